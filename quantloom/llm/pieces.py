"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by longest prefixes of the model's compiled character map (a double-array trie over bytes); every
normalised character keeps the source bytes it came from, so each piece projects to a byte span of the original text.

No piece of a model with white-space splitting holds a space mark after another character, so no merge crosses the
place where a space mark follows another character. The normalised text falls into segments there; equal segments have
equal pieces, and a bounded cache holds those of segments seen before. New segments go to the library in batches.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from .common import rows, texts_of

MARK = "▁"
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class CharacterMap:
    """The compiled map: byte sequences to their normal form, by the longest prefix."""

    def __init__(self, compiled: bytes) -> None:
        self.units: tuple[int, ...] = ()
        if compiled:
            size = struct.unpack_from("<I", compiled)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
            self.forms = compiled[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and normal form of the longest rule that begins at ``at``."""
        units = self.units
        if not units:
            return None
        node, found = _offset(units[0]), None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            unit = units[node]
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.forms[found[1] : self.forms.index(b"\0", found[1])]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 1 << 9) >> 6)


class Normalised:
    """A normalised text, and for each of its characters the source bytes [start, end); a mark that the model put in front
    has an empty span."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: Sequence[int], ends: Sequence[int]) -> None:
        self.text, self.starts, self.ends = text, starts, ends


class Row(NamedTuple):
    """A text's piece ids (also as decimals joined by commas), the span of each in bytes of the original text, and the text
    that the library decodes the ids to. Pieces that fall back to bytes share the span of their character."""

    joined: bytes
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    decoded: str


class Codec:
    """A model's encoder and decoder. ``cache`` bounds the segments kept, ``longest`` the characters of one."""

    def __init__(self, path: str, cache: int = 400_000, longest: int = 48) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze = spec.add_dummy_prefix and not proto.trainer_spec.treat_whitespace_as_suffix, spec.remove_extra_whitespaces
        plain = [p for p in proto.pieces if p.type == p.NORMAL]
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in plain) and not any(p.type == p.USER_DEFINED for p in proto.pieces)
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)
        # characters of the normalised text that a piece takes; of the bytes of one character, the first takes it
        self.widths = np.array([int(int(p.piece[3:5], 16) & 0xC0 != 0x80) if p.type == p.BYTE else 1 if p.type == p.UNKNOWN else len(p.piece) for p in proto.pieces])
        self.decimal = [b"%d" % i for i in range(len(proto.pieces))]
        self.marked = np.array([p.piece.startswith(MARK) for p in proto.pieces])
        # the library's encoder for text that is normalised already
        spec.Clear()
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, True
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.known: dict[str, bytes] = {}
        self.cache, self.longest = cache, longest

    def normalise(self, text: str) -> Normalised:
        """Longest-prefix normalisation with the source of every character."""
        if not self.map.units and not self.squeeze:  # no rule matches anywhere: every character is its own source
            first = [0] if self.prefix and text else []
            raw = np.frombuffer(text.encode(), np.uint8)
            starts = np.flatnonzero(raw & 0xC0 != 0x80)
            ends = np.append(starts, len(raw))[1:]
            return Normalised((" " * len(first) + text).replace(" ", MARK), np.concatenate([first, starts]).astype(np.int32), np.concatenate([first, ends]).astype(np.int32))
        raw, at, pieces = text.encode(), 0, []
        while at < len(raw):
            rule = self.map.longest(raw, at)
            if rule is None:
                n = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                pieces.append((raw[at : at + n].decode(), at, at + n))
            else:
                n = rule[0]
                pieces.append((rule[1].decode(), at, at + n))
            at += n
        chars = [(c, a, b) for form, a, b in pieces for c in form]
        if self.squeeze:
            kept = []
            for c in chars:
                if c[0] != " " or kept and kept[-1][0] != " ":
                    kept.append(c)
            while kept and kept[-1][0] == " ":
                kept.pop()
            chars = kept
        if self.prefix and (chars if self.squeeze else raw):
            first = chars[0][1] if chars else 0
            chars.insert(0, (" ", first, first))
        return Normalised("".join(c for c, _, _ in chars).replace(" ", MARK), [a for _, a, _ in chars], [b for _, _, b in chars])

    def segments(self, normal: str) -> list[str]:
        if not self.splits:
            return [normal] if normal else []
        if normal.startswith(MARK) and MARK * 2 not in normal and not normal.endswith(MARK):
            return normal.split(MARK)[1:]  # without its mark
        return _SEGMENT.findall(normal)

    def forms(self, segments: list[str], bare: bool) -> list[bytes]:
        """Each segment's ids as decimal text. ``bare``: their mark was cut off."""
        known = self.known
        out = list(map(known.get, segments))
        if None in out:
            new = list({s for s, form in zip(segments, out, strict=True) if form is None})
            made = self._together(new) if bare else [b",".join(map(self.decimal.__getitem__, x)) for x in self.bare.encode(new, num_threads=1)]
            made = dict(zip(new, made, strict=True))
            out = [made[s] if form is None else form for s, form in zip(segments, out, strict=True)]
            if len(known) > self.cache:
                known.clear()
            known.update((s, form) for s, form in made.items() if len(s) <= self.longest)
        return out

    def _together(self, bare: list[str]) -> list[bytes]:
        """Encodes segments as one text, in which each begins where a piece has a mark."""
        ids = self.bare.encode(MARK + MARK.join(bare))
        starts = np.flatnonzero(self.marked[np.array(ids)]).tolist()
        texts = list(map(self.decimal.__getitem__, ids))
        return [b",".join(texts[a:b]) for a, b in zip(starts, [*starts[1:], len(texts)], strict=True)]

    def joined(self, normal: str) -> bytes:
        """The ids of a normalised text as decimals joined by commas."""
        segments = self.segments(normal)
        return b",".join(self.forms(segments, bool(segments) and self.splits and segments[0][:1] != MARK and normal[:1] == MARK))

    def row(self, text: str) -> Row:
        """Everything about a text, each part made from the one before: aligned normal form, ids, spans, decoded ids."""
        source = self.normalise(text)
        joined = self.joined(source.text)
        ids = np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32)
        widths = self.widths[ids]
        behind = np.cumsum(widths)
        starts, ends = np.asarray(source.starts, np.int32), np.asarray(source.ends, np.int32)
        return Row(joined, ids, starts[behind - np.maximum(widths, 1)], ends[behind - 1], self.whole.decode(ids.tolist()) if joined else "")


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec of a model file; the cache outlives a task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, starts, ends, decoded`` for each row: all piece ids of the whole text, their byte spans in the
    original text, and the text that the ids decode to. Null texts are empty; an empty text has no pieces and decodes to
    an empty text. Rows repeated are encoded again; null doc_ids stay null; other columns are ignored. ``model`` is the
    path of the model file on every executor."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for part in rows(batches, 32):
            made = [c.row(t) for _, t in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in part], pa.int64()), *(pa.array([getattr(r, k) for r in made], pa.list_(pa.int32())) for k in ("ids", "starts", "ends")), pa.array([r.decoded for r in made], pa.string())],
                names=["doc_id", "ids", "starts", "ends", "decoded"],
            )

    return texts_of(docs).mapInArrow(make, "doc_id bigint, ids array<int>, starts array<int>, ends array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256`` for each row, of the same rows that ``encode_documents``
    gives; ids stay in the worker. ``spans_sha256`` is of start and end of each piece in turn, as little-endian 32-bit
    numbers. Nulls and empty texts as there."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for part in rows(batches):
            n, ids, texts, spans = [], [], [], []
            for _, text in part:
                r = c.row(text)
                n.append(len(r.ids))
                ids.append(hashlib.sha256(r.joined).hexdigest())
                texts.append(hashlib.sha256(r.decoded.encode()).hexdigest())
                spans.append(hashlib.sha256(np.stack([r.starts, r.ends], 1).astype("<i4").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in part], pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts), pa.array(spans)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
            )

    return texts_of(docs).mapInArrow(make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
