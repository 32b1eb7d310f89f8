"""Token ids in wavelet-matrix shards.

Documents are put in ascending doc_id order by ranges, encoded, and cut into shards of about ``SHARD`` ids. A shard is one
compressed file: the distinct ids of the shard, the documents' ids and starts, and a wavelet matrix over the rank of each
id among the distinct ones, one plane of bits for each bit of the rank. The file holds a directory of the set bits before
each page of a plane, so that ``ShardFile`` answers what id stands at a position, how often an id occurs before one, and where
its k-th occurrence is, by reading a page or two of each plane, without unpacking the ids.

File: ``QLWM``, five little-endian numbers (format, ids, documents, distinct ids, planes), then zlib blocks, each behind
its length: distinct ids (uint32), doc ids (int64), a null flag for each, starts (uint64, one more than documents), and the
directory (uint64: for each page, plane by plane, its end and the set bits of its plane before it). Pages follow, each of
``_PAGE`` bytes before compression, of the planes from the highest bit down (eight positions a byte, lowest bit first).
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import file_system, rows, settle, shared_folder, texts_of

#: Ids after which a shard ends, at the next document's end.
SHARD = 1 << 20
END = 0
_BLOCK = 512
_PAGE = 1 << 14
_FORMAT = 2


def _pack(data: bytes) -> bytes:
    """A zlib stream; data whose bytes are all about as common is stored in it."""
    share = np.bincount(np.frombuffer(data, np.uint8)) / max(1, len(data))
    share = share[share > 0]
    return zlib.compress(data, 1 if -(share * np.log2(share)).sum() < 7.5 else 0)


class _Wavelet:
    """Answers over bit planes; how bits are counted is up to the subclass."""

    alphabet: np.ndarray
    zeros: list[int]
    n: int

    def access(self, at: int) -> int:
        """The id at a position."""
        rank = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, at), self._ones(level, at)
            at = zeros + ones if bit else at - ones
            rank = rank << 1 | bit
        return int(self.alphabet[rank])

    def _bits(self, token: int) -> list[int] | None:
        rank = int(np.searchsorted(self.alphabet, token))
        if rank == len(self.alphabet) or self.alphabet[rank] != token:
            return None
        return [rank >> i & 1 for i in range(len(self.zeros) - 1, -1, -1)]

    def count(self, token: int, first: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in [first, end)."""
        bits, end = self._bits(token), self.n if end is None else end
        if bits is None:
            return 0
        for level, bit in enumerate(bits):
            a, b = self._ones(level, first), self._ones(level, end)
            first, end = (self.zeros[level] + a, self.zeros[level] + b) if bit else (first - a, end - b)
        return end - first

    def find(self, token: int, k: int) -> int | None:
        """Position of the k-th (from 0) occurrence of an id."""
        bits = self._bits(token)
        if bits is None or not 0 <= k < self.count(token):
            return None
        at = 0
        for level, bit in enumerate(bits):
            ones = self._ones(level, at)
            at = self.zeros[level] + ones if bit else at - ones
        at += k
        for level in range(len(bits) - 1, -1, -1):
            at = self._select_bit(level, bits[level], at - self.zeros[level] * bits[level])
        return at


class WaveletShard(_Wavelet):
    """Ids of consecutive documents as a wavelet matrix."""

    def __init__(self, alphabet: np.ndarray, docs: list[int | None], starts: np.ndarray, planes: list[np.ndarray], n: int) -> None:
        self.alphabet, self.docs, self.starts, self.planes, self.n = alphabet, docs, starts, planes, n
        self.before = []  # set bits before each block of each plane
        for plane in planes:
            ones = np.zeros(-(-len(plane) * 8 // _BLOCK) + 1, dtype=np.int64)
            padded = np.zeros((len(ones) - 1) * _BLOCK // 8, dtype=np.uint8)
            padded[: len(plane)] = plane
            ones[1:] = np.cumsum(np.bitwise_count(padded).reshape(-1, _BLOCK // 8).sum(axis=1, dtype=np.int64))
            self.before.append(ones)
        self.zeros = [n - int(ones[-1]) for ones in self.before]

    @classmethod
    def of(cls, ids: np.ndarray, docs: list[int | None], starts: np.ndarray) -> WaveletShard:
        seen = np.bincount(ids) > 0 if len(ids) else np.zeros(0, dtype=bool)
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        width = max(len(alphabet) - 1, 0).bit_length()
        kind = np.uint16 if width <= 16 else np.uint32
        ranks = (np.cumsum(seen) - 1).astype(kind)[ids] if len(ids) else np.zeros(0, kind)
        planes = []
        for bit in range(width - 1, -1, -1):
            ones = (ranks & kind(1 << bit)).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            ranks = np.concatenate([np.compress(~ones, ranks), np.compress(ones, ranks)])
        return cls(alphabet, docs, starts, planes, len(ids))

    def to_bytes(self) -> bytes:
        nulls = np.array([d is None for d in self.docs], dtype=np.uint8)
        ids = np.array([d or 0 for d in self.docs], dtype="<i8")
        pages, directory, end = [], [], 0
        for level, plane in enumerate(self.planes):
            for at in range(0, len(plane), _PAGE):
                pages.append(_pack(plane[at : at + _PAGE].tobytes()))
                end += len(pages[-1])
                directory.append((end, int(self.before[level][at * 8 // _BLOCK])))
        out = [b"QLWM", struct.pack("<5Q", _FORMAT, self.n, len(self.docs), len(self.alphabet), len(self.planes))]
        for block in (self.alphabet.astype("<u4"), ids, nulls, self.starts.astype("<u8"), np.array(directory, "<u8")):
            packed = _pack(block.tobytes())
            out += [struct.pack("<Q", len(packed)), packed]
        return b"".join(out + pages)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletShard:
        shard = ShardFile(io.BytesIO(data))
        planes = [np.frombuffer(b"".join(shard._page(level * shard.each + k) for k in range(shard.each)), np.uint8) for level in range(shard.planes)]
        return cls(shard.alphabet, shard.docs, shard.starts, planes, shard.n)

    def _ones(self, level: int, at: int) -> int:
        """Set bits of a plane before a position."""
        block, plane = at // _BLOCK, self.planes[level]
        first, last = block * _BLOCK // 8, at // 8
        n = int(self.before[level][block]) + int(np.bitwise_count(plane[first:last]).sum())
        return n + (int(plane[last]) & (1 << at % 8) - 1).bit_count() if at % 8 else n

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at // 8]) >> at % 8 & 1

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value."""
        ones = self.before[level]
        counts = ones if bit else np.arange(len(ones)) * _BLOCK - ones
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * _BLOCK // 8 : (block + 1) * _BLOCK // 8], bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def tokens(self) -> np.ndarray:
        """All ids, from the planes."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        ranks = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(ranks)
            above[np.concatenate([np.flatnonzero(~ones), np.flatnonzero(ones)])] = ranks
            above |= ones.astype(kind) << kind(len(self.planes) - 1 - level)
            ranks = above
        return self.alphabet[ranks] if self.n else np.zeros(0, np.uint32)


class ShardFile(_Wavelet):
    """A shard in a file that is open for reading and seeking: header and directory are read, then pages as they are needed."""

    def __init__(self, source, cache: int = 64) -> None:
        self.source = source
        if source.read(4) != b"QLWM":
            raise ValueError("not a token shard")
        form, self.n, n_docs, _, self.planes = struct.unpack("<5Q", source.read(40))
        if form != _FORMAT:
            raise ValueError(f"unknown shard format {form}")
        blocks = [zlib.decompress(source.read(struct.unpack("<Q", source.read(8))[0])) for _ in range(5)]
        self.first = source.tell()
        self.alphabet, self.starts = np.frombuffer(blocks[0], "<u4"), np.frombuffer(blocks[3], "<u8").astype(np.int64)
        self.docs = [None if null else d for d, null in zip(np.frombuffer(blocks[1], "<i8").tolist(), blocks[2], strict=True)]
        directory = np.frombuffer(blocks[4], "<u8").reshape(-1, 2)
        self.ends, self.ones = [0, *directory[:, 0].tolist()], directory[:, 1].tolist()
        self.each = -(-(-(-self.n // 8)) // _PAGE)  # pages of a plane
        if len(self.docs) != n_docs or len(self.ones) != self.each * self.planes:
            raise ValueError("damaged token shard")
        self.page = lru_cache(cache)(self._page)
        self.zeros = [self.n - self._ones(level, self.n) for level in range(self.planes)]

    def _page(self, k: int) -> bytes:
        self.source.seek(self.first + self.ends[k])
        return zlib.decompress(self.source.read(self.ends[k + 1] - self.ends[k]))

    def _ones(self, level: int, at: int) -> int:
        page = min(at // (8 * _PAGE), self.each - 1)
        data, at = self.page(level * self.each + page), at - page * 8 * _PAGE
        n = self.ones[level * self.each + page] + int(np.bitwise_count(np.frombuffer(data, np.uint8)[: at // 8]).sum())
        return n + (data[at // 8] & (1 << at % 8) - 1).bit_count() if at % 8 else n

    def _bit(self, level: int, at: int) -> int:
        return self.page(level * self.each + at // (8 * _PAGE))[at // 8 % _PAGE] >> at % 8 & 1

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        ones = np.array(self.ones[level * self.each : (level + 1) * self.each])
        counts = ones if bit else np.arange(len(ones)) * 8 * _PAGE - ones
        page = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(np.frombuffer(self.page(level * self.each + page), np.uint8), bitorder="little")
        return page * 8 * _PAGE + int(np.flatnonzero(bits == bit)[k - int(counts[page])])


#: A mark in front of what has no space in front of it.
_BARE = "\x01"


class Encoder:
    """The library's ids of whole texts. What stands between spaces is encoded once and kept, in a bounded cache.

    The tokenizer's pattern never joins a character to the space or line feed behind it, so a text falls apart in front of
    those, and in front of the signs that end a word of letters; texts in which white space stands beside white space go to
    the library whole. New words go to it as one text: each begins at the one id that begins with its space or line feed.
    """

    #: White space besides space and line feed, by the Unicode tables of either library.
    OTHER = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

    def __init__(self, path: str, cache: int = 500_000, longest: int = 48) -> None:
        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.spaced = np.zeros(size, dtype=bool)
        self.spaced[[i for token, i in self.library.get_vocab().items() if token.startswith("\u0120")]] = True
        self.feed = self.library.token_to_id("\u010a")
        self.known: dict[str, bytes] = {_BARE: b""}
        self.once: dict[str, bytes] = {}
        self.cache, self.longest = cache, longest

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _falls_apart(self, text: str) -> bool:
        return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in " \n" or text[-1:] in " \n" or "<|" in text or _BARE in text or any(c in text for c in self.OTHER))

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words: those marked bare without a space in front, those that begin with a line feed with it, others
        with a space."""
        spaced, others = [w for w in words if w[0] not in "\n\x01"], [w for w in words if w[0] in "\n\x01"]
        out, size = {}, self.kind.itemsize
        for group, text in ((spaced, "".join(" " + w for w in spaced)), (others, "".join("\n" + w[1:] for w in others))):
            if not group:
                continue
            ids = self.whole([text])[0]
            starts = np.flatnonzero(self.spaced[ids] if group is spaced else ids == self.feed)
            if len(starts) != len(group):
                raise ValueError("a word doesn't begin where a token does")
            data, begins, ends = ids.tobytes(), (starts * size).tolist(), (np.append(starts, len(ids))[1:] * size).tolist()
            out |= {w: data[a + size if w[0] == _BARE else a : b] for w, a, b in zip(group, begins, ends, strict=True)}
        return out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self._falls_apart(t)]
        for i, ids in zip(whole, self.whole([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = ids
        places = [i for i, x in enumerate(out) if x is None]
        if not places:
            return out
        marked = pc.replace_substring(pa.array([_BARE + texts[i] for i in places], pa.large_string()), "\n", " \n")
        marked = pc.replace_substring_regex(marked, pattern="([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?]+)( |$)", replacement=f"\\1 {_BARE}\\2\\3")
        lists = pc.split_pattern(marked, " ")
        cuts = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()

        known, once = self.known, self.once
        ids = list(map(known.get, words))
        new = []
        for i, x in enumerate(ids):  # most words of a text collection occur once: a word is kept for good when it comes again
            if x is None:
                w = words[i]
                found = once.pop(w, None)
                if found is None:
                    new.append(i)
                else:
                    ids[i] = known[w] = found
        made = self._learn([words[i] for i in new])
        for i in new:
            ids[i] = made[words[i]]
        once.update((w, x) for w, x in made.items() if len(w) <= self.longest)
        if len(once) > self.cache // 2:
            once.clear()
        if len(known) > self.cache:  # what is common is in this batch too
            self.known = {_BARE: b""} | {w: known[w] for w in words if w in known}

        flat = np.frombuffer(b"".join(ids), self.kind)
        sizes = np.array(list(map(len, ids)), dtype=np.int64) // self.kind.itemsize
        starts = np.cumsum(sizes) - sizes
        each = sizes[at]
        ends = np.cumsum(each)
        tokens = flat[np.arange(ends[-1]) + np.repeat(starts[at] - ends + each, each)]
        edges = np.concatenate([[0], ends])[cuts]
        for i, a, b in zip(places, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out[i] = tokens[a:b]
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shard: int = SHARD) -> DataFrame:
    """Encodes ``docs`` and writes the shards into ``folder`` (a URI that all executors share).

    Returns the manifest, a row for each shard: ``part, seq, path, n_tokens, n_docs``; part then seq is the order of the
    ids. Every document ends with id 0. Rows are in ascending doc_id order, null doc_ids first, rows of one doc_id by
    their text. A null or empty text is the end id alone. An empty table makes no shard. Files have names of their own
    for each attempt, and the manifest lists those of finished tasks alone.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, attempt = encoder(tokenizer), TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        pending, ids, n, seq = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal pending, ids, n, seq
            starts = np.concatenate([[0], np.cumsum([len(x) for x in pending])])
            name = f"{part:06d}-{seq:06d}-{attempt}.qlwm"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(WaveletShard.of(np.concatenate(pending), ids, starts).to_bytes())
            row = {"part": [part], "seq": [seq], "path": [f"{folder}/{name}"], "n_tokens": [n], "n_docs": [len(ids)]}
            pending, ids, n, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]))

        end = np.array([END], enc.kind)
        for rows_ in rows(batches, 2048):
            for (doc_id, _), x in zip(rows_, enc.encode_many([t for _, t in rows_]), strict=True):
                x = np.concatenate([x, end])
                pending.append(x)
                ids.append(doc_id)
                n += len(x)
                if n >= shard:
                    yield flush()
        if ids:
            yield flush()

    ordered = texts_of(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return settle(ordered.mapInArrow(write, "part int, seq int, path string, n_tokens bigint, n_docs bigint"), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    placed = manifest.select("part", "path", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("inside")).join(parts, "part")
    placed = placed.select("path", (F.col("ahead") + F.col("inside")).alias("start")).repartition(min(max(1, manifest.count()), 20_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows(batches, 1):
            for path, start in part:
                fs, at = file_system(path)
                with fs.open_input_stream(at) as f:
                    shard = WaveletShard.from_bytes(f.read())
                ids, s = shard.tokens().astype("<u4"), shard.starts.tolist()
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(s, s[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.docs, pa.int64()), pa.array(shard.starts[:-1] + start, pa.int64()), pa.array(np.diff(shard.starts), pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, shard: int = SHARD) -> DataFrame:
    """Writes the shards to the shared folder and reads the documents back from them."""
    return read_shards(write_shards(docs, tokenizer, shared_folder(docs.sparkSession, "token-shards"), shard))
