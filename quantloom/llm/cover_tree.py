"""A cover tree over vectors, with bounds of inner products.

Vectors get one more coordinate that makes all norms equal (that of the longest), so that the distance to a query tells
the inner product with it. Each node covers its points with a ball; its children cover them with balls of at most
``SHRINK`` times that radius, level by level, and their real radii are kept. A query's inner product with any
point of a ball lies within bounds that follow from the one with the centre: by the triangle inequality in the augmented
space, or by the query's norm times the radius, whichever is tighter. ``best`` descends best first, skips nodes whose bounds lie
outside the wanted window, and takes the products of leaves exactly. ``Search`` takes many queries through trees at once: a node goes
on with the queries that its bounds don't rule out, and where its children are many or small, its points are taken in one product of matrices.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

#: A child's radius as a share of its parent's, and the most points of a leaf.
SHRINK, LEAF = 0.75, 24
#: A node of n points gets n / ``_PER_CHILD`` children at most, and stays a leaf where its points need more.
_PER_CHILD = 8
#: Up to these sums of products, floats and doubles hold every integer.
_SINGLE, _EXACT = 2.0**24, 2.0**53
#: Many queries at once: scores of a tile, and of one in integers of any size; scores of a node that aren't worth its children's bounds; points
#: that a node must hold for each child, as bounds cost more than scores.
_TILE, _LONG_TILE, _FEW, _PER_BOUND = 1 << 19, 1 << 12, 1 << 16, 32
#: Points of a label are scored apart if there are so many scores for each label, and windows are held apart if one of so many scores lies within
#: any of a query's windows or between them.
_PER_LABEL, _MANY = 4096, 16


def reach(points: np.ndarray) -> float:
    """The largest absolute component."""
    return max(-float(points.min(initial=0)), float(points.max(initial=0)))


def narrow(points: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them and their negatives."""
    most = reach(points)
    return points.astype(next((t for t in (np.int16, np.int32) if most <= np.iinfo(t).max), np.int64))


def lengths(points: np.ndarray) -> np.ndarray:
    flat = points.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", flat, flat))


def products(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where these are exact, else in integers of any size."""
    if len(points) and reach(points) * reach(query) * max(1, points.shape[1]) >= _EXACT:
        return np.array([sum(int(a) * int(b) for a, b in zip(p, query, strict=True)) for p in points], object)
    return points.astype(np.float64) @ query.astype(np.float64)


class CoverTree:
    """``points`` (integers, a row each) in the order of the leaves; a node holds the points [begin, end) and the children
    [child, child + children)."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        flat = points.astype(np.float64)
        norms = np.einsum("ij,ij->i", flat, flat)
        self.square = float(norms.max(initial=0.0))
        space = np.hstack([flat, np.sqrt(np.maximum(0.0, self.square - norms))[:, None]])
        order = np.arange(len(points))
        centre, radius, begin, end, child, children = [], [], [], [], [], []

        def node(members: np.ndarray, at: int, middle: int) -> int:
            centre.append(middle)
            gap = space[members] - space[middle]
            away = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            radius.append(float(away.max(initial=0.0)))
            begin.append(at)
            end.append(at + len(members))
            child.append(0)
            children.append(0)
            order[at : at + len(members)] = members
            return len(centre) - 1

        if len(points):
            node(order.copy(), 0, int(np.argmin(((space - space.mean(axis=0)) ** 2).sum(axis=1))))
        todo = 0
        while todo < len(centre):
            members = order[begin[todo] : end[todo]].copy()
            if len(members) > LEAF and radius[todo] > 0:
                most, heads = radius[todo] * SHRINK, [centre[todo]]
                here, head = space[members], np.zeros(len(members), int)
                # norms are equal, so products tell distances but for rounding, which is enough to deal points to children
                near = np.sqrt(np.maximum(0.0, 2 * (self.square - here @ space[centre[todo]])))
                near[members == centre[todo]] = 0
                while (far := int(near.argmax())) >= 0 and near[far] > most and len(heads) <= len(members) // _PER_CHILD:
                    away = np.sqrt(np.maximum(0.0, 2 * (self.square - here @ here[far])))
                    away[far] = 0
                    closer = away < near
                    near[closer], head[closer] = away[closer], len(heads)
                    heads.append(int(members[far]))
                if 1 < len(heads) <= len(members) // _PER_CHILD:  # else the points lie too far from one another for balls to help
                    child[todo], children[todo], at = len(centre), len(heads), begin[todo]
                    for number, middle in enumerate(heads):
                        mine = members[head == number]
                        node(mine, at, middle)
                        at += len(mine)
            todo += 1
        points = narrow(points)
        self.centres = points[np.array(centre, int)] if centre else points[:0]
        self.radius, self.begin, self.end, self.child, self.children = (np.array(x) for x in (radius, begin, end, child, children))
        self.points, self.ids, self.labels = points[order], ids[order], labels[order]

    def query(self, vector: np.ndarray) -> Query:
        return Query(self, vector)


def bounds(centre_products: np.ndarray, radius: np.ndarray, square: float, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of a query with the points of balls; ``square``: the augmented points' squared norm."""
    centre_products = centre_products.astype(np.float64)
    away = np.sqrt(np.maximum(0.0, norm * norm + square - 2 * centre_products))
    slack = 1e-9 * (norm * norm + square) + 1
    nearest, farthest = np.maximum(0.0, away - radius), away + radius
    high = np.minimum((norm * norm + square - nearest**2) / 2, centre_products + norm * radius)
    low = np.maximum((norm * norm + square - farthest**2) / 2, centre_products - norm * radius)
    return low - slack, high + slack


class Query:
    """One query of a tree; inner products are kept over its searches. ``seen`` counts the points that were verified."""

    def __init__(self, tree: CoverTree, vector: np.ndarray):
        self.tree, self.vector, self.norm = tree, vector, math.sqrt(float((vector.astype(np.float64) ** 2).sum()))
        self._balls: dict[int, tuple] = {}
        self._leaves: dict[int, np.ndarray] = {}
        self.seen = 0

    def _bounds(self, key: int, nodes: slice) -> tuple[list[float], list[float]]:
        if key not in self._balls:
            t = self.tree
            low, high = bounds(products(t.centres[nodes], self.vector), t.radius[nodes], t.square, self.norm)
            self._balls[key] = low.tolist(), high.tolist()
        return self._balls[key]

    def best(self, k: int, label: int, same: bool, without: int | None = None, window: tuple[int, int] | None = None, floor: float = -math.inf) -> list[tuple[int, int]]:
        """The first ``k`` points ``(product, id)`` of that label (``same``) or of others, products falling, then ids rising; the
        products within ``window``. Points below ``floor`` may be left out."""
        t, found, heap = self.tree, [], []
        least, most = window or (-math.inf, math.inf)
        least = max(least, floor)

        def offer(key: int, nodes: slice) -> None:
            for number, (low, high) in enumerate(zip(*self._bounds(key, nodes), strict=True), nodes.start):
                if high >= least and low <= most:
                    heapq.heappush(heap, (-min(high, most), number))

        if len(t.points):
            offer(-1, slice(0, 1))
        while heap:
            bound, number = heapq.heappop(heap)
            if len(found) == k and -bound < found[0][0]:
                break
            if t.children[number]:
                offer(number, slice(t.child[number], t.child[number] + t.children[number]))
                continue
            begin, end = t.begin[number], t.end[number]
            if number not in self._leaves:
                self._leaves[number] = products(t.points[begin:end], self.vector)
                self.seen += end - begin
            score, ids = self._leaves[number], t.ids[begin:end]
            fits = (score >= least) & (score <= most) & ((t.labels[begin:end] == label) == same)
            if without is not None:
                fits &= ids != without
            if len(found) == k:
                fits &= score >= found[0][0]
            hits = np.flatnonzero(fits)
            if len(hits) > k:
                hits = hits[np.lexsort((ids[hits], -score[hits]))[:k]]
            for at in hits:
                entry = (int(score[at]), -int(ids[at]))
                if len(found) < k:
                    heapq.heappush(found, entry)
                elif entry > found[0]:
                    heapq.heapreplace(found, entry)
        return [(score, -number) for score, number in sorted(found, reverse=True)]


class Search:
    """Many queries over trees met one after another, each query with the same number of windows ``least`` to ``most`` (a row a
    query). For each window the first ``k`` points of the query's label (``same``) or of others are kept, products falling,
    then ids rising, but never the point with the query's own id. No two points have the same id."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool):
        self.vectors, self.ids, self.labels, self.k, self.same = vectors, ids, labels, k, same
        self.least, self.most = _exact(least), _exact(most)
        self.norm = lengths(vectors)
        self._single, self._double = vectors.astype(np.float32), vectors.astype(np.float64)
        self.score = np.full((*least.shape, k), -math.inf)
        self.number = np.full((*least.shape, k), np.iinfo(np.int64).max)
        self._pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._waiting, self._room = 0, max(_FEW, self.score.size)
        self._tighten()

    def _tighten(self) -> None:
        """What a point must reach now in each window, and in any of a query's windows."""
        self.floor = np.maximum(self.least, self.score[:, :, -1])
        self._low = self.floor.min(axis=1, initial=math.inf).astype(np.float64)
        self._high = self.most.max(axis=1, initial=-math.inf).astype(np.float64)

    def meet(self, tree: CoverTree) -> None:
        if not len(tree.points) or not len(self.ids):
            return
        norms, points = lengths(tree.points), {}
        todo = [(0, np.flatnonzero(self._need(tree, slice(0, 1), np.arange(len(self.ids)))[:, 0]))]
        while todo:
            at, who = todo.pop()
            begin, end, children = int(tree.begin[at]), int(tree.end[at]), int(tree.children[at])
            scores = len(who) * (end - begin)
            if children and children * _PER_BOUND <= end - begin and scores > _FEW:
                nodes = slice(int(tree.child[at]), int(tree.child[at]) + children)
                need = self._need(tree, nodes, who)
                todo += [(nodes.start + c, who[need[:, c]]) for c in range(children)]
            elif scores:
                self._scan(tree, norms, points, begin, end, who)

    def _need(self, tree: CoverTree, nodes: slice, who: np.ndarray) -> np.ndarray:
        """For each query and node, whether its ball may hold a point of a window."""
        low, high = bounds(self._double[who] @ tree.centres[nodes].astype(np.float64).T, tree.radius[nodes], tree.square, self.norm[who][:, None])
        return (high >= self._low[who][:, None]) & (low <= self._high[who][:, None])

    def _scan(self, tree: CoverTree, norms: np.ndarray, points: dict, begin: int, end: int, who: np.ndarray) -> None:
        places, asked = tree.labels[begin:end], self.labels[who]
        both = np.intersect1d(places, asked) if self.same else []
        if self.same and len(both) * _PER_LABEL <= len(who) * (end - begin):
            tiles = [(who[asked == label], begin + np.flatnonzero(places == label)) for label in both]
        else:
            tiles = [(who, slice(begin, end))]
        for queries, columns in tiles:
            longest = self.norm[queries] * norms[columns].max() * (1 + 1e-9)
            for kind, above, below in ((np.float32, -1.0, _SINGLE), (np.float64, _SINGLE, _EXACT)):
                if len(part := queries[(longest >= above) & (longest < below)]):
                    self._take(tree, self._as(points, tree, kind), columns, part)
            if len(part := queries[longest >= _EXACT]):
                columns = np.arange(len(norms))[columns]
                far = norms[columns] * self.norm[part].max() * (1 + 1e-9) >= _EXACT
                if not far.all():
                    self._take(tree, self._as(points, tree, np.float64), columns[~far], part)
                if far.any():
                    self._take(tree, None, columns[far], part)

    @staticmethod
    def _as(points: dict, tree: CoverTree, kind: type) -> np.ndarray:
        if kind not in points:
            points[kind] = tree.points.astype(kind)
        return points[kind]

    def _take(self, tree: CoverTree, points: np.ndarray | None, columns: slice | np.ndarray, who: np.ndarray) -> None:
        """Score points for queries and keep what reaches a window; without ``points``, in integers of any size."""
        ids, labels = tree.ids[columns], tree.labels[columns]
        long = points is None
        there = tree.points[columns].astype(object).T if long else points[columns].T
        step = max(1, (_LONG_TILE if long else _TILE) // len(ids))
        for at in range(0, len(who), step):
            part = who[at : at + step]
            every = range(self.least.shape[1])
            if long:
                scores = self.vectors[part].astype(object) @ there
                found = [(every, np.arange(scores.size))]
            else:
                vectors, most = (self._single, _SINGLE) if points.dtype == np.float32 else (self._double, _EXACT)
                limit = lambda x: np.clip(x[part].astype(np.float64), -most, most).astype(points.dtype)[:, None]  # noqa: B023, E731
                scores = vectors[part] @ there
                found = [(every, np.flatnonzero(scores >= limit(self._low)))]
                if len(found[0][1]) * _MANY > scores.size:
                    found = [([w], np.flatnonzero((scores >= limit(self.floor[:, w])) & (scores <= limit(self.most[:, w])))) for w in every]
            for windows, places in found:
                row, column = np.divmod(places, len(ids))
                query, number = part[row], ids[column]
                fits = ((labels[column] == self.labels[query]) == self.same) & (number != self.ids[query])
                score = scores.reshape(-1)[places[fits]]
                self._offer(windows, query[fits], number[fits], score if long else score.astype(np.float64))
            if self._waiting > self._room:
                self._merge()

    def _offer(self, windows: range | list[int], query: np.ndarray, number: np.ndarray, score: np.ndarray) -> None:
        if score.dtype == object and self.score.dtype != object:
            self.score = self.score.astype(object)
        for window in windows:
            last = self.score[query, window, -1]
            fits = (score >= self.floor[query, window]) & (score <= self.most[query, window]) & ((score > last) | (number < self.number[query, window, -1]))
            fits = np.flatnonzero(fits)
            if len(fits):
                self._pending.append((query[fits] * self.least.shape[1] + window, score[fits], number[fits]))
                self._waiting += len(fits)

    def _merge(self) -> None:
        if not self._pending:
            return
        k, best, numbers = self.k, self.score.reshape(-1, self.k), self.number.reshape(-1, self.k)
        slot, score, number = (np.concatenate(x) for x in zip(*self._pending, strict=True))
        self._pending, self._waiting = [], 0
        touched = np.unique(slot)
        slot, score, number = np.concatenate([slot, np.repeat(touched, k)]), np.concatenate([score, best[touched].ravel()]), np.concatenate([number, numbers[touched].ravel()])
        falling = np.unique(-score, return_inverse=True)[1] if score.dtype == object else -score
        order = np.lexsort((number, falling, slot))
        slot = slot[order]
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.concatenate([first, [len(slot)]])))
        top = order[place < k]  # k of each slot, as it had k before
        best[touched], numbers[touched] = score[top].reshape(-1, k), number[top].reshape(-1, k)
        self._tighten()

    def floors(self) -> np.ndarray:
        """What the points met so far show that the ``k``-th of each window reaches at least."""
        self._merge()
        return self.floor

    def answers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The query's and the window's place, the score and the id of each point kept."""
        self._merge()
        query, window, place = np.nonzero(self.score != -math.inf)
        return query, window, self.score[query, window, place], self.number[query, window, place]


def _exact(bounds_: np.ndarray) -> np.ndarray:
    """Doubles if they hold these bounds, else integers of any size."""
    if bounds_.dtype != object:
        return bounds_.astype(np.float64) if bounds_.dtype.kind == "f" or reach(bounds_) < _EXACT else bounds_.astype(object)
    held = all(x in (math.inf, -math.inf) or abs(x) < _EXACT for x in bounds_.ravel())
    return bounds_.astype(np.float64) if held else bounds_
