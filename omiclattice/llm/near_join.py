"""Set-similarity join of documents on word shingles, through count-vector R-trees.

A document's shingles are hashed to 64 bits; its set is cut into groups by
hash range, and the group sizes are its point. Two sets overlap by at most the
sum of the coordinate minima of their points, so an R-tree over points (each
node keeps coordinate maxima and the size range) finds all pairs that may
reach the threshold; these are verified on the sets.

One tree over all documents would be searched almost whole, since large texts
have similar counts. Trees are therefore built per bucket. Buckets lose no pair:
sets at Jaccard >= t differ in at most d shingles, d known from their sizes,
so of more than d non-empty groups at least one is the same in both, and equal
groups meet on a key. What hangs together by pairs that the points of 256
coordinates allow is a block; blocks with large sets are split again by points
with about a coordinate a shingle. Only then are the texts of what is left
gathered and searched by a tree with verification. Buckets and blocks above a
size are searched in tiles: tiles with a common pivot first, then the tile
pairs that still hold unlinked parts, to which only texts go that their points
allow to link with one of the other tile.

Everything up to the components is keyed by the set (64 bits of its signature),
not by document: equal sets take part once, and a document with several texts
brings each. Equal sets themselves are told by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from omiclattice.llm import words
from omiclattice.llm.graph import components
from omiclattice.llm.storage import picked, settle

#: Coordinates of a point; sets of twice as many shingles also have a point with a coordinate for one or two shingles.
GROUPS = 256
#: Points in a leaf; in buckets that are one leaf and compared side by side; and columns, for each coordinate, of points written as 0 and 1.
LEAF, SIDE_BY_SIDE, ONES = 64, 16, 16
#: In a tile, on average: shingles of sets, and points and their coordinates where only these are compared.
TILE, POINTS, COORDINATES = 1 << 18, 4096, 1 << 21
#: Bits of the filter that tells which texts are needed: 4 MB in each task, whatever the input.
MEMBERS = 1 << 25

_K = words.mix(np.arange(1, 65, dtype=np.uint64))  # factors of the hashes below


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each row's ``size``-word shingles; shorter texts are one shingle."""
    h, row, _, _ = words.words(buf, offs)
    at = words.spans(row, len(offs) - 1)
    long = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size):
        long += h[i:i + len(long)] * (_K[i] | np.uint64(1))
    long = words.mix(long)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= size:
            yield np.unique(long[a:b - size + 1])
        elif b > a:
            whole = (h[a:b] * (_K[32:32 + b - a] | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(b - a)
            yield words.mix(np.array([whole], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def few(percent: int) -> int:
    """Up to this size, linked sets differ in at most one shingle on either side."""
    return -(-200 // (100 - percent)) - 1


def size_classes(percent: int, top: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the classes of the smaller set's size, and the most shingles a linked pair may differ in."""
    low = [-(-percent * (few(percent) + 1) // 100)]  # the smallest partner of a set above ``few``
    while low[-1] < top:
        low.append(low[-1] + max(2, int(low[-1] * (0.15 if low[-1] < 40 else 0.6))))
    hi = np.array(low[1:], np.int64) - 1
    most = hi + hi * 100 // percent
    return np.array(low[:-1], np.int64), (100 - percent) * most // (100 + percent)


def meeting_keys(s: np.ndarray, percent: int, classes: tuple[np.ndarray, np.ndarray], bounds: dict[int, np.ndarray]) -> np.ndarray:
    """Keys such that two sets at the threshold have one in common.

    Small sets meet by the set less one shingle, larger ones by equal groups of their size class.
    """
    n, out = len(s), []
    if not n:
        return s
    mixed = words.mix(s)
    if n <= few(percent):
        whole = mixed.sum(dtype=np.uint64)
        out.append(words.mix(np.r_[whole, whole - mixed] + _K[60]))
    low, differ = classes
    if n >= low[0]:
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed, out=sums[1:])
        first = np.searchsorted(low, max(low[0], -(-n * percent // 100)), "right") - 1
        for k in range(first, np.searchsorted(low, n, "right")):
            groups = int(differ[k]) + 1
            groups += -(-groups // 50)
            if groups not in bounds:
                bounds[groups] = np.array([(i << 64) // groups for i in range(1, groups)], np.uint64)
            at = np.r_[0, np.searchsorted(s, bounds[groups]), n]
            key = sums[at[1:]] - sums[at[:-1]] + np.arange(groups, dtype=np.uint64) * _K[61] + _K[40:41] * np.uint64(k + 1)
            full = np.diff(at) > 0
            # with too few non-empty groups, equal empty ones count as well
            out.append(words.mix(key if full.sum() <= differ[k] else key[full]))
    return np.concatenate(out)


def name_of(s: np.ndarray) -> np.uint64:
    """The set's name: the first half of its signature."""
    return words.mix(s).sum(dtype=np.uint64)


def meetings(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(bucket, doc): sets, by name, that share a key; buckets of the same sets are one."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, bounds = size_classes(percent), {}
        for rows, buf, offs in words.chunks(batches, text, 1 << 20):
            found = {}  # equal sets are one
            for x in shingle_sets(buf, offs, size):
                if len(x) and (name := name_of(x)) not in found:
                    found[name] = meeting_keys(x, percent, classes, bounds)
            names, own = np.array(list(found), np.uint64), list(found.values())
            key = np.concatenate(own) if own else names
            yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "doc": np.repeat(names, [len(x) for x in own]).view(np.int64)})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        key, doc = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
        key, doc = key[new], doc[new]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[start, len(key)])
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(words.mix(doc.astype(np.uint64)), dtype=np.uint64)]
        name = words.mix(sums[start + count] - sums[start])  # of the documents in it
        _, once = np.unique(name, return_index=True)
        once = once[count[once] > 1]
        at = np.repeat(start[once] - np.r_[0, np.cumsum(count[once])[:-1]], count[once]) + np.arange(count[once].sum())
        yield pa.RecordBatch.from_pydict({"bucket": np.repeat(name[once], count[once]).view(np.int64), "doc": doc[at]})

    named = picked(docs, doc_id, text).where(F.col(doc_id).isNotNull())
    return named.mapInArrow(keys, "key long, doc long").repartition("key").mapInArrow(meet, "bucket long, doc long").distinct()


def point(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Sizes of the set's groups by hash range; ``groups`` is a power of two."""
    return np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def fine(n: int) -> int:
    """Coordinates of the fine point of a set of ``n`` shingles."""
    return max(GROUPS, 1 << n.bit_length() >> 1)


def packed(x: np.ndarray) -> bytes:
    width = next(w for w in (1, 2, 4) if x.max() < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1)


class Tree:
    """Packed binary R-tree over count vectors: a node keeps coordinate maxima, the size range and its slice."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order, self.points, self.sizes = np.arange(len(sizes)), points, sizes
        self.nodes: list[tuple] = []
        self._build(0, len(sizes))

    def _build(self, a: int, b: int) -> int:
        rows = self.order[a:b]
        at = len(self.nodes)
        box = (self.points[rows].max(0), int(self.sizes[rows].min()), int(self.sizes[rows].max()), a, b)
        self.nodes.append(box)
        kids = ()
        if b - a > LEAF:
            both = np.c_[self.sizes[rows], self.points[rows]]
            axis = int(np.argmax(np.ptp(both, axis=0)))
            self.order[a:b] = rows[np.argsort(both[:, axis], kind="stable")]
            mid = (a + b) // 2
            kids = (self._build(a, mid), self._build(mid, b))
        self.nodes[at] = (*box, kids)
        return at


def _ones(points: np.ndarray) -> np.ndarray | None:
    """Rows of 0 and 1 whose products are the sums of coordinate minima: a coordinate becomes a column for each count that two rows reach."""
    if not len(points) or int(points.max(0).sum()) > ONES * points.shape[1]:
        return None
    out = []
    for k in range(1, int(points.max()) + 1):
        reach = points >= k
        out.append(reach[:, reach.sum(0) > 1])
    return np.concatenate(out, 1).astype(np.float32) if out else np.zeros((len(points), 0), np.float32)


def near_pairs(points: np.ndarray, label: np.ndarray, rows: np.ndarray, lowest: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(u, v): all pairs of ``rows`` that the points allow, a leaf pair at a time; pairs of one ``label`` and those without a ``lowest`` row are left out.

    The caller may merge labels on the way.
    """
    sizes = points.sum(1)
    tree = Tree(points, sizes)
    order, ones = tree.order, _ones(points)

    def far(overlap, a, b):
        return (100 + percent) * overlap < percent * (a + b)

    def whole(n):
        own = label[rows[order[n[3]:n[4]]]]
        return own[0] if (own == own[0]).all() else None

    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        x, y = tree.nodes[i], tree.nodes[j]
        if 100 * min(x[2], y[2]) < percent * max(x[1], y[1]) or far(int(np.minimum(x[0], y[0]).sum()), x[1], y[1]):
            continue
        one = whole(x)
        if one is not None and one == whole(y):
            continue
        if x[5] or y[5]:
            if i == j:
                stack += [(x[5][0], x[5][1]), (x[5][1], x[5][1]), (x[5][0], x[5][0])]
            elif not y[5] or x[5] and x[4] - x[3] >= y[4] - y[3]:
                stack += [(k, j) for k in x[5]]
            else:
                stack += [(i, k) for k in y[5]]
            continue
        left, right = order[x[3]:x[4]], order[y[3]:y[4]]
        if ones is None:
            other = points[right]
            bound = np.array([np.minimum(points[p], other).sum(1) for p in left])
        else:
            bound = (ones[left] @ ones[right].T).astype(np.int64)
        near = ~far(bound, sizes[left][:, None], sizes[right][None]) & (label[rows[left]][:, None] != label[rows[right]][None])
        p, q = np.nonzero(near & (lowest[left][:, None] | lowest[right][None]))
        if len(p):
            yield rows[left[p]], rows[right[q]]


def levels(vectors: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(points, rows, lowest): each pair of sizes that may link meets once, at the coordinates of its smaller set."""
    width = np.array([len(x) for x in vectors])
    reach = 1 << max(0, int(np.ceil(np.log2(100 / percent))))
    for w in np.unique(width):
        rows = np.flatnonzero((width >= w) & (width <= w * reach))
        if len(rows) > 1:
            yield np.array([vectors[i].reshape(w, -1).sum(1) for i in rows], np.int32), rows, width[rows] == w


def links_of(vectors: list[np.ndarray], label: np.ndarray, percent: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join labels: of all pairs that the points allow, or that the ``sets`` confirm."""
    label, out = label.copy(), []
    for points, rows, lowest in levels(vectors, percent):
        for us, vs in near_pairs(points, label, rows, lowest, percent):
            for u, v in zip(us, vs):
                if label[u] == label[v]:
                    continue
                n = 0 if sets is None else len(sets[u]) + len(sets[v])
                if sets is None or (100 + percent) * len(np.intersect1d(sets[u], sets[v], assume_unique=True)) >= percent * n:
                    out.append((int(u), int(v)))
                    label[label == label[v]] = label[u]
    return out


def wanted(vectors: list[np.ndarray], label: np.ndarray, tile: np.ndarray, percent: int) -> np.ndarray:
    """Which rows may link with one of another label and tile."""
    keep = np.zeros(len(label), bool)
    for points, rows, lowest in levels(vectors, percent):
        for u, v in near_pairs(points, label, rows, lowest, percent):
            apart = tile[u] != tile[v]
            keep[u[apart]] = keep[v[apart]] = True
    return keep


def _tiles(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """(key, columns) of each run of rows with equal keys that has more than one row."""
    rows, name = {k: [] for k in names}, None
    for batch in batches:
        cols = {k: batch.column(k).to_pylist() for k in names}
        for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
            if key != name:
                if len(rows[names[0]]) > 1:
                    yield name, rows
                rows, name = {k: [] for k in names}, key
            for k in names:
                rows[k].append(cols[k][i])
    if len(rows[names[0]]) > 1:
        yield name, rows


def _dealt(tiles: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return tiles.select(*keys, *names).repartition(*keys).sortWithinPartitions(*keys, "doc")


def _rest(names: list[str], keys: list[str], held: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(held).select([*keys, *names]).combine_chunks()


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds): rows of whole runs with equal keys, and where each begins; a run longer than a batch comes alone."""
    held: list[pa.RecordBatch] = []

    def differ(x: pa.RecordBatch, y: pa.RecordBatch) -> bool:
        return any(x.column(k)[-1] != y.column(k)[0] for k in keys)

    def bounds(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table) - 1, bool)
        for k in keys:
            at = table[k].to_numpy()
            new |= at[1:] != at[:-1]
        return np.r_[0, np.flatnonzero(new) + 1, len(table)]

    for batch in batches:
        if not batch.num_rows:
            continue
        last = {k: batch.column(k)[-1] for k in keys}
        if held and all(batch.column(k)[0] == last[k] for k in keys) and not differ(held[-1], batch):
            held.append(batch)  # the run goes on through the whole batch
            continue
        table = _rest(names, keys, [*held, batch])
        at = bounds(table)
        if len(at) > 2:
            yield table.slice(0, int(at[-2])).combine_chunks(), at[:-1]
        held = table.slice(int(at[-2])).combine_chunks().to_batches()
    if held:
        table = _rest(names, keys, held)
        yield table, bounds(table)


def _points(held: pa.ChunkedArray) -> np.ndarray | None:
    """Packed points with ``GROUPS`` coordinates each as a matrix; None if one has more."""
    raw = pa.concat_arrays([x.cast(pa.large_binary()) for x in held.chunks])
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)
    width = data[at[:-1]].astype(np.int64)
    if (np.diff(at) != 1 + GROUPS * width).any():
        return None
    out = np.zeros((len(raw), GROUPS), np.uint8 if width.max() == 1 else np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        cells = data[at[rows][:, None] + 1 + np.arange(GROUPS * w)]
        out[rows] = cells.view(f"<u{w}")
    return out


def leaf_links(points: np.ndarray, label: np.ndarray, first: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): which rows of groups no larger than a leaf hang together by pairs that the points allow, each row with the first of its part.

    Groups are leaves of one node: those of one size are compared side by side. Rows of one ``label`` hang together already.
    """
    total = points.sum(1, dtype=np.int64)
    us, vs = [], []
    for m in np.unique(size):
        every = first[size == m]
        for some in np.array_split(every, max(1, -(-len(every) * m * GROUPS >> 22))):
            at = some[:, None] + np.arange(m)
            p, n, own = points[at], total[at], label[at]
            near = own[:, :, None] == own[:, None, :]
            for i in range(m - 1):
                overlap = np.minimum(p[:, i:i + 1], p[:, i + 1:]).sum(2, dtype=np.int64)
                near[:, i, i + 1:] |= (100 + percent) * overlap >= percent * (n[:, i:i + 1] + n[:, i + 1:])
            near |= near.transpose(0, 2, 1)
            root = np.broadcast_to(np.arange(m), at.shape)
            while True:
                low = np.where(near, root[:, None, :], m).min(2)
                if np.array_equal(low, root):
                    break
                root = low
            top = np.take_along_axis(at, root, 1)
            g, i = np.nonzero(label[top] != own)
            us.append(top[g, i])
            vs.append(at[g, i])
    return np.concatenate(us), np.concatenate(vs)


class Known:
    """Labels that a task has found to hang together: groups of the same copies come again and again."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def _find(self, x: int) -> int:
        top = x
        while (up := self.root.get(top, top)) != top:
            top = up
        while x != top:
            self.root[x], x = top, self.root.get(x, x)
        return top

    def of(self, labels: np.ndarray) -> np.ndarray:
        """The label that each of these is known by."""
        each, at = np.unique(labels, return_inverse=True)
        return np.array([self._find(x) for x in each.tolist()], np.int64)[at]

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        for a, b in zip(u.tolist(), v.tolist()):
            a, b = self._find(a), self._find(b)
            self.root[max(a, b)] = min(a, b)


def _search(tiles: DataFrame, keys: list[str], size: int, percent: int, held: str) -> DataFrame:
    """Links (a, b) inside each tile of (keys, doc, label, held): ``held`` is ``point`` or ``text``; ``label`` says what is linked already.

    By ``point`` they tell what hangs together, not which pair does it.
    """

    def linked(rows: dict[str, list]) -> Iterator[pa.RecordBatch]:
        docs, label, sets = np.array(rows["doc"]), np.unique(rows["label"], return_inverse=True)[1], None
        if held == "text":
            buf, offs = words.buffers(pa.array(rows["text"], pa.large_string()))
            sets = list(shingle_sets(buf, offs, size))
            # rows of the same doc_id may hold another text, or the same one again
            own = {int(x): i for i, x in enumerate(docs) if len(sets[i]) and name_of(sets[i]).astype(np.int64) == x}
            mine = list(own.values())
            docs, label, sets = docs[mine], label[mine], [sets[i] for i in mine]
            vectors = [point(s, fine(len(s))) for s in sets]
        else:
            vectors = [unpacked(x) for x in rows[held]]
        found = links_of(vectors, label, percent, sets)
        if found:
            a, b = (docs[[p[i] for p in found]].astype(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_pydict({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    def by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _tiles(batches, keys, ["doc", "label", held]):
            yield from linked(rows)

    def by_point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = ["doc", "label", held], Known()
        for table, at in _runs(batches, keys, names):
            label, count = known.of(table["label"].to_numpy()), np.diff(at)
            apart = np.minimum.reduceat(label, at[:-1]) < np.maximum.reduceat(label, at[:-1])
            small = apart & (count <= SIDE_BY_SIDE)
            n = count[small]
            rows = table.take(pa.array(np.repeat(at[:-1][small] - np.cumsum(n) + n, n) + np.arange(n.sum())))
            points = _points(rows[held]) if len(n) else None
            if points is None:
                small[:] = False
            else:
                docs, own = rows["doc"].to_numpy(), rows["label"].to_numpy()
                u, v = leaf_links(points, known.of(own), np.cumsum(n) - n, n, percent)
                known.join(own[u], own[v])
                yield pa.RecordBatch.from_pydict({"a": np.minimum(docs[u], docs[v]), "b": np.maximum(docs[u], docs[v])})
            for i in np.flatnonzero(apart & ~small):
                rows = table.slice(int(at[i]), int(count[i])).select(names).to_pydict()
                own, rows["label"] = np.array(rows["label"]), known.of(np.array(rows["label"]))
                if (rows["label"] == rows["label"][0]).all():
                    continue
                place = {doc: label for doc, label in zip(rows["doc"], own)}
                for found in linked(rows):
                    known.join(*(np.array([place[x] for x in found.column(k).to_pylist()]) for k in (0, 1)))
                    yield found

    return _dealt(tiles, keys, ["doc", "label", held]).mapInArrow(by_text if held == "text" else by_point, "a long, b long")


def _wanted(tiles: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """The rows (keys, doc, label) of tile pairs (keys, doc, label, tile, point) that may link across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _tiles(batches, keys, ["doc", "label", "tile", "point"]):
            label = np.unique(rows["label"], return_inverse=True)[1]
            keep = np.flatnonzero(wanted([unpacked(x) for x in rows["point"]], label, np.array(rows["tile"]), percent))
            if len(keep):
                cols = {k: pa.array(np.full(len(keep), v, np.int64)) for k, v in zip(keys, key)}
                yield pa.RecordBatch.from_pydict(cols | {k: pa.array(np.array(rows[k], np.int64)[keep]) for k in ("doc", "label")})

    return _dealt(tiles, keys, ["doc", "label", "tile", "point"]).mapInArrow(run, ", ".join(f"{k} long" for k in [*keys, "doc", "label"]))


def _joined(groups: DataFrame, holding: DataFrame, held: str, weight, size: int, percent: int, points: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join all linked sets of each group of (group, doc, ...); ``holding`` has (doc, held).

    A group of more than one tile (``weight`` tiles) meets in tiles that share a
    pivot; tiles with parts not linked by then meet two by two, by ``points`` first if given.
    """
    total = groups.groupBy("group").agg(F.ceil(weight).cast("int").alias("tiles"), F.min("doc").alias("pivot"), F.count("*").alias("docs"))
    rows = groups.select("group", "doc").join(total.where("docs > 1").drop("docs"), "group")
    rows = settle(rows.withColumn("tile", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int")).withColumn("label", F.col("doc")))
    pivots = rows.where("tiles > 1 and doc = pivot").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    firsts = rows.where("tiles = 1 or doc <> pivot").unionByName(pivots)
    links = settle(_search(firsts.join(holding, "doc"), ["group", "tile"], size, percent, held))
    large = rows.where("tiles > 1")
    if not large.limit(1).count():
        return links
    labels = components(links).select(F.col("node").alias("doc"), F.col("component").alias("label"))
    labelled = large.drop("label").join(labels, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    apart = labelled.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("group")
    rest = settle(labelled.join(apart, "group", "left_semi"))
    pairs = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).where("other <> tile")
    pairs = pairs.select("group", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "doc", "label", "tile")
    keys = ["group", "i", "j"]
    if points is not None:
        pairs = settle(_wanted(pairs.join(points, "doc"), keys, percent))
    return settle(links.union(_search(pairs.join(holding, "doc"), keys, size, percent, held)))


def _members(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, ...) whose id may be among ``ids`` (doc_id): a bitmap of fixed size, so that other texts are not shuffled."""
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(MEMBERS))
    held = ids.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("bits")).toArrow()
    bits = np.zeros(MEMBERS >> 6, np.int64)
    bits[held["w"].to_numpy()] = held["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def member(p: pd.Series) -> pd.Series:
        at = p.to_numpy()
        return pd.Series((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return docs.where(member(place))


def signatures(docs: DataFrame, size: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, name, rest, point, fine) of every row; equal name and rest (128 bits) mean equal sets. ``fine`` is null where it equals ``point``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in words.chunks(batches, text):
            n, name, rest, points, finer = [], [], [], [], []
            for s in shingle_sets(buf, offs, size):
                m = words.mix(s)
                n.append(len(s))
                points.append(packed(point(s)))
                finer.append(packed(point(s, fine(len(s)))) if fine(len(s)) > GROUPS else None)
                name.append(m.sum(dtype=np.uint64))
                rest.append(words.mix(m).sum(dtype=np.uint64))
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column(doc_id).cast(pa.int64()), "n_shingles": pa.array(n, pa.int64()),
                "name": np.array(name, np.uint64).view(np.int64), "rest": np.array(rest, np.uint64).view(np.int64),
                "point": pa.array(points, pa.binary()), "fine": pa.array(finer, pa.binary())})

    return picked(docs, doc_id, text).mapInArrow(sign, "doc_id long, n_shingles long, name long, rest long, point binary, fine binary")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, rest, head, doc): ``head`` is the smallest doc of this set in the partition."""
    got = [[b.column(i).to_numpy() for i in range(3)] for b in batches if b.num_rows]
    if got:
        name, rest, doc = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((doc, rest, name))
        name, rest, doc = name[order], rest[order], doc[order]
        new = np.r_[True, (name[1:] != name[:-1]) | (rest[1:] != rest[:-1])]
        yield pa.RecordBatch.from_pydict({"name": name, "rest": rest, "head": doc[new][np.cumsum(new) - 1], "doc": doc})


def classes_of(docs: DataFrame, signed: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, component) for every document with a link; the smallest doc_id names a component. ``signed``: its :func:`signatures`."""
    known = signed.where("doc_id is not null and n_shingles > 0")
    # copies: linked to the smallest of their partition first, so that a very common text is not one task
    heads = settle(known.select("name", "rest", F.col("doc_id").alias("doc")).mapInArrow(_heads, "name long, rest long, head long, doc long"))
    firsts = settle(heads.where("head = doc").groupBy("name", "rest").agg(F.min("head").alias("rep")))
    met = heads.where("head = doc").distinct().join(firsts, ["name", "rest"]).where("head <> rep")
    copies = heads.where("head <> doc").select(F.col("head").alias("a"), F.col("doc").alias("b")).union(met.select("rep", "head"))

    sets = known.select(F.col("name").alias("doc"), F.col("n_shingles").alias("n"))
    points = known.select(F.col("name").alias("doc"), "point").distinct()
    fines = known.select(F.col("name").alias("doc"), F.coalesce("fine", "point").alias("point")).distinct()
    buckets = settle(meetings(docs, size, percent, doc_id, text).withColumnRenamed("bucket", "group"))
    near = _joined(buckets, points, "point", F.count("*") / POINTS, size, percent)
    blocks = components(near).select(F.col("component").alias("group"), F.col("node").alias("doc"))
    sized = settle(blocks.join(sets.distinct(), "doc"))
    # blocks with sets above GROUPS are split by their fine points
    large = sized.groupBy("group").agg(F.max("n").alias("top")).where(F.col("top") >= 2 * GROUPS).select("group")
    width = F.sum(F.greatest("n", F.lit(GROUPS))) / COORDINATES
    finer = components(_joined(sized.join(large, "group", "left_semi"), fines, "point", width, size, percent))
    split = finer.select(F.col("component").alias("group"), F.col("node").alias("doc")).join(sets.distinct(), "doc").select("doc", "group", "n")
    sized = settle(sized.join(large, "group", "left_anti").select("doc", "group", "n").union(split))

    reps = firsts.groupBy(F.col("name").alias("doc")).agg(F.min("rep").alias("doc_id"))
    needed = settle(sized.select("doc").distinct().join(reps, "doc"))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    texts = settle(_members(texts, needed).join(needed, "doc_id").select("doc", "text"))
    links = _joined(sized, texts, "text", F.sum("n") / TILE, size, percent, fines)
    named = links.join(reps.select(F.col("doc").alias("a"), F.col("doc_id").alias("u")), "a").join(reps.select(F.col("doc").alias("b"), F.col("doc_id").alias("v")), "b")
    ends = named.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a <> b")
    return settle(components(ends.union(copies)))


def near_join(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Documents link when ``100 * |A & B| >= percent * |A | B|``. A null or
    wordless text has no shingle and no link; texts below ``size`` words are one
    shingle. Rows of one doc_id are one document: it links by each of its texts. A row with a null
    doc_id links with nothing and has a null component. An empty table gives none;
    columns besides doc_id and text are left aside, whatever their names.
    """
    signed = settle(signatures(docs, size, doc_id, text))
    found = classes_of(docs, signed, size, percent, doc_id, text)
    out = signed.join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
