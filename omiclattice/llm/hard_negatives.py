"""Hard negatives by inner product, searched in STR-packed R-trees.

Vectors are dealt out by label and by their widest coordinate; a task cuts
its share into tiles of one label, sort-tile-recursively, and packs each tile's
R-tree: leaves of neighbouring vectors, then boxes of boxes. For an anchor q
a box gives an interval of inner products, coordinate by coordinate from
``q * low`` and ``q * high``. A best-first queue opens the box with the highest
possible score first; a box outside the score window, or strictly below the
kth score found, is never opened.

Two searches follow each other: the positives of every anchor among the tiles of
its label, beginning with the kth score in its own tile, then for each
positive the negatives in its score window among the tiles of the other labels.
Anchors come in blocks and tiles in lanes; a task takes one block through
one lane, carries its kth scores from tile to tile and returns k rows an anchor or positive.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from omiclattice.llm.storage import settle

#: Vectors in a leaf, children of an inner box, vectors in a tile and those that one task packs into tiles.
LEAF, FANOUT, TILE, SHARE = 64, 8, 2048, 8192
#: Anchors in a block and tiles in a lane.
ANCHORS, LANE = 1024, 4

_TILE = "tile long, dim int, label long, n int, row binary, id binary, asks binary, data binary, high binary, low binary, first binary, last binary, level binary"
_INTS = np.iinfo(np.int64)


def str_order(data: np.ndarray, cap: int) -> list[np.ndarray]:
    """Rows in groups of at most ``cap``: sorted and sliced by one coordinate after the other, the widest first."""
    axes = np.argsort(-data.var(0), kind="stable")

    def part(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        groups = -(-len(rows) // cap)
        if groups <= 1:
            return [rows]
        left = min(len(axes) - depth, max(1, groups.bit_length() - 1))
        slabs = groups if left == 1 else max(2, round(groups ** (1 / left)))
        size = -(-groups // slabs) * cap
        rows = rows[np.argsort(data[rows, axes[depth]], kind="stable")]
        return [g for i in range(0, len(rows), size) for g in part(rows[i:i + size], depth + 1)]

    return part(np.arange(len(data)), 0)


def pack_tree(data: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row order, boxes): STR leaves first, then level upon level up to one root; ``first:last`` are a box's rows or children."""
    groups = str_order(data, LEAF)
    order = np.concatenate(groups)
    last = np.cumsum([len(g) for g in groups])
    first = np.r_[0, last[:-1]]
    low = np.minimum.reduceat(data[order], first, axis=0)
    high = np.maximum.reduceat(data[order], first, axis=0)
    out = {"low": [low], "high": [high], "first": [first], "last": [last], "level": [np.zeros(len(first), np.int32)]}
    below = 0
    while len(low) > 1:
        start = np.arange(0, len(low), FANOUT)
        end = np.minimum(start + FANOUT, len(low))
        out["first"].append(start + below)
        out["last"].append(end + below)
        below += len(low)
        low, high = np.minimum.reduceat(low, start, axis=0), np.maximum.reduceat(high, start, axis=0)
        out["low"].append(low)
        out["high"].append(high)
        out["level"].append(np.full(len(low), len(out["level"]), np.int32))
    return order, {k: np.concatenate(v) for k, v in out.items()}


class Tree:
    """A tile read back."""

    def __init__(self, t: dict):
        get = lambda k, kind: np.frombuffer(t[k], kind)
        self.dim, self.row, self.id = t["dim"], get("row", "<i8"), get("id", "<i8")
        self.data = get("data", "<i8").reshape(-1, self.dim)
        self.low, self.high = get("low", "<i8").reshape(-1, self.dim), get("high", "<i8").reshape(-1, self.dim)
        self.first, self.last, self.level = get("first", "<i8").tolist(), get("last", "<i8").tolist(), get("level", "<i4").tolist()

    def intervals(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner products of each anchor with anything in each box."""
        exact = self.dim * float(np.abs(asked).max(initial=0)) * float(max(np.abs(self.low).max(), np.abs(self.high).max())) < 2**53
        if exact and self.data.dtype != float:  # doubles multiply faster and hold these sums exactly
            self.data, self.low, self.high = (x.astype(float) for x in (self.data, self.low, self.high))
        q = asked.astype(self.data.dtype)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def search(self, q: np.ndarray, low: np.ndarray, high: np.ndarray, window: tuple[int, int], best: list[tuple[int, int, int]], k: int, own: int, seen: dict) -> list[tuple[int, int, int]]:
        """``best`` (score, -id, row), highest first, with what this tile adds to the k best in the score window.

        ``low`` and ``high`` are the boxes' intervals for ``q``; ``seen`` keeps leaf scores for other windows of the anchor.
        """
        least, most = window
        root = len(high) - 1
        queue = [(-min(high[root], most), root)]
        while queue:
            top, box = heapq.heappop(queue)
            if -top < least or len(best) == k and -top < best[-1][0]:
                break
            if low[box] > most:
                continue
            a, b = self.first[box], self.last[box]
            if self.level[box]:
                for c in range(a, b):
                    heapq.heappush(queue, (-min(high[c], most), c))
                continue
            if box not in seen:
                seen[box] = self.data[a:b] @ q
            s = seen[box]
            floor = max(least, best[-1][0]) if len(best) == k else least
            met = np.flatnonzero((s >= floor) & (s <= most))
            if len(met):
                best = best + [(int(s[i]), -int(self.id[a + i]), int(self.row[a + i])) for i in met if self.row[a + i] != own]
                best = sorted(best, reverse=True)[:k]
        return best


def usable(vectors: DataFrame, scale: int, vec_id: str, vector: str, label: str) -> DataFrame:
    """(row, id, label, dim, v): rows that take part, with integer components and a number of their own."""
    x = F.col(f"`{vector}`")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = vectors.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound)
    return settle(kept.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
        F.size(x).alias("dim"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v")))


def tiles(rows: DataFrame) -> DataFrame:
    """One row a tile: vectors of one length and label, near each other, and their R-tree."""
    spread = rows.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.var_pop("x").alias("wide"))
    widest = spread.groupBy("dim").agg(F.max_by("at", F.struct("wide", F.negate("at"))).alias("axis"))
    n = max(1, -(-rows.count() // SHARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held: list[dict]) -> Iterator[pa.RecordBatch]:
            data = np.array([r["v"] for r in held], np.int64)
            for group in str_order(data, TILE):
                order, boxes = pack_tree(data[group])
                rows = [held[i] for i in group[order]]
                number = min(r["row"] for r in rows)
                cols = {k: np.array([r[k] for r in rows], "<i8") for k in ("row", "id")} | {"asks": np.array([r["asks"] for r in rows], "?"), "data": data[group[order]]}
                cols |= {k: v.astype("<i4" if k == "level" else "<i8") for k, v in boxes.items()}
                yield pa.RecordBatch.from_pydict({
                    "tile": pa.array([number], pa.int64()), "dim": pa.array([len(data[0])], pa.int32()), "label": pa.array([rows[0]["label"]], pa.int64()), "n": pa.array([len(rows)], pa.int32()),
                    **{k: [np.ascontiguousarray(cols[k]).tobytes()] for k in ("row", "id", "asks", "data", "high", "low", "first", "last", "level")}})

        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and ((r["dim"], r["label"]) != (held[0]["dim"], held[0]["label"]) or len(held) >= 2 * SHARE):
                    yield from packed(held)
                    held = []
                held.append(r)
        if held:
            yield from packed(held)

    # the row number parts equal vectors, so that a very common one is no range by itself
    keys = ["dim", "label", F.element_at("v", F.col("axis") + 1), "row"]
    dealt = rows.join(widest, "dim").repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return settle(dealt.select("row", "id", "label", "dim", "v", "asks").mapInArrow(run, _TILE))


def anchors_of(stored: DataFrame, k: int) -> DataFrame:
    """(anchor, id, label, dim, v, least): the anchors of the tiles, each with the kth score it finds in its own tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.to_pylist():
                asks = np.flatnonzero(np.frombuffer(t["asks"], "?"))
                if not len(asks):
                    continue
                tree = Tree(t)
                v = tree.data[asks]
                low, high = tree.intervals(v)
                least = []
                for j, i in enumerate(asks.tolist()):
                    best = tree.search(tree.data[i], low[j], high[j], (_INTS.min, _INTS.max), [], k, int(tree.row[i]), {})
                    least.append(best[-1][0] if len(best) == k else _INTS.min)
                yield pa.RecordBatch.from_pydict({
                    "anchor": pa.array(tree.row[asks]), "id": pa.array(tree.id[asks]), "label": pa.array(np.full(len(asks), t["label"], np.int64)),
                    "dim": pa.array(np.full(len(asks), t["dim"], np.int32)), "v": [x.astype("<i8").tobytes() for x in v], "least": pa.array(least, pa.int64())})

    return settle(stored.mapInArrow(run, "anchor long, id long, label long, dim int, v binary, least long"))


def _lanes(stored: DataFrame, asks: DataFrame, same: bool, step: Callable, schema: str) -> DataFrame:
    """Every block of anchors through every lane of the tiles of its label (``same``) or of the others.

    ``step(anchors, trees)`` gets a block's rows and an iterator over a lane's trees.
    """
    by = ["dim", "label"]
    asked = asks.groupBy(by).agg(F.ceil(F.count("*") / ANCHORS).alias("blocks"))
    placed = settle(asks.join(asked, by).withColumn("block", F.pmod(F.xxhash64("anchor"), F.col("blocks"))))
    held = stored.groupBy(by).agg(F.ceil(F.count("*") / LANE).alias("lanes"))
    laned = stored.join(held, by).withColumn("lane", F.pmod(F.xxhash64("tile"), F.col("lanes")))
    blocks = placed.select("dim", F.col("label").alias("of"), "block").distinct()
    lanes = laned.select("dim", "label", "lane").distinct()
    meet = F.col("of") == F.col("label") if same else F.col("of") != F.col("label")
    # a table of block and lane numbers: the anchors are a stated share of the rows
    pairs = settle(lanes.join(blocks, "dim").where(meet).withColumn("pair", F.struct("dim", "label", "lane", "of", "block")))
    left = placed.withColumnRenamed("label", "of").join(pairs, ["dim", "of", "block"]).select("pair", F.struct("anchor", "id", "v", "least", "windows").alias("ask"), F.lit(None).cast(stored.schema).alias("held"))
    right = laned.join(pairs, ["dim", "label", "lane"]).select("pair", F.lit(None).cast(left.schema["ask"].dataType).alias("ask"), F.struct(*stored.columns).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        r = next(rows, None)
        while r is not None:  # a pair's anchors come first, then its tiles
            pair, block = r["pair"], []
            while r is not None and r["pair"] == pair and r["ask"] is not None:
                block.append(r["ask"])
                r = next(rows, None)

            def trees():
                nonlocal r
                while r is not None and r["pair"] == pair:
                    if block:
                        yield Tree(r["held"])
                    r = next(rows, None)

            yield from step(block, trees())
            for _ in trees():
                pass

    n = max(1, pairs.count())
    both = left.unionByName(right).repartition(min(n, 10_000), "pair").sortWithinPartitions("pair", F.col("held").isNotNull())
    return both.mapInArrow(run, schema)


def positives(stored: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(anchor, id, score, rank): each anchor's k best other rows of its label."""

    def step(block, trees):
        best: list[list] = [[] for _ in block]
        v = np.array([np.frombuffer(a["v"], "<i8") for a in block]) if block else None
        for tree in trees:
            low, high = tree.intervals(v)
            for j, a in enumerate(block):
                best[j] = tree.search(v[j].astype(tree.data.dtype), low[j], high[j], (a["least"], _INTS.max), best[j], k, a["anchor"], {})
        rows = [(a["anchor"], -i, s) for a, own in zip(block, best) for s, i, _ in own]
        if rows:
            anchor, i, s = zip(*rows)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor, pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    asked = asks.withColumn("windows", F.array().cast("array<long>"))
    found = _lanes(stored, asked, True, step, "anchor long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id")))
    return settle(ranked.where(F.col("rank") <= k))


def hard_negatives(vectors: DataFrame, is_anchor, k_positive: int = 5, k_negative: int = 5, percent: int = 80, scale: int = 256,
                   vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and positive its best negatives.

    Components become ``floor(scale * x)``; scores are integer inner products
    and must fit 64 bits. ``is_anchor`` is a condition on (id, label, row). An anchor's positives are its
    ``k_positive`` best other rows of the same label, the negatives of a positive the ``k_negative`` best
    rows of other labels with ``percent * positive <= 100 * negative <= 100 * positive``; ties go to the smaller id.

    Rows with a null id, label or vector, an empty vector, or a null or
    non-finite component take no part; only vectors of one length are compared. Rows that
    repeat an id are rows of their own: each is an anchor, a positive and a negative, and only the very row is not its own positive.
    Components of any length are read whole; other columns are left aside; an empty table gives no rows.
    """
    rows = usable(vectors, scale, vec_id, vector, label).withColumn("asks", is_anchor)
    stored = tiles(rows)
    asks = anchors_of(stored, k_positive)
    near = positives(stored, asks, k_positive)
    wanted = near.groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("windows"))  # k_positive numbers at most
    asked = asks.join(wanted, "anchor")

    def step(block, trees):
        best: list[dict[int, list]] = [{p: [] for p in a["windows"]} for a in block]
        v = np.array([np.frombuffer(a["v"], "<i8") for a in block]) if block else None
        for tree in trees:
            low, high = tree.intervals(v)
            for j, a in enumerate(block):
                q, seen = v[j].astype(tree.data.dtype), {}
                for p, own in best[j].items():
                    window = (-(-percent * p // 100), p)
                    if window[0] <= p:
                        best[j][p] = tree.search(q, low[j], high[j], window, own, k_negative, a["anchor"], seen)
        rows = [(a["anchor"], p, -i, s) for a, own in zip(block, best) for p, kept in own.items() for s, i, _ in kept]
        if rows:
            anchor, p, i, s = zip(*rows)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor, pa.int64()), "positive": pa.array(p, pa.int64()), "negative_id": pa.array(i, pa.int64()), "negative_score": pa.array(s, pa.int64())})

    found = _lanes(stored, asked, False, step, "anchor long, positive long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "positive").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_negative)
    pairs = near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive"))
    out = ranked.join(pairs, ["anchor", "positive"]).join(asks.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive").alias("positive_score"), "negative_score")


def query(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", moved)
    return hard_negatives(vectors, F.col("id") % 100 == 0)


SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.id AS anchor_id, c.r AS cr, c.id, a.label = c.label AS alike, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM e a JOIN e c ON a.r <> c.r AND len(a.v) = len(c.v) WHERE a.id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS k FROM s WHERE alike) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.ar, p.cr ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.ar = p.ar AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
