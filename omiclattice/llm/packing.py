"""Best-fit packing of documents into fixed sequences by a grouping genetic algorithm.

Documents become pieces (only those longer than a sequence are cut), and the
pieces of a shard, drawn by hash, are packed by several islands: each island
holds a population of packings, crosses them by injecting well-filled bins of
one into another, removes what is then there twice and best-fits the displaced
pieces. After each epoch the best packing of an island migrates to the next
one. Islands are rows, so they run as separate tasks; a shard is a few
thousand pieces at any input size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from omiclattice.llm import tokens
from omiclattice.llm.storage import picked, settle

#: A shard's pieces travel together in one row: flat arrays, one entry a piece.
FIELDS = {"doc": "<i8", "piece": "<i4", "start": "<i8", "length": "<i4", "crc": "<i8"}


def pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of each whole text and the end id, cut where longer than ``size``.

    The first piece takes the remainder. A null or empty text is one piece of one id.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, close = tokens.encoder(path), np.array([end_id], "<u4").tobytes()
        for rows, texts in tokens.runs(batches, text):
            out = []
            for d, found in zip(rows.column(doc_id).to_pylist(), enc.encode(texts)):
                found += close
                n = len(found) // 4
                edges = [0, *range(n % size or size, n + 1, size)]
                if n <= size:
                    edges = [0, n]
                out += [(d, k, a, b - a, zlib.crc32(found[4 * a:4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            d, k, a, n, c = zip(*out)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(d, pa.int64()), "piece": pa.array(k, pa.int32()), "start": pa.array(a, pa.int64()),
                "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(c, pa.int64())})

    return picked(docs, doc_id, text).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Bins:
    """Open bins by free room; the tightest that fits comes from one bit operation."""

    def __init__(self, size: int):
        self.mask, self.free = 0, [[] for _ in range(size + 1)]

    def add(self, b: int, room: int) -> None:
        if room:
            self.free[room].append(b)
            self.mask |= 1 << room

    def take(self, n: int) -> tuple[int, int] | None:
        fits = self.mask >> n
        if not fits:
            return None
        room = n + (fits & -fits).bit_length() - 1
        b = self.free[room].pop()
        if not self.free[room]:
            self.mask ^= 1 << room
        return b, room


def best_fit(lengths: list[int], items: list[int], where: np.ndarray, room: dict[int, int], size: int, fresh: int) -> int:
    """Place ``items`` in turn into the tightest open bin; returns the next unused bin number."""
    bins = _Bins(size)
    for b, r in room.items():
        bins.add(b, r)
    for i in items:
        n = lengths[i]
        got = bins.take(n)
        if got is None:
            got, fresh = (fresh, size), fresh + 1
        where[i] = got[0]
        bins.add(got[0], got[1] - n)
    return fresh


def _fill(where: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.bincount(where, lengths).astype(np.int64)


def _score(where: np.ndarray, lengths: np.ndarray, size: int) -> tuple[int, float]:
    """Fewer bins first, then more uneven filling (which leaves room to empty a bin)."""
    fill = _fill(where, lengths)
    fill = fill[fill > 0]
    return len(fill), -float(np.square(fill / size).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, size: int, rng: np.random.Generator, share: float = 0.3) -> np.ndarray:
    """Inject a random ``share`` of ``b``'s best-filled bins into ``a``."""
    fill = _fill(b, lengths)
    well = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    given = np.isin(b, well[rng.random(len(well)) < share])
    child = np.unique(a, return_inverse=True)[1].astype(np.int64)
    broken = np.zeros(child.max() + 1, bool)
    broken[child[given]] = True
    loose = broken[child] & ~given
    top = len(broken)
    child[given] = top + np.unique(b[given], return_inverse=True)[1]
    top = int(child[given].max()) + 1 if given.any() else top
    kept = ~loose
    fill = np.bincount(child[kept], lengths[kept], minlength=top).astype(np.int64)
    # the worst-filled bins are broken up too, so that a bin can be saved
    weak = np.flatnonzero((fill > 0) & (fill < np.quantile(fill[fill > 0], 0.02)))
    loose |= np.isin(child, weak) & ~given
    fill[weak] = 0
    room = {int(x): int(size - fill[x]) for x in np.flatnonzero((fill > 0) & (fill < size))}
    items = np.flatnonzero(loose)
    items = items[np.argsort(-lengths[items], kind="stable")].tolist()
    best_fit(lengths.tolist(), items, child, room, size, top)
    return np.unique(child, return_inverse=True)[1].astype(np.int64)


def evolve(lengths: np.ndarray, size: int, seed: int, parents: list[np.ndarray], population: int = 4, generations: int = 6) -> np.ndarray:
    """Best packing that an island finds from its parents and fresh random ones."""
    rng, n, plain = np.random.default_rng(seed), len(lengths), lengths.tolist()
    least, pool = math.ceil(int(lengths.sum()) / size), list(parents)
    for where in pool:
        if _score(where, lengths, size)[0] == least:
            return where  # nothing is left to save
    while len(pool) < population:
        noise = 0 if not pool else rng.normal(0, size / 40, n)
        where = np.zeros(n, np.int64)
        best_fit(plain, np.argsort(-(lengths + noise), kind="stable").tolist(), where, {}, size, 0)
        pool.append(where)
        if _score(where, lengths, size)[0] == least:
            return where
    pool.sort(key=lambda w: _score(w, lengths, size))
    for _ in range(generations):
        if _score(pool[0], lengths, size)[0] == least:
            break
        i, j = rng.choice(len(pool), 2, replace=False)
        pool.append(crossover(pool[i], pool[j], lengths, size, rng))
        pool = sorted(pool, key=lambda w: _score(w, lengths, size))[:population]
    return pool[0]


def _shards(cut: DataFrame, per_shard: int) -> DataFrame:
    """One row a shard: its pieces as flat arrays in a fixed order."""
    n = max(1, math.ceil(cut.count() / per_shard))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        cols = {k: t.column(v) for k, v in zip(FIELDS, ("doc_id", "piece", "start", "length", "ids_crc32"))}
        shard, none = t.column("shard").to_numpy(), cols["doc"].is_null().to_numpy()
        doc = cols["doc"].fill_null(0).to_numpy()
        order = np.lexsort((cols["crc"].to_numpy(), cols["piece"].to_numpy(), doc, none, shard))
        shard = shard[order]
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        for a, b in zip(edges, edges[1:]):
            rows = order[a:b]
            got = {k: (doc if k == "doc" else cols[k].to_numpy())[rows].astype(f).tobytes() for k, f in FIELDS.items()}
            yield pa.RecordBatch.from_pydict({"shard": pa.array([int(shard[a])], pa.int64()), "none": [none[rows].tobytes()]} | {k: [v] for k, v in got.items()})

    # the row's place in the stored table parts rows that repeat
    keyed = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n)))
    schema = "shard long, none binary, " + ", ".join(f"{k} binary" for k in FIELDS)
    return settle(keyed.repartition(n, "shard").mapInArrow(pack, schema))


def pack(cut: DataFrame, size: int = 2048, per_shard: int = 8192, islands: int = 3, epochs: int = 2, seed: int = 7) -> DataFrame:
    """Pieces with their place: sequence_id (any number) and offset, gapless from 0.

    Repeated rows are packed one by one; a null doc_id is a document like any
    other; an empty table gives an empty result.
    """
    shards = _shards(cut, per_shard)
    n = max(1, shards.count())

    def epoch(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    lengths = np.frombuffer(r["length"], FIELDS["length"]).astype(np.int64)
                    parents = [np.frombuffer(x, "<i4").astype(np.int64) for x in r["parents"] or []]
                    best = evolve(lengths, size, seed + 1009 * r["shard"] + 31 * r["island"] + number, parents)
                    bins, spread = _score(best, lengths, size)
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([r["shard"]], pa.int64()), "island": pa.array([r["island"]], pa.int32()),
                        "best": [best.astype("<i4").tobytes()], "bins": pa.array([bins], pa.int64()), "spread": [spread]})

        return run

    lots = shards.select("shard", "length", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    elites = None
    for number in range(epochs):
        if elites is None:
            given = lots.withColumn("parents", F.lit(None).cast("array<binary>"))
        else:
            moved = elites.withColumn("island", (F.col("island") + 1) % islands)
            both = elites.union(moved).groupBy("shard", "island").agg(F.collect_list("best").alias("parents"))  # own and migrant
            given = lots.join(both, ["shard", "island"])
        elites = settle(given.repartition(n * islands, "shard", "island").mapInArrow(epoch(number), "shard long, island int, best binary, bins long, spread double"))
    best = elites.groupBy("shard").agg(F.min_by("best", F.struct("bins", "spread", "island")).alias("best"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                got = {k: np.frombuffer(r[k], f) for k, f in FIELDS.items()}
                where = np.frombuffer(r["best"], "<i4").astype(np.int64)
                order = np.argsort(where, kind="stable")
                ends = np.cumsum(got["length"][order].astype(np.int64))
                first = np.r_[True, np.diff(where[order]) != 0]
                before = ends - got["length"][order]
                offset = before - np.maximum.accumulate(np.where(first, before, 0))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(got["doc"][order], pa.int64(), mask=np.frombuffer(r["none"], bool)[order]),
                    "piece": pa.array(got["piece"][order], pa.int32()), "start": pa.array(got["start"][order], pa.int64()),
                    "length": pa.array(got["length"][order], pa.int64()), "ids_crc32": pa.array(got["crc"][order], pa.int64()),
                    "sequence_id": pa.array((r["shard"] << 24) + where[order], pa.int64()), "offset": pa.array(offset, pa.int64())})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return shards.join(best, "shard").repartition(n, "shard").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(settle(pieces(docs, path or tokens.tokenizer_path(), size, end_id)), size)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
