"""Exact top-k inner products by the threshold algorithm over sorted lists.

Vectors are dealt into blocks. In a block, each dimension's vectors are sorted
once; a query reads the lists from the end that its sign favours, scores each
newly met vector exactly and stops when the sum of what the lists still can
give stays below its kth score. Queries come in blocks too, so the work is a
table of block pairs of bounded size, and a query's results of all blocks meet
in one ranking of k rows a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from omiclattice.llm.storage import settle

#: Vectors and queries in a block.
BLOCK, QUERIES = 4096, 1024


def threshold_top(data: np.ndarray, order: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of a block for one query; ``order`` has each dimension's rows by falling value."""
    n = len(data)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen, best, score = ids == own, np.zeros(0, np.int64), np.zeros(0, data.dtype)
    at, depth = 0, max(32, k)
    while at < n:
        to = min(n, at + depth)
        met = np.zeros(n, bool)
        met[order[at:to, up]] = True
        met[order[n - to:n - at, down]] = True
        if not len(up) + len(down):
            met[:] = True
        new = np.flatnonzero(met & ~seen)
        seen |= met
        s = data[new] @ query
        if len(s) > k:  # the kth score and its ties are all that can stay
            stay = s >= np.partition(s, len(s) - k)[len(s) - k]
            new, s = new[stay], s[stay]
        best, score = np.concatenate([best, new]), np.concatenate([score, s])
        keep = np.lexsort((ids[best], -score))[:k]
        best, score = best[keep], score[keep]
        bound = data[order[to - 1, up], up] @ query[up] + data[order[n - to, down], down] @ query[down]
        if len(best) == k and bound < score[-1]:
            break
        at, depth = to, depth * 3
    return [(int(s), int(i)) for s, i in zip(score, ids[best])]


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """(dim, block, blocks, ids, data): vectors of one length in blocks of about ``size``."""
    count = vectors.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("long").alias("blocks"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None

        def row():
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([name[0]], pa.int32()), "block": pa.array([name[1]], pa.int64()), "blocks": pa.array([name[2]], pa.int64()),
                "ids": [np.array([x[0] for x in held], "<i8").tobytes()], "data": [np.array([x[1] for x in held], "<i8").tobytes()]})

        for b in batches:
            for r in b.to_pylist():
                key = (r["dim"], r["block"], r["blocks"])
                if key != name and held:
                    yield row()
                    held = []
                name = key
                held.append((r["id"], r["v"]))
        if held:
            yield row()

    dealt = vectors.join(count, "dim").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    return dealt.repartition("dim", "block").sortWithinPartitions("dim", "block", "id").mapInArrow(pack, "dim int, block long, blocks long, ids binary, data binary")


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products, ties to the smaller vec_id.

    Components become ``floor(scale * x)``; scores must fit 64 bits. Vectors
    that are null, empty or hold null or non-finite components take no part,
    nor do rows with a null vec_id. Only vectors of a query's length are
    compared with it. A query's own row is left out by its vec_id; other
    repeated rows each rank. An empty table gives none.
    """
    x = F.col(f"`{vector}`")
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.where(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound).select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), F.size(x).alias("dim"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"), is_query.alias("asks"))
    lists = settle(_blocks(rows.drop("asks"), BLOCK))
    asks = settle(_blocks(rows.where("asks").drop("asks"), QUERIES)).select("dim", F.col("block").alias("q"), F.col("blocks").alias("qs"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    # every block of vectors meets every block of queries of its length: one row a pair, keyed by both
    spread = lists.join(asks.select("dim", "q"), "dim")
    pairs = spread.join(asks, ["dim", "q"])
    n = max(1, lists.count() * asks.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids, q_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                data, q = (np.frombuffer(r[c], "<i8").reshape(-1, r["dim"]) for c in ("data", "q_data"))
                order = np.argsort(-data, axis=0, kind="stable")
                if r["dim"] * float(np.abs(data).max()) * float(np.abs(q).max()) < 2**53:  # exact in doubles, which multiply faster
                    data, q = data.astype(float), q.astype(float)
                found = [(i, s, v) for i, x in zip(q_ids.tolist(), q) for s, v in threshold_top(data, order, ids, x, i, k)]
                if found:
                    i, s, v = zip(*found)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(i, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    found = pairs.repartition(min(n, 10_000), "dim", "block", "q").mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
