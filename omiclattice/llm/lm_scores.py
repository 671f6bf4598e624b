"""Stupid-backoff scores of all documents against the bigram counts of the corpus.

A word after another scores ``(c(v w) - own) / c(v)`` where other documents
also hold the pair (``own``: its count in this document), else ``0.4 c(w) / N``;
a document's first word scores ``c(w) / N``.

Count tables are partitioned by hash. Every document's pairs go to those
partitions once, packed as arrays: one row for each run of documents and
partition. There, one sort gives the pair counts, the word counts and each
pair's other documents. A pair belongs to the partition of its second word.
Words with more than ``1 / HOT`` of all words (so at most ``HOT``) are a table in every
task; a pair that ends in one belongs to its first word's partition, or to its own
if that is frequent too, so no frequent word gathers in one place. Counts of rare first words
that their pair's partition doesn't hold are joined. Sums meet per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from omiclattice.llm import words
from omiclattice.llm.storage import picked, settle

#: At most so many words are held as a table in every task.
HOT = 200_000
BACKOFF = 0.4
#: Bytes of text whose pairs are packed together, and pairs that a partition sorts at once.
RUN, SLICE = 5 << 20, 400_000

_START = np.uint64(0)


def _runs(batches: Iterator[pa.RecordBatch], text: str, key: str):
    """Word hashes and row numbers of runs of documents of about ``RUN`` bytes, with their ids."""
    held, size, at = [], 0, 0

    def join():
        return np.concatenate([h for h, _, _ in held]), np.concatenate([r for _, r, _ in held]), np.concatenate([k for _, _, k in held])

    for rows, buf, offs in words.chunks(batches, text):
        h, row, _, _ = words.words(buf, offs)
        held.append((h, row + at, rows.column(key).to_numpy(zero_copy_only=False).astype(np.int64)))
        size, at = size + len(buf), at + rows.num_rows
        if size >= RUN:
            yield join()
            held, size, at = [], 0, 0
    if held:
        yield join()


def word_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, n): occurrences of each hashed word in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _, _ in _runs(batches, text, key):
            w, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_pydict({"word": w.view(np.int64), "n": n.astype(np.int64)})

    return docs.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _find(table: tuple[np.ndarray, np.ndarray], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the table of frequent words, whether it is there)."""
    names = table[0]
    if not len(names):
        return np.zeros(len(w), np.int64), np.zeros(len(w), bool)
    at = np.minimum(np.searchsorted(names, w), len(names) - 1)
    return at, names[at] == w


def _home(v: np.ndarray, w: np.ndarray, v_hot: np.ndarray, w_hot: np.ndarray) -> np.ndarray:
    """Hash that decides where a pair belongs: its second word, or its first where that is rarer, or both."""
    return words.mix(np.where(~w_hot, w, np.where(~v_hot & (v != _START), v, words.mix(v) ^ w)))


def _small(x: np.ndarray) -> np.ndarray:
    """Differences of sorted ids in the smallest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next((t for t in ("<u1", "<u2", "<u4") if top <= np.iinfo(t).max), "<u8"))


#: Arrays of a packed row: steps between document ids; words and how often each follows; for every pair the document's rank,
#: whether its first word is frequent, and then its place in the table (low and high part), else its hash.
PACKED = ("step", "word", "times", "rank", "hot", "low", "high", "rare")


def pair_rows(docs: DataFrame, key: str, text: str, hot, parts: int) -> DataFrame:
    """Packed (predecessor, word, document) occurrences by partition of the scored word."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hot.value
        for h, row, ids in _runs(batches, text, key):
            if not len(h):
                continue
            before = np.r_[_START, h[:-1]]
            before[np.r_[True, row[1:] != row[:-1]]] = _START
            (place, v_hot), (_, w_hot) = _find(table, before), _find(table, h)
            part = (_home(before, h, v_hot, w_hot) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((before, h, part))
            part, v, w, row, place, v_hot = part[order], before[order], h[order], row[order], place[order], v_hot[order]
            edges = np.r_[np.flatnonzero(np.r_[True, np.diff(part) != 0]), len(part)]
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                own, at = np.unique(row[a:b], return_inverse=True)
                names = np.argsort(ids[own], kind="stable")
                rank = np.empty(len(own), np.int64)
                rank[names] = np.arange(len(own))
                step = np.diff(ids[own][names])
                first = np.r_[True, w[a + 1:b] != w[a:b - 1]]
                out.append((int(part[a]), int(ids[own][names][0]), _small(step), w[a:b][first], _small(np.diff(np.r_[np.flatnonzero(first), b - a])), _small(rank[at]),
                            np.packbits(v_hot[a:b]), (place[a:b][v_hot[a:b]] & 0xFFFF).astype("<u2"), (place[a:b][v_hot[a:b]] >> 16).astype("u1"), v[a:b][~v_hot[a:b]]))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([x[0] for x in out], pa.int32()), "base": pa.array([x[1] for x in out], pa.int64()),
                "widths": pa.array([1000 * x[2].itemsize + 100 * x[4].itemsize + x[5].itemsize for x in out], pa.int32()),
                **{n: pa.array([x[i].tobytes() for x in out], pa.binary()) for i, n in enumerate(PACKED, 2)}})

    return docs.mapInArrow(pack, "part int, base long, widths int, " + ", ".join(f"{n} binary" for n in PACKED))


def _unpack(r: dict, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, second words, document ids) of one packed row."""
    a, b, c = r["widths"] // 1000, r["widths"] // 100 % 10, r["widths"] % 10
    ids = r["base"] + np.r_[0, np.cumsum(np.frombuffer(r["step"], f"<u{a}").astype(np.int64))]
    w = np.repeat(np.frombuffer(r["word"], "<u8"), np.frombuffer(r["times"], f"<u{b}").astype(np.int64))
    hot, v = np.unpackbits(np.frombuffer(r["hot"], "u1"), count=len(w)).astype(bool), np.empty(len(w), np.uint64)
    v[hot] = names[np.frombuffer(r["low"], "<u2") + (np.frombuffer(r["high"], "u1").astype(np.int64) << 16)]
    v[~hot] = np.frombuffer(r["rare"], "<u8")
    return v, w, ids[np.frombuffer(r["rank"], f"<u{c}")]


def _slices(rows: list[dict], hot) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of a partition in slices that keep together what belongs together."""
    v, w, doc = (np.concatenate(x) for x in zip(*(_unpack(r, hot[0]) for r in rows)))
    rows.clear()
    n = max(1, len(v) // SLICE)
    part = (_home(v, w, _find(hot, v)[1], _find(hot, w)[1]) >> np.uint64(40)) % np.uint64(n)
    for k in range(n):
        own = np.flatnonzero(part == k)
        yield v[own], w[own], doc[own]


def _score_pairs(v: np.ndarray, w: np.ndarray, doc: np.ndarray, hot, total: int):
    """Per document the sum and the number of pairs; and (first word, document, times) where the first word's count is elsewhere."""
    order = np.lexsort((doc, v, w))
    v, w, doc = v[order], w[order], doc[order]
    new_w = np.r_[True, w[1:] != w[:-1]]
    new_p = new_w | np.r_[True, v[1:] != v[:-1]]
    runs = np.flatnonzero(new_p | np.r_[True, doc[1:] != doc[:-1]])
    own = np.diff(np.r_[runs, len(w)])
    pair_of, word_of = (np.cumsum(new_p) - 1)[runs], (np.cumsum(new_w) - 1)[runs]
    pair = np.bincount(pair_of, own)[pair_of]
    here, here_n = w[new_w], np.bincount(word_of, own)  # whole counts of the rare words among them
    rare = ~_find(hot, here)[1]
    local = here[rare], here_n[rare].astype(np.int64)
    (at, known), word = _find(hot, w[runs]), here_n[word_of]
    word[known] = hot[1][at[known]]
    v, doc = v[runs], doc[runs]
    others, start = pair - own, v == _START
    seen = (others > 0) & ~start
    below = np.zeros(len(v))
    for table in (hot, local):
        at, known = _find(table, v)
        below[known] = table[1][at[known]]
    score = np.where(seen, np.log(np.maximum(others, 1)), np.log(word / total) + np.where(start, 0.0, np.log(BACKOFF)))
    score -= np.where(seen & (below > 0), np.log(np.maximum(below, 1)), 0.0)
    ids, at = np.unique(doc, return_inverse=True)
    late = seen & (below == 0)
    return ids, np.bincount(at, score * own), np.bincount(at, own).astype(np.int64), (v[late], doc[late], own[late])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, sum_logprob, mean_logprob) of every row with a doc_id.

    Words are runs of non-spaces with A-Z lower-cased. A null or wordless text
    has 0 words, sum 0 and a null mean. Rows of one doc_id are one document
    (each text starts afresh); a null doc_id is left out, as no count could be
    kept from it. An empty table gives none.
    """
    named = picked(docs, doc_id, text).where(F.col(f"`{doc_id}`").isNotNull()).withColumnRenamed(doc_id, "doc")
    counts = settle(word_counts(named, "doc", text))
    total = counts.agg(F.sum("n")).first()[0] or 0
    spark = docs.sparkSession
    table = counts.where(F.col("n") * HOT > total).toPandas()  # HOT rows at most
    names, n = table["word"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(np.int64)
    order = np.argsort(names)
    hot = spark.sparkContext.broadcast((names[order], n[order]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                held.setdefault(r["part"], []).append(r)
        while held:
            rows, ids, sums, n = held.popitem()[1], [], [], []
            for part in _slices(rows, hot.value):
                a, x, k, (v, doc, own) = _score_pairs(*part, hot.value, total)
                ids, sums, n = [*ids, a], [*sums, x], [*n, k]
                if len(v):
                    low, at = np.unique(np.stack([v.view(np.int64), doc]), axis=1, return_inverse=True)
                    none = pa.nulls(low.shape[1], pa.binary())
                    yield pa.RecordBatch.from_pydict({
                        "before": low[0], "doc": low[1], "n": np.bincount(at, own).astype(np.int64), "to": pa.nulls(low.shape[1], pa.int32()), "docs": none, "ns": none, "sums": none})
            ids, at = np.unique(np.concatenate(ids), return_inverse=True)
            n, sums = np.bincount(at, np.concatenate(n)).astype("<i8"), np.bincount(at, np.concatenate(sums))
            # a document has a sum in nearly every partition: they go on packed, by a hash of the document
            to = (words.mix(ids.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(parts + 1))
            own = [order[a:b] for a, b in zip(edges[:-1], edges[1:]) if b > a]
            yield pa.RecordBatch.from_pydict({
                "before": pa.array([None] * len(own), pa.int64()), "doc": pa.array([None] * len(own), pa.int64()), "n": pa.array([None] * len(own), pa.int64()),
                "to": pa.array([int(to[x[0]]) for x in own], pa.int32()), "docs": [ids[x].astype("<i8").tobytes() for x in own],
                "ns": [n[x].tobytes() for x in own], "sums": [sums[x].astype("<f8").tobytes() for x in own]})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[np.frombuffer(r[k], t) for k, t in (("docs", "<i8"), ("ns", "<i8"), ("sums", "<f8"))] for b in batches for r in b.to_pylist()]
        if got:
            docs, n, sums = (np.concatenate(x) for x in zip(*got))
            order = np.lexsort((sums, docs))  # one order of summing, whatever order the rows came in
            ids, at = np.unique(docs[order], return_inverse=True)
            yield pa.RecordBatch.from_pydict({"doc": ids, "n": np.bincount(at, n[order]).astype(np.int64), "score": np.bincount(at, sums[order])})

    packed = pair_rows(named, "doc", text, hot, parts)
    schema = "before long, doc long, n long, to int, docs binary, ns binary, sums binary"
    rows = settle(packed.repartition(parts, "part").mapInArrow(reduce, schema))
    done = rows.where("before is null").select("to", "docs", "ns", "sums").repartition(parts, "to").mapInArrow(gather, "doc long, n long, score double")
    rare = rows.where("before is not null").select("before", "doc", "n").join(counts.select(F.col("word").alias("before"), F.col("n").alias("c")), "before")
    late = rare.select("doc", F.lit(0).cast("long").alias("n"), (-F.col("n") * F.log("c")).alias("score"))
    sums = done.union(late).groupBy("doc").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))
    ids = named.select("doc").distinct().join(sums, "doc", "left")
    return ids.select(
        F.col("doc").alias("doc_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_words"),
        F.round(F.coalesce("score", F.lit(0.0)), 4).alias("sum_logprob"), F.round(F.col("score") / F.col("n"), 6).alias("mean_logprob"))


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT doc_id, unnest(w) AS w, unnest(list_concat([NULL], w[:-2])) AS v FROM d WHERE len(w) > 0),
c AS (SELECT w, count(*) AS n FROM t GROUP BY w),
o AS (SELECT doc_id, v, w, count(*) AS own FROM t GROUP BY ALL),
p AS (SELECT *, CASE WHEN v IS NULL THEN 0 ELSE sum(own) OVER (PARTITION BY v, w) - own END AS others FROM o),
s AS (SELECT doc_id, own, own * CASE WHEN others > 0 THEN ln(others) - ln(cv.n) ELSE ln(cw.n / (SELECT sum(n) FROM c)) + CASE WHEN p.v IS NULL THEN 0 ELSE ln(0.4) END END AS score
      FROM p JOIN c cw ON cw.w = p.w LEFT JOIN c cv ON cv.w = p.v),
g AS (SELECT doc_id, sum(own) AS n, sum(score) AS score FROM s GROUP BY doc_id)
SELECT i.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, round(coalesce(score, 0), 4) AS sum_logprob, round(score / n, 6) AS mean_logprob
FROM (SELECT DISTINCT doc_id FROM d) i LEFT JOIN g USING (doc_id)
"""
