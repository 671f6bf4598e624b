"""Ranked lexical search: term at a time, rarest first, with limited accumulators.

One pass over the texts keeps, of the words that some item asks for, the
postings (term, document, occurrences) as flat arrays of blocks of documents,
and counts documents and words. Document frequencies are summed over the blocks;
with them every task searches its blocks for all items.

In a block an item's terms are taken rarest first. A document met for the first
time gets an accumulator, until what the remaining terms can still give (the sum of
their largest contributions in the block) stays below the kth partial score: a
document without an accumulator can't reach the result any more. The others
are updated by all remaining terms, so their scores are exact; those that can't
reach the kth score are put aside. A task carries its kth scores from block to
block, and its best k documents of each item meet those of the other tasks in one ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from omiclattice.llm import words
from omiclattice.llm.storage import picked, settle

#: Bytes of item texts whose terms every task holds; more items are searched in slices, with a scan for each.
SLICE = 32 << 20
#: A block is closed beyond so many documents or postings.
DOCUMENTS, POSTINGS = 1 << 16, 1 << 21

_BLOCK = "doc binary, none binary, n binary, place binary, term binary, tf binary, n_docs long, n_words long"


def terms_of(texts: list[str]) -> np.ndarray:
    """Sorted distinct hashes of the terms of some texts."""
    buf, offs = words.buffers(pa.array(texts, pa.string()))
    return np.unique(words.words(buf, offs, True, words.NOT_WORD)[0])


def blocks(docs: DataFrame, vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings of the broadcast ``vocabulary`` (sorted hashes) in blocks; every task also counts its documents and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        maybe = np.zeros(1 << 20, bool)  # a first, small table that passes few other words
        maybe[(known >> np.uint64(44)).astype(np.int64)] = True
        held: list[tuple] = []
        n_docs = n_words = docs_held = postings_held = 0

        def row():
            cols = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0, np.int64)] * 6
            kinds = ("<i8", "?", "<i8", "<i4", "<i4", "<i4")
            data = {k: [x.astype(t).tobytes()] for k, x, t in zip(("doc", "none", "n", "place", "term", "tf"), cols, kinds)}
            return pa.RecordBatch.from_pydict(data | {"n_docs": pa.array([n_docs], pa.int64()), "n_words": pa.array([n_words], pa.int64())})

        for part, buf, offs in words.chunks(batches, text):
            h, of, _, _ = words.words(buf, offs, True, words.NOT_WORD)
            n = np.bincount(of, minlength=part.num_rows)
            n_docs, n_words = n_docs + int((n > 0).sum()), n_words + len(h)
            at = np.flatnonzero(maybe[(h >> np.uint64(44)).astype(np.int64)])
            term = np.minimum(np.searchsorted(known, h[at]), max(0, len(known) - 1))
            hit = known[term] == h[at] if len(known) else np.zeros(0, bool)
            if not hit.any():
                continue
            key, tf = np.unique(of[at[hit]] * len(known) + term[hit], return_counts=True)
            rows, place = np.unique(key // len(known), return_inverse=True)
            ids = part.column(doc_id).cast(pa.int64())
            none = ids.is_null().to_numpy(zero_copy_only=False)
            held.append((ids.fill_null(0).to_numpy()[rows], none[rows], n[rows], place + docs_held, key % len(known), tf))
            docs_held, postings_held = docs_held + len(rows), postings_held + len(key)
            if docs_held >= DOCUMENTS or postings_held >= POSTINGS:
                yield row()
                held, n_docs, n_words, docs_held, postings_held = [], 0, 0, 0, 0
        if n_docs:
            yield row()

    return settle(picked(docs, doc_id, text).mapInArrow(run, _BLOCK))


def frequencies(stored: DataFrame) -> DataFrame:
    """(term, df): documents that hold each term, summed over the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                term, n = np.unique(np.frombuffer(x.as_buffer(), "<i4"), return_counts=True)
                yield pa.RecordBatch.from_pydict({"term": pa.array(term, pa.int32()), "n": pa.array(n, pa.int64())})

    return stored.select("term").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("df"))


class Block:
    """Postings of a block by term, with each posting's share of the score before the term's weight."""

    def __init__(self, row: dict, n_docs: int, n_words: int):
        get = lambda k, t: np.frombuffer(row[k], t)
        self.doc, self.none = get("doc", "<i8"), get("none", "?")
        place, term, tf = get("place", "<i4"), get("term", "<i4"), get("tf", "<i4").astype(np.int64)
        m = 50 + 50 * get("n", "<i8") * n_docs // n_words
        order = np.argsort(term, kind="stable")  # documents stay in ascending place
        self.place = place[order].astype(np.int64)
        self.share = (1_000_000_000 * tf // (1000 * tf + 20 * m[place]))[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.at = np.append(first, len(order))
        self.top = np.maximum.reduceat(self.share, first) if len(first) else np.zeros(0, np.int64)
        self.score, self.met = np.zeros(len(self.doc), np.int64), np.zeros(len(self.doc), bool)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, exact scores, accumulators made) of all that may be among the best ``k``; ``terms`` come rarest first.

        Documents that stay below ``least`` may be left out.
        """
        at = np.searchsorted(self.terms, terms)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == terms[here]
        at, weights = at[here], weights[here]
        left = np.append(np.cumsum((weights * self.top[at])[::-1])[::-1], 0)  # what the terms from each on can give
        score, met = self.score, self.met
        made, alive = [np.zeros(0, np.int64)], None
        for j, (t, w) in enumerate(zip(at.tolist(), weights.tolist())):
            d, x = self.place[self.at[t]:self.at[t + 1]], w * self.share[self.at[t]:self.at[t + 1]]
            if alive is None:
                score[d] += x
                new = d[~met[d]]
                met[new] = True
                made.append(new)
                if sum(map(len, made)) >= k:
                    made = [np.concatenate(made)]
                    least = max(least, int(np.partition(score[made[0]], -k)[-k]))
                if left[j + 1] < least:
                    alive = np.sort(np.concatenate(made))
            elif len(alive):
                if len(alive) * 16 < len(d):
                    p = np.minimum(np.searchsorted(d, alive), len(d) - 1)
                    hit = d[p] == alive
                    score[alive[hit]] += x[p[hit]]
                else:
                    hit = met[d]
                    score[d[hit]] += x[hit]
                if len(alive) >= k:
                    least = max(least, int(np.partition(score[alive], -k)[-k]))
            if alive is not None and len(alive):
                alive = alive[score[alive] + left[j + 1] >= least]
        every = np.concatenate(made)
        alive = every if alive is None else alive
        alive = alive[score[alive] >= least]
        found = score[alive]
        score[every], met[every] = 0, False
        return alive, found, len(every)


def _best(rows: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k first of (score, none, doc): highest score, then smallest doc_id, null last."""
    keep = np.lexsort((rows[2], rows[1], -rows[0]))[:k]
    return tuple(x[keep] for x in rows)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k highest-scoring documents with a score above 0, ties to the smaller doc_id.

    A null or wordless text is no document of the counts and is never found; a
    null or wordless item has no rows. Rows of one item_id are one item with the
    terms of all of them. Rows that repeat a doc_id are documents of their own,
    each ranked; those with a null doc_id too, behind equal scores. Terms are
    compared by 64-bit hashes. Long texts are read whole; other columns are
    left aside; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    own = items.where(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").cast("long").alias("i"), F.col(f"`{item_text}`").alias("t")).distinct()
    slices = max(1, math.ceil((own.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / SLICE))
    out = counts = None
    for part in range(slices):
        rows = own.where(F.pmod(F.xxhash64("i"), F.lit(slices)) == part).collect()  # about SLICE bytes
        texts: dict = {}
        for r in rows:
            texts.setdefault(r.i, []).append(r.t)
        asked = {i: terms_of(t) for i, t in texts.items()}
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *asked.values()]))
        stored = blocks(docs, spark.sparkContext.broadcast(vocabulary), doc_id, text)
        if counts is None:
            counts = stored.agg(F.sum("n_docs"), F.sum("n_words")).first()
        n_docs, n_words = counts[0] or 0, counts[1] or 0
        df = np.zeros(len(vocabulary), np.int64)
        for r in frequencies(stored).collect():  # one row a term of the slice
            df[r.term] = r.df
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        plan = []
        for i, h in asked.items():
            term = np.searchsorted(vocabulary, h)
            term = term[np.argsort(df[term], kind="stable")].astype(np.int32)
            plan.append((i, term, weight[term]))
        plan = spark.sparkContext.broadcast(plan)

        def run(batches: Iterator[pa.RecordBatch], plan=plan, n_docs=n_docs, n_words=n_words) -> Iterator[pa.RecordBatch]:
            best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(plan.value)
            for b in batches:
                for row in b.to_pylist():
                    block = Block(row, n_docs, n_words)
                    for j, (_, term, w) in enumerate(plan.value):
                        least = int(best[j][0][-1]) if len(best[j][0]) == k else 1
                        d, s, _ = block.search(term, w, k, least)
                        if len(d):
                            best[j] = _best(tuple(np.concatenate(x) for x in zip(best[j], (s, block.none[d], block.doc[d]))), k)
            for (i, _, _), (s, none, d) in zip(plan.value, best):
                if len(s):
                    yield pa.RecordBatch.from_pydict({"item_id": pa.array([i] * len(s), pa.int64()), "doc_id": pa.array(d, pa.int64(), mask=none), "score": pa.array(s)})

        found = stored.drop("n_docs", "n_words").mapInArrow(run, "item_id long, doc_id long, score long")
        out = found if out is None else out.union(found)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nw FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
u AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM i) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, nd),
s AS (SELECT i.item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nw)))) AS BIGINT) AS score
      FROM p JOIN i USING (term) JOIN f USING (term), c GROUP BY i.item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""
