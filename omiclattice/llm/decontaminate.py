"""Benchmark decontamination: item-sized windows, CGK embedding, bit-sampling LSH, exact edit verification.

Items and documents are word sequences (A-Z lower-cased, ASCII punctuation
dropped). A document is contaminated by an item of ``n`` words if a passage is
within ``k = floor(n * (1 - similarity))`` word edits of it.

1. The window of ``n`` words where such a passage begins shares at least
   ``n - 1 - 2k`` word pairs with the item, so windows with fewer are passed over: counted first over the pairs of
   all items, then item by item. This loses nothing and leaves few windows.
2. The CGK random walk maps windows and items to strings whose Hamming distance
   follows the edit distance; several walks and several samples of their symbols
   give LSH keys, and windows that share a key with the item are candidates. Samples come from
   steps at which the item's walk is still inside the item, so that equal keys mean equal words
   and never two ended walks. ``lsh_recall`` sets the number of samples.
3. Candidates are verified by the exact edit distance, with the passage's end left free.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from omiclattice.llm import words
from omiclattice.llm.storage import picked

#: Items below so many words are no evidence and are not searched.
LEAST = 5
#: Bytes of benchmark text held in each task; a larger benchmark is searched in slices.
SLICE = 8 << 20
#: Symbols in a sample, walks, and the share of walk positions that a match at the limit is taken to keep.
SAMPLE, WALKS, KEPT = 2, 8, 0.2


def samples_for(recall: float) -> int:
    """Samples for each walk so that all walks reach the recall at ``KEPT``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - KEPT**SAMPLE) / WALKS)


def edit_distances(item: np.ndarray, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least Levenshtein distance of an item to a beginning of each row of ``windows``, of at most ``lengths`` symbols, and its length."""
    m, n = windows.shape
    step = np.arange(n + 1)
    row, new = np.tile(step, (m, 1)), np.empty((m, n + 1), np.int64)
    for i, x in enumerate(item, 1):
        new[:, 0] = i
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (windows != x), out=new[:, 1:])
        new -= step
        np.minimum.accumulate(new, axis=1, out=row)
        row += step
    row[step[None] > lengths[:, None]] = len(item) + n
    end = row.argmin(1)
    return row[np.arange(m), end], end


def embed(s: np.ndarray, bits: np.ndarray, steps: int | None = None) -> np.ndarray:
    """CGK walks of the rows of ``s`` (symbols, -1 beyond the end): (walks, rows, steps); a random bit of step and symbol moves on.

    Without ``steps``, three for each symbol of a row.
    """
    m, n = s.shape
    steps = 3 * n if steps is None else steps
    walk = np.repeat(np.arange(len(bits)), m)
    flat, row = np.c_[s, np.full((m, 1), -1)].ravel(), np.tile(np.arange(m) * (n + 1), len(bits))
    at, out = row.copy(), np.empty((len(row), steps), np.int64)
    for j in range(steps):
        out[:, j] = x = flat[at]
        at += (bits[walk, j // 64, x] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64)
        np.minimum(at, row + n, out=at)
    return out.reshape(len(bits), m, steps)


class Items:
    """Benchmark items of one slice as symbols, with the pairs and LSH keys to look up."""

    def __init__(self, items: list[tuple[int, str]], similarity: float, recall: float, seed: int = 11):
        found = []
        for name, text in items:
            buf, offs = words.buffers(pa.array([text]))
            found.append((name, words.words(buf, offs, True, words.NOT_WORD)[0]))
        found = [(i, h) for i, h in found if len(h) >= LEAST]
        self.names = [i for i, _ in found]
        self.vocabulary = np.unique(np.concatenate([h for _, h in found])) if found else np.zeros(0, np.uint64)
        v = self.base = len(self.vocabulary) + 1
        self.symbols = [np.searchsorted(self.vocabulary, h) + 1 for _, h in found]
        codes = [np.unique(s[:-1] * v + s[1:]) for s in self.symbols]
        self.pairs, place = np.unique(np.concatenate(codes), return_inverse=True) if found else (np.zeros(0, np.int64),) * 2
        owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        order = np.argsort(place, kind="stable")
        self.owners, self.owner_at = owner[order], np.searchsorted(place[order], np.arange(len(self.pairs) + 1))
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.sizes = np.array([len(s) for s in self.symbols], np.int64)
        self.edits = np.array([int(n * (1 - similarity) + 1e-9) for n in self.sizes], np.int64)
        rng, top = np.random.default_rng(seed), int(self.sizes.max(initial=1))
        self.bits = rng.integers(0, np.iinfo(np.uint64).max, (WALKS, 3 * top // 64 + 1, v + 1), np.uint64, endpoint=True)
        #: Where each sample lies, as a share of the item's walk.
        self.draws = rng.random((WALKS, samples_for(recall), SAMPLE))
        self.own = {}

    def keys(self, walks: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """(walks, rows, samples) keys: the symbols at ``steps`` in one number."""
        key = np.zeros((len(walks), walks.shape[1], steps.shape[1]), np.int64)
        for j in range(SAMPLE):
            key = key * (self.base + 2) + np.take_along_axis(walks, steps[:, None, :, j], 2) + 1
        return key

    def item(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sampled steps and keys of an item; every step lies before the end of its walk."""
        if i not in self.own:
            walks = embed(self.symbols[i][None], self.bits)
            steps = (self.draws * (walks[:, 0] >= 0).sum(1)[:, None, None]).astype(np.int64)
            self.own[i] = steps, self.keys(walks, steps)
        return self.own[i]

    def alike(self, walks: np.ndarray, i: int) -> np.ndarray:
        """Which of the embedded windows share a key with the item."""
        steps, own = self.item(i)
        return (self.keys(walks, steps) == own).any((0, 2))

    def windows(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, item, first word) of windows that share enough pairs with an item of their size."""
        sym, none = np.zeros(len(h), np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.near[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        sym[maybe] = np.where(self.vocabulary[at] == h[maybe], at + 1, 0)
        both = np.flatnonzero((sym[:-1] > 0) & (sym[1:] > 0) & (row[:-1] == row[1:]))
        code = sym[both] * self.base + sym[both + 1]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        place, pair = both[self.pairs[at] == code], at[self.pairs[at] == code]
        known = np.zeros(len(h) + 1, np.int32)
        known[place + 1] = 1
        sums = np.cumsum(known, dtype=np.int32)  # known pairs that begin before each word
        inside, starts = np.zeros(len(h) + 1, np.int32), {}
        for n in map(int, np.unique(self.sizes)):
            k = int(self.edits[np.argmax(self.sizes == n)])
            m = len(h) - (n - k) + 1
            if m <= 0:
                continue
            full = max(0, len(h) - n + 1)
            start = np.flatnonzero(sums[n - 1:n - 1 + full] - sums[:full] >= max(1, n - 1 - 2 * k))
            tail = np.arange(full, m)
            start = np.r_[start, tail[sums[len(h) - 1] - sums[tail] >= max(1, n - 1 - 2 * k)]]
            start = start[row[start] == row[start + n - k - 1]]
            if len(start):
                starts[n] = start
                np.add.at(inside, start, 1)
                np.add.at(inside, np.minimum(start + n, len(h)), -1)
        if not starts:
            return sym, none, none
        # the same count for each item by itself, where some window is left
        here = np.cumsum(inside)[place] > 0
        place, pair = place[here], pair[here]
        times = self.owner_at[pair + 1] - self.owner_at[pair]
        item = self.owners[np.repeat(self.owner_at[pair] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())]
        where = np.repeat(place, times)
        order = np.argsort(item, kind="stable")
        item, where = item[order], where[order]
        out = []
        for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[np.flatnonzero(np.r_[True, np.diff(item) != 0]), len(item)])):
            i = int(item[a])
            n, least = int(self.sizes[i]), max(1, int(self.sizes[i] - 1 - 2 * self.edits[i]))
            if b - a < least or n not in starts:
                continue
            own, start = where[a:b], starts[n]
            count = np.searchsorted(own, start + n - 1) - np.searchsorted(own, start)
            keep = start[count >= least]
            if len(keep):
                out.append((np.full(len(keep), i), keep))
        return (sym, *(np.concatenate(x) for x in zip(*out))) if out else (sym, none, none)

    def search(self, h: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, first word, words, distance): the closest window of each row and item."""
        if not len(self.pairs) or not len(h):
            return
        sym, item, start = self.windows(h, row)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for part in range(0, len(item), 1024):
            own, at = item[part:part + 1024], start[part:part + 1024]
            n = int(self.sizes[own].max())
            place = at[:, None] + np.arange(n)
            held = (place < np.minimum(at + self.sizes[own], len(h))[:, None]) & (row[np.minimum(place, len(h) - 1)] == row[at][:, None])
            window = np.where(held, sym[np.minimum(place, len(h) - 1)], -1)
            walks = embed(window, self.bits, 1 + max(int(self.item(int(i))[0].max()) for i in np.unique(own)))
            for i in np.unique(own):
                mine = np.flatnonzero(own == i)
                mine = mine[self.alike(walks[:, mine], int(i))]
                same = (window[mine, :self.sizes[i]] == self.symbols[i]).all(1)
                done = set(row[at[mine[same]]].tolist())  # an exact window leaves nothing to look for in its row
                mine = mine[same | ~np.isin(row[at[mine]], list(done))]
                longer = at[mine][:, None] + np.arange(self.sizes[i] + self.edits[i])  # insertions push an item beyond its window
                inside = (longer < len(h)) & (row[np.minimum(longer, len(h) - 1)] == row[at[mine]][:, None])
                symbols = np.where(inside, sym[np.minimum(longer, len(h) - 1)], -1)
                for c, d, w in zip(mine, *edit_distances(self.symbols[i], symbols, inside.sum(1))):
                    name = int(row[at[c]]), int(i)
                    if d <= self.edits[i] and (name not in best or (d, int(at[c])) < best[name][:2]):
                        best[name] = int(d), int(at[c]), int(w)
        for (_, i), (d, at, n) in best.items():
            yield i, at, n, d


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, lsh_recall: float = 0.99, doc_id: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, first_word, n_words, distance): for each contaminated row and item the closest window.

    ``start`` and ``end`` are code points of the text. Null and empty texts hold
    nothing; items below ``LEAST`` words and null items are not searched; equal
    windows resolve to the first; repeated rows each report; empty tables report
    nothing; other columns are left aside.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length(F.col(f"`{item_text}`")))).first()[0] or 0
    slices = max(1, math.ceil(size / SLICE))
    named = picked(docs, doc_id, text)
    own = benchmark.where(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t"))
    out = None
    for k in range(slices):
        rows = own.where(F.pmod(F.xxhash64("t"), F.lit(slices)) == k).collect()  # about SLICE bytes
        found = spark.sparkContext.broadcast([(r.i, r.t) for r in rows])

        def find(batches: Iterator[pa.RecordBatch], found=found) -> Iterator[pa.RecordBatch]:
            items = Items(found.value, similarity, lsh_recall)
            for part, buf, offs in words.chunks(batches, text):
                h, row, a, b = words.words(buf, offs, True, words.NOT_WORD)
                got = list(items.search(h, row))
                if not got:
                    continue
                ids = part.column(doc_id)
                points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
                first, last = np.array([x[1] for x in got]), np.array([x[1] + x[2] - 1 for x in got])
                of = row[first]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids.take(pa.array(of)).cast(pa.int64()), "item_id": pa.array([items.names[x[0]] for x in got], pa.int64()),
                    "start": points[a[first]] - points[offs[of]], "end": points[b[last]] - points[offs[of]],
                    "first_word": first - np.searchsorted(row, of), "n_words": pa.array([x[2] for x in got], pa.int64()),
                    "distance": pa.array([x[3] for x in got], pa.int64())})

        part = named.mapInArrow(find, "doc_id long, item_id long, start long, end long, first_word long, n_words long, distance long")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """Rows of documents without a leak; all columns stay. Rows with a null doc_id stay too."""
    bad = leaks(docs, benchmark, doc_id=doc_id, **how).select(F.col("doc_id").alias("__leaked")).distinct()
    return docs.join(bad, F.col(f"`{doc_id}`") == F.col("__leaked"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
