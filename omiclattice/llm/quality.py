"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every text.
Expectation-maximisation over the counts of all vote patterns estimates their
accuracies; the posterior labels of a bounded sample (``sample`` rows, chosen by
a hash of the text) train a linear scorer over hashed word shapes, which scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from omiclattice.llm import words
from omiclattice.llm.learning import Votes, fit_linear, pairs_of, sigmoid
from omiclattice.llm.storage import settle

#: Hashed word shapes.
WIDTH = 1 << 14
LABELLERS = ("symbols", "capitals", "shouting", "repeated lines", "repeated words", "stuttering", "length", "word length", "function words", "sentences")

# Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that for it was on as with be by a "
    "le la les de des du et en que un une dans qui pour "
    "der die das und zu den von ist ein mit sich auf dem "
    "el los las y del se por con para su al lo"
).split()

_UP, _LOW, _DIGIT = (np.array([f(chr(b)) if b < 128 else v for b in range(256)]) for f, v in ((str.isupper, False), (str.islower, True), (str.isdigit, False)))
_SYMBOL = np.array([b < 128 and not chr(b).isalnum() and chr(b) not in " \t\n\r\v\f.,;:'\"!?()-" for b in range(256)])
#: Byte classes of a word's shape: capital, other letter, digit, and each ASCII mark for itself.
_SHAPE = np.where(_UP, 65, np.where(_LOW, 97, np.where(_DIGIT, 48, np.arange(256)))).astype(np.uint8)


def _share(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(mask)]
    return sums[offs[1:]] - sums[offs[:-1]]


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row."""
    _, first = np.unique(h ^ words.mix(row.astype(np.uint64)), return_index=True)
    return np.bincount(row[first], minlength=n)


def _vote(good, bad) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0)).astype(np.int8)


def votes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x labellers votes, words of each row)."""
    n = len(offs) - 1
    h, row, start, end = words.words(buf, offs)
    size = np.diff(offs)
    count = np.bincount(row, minlength=n)
    some, chars = np.maximum(count, 1), np.maximum(size, 1)
    up, letters = _share(_UP[buf], offs), np.maximum(_share((_UP | _LOW)[buf], offs), 1)
    symbols, bangs = _share(_SYMBOL[buf], offs) / chars, _share(buf == 33, offs) / some
    kinds = _distinct(h, row, n)
    line, line_row, _, _ = words.words(buf, offs, True, np.arange(256) == 10)
    lines = np.bincount(line_row, minlength=n)
    own = _distinct(line, line_row, n)
    again = 1 - own / np.maximum(lines, 1)
    common = np.sort(np.array([words.word_hash(w) for w in FUNCTION_WORDS], np.uint64))
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    function = np.bincount(row[common[at] == h], minlength=n) / some
    mean = np.bincount(row, end - start, n) / some
    capitals = up / letters
    # a long text repeats words; what is expected falls with its length
    variety = kinds / np.minimum(some, 60 + some**0.75)
    twice = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n) / some
    stops = _share((buf == 46) | (buf == 63) | (buf == 44), offs) / some
    never = np.zeros(n, bool)
    return np.stack([
        _vote(never, symbols > 0.06), _vote(never, capitals > 0.4), _vote(never, bangs > 0.2), _vote(never, again > 0.3), _vote(never, variety < 0.25), _vote(never, (twice > 0.2) & (count > 3)),
        _vote(count >= 12, never), _vote((mean > 3) & (mean < 9), (mean < 2) | (mean > 20)),
        _vote(function > 0.08, (function < 0.02) & (count > 10)), _vote((stops > 0.02) & (stops < 0.5), (stops > 1) & (count > 10)),
    ], 1), count


def features(buf: np.ndarray, offs: np.ndarray, given: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value): square roots of the shares of hashed word shapes, and repetition of words and lines as the votes ``given`` have it."""
    n = len(offs) - 1
    cls = _SHAPE[buf]
    keep = np.r_[True, cls[1:] != cls[:-1]] if len(buf) else np.zeros(0, bool)
    edge = offs[1:-1]
    keep[edge[edge < len(buf)]] = True
    at = np.r_[0, np.cumsum(keep)][offs]
    h, row, _, _ = words.words(cls[keep], at, False)
    count = np.maximum(np.bincount(row, minlength=n), 1)
    a, b, k = pairs_of(row, (h % np.uint64(WIDTH - 64)).astype(np.int64), WIDTH)
    # what shapes can't show takes the last slots
    coarse = [(np.arange(n), np.full(n, WIDTH - 64 + 3 * i) + given[:, j] + 1) for i, j in enumerate((3, 4, 5, 6))]
    rows = np.concatenate([a, *(x for x, _ in coarse)])
    slots = np.concatenate([b, *(x for _, x in coarse)])
    return rows, slots, np.concatenate([np.sqrt(k / count[a]), np.full(len(coarse) * n, 0.5)])


def fit(docs: DataFrame, sample: int = 20_000, text: str = "text") -> dict:
    """Labeller odds from all rows, scorer weights from about ``sample`` of them."""
    total = max(1, docs.count())
    part = int(min(1.0, sample / total) * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in words.chunks(batches, "text"):
            v, count = votes(buf, offs)
            chosen = np.flatnonzero(rows.column("chosen").to_numpy(zero_copy_only=False) & (count > 0))
            slots, values = np.full(len(v), None, object), np.full(len(v), None, object)
            if len(chosen):
                row, slot, value = features(buf, offs, v)
                order = np.argsort(row, kind="stable")
                at = words.spans(row[order], len(v))
                for i in chosen:
                    own = order[at[i]:at[i + 1]]
                    slots[i], values[i] = slot[own].astype("<i4").tobytes(), value[own].astype("<f4").tobytes()
            keep = np.flatnonzero(count > 0)
            yield pa.RecordBatch.from_pydict({
                "votes": [v[i].tobytes() for i in keep], "slots": pa.array(slots[keep].tolist(), pa.binary()), "values": pa.array(values[keep].tolist(), pa.binary())})

    column = F.col(f"`{text}`")
    named = docs.select(column.alias("text"), (F.pmod(F.xxhash64(column), F.lit(1_000_000)) < part).alias("chosen"))
    rows = settle(named.mapInArrow(run, "votes binary, slots binary, values binary"))
    seen = rows.groupBy("votes").count().collect()  # 3 ** labellers rows at most
    patterns = np.array([np.frombuffer(r["votes"], np.int8) for r in seen]).reshape(-1, len(LABELLERS))
    model = Votes(patterns, np.array([r["count"] for r in seen], float), prior=10.0, least=1.0)
    got = rows.where("slots is not null").collect()  # about ``sample`` rows
    slots = [np.frombuffer(r["slots"], "<i4") for r in got]
    row = np.repeat(np.arange(len(got)), [len(s) for s in slots])
    slot = np.concatenate(slots).astype(np.int64) if got else np.zeros(0, np.int64)
    value = np.concatenate([np.frombuffer(r["values"], "<f4") for r in got]).astype(float) if got else np.zeros(0)
    truth = model.posterior(np.array([np.frombuffer(r["votes"], np.int8) for r in got]).reshape(-1, len(LABELLERS))) if got else np.zeros(0)
    w = fit_linear(row, slot, value, lambda s: truth - sigmoid(s), WIDTH, 150, 0.5)
    return {"odds": model.odds, "share": model.share, "weights": w}


def scored(docs: DataFrame, model: dict, text: str = "text", column: str = "quality") -> DataFrame:
    """All rows and columns, and the scorer's probability of good quality in ``column``.

    A null or wordless text scores 0. Repeated rows score alike; an empty table
    stays empty; ``column`` must not name one of the table's own.
    """
    if column in docs.columns:
        raise ValueError(f"{column} is a column already")
    held = docs.sparkSession.sparkContext.broadcast(model["weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in words.chunks(batches, text):
            given, count = votes(buf, offs)
            row, slot, value = features(buf, offs, given)
            p = np.round(sigmoid(np.bincount(row, value * held.value[slot], rows.num_rows)), 6)
            p[count == 0] = 0
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(p)], [*rows.schema.names, column])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scored(docs, fit(docs))
    return found.select("doc_id", "quality", (F.col("quality") >= 0.5).alias("keep"))
