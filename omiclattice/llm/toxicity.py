"""Toxicity grades by cumulative-link ordinal regression on hashed words.

Grade 0 is a text labelled not toxic; toxic ones are graded by how large their
share of words is that mark toxic texts (log odds over the labelled sample),
cut at quantiles. One weight a hashed word is shared by all thresholds:
``P(grade <= j) = sigmoid(threshold_j - score)``. The model is fitted to a
bounded sample of labelled rows (``sample``, chosen by a hash of doc_id) and
scores every text; expected severity is the mean grade.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from omiclattice.llm import words
from omiclattice.llm.learning import pairs_of, sigmoid
from omiclattice.llm.storage import picked

#: Hashed words.
WIDTH = 1 << 18


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value): square roots of word shares, so each row has length one."""
    h, row, _, _ = words.words(buf, offs, True, words.NOT_WORD)
    total = np.bincount(row, minlength=len(offs) - 1)
    row, slot, n = pairs_of(row, (h % np.uint64(WIDTH)).astype(np.int64), WIDTH)
    return row, slot, np.sqrt(n / total[row])


def grades(row: np.ndarray, slot: np.ndarray, value: np.ndarray, toxic: np.ndarray, levels: int) -> np.ndarray:
    """0 for rows not toxic, else 1 to ``levels`` - 1 by the share of words typical of toxic rows."""
    share = value**2
    one, n = np.bincount(slot[toxic[row]], minlength=WIDTH), np.bincount(slot, minlength=WIDTH)
    k, m = max(1, toxic.sum()), max(1, (~toxic).sum())
    odds = np.log((one + 0.5) / (k + 1)) - np.log((n - one + 0.5) / (m + 1))
    marked = np.bincount(row, share * (odds[slot] > 2), len(toxic))
    out = np.zeros(len(toxic), np.int64)
    if toxic.any():
        cuts = np.quantile(marked[toxic], np.linspace(0, 1, levels)[1:-1])
        out[toxic] = 1 + np.searchsorted(cuts, marked[toxic], "right")
    return out


def lean(row: np.ndarray, slot: np.ndarray, toxic: np.ndarray, prior: float = 20.0, least: float = 0.4) -> np.ndarray:
    """How far each word speaks for or against toxic rows: log odds shrunk by ``prior`` rows at the base rate, 0 below ``least``.

    Features are scaled by it, so that words met in a few rows can't be learnt by heart.
    """
    base = toxic.mean() if len(toxic) else 0.5
    if base in (0, 1):
        return np.zeros(WIDTH)
    one, n = np.bincount(slot[toxic[row]], minlength=WIDTH), np.bincount(slot, minlength=WIDTH)
    out = np.log((one + prior * base) / (n + prior)) - np.log(base)
    return np.where(np.abs(out) < least, 0, out)


def fit_grades(row, slot, value, grade: np.ndarray, levels: int, rounds: int = 150, rate: float = 1.0, decay: float = 1e-5) -> dict:
    """Weights and ordered thresholds that maximise the ordinal likelihood, by gradient ascent with momentum; both classes weigh alike."""
    scale = 10 * lean(row, slot, grade > 0)
    n, keep = len(grade), scale[slot] != 0
    row, slot, value = row[keep], slot[keep], value[keep] * scale[slot[keep]]
    share = np.clip([(grade <= j).mean() for j in range(levels - 1)] if n else [0.5] * (levels - 1), 1e-3, 1 - 1e-3)
    cut, w, step = np.maximum.accumulate(np.log(share / (1 - share))), np.zeros(WIDTH), np.zeros(WIDTH)
    importance = np.where(grade > 0, 0.5 / max(1e-9, (grade > 0).mean()), 0.5 / max(1e-9, (grade == 0).mean())) if n else np.zeros(0)
    for _ in range(rounds if len(row) else 0):
        s = np.bincount(row, value * w[slot], n)
        below = sigmoid(cut[None] - s[:, None])  # P(grade <= j)
        padded, at = np.c_[np.zeros(n), below, np.ones(n)], np.arange(n)
        hi, lo = padded[at, grade + 1], padded[at, grade]
        d = below * (1 - below) * (importance / np.maximum(hi - lo, 1e-9))[:, None]
        step = 0.9 * step + np.bincount(slot, value * (importance * (hi + lo - 1))[row], WIDTH) / n - decay * w
        w += rate * step
        cut += 0.5 * np.array([(d[grade == j, j].sum() - d[grade == j + 1, j].sum()) / n for j in range(levels - 1)])
        cut = np.maximum.accumulate(cut)
    return {"weights": (w * scale).astype(np.float32), "cuts": cut}


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, levels: int = 3, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """Model from about ``sample`` labelled rows (all, if fewer); rows with a null text or label give nothing."""
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").alias("toxic")).dropna()
    share = min(1.0, sample / max(1, known.count()))
    chosen = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buf, offs in words.chunks(batches, "text"):
            row, slot, value = features(buf, offs)
            at = words.spans(row, part.num_rows)
            yield pa.RecordBatch.from_pydict({
                "toxic": part.column("toxic").cast(pa.int32()), "slots": [slot[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:])],
                "values": [value[a:b].astype("<f4").tobytes() for a, b in zip(at[:-1], at[1:])]})

    texts = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).where(chosen).dropna()
    got = texts.join(known.where(chosen), "id").mapInArrow(rows, "toxic int, slots binary, values binary").collect()
    slots = [np.frombuffer(r.slots, "<i4") for r in got]
    row = np.repeat(np.arange(len(got)), [len(s) for s in slots])
    slot = np.concatenate(slots).astype(np.int64) if got else np.zeros(0, np.int64)
    value = np.concatenate([np.frombuffer(r["values"], "<f4") for r in got]).astype(float) if got else np.zeros(0)
    grade = grades(row, slot, value, np.array([r.toxic > 0 for r in got], bool), levels)
    return fit_grades(row, slot, value, grade, levels)


def severity(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, grade, toxic) of every row: expected and most likely grade, and whether grade 1 or more is likelier than 0.

    A null or wordless text has severity 0 and grade 0. Repeated rows score
    alike; an empty table gives none; other columns are left aside.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cut = held.value["weights"], held.value["cuts"]
        for part, buf, offs in words.chunks(batches, text):
            row, slot, value = features(buf, offs)
            s = np.bincount(row, value * w[slot], part.num_rows)
            below = np.c_[sigmoid(cut[None] - s[:, None]), np.ones(len(s))]
            below[np.bincount(row, minlength=len(s)) == 0] = 1
            p = np.diff(below, axis=1, prepend=0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(doc_id).cast(pa.int64()), "severity": np.round((1 - below[:, :-1]).sum(1), 6),
                "grade": pa.array(p.argmax(1), pa.int32()), "toxic": pa.array(below[:, 0] < 0.5)})

    return picked(docs, doc_id, text).mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return severity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
