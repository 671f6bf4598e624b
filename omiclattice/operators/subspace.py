"""Leading directions over the samples without a samples-by-samples matrix.

Block Krylov iteration: a block of a few directions V is sent past all features,
each task adds up its part of X'(XV), and what is new in the sum, made orthogonal
to all before, is the next block. The directions are a table with one row a
sample; they are made orthogonal through inner products of their columns
(tall-skinny QR, done twice). The driver only sees matrices as wide as the number
of directions, and the block in hand on its way to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from omiclattice.functions.materialise import settle
from omiclattice.operators.corr import _matrix

#: Directions in a block beyond those asked for, and the residual at which one is taken as found.
EXTRA, TOLERANCE = 8, 1e-10


def _centred(x: np.ndarray, centre: bool) -> np.ndarray:
    return x - x.mean(axis=1, keepdims=True) if centre else x


def spread(vectors: DataFrame, centre: bool = True) -> float:
    """Sum of squares of all (centred) features."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"s": [float(np.square(_centred(_matrix(pdf["vec"]), centre)).sum())]})

    return vectors.select("vec").mapInPandas(part, "s double").agg(F.sum("s")).first()[0] or 0.0


def _passed(vectors: DataFrame, v: np.ndarray, centre: bool) -> DataFrame:
    """(i, y): the rows of X'(XV), summed over all features."""
    names = [f"y{j}" for j in range(v.shape[1])]
    sent = vectors.sparkSession.sparkContext.broadcast(v)  # as wide as a few rows of the input

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = None
        for pdf in batches:
            x = _centred(_matrix(pdf["vec"]), centre)
            new = x.T @ (x @ sent.value)
            acc = new if acc is None else acc + new
        if acc is not None:
            yield pd.DataFrame(acc, columns=names).assign(i=np.arange(len(acc)))

    rows = vectors.select("vec").mapInPandas(part, ", ".join(f"{c} double" for c in names) + ", i long")
    return rows.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).select("i", F.array(*names).alias("y"))


def _inner(table: DataFrame, columns: list[str], width: int) -> np.ndarray:
    """Inner products of the columns of all the arrays side by side."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = np.hstack([_matrix(pdf[c]) for c in columns])
            yield pd.DataFrame({"at": np.arange(z.shape[1] ** 2), "g": (z.T @ z).ravel()})

    cells = table.select(*columns).mapInPandas(part, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).collect()
    out = np.zeros(width * width)
    for r in cells:
        out[r["at"]] = r["g"]
    return out.reshape(width, width)


def _mixed(table: DataFrame, out: str, parts: dict[str, np.ndarray]) -> DataFrame:
    """``table`` with the sum over the named arrays, each times a small matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[out] = list(sum(_matrix(pdf[c]) @ m for c, m in parts.items()))
            yield pdf

    kept = [c for c in table.columns if c != out]
    schema = ", ".join(f"{c} {t}" for c, t in table.dtypes if c != out)
    return table.select(*set(kept + list(parts))).select(*table.columns).mapInPandas(
        lambda b: (p[[*kept, out]] for p in run(b)), f"{schema}, {out} array<double>")


def leading_directions(vectors: DataFrame, k: int, centre: bool = True, seed: int = 7) -> tuple[DataFrame, list[float], float]:
    """((i, u), values, total): the k leading unit directions over the samples, their eigenvalues and the sum of all.

    ``vectors`` has (feature_id, vec), all vectors as long as there are samples.
    Fewer directions come back if the features span fewer. The component of a direction with the largest magnitude is positive.
    """
    spark, n = vectors.sparkSession, vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    total = spread(vectors, centre)
    wide = min(n, k + EXTRA)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [np.random.default_rng((seed, i)).normal(size=wide) for i in pdf["id"].tolist()]
            yield pd.DataFrame({"i": pdf["id"], "z": rows})

    if not n or total <= 0:
        return spark.createDataFrame([], "i long, u array<double>"), [], total
    space = spark.range(n).mapInPandas(draw, "i long, z array<double>").withColumn("q", F.array().cast("array<double>"))
    dim, t = 0, np.zeros((0, 0))
    space, scale = settle(space), float(n)
    while True:
        # the new block, made orthogonal to the others and in itself, twice; columns that add nothing go
        links = None
        for _ in range(2):
            g = _inner(space, ["q", "z"] if dim else ["z"], dim + wide)
            cross, own = g[:dim, dim:], g[dim:, dim:] - g[:dim, dim:].T @ g[:dim, dim:]
            e, b = np.linalg.eigh((own + own.T) / 2)
            keep = e > 1e-18 * scale
            b, root = b[:, keep], np.sqrt(e[keep])
            links = (root[:, None] * b.T) if links is None else (root[:, None] * b.T) @ links
            parts = {"z": b / root} | ({"q": -cross @ (b / root)} if dim else {})
            wide, scale = int(keep.sum()), 1.0
            if not wide:
                break
            space = _mixed(space, "z", parts)
        if dim:
            values, basis = np.linalg.eigh((t + t.T) / 2)
            top = np.argsort(values)[::-1][:k]
            rest = np.linalg.norm(links @ basis[dim - links.shape[1]:, top], axis=0) if wide else np.zeros(len(top))
            if not wide or dim >= n or len(top) == k and (rest <= TOLERANCE * values[top[0]]).all():
                break
        space = settle(space.select("i", F.concat("q", "z").alias("q")))
        block = space.select("i", F.slice("q", dim + 1, wide).alias("v")).orderBy("i").toPandas()
        y = _passed(vectors, _matrix(block["v"]), centre)
        space = settle(space.join(y.withColumnRenamed("y", "z"), "i"))
        dim += wide
        g = _inner(space, ["q", "z"], dim + wide)
        new = np.zeros((dim, dim))
        new[:dim - wide, :dim - wide] = t
        new[:, dim - wide:] = g[:dim, dim:]
        new[dim - wide:, :] = g[:dim, dim:].T
        t, scale = new, float(np.trace(g[dim:, dim:]))
    top = [j for j in top if values[j] > 1e-12 * max(values[top[0]], 0)]
    found = settle(_mixed(space.select("i", "q"), "u", {"q": basis[:, top]}).select("i", "u"))
    largest = found.select(F.posexplode("u").alias("j", "x"), "i").groupBy("j").agg(F.max_by("x", F.struct(F.abs("x"), -F.col("i"))).alias("x"))
    sign = np.ones(len(top))
    for r in largest.collect():
        sign[r["j"]] = -1.0 if r["x"] < 0 else 1.0
    turned = F.zip_with("u", F.array(*map(F.lit, sign.tolist())), lambda x, s: x * s)
    return found.select("i", turned.alias("u")), [float(values[j]) for j in top], total
