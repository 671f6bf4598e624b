"""Principal components and joint PLS.

Components come from :mod:`subspace`. For PLS Spark reduces any number of features to
(samples x samples) inner products, whose rows go to one task a
cross-validation fold; per-feature weights and loadings come back as one dot
product per feature with the sample scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from omiclattice.functions.materialise import settle
from omiclattice.operators.corr import _matrix, gram
from omiclattice.operators.subspace import leading_directions

MAX_SAMPLES = 2048  # side of the sample matrix that a fold's task may hold (32 MB)


def standardise_vectors(vectors: DataFrame) -> DataFrame:
    """Centre and scale each feature (ddof 1, tiny deviations count as 1)."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def scale(s: pd.Series) -> pd.Series:
        x = _matrix(s)
        x = x - x.mean(axis=1, keepdims=True)
        sd = x.std(axis=1, ddof=1, keepdims=True)
        return pd.Series(list(x / np.where(sd < 1e-10, 1.0, sd)))

    return vectors.select("feature_id", scale("vec").alias("vec"))


def pca_samples(vectors: DataFrame, n_comp: int = 2) -> tuple[DataFrame, list[float]]:
    """(i, scores): the samples' scores, and the explained-variance ratios.

    Signs: the entry of largest magnitude of each component is positive.
    """
    found, values, total = leading_directions(vectors, n_comp)
    lengths = F.array(*[F.lit(float(np.sqrt(max(v, 0.0)))) for v in values]).cast("array<double>")
    scores = found.select("i", F.zip_with("u", lengths, lambda x, s: x * s).alias("scores"))
    return scores, [v / max(total, 1e-300) for v in values]


def pca_table(vectors: DataFrame, samples: list[str], n_comp: int = 2) -> DataFrame:
    scores, ratio = pca_samples(vectors, n_comp)
    names = vectors.sparkSession.createDataFrame(list(enumerate(samples)), "i long, sample_id string")
    return names.join(scores, "i").select("sample_id", *[F.col("scores")[j].alias(f"pc{j + 1}") for j in range(len(ratio))])


def batch_score(vectors: DataFrame) -> DataFrame:
    """Share of variance on the first component, 3 digits."""
    _, ratio = pca_samples(vectors, 1)
    return vectors.sparkSession.createDataFrame([(round(ratio[0], 3) if ratio else 0.0,)], "batch_score double")


# --- PLS in sample space ---------------------------------------------------------
def _pls_scores(kx: np.ndarray, ky: np.ndarray, n_comp: int) -> list[dict]:
    """NIPALS scores from Kx = X X' and Ky = Y Y' (regression deflation)."""
    comps, kxd, kyd = [], kx.copy(), ky.copy()
    for _ in range(n_comp):
        if np.trace(kyd) < 1e-12 * max(np.trace(ky), 1e-300) or np.trace(kxd) < 1e-12 * max(np.trace(kx), 1e-300):
            break
        u = kyd[:, int(np.argmax(np.diag(kyd)))]
        u = u / max(np.linalg.norm(u), 1e-300)
        t = None
        for _ in range(1000):
            new = kxd @ u
            new = new / max(np.linalg.norm(new), 1e-300)
            u = kyd @ new
            u = u / max(np.linalg.norm(u), 1e-300)
            if t is not None and np.linalg.norm(new - t) < 1e-12:
                t = new
                break
            t = new
        # w = X'u / |X'u| gives t = X w with length |Kx u| / sqrt(u'Kx u)
        wn = np.sqrt(max(u @ kxd @ u, 1e-300))
        t = kxd @ u / wn
        tt = t @ t
        q2 = (t @ kyd @ t) / tt**2  # squared length of the Y weights
        y_score = kyd @ t / tt / max(q2, 1e-300)
        proj = np.eye(len(t)) - np.outer(t, t) / tt
        lift = u / wn
        for prev in reversed(comps):
            p = prev["t"]
            lift = lift - p * (p @ lift) / (p @ p)
        comps.append({"t": t, "u": y_score, "lift": lift, "tt": tt, "pp": (t @ kx @ t) / tt**2})
        kxd, kyd = proj @ kxd @ proj, proj @ kyd @ proj
    return comps


def _centre(k: np.ndarray) -> np.ndarray:
    h = np.eye(len(k)) - 1.0 / len(k)
    return h @ k @ h


def _predictor(kx: np.ndarray, train: np.ndarray, test: np.ndarray, comps: list[dict]) -> np.ndarray:
    """Matrix B with predicted Y[test] = B @ Y[train] (means included), from the components of the centred training samples."""
    n = len(train)
    mean = np.full((len(test), n), 1.0 / n)
    if not comps:
        return mean
    kt = kx[np.ix_(train, train)]
    h = np.eye(n) - 1.0 / n
    cross = (kx[np.ix_(test, train)] - mean @ kt) @ h
    t = np.column_stack([c["t"] for c in comps])
    lift = np.column_stack([c["lift"] for c in comps])
    inner = t.T @ _centre(kt) @ lift  # T'T R-matrix of the deflated weights
    return mean + (cross @ lift) @ np.linalg.solve(inner, t.T @ h)


def _folds(n: int, k: int, seed: int) -> list[np.ndarray]:
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    return [np.sort(f) for f in np.array_split(order, k)]


_STATE = (
    "fold int, n_comp int, press double, total double, x_variance double, y_variance double, orthogonal double, "
    "ssq double, scores array<double>, lift array<double>"
)


def _whole_fit(kx: np.ndarray, ky: np.ndarray, comps: list[dict], n_orthogonal: int, literal: bool) -> Iterator[dict]:
    """Explained variances with one, two, ... components, and each component's vectors."""
    n = len(kx)
    px, py = max(np.trace(kx), 1e-15), max(np.trace(ky), 1e-15)
    kd, removed = kx.copy(), 0.0
    for _ in range(n_orthogonal if comps else 0):
        t0, tt = comps[0]["t"], comps[0]["tt"]
        # scores orthogonal to the response: X w with the predictive part taken out
        o = kd @ t0 if literal else kd @ t0 / tt - t0 * (t0 @ kd @ t0) / tt**2
        o = o - o.mean()
        o = o / (np.linalg.norm(o) + 1e-15)
        removed += float(o @ kd @ o)
        proj = np.eye(n) - np.outer(o, o)
        kd = proj @ kd @ proj
    for c in range(1, len(comps) + 1):
        part = comps[:c]
        t, u, tt = (np.column_stack([x[k] for x in part]) for k in ("t", "u", "tt"))
        tt = tt.ravel()
        inner = t.T @ ky @ t / np.outer(tt, tt)
        fit = np.trace(ky) - 2.0 * sum(u[:, j] @ ky @ t[:, j] / tt[j] for j in range(c)) + np.trace(u.T @ u @ inner)
        yield {
            "n_comp": c, "x_variance": sum(x["tt"] * x["pp"] for x in part) / px, "y_variance": 1.0 - fit / py,
            "orthogonal": removed / px, "ssq": part[-1]["tt"], "scores": part[-1]["t"], "lift": part[-1]["lift"],
        }


def fold_states(xs: DataFrame, ys: DataFrame, max_comp: int, folds: list[np.ndarray], n_orthogonal: int = 2,
                literal_orthogonal: bool = False) -> DataFrame:
    """One row a fold and number of components, of one distributed job; fold -1 is the fit to all samples.

    Standardised blocks become sample inner products, whose rows go to every
    fold; a fold's task fits its components in turn and predicts the samples it left
    out after each. ``press`` is the squared error there (for fold -1: of the
    fit), ``total`` the squares around the mean; fold -1 also has its components' vectors.
    """
    packed = []
    for which, block in (("x", xs), ("y", ys)):
        cells = gram(block).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "g"))).alias("row"))
        packed.append(cells.select(F.lit(which).alias("block"), "i", F.transform("row", lambda c: c["g"]).alias("row")))
    rows = settle(packed[0].unionByName(packed[1]))
    n = rows.agg(F.max("i") + 1).first()[0] or 0
    if n > MAX_SAMPLES:
        raise ValueError(f"{n} samples exceed the {MAX_SAMPLES} of a fold's task")
    tests = [f.tolist() for f in folds]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        fold = int(pdf["fold"].iloc[0])
        pdf = pdf.sort_values("i")
        kx, ky = (_matrix(pdf.loc[pdf["block"] == b, "row"]) for b in "xy")
        kx, ky = (kx + kx.T) / 2.0, (ky + ky.T) / 2.0
        every = np.arange(n)
        test = np.array(tests[fold], int) if fold >= 0 else every
        train = np.setdiff1d(every, test) if fold >= 0 else every
        centred = _centre(kx[np.ix_(train, train)])
        comps = _pls_scores(centred if fold >= 0 else kx, _centre(ky[np.ix_(train, train)]) if fold >= 0 else ky, max_comp)
        whole = list(_whole_fit(kx, ky, comps, n_orthogonal, literal_orthogonal)) if fold < 0 else []
        out = []
        for c in range(1, max_comp + 1):
            err = np.zeros((len(test), n))
            err[np.arange(len(test)), test] = 1.0
            err[:, train] -= _predictor(kx, train, test, comps[:c])
            row = {"fold": fold, "n_comp": c, "press": float(np.trace(err @ ky @ err.T)), "total": float(np.trace(_centre(ky)))}
            out.append(row | (whole[c - 1] if c <= len(whole) else {}))
        return pd.DataFrame(out, columns=[x.split()[0] for x in _STATE.split(", ")]).astype({"fold": int}).replace({np.nan: None})

    dealt = rows.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(-1, len(tests))])))
    return settle(dealt.groupBy("fold").applyInPandas(fit, _STATE))


def component_quality(states: DataFrame) -> DataFrame:
    """``n_comp, q2, r2`` from the rows of :func:`fold_states`, 4 digits."""
    q = F.sum(F.when(F.col("fold") >= 0, F.col("press")))
    r, total = (F.max(F.when(F.col("fold") < 0, F.col(c))) for c in ("press", "total"))
    share = lambda e: F.round(1.0 - e / (total + 1e-15), 4)
    return states.groupBy("n_comp").agg(share(q).alias("q2"), share(r).alias("r2"))


def joint_pls(x: DataFrame, y: DataFrame, n_joint: int | None = None, n_orthogonal: int = 2,
              literal_orthogonal: bool = False, n_folds: int = 5, seed: int = 42, gain: float = 0.02) -> dict:
    """Joint decomposition of two blocks of ``feature_id, vec`` rows.

    Returns DataFrames ``x_variables`` (weights, loadings, vip),
    ``y_variables`` (loadings), ``scores``, ``folds`` and a one-row ``summary``. Without ``n_joint``,
    the last number of components that raises the cross-validated Q2 by more than ``gain`` is taken.
    """
    spark = x.sparkSession
    xs, ys = settle(standardise_vectors(x)), settle(standardise_vectors(y))
    p, q = xs.count(), ys.count()
    n = xs.agg(F.max(F.size("vec"))).first()[0] or 0
    q2, r2, folds, most = [], [], [], n_joint
    if n_joint is None:
        most = min(10, n - 2, p, q + 2, n - n_folds)
        folds = _folds(n, min(n_folds, n), seed) if most >= 2 else []
        most = most if most >= 2 else 1
    states = fold_states(xs, ys, most, folds, n_orthogonal, literal_orthogonal)
    if n_joint is None:
        n_joint = 1
        if folds:
            quality = component_quality(states).orderBy("n_comp").collect()  # one row a number of components
            q2, r2 = [r.q2 for r in quality], [r.r2 for r in quality]
            n_joint = max([1, *(i + 1 for i in range(1, len(q2)) if q2[i] - q2[i - 1] > gain)])
    comps = states.where((F.col("fold") < 0) & (F.col("n_comp") <= n_joint) & F.col("scores").isNotNull()).orderBy("n_comp").collect()
    t = np.column_stack([c.scores for c in comps])
    lift = np.column_stack([c.lift for c in comps])
    tt = np.array([c.ssq for c in comps])

    @F.pandas_udf(ArrayType(DoubleType()))
    def weights(s: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(s) @ lift))

    @F.pandas_udf(ArrayType(DoubleType()))
    def loadings(s: pd.Series) -> pd.Series:
        return pd.Series(list(_matrix(s) @ t / tt))

    ssy = F.array(*[F.lit(float(v)) for v in tt])
    xv = xs.select("feature_id", weights("vec").alias("weights"), loadings("vec").alias("loadings"))
    share = F.aggregate(
        F.zip_with("weights", ssy, lambda w, v: w * w * v), F.lit(0.0), lambda a, b: a + b
    )
    xv = xv.withColumn("vip", F.sqrt(float(p) * share / float(tt.sum())))
    yv = ys.select("feature_id", loadings("vec").alias("loadings"))
    last = comps[-1]
    summary = spark.createDataFrame(
        [(n, p, q, len(comps), n_orthogonal, float(last.x_variance), float(last.y_variance), float(last.orthogonal), q2, r2)],
        "n_samples int, n_x int, n_y int, n_joint int, n_orthogonal int, x_joint_variance double, "
        "y_joint_variance double, orthogonal_variance double, q2 array<double>, r2 array<double>",
    )
    scores = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(t)], "sample_index int, scores array<double>"
    )
    return {"x_variables": xv, "y_variables": yv, "scores": scores, "summary": summary, "folds": states}


def top_loadings(variables: DataFrame, n: int) -> DataFrame:
    """Variables by absolute first loading."""
    first = F.element_at("loadings", 1)
    return variables.withColumn("loading", first).orderBy(F.desc(F.abs(first)), "feature_id").limit(n)
