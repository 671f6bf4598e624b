"""Exact order statistics that never gather one big group into one task.

A group (a sample, a test family, the whole table) may hold a third of all
rows, so ranks, quantiles and Benjamini-Hochberg values work on pre-aggregated
``(keys, value) -> count`` rows. Where the largest group is small (its size is
checked) one window per group does; beyond that the groups are split by value
range, and only the per-bucket totals (at most ``buckets`` rows per group) see
a window over the whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from omiclattice.functions.materialise import settle

_MIN_BUCKETS = 8
SMALL_GROUP = 200_000  # distinct values one task may sort in one window


def _bucket_count(df: DataFrame) -> int:
    """One bucket per shuffle partition: a group spreads over the cluster."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(_MIN_BUCKETS, min(n, 4096))


def _locate(bounds: Column, value: Column, n: int) -> Column:
    """Number of sorted bounds below ``value``, by binary search."""
    steps, s = [], 1
    while s <= n:
        steps.append(s)
        s *= 2
    return F.aggregate(
        F.array(*[F.lit(x) for x in reversed(steps)]),
        F.lit(0),
        lambda pos, step: F.when(F.get(bounds, pos + step - 1) < value, pos + step).otherwise(pos),
    )


def _positions(df: DataFrame, keys: list[str], value: str, buckets: int | None,
               small_group: int) -> tuple[DataFrame, list[str], bool]:
    group = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    distinct = settle(
        src.where(F.col(value).isNotNull())
        .groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    largest = distinct.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    ordered = W.partitionBy(*group).orderBy(value)
    if buckets is None and largest <= small_group:
        out = distinct.withColumn(
            "below", F.coalesce(F.sum("cnt").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ).withColumn("total", F.sum("cnt").over(W.partitionBy(*group)))
        return out.withColumn("_bucket", F.lit(0)), group, False
    n = buckets or _bucket_count(df)
    bounds = distinct.agg(
        F.percentile_approx(value, [i / n for i in range(1, n)], 100 * n).alias("b")
    ).scalar()
    placed = distinct.withColumn("_bounds", bounds)
    placed = placed.withColumn(
        "_bucket", _locate(F.col("_bounds"), F.col(value), n)
    ).drop("_bounds")
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*group, "_bucket")
        .agg(F.sum("cnt").alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("total", F.sum("_n").over(W.partitionBy(*group)))
        .drop("_n")
    )
    inside = (
        W.partitionBy(*group, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    )
    out = (
        placed.join(offsets, group + ["_bucket"])
        .withColumn("below", F.col("_off") + F.sum("cnt").over(inside) - F.col("cnt"))
        .drop("_off")
    )
    return out, group, True


def cumulative_counts(
    df: DataFrame, keys: list[str], value: str, buckets: int | None = None,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Distinct values per group with their counts and exact positions.

    Returns ``keys, value, cnt, below, total, _bucket`` where ``below`` is the
    number of rows of the group with a smaller value. NULL values are skipped.
    Giving ``buckets`` forces the range-split form.
    """
    return _positions(df, keys, value, buckets, small_group)[0]


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str = "rnk") -> DataFrame:
    """Tie-averaged 1-based ranks of ``value`` inside each group."""
    cc = cumulative_counts(df, keys, value)
    ranks = cc.select(
        *keys, value, (F.col("below") + (F.col("cnt") + 1) / 2.0).alias(out)
    )
    return df.join(ranks, keys + [value], "left")


def exact_quantile(
    df: DataFrame, keys: list[str], value: str, q: float, out: str = "quantile"
) -> DataFrame:
    """Exact linear-interpolation quantile per group (one row per group)."""
    cc = cumulative_counts(df, keys, value)
    h = (F.col("total") - 1) * F.lit(q)
    lo, hi = F.floor(h), F.ceil(h)
    covers = lambda pos: (F.col("below") <= pos) & (pos < F.col("below") + F.col("cnt"))
    group = keys or ["_all"]
    res = (
        cc.where(covers(lo) | covers(hi))
        .groupBy(*group)
        .agg(
            F.max(F.when(covers(lo), F.col(value))).alias("_lo"),
            F.max(F.when(covers(hi), F.col(value))).alias("_hi"),
            F.max(h - lo).alias("_w"),
        )
        .withColumn(out, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w"))
    )
    return res.select(*keys, out)


def global_median(df: DataFrame, value: str) -> Column:
    """Exact median of a whole column as a scalar-subquery column."""
    return exact_quantile(df, [], value, 0.5, "m").scalar()


def _mostly_distinct(df: DataFrame, scope: list[str], p: str, small_group: int) -> bool:
    """Whether a group is too large for one window and hardly a value is repeated, so that values are as many as rows."""
    rows = df.where(F.col(p).isNotNull())
    if (rows.groupBy(*scope).count().agg(F.max("count")).first()[0] or 0) <= small_group:
        return False
    n, values = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*scope, p), 0.02)).first()
    return values >= 0.9 * n


def _bh_of_rows(df: DataFrame, p: str, scope: list[str], out: str, n_tests: Column | None) -> DataFrame:
    """Step-up q values of rows whose values hardly repeat: rows are range-split and moved once, their values once more."""
    n = _bucket_count(df)
    group = scope or ["_all"]
    src = df if scope else df.withColumn("_all", F.lit(0))
    some = src.where(F.col(p).isNotNull())
    bounds = some.agg(F.percentile_approx(p, [i / n for i in range(1, n)], 100 * n).alias("b")).first()["b"]
    place = _locate(F.array(*[F.lit(float(b)) for b in bounds]), F.col(p), len(bounds))
    part = W.partitionBy(*group, "_bucket")
    whole = W.partitionBy(*group)
    offsets = settle(
        some.groupBy(*group, place.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(whole.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_total", F.sum("_n").over(whole)).drop("_n"))

    def raw(rows: DataFrame) -> DataFrame:
        rank = F.count(F.lit(1)).over(part.orderBy(p).rangeBetween(W.unboundedPreceding, W.currentRow))
        ranked = rows.withColumn("_bucket", place).withColumn("_rank", rank).join(F.broadcast(offsets), group + ["_bucket"])
        total = n_tests if n_tests is not None else F.col("_total")
        return ranked.withColumn("_tests", total).withColumn("_raw", F.col(p) * F.col("_tests") / (F.col("_off") + F.col("_rank")))

    later = whole.orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    tails = settle(
        raw(some.select(*group, p)).groupBy(*group, "_bucket").agg(F.min("_raw").alias("_bmin"))
        .withColumn("_after", F.min("_bmin").over(later)).drop("_bmin"))
    desc = part.orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    found = raw(some).withColumn("_q", F.min("_raw").over(desc)).join(F.broadcast(tails), group + ["_bucket"])
    done = found.select(*df.columns, F.least(F.lit(1.0), "_q", "_after").alias(out))
    return done.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def benjamini_hochberg(
    df: DataFrame, p: str, scope: list[str] | None = None, out: str = "q_value",
    n_tests: Column | None = None, buckets: int | None = None, small_group: int = SMALL_GROUP,
) -> DataFrame:
    """Step-up q values ``min_{j>=i} p_j * n / j`` inside each scope.

    Ties share one row of the pre-aggregate, later buckets contribute through
    their minimum, so a scope of any size is split over all tasks. Where values hardly
    repeat, rows are ranked themselves instead of meeting a pre-aggregate as large as they are.
    ``n_tests`` gives the number of tests when only the smallest p values
    were kept; ranks among those are still true ranks.
    """
    scope = scope or []
    df = settle(df)
    if buckets is None and _mostly_distinct(df, scope, p, small_group):
        return _bh_of_rows(df, p, scope, out, n_tests)
    cc, group, split = _positions(df, scope, p, buckets, small_group)
    if n_tests is not None:
        cc = cc.withColumn("total", n_tests)
    cc = cc.withColumn("_raw", F.col(p) * F.col("total") / (F.col("below") + F.col("cnt")))
    part = group + ["_bucket"] if split else group
    desc = W.partitionBy(*part).orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    if split:
        later = W.partitionBy(*group).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
        tails = (
            cc.groupBy(*group, "_bucket")
            .agg(F.min("_raw").alias("_bmin"))
            .withColumn("_after", F.min("_bmin").over(later))
            .drop("_bmin")
        )
        cc = cc.join(tails, group + ["_bucket"])
    else:
        cc = cc.withColumn("_after", F.lit(1.0))
    q = cc.withColumn(
        out, F.least(F.lit(1.0), F.min("_raw").over(desc), F.col("_after"))
    ).select(*scope, p, out)
    return df.join(q, scope + [p], "left")
