"""Missing values, filters, quality gates and normalisation on long tables.

All operators take and return the long form ``feature_id, sample_id, value``
where NULL (or an absent row) is a missing cell. Per-feature statistics are
grouped and joined back instead of windowed, so one hot feature does not have
to fit into one task; Spark broadcasts or skew-splits the join at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from omiclattice.functions.materialise import settle
from omiclattice.functions.ranks import cumulative_counts, exact_quantile, global_median

# Texts that mean "no value".
MISSING_TOKENS = ["", "na", "nan", "null", "none", "-", "inf"]

# Stress marker families, in matching order.
STRESS_MARKERS = [
    "HSF", "HSP", "DREB", "ERF", "WRKY", "NAC", "LEA", "PR1", "PR2",
    "PAL", "CHS", "LOX", "AOS", "CAT", "SOD", "APX", "GPX", "GST",
    "P5CS", "NCED", "ZEP", "ABA", "RD29", "COR", "KIN",
]

# Words that mark a transporter id.
TRANSPORTER_KEYWORDS = [
    "ABC", "MATE", "NRT", "PTR", "PDR", "NIP", "TIP", "PIP",
    "transporter", "carrier", "efflux", "influx", "export",
    "DTX", "MFS", "AMT", "SULTR", "ZIP",
]


def parse_number(text: Column) -> Column:
    """Text to double; missing tokens, NaN and infinities become NULL."""
    token = F.lower(F.trim(text))
    v = token.try_cast("double")
    return F.when(
        token.isin(MISSING_TOKENS) | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), None
    ).otherwise(v)


def n_samples(df: DataFrame) -> Column:
    """Distinct samples of a block as a scalar column."""
    return df.agg(F.count_distinct("sample_id")).scalar()


def n_features(df: DataFrame) -> Column:
    return df.agg(F.count_distinct("feature_id")).scalar()


def sample_list(df: DataFrame) -> Column:
    """Sorted sample ids as a scalar array: the column axis of the matrix."""
    return df.agg(F.sort_array(F.collect_set("sample_id"))).scalar()


def with_stats(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """Attach grouped aggregates to every row."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]), keys)


def to_vectors(df: DataFrame, samples: Column | None = None) -> DataFrame:
    """Long form to ``feature_id, vec`` in sorted sample order (NULL = missing).

    A row holds one value per matrix column. A repeated cell counts with the
    mean of its values. Cells and axis are sorted together, so that a cell
    stands just before its place in the axis.
    """
    axis = samples if samples is not None else sample_list(df)
    cells = df.groupBy("feature_id", "sample_id").agg(F.avg("value").alias("value"))
    packed = cells.groupBy("feature_id").agg(
        F.collect_list(F.struct("sample_id", F.lit(0).alias("place"), "value")).alias("_m")
    )
    places = F.transform("_axis", lambda s: F.struct(s.alias("sample_id"), F.lit(1).alias("place"), F.lit(None).cast("double").alias("value")))
    both = packed.withColumn("_axis", axis).select("feature_id", F.sort_array(F.concat("_m", places)).alias("_all"))

    def cell(x: Column, i: Column) -> Column:
        before = F.get("_all", i - 1)
        return F.struct(x["place"].alias("place"), F.when((before["sample_id"] == x["sample_id"]) & (before["place"] == 0), before["value"]).alias("value"))

    met = F.filter(F.transform("_all", cell), lambda x: x["place"] == 1)
    return both.select("feature_id", F.transform(met, lambda x: x["value"]).alias("vec"))


def densify(df: DataFrame) -> DataFrame:
    """Every feature x sample cell of the block, absent ones with NULL; repeated cells are averaged."""
    samples = df.select("sample_id").distinct()
    names = df.select("feature_id").distinct().withColumn("_axis", samples.agg(F.collect_set("sample_id")).scalar())
    grid = names.select("feature_id", F.explode("_axis").alias("sample_id"))
    cells = df.groupBy("feature_id", "sample_id").agg(F.avg("value").alias("value"))
    return grid.join(cells, ["feature_id", "sample_id"], "left")


# --- filters and flags ----------------------------------------------------
def feature_profile(df: DataFrame) -> DataFrame:
    """One row per feature with the counts every filter below needs."""
    v = F.col("value")
    return (
        df.groupBy("feature_id")
        .agg(
            F.count(v).alias("n_values"),
            F.count_if(v > 0).alias("n_positive"),
            F.sum(v).alias("total"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("sd"),
        )
        .withColumn("n_samples", n_samples(df))
        .withColumn("missing_rate", 1.0 - F.col("n_values") / F.col("n_samples"))
    )


def filter_low_expression(
    df: DataFrame, min_mean: float = 1.0, min_present: float = 0.5, mean_over: str = "present"
) -> DataFrame:
    """Keep features present (>0) often enough with a high enough mean.

    The mean divides by the number of positive values, or by all samples with
    ``mean_over='all'``.
    """
    prof = feature_profile(df)
    denom = F.greatest(
        F.col("n_positive") if mean_over == "present" else F.col("n_samples"), F.lit(1)
    )
    keep = prof.where(
        (F.col("n_positive") / F.greatest("n_samples", F.lit(1)) >= min_present)
        & (F.coalesce(F.col("total"), F.lit(0.0)) / denom >= min_mean)
    )
    return df.join(keep.select("feature_id"), "feature_id", "left_semi")


def filter_na_ratio(df: DataFrame, max_na_ratio: float = 0.8) -> DataFrame:
    keep = feature_profile(df).where(F.col("missing_rate") <= max_na_ratio)
    return df.join(keep.select("feature_id"), "feature_id", "left_semi")


def expression_flags(df: DataFrame, min_mean: float = 1.0, min_detected: int = 2) -> DataFrame:
    """Low-expression, low-detection and all-missing flags per feature."""
    return feature_profile(df).select(
        "feature_id",
        F.coalesce(F.col("mean") < min_mean, F.lit(False)).alias("low_expression"),
        (F.col("n_positive") < min_detected).alias("low_detection"),
        (F.col("n_values") == 0).alias("all_missing"),
    )


def duplicate_cells(df: DataFrame) -> DataFrame:
    """Cells that occur more than once."""
    return (
        df.groupBy("feature_id", "sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )


def feature_missingness(df: DataFrame, limit: float = 0.5) -> DataFrame:
    return feature_profile(df).select(
        "feature_id",
        F.round("missing_rate", 4).alias("missing_rate"),
        (F.col("missing_rate") > limit).alias("is_high"),
    )


def sample_missingness(df: DataFrame, limit: float = 0.3) -> DataFrame:
    rate = 1.0 - F.col("n_values") / F.col("n_features")
    return (
        df.groupBy("sample_id")
        .agg(F.count("value").alias("n_values"))
        .withColumn("n_features", n_features(df))
        .select("sample_id", F.round(rate, 4).alias("missing_rate"), (rate > limit).alias("is_high"))
    )


def matrix_integrity(df: DataFrame) -> DataFrame:
    """One row: sample count, constant and mostly missing samples, verdict."""
    cols = (
        df.groupBy("sample_id")
        .agg(F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
        .withColumn("nf", n_features(df))
    )
    out = cols.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("sd") == 0).alias("n_zero_variance"),
        F.count_if(1.0 - F.col("n") / F.col("nf") > 0.5).alias("n_high_missing"),
    )
    return out.withColumn(
        "all_passed",
        (F.col("n_samples") >= 3) & (F.col("n_zero_variance") == 0) & (F.col("n_high_missing") <= 5),
    )


def validate_block(df: DataFrame) -> DataFrame:
    """One row of counts: features, samples, id clashes by case, missing, infinite."""
    per = df.groupBy("feature_id").agg(
        F.count_if(F.col("value").isNotNull() & (F.abs("value") != float("inf"))).alias("ok"),
        F.count_if(F.abs("value") == float("inf")).alias("inf"),
    )
    return (
        per.agg(
            F.count(F.lit(1)).alias("n_features"),
            (F.count(F.lit(1)) - F.count_distinct(F.lower("feature_id"))).alias("n_duplicate_ids"),
            F.sum("ok").alias("_ok"),
            F.sum("inf").alias("n_infinite"),
        )
        .withColumn("n_samples", n_samples(df))
        .withColumn("n_missing", F.col("n_features") * F.col("n_samples") - F.col("_ok") - F.col("n_infinite"))
        .withColumn("passed", F.col("n_samples") >= 3)
        .drop("_ok")
    )


def quality_gate(expr: DataFrame, metab: DataFrame, target: str = "") -> DataFrame:
    """One row: hard and soft data-quality issues before the analysis.

    Hard issues stop the run: fewer than three samples or common samples.
    """
    miss = feature_profile(expr).agg(
        F.round(F.avg("missing_rate"), 4).alias("avg_missing_rate"),
        F.count(F.lit(1)).alias("n_genes"),
        F.first("n_samples").alias("n_samples"),
    )
    common = (
        expr.select("sample_id").distinct()
        .join(metab.select("sample_id").distinct(), "sample_id", "left_semi")
        .agg(F.count(F.lit(1)))
        .scalar()
    )
    found = metab.agg(
        F.coalesce(F.bool_or(F.contains(F.lower("feature_id"), F.lit(target.lower()))), F.lit(False))
    ).scalar()
    out = miss.withColumn("common_samples", common).withColumn("target_found", found)
    issues = F.array_compact(F.array(
        F.when(F.col("n_samples") < 3, F.lit("too_few_samples")),
        F.when(F.col("common_samples") < 3, F.lit("too_few_common_samples")),
        F.when(F.col("avg_missing_rate") > 0.3, F.lit("high_missing_rate")),
        F.when(F.col("n_genes") < 100, F.lit("few_genes")),
        F.when(~F.col("target_found"), F.lit("target_not_found")),
    ))
    hard = F.array(F.lit("too_few_samples"), F.lit("too_few_common_samples"))
    return out.withColumn("issues", issues).withColumn(
        "passed", F.size(F.array_intersect("issues", hard)) == 0
    )


def name_matches(name: Column, target: str) -> Column:
    """Case-insensitive containment in either direction."""
    t = F.lit(target.lower().replace("-", "_").replace(" ", "_"))
    n = F.lower(name)
    return F.contains(n, t) | F.contains(t, n)


def target_signal(metab: DataFrame, target: str) -> DataFrame:
    """Coefficient of variation and verdict for each metabolite matching a name."""
    hit = metab.where(name_matches(F.col("feature_id"), target))
    stat = hit.groupBy("feature_id").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")
    )
    cv = F.when(F.abs("m") > 1e-10, F.col("s") / F.col("m")).otherwise(0.0)
    return stat.withColumn("cv", cv).select(
        "feature_id", "n", "cv",
        F.when(F.col("n") < 3, "too_few_values")
        .when(F.col("cv") > 0.3, "strong")
        .when(F.col("cv") > 0.1, "limited")
        .otherwise("flat").alias("signal"),
        ((F.col("n") >= 3) & (F.col("cv") > 0.1)).alias("validated"),
    )


def pick_target(metab: DataFrame) -> DataFrame:
    """The metabolite with the highest coefficient of variation."""
    stat = metab.groupBy("feature_id").agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s")
    )
    return (
        stat.where("n >= 2 AND m > 0")
        .select("feature_id", (F.col("s") / F.col("m")).alias("cv"))
        .orderBy(F.desc("cv"), "feature_id")
        .limit(1)
    )


def top_variance(df: DataFrame, n: int = 60) -> DataFrame:
    """The n most variable features (population variance)."""
    return (
        df.groupBy("feature_id").agg(F.var_pop("value").alias("variance"))
        .where(F.col("variance").isNotNull())
        .orderBy(F.desc("variance"), "feature_id")
        .limit(n)
    )


def drop_low_effect(df: DataFrame, effect: str = "effect_size", q: float = 0.1) -> DataFrame:
    """Drop tests below the q quantile of effect. Whether to filter is the caller's choice at any size."""
    df = settle(df)
    cut = exact_quantile(df, [], effect, q).scalar()
    return df.withColumn("_cut", F.greatest(cut, F.lit(1e-6))).where(F.col(effect) >= F.col("_cut")).drop("_cut")


def infer_data_type(df: DataFrame) -> DataFrame:
    """count or fpkm from the exact median of all cells (> 50 means counts)."""
    med = exact_quantile(df, [], "value", 0.5, "matrix_median")
    return med.withColumn(
        "data_type", F.when(F.col("matrix_median") > 50, "count").otherwise("fpkm")
    )


def infer_scale(df: DataFrame) -> DataFrame:
    """Co-expression variant: median and maximum of the positive cells."""
    pos = df.where("value > 0")
    med = exact_quantile(pos, [], "value", 0.5, "positive_median")
    return med.withColumn("positive_max", pos.agg(F.max("value")).scalar()).withColumn(
        "scale",
        F.when(F.col("positive_median") > 50, "count")
        .when(F.col("positive_max") <= 30, "already_log")
        .otherwise("linear"),
    )


def stress_markers(df: DataFrame, markers: list[str] = STRESS_MARKERS) -> DataFrame:
    """Mean and variation of features named after a stress family.

    The first family of the list that occurs in the id wins.
    """
    up = F.upper("feature_id")
    family = F.coalesce(*[F.when(F.contains(up, F.lit(m.upper())), F.lit(m)) for m in markers])
    stat = (
        df.withColumn("marker", family).where(F.col("marker").isNotNull())
        .groupBy("feature_id", "marker")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("s"))
    )
    return stat.select(
        "feature_id", "marker", "mean",
        (F.col("s") / (F.abs("mean") + 1e-10)).alias("cv"),
    )


def stress_verdict(markers: DataFrame) -> DataFrame:
    """strong when at least three markers vary with CV > 0.5."""
    return markers.agg(
        F.count(F.lit(1)).alias("n_markers"), F.count_if(F.col("cv") > 0.5).alias("n_variable")
    ).withColumn("is_strong", F.col("n_variable") >= 3)


def keyword_features(df: DataFrame, keywords: list[str] = TRANSPORTER_KEYWORDS) -> DataFrame:
    """Features whose id contains any keyword (transporters and the like)."""
    pattern = "(?i)" + "|".join(keywords)
    return df.select("feature_id").where(F.col("feature_id").rlike(pattern)).distinct()


def feasibility(n_samples_: Column, has_expr: Column, has_metab: Column, min_corr: int = 4) -> Column:
    """Rating of a study from its sample count and the blocks it has."""
    return (
        F.when(n_samples_ < 3, "infeasible")
        .when(n_samples_ < min_corr, "limited")
        .when(~has_expr | ~has_metab, "partial")
        .otherwise("feasible")
    )


def group_feasibility(df: DataFrame, groups: DataFrame) -> DataFrame:
    """exploratory when fewer than 5 samples or any group below 3."""
    sizes = (
        df.select("sample_id").distinct().join(groups, "sample_id")
        .groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    )
    return sizes.agg(
        F.sum("n").alias("n_total"), F.min("n").alias("min_group"), F.count(F.lit(1)).alias("n_groups")
    ).withColumn(
        "feasibility",
        F.when((F.col("n_total") < 5) | (F.col("min_group") < 3), "exploratory").otherwise("standard"),
    )


# --- imputation and normalisation ----------------------------------------
def impute_mean(df: DataFrame) -> DataFrame:
    """Fill every missing cell with the feature mean (6 digits, 0 if none)."""
    dense = densify(df)
    cells = df.groupBy("feature_id", "sample_id").agg(F.avg("value").alias("value"))
    means = cells.groupBy("feature_id").agg(F.avg("value").alias("_mean"))
    return dense.join(means, "feature_id").select(
        "feature_id", "sample_id",
        F.coalesce("value", F.round("_mean", 6), F.lit(0.0)).alias("value"),
    )


def impute_zero(df: DataFrame) -> DataFrame:
    return densify(df).fillna(0.0, ["value"])


def log2_transform(df: DataFrame, pseudo_count: float = 1.0) -> DataFrame:
    # greatest() would turn a missing cell into 0
    v = F.when(F.col("value").isNotNull(), F.greatest("value", F.lit(0.0)))
    return df.withColumn("value", F.round(F.log2(v + pseudo_count), 6))


def z_score(df: DataFrame) -> DataFrame:
    d = with_stats(df, ["feature_id"], _m=F.avg("value"), _v=F.var_pop("value"))
    z = (F.col("value") - F.col("_m")) / F.sqrt(F.greatest("_v", F.lit(1e-10)))
    return d.select("feature_id", "sample_id", z.alias("value"))


def min_max(df: DataFrame) -> DataFrame:
    d = with_stats(df, ["feature_id"], _lo=F.min("value"), _hi=F.max("value"))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-10))
    return d.select("feature_id", "sample_id", ((F.col("value") - F.col("_lo")) / span).alias("value"))


def quantile_normalise(df: DataFrame) -> DataFrame:
    """Give every sample the same distribution: mean over samples per rank.

    Ties take the mean of the reference values they cover. A sample holds all
    features, so positions come from the range-split counts; a value shared
    by very many features is cut into pieces that go to different tasks.
    """
    piece = 100_000
    cc = cumulative_counts(df, ["sample_id"], "value")
    cut = cc.select(
        "sample_id", "value", "below", "cnt",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("cnt") - 1) / piece))).alias("part"),
    ).repartition("sample_id", "value", "part")
    start = F.col("below") + F.col("part") * piece
    stop = F.least(start + piece, F.col("below") + F.col("cnt"))
    spots = cut.select("sample_id", "value", F.explode(F.sequence(start + 1, stop)).alias("pos"))
    reference = spots.groupBy("pos").agg(F.avg("value").alias("ref"))
    mapped = (
        spots.join(reference, "pos").groupBy("sample_id", "value").agg(F.avg("ref").alias("normalised"))
    )
    return df.join(mapped, ["sample_id", "value"]).select(
        "feature_id", "sample_id", F.col("normalised").alias("value")
    )


def size_factors(counts: DataFrame) -> DataFrame:
    """Median-of-ratios factor per sample (mean 1); 1 where none can be had.

    Only features positive in every sample count. The median of a sample runs
    over all features, hence the range-split exact quantile.
    """
    counts = settle(counts)
    total = n_samples(counts)
    full = (
        counts.where("value > 0").groupBy("feature_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.avg(F.ln("value")).alias("_lg"))
        .withColumn("_total", total)
        .where("_n = _total").select("feature_id", "_lg")
    )
    ratios = counts.join(full, "feature_id").withColumn("ratio", F.col("value") / F.exp("_lg"))
    med = exact_quantile(ratios, ["sample_id"], "ratio", 0.5, "raw")
    mean = med.where("raw > 0").agg(F.avg("raw")).scalar()
    raw = counts.select("sample_id").distinct().join(med, "sample_id", "left")
    return raw.withColumn("_mean", mean).select(
        "sample_id",
        F.when(F.col("raw") > 0, F.col("raw") / F.col("_mean")).otherwise(F.lit(1.0)).alias("size_factor"),
    )


def log_counts(counts: DataFrame) -> DataFrame:
    """log2(count / size factor + 1)."""
    counts = settle(counts)
    return counts.join(size_factors(counts), "sample_id").select(
        "feature_id", "sample_id", F.log2(F.col("value") / F.col("size_factor") + 1.0).alias("value")
    )


def log_fpkm(df: DataFrame) -> DataFrame:
    return df.select("feature_id", "sample_id", F.log2(F.col("value") + 1e-6).alias("value"))


def column_standardise(df: DataFrame) -> DataFrame:
    """Centre and scale each feature over samples (ddof 1, tiny sd counts as 1)."""
    d = with_stats(df, ["feature_id"], _m=F.avg("value"), _s=F.stddev_samp("value"))
    sd = F.when(F.col("_s") < 1e-10, 1.0).otherwise(F.col("_s"))
    return d.select("feature_id", "sample_id", ((F.col("value") - F.col("_m")) / sd).alias("value"))


def preprocess(expr: DataFrame, method: str = "log2", fill: str = "mean",
               min_mean: float = 0.5) -> DataFrame:
    """Impute, drop low features, normalise: the usual first chain."""
    filled = expr.transform(impute_mean if fill == "mean" else impute_zero)
    kept = filled.transform(filter_low_expression, min_mean)
    steps = {"log2": log2_transform, "zscore": z_score, "minmax": min_max, "none": lambda d: d}
    return kept.transform(steps[method])


def heatmap_values(df: DataFrame, top: int = 60) -> DataFrame:
    """Row z-scores of the most variable features: the cells of a heat map."""
    chosen = top_variance(df, top).select("feature_id")
    return z_score(df.join(chosen, "feature_id", "left_semi"))
