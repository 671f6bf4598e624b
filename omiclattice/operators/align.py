"""Sample alignment, grouping and sample metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Words in a sample name that give its tissue, in matching order.
TISSUE_WORDS = {
    "root": ["root", "radicle", "rhiz"],
    "leaf": ["leaf", "leave", "foliar"],
    "stem": ["stem", "culm", "stalk"],
    "flower": ["flower", "blossom", "floral"],
    "fruit": ["fruit", "berry", "pod", "seed"],
    "bark": ["bark", "cortex"],
    "callus": ["callus", "calli"],
}


def sample_key(name: Column) -> Column:
    """Comparable sample name: lower case, one underscore per separator run."""
    return F.rtrim(F.regexp_replace(F.lower(F.trim(name)), r"[\s_\-.]+", "_"), F.lit("_"))


def distinct_samples(df: DataFrame) -> DataFrame:
    return df.select("sample_id").distinct().withColumn("sample_key", sample_key(F.col("sample_id")))


def align_blocks(expr: DataFrame, metab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both blocks on their common samples, renamed to the shared key."""
    e, m = distinct_samples(expr), distinct_samples(metab)
    common = e.select("sample_key").join(m.select("sample_key"), "sample_key", "left_semi").distinct()

    def keep(df):
        keyed = df.withColumn("sample_key", sample_key(F.col("sample_id")))
        return keyed.join(common, "sample_key", "left_semi").select(
            "feature_id", F.col("sample_key").alias("sample_id"), "value"
        )

    return keep(expr), keep(metab)


def alignment_report(**blocks: DataFrame) -> DataFrame:
    """One row per sample key: which blocks have it, and whether all do."""
    parts = None
    for name, df in blocks.items():
        one = distinct_samples(df).select("sample_key", F.lit(name).alias("source")).distinct()
        parts = one if parts is None else parts.unionByName(one)
    seen = parts.groupBy("sample_key").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    return seen.select(
        "sample_key",
        F.array_join("sources", ",").alias("sources"),
        F.when(F.size("sources") == len(blocks), "common").otherwise("dropped").alias("status"),
    )


def group_from_name(name: Column) -> Column:
    """Replicate suffix stripped: Leaf_1 -> Leaf; a name without digits stays."""
    sep = F.regexp_extract(name, r"^(.*)[_\-.]\s*\d+\s*$", 1)
    tail = F.regexp_extract(name, r"^(.+?)[_\-\s]?\d+$", 1)
    return F.when(name.rlike(r"^.*[_\-.]\s*\d+\s*$"), F.trim(sep)).when(
        name.rlike(r"^(.+?)[_\-\s]?\d+$"), F.trim(tail)
    ).otherwise(name)


def infer_groups(samples: DataFrame) -> DataFrame:
    """sample_id -> grp by name; lone names go to other, one group to all."""
    named = samples.select("sample_id").distinct().withColumn("g", group_from_name(F.col("sample_id")))
    sizes = named.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    merged = named.join(sizes, "g").withColumn(
        "grp", F.when(F.col("n") >= 2, F.col("g")).otherwise(F.lit("other"))
    )
    n_groups = merged.agg(F.count_distinct("grp")).scalar()
    n_all = merged.agg(F.count(F.lit(1))).scalar()
    return merged.withColumn("_k", n_groups).withColumn("_n", n_all).select(
        "sample_id",
        F.when((F.col("_k") < 2) | (F.col("_n") < 4), F.lit("all")).otherwise(F.col("grp")).alias("grp"),
    )


def groups_from_metadata(samples: DataFrame, meta: DataFrame) -> DataFrame:
    """First non-blank of condition, tissue, treatment; names as the fallback."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    given = samples.select("sample_id").distinct().join(
        meta.select("sample_id", F.coalesce(blank("condition"), blank("tissue"), blank("treatment")).alias("given")),
        "sample_id", "left",
    )
    usable = given.agg(F.count_distinct("given")).scalar()
    by_name = infer_groups(samples).withColumnRenamed("grp", "by_name")
    return given.join(by_name, "sample_id").withColumn("_k", usable).select(
        "sample_id", F.when(F.col("_k") >= 2, F.col("given")).otherwise(F.col("by_name")).alias("grp")
    ).where(F.col("grp").isNotNull())


def tissue_of(name: Column, words: dict[str, list[str]] = TISSUE_WORDS) -> Column:
    """First tissue whose keyword occurs in the sample name."""
    low = F.lower(name)
    out = F.lit("unknown")
    for tissue, keys in reversed(list(words.items())):
        out = F.when(low.rlike("|".join(keys)), F.lit(tissue)).otherwise(out)
    return out


def split_sample_id(df: DataFrame, pattern: str = r"^([A-Za-z0-9]+)\.([A-Za-z0-9]+)\.([A-Za-z0-9]+)\.(\d+)$") -> DataFrame:
    """block.genotype.treatment.replicate sample ids into columns."""
    c = F.col("sample_id")
    names = ["block", "genotype", "treatment", "replicate"]
    return df.where(c.rlike(pattern)).select(
        "*", *[F.regexp_extract(c, pattern, i + 1).alias(n) for i, n in enumerate(names)]
    )


def collapse_replicates(df: DataFrame) -> DataFrame:
    """Mean of duplicate cells (repeat injections, repeated names)."""
    return df.groupBy("feature_id", "sample_id").agg(F.avg("value").alias("value"))


def pair_blocks(expr: DataFrame, metab: DataFrame, max_missing: float = 0.2) -> DataFrame:
    """Collapsed cells of both blocks on paired samples, sparse features dropped."""
    a = collapse_replicates(expr).withColumn("block", F.lit("expr"))
    b = collapse_replicates(metab).withColumn("block", F.lit("metab"))
    both = a.unionByName(b)
    paired = (
        both.select("block", "sample_id").distinct().groupBy("sample_id")
        .agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("sample_id")
    )
    kept = both.join(paired, "sample_id", "left_semi")
    total = paired.agg(F.count(F.lit(1))).scalar()
    dense_enough = (
        kept.groupBy("block", "feature_id").agg(F.count("value").alias("n"))
        .withColumn("total", total)
        .where(1.0 - F.col("n") / F.col("total") <= max_missing)
    )
    return kept.join(dense_enough.select("block", "feature_id"), ["block", "feature_id"], "left_semi").select(
        "block", "feature_id", "sample_id", "value"
    )
