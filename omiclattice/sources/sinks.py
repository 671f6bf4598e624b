"""Output tables. Every sink is an ordinary distributed write."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from omiclattice.operators.evidence import DIMENSIONS


def candidate_table(fused: DataFrame) -> DataFrame:
    """One row per candidate with its three leading evidence sources."""
    pairs = F.array_compact(F.array(*[
        F.when(F.col(d) > 0, F.struct((-F.col(d)).alias("s"), F.lit(d).alias("d"))) for d in DIMENSIONS
    ]))
    top = F.transform(F.slice(F.array_sort(pairs), 1, 3), lambda x: x["d"])
    return fused.select(
        "gene_id", "level", "calibrated_score", F.size("evidence").alias("n_evidence"), F.array_join(top, ", ").alias("top_sources")
    )


def evidence_table(fused: DataFrame) -> DataFrame:
    return fused.select("gene_id", F.explode("evidence").alias("e")).select(
        "gene_id", "e.source", F.round("e.raw", 4).alias("score"), F.round("e.contribution", 4).alias("contribution")
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    w.csv(path, header=True) if fmt == "csv" else w.format(fmt).save(path)


def write_matrix(long: DataFrame, path: str, samples: list[str]) -> None:
    """Wide CSV of a block; the sample columns are given, so no extra pass."""
    wide = long.groupBy("feature_id").pivot("sample_id", samples).agg(F.min("value"))
    wide.write.mode("overwrite").csv(path, header=True)


def write_snapshot(blocks: DataFrame, path: str) -> None:
    """Session snapshot: a new upload replaces its own block only."""
    (
        blocks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("session_id", "block").parquet(path)
    )


def write_tf_lists(rows: DataFrame, path: str) -> None:
    """Per-species lists: species in the input replace their old rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("species").parquet(path)


def report_digest(steps: dict[str, DataFrame]) -> DataFrame:
    """One row per step from one-row statistics, as JSON text."""
    out = None
    for name, df in steps.items():
        row = df.limit(1).select(F.lit(name).alias("step"), F.to_json(F.struct(*df.columns)).alias("stats"))
        out = row if out is None else out.unionByName(row)
    return out
