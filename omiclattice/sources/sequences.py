"""FASTA records and per-species transcription-factor lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from omiclattice.functions.materialise import settle
from omiclattice.functions.ranks import cumulative_counts


def parse_fasta(records: DataFrame, pos: str = "pos") -> DataFrame:
    """``seq_id, sequence`` from text records starting at ``>``.

    The id is the first word; repeated ids get _2, _3 ... in record order
    (``pos`` orders records). Numbering uses range-split counts, so an id
    that repeats millions of times is no single-task job.
    """
    body = F.regexp_replace(F.col("value"), r"^>", "")
    head = F.split(body, r"\r?\n", 2)
    parsed = settle(records.where(F.trim("value") != "").select(
        F.split(F.trim(head[0]), r"\s+")[0].alias("id"),
        F.upper(F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), r"\s+", "")).alias("sequence"),
        F.col(pos).alias("pos"),
    ))
    nth = cumulative_counts(parsed, ["id"], "pos").select("id", "pos", (F.col("below") + 1).alias("nth"))
    return parsed.join(nth, ["id", "pos"]).select(
        F.when(F.col("nth") == 1, F.col("id")).otherwise(F.concat_ws("_", "id", F.col("nth").cast("string"))).alias("seq_id"),
        "sequence",
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, lineSep="\n>").withColumn("pos", F.monotonically_increasing_id())
    return parse_fasta(settle(rows))


def parse_tf_list(lines: DataFrame, families: list[str], min_rows: int = 10) -> DataFrame:
    """``species, tf_id, gene_id, family`` from tab or space separated lists.

    The family column is the one whose words are known families most often;
    species with fewer than min_rows rows or no known family are refused.
    """
    cells = F.split(F.trim("value"), r"\t|\s{2,}|,")
    known = F.array(*[F.lit(f.upper()) for f in families])
    rows = lines.select("species", cells.alias("c")).where(F.size("c") >= 2)
    fam_at = F.array_position(F.transform("c", lambda x: F.array_contains(known, F.upper(x))), True)
    rows = rows.withColumn("at", fam_at)
    best = rows.where("at > 0").groupBy("species", "at").agg(F.count(F.lit(1)).alias("n"))
    best = best.groupBy("species").agg(F.max_by("at", F.struct("n", (-F.col("at")).alias("t"))).alias("col"))
    ok = rows.groupBy("species").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    joined = rows.join(best, "species").join(ok.select("species"), "species")
    return joined.where(F.col("col") <= F.size("c")).select(
        "species", F.element_at("c", 1).alias("tf_id"),
        F.when(F.col("col") > 2, F.element_at("c", 2)).otherwise(F.element_at("c", 1)).alias("gene_id"),
        F.element_at("c", F.col("col").cast("int")).alias("family"),
    ).where(~F.lower("family").isin("family", "tf_family"))


def classification_ids(rows: DataFrame, gene: Column, domain: Column | None = None) -> DataFrame:
    """Hit counts per id, for the id as written and without its .N suffix.

    With ``domain`` only rows whose domain looks like a Pfam accession count.
    """
    d = rows.select(F.trim(gene).alias("raw"), *([domain.alias("dom")] if domain is not None else []))
    if domain is not None:
        d = d.where(F.col("dom").rlike(r"^PF\d+"))
    return (
        d.where("raw <> ''")
        .select(F.explode(F.array("raw", F.regexp_replace("raw", r"\.\d+$", ""))).alias("gene_id"))
        .groupBy("gene_id").agg(F.count(F.lit(1)).alias("hits"))
    )
