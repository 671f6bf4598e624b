"""The whole study as an ordered list of DataFrame steps.

Each step's table is written once under ``out`` and later steps read it back,
so a failed run resumes from finished tables and lineage stays short. The
only decisions on the driver are the quality gate and the chosen power.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from omiclattice.operators import align, clean, corr, enrich, evidence as ev, network, stats
from omiclattice.sources.sinks import report_digest


def run_analysis(
    expr: DataFrame, metab: DataFrame, groups: DataFrame, out: str, members: DataFrame | None = None,
    target: str = "", min_abs_r: float = 0.8, alpha: float = 0.05, with_modules: bool = True,
) -> dict[str, DataFrame]:
    """Differential tests, integration, enrichment and fused candidates.

    ``members``: set_id, feature_id pathway table (optional). Stops after the
    gate with only its report when a hard issue is found.
    """
    spark = expr.sparkSession
    done: dict[str, DataFrame] = {}

    def step(name: str, df: DataFrame) -> DataFrame:
        path = f"{out}/{name}"
        df.write.mode("overwrite").parquet(path)
        done[name] = spark.read.parquet(path)
        return done[name]

    e, m = align.align_blocks(expr, metab)
    e, m = step("expression", e), step("metabolites", m)
    g = step("groups", groups.select(align.sample_key(F.col("sample_id")).alias("sample_id"), "grp"))
    gate = step("quality", clean.quality_gate(e, m, target))
    if not gate.first()["passed"]:
        return done

    kind = clean.infer_data_type(e).first()["data_type"]
    loge = step("log_expression", clean.log_counts(e) if kind == "count" else clean.log_fpkm(e))
    logm = step("log_metabolites", clean.log_fpkm(m))
    deg = step("deg", stats.deg_multigroup(loge, g, alpha))
    dam = step("dam", stats.deg_multigroup(logm, g, alpha))
    step("dam_pairs", stats.dam_pairwise(logm, g, alpha))

    axis = clean.sample_list(loge)
    ev_e = clean.to_vectors(clean.impute_mean(loge), axis)
    ev_m = clean.to_vectors(clean.impute_mean(logm), axis)
    ue, um = step("unit_expression", corr.unit_vectors(ev_e, "bicor")), step("unit_metabolites", corr.unit_vectors(ev_m, "bicor"))
    pairs = step("pairs", corr.correlation_screen(ue, um, min_abs_r, alpha))
    edges = pairs.select(F.col("feature_a").alias("src"), F.col("feature_b").alias("dst"), F.abs("r").alias("weight"))
    nodes = ue.select("feature_id").unionByName(um.select("feature_id"))
    step("hubs", network.hubs(edges, nodes))
    step("communities", network.components(edges, nodes))

    best = pairs.groupBy(F.col("feature_a").alias("gene_id")).agg(F.max(F.abs("r")).alias("score"))
    parts = {"correlation": best}
    if members is not None:
        hits = deg.where("is_fdr_sig").select("feature_id")
        sets = step("enrichment", enrich.over_representation(hits, members, deg.select("feature_id")))
        good = members.join(sets.select("set_id", "p_value"), "set_id").groupBy(F.col("feature_id").alias("gene_id")).agg(
            (1.0 - F.min("p_value")).alias("score")
        )
        parts["pathway"] = good
    if with_modules:
        run = network.coexpression(loge)
        step("modules", run["modules"])
        kme = step("membership", run["membership"])
        parts["module_membership"] = kme.select(F.col("feature_id").alias("gene_id"), F.greatest("kme", F.lit(0.0)).alias("score"))
    table = ev.assemble(**parts)
    missing = [d for d in ev.DIMENSIONS if d not in parts]
    table = table.select("*", *[F.lit(None).cast("double").alias(d) for d in missing])
    fused = step("candidates", ev.fuse(table))
    step("shortlist", ev.shortlist(fused))
    summary = {
        "quality": gate,
        "deg": deg.agg(F.count(F.lit(1)).alias("n_tested"), F.count_if("is_fdr_sig").alias("n_significant")),
        "dam": dam.agg(F.count(F.lit(1)).alias("n_tested"), F.count_if("is_fdr_sig").alias("n_significant")),
        "pairs": pairs.agg(F.count(F.lit(1)).alias("n_pairs")),
        "candidates": ev.level_counts(fused),
    }
    step("digest", report_digest(summary))
    return done
