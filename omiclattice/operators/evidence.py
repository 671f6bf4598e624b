"""Evidence fusion, contradictions, hypotheses and run confidence.

Inputs are one row per gene with up to eight scores in [0, 1] (NULL = no
evidence). Everything is a row-wise expression, so a table of any size is one
narrow pass without a shuffle; only hypothesis bookkeeping groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from omiclattice.functions.scalars import at_least, round_half_up

DIMENSIONS = [
    "correlation", "module_membership", "motif", "pathway", "tf_prior", "tissue", "ortholog", "literature",
]

# Weights and thresholds of the scoring policies.
POLICIES = {
    "default": {
        "correlation": 0.15, "module_membership": 0.10, "motif": 0.08, "pathway": 0.15,
        "tf_prior": 0.15, "tissue": 0.10, "ortholog": 0.10, "literature": 0.10,
    },
    "balanced": {
        "correlation": 0.15, "module_membership": 0.10, "motif": 0.08, "pathway": 0.15,
        "tf_prior": 0.15, "tissue": 0.10, "ortholog": 0.10, "literature": 0.15,
    },
    "motif_focused": {
        "correlation": 0.10, "module_membership": 0.05, "motif": 0.35, "pathway": 0.20,
        "tf_prior": 0.10, "tissue": 0.10, "ortholog": 0.10, "literature": 0.10,
    },
    "prior_knowledge_focused": {
        "correlation": 0.10, "module_membership": 0.05, "motif": 0.10, "pathway": 0.20,
        "tf_prior": 0.30, "tissue": 0.10, "ortholog": 0.15, "literature": 0.10,
    },
    "expression_only": {
        "correlation": 0.40, "module_membership": 0.30, "motif": 0.10, "pathway": 0.10,
        "tf_prior": 0.05, "tissue": 0.05, "ortholog": 0.0, "literature": 0.10,
    },
    "strict": {
        "correlation": 0.10, "module_membership": 0.05, "motif": 0.25, "pathway": 0.25,
        "tf_prior": 0.10, "tissue": 0.10, "ortholog": 0.15, "literature": 0.10,
    },
}
GOLD, SILVER, MIN_SOURCES, BONUS = 0.70, 0.40, 2, 0.10
STRICT = {"gold": 0.80, "silver": 0.50, "min_sources": 3}

# Importance tier of an evidence source (1 where not listed).
TIERS = {
    "motif": 5, "pathway": 4, "tf_prior": 3, "ortholog": 3, "tissue": 2, "correlation": 2,
    "module_membership": 1,
}

# Weights of the plausibility dimensions.
PLAUSIBILITY = {"tf_prior": 0.25, "pathway": 0.25, "tissue": 0.20, "ortholog": 0.15, "motif": 0.15}

# Weights of the simple candidate score.
CANDIDATE = {
    "correlation": 0.15, "module_membership": 0.20, "motif": 0.10, "pathway": 0.15,
    "tissue": 0.05, "literature": 0.15, "ortholog": 0.05,
}
CANDIDATE_PLAUSIBILITY = 0.15


def _sum(arr, field) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, e: a + e[field])


def evidence_list(policy: str = "default") -> Column:
    """Active evidence as structs: source, raw, norm, weight, contribution, tier."""
    w = POLICIES[policy]
    items = [
        F.when(F.col(d) > 0, F.struct(
            F.lit(d).alias("source"), F.col(d).cast("double").alias("raw"),
            F.least(F.col(d), F.lit(1.0)).alias("norm"), F.lit(w[d]).alias("weight"),
            (F.least(F.col(d), F.lit(1.0)) * F.lit(w[d])).alias("contribution"),
            F.lit(TIERS.get(d, 1)).alias("tier"),
        ))
        for d in DIMENSIONS
    ]
    return F.array_compact(F.array(*items))


def _summary() -> dict[str, Column]:
    """Plain sums over the active dimensions, as scalar columns."""
    on = {d: F.coalesce(F.col(d) > 0, F.lit(False)) for d in DIMENSIONS}
    norm = {d: F.when(on[d], F.least(F.col(d), F.lit(1.0))).otherwise(0.0) for d in DIMENSIONS}
    count = lambda conds: sum(c.cast("int") for c in conds)
    return {
        "_n": count(on.values()),
        "_s1": sum(norm.values()),
        "_s2": sum(v * v for v in norm.values()),
        "n_sources": count(norm[d] >= 0.20 for d in DIMENSIONS),
        "_strong": count(on[d] & (F.col(d) >= 0.30) for d in DIMENSIONS),
    }


def contradictions(n_active: Column, n_strong: Column, plausibility: Column) -> Column:
    """Broken consistency rules as structs: pattern, level, penalty."""
    # Rule names, thresholds and penalties below.
    v = {d: F.coalesce(F.col(d), F.lit(0.0)) for d in DIMENSIONS}
    flag = lambda cond, name, level, penalty: F.when(cond, F.struct(
        F.lit(name).alias("pattern"), F.lit(level).alias("level"), F.lit(penalty).alias("penalty")
    ))
    return F.array_compact(F.array(
        flag((v["correlation"] >= 0.70) & (v["motif"] < 0.20), "high_correlation_no_motif", "high", 0.20),
        flag((v["tf_prior"] >= 0.70) & (v["tissue"] < 0.25), "high_prior_wrong_tissue", "medium", 0.15),
        flag((v["pathway"] >= 0.60) & (v["correlation"] < 0.30) & (v["module_membership"] < 0.30),
             "pathway_no_upstream", "medium", 0.10),
        flag((v["ortholog"] >= 0.70) & (v["pathway"] < 0.30) & (v["tf_prior"] < 0.30),
             "strong_ortholog_wrong_path", "low", 0.05),
        flag((v["module_membership"] >= 0.70) & (v["correlation"] < 0.20), "high_module_low_corr", "low", 0.05),
        flag((plausibility == "plausible") & (n_active > 0) & (n_strong < 2), "plausible_but_no_evidence", "medium", 0.10),
    ))


def top_sources(evidence: Column, n: int = 5) -> Column:
    """Leading sources by tier, then contribution."""
    order = F.array_sort(F.transform(evidence, lambda e: F.struct(
        (-e["tier"]).alias("t"), (-F.round(e["contribution"], 12)).alias("c"), e["source"].alias("source")
    )))
    return F.transform(F.slice(order, 1, n), lambda e: e["source"])


def fuse(genes: DataFrame, policy: str = "default", plausibility: str | None = None) -> DataFrame:
    """Fused score, contradictions, calibrated score and level per gene."""
    strict = policy == "strict"
    gold = STRICT["gold"] if strict else GOLD
    silver = STRICT["silver"] if strict else SILVER
    need = STRICT["min_sources"] if strict else MIN_SOURCES
    weights = POLICIES[policy]
    plaus = F.coalesce(F.col(plausibility), F.lit("")) if plausibility else F.lit("")
    d = genes.withColumns(_summary())
    active = lambda dim: F.coalesce(F.col(dim) > 0, F.lit(False))
    wsum = sum(F.when(active(dim), F.lit(w)).otherwise(0.0) for dim, w in weights.items())
    csum = sum(F.when(active(dim), F.least(F.col(dim), F.lit(1.0)) * F.lit(w)).otherwise(0.0) for dim, w in weights.items())
    n = F.col("_n")
    var = F.greatest(F.col("_s2") / n - F.col("_s1") / n * (F.col("_s1") / n), F.lit(0.0))
    d = d.withColumns({
        "_raw": F.when(wsum > 0, csum / wsum).otherwise(0.0),
        "convergence": F.when(n >= 2, round_half_up(F.greatest(1.0 - var * 3.0, F.lit(0.0)), 3)).otherwise(0.0),
        "diversity": F.least(F.col("n_sources") / 7.0, F.lit(1.0)),
        "evidence": evidence_list(policy),
        "contradictions": contradictions(n, F.col("_strong"), plaus),
    })
    penalty = F.least(_sum(F.col("contradictions"), "penalty"), F.col("_raw") * 0.4)
    s = F.col("_raw") - penalty
    s = F.when(F.col("n_sources") < need, s * F.col("n_sources") / need).otherwise(s)
    s = s + F.when((F.col("convergence") >= 0.70) & (F.col("n_sources") >= 2), F.col("convergence") * BONUS).otherwise(0.0)
    d = d.withColumn("_cal", F.when(n == 0, 0.0).otherwise(F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0))))
    c = F.col("_cal")
    level = (
        F.when(n == 0, "None").when(at_least(c, gold) & (F.col("n_sources") >= need), "Gold")
        .when(at_least(c, silver), "Silver").when(at_least(c, 0.10), "Weak").otherwise("None")
    )
    return d.withColumns({
        "raw_score": round_half_up(F.col("_raw"), 4), "calibrated_score": round_half_up(c, 4), "level": level,
    }).drop("_raw", "_cal", "_n", "_s1", "_s2", "_strong")


def plausibility(genes: DataFrame) -> DataFrame:
    """Mean of the available reasoning dimensions plus a convergence bonus."""
    have = lambda d: F.when(F.col(d).isNotNull(), F.lit(PLAUSIBILITY[d])).otherwise(0.0)
    total = sum(have(d) for d in PLAUSIBILITY)
    fused = sum(F.coalesce(F.col(d), F.lit(0.0)) * F.lit(w) for d, w in PLAUSIBILITY.items()) / total
    high = sum(F.coalesce((F.col(d) >= 0.5).cast("int"), F.lit(0)) for d in PLAUSIBILITY)
    bonus = F.when(high >= 2, F.least(high * 0.03, F.lit(0.12))).when((high >= 1) & (fused >= 0.5), 0.02).otherwise(0.0)
    out = genes.withColumn("_t", total).withColumn("_b", F.when(total > 0, bonus).otherwise(0.0)).withColumn(
        "_f", F.when(total > 0, F.least(fused + bonus, F.lit(1.0))).otherwise(0.0)
    )
    return out.withColumn("plausibility_score", round_half_up(F.col("_f"), 3)).withColumn("convergence_bonus", round_half_up(F.col("_b"), 3)).withColumn(
        "plausibility",
        F.when(F.col("_t") == 0, "unknown").when(at_least(F.col("_f"), 0.70), "plausible")
        .when(at_least(F.col("_f"), 0.40), "weak").otherwise("unlikely"),
    ).drop("_t", "_b", "_f")


def candidate_score(genes: DataFrame, plaus: str = "plausibility") -> DataFrame:
    """Plain weighted candidate score with its level."""
    s = sum(F.coalesce(F.col(d), F.lit(0.0)) * F.lit(w) for d, w in CANDIDATE.items())
    p = F.when(F.col(plaus) == "plausible", 1.0).when(F.col(plaus) == "weak", 0.5).otherwise(0.0)
    out = genes.withColumn("confidence_score", F.least(s + p * CANDIDATE_PLAUSIBILITY, F.lit(1.0)))
    c = F.col("confidence_score")
    return out.withColumn("confidence_level", F.when(c >= 0.70, "Gold").when(c >= 0.40, "Silver").otherwise("Weak"))


def pathway_position(upstream_ratio: Column, coexpression: Column, bottleneck: Column) -> Column:
    """0.4 x upstream + 0.3 x bottleneck + 0.15; neutral 0.5 where unknown."""
    up = F.least(F.coalesce(upstream_ratio, F.lit(0.5)), F.lit(1.0))
    up = F.when(coexpression.isNotNull(), (up + coexpression) / 2.0).otherwise(up)
    neck = F.when(bottleneck.isNull(), 0.5).when(bottleneck, 0.8).otherwise(0.3)
    return 0.4 * up + 0.3 * neck + 0.15


def literature_score(n_papers: Column) -> Column:
    return F.least(n_papers / 3.0, F.lit(1.0)) * 0.8


def assemble(**parts: DataFrame) -> DataFrame:
    """One row per gene from per-dimension score tables (gene_id, score).

    The tables are stacked and pivoted with one aggregation instead of a
    chain of outer joins.
    """
    rows = None
    for name, df in parts.items():
        one = df.select("gene_id", F.lit(name).alias("dim"), F.col("score").cast("double").alias("score"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("gene_id").agg(*[
        F.max(F.when(F.col("dim") == d, F.col("score"))).alias(d) for d in DIMENSIONS if d in parts
    ])


def keep_candidates(genes: DataFrame) -> DataFrame:
    """Correlation at least 0.50 or motif at least 0.30."""
    return genes.where((F.coalesce("correlation", F.lit(0.0)) >= 0.50) | (F.coalesce("motif", F.lit(0.0)) >= 0.30))


def exclusion_reasons(fused: DataFrame, profile: DataFrame) -> DataFrame:
    """Why candidates are dropped: isolated evidence, contradictions, noisy or
    near-absent expression. ``profile``: gene_id, n, mean, sd (population)."""
    cv = F.col("sd") / (F.abs("mean") + 1e-10)
    serious = F.transform(
        F.filter("contradictions", lambda c: c["level"].isin("high", "medium")), lambda c: c["pattern"]
    )
    enough = F.coalesce(F.col("n") >= 3, F.lit(False))
    own = F.array_compact(F.array(
        F.when(F.col("n_sources") < 2, F.lit("isolated_evidence")),
        F.when(enough & (cv > 1.5), F.lit("unstable_expression")),
        F.when(enough & (F.col("mean") < 0.1), F.lit("very_low_expression")),
    ))
    return fused.join(profile, "gene_id", "left").withColumn("reasons", F.concat(own, serious)).withColumn(
        "excluded", F.size("reasons") > 0
    )


def score_matrix(fused: DataFrame) -> DataFrame:
    """gene x dimension scores with the overall score."""
    return fused.select(
        "gene_id", *[F.round(F.when(F.col(d) > 0, F.least(F.col(d), F.lit(1.0))), 4).alias(d) for d in DIMENSIONS],
        F.col("calibrated_score").alias("overall"),
    )


def shortlist(fused: DataFrame, n: int = 20) -> DataFrame:
    """Top candidates by calibrated score."""
    return fused.orderBy(F.desc("calibrated_score"), "gene_id").limit(n).select("gene_id", "calibrated_score", "level")


def level_counts(fused: DataFrame) -> DataFrame:
    return fused.agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("level") == "Gold").alias("n_gold"),
        F.count_if(F.col("level") == "Silver").alias("n_silver"),
    )


def run_confidence(d: DataFrame) -> DataFrame:
    """Overall confidence from counts: n_candidates, n_high, n_sources,
    n_contradictions, convergence, data_quality, n_samples."""
    c = F.when(F.col("n_candidates") >= 10, 0.20).when(F.col("n_candidates") >= 3, 0.15).when(F.col("n_candidates") >= 1, 0.08).otherwise(0.0)
    c = F.least(c + F.when(F.col("n_high") >= 1, 0.10).otherwise(0.0), F.lit(0.30))
    s = (
        c + F.least(F.col("n_sources") * 0.06, F.lit(0.30)) + F.col("convergence") * 0.15
        - F.least(F.col("n_contradictions") * 0.05, F.lit(0.15)) + F.col("data_quality") * 0.10
    )
    s = F.when(F.col("n_samples") < 4, s * 0.5).when(F.col("n_samples") < 10, s * 0.8).otherwise(s)
    s = F.greatest(F.least(s, F.lit(1.0)), F.lit(0.0))
    return d.withColumn("_s", s).withColumn("overall_score", round_half_up(F.col("_s"), 3)).withColumn(
        "label", F.when(at_least(F.col("_s"), 0.70), "high").when(at_least(F.col("_s"), 0.40), "moderate")
        .when(at_least(F.col("_s"), 0.10), "low").otherwise("unreliable"),
    ).drop("_s")


# --- mechanisms and hypotheses ------------------------------------------------------
def mechanism_scores(m: DataFrame) -> DataFrame:
    """Mechanism probabilities per metabolite.

    Columns: cv, n_samples, n_stress (associations), is_developmental,
    n_precursors, transport_mode (NULL when none), has_expression,
    has_promoter.
    """
    zero = F.lit(0.0)
    s = {
        "technical_artifact": F.when((F.col("cv") < 0.1) & (F.col("n_samples") >= 3), 0.7)
        .when((F.col("cv") < 0.2) & (F.col("n_samples") >= 3), 0.4),
        "cell_composition_change": F.lit(0.15),
        "stress_response": F.when(F.col("n_stress") > 0, F.least(F.col("n_stress") * 0.15, F.lit(0.5))).otherwise(0.1),
        "developmental": F.when(F.col("is_developmental"), 0.4).otherwise(0.1),
        "precursor_limitation": F.when(F.col("n_precursors") > 0, 0.3),
        "transport": F.when(F.coalesce(F.col("transport_mode") != "unknown", F.lit(False)), 0.3),
        "enzymatic": F.lit(0.2),
    }
    other = F.greatest(*[F.coalesce(c, zero) for c in s.values()], zero)
    t = 0.15 + F.when(F.col("has_expression"), 0.1).otherwise(0.0) + F.when(F.col("has_promoter"), 0.1).otherwise(0.0)
    t = t + F.when(F.col("has_expression") & F.col("has_promoter"), 0.1).otherwise(0.0)
    t = F.when(other >= 0.30, t * 0.6).when(other >= 0.15, t * 0.8).otherwise(t)
    s["transcriptional"] = F.when(F.col("has_expression"), F.least(t, F.lit(0.5))).otherwise(0.05)
    items = F.array_compact(F.array(*[
        F.when(c.isNotNull(), F.struct(F.lit(i).alias("pos"), F.lit(k).alias("mechanism"), c.alias("score")))
        for i, (k, c) in enumerate(s.items())
    ]))
    d = m.withColumn("_i", items).withColumn("_t", F.greatest(F.aggregate("_i", F.lit(0.0), lambda a, e: a + e["score"]), F.lit(1.0)))
    d = d.withColumn("_p", F.transform("_i", lambda e: F.struct(
        (-round_half_up(e["score"] / F.col("_t"), 3)).alias("np"), e["pos"].alias("pos"), e["mechanism"].alias("mechanism")
    )))
    top = F.array_min("_p")
    d = d.withColumn("primary", top["mechanism"]).withColumn("top_probability", -top["np"]).withColumn(
        "probabilities", F.map_from_entries(F.transform("_p", lambda e: F.struct(e["mechanism"], -e["np"])))
    )
    p = F.col("top_probability")
    return d.withColumn("uncertainty", F.when(p < 0.3, "high").when(p < 0.5, "moderate").otherwise("low")).drop("_i", "_t", "_p")


def _record(hyp, role, kind, score, relation, severity=None):
    return F.struct(
        F.lit(hyp).alias("hypothesis"), F.lit(role).alias("role"), F.lit(kind).alias("kind"),
        F.lit(score).cast("double").alias("score"), F.lit(relation).alias("relation"),
        F.lit(severity).cast("string").alias("severity"),
    )


def competing_hypotheses(m: DataFrame, key: str = "metabolite") -> DataFrame:
    """Initial evidence rows of up to four hypotheses per metabolite.

    Columns: has_transcriptional, n_stress, transport_mode, n_precursors.
    """
    stress, trans, prec = F.col("n_stress") > 0, F.col("transport_mode").isNotNull(), F.col("n_precursors") > 0
    rows = [
        F.when(F.col("has_transcriptional"), _record("H1", "support", "transcriptional_evidence", 0.4, "supports"))
        .otherwise(_record("H1", "contradiction", "transcriptional_evidence", 0.0, "contradicts")),
        F.when(stress, _record("H2", "support", "stress_association", 0.5, "supports")),
        F.when(stress, _record("H2", "missing", "stress_marker_expression", 0.0, "missing")),
        F.when(trans, _record("H3", "support", "transport_evidence", 0.3, "conditionally_supports")),
        F.when(trans, _record("H3", "missing", "transporter_expression", 0.0, "missing")),
        F.when(trans, _record("H3", "missing", "tissue_accumulation", 0.0, "missing")),
        F.when(prec, _record("H4", "support", "precursor_pathway", 0.2, "conditionally_supports")),
        F.when(prec, _record("H4", "missing", "precursor_abundance", 0.0, "missing")),
    ]
    return m.select(key, F.explode(F.array_compact(F.array(*rows))).alias("r")).select(key, "r.*")


# Mechanism of each hypothesis.
MECHANISM_OF = {
    "H1": "transcriptional", "H2": "stress_response", "H3": "transport", "H4": "precursor_limitation",
}


def falsify(evidence: DataFrame, context: DataFrame, regulators: DataFrame, data_genes: DataFrame,
            key: str = "metabolite") -> DataFrame:
    """Append the rows that speak against each hypothesis with regulators.

    ``context``: key, n_samples, tissues (array), species. ``regulators``:
    key, hypothesis, gene_id. ``evidence`` may carry ``species_scope``;
    causal gaps are ``role='gap'`` rows.
    """
    scope = F.col("species_scope") if "species_scope" in evidence.columns else F.lit(None).cast("string")
    ev = evidence.withColumn("species_scope", scope)
    found = regulators.join(data_genes.select("gene_id").distinct().withColumn("_in", F.lit(1)), "gene_id", "left")
    heads = found.groupBy(key, "hypothesis").agg(F.count("_in").alias("n_found"))
    has_data = data_genes.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    sums = ev.groupBy(key, "hypothesis").agg(F.count_if(F.col("role") == "support").alias("n_support"))
    h = heads.join(sums, [key, "hypothesis"], "left").join(context, key, "left").withColumn("_d", has_data)
    n_sup = F.coalesce("n_support", F.lit(0))
    mech = F.col("hypothesis") == "H1"
    rec = lambda cond, kind, relation, sev=None: F.when(cond, F.struct(
        F.lit("contradiction").alias("role"), F.lit(kind).alias("kind"), F.lit(0.0).alias("score"),
        F.lit(relation).alias("relation"), F.lit(sev).cast("string").alias("severity"),
    ))
    rows = F.array_compact(F.array(
        rec(F.col("_d") & (F.col("n_found") == 0), "expression_check", "contradicts"),
        rec(F.col("n_samples") < 6, "sample_size_check", "insufficient", "low"),
        rec(n_sup < 2, "evidence_diversity_check", "contradicts"),
        rec(mech & (F.size("tissues") > 0), "tissue_mismatch_check", "context_dependent", "low"),
    ))
    own = h.select(key, "hypothesis", F.explode(rows).alias("r")).select(key, "hypothesis", "r.*")
    attacked = heads.select(key, "hypothesis")
    species = (
        ev.where((F.col("role") == "support") & F.col("species_scope").isNotNull() & (F.col("species_scope") != ""))
        .join(context.select(key, "species"), key).where((F.col("species") != "") & (F.col("species_scope") != F.col("species")))
        .join(attacked, [key, "hypothesis"], "left_semi")
        .select(key, "hypothesis", F.lit("contradiction").alias("role"), F.lit("species_mismatch_check").alias("kind"),
                F.lit(0.0).alias("score"), F.lit("species_limited").alias("relation"), F.lit("medium").alias("severity"))
    )
    gaps = ev.where("role = 'gap'").join(attacked, [key, "hypothesis"], "left_semi").select(
        key, "hypothesis", F.lit("contradiction").alias("role"), F.lit("causal_gap_check").alias("kind"),
        F.lit(0.0).alias("score"), F.lit("insufficient").alias("relation"), F.lit("high").alias("severity"),
    )
    return ev.drop("species_scope").unionByName(own).unionByName(species).unionByName(gaps)


def consistency(n_pathway_genes: Column) -> Column:
    """Upstream coordination of a transcriptional hypothesis."""
    return F.when(n_pathway_genes.isNull() | (n_pathway_genes == 0), "missing").when(
        n_pathway_genes < 2, "contradiction"
    ).otherwise("ok")


def proposed_tests(hypotheses: DataFrame) -> DataFrame:
    """Falsification experiments per transcriptional hypothesis."""
    t = lambda name, feasible: F.struct(F.lit(name).alias("test"), F.lit(feasible).alias("feasibility"))
    return hypotheses.where("hypothesis = 'H1'").select(
        "*", F.explode(F.array(t("TF_knockout_prediction", "low"), t("temporal_consistency", "medium"))).alias("t")
    ).select("*", "t.test", "t.feasibility").drop("t")


def rank_hypotheses(evidence: DataFrame, key: str = "metabolite") -> DataFrame:
    """Support share minus 0.2 per high-severity contradiction (at most 0.6)."""
    g = evidence.groupBy(key, "hypothesis").agg(
        F.count_if(F.col("role") == "support").alias("n_support"),
        F.count_if(F.col("role") == "contradiction").alias("n_contradict"),
        F.count_if(F.col("role") == "missing").alias("n_missing"),
        F.count_if((F.col("role") == "contradiction") & (F.col("severity") == "high")).alias("n_high"),
    )
    total = F.col("n_support") + F.col("n_contradict") + F.col("n_missing")
    score = F.greatest(F.col("n_support") / F.greatest(total, F.lit(1)) - F.least(F.col("n_high") * 0.2, F.lit(0.6)), F.lit(0.0))
    uncertain = F.when((F.col("n_contradict") >= F.col("n_support")) & (F.col("n_support") > 0), "high").otherwise("moderate")
    w = W.partitionBy(key).orderBy(F.desc("score"), "hypothesis")
    return g.withColumn("score", score).withColumn("uncertainty", uncertain).withColumn("rank", F.row_number().over(w))


# --- roll-up scoring -----------------------------------------------------------------
def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.8, "B").when(score >= 0.7, "C").when(score >= 0.5, "D").otherwise("F")


def weighted_rollup(tests: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean test score per dimension, weighted sum and letter grade."""
    mean = tests.groupBy("dimension").agg(F.avg("score").alias("score")).join(weights, "dimension")
    return mean.agg(F.sum(F.col("score") * F.col("weight")).alias("overall"), F.count(F.lit(1)).alias("n_dimensions")).withColumn(
        "grade", grade(F.col("overall"))
    )


def recall_scores(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Per case: share of expected items retrieved, and whether all were.

    Both sides: case_id, item. One join and one aggregation; no item list is
    gathered.
    """
    e = expected.select("case_id", "item").distinct()
    r = retrieved.select("case_id", "item").distinct().withColumn("_hit", F.lit(1))
    return e.join(r, ["case_id", "item"], "left").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_expected"), F.count("_hit").alias("n_found")
    ).withColumn("recall", F.col("n_found") / F.col("n_expected")).withColumn("complete", F.col("n_found") == F.col("n_expected"))


# --- wording ---------------------------------------------------------------------------
def verb_choice(validated: Column, n_sources: Column, max_corr: Column, has_motif: Column, has_literature: Column) -> Column:
    """Verb that the evidence allows."""
    return (
        F.when(validated, "regulates")
        .when((n_sources >= 3) & has_motif & has_literature, "is a candidate regulator of")
        .when((n_sources >= 2) & (max_corr >= 0.70), "is associated with")
        .otherwise("correlates with")
    )
