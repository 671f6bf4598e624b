"""Queries for evidence fusion, hypotheses and knowledge lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from omiclattice.functions.materialise import settle
from omiclattice.operators import evidence as ev, knowledge as kn, network
from omiclattice.plans.matrix_queries import R
from omiclattice.plans.registry import query
from omiclattice.plans.views import EXPR, expr, table
from omiclattice.sources import sequences as sq

# one candidate per part: scores spread over [0, 1] from its attributes
_MULT = {"correlation": 37, "module_membership": 53, "motif": 71, "pathway": 29, "tf_prior": 83, "tissue": 41, "ortholog": 67, "literature": 59}
_GENES = "genes AS (SELECT 'P' || p_partkey AS gene_id, " + ", ".join(
    f"CASE WHEN (p_partkey + {m}) % 5 = 0 THEN 0 ELSE ((p_partkey * {m} + p_size) % 101) / 100.0 END::DOUBLE AS {d}" for d, m in _MULT.items()
) + ", CASE p_size % 3 WHEN 0 THEN 'plausible' WHEN 1 THEN 'weak' END AS plausibility FROM part)"


def candidates(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    score = lambda m: F.when((k + m) % 5 == 0, 0.0).otherwise(((k * m + F.col("p_size")) % 101) / 100.0)
    return p.select(
        F.concat(F.lit("P"), k.cast("string")).alias("gene_id"), *[score(m).alias(d) for d, m in _MULT.items()],
        F.when(F.col("p_size") % 3 == 0, "plausible").when(F.col("p_size") % 3 == 1, "weak").alias("plausibility"),
    )


def _fuse_sql(policy="default", plaus="coalesce(plausibility, '')"):
    w = ev.POLICIES[policy]
    strict = policy == "strict"
    gold, silver, need = (0.8, 0.5, 3) if strict else (0.7, 0.4, 2)
    rows = " UNION ALL ".join(
        f"SELECT gene_id, '{d}' AS source, {d} AS raw, {w[d]}::DOUBLE AS w, {ev.TIERS.get(d, 1)} AS tier FROM genes WHERE {d} > 0" for d in ev.DIMENSIONS
    )
    return f"""WITH {_GENES}, e AS ({rows}), a AS (SELECT gene_id, count(*) AS n, CASE WHEN sum(w) > 0 THEN sum(least(raw, 1) * w) / sum(w) ELSE 0 END AS raw_fused,
    CASE WHEN count(*) >= 2 THEN round(greatest(0, 1 - var_pop(least(raw, 1)) * 3) + 1e-9, 3) ELSE 0 END AS convergence,
    count(*) FILTER (raw >= 0.2) AS n_sources, count(*) FILTER (raw >= 0.3) AS n_strong FROM e GROUP BY 1),
  c AS (SELECT genes.*, coalesce(n, 0) AS n, coalesce(raw_fused, 0) AS rf, coalesce(convergence, 0) AS convergence, coalesce(n_sources, 0) AS n_sources, coalesce(n_strong, 0) AS n_strong,
    correlation >= 0.7 AND motif < 0.2 AS c1, tf_prior >= 0.7 AND tissue < 0.25 AS c2, pathway >= 0.6 AND correlation < 0.3 AND module_membership < 0.3 AS c3,
    ortholog >= 0.7 AND pathway < 0.3 AND tf_prior < 0.3 AS c4, module_membership >= 0.7 AND correlation < 0.2 AS c5,
    {plaus} = 'plausible' AND coalesce(n, 0) > 0 AND coalesce(n_strong, 0) < 2 AS c6 FROM genes LEFT JOIN a USING (gene_id)),
  p AS (SELECT *, c1::INT + c2::INT + c3::INT + c4::INT + c5::INT + c6::INT AS n_contradictions,
    least(c1::INT * 0.2::DOUBLE + c2::INT * 0.15::DOUBLE + c3::INT * 0.1::DOUBLE + c4::INT * 0.05::DOUBLE + c5::INT * 0.05::DOUBLE + c6::INT * 0.1::DOUBLE, rf * 0.4) AS pen FROM c),
  s AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE greatest(least((rf - pen) * CASE WHEN n_sources < {need} THEN n_sources / {need} ELSE 1 END
    + CASE WHEN convergence >= 0.7 AND n_sources >= 2 THEN convergence * 0.1 ELSE 0 END, 1), 0) END AS cal FROM p),
  fz AS (SELECT *, CASE WHEN n = 0 THEN 'None' WHEN cal >= {gold} - 1e-9 AND n_sources >= {need} THEN 'Gold' WHEN cal >= {silver} - 1e-9 THEN 'Silver' WHEN cal >= 0.1 - 1e-9 THEN 'Weak' ELSE 'None' END AS level FROM s)"""


def _fused_out(df):
    return df.select(
        "gene_id", "raw_score", "calibrated_score", "level",
        "convergence", "n_sources", F.size("contradictions").alias("n_contradictions"),
    )


_OUT = " SELECT gene_id, round(rf + 1e-9, 4)::DOUBLE AS raw_score, round(cal + 1e-9, 4)::DOUBLE AS calibrated_score, level, convergence::DOUBLE AS convergence, n_sources, n_contradictions FROM fz"


def _register_fusion(name, policy):
    @query(name, _fuse_sql(policy) + _OUT)
    def run(spark, sf):
        return _fused_out(ev.fuse(candidates(spark, sf), policy, "plausibility"))


for _name in ev.POLICIES:
    _register_fusion("fuse_evidence" if _name == "default" else f"fuse_evidence_{_name}", _name)


@query("contradiction_flags", _fuse_sql() + """ SELECT pattern, level, count(*) AS n FROM (SELECT unnest([
  CASE WHEN c1 THEN 'high_correlation_no_motif' END, CASE WHEN c2 THEN 'high_prior_wrong_tissue' END, CASE WHEN c3 THEN 'pathway_no_upstream' END,
  CASE WHEN c4 THEN 'strong_ortholog_wrong_path' END, CASE WHEN c5 THEN 'high_module_low_corr' END, CASE WHEN c6 THEN 'plausible_but_no_evidence' END]) AS pattern,
  unnest(['high', 'medium', 'medium', 'low', 'low', 'medium']) AS level FROM fz) WHERE pattern IS NOT NULL GROUP BY 1, 2""")
def contradiction_flags(spark, sf):
    f = ev.fuse(candidates(spark, sf), plausibility="plausibility")
    return f.select(F.explode("contradictions").alias("c")).groupBy("c.pattern", "c.level").agg(F.count(F.lit(1)).alias("n"))


_TIERROWS = " UNION ALL ".join(
    f"SELECT gene_id, '{d}' AS source, {ev.TIERS.get(d, 1)} AS tier, round(least({d}, 1) * {ev.POLICIES['default'][d]}::DOUBLE, 12) AS c FROM genes WHERE {d} > 0" for d in ev.DIMENSIONS
)


@query("evidence_hierarchy", f"""WITH {_GENES}, e AS ({_TIERROWS}), r AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY tier DESC, c DESC, source) AS rk FROM e)
  SELECT gene_id, string_agg(source, ',' ORDER BY rk) FILTER (rk <= 2) AS leading, count(*) AS n FROM r GROUP BY 1""")
def evidence_hierarchy(spark, sf):
    d = candidates(spark, sf).withColumn("evidence", ev.evidence_list())
    d = d.where(F.size("evidence") > 0)
    return d.select("gene_id", F.array_join(ev.top_sources(F.col("evidence"), 2), ",").alias("leading"), F.size("evidence").cast("bigint").alias("n"))


@query("plausibility", f"""WITH {_GENES}, g AS (SELECT gene_id, tf_prior, pathway, CASE WHEN tissue > 0 THEN tissue END AS tissue, CASE WHEN ortholog > 0 THEN ortholog END AS ortholog, motif FROM genes),
  t AS (SELECT *, 0.25::DOUBLE + 0.25 + CASE WHEN tissue IS NULL THEN 0 ELSE 0.2::DOUBLE END + CASE WHEN ortholog IS NULL THEN 0 ELSE 0.15::DOUBLE END + 0.15::DOUBLE AS w,
    (tf_prior >= 0.5)::INT + (pathway >= 0.5)::INT + coalesce((tissue >= 0.5)::INT, 0) + coalesce((ortholog >= 0.5)::INT, 0) + (motif >= 0.5)::INT AS hi FROM g),
  f AS (SELECT *, (tf_prior * 0.25::DOUBLE + pathway * 0.25::DOUBLE + coalesce(tissue, 0) * 0.2::DOUBLE + coalesce(ortholog, 0) * 0.15::DOUBLE + motif * 0.15::DOUBLE) / w AS f0 FROM t),
  b AS (SELECT *, least(f0 + CASE WHEN hi >= 2 THEN least(hi * 0.03::DOUBLE, 0.12) WHEN hi >= 1 AND f0 >= 0.5 THEN 0.02 ELSE 0 END, 1) AS f1 FROM f)
  SELECT gene_id, round(f1 + 1e-9, 3) AS plausibility_score, CASE WHEN f1 >= 0.7 - 1e-9 THEN 'plausible' WHEN f1 >= 0.4 - 1e-9 THEN 'weak' ELSE 'unlikely' END AS plausibility FROM b""")
def plausibility(spark, sf):
    g = candidates(spark, sf).select(
        "gene_id", "tf_prior", "pathway", F.when(F.col("tissue") > 0, F.col("tissue")).alias("tissue"),
        F.when(F.col("ortholog") > 0, F.col("ortholog")).alias("ortholog"), "motif",
    )
    return ev.plausibility(g).select("gene_id", "plausibility_score", "plausibility")


@query("candidate_score", f"""WITH {_GENES} SELECT gene_id, round(least(correlation * 0.15::DOUBLE + module_membership * 0.2::DOUBLE + motif * 0.1::DOUBLE + pathway * 0.15::DOUBLE + tissue * 0.05::DOUBLE
  + literature * 0.15::DOUBLE + ortholog * 0.05::DOUBLE + CASE plausibility WHEN 'plausible' THEN 0.15::DOUBLE WHEN 'weak' THEN 0.075::DOUBLE ELSE 0 END, 1), 6) AS confidence_score FROM genes""")
def candidate_score(spark, sf):
    return ev.candidate_score(candidates(spark, sf)).select("gene_id", R("confidence_score").alias("confidence_score"))


@query("pathway_position", """SELECT p_partkey, round(0.4 * CASE WHEN p_size % 4 = 0 THEN (0.5 + p_size / 50) / 2 ELSE least((p_size % 7) / 5, 1) END
  + 0.3 * CASE p_size % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 ELSE 0.3 END + 0.15, 6) AS score FROM part""")
def pathway_position(spark, sf):
    s = F.col("p_size")
    ratio = F.when(s % 4 != 0, (s % 7) / 5)
    coexp = F.when(s % 4 == 0, s / 50)
    neck = F.when(s % 3 == 1, True).when(s % 3 == 2, False)
    return table(spark, sf, "part").select("p_partkey", R(ev.pathway_position(ratio, coexp, neck)).alias("score"))


@query("literature_score", """SELECT source, count(DISTINCT lang) AS n_papers, round(least(count(DISTINCT lang) / 3, 1) * 0.8, 6) AS score FROM documents GROUP BY 1""")
def literature_score(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n_papers"))
    return d.withColumn("score", R(ev.literature_score(F.col("n_papers"))))


@query("assemble_dimensions", """WITH c AS (SELECT l_partkey AS gene_id, max(l_discount) * 10 AS score FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
  m AS (SELECT l_partkey AS gene_id, max(l_tax) * 12 AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), p AS (SELECT p_partkey AS gene_id, p_size / 50 AS score FROM part WHERE p_size > 10)
  SELECT gene_id, round(c.score, 6) AS correlation, round(m.score, 6) AS motif, round(p.score, 6) AS pathway FROM c FULL JOIN m USING (gene_id) FULL JOIN p USING (gene_id)""")
def assemble_dimensions(spark, sf):
    li = table(spark, sf, "lineitem")
    top = lambda flag, col, k: li.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("gene_id")).agg((F.max(col) * k).alias("score"))
    out = ev.assemble(
        correlation=top("A", "l_discount", 10), motif=top("R", "l_tax", 12),
        pathway=table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").alias("gene_id"), (F.col("p_size") / 50).alias("score")),
    )
    return out.select("gene_id", *[R(c).alias(c) for c in ("correlation", "motif", "pathway")])


@query("keep_candidates", f"WITH {_GENES} SELECT gene_id FROM genes WHERE correlation >= 0.5 OR motif >= 0.3")
def keep_candidates(spark, sf):
    return ev.keep_candidates(candidates(spark, sf)).select("gene_id")


@query("candidate_exclusion", _fuse_sql() + f""", {EXPR}, pr AS (SELECT feature_id AS gene_id, count(value) AS cn, avg(value) AS mean, stddev_pop(value) AS sd FROM expr GROUP BY 1)
  SELECT gene_id, (n_sources < 2)::INT + coalesce((cn >= 3 AND sd / (abs(mean) + 1e-10) > 0.8)::INT, 0) * 0 + coalesce((cn >= 3 AND sd / (abs(mean) + 1e-10) > 1.5)::INT, 0)
    + coalesce((cn >= 3 AND mean < 0.1)::INT, 0) + c1::INT + c2::INT + c3::INT + c6::INT AS n_reasons FROM fz LEFT JOIN pr USING (gene_id)""")
def candidate_exclusion(spark, sf):
    prof = expr(spark, sf).groupBy(F.col("feature_id").alias("gene_id")).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")
    )
    f = ev.fuse(candidates(spark, sf), plausibility="plausibility")
    return ev.exclusion_reasons(f, prof).select("gene_id", F.size("reasons").alias("n_reasons"))


@query("candidate_shortlist", _fuse_sql() + " SELECT gene_id, round(cal + 1e-9, 4) AS calibrated_score, level FROM fz ORDER BY round(cal + 1e-9, 4) DESC, gene_id LIMIT 20")
def candidate_shortlist(spark, sf):
    return ev.shortlist(ev.fuse(candidates(spark, sf), plausibility="plausibility"))


@query("candidate_levels", _fuse_sql() + " SELECT count(*) AS n_candidates, count(*) FILTER (level = 'Gold') AS n_gold, count(*) FILTER (level = 'Silver') AS n_silver FROM fz")
def candidate_levels(spark, sf):
    return ev.level_counts(ev.fuse(candidates(spark, sf), plausibility="plausibility"))


@query("candidate_matrix", _fuse_sql() + " SELECT gene_id, " + ", ".join(f"CASE WHEN {d} > 0 THEN round(least({d}, 1), 4) END AS {d}" for d in ev.DIMENSIONS) + ", round(cal + 1e-9, 4)::DOUBLE AS overall FROM fz")
def candidate_matrix(spark, sf):
    return ev.score_matrix(ev.fuse(candidates(spark, sf), plausibility="plausibility"))


@query("run_confidence", """WITH r AS (SELECT o_orderpriority AS run, count(*) % 13 AS n_candidates, count(*) % 2 AS n_high, count(DISTINCT o_orderstatus) AS n_sources,
    count(*) % 4 AS n_contradictions, (count(*) % 100) / 100 AS convergence, (count(*) % 37) / 37 AS data_quality, count(*) % 12 AS n_samples FROM orders GROUP BY 1),
  s AS (SELECT *, (least(CASE WHEN n_candidates >= 10 THEN 0.2 WHEN n_candidates >= 3 THEN 0.15 WHEN n_candidates >= 1 THEN 0.08 ELSE 0 END + CASE WHEN n_high >= 1 THEN 0.1 ELSE 0 END, 0.3)
    + least(n_sources * 0.06, 0.3) + convergence * 0.15 - least(n_contradictions * 0.05, 0.15) + data_quality * 0.1)::DOUBLE * CASE WHEN n_samples < 4 THEN 0.5 WHEN n_samples < 10 THEN 0.8 ELSE 1 END AS s FROM r)
  SELECT run, round(greatest(least(s, 1), 0) + 1e-9, 3) AS overall_score, CASE WHEN s >= 0.7 - 1e-9 THEN 'high' WHEN s >= 0.4 - 1e-9 THEN 'moderate' WHEN s >= 0.1 - 1e-9 THEN 'low' ELSE 'unreliable' END AS label FROM s""")
def run_confidence(spark, sf):
    n = F.count(F.lit(1))
    r = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(
        (n % 13).alias("n_candidates"), (n % 2).alias("n_high"), F.count_distinct("o_orderstatus").alias("n_sources"),
        (n % 4).alias("n_contradictions"), ((n % 100) / 100).alias("convergence"), ((n % 37) / 37).alias("data_quality"), (n % 12).alias("n_samples"),
    )
    return ev.run_confidence(r).select("run", "overall_score", "label")


# --- mechanisms: one metabolite per supplier ------------------------------------------
_MET = """met AS (SELECT s_suppkey AS metabolite, (s_suppkey % 40) / 100.0::DOUBLE AS cv, s_suppkey % 9 AS n_samples, s_suppkey % 5 AS n_stress, s_suppkey % 7 = 0 AS is_developmental,
  s_suppkey % 3 AS n_precursors, CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' ELSE 'ABC' END AS transport_mode, s_suppkey % 6 <> 0 AS has_expression, s_suppkey % 2 = 0 AS has_promoter,
  s_suppkey % 3 = 1 AS has_transcriptional FROM supplier)"""


def metabolites(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("metabolite"), ((k % 40) / 100.0).alias("cv"), (k % 9).alias("n_samples"), (k % 5).alias("n_stress"),
        (k % 7 == 0).alias("is_developmental"), (k % 3).alias("n_precursors"),
        F.when(k % 4 == 1, "unknown").when(k % 4 > 1, "ABC").alias("transport_mode"),
        (k % 6 != 0).alias("has_expression"), (k % 2 == 0).alias("has_promoter"), (k % 3 == 1).alias("has_transcriptional"),
    )


@query("mechanism_probabilities", f"""WITH {_MET}, s AS (SELECT metabolite, has_expression, has_promoter, CASE WHEN cv < 0.1 AND n_samples >= 3 THEN 0.7::DOUBLE WHEN cv < 0.2 AND n_samples >= 3 THEN 0.4::DOUBLE END AS ta,
    CASE WHEN n_stress > 0 THEN least(n_stress * 0.15::DOUBLE, 0.5) ELSE 0.1::DOUBLE END AS st, CASE WHEN is_developmental THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS dv,
    CASE WHEN n_precursors > 0 THEN 0.3::DOUBLE END AS pl, CASE WHEN transport_mode <> 'unknown' THEN 0.3::DOUBLE END AS tr FROM met),
  t AS (SELECT *, greatest(coalesce(ta, 0), 0.2, st, dv, coalesce(pl, 0), coalesce(tr, 0)) AS other,
    0.15::DOUBLE + CASE WHEN has_expression THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN has_promoter THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN has_expression AND has_promoter THEN 0.1::DOUBLE ELSE 0 END AS t0 FROM s),
  u AS (SELECT *, CASE WHEN has_expression THEN least(t0 * CASE WHEN other >= 0.3 THEN 0.6 WHEN other >= 0.15 THEN 0.8 ELSE 1 END, 0.5) ELSE 0.05 END::DOUBLE AS tc FROM t),
  w AS (SELECT *, greatest(coalesce(ta, 0) + 0.15::DOUBLE + st + dv + coalesce(pl, 0) + coalesce(tr, 0) + 0.2::DOUBLE + tc, 1) AS tot FROM u),
  l AS (SELECT metabolite, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS pos, unnest(['technical_artifact', 'cell_composition_change', 'stress_response', 'developmental', 'precursor_limitation', 'transport', 'enzymatic', 'transcriptional']) AS mechanism,
    unnest([ta, 0.15::DOUBLE, st, dv, pl, tr, 0.2::DOUBLE, tc]) / tot AS p FROM w),
  k AS (SELECT *, round(p + 1e-9, 3) AS r, row_number() OVER (PARTITION BY metabolite ORDER BY round(p + 1e-9, 3) DESC, pos) AS rk FROM l WHERE p IS NOT NULL)
  SELECT metabolite, mechanism AS "primary", r AS top_probability, CASE WHEN r < 0.3 THEN 'high' WHEN r < 0.5 THEN 'moderate' ELSE 'low' END AS uncertainty FROM k WHERE rk = 1""")
def mechanism_probabilities(spark, sf):
    return ev.mechanism_scores(metabolites(spark, sf)).select("metabolite", "primary", "top_probability", "uncertainty")


_HYP = f"""WITH {_MET}, r AS (SELECT metabolite, 'H1' AS hypothesis, CASE WHEN has_transcriptional THEN 'support' ELSE 'contradiction' END AS role, 'transcriptional_evidence' AS kind, NULL AS severity FROM met
  UNION ALL SELECT metabolite, 'H2', unnest(['support', 'missing']), unnest(['stress_association', 'stress_marker_expression']), NULL FROM met WHERE n_stress > 0
  UNION ALL SELECT metabolite, 'H3', unnest(['support', 'missing', 'missing']), unnest(['transport_evidence', 'transporter_expression', 'tissue_accumulation']), NULL FROM met WHERE transport_mode IS NOT NULL
  UNION ALL SELECT metabolite, 'H4', unnest(['support', 'missing']), unnest(['precursor_pathway', 'precursor_abundance']), NULL FROM met WHERE n_precursors > 0)"""


@query("competing_hypotheses", _HYP + " SELECT metabolite, hypothesis, role, kind FROM r")
def competing_hypotheses(spark, sf):
    return ev.competing_hypotheses(metabolites(spark, sf)).select("metabolite", "hypothesis", "role", "kind")


_FALS = _HYP + """, reg AS (SELECT s_suppkey AS metabolite, 'H1' AS hypothesis, 'P' || (s_suppkey * 3 % 250) AS gene_id FROM supplier), gs AS (SELECT DISTINCT 'P' || l_partkey AS gene_id FROM lineitem WHERE l_quantity > 49),
  hd AS (SELECT metabolite, hypothesis, count(gs.gene_id) AS nf FROM reg LEFT JOIN gs USING (gene_id) GROUP BY 1, 2), sp AS (SELECT metabolite, hypothesis, count(*) FILTER (role = 'support') AS ns FROM r GROUP BY 1, 2),
  h AS (SELECT hd.*, ns, n_samples FROM hd JOIN sp USING (metabolite, hypothesis) JOIN met USING (metabolite)),
  a AS (SELECT metabolite, hypothesis, role, kind, severity FROM r UNION ALL SELECT metabolite, hypothesis, 'contradiction', 'expression_check', NULL FROM h WHERE nf = 0
    UNION ALL SELECT metabolite, hypothesis, 'contradiction', 'sample_size_check', 'low' FROM h WHERE n_samples < 6 UNION ALL SELECT metabolite, hypothesis, 'contradiction', 'evidence_diversity_check', NULL FROM h WHERE ns < 2
    UNION ALL SELECT metabolite, hypothesis, 'contradiction', 'tissue_mismatch_check', 'low' FROM h)"""


def _attacked(spark, sf):
    m = metabolites(spark, sf)
    k = F.col("s_suppkey")
    reg = table(spark, sf, "supplier").select(k.alias("metabolite"), F.lit("H1").alias("hypothesis"), F.concat(F.lit("P"), (k * 3 % 250).cast("string")).alias("gene_id"))
    genes = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene_id"))
    ctx = m.select("metabolite", "n_samples", F.array(F.lit("leaf")).alias("tissues"), F.lit("").alias("species"))
    return ev.falsify(ev.competing_hypotheses(m), ctx, reg, genes)


@query("falsification_checks", _FALS + " SELECT metabolite, hypothesis, role, kind, severity FROM a")
def falsification_checks(spark, sf):
    return _attacked(spark, sf).select("metabolite", "hypothesis", "role", "kind", "severity")


@query("hypothesis_ranking", _FALS + """, g AS (SELECT metabolite, hypothesis, count(*) FILTER (role = 'support') AS s, count(*) FILTER (role = 'contradiction') AS c, count(*) FILTER (role = 'missing') AS m FROM a GROUP BY 1, 2)
  SELECT metabolite, hypothesis, round(s / greatest(s + c + m, 1), 6) AS score, CASE WHEN c >= s AND s > 0 THEN 'high' ELSE 'moderate' END AS uncertainty,
  row_number() OVER (PARTITION BY metabolite ORDER BY s / greatest(s + c + m, 1) DESC, hypothesis) AS rank FROM g""")
def hypothesis_ranking(spark, sf):
    return ev.rank_hypotheses(_attacked(spark, sf)).select("metabolite", "hypothesis", R("score").alias("score"), "uncertainty", "rank")


@query("falsification_tests", f"WITH {_MET} SELECT metabolite, unnest(['TF_knockout_prediction', 'temporal_consistency']) AS test, unnest(['low', 'medium']) AS feasibility FROM met")
def falsification_tests(spark, sf):
    h = ev.competing_hypotheses(metabolites(spark, sf)).select("metabolite", "hypothesis").distinct()
    return ev.proposed_tests(h).select("metabolite", "test", "feasibility")


@query("upstream_consistency", """SELECT p_brand, n, CASE WHEN n = 0 THEN 'missing' WHEN n < 2 THEN 'contradiction' ELSE 'ok' END AS verdict
  FROM (SELECT p_brand, count(*) FILTER (p_size = 50 AND p_retailprice > 1000) AS n FROM part GROUP BY 1)""")
def upstream_consistency(spark, sf):
    d = table(spark, sf, "part").groupBy("p_brand").agg(F.count_if((F.col("p_size") == 50) & (F.col("p_retailprice") > 1000)).alias("n"))
    return d.withColumn("verdict", ev.consistency(F.col("n")))


@query("weighted_grade", """WITH m AS (SELECT o_orderpriority AS d, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.6 END) AS s FROM orders GROUP BY 1),
  o AS (SELECT sum(s * CASE d WHEN '1-URGENT' THEN 0.25 WHEN '2-HIGH' THEN 0.25 WHEN '3-MEDIUM' THEN 0.25 WHEN '4-NOT SPECIFIED' THEN 0.15 ELSE 0.10 END)::DOUBLE AS overall, count(*) AS n_dimensions FROM m)
  SELECT round(overall, 6) AS overall, n_dimensions, CASE WHEN overall >= 0.9 THEN 'A' WHEN overall >= 0.8 THEN 'B' WHEN overall >= 0.7 THEN 'C' WHEN overall >= 0.5 THEN 'D' ELSE 'F' END AS grade FROM o""")
def weighted_grade(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dimension"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.6).alias("score"))
    d = F.col("dimension")
    w = o.select("dimension").distinct().withColumn(
        "weight", F.when(d.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), 0.25).when(d == "4-NOT SPECIFIED", 0.15).otherwise(0.10)
    )
    return ev.weighted_rollup(o, w).withColumn("overall", R("overall"))


@query("recall_scores", """WITH e AS (SELECT DISTINCT l_suppkey AS case_id, l_partkey AS item FROM lineitem), r AS (SELECT DISTINCT l_suppkey AS case_id, l_partkey AS item, 1 AS hit FROM lineitem WHERE l_returnflag <> 'N')
  SELECT case_id, count(*) AS n_expected, count(hit) AS n_found, round(count(hit) / count(*), 6) AS recall, count(hit) = count(*) AS complete FROM e LEFT JOIN r USING (case_id, item) GROUP BY 1""")
def recall_scores(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_partkey").alias("item"), "l_returnflag")
    return ev.recall_scores(li, li.where("l_returnflag <> 'N'")).withColumn("recall", R("recall"))


@query("verb_choice", _fuse_sql() + """ SELECT verb, count(*) AS n FROM (SELECT CASE WHEN n_sources >= 3 AND motif >= 0.3 AND literature >= 0.3 THEN 'is a candidate regulator of'
  WHEN n_sources >= 2 AND correlation >= 0.7 THEN 'is associated with' ELSE 'correlates with' END AS verb FROM fz) GROUP BY 1""")
def verb_choice(spark, sf):
    f = ev.fuse(candidates(spark, sf), plausibility="plausibility")
    v = ev.verb_choice(F.lit(False), F.col("n_sources"), F.col("correlation"), F.col("motif") >= 0.3, F.col("literature") >= 0.3)
    return f.groupBy(v.alias("verb")).agg(F.count(F.lit(1)).alias("n"))


# --- knowledge -----------------------------------------------------------------------
_WORDS = ["ring", "widget", "bolt", "gear", "nut", "plate"]


@query("map_metabolites", """WITH n AS (SELECT p_partkey, p_name, regexp_replace(lower(trim(' ' || p_name || CASE p_partkey % 4 WHEN 0 THEN '-Flavonoid' WHEN 1 THEN ' Alkaloid' ELSE '' END)), '[_\\- ]+', '_', 'g') AS norm FROM part)
  SELECT p_partkey, CASE WHEN norm = 'red_bolt' THEN 'crimson_fastener' WHEN regexp_matches(norm, 'flavonoid|alkaloid') THEN norm WHEN regexp_matches(norm, 'ring') THEN norm || '_loop' ELSE norm END AS canonical,
  CASE WHEN norm = 'red_bolt' THEN 'synonym:crimson_fastener' WHEN regexp_matches(norm, 'flavonoid') THEN 'pattern:flavonoid' WHEN regexp_matches(norm, 'alkaloid') THEN 'pattern:alkaloid'
  WHEN regexp_matches(norm, 'ring') THEN 'pattern:loop' ELSE 'raw' END AS mapping FROM n""")
def map_metabolites(spark, sf):
    m = F.col("p_partkey") % 4
    name = F.concat(F.lit(" "), "p_name", F.when(m == 0, "-Flavonoid").when(m == 1, " Alkaloid").otherwise(""))
    got = kn.map_metabolite(name, {**kn.METABOLITE_SYNONYMS, "red_bolt": "crimson_fastener"}, kn.METABOLITE_PATTERNS + [("ring", "loop")])
    return table(spark, sf, "part").select("p_partkey", got["canonical"].alias("canonical"), got["mapping"].alias("mapping"))


@query("map_species", """SELECT c_custkey, coalesce(r_name, lower(trim(c_mktsegment))) AS canonical, CASE WHEN r_name IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS confidence FROM customer
  LEFT JOIN (SELECT * FROM (VALUES ('building', 0), ('machinery', 1)) v(alias, k) JOIN region ON r_regionkey = k) ON lower(trim(c_mktsegment)) = alias""")
def map_species(spark, sf):
    r = table(spark, sf, "region")
    alias = r.where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "Building").otherwise("machinery").alias("alias"), F.col("r_name").alias("canonical"))
    return kn.map_species(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", alias).select("c_custkey", "canonical", "confidence")


_GID = "CASE p_partkey % 7 WHEN 0 THEN 'evm.' || p_partkey WHEN 1 THEN 'TRINITY_' || p_partkey WHEN 2 THEN 'XM_' || p_partkey WHEN 3 THEN 'AT1G' || lpad(p_partkey::VARCHAR, 5, '0') WHEN 4 THEN p_partkey::VARCHAR WHEN 5 THEN 'Os01g' || lpad(p_partkey::VARCHAR, 7, '0') ELSE '-x' END"


def _gene_ids(spark, sf):
    k = F.col("p_partkey")
    t = k.cast("string")
    g = (
        F.when(k % 7 == 0, F.concat(F.lit("evm."), t)).when(k % 7 == 1, F.concat(F.lit("TRINITY_"), t)).when(k % 7 == 2, F.concat(F.lit("XM_"), t))
        .when(k % 7 == 3, F.concat(F.lit("AT1G"), F.lpad(t, 5, "0"))).when(k % 7 == 4, t).when(k % 7 == 5, F.concat(F.lit("Os01g"), F.lpad(t, 7, "0"))).otherwise("-x")
    )
    return table(spark, sf, "part").select("p_partkey", g.alias("gene_id"))


@query("gene_id_formats", f"""WITH g AS (SELECT p_partkey, {_GID} AS gene_id FROM part) SELECT p_partkey, gene_id, CASE WHEN regexp_matches(gene_id, '^evm\\.\\S+') THEN 'evm' WHEN regexp_matches(gene_id, '^TRINITY_\\S+') THEN 'trinity'
  WHEN regexp_matches(gene_id, '^(NM_|XM_|NP_|XP_)\\d+') THEN 'refseq' WHEN regexp_matches(gene_id, '^AT\\wG\\d+') THEN 'arabidopsis' WHEN regexp_matches(gene_id, '^\\w+') THEN 'generic' ELSE 'unknown' END AS id_format,
  CASE WHEN regexp_matches(gene_id, '^Os\\d{{2}}g\\d{{7}}$') THEN 'rapdb' WHEN regexp_matches(gene_id, '^AT[1-5MC]G\\d{{5}}(\\.[0-9]+)?$') THEN 'tair' WHEN regexp_matches(gene_id, '^\\d{{4,}}$') THEN 'ncbi_gene'
  WHEN regexp_matches(gene_id, '^evm\\.\\w+$') THEN 'ensembl_plant' ELSE 'symbol' END AS locus_format, CASE WHEN regexp_matches(gene_id, '^\\d') THEN 'GENE_' || gene_id ELSE gene_id END AS fixed FROM g""")
def gene_id_formats(spark, sf):
    g = F.col("gene_id")
    return _gene_ids(spark, sf).select("p_partkey", "gene_id", kn.id_format(g).alias("id_format"), kn.locus_format(g).alias("locus_format"), kn.fix_prefix(g).alias("fixed"))


@query("duplicate_ids", "SELECT lower(p_name) AS id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return kn.duplicate_ids(table(spark, sf, "part").select(F.initcap("p_name").alias("feature_id")))


@query("symbol_families", """WITH s AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'OsNAC' || p_size WHEN 1 THEN 'xMYBlike' WHEN 2 THEN 'AtWRKY' || p_size WHEN 3 THEN 'ABCERF1' WHEN 4 THEN 'HD-ZIP ' || p_size ELSE p_name END AS symbol FROM part)
  SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'NAC' WHEN 2 THEN 'WRKY' WHEN 4 THEN 'HD-ZIP' ELSE '' END AS family FROM s""")
def symbol_families(spark, sf):
    k = F.col("p_partkey") % 6
    s = F.col("p_size").cast("string")
    sym = F.when(k == 0, F.concat(F.lit("OsNAC"), s)).when(k == 1, "xMYBlike").when(k == 2, F.concat(F.lit("AtWRKY"), s)).when(k == 3, "ABCERF1").when(k == 4, F.concat(F.lit("HD-ZIP "), s)).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", kn.symbol_family(sym).alias("family"))


@query("readable_alias", """SELECT p_partkey AS gene_id, CASE WHEN p_size % 2 = 0 THEN 'OsNAC' || (p_size % 10) ELSE 'ABC' || (p_size % 10) END AS alias, CASE WHEN p_size % 2 = 0 THEN 12 ELSE 5 END AS score FROM part""")
def readable_alias(spark, sf):
    s = F.col("p_size")
    d = (s % 10).cast("string")
    names = F.array(
        F.concat(F.lit("LOC"), F.col("p_partkey").cast("string"), F.lit("0000")), F.lit("putative"), F.concat(F.col("p_name"), F.lit(" protein")),
        F.when(s % 2 == 0, F.concat(F.lit("OsNAC"), d)).otherwise(F.concat(F.lit("ABC"), d)),
    )
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("gene_id"), F.posexplode(names).alias("pos", "alias"))
    return kn.best_alias(a)


def _annotation(spark, sf):
    return table(spark, sf, "part").select(
        F.concat(F.lit("g"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ".1").otherwise("")).alias("gene_id"),
        F.concat_ws("|", "p_name", "p_type", "p_brand").alias("term"),
    )


_ANNO = "ann AS (SELECT 'g' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.1' ELSE '' END AS gene_id, p_name || '|' || p_type || '|' || p_brand AS term FROM part)"


@query("annotation_tokens", f"WITH {_ANNO} SELECT token, count(*) AS n FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(term), '[|;\\s]+')) AS token, gene_id FROM ann) WHERE length(token) >= 2 GROUP BY 1")
def annotation_tokens(spark, sf):
    return kn.annotation_tokens(_annotation(spark, sf)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("annotation_search", f"WITH {_ANNO}, k AS (SELECT unnest(['RED', 'Econ', 'brand#1']) AS keyword) SELECT DISTINCT gene_id, keyword FROM ann, k WHERE contains(lower(term), lower(keyword))")
def annotation_search(spark, sf):
    return kn.search_annotation(_annotation(spark, sf), ["RED", "Econ", "brand#1"])


@query("resolve_ids", f"WITH {_ANNO}, kn AS (SELECT DISTINCT 'g' || l_partkey AS feature_id FROM lineitem) SELECT gene_id AS hit, regexp_replace(gene_id, '\\.[^.]*$', '') AS feature_id FROM ann WHERE regexp_replace(gene_id, '\\.[^.]*$', '') IN (SELECT feature_id FROM kn)")
def resolve_ids(spark, sf):
    known = table(spark, sf, "lineitem").select(F.concat(F.lit("g"), F.col("l_partkey").cast("string")).alias("feature_id"))
    return kn.resolve_ids(_annotation(spark, sf).select(F.col("gene_id").alias("hit")), known)


@query("tf_membership", """WITH g AS (SELECT 'G' || p_partkey AS gene_id FROM part), c AS (SELECT DISTINCT 'G' || l_partkey AS gene_id FROM lineitem WHERE l_quantity >= 50), d AS (SELECT 'G' || l_partkey AS gene_id, count(*) AS hits FROM lineitem WHERE l_quantity = 1 GROUP BY 1)
  SELECT gene_id, CASE WHEN c.gene_id IS NOT NULL THEN 0.8 WHEN d.gene_id IS NOT NULL THEN 0.7 ELSE 0.5 END::DOUBLE AS score, coalesce(hits, 0) AS domain_hits
  FROM g LEFT JOIN c USING (gene_id) LEFT JOIN d USING (gene_id) WHERE c.gene_id IS NOT NULL OR d.gene_id IS NOT NULL OR regexp_matches(gene_id, '^G1')""")
def tf_membership(spark, sf):
    gid = lambda c: F.concat(F.lit("G"), F.col(c).cast("string"))
    li = table(spark, sf, "lineitem")
    rows = li.select(gid("l_partkey").alias("raw"), F.when(F.col("l_quantity") == 1, "PF00001").otherwise("-").alias("dom"))
    # ids are plain here, so the suffix-free twin is the id itself
    domains = sq.classification_ids(rows, F.col("raw"), F.col("dom")).withColumn("hits", (F.col("hits") / 2).cast("bigint"))
    return kn.tf_membership(
        table(spark, sf, "part").select(gid("p_partkey").alias("gene_id")),
        li.where("l_quantity >= 50").select(gid("l_partkey").alias("gene_id")), domains, "^G1",
    )


# prior edges: brand = family, part name = metabolite class
_PRIOR = "pri AS (SELECT p_brand AS family, p_name AS metabolite_class, max(p_size) / 50.0::DOUBLE AS score, min(p_partkey) AS pos FROM part GROUP BY 1, 2)"


def _prior(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("family"), F.col("p_name").alias("metabolite_class")).agg(
        (F.max("p_size") / 50.0).alias("score"), F.min("p_partkey").alias("pos")
    )


@query("prior_lookup", f"""WITH {_PRIOR}, q AS (SELECT DISTINCT p_brand AS family, CASE p_partkey % 3 WHEN 0 THEN 'red ring' WHEN 1 THEN 'ring' ELSE 'zzz' END AS target FROM part),
  j AS (SELECT q.*, metabolite_class, score, pos, CASE WHEN contains(metabolite_class, target) OR contains(target, metabolite_class) THEN 1
    WHEN len(list_filter(string_split(metabolite_class, '_'), lambda w: contains(target, w))) > 0 OR len(list_filter(regexp_split_to_array(target, '\\s+'), lambda w: contains(metabolite_class, w))) > 0 THEN 2 ELSE 3 END AS tier FROM q JOIN pri USING (family)),
  k AS (SELECT *, row_number() OVER (PARTITION BY family, target ORDER BY tier, CASE WHEN tier = 1 THEN pos ELSE -score END, pos) AS rk FROM j)
  SELECT family, target, CASE WHEN tier = 3 THEN 'general' ELSE metabolite_class END AS matched, round(CASE WHEN tier = 3 THEN score * 0.5 ELSE score END, 6) AS score, tier FROM k WHERE rk = 1""")
def prior_lookup(spark, sf):
    m = F.col("p_partkey") % 3
    q = table(spark, sf, "part").select(F.col("p_brand").alias("family"), F.when(m == 0, "red ring").when(m == 1, "ring").otherwise("zzz").alias("target")).distinct()
    return kn.prior_lookup(q, _prior(spark, sf)).withColumn("score", R("score"))


# ontology: customers in a 4-ary tree by key
_TREE = "tr AS (SELECT c_custkey AS node, (c_custkey - 1) // 4 AS parent FROM customer WHERE c_custkey > 0)"
_CLOS = "cl AS (SELECT node, parent AS ancestor, 1 AS depth FROM tr UNION ALL SELECT cl.node, tr.parent, cl.depth + 1 FROM cl JOIN tr ON tr.node = cl.ancestor)"


def _tree(spark, sf):
    return table(spark, sf, "customer").where("c_custkey > 0").select(
        F.col("c_custkey").alias("node"), F.floor((F.col("c_custkey") - 1) / 4).alias("parent")
    )


@query("ontology_closure", f"WITH RECURSIVE {_TREE}, {_CLOS} SELECT node, ancestor, depth FROM cl")
def ontology_closure(spark, sf):
    return network.closure(_tree(spark, sf))


@query("ontology_leaves", f"WITH RECURSIVE {_TREE}, {_CLOS}, lf AS (SELECT node FROM tr WHERE node NOT IN (SELECT parent FROM tr)) SELECT ancestor, count(*) AS n_leaves FROM cl SEMI JOIN lf USING (node) GROUP BY 1")
def ontology_leaves(spark, sf):
    t = settle(_tree(spark, sf))
    leaves = t.join(t.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    return network.closure(t).join(leaves.select("node"), "node", "left_semi").groupBy("ancestor").agg(F.count(F.lit(1)).alias("n_leaves"))


@query("inherited_prior", f"""WITH RECURSIVE {_TREE}, {_CLOS}, pr AS (SELECT 'F' || (c_nationkey % 5) AS family, c_custkey AS target, round(abs(c_acctbal) / 10000, 4) AS score, c_custkey % 2 = 0 AS inheritable FROM customer WHERE c_custkey % 3 = 0),
  q AS (SELECT 'F' || f AS family, c_custkey AS target FROM customer, range(0, 5) r(f)),
  a AS (SELECT q.*, target AS att, 0 AS depth FROM q UNION ALL SELECT q.*, ancestor, depth FROM q JOIN cl ON node = target),
  h AS (SELECT a.family, a.target, score, a.att, depth FROM a JOIN pr ON pr.family = a.family AND pr.target = a.att WHERE depth = 0 OR inheritable),
  k AS (SELECT *, row_number() OVER (PARTITION BY family, target ORDER BY score DESC, depth, att) AS rk FROM h)
  SELECT family, target, score, att AS matched, depth FROM k WHERE rk = 1""")
def inherited_prior(spark, sf):
    c = table(spark, sf, "customer")
    pri = c.where("c_custkey % 3 = 0").select(
        F.concat(F.lit("F"), (F.col("c_nationkey") % 5).cast("string")).alias("family"), F.col("c_custkey").alias("target"),
        F.round(F.abs("c_acctbal") / 10000, 4).alias("score"), (F.col("c_custkey") % 2 == 0).alias("inheritable"),
    )
    q = c.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("F"), i.cast("string")))).alias("family"), F.col("c_custkey").alias("target")
    )
    return kn.inherited_prior(q, pri, network.closure(_tree(spark, sf)))


@query("query_priors", """SELECT p_partkey FROM part WHERE p_retailprice / 2000 >= 0.46 AND contains(lower(p_brand), 'brand#1') AND (contains(lower(p_type), 'ring') OR contains(lower(p_name), 'ring') OR contains(lower(p_type), 'econ'))
  AND (p_size % 3 = 0 OR p_size % 5 = 1 OR p_size % 2 = 0)""")
def query_priors(spark, sf):
    s = F.col("p_size")
    pri = table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("tf_family"), F.col("p_type").alias("metabolite_class"), F.col("p_name").alias("specific_metabolite"), F.lit("").alias("description"),
        (F.col("p_retailprice") / 2000).alias("score"), F.when(s % 2 == 0, "strong").otherwise("weak").alias("strength"),
        F.when(s % 3 == 0, "general").when(s % 5 == 1, "Oryza sativa").otherwise("Zea mays").alias("species_scope"),
    )
    return kn.query_priors(pri, "ring", "Brand#1", "oryza", 0.46, "econ").select("p_partkey")


@query("family_ranking", "SELECT p_brand AS tf_family, max(p_size) AS best FROM part GROUP BY 1")
def family_ranking(spark, sf):
    return kn.families_by_score(table(spark, sf, "part").select(F.col("p_brand").alias("tf_family"), F.col("p_size").alias("score")))


@query("ortholog_prior", """SELECT p_partkey, round(CASE WHEN p_size % 3 <> 0 THEN least(s * CASE WHEN p_size % 4 = 0 THEN 0.5 WHEN p_size % 4 = 1 THEN CASE WHEN i >= 70 THEN 1.0 WHEN i >= 50 THEN 0.8 ELSE 0.6 END ELSE 1 END, 1) ELSE s * 0.5 END, 6)::DOUBLE AS score
  FROM (SELECT *, p_size / 50.0::DOUBLE AS s, p_partkey % 100 AS i FROM part)""")
def ortholog_prior(spark, sf):
    s = F.col("p_size")
    has = F.when(s % 4 == 0, False).when(s % 4 == 1, True)
    return table(spark, sf, "part").select("p_partkey", R(kn.ortholog_prior(s / 50.0, s % 3 != 0, has, F.col("p_partkey") % 100)).alias("score"))


@query("ortholog_map", """WITH g AS (SELECT p_name || p_partkey AS gene_id, p_partkey FROM part), c AS (SELECT gene_id, 'AT' || p_partkey AS ortholog FROM g WHERE p_partkey % 5 = 0)
  SELECT gene_id, coalesce(ortholog, CASE WHEN contains(gene_id, 'ring') THEN 'RING' WHEN contains(gene_id, 'bolt') THEN 'BOLT' END) AS ortholog, CASE WHEN ortholog IS NULL THEN 'family' ELSE 'curated' END AS source
  FROM g LEFT JOIN c USING (gene_id) WHERE ortholog IS NOT NULL OR contains(gene_id, 'ring') OR contains(gene_id, 'bolt')""")
def ortholog_map(spark, sf):
    p = table(spark, sf, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("gene_id"), "p_partkey")
    cur = p.where("p_partkey % 5 = 0").select("gene_id", F.concat(F.lit("AT"), F.col("p_partkey").cast("string")).alias("ortholog"))
    return kn.ortholog_map(p.select("gene_id"), cur, ["RING", "BOLT"])


@query("species_fallback", """WITH q AS (SELECT DISTINCT c_nationkey AS species, c_mktsegment AS metabolite FROM customer), pf AS (SELECT c_nationkey AS species, c_mktsegment AS metabolite, 'p' || min(c_custkey) AS answer FROM customer WHERE c_nationkey < 8 AND c_custkey % 3 = 0 GROUP BY 1, 2)
  SELECT species, metabolite, CASE WHEN species IN (SELECT species FROM pf) THEN answer WHEN metabolite < 'F' THEN 'rule' END AS answer, CASE WHEN species IN (SELECT species FROM pf) THEN 'profile' WHEN metabolite < 'F' THEN 'ortholog' ELSE 'gap' END AS level FROM q LEFT JOIN pf USING (species, metabolite)""")
def species_fallback(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("species"), F.col("c_mktsegment").alias("metabolite"), "c_custkey")
    pf = c.where("species < 8 AND c_custkey % 3 = 0").groupBy("species", "metabolite").agg(F.concat(F.lit("p"), F.min("c_custkey").cast("string")).alias("answer"))
    rules = c.where("metabolite < 'F'").select("metabolite", F.lit("rule").alias("rule")).distinct()
    return kn.species_knowledge(c.select("species", "metabolite").distinct(), pf, rules)


@query("shared_families", "SELECT DISTINCT p_brand AS family FROM part WHERE p_size = 7 INTERSECT SELECT DISTINCT p_brand FROM part WHERE p_size = 9")
def shared_families(spark, sf):
    p = table(spark, sf, "part")
    return kn.shared_families(p.where("p_size = 7").select(F.col("p_brand").alias("family")), p.where("p_size = 9").select(F.col("p_brand").alias("family")))


@query("clean_references", """WITH r AS (SELECT o_orderkey AS ref_id, CASE o_orderkey % 4 WHEN 0 THEN 'PMID:' || (10000 + o_orderkey) WHEN 1 THEN 'NCBI Gene ' || o_orderkey WHEN 2 THEN 'blog ' || o_orderkey ELSE 'x' END AS ref FROM orders)
  SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN ref_id % 8 = 0 WHEN 1 THEN true ELSE false END AS kept, CASE ref_id % 4 WHEN 0 THEN 'PMID: ' || (10000 + ref_id) ELSE ref END AS ref FROM r WHERE ref_id % 4 <> 3""")
def clean_references(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    ref = F.when(k % 4 == 0, F.concat(F.lit("PMID:"), (10000 + k).cast("string"))).when(k % 4 == 1, F.concat(F.lit("NCBI Gene "), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("blog "), k.cast("string"))).otherwise("x")
    return kn.clean_references(o.select(k.alias("ref_id"), ref.alias("ref")), o.where("o_orderkey % 8 = 0").select((10000 + k).alias("pmid")))


@query("pathway_lookup", """WITH n AS (SELECT DISTINCT p_name AS name FROM part) SELECT name, CASE WHEN name = 'red ring' THEN 'red_ring' WHEN suffix(name, 'bolt') THEN 'bolt' ELSE 'ring' END AS key,
  CASE WHEN name = 'red ring' THEN 'map1' WHEN suffix(name, 'bolt') THEN 'map2' ELSE 'map3' END AS pathway_id, CASE WHEN name = 'red ring' THEN 1 WHEN suffix(name, 'bolt') OR suffix(name, 'ring') THEN 2 ELSE 3 END AS tier
  FROM n WHERE suffix(name, 'ring') OR suffix(name, 'bolt') OR contains(name, 'dget')""")
def pathway_lookup(spark, sf):
    p = table(spark, sf, "part")
    key = F.when(F.col("p_name") == "red ring", "red_ring").when(F.col("p_name").endswith("bolt"), "bolt").when(F.col("p_name").endswith("ring"), "ring")
    pw = p.select(key.alias("key")).where("key IS NOT NULL").distinct().withColumn(
        "pathway_id", F.when(F.col("key") == "red_ring", "map1").when(F.col("key") == "bolt", "map2").otherwise("map3")
    )
    return kn.pathway_lookup(p.select(F.col("p_name").alias("name")).distinct(), pw, [("dget", "ring")])


@query("resolve_terms", """WITH n AS (SELECT DISTINCT p_name AS term FROM part), t AS (SELECT term FROM n UNION SELECT term || ' pathway' FROM n UNION SELECT split_part(term, ' ', 2) FROM n UNION SELECT DISTINCT lower(p_brand) FROM part),
  k AS (SELECT term, replace(term, ' ', '_') AS key FROM t), syn AS (SELECT replace(lower(term), ' ', '_') AS key FROM n WHERE term LIKE '%bolt'), pw AS (SELECT replace(term || ' pathway', ' ', '_') AS key FROM n WHERE term LIKE '%ring%')
  SELECT term, CASE WHEN contains(term, 'pathway') AND key IN (FROM pw) THEN 'pathway' WHEN key IN (FROM syn) THEN 'metabolite' WHEN key IN (FROM pw) THEN 'pathway' WHEN prefix(term, 'brand#') THEN 'tf_family'
    WHEN EXISTS (SELECT 1 FROM syn WHERE contains(syn.key, k.key)) THEN 'fuzzy' ELSE 'unknown' END AS node_type FROM k""")
def resolve_terms(spark, sf):
    p = table(spark, sf, "part")
    name = p.select(F.col("p_name").alias("term")).distinct()
    terms = (
        name.unionByName(name.select(F.concat("term", F.lit(" pathway")).alias("term")))
        .unionByName(name.select(F.split("term", " ")[1].alias("term")))
        .unionByName(p.select(F.lower("p_brand").alias("term")).distinct())
    )
    syn = name.where("term LIKE '%bolt'").select(F.upper("term").alias("alias"), F.lit("bolt").alias("canonical"))
    pw = name.where("term LIKE '%ring%'").select(F.concat("term", F.lit(" pathway")).alias("alias"), F.lit("ring_pathway").alias("node"))
    fam = p.select(F.col("p_brand").alias("family")).distinct()
    return kn.resolve_terms(terms, syn, pw, fam).select("term", "node_type")


@query("expand_query", """WITH s AS (SELECT split_part(p_name, ' ', 1) AS gene, p_type AS synonym, row_number() OVER (PARTITION BY split_part(p_name, ' ', 1) ORDER BY p_type) AS rn FROM (SELECT DISTINCT p_name, p_type FROM part WHERE p_name LIKE 'red %' OR p_name LIKE 'small %') GROUP BY 1, 2),
  a AS (SELECT gene, string_agg(synonym, ' OR ' ORDER BY synonym) AS syn FROM s WHERE rn <= 3 GROUP BY 1)
  SELECT p_partkey AS query_id, CASE WHEN syn IS NULL THEN p_name ELSE '(' || gene || ' OR ' || syn || ') ' || split_part(p_name, ' ', 2) END AS expanded FROM part LEFT JOIN a ON gene = split_part(p_name, ' ', 1)""")
def expand_query(spark, sf):
    p = table(spark, sf, "part")
    first = F.split("p_name", " ")[0]
    syn = p.where(first.isin("red", "small")).select(first.alias("gene"), F.col("p_type").alias("synonym")).distinct()
    return kn.expand_query(p.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text")), syn, most=3)
