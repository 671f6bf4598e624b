"""Queries over the matrix views: cleaning, alignment and differential tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from omiclattice.functions.ranks import average_ranks, benjamini_hochberg, exact_quantile
from omiclattice.operators import align, clean, stats
from omiclattice.plans.registry import query
from omiclattice.plans.views import (
    EVT, EXPR, GRP, METAB, events_long, expr, groups, metab, sql_bh, sql_chi2_tail,
    sql_f_tail, sql_t_two_sided, table,
)

R = lambda c, d=6: F.round(c, d)

# --- predicates, filters, gates -------------------------------------------
_RAW = """CASE l_linenumber % 7 WHEN 1 THEN ' NA ' WHEN 2 THEN '-' WHEN 3 THEN 'inf' WHEN 4 THEN 'x'
  ELSE l_quantity::VARCHAR END"""


@query("missing_predicate", f"""SELECT l_returnflag, count(*) AS n_cells, count(v) AS n_values,
  round(sum(v), 2) AS total FROM (SELECT l_returnflag, CASE WHEN lower(trim(raw)) IN ('', 'na', 'nan', 'null', 'none', '-', 'inf')
  THEN NULL ELSE try_cast(raw AS DOUBLE) END AS v FROM (SELECT l_returnflag, {_RAW} AS raw FROM lineitem)) GROUP BY 1""")
def missing_predicate(spark, sf):
    m = F.col("l_linenumber") % 7
    raw = (
        F.when(m == 1, " NA ").when(m == 2, "-").when(m == 3, "inf").when(m == 4, "x")
        .otherwise(F.col("l_quantity").cast("string"))
    )
    df = table(spark, sf, "lineitem").select("l_returnflag", clean.parse_number(raw).alias("v"))
    return df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n_cells"), F.count("v").alias("n_values"), R(F.sum("v"), 2).alias("total")
    )


_PROF = """prof AS (SELECT feature_id, count(value) AS n_values, count(*) FILTER (value > 0) AS n_positive,
  sum(value) AS total, avg(value) AS mean, stddev_samp(value) AS sd, (SELECT count(DISTINCT sample_id) FROM expr) AS ns
  FROM expr GROUP BY 1)"""


@query("filter_low_expression", f"""WITH {EXPR}, {_PROF} SELECT feature_id, sample_id, value FROM expr
  WHERE feature_id IN (SELECT feature_id FROM prof WHERE n_positive / ns >= 0.7 AND total / greatest(n_positive, 1) >= 40000)""")
def filter_low_expression(spark, sf):
    return clean.filter_low_expression(expr(spark, sf), min_mean=40000.0, min_present=0.7)


@query("filter_na_ratio", f"""WITH {EXPR}, {_PROF} SELECT feature_id, sample_id, value FROM expr
  WHERE feature_id IN (SELECT feature_id FROM prof WHERE 1 - n_values / ns <= 0.3)""")
def filter_na_ratio(spark, sf):
    return clean.filter_na_ratio(expr(spark, sf), 0.3)


@query("expression_flags", f"""WITH {EXPR}, {_PROF} SELECT feature_id, coalesce(mean < 45000, false) AS low_expression,
  n_positive < 16 AS low_detection, n_values = 0 AS all_missing FROM prof""")
def expression_flags(spark, sf):
    return clean.expression_flags(expr(spark, sf), 45000.0, 16)


@query("duplicate_cells", f"WITH {EVT} SELECT feature_id, sample_id, count(*) AS n FROM evt GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_cells(spark, sf):
    return clean.duplicate_cells(events_long(spark, sf))


@query("feature_missingness", f"""WITH {EXPR}, {_PROF} SELECT feature_id, round(1 - n_values / ns, 4) AS missing_rate,
  1 - n_values / ns > 0.3 AS is_high FROM prof""")
def feature_missingness(spark, sf):
    return clean.feature_missingness(expr(spark, sf), 0.3)


@query("sample_missingness", f"""WITH {EXPR}, f AS (SELECT count(DISTINCT feature_id) AS nf FROM expr)
  SELECT sample_id, round(1 - count(value) / max(nf), 4) AS missing_rate, 1 - count(value) / max(nf) > 0.3 AS is_high
  FROM expr, f GROUP BY 1""")
def sample_missingness(spark, sf):
    return clean.sample_missingness(expr(spark, sf))


@query("matrix_integrity", f"""WITH {EXPR}, c AS (SELECT sample_id, stddev_samp(value) AS sd, count(value) AS n,
  (SELECT count(DISTINCT feature_id) FROM expr) AS nf FROM expr GROUP BY 1)
  SELECT count(*) AS n_samples, count(*) FILTER (sd = 0) AS n_zero_variance, count(*) FILTER (1 - n / nf > 0.5) AS n_high_missing,
  count(*) >= 3 AND count(*) FILTER (sd = 0) = 0 AND count(*) FILTER (1 - n / nf > 0.5) <= 5 AS all_passed FROM c""")
def matrix_integrity(spark, sf):
    return clean.matrix_integrity(expr(spark, sf))


@query("validate_block", f"""WITH {EXPR} SELECT count(DISTINCT feature_id) AS n_features,
  count(DISTINCT feature_id) - count(DISTINCT lower(feature_id)) AS n_duplicate_ids, 0::BIGINT AS n_infinite,
  count(DISTINCT sample_id) AS n_samples, count(DISTINCT feature_id) * count(DISTINCT sample_id) - count(value) AS n_missing,
  count(DISTINCT sample_id) >= 3 AS passed FROM expr""")
def validate_block(spark, sf):
    return clean.validate_block(expr(spark, sf))


@query("quality_gate", f"""WITH {EXPR}, {METAB}, {_PROF}, g AS (SELECT round(avg(1 - n_values / ns), 4) AS avg_missing_rate,
  count(*) AS n_genes, max(ns) AS n_samples FROM prof), c AS (SELECT count(*) AS common_samples FROM
  (SELECT DISTINCT sample_id FROM expr INTERSECT SELECT DISTINCT sample_id FROM metab)),
  t AS (SELECT bool_or(contains(lower(feature_id), 'm7')) AS target_found FROM metab)
  SELECT avg_missing_rate, n_genes, n_samples, common_samples, target_found,
  n_samples >= 3 AND common_samples >= 3 AS passed, (n_samples < 3)::INT + (common_samples < 3)::INT +
  (avg_missing_rate > 0.3)::INT + (n_genes < 100)::INT + (NOT target_found)::INT AS n_issues FROM g, c, t""")
def quality_gate(spark, sf):
    return clean.quality_gate(expr(spark, sf), metab(spark, sf), "m7").select(
        "avg_missing_rate", "n_genes", "n_samples", "common_samples", "target_found", "passed",
        F.size("issues").alias("n_issues"),
    )


@query("target_signal", f"""WITH {METAB}, s AS (SELECT feature_id, count(value) AS n,
  CASE WHEN abs(avg(value)) > 1e-10 THEN stddev_pop(value) / avg(value) ELSE 0 END AS cv FROM metab
  WHERE contains(lower(feature_id), 'm1') OR contains('m1', lower(feature_id)) GROUP BY 1)
  SELECT feature_id, n, round(cv, 6) AS cv, CASE WHEN n < 3 THEN 'too_few_values' WHEN cv > 0.3 THEN 'strong'
  WHEN cv > 0.1 THEN 'limited' ELSE 'flat' END AS signal, n >= 3 AND cv > 0.1 AS validated FROM s""")
def target_signal(spark, sf):
    return clean.target_signal(metab(spark, sf), "M1").withColumn("cv", R("cv"))


@query("pick_target", f"""WITH {METAB} SELECT feature_id, round(stddev_pop(value) / avg(value), 6) AS cv FROM metab
  GROUP BY 1 HAVING count(value) >= 2 AND avg(value) > 0 ORDER BY stddev_pop(value) / avg(value) DESC, feature_id LIMIT 1""")
def pick_target(spark, sf):
    return clean.pick_target(metab(spark, sf)).withColumn("cv", R("cv"))


@query("top_variance", f"""WITH {EXPR} SELECT feature_id, round(var_pop(value), 2) AS variance FROM expr GROUP BY 1
  ORDER BY var_pop(value) DESC, feature_id LIMIT 60""")
def top_variance(spark, sf):
    return clean.top_variance(expr(spark, sf), 60).withColumn("variance", R("variance", 2))


@query("infer_data_type", f"""WITH {EXPR} SELECT round(median(value), 4) AS matrix_median,
  CASE WHEN median(value) > 50 THEN 'count' ELSE 'fpkm' END AS data_type FROM expr""")
def infer_data_type(spark, sf):
    return clean.infer_data_type(expr(spark, sf)).withColumn("matrix_median", R("matrix_median", 4))


@query("infer_scale", f"""WITH {EXPR} SELECT round(median(value), 4) AS positive_median, max(value) AS positive_max,
  CASE WHEN median(value) > 50 THEN 'count' WHEN max(value) <= 30 THEN 'already_log' ELSE 'linear' END AS scale
  FROM expr WHERE value > 0""")
def infer_scale(spark, sf):
    return clean.infer_scale(expr(spark, sf)).withColumn("positive_median", R("positive_median", 4))


_NAMED = """named AS (SELECT upper(p_name) || '_' || p_partkey AS feature_id, n_name AS sample_id,
  round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY p_name, p_partkey, n_name)"""


def named_features(spark, sf):
    """Expression view with part names inside the feature ids."""
    names = table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("feature_id"),
        F.concat(F.upper("p_name"), F.lit("_"), F.col("p_partkey").cast("string")).alias("named"),
    )
    return expr(spark, sf).join(names, "feature_id").select(
        F.col("named").alias("feature_id"), "sample_id", "value"
    )


@query("stress_marker_scan", f"""WITH {_NAMED}, h AS (SELECT feature_id, value, CASE WHEN contains(feature_id, 'RED') THEN 'red'
  WHEN contains(feature_id, 'RING') THEN 'ring' WHEN contains(feature_id, 'SMALL') THEN 'small' END AS marker FROM named)
  SELECT feature_id, marker, round(avg(value), 6) AS mean, round(stddev_pop(value) / (abs(avg(value)) + 1e-10), 6) AS cv
  FROM h WHERE marker IS NOT NULL GROUP BY 1, 2""")
def stress_marker_scan(spark, sf):
    return clean.stress_markers(named_features(spark, sf), ["red", "ring", "small"]).withColumns(
        {"mean": R("mean"), "cv": R("cv")}
    )


@query("stress_verdict", f"""WITH {_NAMED}, h AS (SELECT feature_id, stddev_pop(value) / (abs(avg(value)) + 1e-10) AS cv FROM named
  WHERE contains(feature_id, 'RED') GROUP BY 1) SELECT count(*) AS n_markers, count(*) FILTER (cv > 0.5) AS n_variable,
  count(*) FILTER (cv > 0.5) >= 3 AS is_strong FROM h""")
def stress_verdict(spark, sf):
    return clean.stress_verdict(clean.stress_markers(named_features(spark, sf), ["red"]))


@query("transporter_scan", f"""WITH {_NAMED} SELECT DISTINCT feature_id FROM named
  WHERE regexp_matches(feature_id, '(?i)widget|bolt|gear')""")
def transporter_scan(spark, sf):
    return clean.keyword_features(named_features(spark, sf), ["widget", "bolt", "gear"])


@query("study_feasibility", """SELECT o_orderpriority, n, CASE WHEN n < 3 THEN 'infeasible' WHEN n < 4 THEN 'limited'
  WHEN NOT has_e OR NOT has_m THEN 'partial' ELSE 'feasible' END AS feasibility FROM (SELECT o_orderpriority, count(DISTINCT o_custkey % 10) AS n,
  bool_or(o_orderstatus = 'F') AS has_e, bool_or(o_totalprice > 499000) AS has_m FROM orders GROUP BY 1)""")
def study_feasibility(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count_distinct(F.col("o_custkey") % 10).alias("n"),
        F.bool_or(F.col("o_orderstatus") == "F").alias("e"),
        F.bool_or(F.col("o_totalprice") > 499000).alias("m"),
    )
    return g.select("o_orderpriority", "n", clean.feasibility(F.col("n"), F.col("e"), F.col("m")).alias("feasibility"))


@query("group_feasibility", f"""WITH {METAB}, {GRP}, z AS (SELECT grp, count(DISTINCT metab.sample_id) AS n FROM metab JOIN grp USING (sample_id) GROUP BY 1)
  SELECT sum(n)::BIGINT AS n_total, min(n) AS min_group, count(*) AS n_groups,
  CASE WHEN sum(n) < 5 OR min(n) < 3 THEN 'exploratory' ELSE 'standard' END AS feasibility FROM z""")
def group_feasibility(spark, sf):
    return clean.group_feasibility(metab(spark, sf), groups(spark, sf))


# --- normalisation ----------------------------------------------------------
_DENSE = """dense AS (SELECT f.feature_id, s.sample_id, e.value FROM (SELECT DISTINCT feature_id FROM expr) f
  CROSS JOIN (SELECT DISTINCT sample_id FROM expr) s LEFT JOIN expr e ON e.feature_id = f.feature_id AND e.sample_id = s.sample_id)"""


@query("impute_mean", f"""WITH {EXPR}, {_DENSE} SELECT feature_id, sample_id,
  round(coalesce(value, round(avg(value) OVER (PARTITION BY feature_id), 6), 0), 6) AS value FROM dense""")
def impute_mean(spark, sf):
    return clean.impute_mean(expr(spark, sf)).withColumn("value", R("value"))


@query("impute_zero", f"WITH {EXPR}, {_DENSE} SELECT feature_id, sample_id, coalesce(value, 0) AS value FROM dense")
def impute_zero(spark, sf):
    return clean.impute_zero(expr(spark, sf))


@query("log2_transform", f"WITH {EXPR} SELECT feature_id, sample_id, round(log2(greatest(value, 0) + 1), 6) AS value FROM expr")
def log2_transform(spark, sf):
    return clean.log2_transform(expr(spark, sf))


@query("z_score", f"""WITH {EXPR} SELECT feature_id, sample_id, round((value - avg(value) OVER w) /
  sqrt(greatest(var_pop(value) OVER w, 1e-10)), 6) AS value FROM expr WINDOW w AS (PARTITION BY feature_id)""")
def z_score(spark, sf):
    return clean.z_score(expr(spark, sf)).withColumn("value", R("value"))


@query("min_max", f"""WITH {EXPR} SELECT feature_id, sample_id, round((value - min(value) OVER w) /
  greatest(max(value) OVER w - min(value) OVER w, 1e-10), 6) AS value FROM expr WINDOW w AS (PARTITION BY feature_id)""")
def min_max(spark, sf):
    return clean.min_max(expr(spark, sf)).withColumn("value", R("value"))


@query("quantile_normalise", f"""WITH {EXPR}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY value) AS pos FROM expr),
  ref AS (SELECT pos, avg(value) AS ref FROM r GROUP BY 1) SELECT feature_id, sample_id,
  round(avg(ref) OVER (PARTITION BY sample_id, value), 4) AS value FROM r JOIN ref USING (pos)""")
def quantile_normalise(spark, sf):
    return clean.quantile_normalise(expr(spark, sf)).withColumn("value", R("value", 4))


_SF = """fullf AS (SELECT feature_id, avg(ln(value)) AS lg FROM expr WHERE value > 0 GROUP BY 1
    HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM expr)),
  med AS (SELECT sample_id, median(value / exp(lg)) AS raw FROM expr JOIN fullf USING (feature_id) GROUP BY 1),
  sfac AS (SELECT s.sample_id, CASE WHEN raw > 0 THEN raw / (SELECT avg(raw) FROM med WHERE raw > 0) ELSE 1.0 END AS size_factor
    FROM (SELECT DISTINCT sample_id FROM expr) s LEFT JOIN med USING (sample_id))"""


@query("size_factors", f"WITH {EXPR}, {_SF} SELECT sample_id, round(size_factor, 6) AS size_factor FROM sfac")
def size_factors(spark, sf):
    return clean.size_factors(expr(spark, sf)).withColumn("size_factor", R("size_factor"))


@query("log_counts", f"""WITH {EXPR}, {_SF} SELECT feature_id, sample_id, round(log2(value / size_factor + 1), 6) AS value
  FROM expr JOIN sfac USING (sample_id)""")
def log_counts(spark, sf):
    return clean.log_counts(expr(spark, sf)).withColumn("value", R("value"))


@query("log_fpkm", f"WITH {METAB} SELECT feature_id, sample_id, round(log2(value + 1e-6), 6) AS value FROM metab")
def log_fpkm(spark, sf):
    return clean.log_fpkm(metab(spark, sf)).withColumn("value", R("value"))


@query("preprocess_chain", f"""WITH {EXPR}, {_DENSE}, imp AS (SELECT feature_id, sample_id,
  coalesce(value, round(avg(value) OVER (PARTITION BY feature_id), 6), 0) AS value FROM dense),
  keep AS (SELECT feature_id FROM imp GROUP BY 1 HAVING count(*) FILTER (value > 0) / count(*) >= 0.5
    AND sum(value) / greatest(count(*) FILTER (value > 0), 1) >= 45000)
  SELECT feature_id, sample_id, round(log2(greatest(value, 0) + 1), 6) AS value FROM imp SEMI JOIN keep USING (feature_id)""")
def preprocess_chain(spark, sf):
    return clean.preprocess(expr(spark, sf), min_mean=45000.0)


@query("column_standardise", f"""WITH {METAB} SELECT feature_id, sample_id, round((value - avg(value) OVER w) /
  CASE WHEN stddev_samp(value) OVER w < 1e-10 THEN 1 ELSE stddev_samp(value) OVER w END, 6) AS value
  FROM metab WINDOW w AS (PARTITION BY feature_id)""")
def column_standardise(spark, sf):
    return clean.column_standardise(metab(spark, sf)).withColumn("value", R("value"))


# --- alignment ----------------------------------------------------------------
_KEY = lambda c: f"rtrim(regexp_replace(lower(trim({c})), '[\\s_\\-.]+', '_', 'g'), '_')"


@query("sample_key", f"""SELECT c_custkey, {_KEY("' ' || replace(c_name, '#', '-.') || '_ '")} AS sample_key FROM customer""")
def sample_key(spark, sf):
    odd = F.concat(F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("-.")), F.lit("_ "))
    return table(spark, sf, "customer").select("c_custkey", align.sample_key(odd).alias("sample_key"))


@query("align_blocks", f"""WITH {EXPR}, {METAB}, e AS (SELECT feature_id, {_KEY("sample_id")} AS sample_id, value FROM expr WHERE sample_id <> 'NATION_3'),
  m AS (SELECT feature_id, {_KEY("upper(replace(sample_id, '_', ' - '))")} AS sample_id, value FROM metab WHERE sample_id <> 'NATION_5'),
  c AS (SELECT DISTINCT sample_id FROM e INTERSECT SELECT DISTINCT sample_id FROM m)
  SELECT 'expr' AS block, sample_id, count(*) AS n, round(sum(value), 2) AS total FROM e SEMI JOIN c USING (sample_id) GROUP BY 2
  UNION ALL SELECT 'metab', sample_id, count(*), round(sum(value), 2) FROM m SEMI JOIN c USING (sample_id) GROUP BY 2""")
def align_blocks(spark, sf):
    e = expr(spark, sf).where("sample_id <> 'NATION_3'")
    m = metab(spark, sf).where("sample_id <> 'NATION_5'").withColumn(
        "sample_id", F.upper(F.replace("sample_id", F.lit("_"), F.lit(" - ")))
    )
    a, b = align.align_blocks(e, m)
    tot = lambda d, n: d.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), R(F.sum("value"), 2).alias("total")
    ).select(F.lit(n).alias("block"), "sample_id", "n", "total")
    return tot(a, "expr").unionByName(tot(b, "metab"))


@query("alignment_report", f"""WITH {EXPR}, {METAB}, p AS (SELECT DISTINCT lower(sample_id) AS sample_key, 'expr' AS source FROM expr WHERE sample_id <> 'NATION_3'
  UNION SELECT DISTINCT lower(sample_id), 'metab' FROM metab WHERE sample_id <> 'NATION_5'
  UNION SELECT lower(n_name), 'meta' FROM nation)
  SELECT sample_key, string_agg(source, ',' ORDER BY source) AS sources, CASE WHEN count(*) = 3 THEN 'common' ELSE 'dropped' END AS status
  FROM p GROUP BY 1""")
def alignment_report(spark, sf):
    return align.alignment_report(
        expr=expr(spark, sf).where("sample_id <> 'NATION_3'"),
        metab=metab(spark, sf).where("sample_id <> 'NATION_5'"),
        meta=table(spark, sf, "nation").select(F.col("n_name").alias("sample_id")),
    )


@query("infer_groups", """WITH s AS (SELECT DISTINCT c_mktsegment || '_' || (c_custkey % 4) AS sample_id FROM customer WHERE c_custkey > 0
  UNION SELECT DISTINCT 'lone' || n_regionkey || 'x' FROM nation WHERE n_regionkey = 1),
  g AS (SELECT sample_id, CASE WHEN regexp_matches(sample_id, '^.*[_\\-.]\\s*\\d+\\s*$') THEN regexp_extract(sample_id, '^(.*)[_\\-.]\\s*\\d+\\s*$', 1)
    ELSE sample_id END AS g FROM s), z AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM g)
  SELECT sample_id, CASE WHEN n >= 2 THEN g ELSE 'other' END AS grp FROM z""")
def infer_groups(spark, sf):
    a = table(spark, sf, "customer").where("c_custkey > 0").select(
        F.concat_ws("_", "c_mktsegment", (F.col("c_custkey") % 4).cast("string")).alias("sample_id")
    )
    b = table(spark, sf, "nation").where("n_regionkey = 1").select(
        F.concat(F.lit("lone"), F.col("n_regionkey").cast("string"), F.lit("x")).alias("sample_id")
    )
    return align.infer_groups(a.unionByName(b))


@query("metadata_groups", """WITH m AS (SELECT c_custkey::VARCHAR AS sample_id, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END AS condition,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'T' || c_nationkey END AS tissue, 'x' AS treatment FROM customer)
  SELECT sample_id, coalesce(nullif(trim(condition), ''), nullif(trim(tissue), ''), nullif(trim(treatment), '')) AS grp FROM m""")
def metadata_groups(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    meta = c.select(
        k.cast("string").alias("sample_id"),
        F.when(k % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("condition"),
        F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("T"), F.col("c_nationkey").cast("string"))).alias("tissue"),
        F.lit("x").alias("treatment"),
    )
    return align.groups_from_metadata(meta.select("sample_id"), meta)


@query("collapse_replicates", f"WITH {EVT} SELECT feature_id, sample_id, round(avg(value), 6) AS value FROM evt GROUP BY 1, 2")
def collapse_replicates(spark, sf):
    return align.collapse_replicates(events_long(spark, sf)).withColumn("value", R("value"))


@query("pair_blocks", f"""WITH {EXPR}, {METAB}, b AS (SELECT 'expr' AS block, * FROM expr WHERE sample_id <> 'NATION_3' UNION ALL SELECT 'metab', * FROM metab),
  pr AS (SELECT sample_id FROM b GROUP BY 1 HAVING count(DISTINCT block) = 2), k AS (SELECT * FROM b SEMI JOIN pr USING (sample_id)),
  ok AS (SELECT block, feature_id FROM k GROUP BY 1, 2 HAVING 1 - count(value) / (SELECT count(*) FROM pr) <= 0.2)
  SELECT block, feature_id, sample_id, value FROM k SEMI JOIN ok USING (block, feature_id)""")
def pair_blocks(spark, sf):
    out = align.pair_blocks(expr(spark, sf).where("sample_id <> 'NATION_3'"), metab(spark, sf))
    return out.withColumn("value", R("value", 2))


# --- differential tests ---------------------------------------------------------
_LOG = "lg AS (SELECT feature_id, sample_id, log2(value + 1) AS value FROM expr)"
_MOM = """mom AS (SELECT feature_id, grp, count(value) AS n, avg(value) AS mean, var_samp(value) AS var
  FROM lg JOIN grp USING (sample_id) GROUP BY 1, 2 HAVING count(value) >= 2)"""
_AOV = f"""a0 AS (SELECT feature_id, count(*) AS k, sum(n) AS nt, sum(n * mean) AS s1, sum((n - 1) * var) AS ssw,
    max(mean) - min(mean) AS max_log2fc FROM mom GROUP BY 1 HAVING count(*) >= 2),
  a1 AS (SELECT a0.feature_id, any_value(k)::INT AS k, any_value(nt)::INT AS nt, any_value(ssw) AS ssw, any_value(max_log2fc) AS max_log2fc,
    sum(n * (mean - s1 / nt) ^ 2) AS ssb FROM a0 JOIN mom USING (feature_id) GROUP BY 1),
  a2 AS (SELECT *, (k - 1) AS df1, (nt - k) AS df2, (ssb / (k - 1)) / (ssw / (nt - k)) AS f_stat, ssb / (ssb + ssw) AS effect_size FROM a1),
  aov AS (SELECT feature_id, k, nt, df1, df2, f_stat, effect_size, max_log2fc, {sql_f_tail('f_stat', 'df1', 'df2')} AS p_value FROM a2)"""
_BASE = f"{EXPR}, {GRP}, {_LOG}, {_MOM}"


def _logged(spark, sf):
    return expr(spark, sf).withColumn("value", F.log2(F.col("value") + 1.0))


@query("group_moments", f"WITH {_BASE} SELECT feature_id, grp, n, round(mean, 6) AS mean, round(var, 6) AS var FROM mom")
def group_moments(spark, sf):
    return stats.group_moments(_logged(spark, sf), groups(spark, sf)).withColumns({"mean": R("mean"), "var": R("var")})


@query("prior_variance", f"""WITH {EXPR}, {_LOG}, v AS (SELECT var_samp(value) AS v FROM lg GROUP BY feature_id
  HAVING count(value) >= 3 AND var_samp(value) > 0) SELECT round(median(v), 6) AS prior_variance FROM v""")
def prior_variance(spark, sf):
    return spark.range(1).select(R(stats.prior_variance(_logged(spark, sf))).alias("prior_variance"))


@query("pooled_variance", f"WITH {EXPR}, {_LOG} SELECT round(var_samp(value), 6) AS pooled_variance FROM lg")
def pooled_variance(spark, sf):
    return spark.range(1).select(R(stats.pooled_variance(_logged(spark, sf))).alias("pooled_variance"))


@query("anova", f"""WITH {_BASE}, {_AOV} SELECT feature_id, df1, df2, round(f_stat, 6) AS f_stat, round(effect_size, 6) AS effect_size,
  round(max_log2fc, 6) AS max_log2fc, round(p_value, 6) AS p_value FROM aov""")
def anova(spark, sf):
    res = stats.anova(stats.group_moments(_logged(spark, sf), groups(spark, sf)))
    return res.select(
        "feature_id", F.col("df1").cast("int"), F.col("df2").cast("int"),
        *[R(c).alias(c) for c in ("f_stat", "effect_size", "max_log2fc", "p_value")],
    )


_KW = f"""kc AS (SELECT * FROM (SELECT lg.*, grp, count(*) OVER (PARTITION BY feature_id, grp) AS gn FROM lg JOIN grp USING (sample_id)) WHERE gn >= 2),
  kr AS (SELECT *, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS rk,
    count(*) OVER (PARTITION BY feature_id, value) AS t FROM kc),
  kg AS (SELECT feature_id, grp, sum(rk) AS r, count(*) AS n, sum(t * t - 1) AS tie FROM kr GROUP BY 1, 2),
  kh AS (SELECT feature_id, count(*) - 1 AS df, sum(n) AS n, sum(r * r / n) AS s, sum(tie) AS tie FROM kg GROUP BY 1 HAVING count(*) >= 2),
  kw AS (SELECT feature_id, df::INT AS df, (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - tie / (n * n * n - n)) AS h_stat FROM kh)"""


@query("kruskal_wallis", f"""WITH {_BASE}, {_KW} SELECT feature_id, round(h_stat, 6) AS h_stat, df, round({sql_chi2_tail('h_stat', 'df')}, 6) AS p_kw FROM kw""")
def kruskal_wallis(spark, sf):
    return stats.kruskal_wallis(_logged(spark, sf), groups(spark, sf)).select(
        "feature_id", R("h_stat").alias("h_stat"), F.col("df").cast("int").alias("df"), R("p_kw").alias("p_kw")
    )


@query("deg_multigroup", f"""WITH {_BASE}, {_AOV}, {_KW}, q AS ({sql_bh('aov', 'p_value')}),
  f AS (SELECT *, q_raw < 0.05 AND max_log2fc >= 0.5 AS is_fdr_sig FROM q)
  SELECT feature_id, round(f_stat, 6) AS f_stat, round(effect_size, 6) AS effect_size, round(max_log2fc, 6) AS max_log2fc,
  round(p_value, 6) AS p_value, round(q_raw, 6) AS q_value, is_fdr_sig, {sql_chi2_tail('h_stat', 'df')} > 0.05 AND p_value < 0.01 AS kw_disagrees,
  round(CASE WHEN is_fdr_sig THEN least(1.0, effect_size / 2 + 0.3) ELSE least(0.7, effect_size / 2) END, 6) AS score
  FROM f LEFT JOIN kw USING (feature_id)""")
def deg_multigroup(spark, sf):
    res = stats.deg_multigroup(_logged(spark, sf), groups(spark, sf))
    return res.select(
        "feature_id", "is_fdr_sig", "kw_disagrees",
        *[R(c).alias(c) for c in ("f_stat", "effect_size", "max_log2fc", "p_value", "q_value", "score")],
    )


@query("deg_prefiltered_fdr", f"""WITH {_BASE}, {_AOV}, pf AS (SELECT feature_id, p_value FROM aov WHERE p_value < 0.5), q AS ({sql_bh('pf', 'p_value')})
  SELECT feature_id, round(coalesce(q_raw, 1.0), 6) AS q_value FROM aov LEFT JOIN q USING (feature_id)""")
def deg_prefiltered_fdr(spark, sf):
    res = stats.deg_multigroup(_logged(spark, sf), groups(spark, sf), fdr_scope="prefiltered", with_kw=False)
    return res.select("feature_id", R("q_value").alias("q_value"))


@query("deg_top_effects", f"""WITH {_BASE}, {_AOV} SELECT feature_id, round(effect_size, 6) AS effect_size FROM aov
  ORDER BY round(effect_size, 9) DESC, feature_id LIMIT 50""")
def deg_top_effects(spark, sf):
    res = stats.anova(stats.group_moments(_logged(spark, sf), groups(spark, sf)))
    res = res.withColumn("effect_size", R("effect_size", 9))
    return stats.top_effects(res, 50).select("feature_id", R("effect_size").alias("effect_size"))


@query("low_effect_prefilter", f"""WITH {_BASE}, {_AOV} SELECT feature_id, round(effect_size, 6) AS effect_size FROM aov
  WHERE effect_size >= greatest((SELECT quantile_cont(effect_size, 0.1) FROM aov), 1e-6) - 1e-12""")
def low_effect_prefilter(spark, sf):
    res = stats.anova(stats.group_moments(_logged(spark, sf), groups(spark, sf)))
    return clean.drop_low_effect(res.select("feature_id", "effect_size")).withColumn("effect_size", R("effect_size"))


_PAIRS2 = """w2 AS (SELECT feature_id, a.n AS n_a, b.n AS n_b, a.mean AS mean_a, b.mean AS mean_b, a.var AS var_a, b.var AS var_b
  FROM (SELECT * FROM mom WHERE grp = 'ASIA') a JOIN (SELECT * FROM mom WHERE grp = 'EUROPE') b USING (feature_id))"""
_PV2 = """pv AS (SELECT median(v) AS pv FROM (SELECT var_samp(value) AS v FROM lg JOIN grp USING (sample_id) WHERE grp IN ('ASIA', 'EUROPE')
  GROUP BY feature_id HAVING count(value) >= 3 AND var_samp(value) > 0))"""
_MODT = lambda src: f"""t0 AS (SELECT *, n_a + n_b - 2 AS dfg, ((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2) AS vg FROM {src}),
  t1 AS (SELECT *, (3 * pv + dfg * vg) / (3 + dfg) AS post FROM t0, pv),
  t2 AS (SELECT *, mean_b - mean_a AS log2fc, (mean_b - mean_a) / sqrt(post * (1.0 / n_a + 1.0 / n_b)) AS t_stat, (mean_b - mean_a) / sqrt(vg) AS cohens_d, (dfg + 3)::INT AS df FROM t1),
  t3 AS (SELECT *, {sql_t_two_sided('t_stat', 'df')} AS p_value FROM t2)"""


@query("deg_two_group", f"""WITH {_BASE}, {_PAIRS2}, {_PV2}, {_MODT('w2')}, q AS ({sql_bh('t3', 'p_value')})
  SELECT feature_id, round(log2fc, 6) AS log2fc, round(t_stat, 6) AS t_stat, round(cohens_d, 6) AS cohens_d,
  round(p_value, 6) AS p_value, round(q_raw, 6) AS q_value FROM q""")
def deg_two_group(spark, sf):
    res = stats.deg_two_group(_logged(spark, sf), groups(spark, sf), "ASIA", "EUROPE")
    return res.select("feature_id", *[R(c).alias(c) for c in ("log2fc", "t_stat", "cohens_d", "p_value", "q_value")])


@query("welch_test", f"""WITH {EXPR}, {GRP}, lg AS (SELECT * FROM expr), {_MOM}, {_PAIRS2}
  SELECT feature_id, round((mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b), 6) AS t_stat,
  round((var_a / n_a + var_b / n_b) ^ 2 / ((var_a / n_a) ^ 2 / (n_a - 1) + (var_b / n_b) ^ 2 / (n_b - 1)), 6) AS df,
  round(log2(mean_b / greatest(mean_a, 1e-10)), 6) AS log2fc FROM w2""")
def welch_test(spark, sf):
    res = stats.welch_test(expr(spark, sf), groups(spark, sf), "ASIA", "EUROPE")
    return res.select("feature_id", *[R(c).alias(c) for c in ("t_stat", "df", "log2fc")])


_MLOG = "lg AS (SELECT feature_id, sample_id, log2(value + 1) AS value FROM metab)"
_PVM = """pv AS (SELECT median(v) AS pv FROM (SELECT var_samp(value) AS v FROM lg GROUP BY feature_id HAVING count(value) >= 3 AND var_samp(value) > 0))"""


@query("dam_pairwise", f"""WITH {METAB}, {GRP}, {_MLOG}, {_MOM}, {_AOV}, {_PVM},
  w2 AS (SELECT feature_id, a.grp AS group_a, b.grp AS group_b, a.n AS n_a, b.n AS n_b, a.mean AS mean_a, b.mean AS mean_b,
    a.var AS var_a, b.var AS var_b FROM mom a JOIN mom b USING (feature_id) WHERE a.grp < b.grp
    AND feature_id IN (SELECT feature_id FROM aov WHERE p_value < 0.5)), {_MODT('w2')}, q AS ({sql_bh('t3', 'p_value')})
  SELECT feature_id, group_a, group_b, round(log2fc, 6) AS log2fc, round(t_stat, 6) AS t_stat, round(p_value, 6) AS p_value,
  round(q_raw, 6) AS q_value, CASE WHEN log2fc > 0 THEN 'up' WHEN log2fc < 0 THEN 'down' ELSE 'unchanged' END AS direction FROM q""")
def dam_pairwise(spark, sf):
    m = metab(spark, sf).withColumn("value", F.log2(F.col("value") + 1.0))
    res = stats.dam_pairwise(m, groups(spark, sf), alpha=0.5)
    return res.select(
        "feature_id", "group_a", "group_b", "direction",
        *[R(c).alias(c) for c in ("log2fc", "t_stat", "p_value", "q_value")],
    )


@query("volcano_table", f"""WITH {_BASE}, {_PAIRS2}, {_PV2}, {_MODT('w2')}, q AS ({sql_bh('t3', 'p_value')})
  SELECT feature_id, round(log2fc, 6) AS log2fc, round(-log10(greatest(q_raw, 1e-300)), 6) AS neg_log10_q,
  CASE WHEN q_raw < 0.9 AND log2fc >= 1 THEN 'up' WHEN q_raw < 0.9 AND log2fc <= -1 THEN 'down' ELSE 'ns' END AS label FROM q""")
def volcano_table(spark, sf):
    res = stats.deg_two_group(_logged(spark, sf), groups(spark, sf), "ASIA", "EUROPE")
    return stats.volcano(res, alpha=0.9).withColumns({"log2fc": R("log2fc"), "neg_log10_q": R("neg_log10_q")})


_CONTRAST = f"""WITH {EXPR}, {METAB}, {GRP}, e AS (SELECT 'P' AS b, feature_id, grp, avg(log2(value + 1)) AS m, count(*) AS n FROM expr JOIN grp USING (sample_id) GROUP BY 1, 2, 3
  UNION ALL SELECT 'M', feature_id, grp, avg(log2(value + 1)), count(*) FROM metab JOIN grp USING (sample_id) GROUP BY 1, 2, 3),
  c AS (SELECT x.b, x.feature_id, y.m - x.m AS lfc FROM e x JOIN e y ON x.feature_id = y.feature_id AND x.b = y.b
    WHERE x.grp = 'ASIA' AND y.grp = 'EUROPE' AND x.n >= 2 AND y.n >= 2),
  pr AS (SELECT g.feature_id AS gene_id, m.feature_id AS metabolite, g.lfc AS gl, m.lfc AS ml FROM c g JOIN c m
    ON m.b = 'M' AND g.b = 'P' AND m.feature_id = 'M' || (substr(g.feature_id, 2)::BIGINT % 100))"""


def _contrast_pairs(spark, sf):
    """Gene/metabolite pairs for direction rules: part p with supplier p % 100."""
    lg = lambda d: d.withColumn("value", F.log2(F.col("value") + 1.0))
    g = stats.signed_contrast(lg(expr(spark, sf)), groups(spark, sf), "ASIA", "EUROPE").select(
        F.col("feature_id").alias("gene_id"), F.col("log2fc").alias("gl"),
        F.concat(F.lit("M"), (F.substring("feature_id", 2, 20).cast("bigint") % 100).cast("string")).alias("metabolite"),
    )
    m = stats.signed_contrast(lg(metab(spark, sf)), groups(spark, sf), "ASIA", "EUROPE").select(
        F.col("feature_id").alias("metabolite"), F.col("log2fc").alias("ml")
    )
    return g.join(m, "metabolite")


@query("quadrant_four", _CONTRAST + """ SELECT gene_id, metabolite, CASE WHEN gl >= 0 AND ml >= 0 THEN 'Q1' WHEN gl >= 0 THEN 'Q4'
  WHEN ml >= 0 THEN 'Q2' ELSE 'Q3' END AS quadrant FROM pr""")
def quadrant_four(spark, sf):
    return _contrast_pairs(spark, sf).select("gene_id", "metabolite", stats.quadrant(F.col("gl"), F.col("ml")).alias("quadrant"))


@query("quadrant_nine", _CONTRAST + """ SELECT quadrant, count(*) AS n FROM (SELECT CASE
  WHEN gl > 0.5 THEN CASE WHEN ml > 0.5 THEN 'Q1' WHEN ml < -0.5 THEN 'Q4' ELSE 'Q5' END
  WHEN gl < -0.5 THEN CASE WHEN ml > 0.5 THEN 'Q2' WHEN ml < -0.5 THEN 'Q3' ELSE 'Q7' END
  ELSE CASE WHEN ml > 0.5 THEN 'Q8' WHEN ml < -0.5 THEN 'Q6' ELSE 'Q9' END END AS quadrant FROM pr) GROUP BY 1""")
def quadrant_nine(spark, sf):
    return (
        _contrast_pairs(spark, sf).groupBy(stats.quadrant(F.col("gl"), F.col("ml"), 0.5).alias("quadrant"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("synchronicity", _CONTRAST + """, s AS (SELECT count(*) AS n_pairs, count(*) FILTER ((gl >= 0) = (ml >= 0)) / count(*) AS y FROM pr)
  SELECT n_pairs, round(y, 6) AS synchronicity, CASE WHEN y >= 0.6 THEN 'strong' WHEN y >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM s""")
def synchronicity(spark, sf):
    q = _contrast_pairs(spark, sf).select(stats.quadrant(F.col("gl"), F.col("ml")).alias("quadrant"))
    return stats.quadrant_summary(q).withColumn("synchronicity", R("synchronicity"))


@query("tau_specificity", f"""WITH {EXPR}, {GRP}, m AS (SELECT feature_id, grp, avg(value) AS x FROM expr JOIN grp USING (sample_id) GROUP BY 1, 2),
  t AS (SELECT feature_id, count(*) AS n_tissues, arg_max(grp, x) AS top_tissue, (count(*) - sum(x) / max(x)) / (count(*) - 1) AS tau
    FROM m GROUP BY 1 HAVING count(*) >= 2 AND max(x) > 0)
  SELECT feature_id, n_tissues, top_tissue, round(tau, 6) AS tau, CASE WHEN tau >= 0.8 AND top_tissue IN ('ASIA', 'EUROPE') THEN 0.9
  WHEN tau >= 0.5 AND top_tissue IN ('ASIA', 'EUROPE') THEN 0.65 WHEN tau >= 0.8 THEN 0.4 ELSE 0.2 END::DOUBLE AS score FROM t""")
def tau_specificity(spark, sf):
    t = stats.tau_index(expr(spark, sf), groups(spark, sf))
    score = stats.tissue_score(F.col("tau"), F.col("top_tissue").isin("ASIA", "EUROPE"))
    return t.withColumn("score", score).withColumn("tau", R("tau"))


@query("expressed_sets", f"""WITH {EXPR}, {GRP} SELECT grp, count(DISTINCT feature_id) AS n_features FROM expr JOIN grp USING (sample_id)
  WHERE value > 0 GROUP BY 1""")
def expressed_sets(spark, sf):
    return stats.expressed_sets(expr(spark, sf), groups(spark, sf))


@query("expressed_overlap", f"""WITH {EXPR}, {GRP}, s AS (SELECT feature_id, array_to_string(list_sort(list(DISTINCT grp)), '+') AS region
  FROM expr JOIN grp USING (sample_id) WHERE value > 0 GROUP BY 1) SELECT region, count(*) AS n_features FROM s GROUP BY 1""")
def expressed_overlap(spark, sf):
    return stats.expressed_overlap(expr(spark, sf), groups(spark, sf))


# --- order statistics on hot groups ------------------------------------------------
@query("average_ranks", """SELECT event_type, event_id, rank() OVER (PARTITION BY event_type ORDER BY value)
  + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rnk FROM events""")
def average_ranks_query(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "event_id", "value")
    return average_ranks(ev, ["event_type"], "value").select("event_type", "event_id", "rnk")


@query("exact_quantiles", """SELECT event_type, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY 1""")
def exact_quantiles(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "value")
    return exact_quantile(ev, ["event_type"], "value", 0.9, "q90").withColumn("q90", R("q90"))


@query("benjamini_hochberg", f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_returnflag, (l_discount * 10 + l_tax) / 1.1 AS p_value FROM lineitem), q AS ({sql_bh('p', 'p_value', 'l_returnflag')})
  SELECT l_orderkey, l_linenumber, round(q_raw, 6) AS q_value FROM q""")
def bh_query(spark, sf):
    p = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        ((F.col("l_discount") * 10 + F.col("l_tax")) / 1.1).alias("p_value"),
    )
    return benjamini_hochberg(p, "p_value", ["l_returnflag"]).select("l_orderkey", "l_linenumber", R("q_value").alias("q_value"))
