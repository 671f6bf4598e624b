"""Queries for correlation, networks, modules and latent components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from omiclattice.functions.materialise import settle
from omiclattice.operators import clean, communities, corr, latent, network
from omiclattice.plans.matrix_queries import R
from omiclattice.plans.registry import query
from omiclattice.plans.views import (
    EXPR, METAB, VEC, expr, metab, sql_bh, sql_t_two_sided, table, vectors,
)

# correlation of embedding vectors in SQL: unit rows, dot products
_UNIT = lambda src, name="unit": f"""{name} AS (SELECT feature_id, sample_id, c / sqrt(sum(c * c) OVER (PARTITION BY feature_id)) AS z
  FROM (SELECT feature_id, sample_id, value - avg(value) OVER (PARTITION BY feature_id) AS c FROM {src}))"""
_PAIR = """pr AS (SELECT a.feature_id AS feature_a, b.feature_id AS feature_b, sum(a.z * b.z) AS r, count(*) AS n
  FROM unit a JOIN unit b ON a.sample_id = b.sample_id AND a.feature_id < b.feature_id GROUP BY 1, 2)"""
_P = lambda r="r", df="n - 2": sql_t_two_sided(f"({r} * sqrt(({df}) / (1 - {r} * {r} + 1e-15)))", f"({df})")
_VPAIR = f"{VEC}, {_UNIT('vecl')}, {_PAIR}"


def _unit(spark, sf, method="pearson"):
    return corr.unit_vectors(vectors(spark, sf), method)


def _pairs_out(df):
    return df.select("feature_a", "feature_b", R("r").alias("r"), R("p_value").alias("p_value"))


@query("pearson_pairs", f"WITH {_VPAIR} SELECT feature_a, feature_b, round(r, 6) AS r, round({_P()}, 6) AS p_value FROM pr WHERE abs(r) >= 0.25 - 1e-12")
def pearson_pairs(spark, sf):
    return _pairs_out(corr.correlated_pairs(_unit(spark, sf), min_abs_r=0.25))


_RANKED = """rk AS (SELECT feature_id, sample_id, rank() OVER (PARTITION BY feature_id ORDER BY value)
  + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS value FROM vecl)"""


@query("spearman_pairs", f"WITH {VEC}, {_RANKED}, {_UNIT('rk')}, {_PAIR} SELECT feature_a, feature_b, round(r, 6) AS r, round({_P()}, 6) AS p_value FROM pr WHERE abs(r) >= 0.25 - 1e-12")
def spearman_pairs(spark, sf):
    return _pairs_out(corr.correlated_pairs(_unit(spark, sf, "spearman"), min_abs_r=0.25))


_BI = """md AS (SELECT feature_id, median(value) AS med FROM vecl GROUP BY 1),
  mad AS (SELECT feature_id, any_value(med) AS med, median(abs(value - med)) + 1e-10 AS mad FROM vecl JOIN md USING (feature_id) GROUP BY 1),
  wt AS (SELECT feature_id, sample_id, value - med AS c, CASE WHEN abs((value - med) / (9 * mad)) < 1
    THEN (1 - ((value - med) / (9 * mad)) ^ 2) ^ 2 ELSE 0 END AS w FROM vecl JOIN mad USING (feature_id))"""


@query("bicor_pairs", f"""WITH {VEC}, {_BI}, unit AS (SELECT feature_id, sample_id, c * w / sqrt(sum(c * w * c * w) OVER (PARTITION BY feature_id)) AS z FROM wt), {_PAIR}
  SELECT feature_a, feature_b, round(r, 6) AS r, round({_P()}, 6) AS p_value FROM pr WHERE abs(r) >= 0.25 - 1e-12""")
def bicor_pairs(spark, sf):
    return _pairs_out(corr.correlated_pairs(_unit(spark, sf, "bicor"), min_abs_r=0.25))


@query("bicor_linear_pairs", f"""WITH {VEC}, {_BI}, unit AS (SELECT feature_id, sample_id, c * w / sqrt(sum(c * w * c) OVER (PARTITION BY feature_id)) AS z FROM wt), {_PAIR}
  SELECT feature_a, feature_b, round(r, 6) AS r, round({_P()}, 6) AS p_value FROM pr WHERE abs(r) >= 0.25 - 1e-12""")
def bicor_linear_pairs(spark, sf):
    return _pairs_out(corr.correlated_pairs(_unit(spark, sf, "bicor_linear"), min_abs_r=0.25))


# two dependent blocks: revenue and quantity of each brand and type per nation
_BRAND = """br AS (SELECT p_brand || '/' || p_type AS b, n_name AS sample_id, round(sum(l_extendedprice), 2) AS rev, round(sum(l_quantity), 2) AS qty
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY p_brand, p_type, n_name),
  bl0 AS (SELECT 'R:' || b AS feature_id, sample_id, rev AS value FROM br UNION ALL SELECT 'Q:' || b, sample_id, qty FROM br),
  bl AS (SELECT * FROM bl0 WHERE feature_id IN (SELECT feature_id FROM bl0 GROUP BY 1 HAVING count(*) = 25))"""
_BPAIR = f"{_BRAND}, {_UNIT('bl')}, {_PAIR}"


def brand_vectors(spark, sf):
    from omiclattice.plans.views import _lines

    part = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("b"))
    cells = (
        _lines(spark, sf, "l_partkey", "l_extendedprice", "l_quantity")
        .join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("b", "n_name")
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("rev"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    )
    long = settle(cells.select(
        F.col("n_name").alias("sample_id"), "b", F.explode(F.array(
            F.struct(F.lit("R:").alias("k"), F.col("rev").alias("value")),
            F.struct(F.lit("Q:").alias("k"), F.col("qty").alias("value")),
        )).alias("c"),
    ).select(F.concat("c.k", "b").alias("feature_id"), "sample_id", "c.value"))
    return clean.to_vectors(long)


@query("correlation_screen", f"""WITH {_BPAIR}, pp AS (SELECT *, {_P()} AS p FROM pr), q AS ({sql_bh('pp', 'p')})
  SELECT feature_a, feature_b, round(r, 6) AS r, round(q_raw, 6) AS q_value FROM q WHERE abs(r) >= 0.5 AND q_raw < 0.05""")
def correlation_screen(spark, sf):
    u = corr.unit_vectors(brand_vectors(spark, sf))
    return corr.correlation_screen(u, min_abs_r=0.5).select("feature_a", "feature_b", R("r").alias("r"), R("q_value").alias("q_value"))


@query("correlation_screen_prefiltered", f"""WITH {_VPAIR}, pp AS (SELECT *, {_P()} AS p FROM pr WHERE abs(r) >= 0.25 - 1e-12), q AS ({sql_bh('pp', 'p')})
  SELECT feature_a, feature_b, round(r, 6) AS r, round(q_raw, 6) AS q_value FROM q WHERE q_raw < 0.05""")
def correlation_screen_prefiltered(spark, sf):
    res = corr.correlation_screen(_unit(spark, sf), min_abs_r=0.25, fdr_scope="prefiltered")
    return res.select("feature_a", "feature_b", R("r").alias("r"), R("q_value").alias("q_value"))


# gene x metabolite blocks: vectors of the two label halves play the two blocks
_TWO = f"""{VEC}, {_UNIT('vecl')}, lab AS (SELECT 'V' || vec_id AS feature_id, label FROM embeddings),
  pr AS (SELECT a.feature_id AS feature_a, b.feature_id AS feature_b, sum(a.z * b.z) AS r, count(*) AS n
    FROM (SELECT u.*, label FROM unit u JOIN lab USING (feature_id) WHERE label < 5) a JOIN
    (SELECT u.*, label FROM unit u JOIN lab USING (feature_id) WHERE label >= 5) b ON a.sample_id = b.sample_id GROUP BY 1, 2)"""


def _two_blocks(spark, sf, method="pearson"):
    lab = table(spark, sf, "embeddings").select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("feature_id"), "label"
    )
    u = settle(_unit(spark, sf, method).join(lab, "feature_id"))
    return u.where("label < 5").drop("label"), u.where("label >= 5").drop("label")


@query("block_pair_screen", f"""WITH {_BRAND}, {_UNIT('bl')}, pr AS (SELECT a.feature_id AS feature_a, b.feature_id AS feature_b, sum(a.z * b.z) AS r, count(*) AS n
    FROM unit a JOIN unit b ON a.sample_id = b.sample_id AND a.feature_id LIKE 'R:%' AND b.feature_id LIKE 'Q:%' GROUP BY 1, 2),
  pp AS (SELECT *, {_P()} AS p FROM pr), q AS ({sql_bh('pp', 'p')})
  SELECT feature_a, feature_b, round(r, 6) AS r, round(q_raw, 6) AS q_value FROM q WHERE abs(r) >= 0.8 AND q_raw < 0.05""")
def block_pair_screen(spark, sf):
    u = settle(corr.unit_vectors(brand_vectors(spark, sf)))
    a, b = u.where("feature_id LIKE 'R:%'"), u.where("feature_id LIKE 'Q:%'")
    return corr.correlation_screen(a, b).select("feature_a", "feature_b", R("r").alias("r"), R("q_value").alias("q_value"))


@query("anchor_scoped_fdr", f"""WITH {_TWO}, pp AS (SELECT *, {_P()} AS p FROM pr WHERE abs(r) >= 0.2 - 1e-12), q AS ({sql_bh('pp', 'p', 'feature_b')})
  SELECT feature_a, feature_b, round(r, 6) AS r, round(q_raw, 6) AS q_value FROM q""")
def anchor_scoped_fdr(spark, sf):
    a, b = _two_blocks(spark, sf)
    res = corr.scoped_fdr(a, b, min_abs_r=0.2)
    return res.select("feature_a", "feature_b", R("r").alias("r"), R("q_value").alias("q_value"))


@query("top_pairs", f"""WITH {_TWO} SELECT feature_a, feature_b, round(r, 6) AS r FROM pr ORDER BY round(abs(r), 9) DESC, feature_a, feature_b LIMIT 30""")
def top_pairs(spark, sf):
    a, b = _two_blocks(spark, sf)
    pairs = corr.correlated_pairs(a, b, top=30, p_values=False)
    return pairs.orderBy(F.desc(F.round(F.abs("r"), 9)), "feature_a", "feature_b").limit(30).select("feature_a", "feature_b", R("r").alias("r"))


@query("profile_modules", f"""WITH {_TWO}, m AS (SELECT feature_a, avg(r) AS mean_r FROM pr GROUP BY 1)
  SELECT feature_a AS feature_id, round(mean_r, 6) AS mean_r, CASE WHEN mean_r > 0.002 THEN 'positive' WHEN mean_r < -0.002 THEN 'negative' END AS module
  FROM m WHERE abs(mean_r) > 0.002""")
def profile_modules(spark, sf):
    a, b = _two_blocks(spark, sf)
    m = corr.mean_profiles(a, b).select(F.col("feature_id").alias("feature_a"), F.col("mean_r").alias("r"))
    return corr.profile_modules(m, 0.002).select(F.col("feature_a").alias("feature_id"), R("mean_r").alias("mean_r"), "module")


@query("partial_correlation", f"""WITH {VEC}, res AS (SELECT feature_id, sample_id, value - avg(value) OVER (PARTITION BY feature_id, sample_id % 4) AS value FROM vecl),
  {_UNIT('res')}, {_PAIR} SELECT feature_a, feature_b, round(r, 6) AS r, round({_P('r', 'n - 5')}, 6) AS p_value FROM pr WHERE abs(r) >= 0.25 - 1e-12""")
def partial_correlation(spark, sf):
    """Covariate: a four-level batch label on the 64 dimensions."""
    dims = [str(i) for i in range(table(spark, sf, "embeddings").select(F.max(F.size("embedding"))).first()[0])]
    batch = np.array([[float(int(d) % 4 == k) for k in (1, 2, 3)] for d in dims])
    clean_vec = corr.residual_vectors(vectors(spark, sf), batch)
    return _pairs_out(corr.correlated_pairs(corr.unit_vectors(clean_vec), min_abs_r=0.25, lost_df=3))


@query("sample_correlation", f"""WITH {EXPR} SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, count(*) AS n, round(corr(a.value, b.value), 6) AS r
  FROM expr a JOIN expr b ON a.feature_id = b.feature_id AND a.sample_id < b.sample_id GROUP BY 1, 2""")
def sample_correlation(spark, sf):
    e = settle(expr(spark, sf))
    axis = clean.sample_list(e)
    return corr.sample_correlation(clean.to_vectors(e, axis), axis).withColumn("r", R("r"))


_SPW = f"""{EXPR}, {METAB}, cm AS (SELECT e.feature_id AS feature_a, m.feature_id AS feature_b, e.value AS x, m.value AS y
    FROM expr e JOIN metab m USING (sample_id)),
  rr AS (SELECT feature_a, feature_b, rank() OVER wx + (count(*) OVER tx - 1) / 2.0 AS rx, rank() OVER wy + (count(*) OVER ty - 1) / 2.0 AS ry FROM cm
    WINDOW wx AS (PARTITION BY feature_a, feature_b ORDER BY x), wy AS (PARTITION BY feature_a, feature_b ORDER BY y),
    tx AS (PARTITION BY feature_a, feature_b, x), ty AS (PARTITION BY feature_a, feature_b, y)),
  sp AS (SELECT feature_a, feature_b, corr(rx, ry) AS r, count(*)::INT AS n FROM rr GROUP BY 1, 2 HAVING count(*) >= 3)"""


@query("network_edges", f"""WITH {_SPW}, pp AS (SELECT *, {_P()} AS p FROM sp WHERE abs(r) >= 0.7 - 1e-12), q AS ({sql_bh('pp', 'p')})
  SELECT feature_a AS src, feature_b AS dst, round(r, 6) AS rho, round(p, 6) AS p_value, round(q_raw, 6) AS q_value FROM q WHERE p < 0.05 AND q_raw < 0.05""")
def network_edges(spark, sf):
    return gene_metabolite_edges(spark, sf).select(
        "src", "dst", R("rho").alias("rho"), R("p_value").alias("p_value"), R("q_value").alias("q_value")
    )


def gene_metabolite_edges(spark, sf, min_abs_rho=0.7):
    """Significant Spearman edges between parts and suppliers (pairwise samples)."""
    from omiclattice.functions.ranks import benjamini_hochberg

    e, m = settle(expr(spark, sf)), settle(metab(spark, sf))
    axis = clean.sample_list(e)
    pairs = corr.spearman_pairwise(clean.to_vectors(e, axis), clean.to_vectors(m, axis), min_abs_rho)
    q = benjamini_hochberg(pairs, "p_value").where("p_value < 0.05 AND q_value < 0.05")
    return q.select(
        F.col("feature_a").alias("src"), F.col("feature_b").alias("dst"), F.col("r").alias("rho"),
        "p_value", "q_value",
    )


# --- graph measures on the embedding network -------------------------------------------
THR = 0.3
_EDGES = f"{_VPAIR}, ed AS (SELECT feature_a AS src, feature_b AS dst, r AS weight FROM pr WHERE r >= {THR}), nd AS (SELECT 'V' || vec_id AS feature_id FROM embeddings), bw AS (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed)"


def _graph(spark, sf):
    u = settle(_unit(spark, sf))
    pairs = corr.correlated_pairs(u, min_abs_r=THR, positive=True, p_values=False).where(F.col("r") >= THR)
    edges = settle(pairs.select(F.col("feature_a").alias("src"), F.col("feature_b").alias("dst"), F.col("r").alias("weight")))
    return edges, u.select("feature_id")


def _linked(spark, sf):
    """The same graph as unit vectors, for what needs no table of edges."""
    u = settle(_unit(spark, sf))
    return u, u.select("feature_id")


@query("degree_centrality", f"""WITH {_EDGES}, d AS (SELECT src, count(*) AS d FROM bw GROUP BY 1) SELECT feature_id, coalesce(d, 0) AS degree,
  round(coalesce(d, 0) / ((SELECT count(*) FROM nd) - 1), 6) AS degree_centrality FROM nd LEFT JOIN d ON src = feature_id""")
def degree_centrality(spark, sf):
    u, nodes = _linked(spark, sf)
    return network.degree_shares(network.link_counts(u, THR), nodes).withColumn("degree_centrality", R("degree_centrality"))


@query("network_density", f"""WITH {_EDGES} SELECT (SELECT count(*) FROM nd) AS n_nodes, (SELECT count(*) FROM ed) AS n_edges,
  round(2.0 * (SELECT count(*) FROM ed) / ((SELECT count(*) FROM nd) * ((SELECT count(*) FROM nd) - 1)), 8) AS density""")
def network_density(spark, sf):
    return network.link_density(*_linked(spark, sf), THR).withColumn("density", R("density", 8))


@query("clustering_coefficient", f"""WITH {_EDGES}, w AS (SELECT src, dst, weight / (SELECT max(weight) FROM ed) AS w FROM bw),
  t AS (SELECT a.src AS feature_id, count(*) AS n, sum(cbrt(a.w * b.w * c.w)) AS t FROM w a JOIN w b ON a.src = b.src AND a.dst < b.dst
    JOIN w c ON c.src = a.dst AND c.dst = b.dst GROUP BY 1), d AS (SELECT src, count(*) AS d FROM bw GROUP BY 1)
  SELECT nd.feature_id, coalesce(n, 0) AS n_triangles, round(CASE WHEN coalesce(d, 0) >= 2 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 6) AS clustering
  FROM nd LEFT JOIN t USING (feature_id) LEFT JOIN d ON d.src = nd.feature_id""")
def clustering_coefficient(spark, sf):
    return network.clustering(*_graph(spark, sf)).withColumn("clustering", R("clustering"))


@query("network_hubs", f"""WITH {_EDGES}, n AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM bw)
  SELECT src AS feature_id, count(*) AS degree, round(count(*) / ((SELECT count(*) FROM nd) - 1), 6) AS degree_centrality,
  string_agg(dst, ',' ORDER BY dst) FILTER (k <= 15) AS neighbors FROM n GROUP BY 1 HAVING count(*) >= 3""")
def network_hubs(spark, sf):
    return network.link_hubs(*_linked(spark, sf), THR).withColumn("degree_centrality", R("degree_centrality"))


@query("connected_components", f"""WITH RECURSIVE {_EDGES}, reach AS (SELECT feature_id, feature_id AS other FROM nd
  UNION SELECT r.feature_id, b.dst FROM reach r JOIN bw b ON b.src = r.other)
  SELECT feature_id, min(other) AS component FROM reach GROUP BY 1""")
def connected_components(spark, sf):
    u, nodes = _linked(spark, sf)
    return network.components(network.link_forest(u, THR), nodes)


@query("component_modules", f"""WITH RECURSIVE {_EDGES}, reach AS (SELECT feature_id, feature_id AS other FROM nd
  UNION SELECT r.feature_id, b.dst FROM reach r JOIN bw b ON b.src = r.other), lab AS (SELECT feature_id, min(other) AS component FROM reach GROUP BY 1),
  k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY feature_id) AS k FROM lab)
  SELECT component, count(*) AS size, string_agg(feature_id, ',' ORDER BY feature_id) FILTER (k <= 30) AS nodes FROM k GROUP BY 1 HAVING count(*) >= 2""")
def component_modules(spark, sf):
    u, nodes = _linked(spark, sf)
    return network.modules_from_components(network.components(network.link_forest(u, THR), nodes))


@query("label_communities")
def label_communities(spark, sf):
    return network.label_communities(*_graph(spark, sf))


@query("modularity_communities")
def modularity_communities(spark, sf):
    return communities.modularity_communities(*_graph(spark, sf))


@query("label_modularity", f"""WITH {_EDGES}, la AS (SELECT 'V' || vec_id AS feature_id, label FROM embeddings), tot AS (SELECT sum(weight) AS t FROM bw),
  x AS (SELECT a.label AS community, sum(weight) AS strength, coalesce(sum(weight) FILTER (a.label = b.label), 0) AS twice
    FROM bw JOIN la a ON a.feature_id = src JOIN la b ON b.feature_id = dst GROUP BY 1)
  SELECT la.label AS community, count(*) AS size, round(coalesce(any_value(twice), 0) / 2, 6) AS inside, round(coalesce(any_value(strength), 0), 6) AS strength,
    round(coalesce(any_value(twice) / any_value(t) - (any_value(strength) / any_value(t)) ^ 2, 0), 8) AS modularity
  FROM la LEFT JOIN x ON x.community = la.label, tot GROUP BY 1""")
def label_modularity(spark, sf):
    u, _ = _linked(spark, sf)
    lab = table(spark, sf, "embeddings").select(F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("feature_id"), F.col("label").alias("community"))
    return communities.shares(settle(network.link_strengths(u, lab, THR)), lab).withColumns({"inside": R("inside"), "strength": R("strength"), "modularity": R("modularity", 8)})


@query("betweenness")
def betweenness(spark, sf):
    return network.betweenness(*_graph(spark, sf)).withColumn("betweenness", R("betweenness"))


# --- weighted co-expression ---------------------------------------------------------------
_ADJ = "aj AS (SELECT feature_a, feature_b, abs(0.5 * (1 + r)) AS a FROM pr), ab AS (SELECT feature_a, feature_b, a FROM aj UNION ALL SELECT feature_b, feature_a, a FROM aj)"


@query("soft_threshold", f"""WITH {_VPAIR}, {_ADJ}, kk AS (SELECT feature_a, power, sum(a ^ power) AS k FROM ab, range(1, 21) t(power) GROUP BY 1, 2),
  st AS (SELECT power, avg(k) AS mean_connectivity, count(*) AS n_pos, min(log10(k)) AS lo, max(log10(k)) AS hi, greatest(10, least(50, count(*) // 5)) AS bins FROM kk GROUP BY 1),
  bn AS (SELECT power, least(floor((log10(k) - lo) / ((hi - lo) / bins)), bins - 1) AS bin, any_value(lo) AS lo, any_value(hi) AS hi, any_value(bins) AS bins,
    any_value(n_pos) AS n_pos, count(*) AS c FROM kk JOIN st USING (power) GROUP BY 1, 2),
  ft AS (SELECT power, regr_slope(log10(c / n_pos), lo + (bin + 0.5) * (hi - lo) / bins) AS slope, regr_r2(log10(c / n_pos), lo + (bin + 0.5) * (hi - lo) / bins) AS r2 FROM bn GROUP BY 1)
  SELECT power::INT AS power, round(mean_connectivity, 4) AS mean_connectivity, round(r2, 4) AS r2, round(slope, 3) AS slope, r2 >= 0.7 AND slope < 0 AS is_acceptable
  FROM st JOIN ft USING (power)""")
def soft_threshold(spark, sf):
    fit = network.scale_free_fit(settle(network.connectivity(_unit(spark, sf), network.POWERS)))
    return fit.withColumns({"mean_connectivity": R("mean_connectivity", 4), "r2": R("r2", 4), "slope": R("slope", 3)})


@query("topological_overlap", f"""WITH {_VPAIR}, {_ADJ}, a6 AS (SELECT feature_a, feature_b, a ^ 6 AS a FROM ab), k AS (SELECT feature_a, sum(a) AS k FROM a6 GROUP BY 1),
  l AS (SELECT x.feature_a AS src, y.feature_b AS dst, sum(x.a * y.a) AS l FROM a6 x JOIN a6 y ON x.feature_b = y.feature_a AND x.feature_a < y.feature_b GROUP BY 1, 2),
  t AS (SELECT src, dst, (l + a) / (least(k1.k, k2.k) + 1 - a) AS weight FROM l JOIN a6 ON a6.feature_a = src AND a6.feature_b = dst
    JOIN k k1 ON k1.feature_a = src JOIN k k2 ON k2.feature_a = dst) SELECT src, dst, round(weight, 6) AS weight FROM t WHERE weight >= 0.04""")
def topological_overlap(spark, sf):
    return network.tom_edges(_unit(spark, sf), 6, 0.04).withColumn("weight", R("weight"))


@query("sparse_overlap", f"""WITH {_EDGES}, k AS (SELECT src, sum(weight) AS k FROM bw GROUP BY 1),
  l AS (SELECT x.dst AS src, y.dst AS dst, sum(x.weight * y.weight) AS l FROM bw x JOIN bw y ON x.src = y.src AND x.dst < y.dst GROUP BY 1, 2)
  SELECT src, dst, round((coalesce(l, 0) + coalesce(weight, 0)) / (least(k1.k, k2.k) + 1 - coalesce(weight, 0)), 6) AS weight
  FROM l FULL JOIN ed USING (src, dst) JOIN k k1 USING (src) JOIN (SELECT src AS dst, k FROM k) k2 USING (dst)""")
def sparse_overlap(spark, sf):
    return network.sparse_overlap(_graph(spark, sf)[0]).withColumn("weight", R("weight"))


@query("greedy_modules", f"""WITH RECURSIVE {_VPAIR}, ab AS (SELECT feature_a AS src, feature_b AS dst, abs(r) AS r FROM pr UNION ALL SELECT feature_b, feature_a, abs(r) FROM pr),
  nd AS (SELECT src AS id, round(sum(r ^ 6), 9) AS k, coalesce(list(dst) FILTER (r >= {THR}), []) AS near FROM ab GROUP BY 1),
  o AS (SELECT *, row_number() OVER (ORDER BY k DESC, id) AS i FROM nd),
  g AS (SELECT 0::BIGINT AS step, []::VARCHAR[] AS seeds UNION ALL SELECT step + 1, CASE WHEN list_has_any(near, seeds) THEN seeds ELSE list_append(seeds, id) END FROM g JOIN o ON o.i = g.step + 1),
  s AS (SELECT unnest(seeds) AS seed FROM g WHERE step = (SELECT count(*) FROM o)), m AS (SELECT o.id AS feature_id, coalesce(
    any_value(o.id) FILTER (s0.seed IS NOT NULL), arg_min(x.id, x.i)) AS seed FROM o LEFT JOIN s s0 ON s0.seed = o.id
    LEFT JOIN (SELECT o.*, unnest(near) AS to_id FROM o WHERE id IN (SELECT seed FROM s)) x ON x.to_id = o.id GROUP BY 1),
  z AS (SELECT seed, row_number() OVER (ORDER BY any_value(o.i)) AS module FROM m JOIN o ON o.id = seed GROUP BY 1 HAVING count(*) >= 5)
  SELECT feature_id, seed, coalesce(module, 0)::INT AS module FROM m LEFT JOIN z USING (seed)""")
def greedy_modules(spark, sf):
    """Neighbours: |r| of 0.3 or more; order: row sums of |r| to the 6th."""
    u = settle(_unit(spark, sf))
    score = network.connectivity(u, [6], signed=False).select("feature_id", F.round("k", 9).alias("score"))
    return network.linked_modules(u, score, THR, min_size=5)


@query("fixed_cut_modules")
def fixed_cut_modules(spark, sf):
    """Average linkage of the overlap, cut at dissimilarity 0.8."""
    return network.tom_modules(_unit(spark, sf), 6, height=0.8)


@query("coexpression_modules")
def coexpression_modules(spark, sf):
    return network.tom_modules(_unit(spark, sf), 6)


def _labels(spark, sf):
    """Embedding labels as module numbers (0 = unassigned)."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("feature_id"),
        F.col("label").cast("int").alias("module"),
    )


@query("module_hub_genes", f"""WITH {_VPAIR}, {_ADJ}, lab AS (SELECT 'V' || vec_id AS feature_id, label AS module FROM embeddings WHERE label <> 0),
  sz AS (SELECT module, count(*) AS size FROM lab GROUP BY 1), k AS (SELECT la.module, feature_a AS feature_id, sum(a ^ 6) AS k FROM ab
    JOIN lab la ON la.feature_id = feature_a JOIN lab lb ON lb.feature_id = feature_b AND la.module = lb.module GROUP BY 1, 2),
  r AS (SELECT module, feature_id, k / size AS kim, row_number() OVER (PARTITION BY module ORDER BY round(k / size, 9) DESC, feature_id) AS rank FROM k JOIN sz USING (module))
  SELECT module, feature_id, round(kim, 6) AS kim, rank FROM r WHERE rank <= 10""")
def module_hub_genes(spark, sf):
    return network.hub_genes(_unit(spark, sf), _labels(spark, sf), 6).withColumn("kim", R("kim"))


def _power(name, gram, keys="", steps=14, pick=None):
    """SQL for the leading eigenvector of each matrix (keys, i, j, g): squared until one direction is left."""
    k = f"{keys}, " if keys else ""
    on = f"a.{keys} = b.{keys} AND " if keys else ""
    own = f"a.{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    out = [f"{name}0 AS MATERIALIZED (SELECT {k}i, j, g / max(abs(g)) OVER ({part}) AS g FROM {gram})"]
    for t in range(1, steps + 1):
        group = "1, 2, 3" if keys else "1, 2"
        out.append(f"{name}s{t} AS MATERIALIZED (SELECT {own}a.i, b.j, sum(a.g * b.g) AS g FROM {name}{t - 1} a JOIN {name}{t - 1} b ON {on}a.j = b.i GROUP BY {group})")
        out.append(f"{name}{t} AS MATERIALIZED (SELECT {k}i, j, g / max(abs(g)) OVER ({part}) AS g FROM {name}s{t})")
    pick = pick or f"SELECT {k}arg_max(j, g) AS j FROM {name}{steps} WHERE i = j" + (f" GROUP BY {keys}" if keys else "")
    using = f"{k}j"
    out.append(f"{name}c AS (SELECT {k}i, g FROM {name}{steps} JOIN ({pick}) USING ({using}))")
    out.append(f"{name} AS MATERIALIZED (SELECT {k}i, g / sqrt(sum(g * g) OVER ({part})) AS u FROM {name}c)")
    return ", ".join(out)


_EIG = f"""{VEC}, lm AS (SELECT 'V' || vec_id AS feature_id, label AS module FROM embeddings WHERE label <> 0),
  cen AS (SELECT feature_id, sample_id::INT AS i, value - avg(value) OVER (PARTITION BY feature_id) AS v FROM vecl),
  gm AS MATERIALIZED (SELECT module, a.i, b.i AS j, sum(a.v * b.v) AS g FROM cen a JOIN cen b USING (feature_id) JOIN lm USING (feature_id) GROUP BY 1, 2, 3), {_power("em", "gm", "module")},
  km AS (SELECT feature_id, lm.module, corr(v, u) AS k FROM cen JOIN lm USING (feature_id) JOIN em ON em.module = lm.module AND em.i = cen.i GROUP BY 1, 2),
  sg AS (SELECT module, CASE WHEN avg(k) < 0 THEN -1 ELSE 1 END AS s FROM km GROUP BY 1)"""


@query("module_eigengenes", f"WITH {_EIG} SELECT module, list(round(s * u, 6) ORDER BY i) AS vec FROM em JOIN sg USING (module) GROUP BY 1")
def module_eigengenes(spark, sf):
    eig = network.eigengenes(vectors(spark, sf), _labels(spark, sf))
    return eig.select("module", F.transform("vec", lambda v: F.round(v, 6)).alias("vec"))


@query("module_membership", f"WITH {_EIG} SELECT feature_id, module, round(s * k, 6) AS kme FROM km JOIN sg USING (module)")
def module_membership(spark, sf):
    v, lab = settle(vectors(spark, sf)), _labels(spark, sf)
    return network.membership(v, lab, network.eigengenes(v, lab)).withColumn("kme", R("kme"))


@query("module_trait_correlation", f"""WITH {_EIG}, tr AS (SELECT 'V' || vec_id AS trait FROM embeddings WHERE label = 0),
  pr AS (SELECT module, trait, any_value(s) * corr(u, v) AS r, count(*) AS n FROM em JOIN sg USING (module) JOIN cen USING (i) JOIN tr ON trait = feature_id GROUP BY 1, 2),
  pp AS (SELECT *, {_P()} AS p FROM pr), q AS ({sql_bh('pp', 'p')})
  SELECT module, trait, round(r, 6) AS r, round(p, 6) AS p_value, round(q_raw, 6) AS q_value FROM q""")
def module_trait_correlation(spark, sf):
    """Traits: the vectors of the unassigned label."""
    v, lab = settle(vectors(spark, sf)), _labels(spark, sf)
    traits = v.join(lab.where("module = 0"), "feature_id", "left_semi")
    res = network.module_traits(network.eigengenes(v, lab), traits)
    return res.select("module", "trait", R("r").alias("r"), R("p_value").alias("p_value"), R("q_value").alias("q_value"))


# --- latent components ------------------------------------------------------------------------
@query("sample_gram", f"""WITH {VEC}, c AS (SELECT feature_id, sample_id, value - avg(value) OVER (PARTITION BY feature_id) AS v FROM vecl)
  SELECT a.sample_id::INT AS i, b.sample_id::INT AS j, round(sum(a.v * b.v), 6) AS g FROM c a JOIN c b USING (feature_id) GROUP BY 1, 2""")
def sample_gram(spark, sf):
    return corr.gram(vectors(spark, sf)).withColumn("g", R("g"))


def _components(n, gram="g0"):
    """Eigenvectors e1..en of a matrix in SQL, each taken out before the next; lambda in l1..ln."""
    out = []
    for c in range(1, n + 1):
        out.append(_power(f"e{c}", gram))
        out.append(f"l{c} AS MATERIALIZED (SELECT sum(a.u * g * b.u) AS l FROM {gram} JOIN e{c} a USING (i) JOIN e{c} b ON b.i = j)")
        out.append(f"g{c} AS MATERIALIZED (SELECT i, j, g - l * a.u * b.u AS g FROM {gram} JOIN e{c} a USING (i) JOIN e{c} b ON b.i = j, l{c})")
        gram = f"g{c}"
    return ", ".join(out)


_GRAM0 = f"""{VEC}, cen AS (SELECT feature_id, sample_id::INT AS i, value - avg(value) OVER (PARTITION BY feature_id) AS v FROM vecl),
  g0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) AS g FROM cen a JOIN cen b USING (feature_id) GROUP BY 1, 2)"""
_SCORE = ", ".join(f"round((SELECT CASE WHEN arg_max(u, abs(u)) < 0 THEN -1 ELSE 1 END FROM e{c}) * e{c}.u * sqrt((SELECT l FROM l{c})), 6) AS pc{c}" for c in (1, 2, 3))


@query("pca_samples", f"WITH {_GRAM0}, {_components(3)} SELECT e1.i::VARCHAR AS sample_id, {_SCORE} FROM e1 JOIN e2 USING (i) JOIN e3 USING (i)")
def pca_samples(spark, sf):
    n = vectors(spark, sf).select(F.max(F.size("vec"))).first()[0]
    t = latent.pca_table(vectors(spark, sf), [str(i) for i in range(n)], 3)
    return t.select("sample_id", *[R(c).alias(c) for c in ("pc1", "pc2", "pc3")])


@query("batch_score", f"WITH {_GRAM0}, {_components(1)} SELECT round((SELECT l FROM l1) / sum(g), 3) AS batch_score FROM g0 WHERE i = j")
def batch_score(spark, sf):
    return latent.batch_score(vectors(spark, sf))


_FOLDS = 5


def _pls_sql(comps, folds):
    """PLS of the two blocks in SQL for every fold (fold -1: all samples), by inner products of samples.

    Scores t, weights u (over samples) and wn of each component as t1.., u1.., n1..;
    xc and yc are the blocks around the training means. ``folds``: SQL rows (fold, i, train).
    """
    tr = "fd.train"
    out = [f"""{_TWO}, fd AS MATERIALIZED ({folds}), st AS (SELECT feature_id AS f, label < 5 AS is_x, sample_id::INT AS i,
    (z - avg(z) OVER w) / CASE WHEN stddev_samp(z) OVER w < 1e-10 THEN 1 ELSE stddev_samp(z) OVER w END AS v FROM unit JOIN lab USING (feature_id) WINDOW w AS (PARTITION BY feature_id)),
  bc AS MATERIALIZED (SELECT fold, f, is_x, i, train, v - avg(v) FILTER (train) OVER (PARTITION BY fold, f) AS v FROM st JOIN fd USING (i)),
  kk AS MATERIALIZED (SELECT a.fold, a.is_x, a.i, b.i AS j, any_value(a.train) AS ti, any_value(b.train) AS tj, sum(a.v * b.v) AS g FROM bc a JOIN bc b USING (fold, f) GROUP BY 1, 2, 3, 4),
  x0 AS (SELECT * FROM kk WHERE is_x), y0 AS (SELECT * FROM kk WHERE NOT is_x)"""]
    for c in range(1, comps + 1):
        x, y = f"x{c - 1}", f"y{c - 1}"
        out.append(f"m{c} AS MATERIALIZED (SELECT a.fold, a.i, b.j, sum(a.g * b.g) AS g FROM {x} a JOIN {y} b ON a.fold = b.fold AND a.j = b.i WHERE a.ti AND a.tj AND b.tj GROUP BY 1, 2, 3)")
        out.append(_power(f"d{c}", f"m{c}", "fold", pick=f"SELECT fold, arg_max(i, g) AS j FROM {y} WHERE i = j AND ti GROUP BY fold"))
        out.append(f"v{c} AS (SELECT k.fold, k.i, sum(k.g * d.u) AS u FROM {y} k JOIN d{c} d ON d.fold = k.fold AND d.i = k.j WHERE k.ti AND k.tj GROUP BY 1, 2)")
        out.append(f"u{c} AS MATERIALIZED (SELECT fold, i, u / sqrt(sum(u * u) OVER (PARTITION BY fold)) AS u FROM v{c})")
        out.append(f"n{c} AS MATERIALIZED (SELECT k.fold, sqrt(sum(a.u * k.g * b.u)) AS wn FROM {x} k JOIN u{c} a ON a.fold = k.fold AND a.i = k.i JOIN u{c} b ON b.fold = k.fold AND b.i = k.j GROUP BY 1)")
        out.append(f"r{c} AS MATERIALIZED (SELECT k.fold, k.i, any_value(k.ti) AS train, sum(k.g * b.u) / any_value(wn) AS t FROM {x} k JOIN u{c} b ON b.fold = k.fold AND b.i = k.j JOIN n{c} n ON n.fold = k.fold GROUP BY 1, 2)")
        out.append(f"t{c} AS MATERIALIZED (SELECT *, sum(t * t) FILTER (train) OVER (PARTITION BY fold) AS tt FROM r{c})")
        for z in "xy":
            k = f"{z}{c - 1}"
            out.append(f"s{z}{c} AS MATERIALIZED (SELECT k.fold, k.i, sum(k.g * t) / any_value(tt) AS s FROM {k} k JOIN t{c} b ON b.fold = k.fold AND b.i = k.j WHERE train GROUP BY 1, 2)")
            out.append(f"p{z}{c} AS MATERIALIZED (SELECT fold, sum(t * s) / any_value(tt) AS pp FROM t{c} JOIN s{z}{c} USING (fold, i) WHERE train GROUP BY 1)")
            out.append(f"""{z}{c} AS MATERIALIZED (SELECT k.fold, k.i, k.j, k.ti, k.tj, g - b.t * sa.s - a.t * sb.s + a.t * b.t * pp AS g FROM {k} k JOIN t{c} a ON a.fold = k.fold AND a.i = k.i
      JOIN t{c} b ON b.fold = k.fold AND b.i = k.j JOIN s{z}{c} sa ON sa.fold = k.fold AND sa.i = k.i JOIN s{z}{c} sb ON sb.fold = k.fold AND sb.i = k.j JOIN p{z}{c} p ON p.fold = k.fold)""")
    return ", ".join(out)


def _fold_rows(n=64):
    """(fold, sample, in training) of the seeded folds for the samples of the tables."""
    rows = [(-1, i, True) for i in range(n)]
    for k, test in enumerate(latent._folds(n, _FOLDS, 42)):
        rows += [(k, i, i not in set(test.tolist())) for i in range(n)]
    return "SELECT * FROM (VALUES " + ", ".join(f"({f}, {i}, {str(t).lower()})" for f, i, t in rows) + ") fd(fold, i, train)"


def _joint(spark, sf, **kw):
    a, b = _two_blocks(spark, sf)
    as_vec = lambda d: d.select("feature_id", F.col("z").alias("vec"))
    return latent.joint_pls(as_vec(a), as_vec(b), **kw)


@query("joint_pls_summary")
def joint_pls_summary(spark, sf):
    return _joint(spark, sf)["summary"]


_PRESS = """SELECT c.fold, {c} AS n_comp, sum((v - {fit}) ^ 2) AS press FROM bc c {joins} WHERE NOT is_x AND (fold < 0 OR NOT c.train) GROUP BY 1"""
_SLOPES = ", ".join(f"q{c} AS MATERIALIZED (SELECT bc.fold, f, sum(v * t) / any_value(tt) AS b FROM bc JOIN t{c} t ON t.fold = bc.fold AND t.i = bc.i WHERE NOT is_x AND bc.train GROUP BY 1, 2)" for c in (1, 2))
_JOIN = lambda c: f"JOIN q{c} ON q{c}.fold = c.fold AND q{c}.f = c.f JOIN t{c} ON t{c}.fold = c.fold AND t{c}.i = c.i"


@query("pls_fold_press", f"""WITH {_pls_sql(2, _fold_rows())}, {_SLOPES},
  pr1 AS ({_PRESS.format(c=1, fit="t1.t * q1.b", joins=_JOIN(1)).replace("(fold < 0", "(c.fold < 0")}),
  pr2 AS ({_PRESS.format(c=2, fit="t1.t * q1.b - t2.t * q2.b", joins=_JOIN(1) + " " + _JOIN(2)).replace("(fold < 0", "(c.fold < 0")})
  SELECT fold, n_comp, round(press, 4) AS press FROM pr1 UNION ALL SELECT fold, n_comp, round(press, 4) FROM pr2""")
def pls_fold_press(spark, sf):
    """Squared prediction errors of each fold with one and two components; fold -1: of the fit to all samples."""
    xs, ys = (latent.standardise_vectors(d.select("feature_id", F.col("z").alias("vec"))) for d in _two_blocks(spark, sf))
    n = ys.agg(F.max(F.size("vec"))).first()[0]
    return latent.fold_states(settle(xs), settle(ys), 2, latent._folds(n, _FOLDS, 42)).select("fold", "n_comp", R("press", 4).alias("press"))


@query("joint_pls_variables", f"""WITH {_pls_sql(2, "SELECT -1 AS fold, range AS i, true AS train FROM range(64)")},
  ld AS (SELECT f, sum(v * t) / any_value(tt) AS loading, any_value(tt) AS tt1, sum(v * u) / any_value(wn) AS w1 FROM bc JOIN t1 USING (i) JOIN u1 USING (i), n1 WHERE is_x GROUP BY 1),
  w2 AS (SELECT f, sum((v - t1.t * loading) * u) / any_value(wn) AS w2, any_value(t2.tt) AS tt2 FROM bc JOIN ld USING (f) JOIN t1 USING (i) JOIN t2 USING (i) JOIN u2 USING (i), n2 WHERE is_x GROUP BY 1)
  SELECT f AS feature_id, round(loading, 6) AS loading, round(sqrt((SELECT count(*) FROM ld) * (w1 * w1 * tt1 + w2 * w2 * tt2) / (tt1 + tt2)), 6) AS vip
  FROM ld JOIN w2 USING (f) ORDER BY abs(loading) DESC, f LIMIT 30""")
def joint_pls_variables(spark, sf):
    out = latent.top_loadings(_joint(spark, sf, n_joint=2)["x_variables"], 30)
    return out.select("feature_id", R("loading").alias("loading"), R("vip").alias("vip"))
