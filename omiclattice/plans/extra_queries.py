"""Queries of the remaining operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from omiclattice.functions.materialise import settle
from omiclattice.operators import clean, corr, network, stats
from omiclattice.plans.matrix_queries import R
from omiclattice.plans.network_queries import brand_vectors
from omiclattice.plans.registry import query
from omiclattice.plans.views import EXPR, METAB, expr, metab, table


@query("heatmap_values", f"""WITH {EXPR}, tv AS (SELECT feature_id FROM expr GROUP BY 1 ORDER BY var_pop(value) DESC, feature_id LIMIT 60)
  SELECT feature_id, sample_id, round((value - avg(value) OVER w) / sqrt(greatest(var_pop(value) OVER w, 1e-10)), 6) AS value FROM expr SEMI JOIN tv USING (feature_id) WINDOW w AS (PARTITION BY feature_id)""")
def heatmap_values(spark, sf):
    return clean.heatmap_values(settle(expr(spark, sf))).withColumn("value", R("value"))


@query("expressologs", f"""WITH {EXPR}, {METAB}, o AS (SELECT DISTINCT 'P' || l_partkey AS gene_a, 'M' || l_suppkey AS gene_b FROM lineitem),
  c AS (SELECT gene_a, gene_b, count(*) AS n, corr(x.value, y.value) AS r FROM o JOIN expr x ON x.feature_id = gene_a JOIN metab y ON y.feature_id = gene_b AND y.sample_id = x.sample_id GROUP BY 1, 2 HAVING count(*) >= 3),
  k AS (SELECT *, row_number() OVER (PARTITION BY gene_a ORDER BY round(r, 9) DESC, gene_b) AS rank FROM c WHERE r IS NOT NULL AND NOT isnan(r)) SELECT gene_a, gene_b, n, round(r, 6) AS r, rank FROM k WHERE rank <= 10""")
def expressologs(spark, sf):
    """Orthologs: part and supplier that ever shared a line."""
    o = table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("gene_a"), F.concat(F.lit("M"), F.col("l_suppkey").cast("string")).alias("gene_b")
    ).distinct()
    return corr.expressologs(expr(spark, sf), metab(spark, sf), o).withColumn("r", R("r"))


@query("tissue_prior", """WITH b AS (SELECT DISTINCT lower(p_type) AS site, split_part(p_name, ' ', 2) AS word FROM part), q AS (SELECT p_partkey AS query_id, p_name AS name, CASE WHEN p_size % 4 <> 0 THEN lower(p_type) END AS own FROM part),
  s AS (SELECT DISTINCT name, site FROM (SELECT DISTINCT name FROM q) n JOIN b ON contains(name, word) OR contains(word, name))
  SELECT query_id, CASE WHEN q.name NOT IN (SELECT name FROM s) THEN 0.3 WHEN own IS NULL THEN 0.5 WHEN EXISTS (SELECT 1 FROM s WHERE s.name = q.name AND s.site = q.own) THEN 0.85 ELSE 0.25 END::DOUBLE AS score FROM q""")
def tissue_prior(spark, sf):
    p = table(spark, sf, "part")
    q = p.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("metabolite"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("tissue"))
    b = p.select(F.col("p_type").alias("tissue"), F.split("p_name", " ")[1].alias("word"))
    return stats.tissue_prior(q, b)


@query("wgcna_run")
def wgcna_run(spark, sf):
    """Modules of the brand revenue and quantity block with sizes."""
    v = brand_vectors(spark, sf)
    long = v.select("feature_id", F.posexplode("vec").alias("s", "value")).select("feature_id", F.col("s").cast("string").alias("sample_id"), "value")
    run = network.coexpression(long)
    return run["modules"].groupBy("module").agg(F.count(F.lit(1)).alias("size"))
