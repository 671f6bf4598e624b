"""Views that give the driver tables the shapes the operators expect.

The tables hold no omics data, so parts and suppliers stand in for genes and
metabolites, nations for samples and regions for experimental groups. Every
view has a DataFrame form and the same thing as SQL text for the oracles.
Cell values are rounded to the cent so both engines start from equal doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a table of few files over all cores before heavy text work.

    Tables with at least one file per core are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def texts(spark, sf, name: str = "documents") -> DataFrame:
    return spread(table(spark, sf, name))


def _lines(spark, sf, *cols) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", *cols)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        li.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(cust, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )


def _cells(lines: DataFrame, prefix: str, key: str, value: str) -> DataFrame:
    return (
        lines.groupBy(key, "n_name")
        .agg(F.round(F.sum(value), 2).alias("value"))
        .select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("feature_id"),
            F.col("n_name").alias("sample_id"),
            "value",
        )
    )


def expr(spark, sf) -> DataFrame:
    """Block "expression": part x nation revenue (cells can be absent)."""
    return _cells(_lines(spark, sf, "l_partkey", "l_extendedprice"), "P", "l_partkey", "l_extendedprice")


def metab(spark, sf) -> DataFrame:
    """Block "metabolite": supplier x nation quantity."""
    return _cells(_lines(spark, sf, "l_suppkey", "l_quantity"), "M", "l_suppkey", "l_quantity")


def groups(spark, sf) -> DataFrame:
    """sample -> group (nation -> region); a fixed dimension table."""
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("sample_id"), F.col("r_name").alias("grp")
    )


def vectors_long(spark, sf) -> DataFrame:
    """embeddings as a dense matrix: vector = feature, dimension = sample."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("feature_id"),
        F.posexplode("embedding").alias("sample_id", "value"),
    ).select("feature_id", F.col("sample_id").cast("string"), F.col("value").cast("double"))


def vectors(spark, sf) -> DataFrame:
    """The same matrix in vector form."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("feature_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def events_long(spark, sf) -> DataFrame:
    """events as raw long cells; event types are a few very hot features."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("feature_id"),
        F.col("user_id").cast("string").alias("sample_id"),
        "value",
    )


# --- the same views as SQL text ------------------------------------------
_FROM = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

EXPR = f"""expr AS (SELECT 'P' || l_partkey AS feature_id, n_name AS sample_id,
  round(sum(l_extendedprice), 2) AS value {_FROM} GROUP BY l_partkey, n_name)"""
METAB = f"""metab AS (SELECT 'M' || l_suppkey AS feature_id, n_name AS sample_id,
  round(sum(l_quantity), 2) AS value {_FROM} GROUP BY l_suppkey, n_name)"""
GRP = """grp AS (SELECT n_name AS sample_id, r_name AS grp
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
VEC = """vecl AS (SELECT 'V' || vec_id AS feature_id, generate_subscripts(embedding, 1) - 1 AS sample_id,
  unnest(embedding)::DOUBLE AS value FROM embeddings)"""
EVT = """evt AS (SELECT event_type AS feature_id, user_id::VARCHAR AS sample_id, value FROM events)"""


# --- exact tails for the oracles (integer degrees of freedom) -------------
def sql_betainc(x: str, a2: str, b2: str) -> str:
    """I_x(a2/2, b2/2) by upward recurrences; a2 and b2 are integers."""
    a0 = f"(CASE WHEN ({a2})::INT % 2 = 1 THEN 0.5 ELSE 1.0 END)"
    b0 = f"(CASE WHEN ({b2})::INT % 2 = 1 THEN 0.5 ELSE 1.0 END)"
    start = f"""(CASE WHEN ({a2})::INT % 2 = 1 AND ({b2})::INT % 2 = 1 THEN 2 / pi() * asin(sqrt({x}))
      WHEN ({a2})::INT % 2 = 1 THEN sqrt({x}) WHEN ({b2})::INT % 2 = 1 THEN 1 - sqrt(1 - ({x})) ELSE ({x}) END)"""
    lnb = lambda a, b: f"(lgamma({a}) + lgamma({b}) - lgamma(({a}) + ({b})))"
    up = f"""coalesce(list_sum(list_transform(range(0, ((({b2}) / 2.0) - {b0})::INT),
      lambda j: exp({a0} * ln({x}) + ({b0} + j) * ln(1 - ({x})) - {lnb(a0, f'{b0} + j')}) / ({b0} + j))), 0)"""
    down = f"""coalesce(list_sum(list_transform(range(0, ((({a2}) / 2.0) - {a0})::INT),
      lambda i: exp(({a0} + i) * ln({x}) + (({b2}) / 2.0) * ln(1 - ({x})) - {lnb(f'{a0} + i', f'({b2}) / 2.0')}) / ({a0} + i))), 0)"""
    return f"""(CASE WHEN ({x}) >= 1 THEN 1.0 WHEN ({x}) <= 0 THEN 0.0
      ELSE greatest({start} + {up} - {down}, 0) END)"""


def sql_t_two_sided(t: str, df: str) -> str:
    return sql_betainc(f"(({df}) / (({df}) + ({t}) * ({t})))", df, "1")


def sql_f_tail(f: str, d1: str, d2: str) -> str:
    return sql_betainc(f"(({d2}) / (({d2}) + ({d1}) * ({f})))", d2, d1)


def sql_chi2_tail(x: str, df: str) -> str:
    """1 - P(df/2, x/2) by the power series; fine for moderate x."""
    return f"""(CASE WHEN ({x}) <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 300), lambda n:
      exp((n + ({df}) / 2.0) * ln(({x}) / 2.0) - ({x}) / 2.0 - lgamma(({df}) / 2.0 + n + 1)))) END)"""


def sql_hypergeom(k: str, m: str, n: str, big_n: str) -> str:
    c = lambda a, b: f"(lgamma(({a}) + 1) - lgamma(({b}) + 1) - lgamma(({a}) - ({b}) + 1))"
    return f"""(CASE WHEN ({k}) <= 0 THEN 1.0 ELSE least(1.0, coalesce(list_sum(list_transform(
      range(greatest(({k}), ({n}) + ({m}) - ({big_n}))::BIGINT, least(({m}), ({n}))::BIGINT + 1), lambda i:
      exp({c(m, 'i')} + {c(f'({big_n}) - ({m})', f'({n}) - i')} - {c(big_n, n)}))), 0)) END)"""


def sql_bh(source: str, p: str, scope: str = "") -> str:
    """CTE body: every row of ``source`` with a step-up q value."""
    part = f"PARTITION BY {scope}" if scope else ""
    return f"""SELECT * EXCLUDE (_rk, _n), least(1.0, min({p} * _n / _rk) OVER ({part}
      ORDER BY {p} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q_raw FROM (
      SELECT *, count(*) OVER ({part} ORDER BY {p} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _rk,
      count(*) OVER ({part}) AS _n FROM {source})"""
