"""Over-representation tests and combined evidence per pathway or term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from omiclattice.functions.materialise import settle
from omiclattice.functions.ranks import benjamini_hochberg
from omiclattice.functions.scalars import contained_in
from omiclattice.functions.tails import P_FLOOR, chi2_tail_even, hypergeom_upper

# Words in a metabolite name that point to a pathway, in order.
PATHWAY_WORDS = [
    ("flavonoid_biosynthesis", ["flavonoid", "flavonol", "anthocyanin", "proanthocyanidin"]),
    ("phenylpropanoid_biosynthesis", ["phenylpropanoid", "lignin", "coumarin", "cinnamate"]),
    ("terpenoid_backbone_biosynthesis", ["terpen", "isoprenoid", "gibberellin", "abscisic"]),
    ("carotenoid_biosynthesis", ["carotenoid", "carotene", "lycopene", "xanthophyll"]),
    ("alkaloid_biosynthesis", ["alkaloid", "berberine", "nicotine", "tropane"]),
    ("benzylisoquinoline_alkaloid_biosynthesis", ["nitidine", "chelerythrine", "sanguinarine", "benzylisoquinoline"]),
    ("glucosinolate_biosynthesis", ["glucosinolate", "sulforaphane"]),
]

# Annotation words tested as terms.
TERMS = [
    "biological_process", "molecular_function", "cellular_component",
    "metabolic", "biosynthetic", "regulation", "response",
    "oxidation", "reduction", "transferase", "hydrolase",
    "transcription", "phosphorylation", "transport",
]


def pathway_of(name: Column, words=PATHWAY_WORDS) -> Column:
    """Pathway key of a metabolite name, NULL when no word matches."""
    low = F.lower(name)
    out = F.lit(None).cast("string")
    for key, keys in reversed(words):
        hit = F.lit(False)
        for k in keys:
            hit = hit | F.contains(low, F.lit(k))
        out = F.when(hit, F.lit(key)).otherwise(out)
    return out


def over_representation(hits: DataFrame, members: DataFrame, background: DataFrame) -> DataFrame:
    """Hypergeometric test per set.

    ``hits`` and ``background``: feature_id; ``members``: set_id, feature_id.
    Counts are partial aggregates; only one row per set reaches the test.
    """
    back = background.select("feature_id").distinct()
    drawn = hits.select("feature_id").distinct().join(back, "feature_id", "left_semi").withColumn("is_hit", F.lit(True))
    n = drawn.agg(F.count(F.lit(1))).scalar()
    big_n = back.agg(F.count(F.lit(1))).scalar()
    counted = (
        members.select("set_id", "feature_id").distinct().join(back, "feature_id", "left_semi")
        .join(drawn, "feature_id", "left").groupBy("set_id")
        .agg(F.count(F.lit(1)).alias("set_size"), F.count_if(F.col("is_hit")).alias("overlap"))
        .withColumn("n_hits", n).withColumn("n_background", big_n)
    )
    expected = F.col("n_hits") * F.col("set_size") / F.col("n_background")
    return counted.withColumn("expected", expected).select(
        "*", F.when(expected > 0, F.col("overlap") / expected).otherwise(0.0).alias("fold"),
        hypergeom_upper("overlap", "set_size", "n_hits", "n_background").alias("p_value"),
    )


def fisher_combined(df: DataFrame, keys: list[str], p: str, out: str = "p_combined") -> DataFrame:
    """Fisher's combined p per key; p outside (0, 1] is ignored, no p gives 1."""
    ok = F.when((F.col(p) > 0) & (F.col(p) <= 1), F.col(p))
    agg = df.groupBy(*keys).agg(F.count(ok).alias("_k"), F.sum(F.ln(ok)).alias("_s"))
    return agg.select(
        *keys, F.when(F.col("_k") > 0, chi2_tail_even(-2.0 * F.col("_s"), F.col("_k"))).otherwise(1.0).alias(out)
    )


def joint_enrichment(deg_hits: DataFrame, members: DataFrame, background: DataFrame,
                     metab_p: DataFrame) -> DataFrame:
    """Gene over-representation and metabolite evidence combined per pathway.

    ``metab_p``: set_id, p_value of metabolites mapped to the pathway.
    """
    genes = over_representation(deg_hits, members, background).withColumnRenamed("p_value", "p_deg")
    m = metab_p.where(F.col("p_value").isNotNull() & ~F.isnan("p_value")).withColumn("p_value", F.least(F.greatest("p_value", F.lit(P_FLOOR)), F.lit(1.0)))
    mets = fisher_combined(m, ["set_id"], "p_value", "p_dam").join(
        m.groupBy("set_id").agg(F.count("p_value").alias("n_dam")), "set_id"
    )
    both = settle(genes.join(mets, "set_id", "left").fillna({"p_dam": 1.0, "n_dam": 0}))
    x = -2.0 * (F.ln("p_deg") + F.ln("p_dam"))
    both = both.withColumn("p_combined", chi2_tail_even(x, F.lit(2)))
    both = benjamini_hochberg(both, "p_combined", out="q_combined")
    return benjamini_hochberg(both, "p_deg", out="q_deg")


def term_enrichment(hits: DataFrame, background: DataFrame, annotation: DataFrame,
                    terms: list[str] = TERMS, min_hits: int = 2, alpha: float = 0.05,
                    background_has_hits: bool = False) -> DataFrame:
    """Fisher's exact test (greater) for words inside annotation texts.

    ``annotation``: feature_id, term. The background excludes the hit set
    unless ``background_has_hits``.
    """
    low = F.lower("term")
    tagged = annotation.select(
        "feature_id", F.explode(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]))).alias("word")
    ).distinct()
    h = hits.select("feature_id").distinct()
    b = background.select("feature_id").distinct()
    if not background_has_hits:
        b = b.join(h, "feature_id", "left_anti")
    labelled = h.withColumn("side", F.lit("hit")).unionByName(b.withColumn("side", F.lit("back")))
    n_hit, n_back = h.agg(F.count(F.lit(1))).scalar(), b.agg(F.count(F.lit(1))).scalar()
    c = tagged.join(labelled, "feature_id").groupBy("word").agg(
        F.count_if(F.col("side") == "hit").alias("in_set"), F.count_if(F.col("side") == "back").alias("in_background")
    ).where(F.col("in_set") >= min_hits).withColumn("n_set", n_hit).withColumn("n_back", n_back)
    test = c.withColumn("p_value", hypergeom_upper(
        F.col("in_set"), F.col("in_set") + F.col("in_background"), F.col("n_set"), F.col("n_set") + F.col("n_back")
    ))
    return benjamini_hochberg(test, "p_value").where(F.col("q_value") < alpha)


def match_gene_names(names: DataFrame, ids: DataFrame) -> DataFrame:
    """Names matched to ids that contain them (or that they contain), any case.

    The shortest, then first id wins.
    """
    n = settle(names.select(F.upper("name").alias("key"), "name").distinct())
    i = settle(ids.select("feature_id", F.upper("feature_id").alias("uid")).distinct())
    inside = contained_in(n, "key", i, "uid").select("name", "feature_id")
    around = contained_in(i, "uid", n, "key").select("name", "feature_id")
    best = inside.unionByName(around).groupBy("name").agg(
        F.min(F.struct(F.length("feature_id").alias("len"), F.col("feature_id").alias("id"))).alias("m")
    )
    return best.select("name", F.col("m.id").alias("feature_id"))


def pathway_activity(df: DataFrame, enzymes: DataFrame) -> DataFrame:
    """Activity per pathway: mean z of its genes and their mean correlation.

    ``enzymes``: set_id, feature_id. The mean over all pairs follows from
    summed unit vectors, (|sum|^2 - n) / (n (n-1)), so no pair is formed.
    """
    means = settle(df.groupBy("feature_id").agg(F.avg("value").alias("m")))
    glob = means.agg(F.struct(F.avg("m").alias("gm"), F.stddev_pop("m").alias("gs"))).scalar()
    z = means.withColumn("_g", glob).withColumn("z", (F.col("m") - F.col("_g.gm")) / (F.col("_g.gs") + 1e-10))
    zs = enzymes.join(z, "feature_id").groupBy("set_id").agg(F.avg("z").alias("mean_z"), F.count(F.lit(1)).alias("n_enzymes"))
    stat = df.groupBy("feature_id").agg(
        F.avg("value").alias("_m"), (F.var_pop("value") * F.count("value")).alias("_ss"), F.count("value").alias("_n")
    ).where("_n >= 3 AND _ss > 1e-20")
    unit = df.join(stat, "feature_id").select("feature_id", "sample_id", ((F.col("value") - F.col("_m")) / F.sqrt("_ss")).alias("u"))
    sums = enzymes.join(unit, "feature_id").groupBy("set_id", "sample_id").agg(F.sum("u").alias("s"))
    k = enzymes.join(stat, "feature_id").groupBy("set_id").agg(F.count(F.lit(1)).alias("k"))
    coh = sums.groupBy("set_id").agg(F.sum(F.col("s") * F.col("s")).alias("q")).join(k, "set_id").where("k >= 2").select(
        "set_id", F.greatest((F.col("q") - F.col("k")) / (F.col("k") * (F.col("k") - 1)), F.lit(0.0)).alias("coherence")
    )
    return zs.join(coh, "set_id", "left").withColumn("is_active", F.coalesce(F.col("coherence") >= 0.20, F.lit(False)))
