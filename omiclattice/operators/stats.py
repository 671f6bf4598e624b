"""Differential tests between sample groups.

Group moments are one partial/final aggregation; every later statistic is a
column expression over at most (features x groups) rows. P values come from
one Arrow batch per partition of one-row-per-test tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from omiclattice.functions.materialise import settle
from omiclattice.functions.ranks import benjamini_hochberg, cumulative_counts, global_median
from omiclattice.functions.tails import P_FLOOR, chi2_tail, f_tail, t_two_sided


def group_moments(df: DataFrame, groups: DataFrame, min_n: int = 2) -> DataFrame:
    """n, mean and sample variance per feature and group (small groups dropped)."""
    return (
        df.join(groups, "sample_id").groupBy("feature_id", "grp")
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
        .where(F.col("n") >= min_n)
    )


def anova(moments: DataFrame) -> DataFrame:
    """F statistic, p, eta squared and largest group difference per feature."""
    n, m, v = F.col("n"), F.col("mean"), F.col("var")
    agg = (
        moments.groupBy("feature_id")
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.sum("n").alias("n_total"),
            F.sum(n * m).alias("_s1"),
            F.sum(n * m * m).alias("_s2"),
            F.sum((n - 1) * v).alias("ssw"),
            (F.max("mean") - F.min("mean")).alias("max_log2fc"),
        )
        .where("k >= 2")
        .withColumn("ssb", F.greatest(F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("n_total"), F.lit(0.0)))
        .drop("_s1", "_s2")
    )
    d1, d2 = F.col("k") - 1, F.col("n_total") - F.col("k")
    msw = F.col("ssw") / d2
    ok = (d2 >= 1) & (F.col("ssw") >= 1e-15) & (msw >= 1e-15)
    sst = F.col("ssb") + F.col("ssw")
    return (
        agg.withColumn("df1", d1).withColumn("df2", d2)
        .withColumn("f_stat", F.when(ok, (F.col("ssb") / d1) / msw).otherwise(0.0))
        .withColumn("effect_size", F.when(sst >= 1e-15, F.col("ssb") / sst).otherwise(0.0))
        .withColumn("p_value", F.when(ok, f_tail("f_stat", d1.cast("double"), d2.cast("double"))).otherwise(1.0))
        .drop("ssb", "ssw")
    )


def prior_variance(df: DataFrame, min_values: int = 3) -> Column:
    """Median over features of the sample variance, as a scalar column."""
    per = (
        df.groupBy("feature_id").agg(F.count("value").alias("n"), F.var_samp("value").alias("v"))
        .where((F.col("n") >= min_values) & (F.col("v") > 0))
    )
    return global_median(per, "v")


def pooled_variance(df: DataFrame) -> Column:
    """Variance of all values of all features together."""
    return df.agg(F.greatest(F.coalesce(F.var_samp("value"), F.lit(1.0)), F.lit(1e-10))).scalar()


def moderated_t(pairs: DataFrame, prior_var: Column, prior_df: float = 3.0) -> DataFrame:
    """Variance-shrunken t test over rows with n/mean/var of groups a and b."""
    na, nb = F.col("n_a"), F.col("n_b")
    df_gene = na + nb - 2
    var_gene = ((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b")) / df_gene
    out = pairs.withColumn("_prior", prior_var).withColumn("_vg", var_gene)
    post = F.when(
        F.col("_prior") > 0, (prior_df * F.col("_prior") + df_gene * F.col("_vg")) / (prior_df + df_gene)
    ).otherwise(F.when(F.col("_vg") > 0, F.col("_vg")).otherwise(1e-10))
    out = out.withColumn("posterior_var", post).withColumn("log2fc", F.col("mean_b") - F.col("mean_a"))
    se = F.sqrt(F.col("posterior_var") * (1.0 / na + 1.0 / nb))
    d = F.sqrt(F.greatest(F.col("_vg"), F.lit(0.0)))
    return (
        out.withColumn("t_stat", F.when(se < 1e-15, 0.0).otherwise(F.col("log2fc") / se))
        .withColumn("df", df_gene + F.lit(prior_df))
        .withColumn("cohens_d", F.when(d < 1e-15, 0.0).otherwise(F.col("log2fc") / d))
        .withColumn("p_value", F.when(se < 1e-15, 1.0).otherwise(t_two_sided("t_stat", "df")))
        .drop("_prior", "_vg")
    )


def group_pairs(moments: DataFrame) -> DataFrame:
    """All group pairs a < b inside each feature.

    A feature has one row per group, so the pairs come from its own small
    array, without a self-join.
    """
    packed = moments.groupBy("feature_id").agg(
        F.sort_array(F.collect_list(F.struct("grp", "n", "mean", "var"))).alias("g")
    )
    a = packed.select("feature_id", "g", F.posexplode("g").alias("i", "a"))
    return a.select(
        "feature_id", "a",
        F.explode(F.slice("g", F.col("i") + 2, F.size("g") - F.col("i") - 1)).alias("b"),
    ).select(
        "feature_id",
        F.col("a.grp").alias("group_a"), F.col("b.grp").alias("group_b"),
        F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"),
        F.col("a.mean").alias("mean_a"), F.col("b.mean").alias("mean_b"),
        F.col("a.var").alias("var_a"), F.col("b.var").alias("var_b"),
    )


def kruskal_wallis(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Tie-corrected H and p per feature (NULL-safe; needs two groups).

    The tie sum comes from the same value counts as the ranks.
    """
    cells = settle(df.join(groups, "sample_id").where(F.col("value").isNotNull()))
    sizes = cells.groupBy("feature_id", "grp").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    cells = cells.join(sizes.select("feature_id", "grp"), ["feature_id", "grp"], "left_semi")
    # one set of value counts gives the ranks and the tie sums
    cc = settle(cumulative_counts(cells, ["feature_id"], "value"))
    t = F.col("cnt")
    ties = cc.groupBy("feature_id").agg(F.sum(t * t * t - t).alias("tie"))
    ranks = cc.select("feature_id", "value", (F.col("below") + (t + 1) / 2.0).alias("rnk"))
    ranked = cells.join(ranks, ["feature_id", "value"])
    rank_sums = ranked.groupBy("feature_id", "grp").agg(
        F.sum("rnk").alias("r"), F.count(F.lit(1)).alias("n")
    )
    h = (
        rank_sums.groupBy("feature_id")
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
        .where("k >= 2").join(ties, "feature_id")
    )
    n = F.col("n")
    corr = 1.0 - F.col("tie") / (n * n * n - n)
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3.0 * (n + 1)
    return (
        h.withColumn("h_stat", F.when(corr > 0, raw / corr).otherwise(0.0))
        .withColumn("df", F.col("k") - 1)
        .withColumn("p_kw", F.when(corr > 0, chi2_tail("h_stat", F.col("df").cast("double"))).otherwise(1.0))
        .select("feature_id", "h_stat", "df", "p_kw")
    )


def deg_multigroup(
    log_df: DataFrame, groups: DataFrame, alpha: float = 0.05, min_lfc: float = 0.5,
    fdr_scope: str = "all", with_kw: bool = True,
) -> DataFrame:
    """ANOVA per feature, q values, significance flag and rank score.

    ``fdr_scope='prefiltered'`` corrects only over tests with p < 10 alpha.
    """
    log_df = settle(log_df) if with_kw else log_df
    res = anova(group_moments(log_df, groups))
    if with_kw:
        kw = kruskal_wallis(log_df, groups)
        res = res.join(kw.select("feature_id", "p_kw"), "feature_id", "left").withColumn(
            "kw_disagrees", (F.col("p_kw") > 0.05) & (F.col("p_value") < 0.01)
        )
    if fdr_scope == "prefiltered":
        res = settle(res)
        tested = benjamini_hochberg(res.where(F.col("p_value") < alpha * 10).select("feature_id", "p_value"), "p_value")
        res = res.join(tested.select("feature_id", "q_value"), "feature_id", "left").fillna(1.0, ["q_value"])
    else:
        res = benjamini_hochberg(res, "p_value")
    return score_effects(res, alpha, min_lfc)


def score_effects(res: DataFrame, alpha: float = 0.05, min_lfc: float = 0.5) -> DataFrame:
    """FDR flag and score: effect/2 + 0.3 when significant, else at most 0.7."""
    sig = (F.col("q_value") < alpha) & (F.abs("max_log2fc") >= min_lfc)
    half = F.abs("effect_size") / 2.0
    return res.withColumn("is_fdr_sig", sig).withColumn(
        "score", F.when(sig, F.least(F.lit(1.0), half + 0.3)).otherwise(F.least(F.lit(0.7), half))
    )


def deg_two_group(log_df: DataFrame, groups: DataFrame, a: str, b: str, prior_df: float = 3.0) -> DataFrame:
    """Two-group test with shrunken variance, Cohen's d and q values."""
    pair = groups.where(F.col("grp").isin(a, b))
    cells = settle(log_df.join(pair.select("sample_id"), "sample_id", "left_semi"))
    mom = group_moments(cells, pair)
    stat = lambda c, g: F.max(F.when(F.col("grp") == g, F.col(c)))
    wide = mom.groupBy("feature_id").agg(
        *[stat(c, g).alias(f"{c}_{s}") for c in ("n", "mean", "var") for g, s in ((a, "a"), (b, "b"))]
    ).where("n_a IS NOT NULL AND n_b IS NOT NULL")
    res = moderated_t(wide, prior_variance(cells), prior_df)
    res = benjamini_hochberg(res, "p_value")
    return score_effects(
        res.withColumn("effect_size", F.abs("cohens_d")).withColumn("max_log2fc", F.abs("log2fc"))
    )


def welch_test(df: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """Welch t on raw values with the log2 ratio of means."""
    mom = group_moments(df, groups.where(F.col("grp").isin(a, b)))
    stat = lambda c, g: F.max(F.when(F.col("grp") == g, F.col(c)))
    w = mom.groupBy("feature_id").agg(
        *[stat(c, g).alias(f"{c}_{s}") for c in ("n", "mean", "var") for g, s in ((a, "a"), (b, "b"))]
    ).where("n_a IS NOT NULL AND n_b IS NOT NULL")
    qa, qb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    se2 = qa + qb
    w = (
        w.withColumn("t_stat", F.when(se2 > 0, (F.col("mean_a") - F.col("mean_b")) / F.sqrt(se2)).otherwise(0.0))
        .withColumn("df", F.when(se2 > 0, se2 * se2 / (qa * qa / (F.col("n_a") - 1) + qb * qb / (F.col("n_b") - 1))).otherwise(1.0))
        .withColumn("log2fc", F.log2(F.col("mean_b") / F.greatest("mean_a", F.lit(1e-10))))
    )
    res = benjamini_hochberg(w.withColumn("p_value", t_two_sided("t_stat", "df")), "p_value")
    return res.withColumn("is_sig", (F.col("q_value") < 0.05) & (F.abs("log2fc") >= 1.0))


def dam_pairwise(
    log_df: DataFrame, groups: DataFrame, alpha: float = 0.05, prior: str = "median"
) -> DataFrame:
    """Follow-up of features with ANOVA p < alpha: every group pair, one FDR."""
    log_df = settle(log_df)
    mom = settle(group_moments(log_df, groups))
    overall = anova(mom).where(F.col("p_value") < alpha)
    hits = mom.join(overall.select("feature_id"), "feature_id", "left_semi")
    pv = prior_variance(log_df) if prior == "median" else pooled_variance(log_df)
    res = moderated_t(group_pairs(hits), pv)
    res = benjamini_hochberg(res, "p_value")
    return res.withColumn(
        "direction",
        F.when(F.col("log2fc") > 0, "up").when(F.col("log2fc") < 0, "down").otherwise("unchanged"),
    )


def signed_contrast(log_df: DataFrame, groups: DataFrame, a: str, b: str) -> DataFrame:
    """Signed log2 fold change b - a per feature, for direction-based steps."""
    mom = group_moments(log_df, groups.where(F.col("grp").isin(a, b)))
    mean = lambda g: F.max(F.when(F.col("grp") == g, F.col("mean")))
    return (
        mom.groupBy("feature_id").agg((mean(b) - mean(a)).alias("log2fc")).where("log2fc IS NOT NULL")
    )


def top_effects(res: DataFrame, n: int, effect: str = "effect_size") -> DataFrame:
    return res.orderBy(F.desc(effect), "feature_id").limit(n)


def volcano(res: DataFrame, lfc: str = "log2fc", alpha: float = 0.05, min_lfc: float = 1.0) -> DataFrame:
    """Plot table: lfc, -log10 q, up/down/ns label."""
    sig = F.col("q_value") < alpha
    return res.select(
        "feature_id", F.col(lfc).alias("log2fc"),
        (-F.log10(F.greatest("q_value", F.lit(P_FLOOR)))).alias("neg_log10_q"),
        F.when(sig & (F.col(lfc) >= min_lfc), "up").when(sig & (F.col(lfc) <= -min_lfc), "down")
        .otherwise("ns").alias("label"),
    )


def quadrant(gene_lfc: Column, metab_lfc: Column, threshold: float = 0.0) -> Column:
    """Four quadrants at threshold 0, nine fields above."""
    side = lambda c: F.when(c > threshold, 1).when(c < -threshold, -1).otherwise(0)
    if threshold > 0:
        fields = {(1, 1): "Q1", (1, -1): "Q4", (1, 0): "Q5", (-1, 1): "Q2", (-1, -1): "Q3",
                  (-1, 0): "Q7", (0, 1): "Q8", (0, -1): "Q6", (0, 0): "Q9"}
        g, m = side(gene_lfc), side(metab_lfc)
        out = F.lit(None).cast("string")
        for (i, j), label in fields.items():
            out = F.when((g == i) & (m == j), label).otherwise(out)
        return out
    up, mup = gene_lfc >= 0, metab_lfc >= 0
    return F.when(up & mup, "Q1").when(up, "Q4").when(mup, "Q2").otherwise("Q3")


def quadrant_summary(pairs: DataFrame) -> DataFrame:
    """Share of pairs moving together and its strength label."""
    sync = F.count_if(F.col("quadrant").isin("Q1", "Q3")) / F.count(F.lit(1))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), sync.alias("synchronicity")).withColumn(
        "strength",
        F.when(F.col("synchronicity") >= 0.6, "strong")
        .when(F.col("synchronicity") >= 0.4, "moderate").otherwise("weak"),
    )


def tau_index(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Tissue specificity per feature from group means, with the top group."""
    means = (
        df.join(groups, "sample_id").groupBy("feature_id", "grp").agg(F.avg("value").alias("x"))
    )
    # ties on the top value go to the first group name
    agg = means.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("n_tissues"), F.max("x").alias("mx"), F.sum("x").alias("sx"),
        F.min(F.struct((-F.col("x")).alias("neg"), F.col("grp").alias("grp"))).alias("top"),
    )
    tau = (F.col("n_tissues") - F.col("sx") / F.col("mx")) / (F.col("n_tissues") - 1)
    return agg.where("n_tissues >= 2 AND mx > 0").select(
        "feature_id", "n_tissues", F.col("top.grp").alias("top_tissue"), tau.alias("tau")
    )


def tissue_score(tau: Column, matches: Column) -> Column:
    """Score of a specificity index and whether the top tissue is expected."""
    return (
        F.when((tau >= 0.80) & matches, 0.90).when((tau >= 0.50) & matches, 0.65)
        .when(tau >= 0.80, 0.40).otherwise(0.20)
    )


def expressed_sets(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Size of the set of features expressed (>0) in each group."""
    return (
        df.where("value > 0").join(groups, "sample_id")
        .groupBy("grp").agg(F.count_distinct("feature_id").alias("n_features"))
    )


def expressed_overlap(df: DataFrame, groups: DataFrame) -> DataFrame:
    """How many features are expressed in exactly which groups (Venn regions)."""
    per = (
        df.where("value > 0").join(groups, "sample_id").groupBy("feature_id")
        .agg(F.array_join(F.sort_array(F.collect_set("grp")), "+").alias("region"))
    )
    return per.groupBy("region").agg(F.count(F.lit(1)).alias("n_features"))


def tissue_prior(queries: DataFrame, bias: DataFrame) -> DataFrame:
    """Score of a gene's tissue for a metabolite from known accumulation sites.

    ``queries``: query_id, metabolite, tissue (may be NULL); ``bias``:
    tissue, word. Unknown metabolite 0.30, no tissue 0.50, match 0.85, else
    0.25. Words and names match by containment either way.
    """
    from omiclattice.functions.scalars import contained_in

    q = settle(queries.select("query_id", F.lower("metabolite").alias("name"), F.lower("tissue").alias("own")))
    names = q.select("name").distinct()
    b = settle(bias.select(F.lower("tissue").alias("site"), F.lower("word").alias("word")).distinct())
    sites = (
        contained_in(b, "word", names, "name").select("name", "site")
        .unionByName(contained_in(names, "name", b, "word").select("name", "site")).distinct()
    )
    known = sites.select("name").distinct().withColumn("_k", F.lit(True))
    hit = sites.select("name", F.col("site").alias("own"), F.lit(True).alias("_m"))
    return q.join(known, "name", "left").join(hit, ["name", "own"], "left").select(
        "query_id",
        F.when(F.col("_k").isNull(), 0.30).when(F.col("own").isNull(), 0.50).when(F.col("_m"), 0.85).otherwise(0.25).alias("score"),
    )
