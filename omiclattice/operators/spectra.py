"""Mass arithmetic, formula candidates and spectrum annotation.

Tolerance matches are equi-joins on logarithmic mass buckets with an exact
check afterwards, so they shuffle like any hash join instead of comparing
every peak with every reference.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from omiclattice.functions.materialise import settle

# Monoisotopic masses, proton and electron.
MASSES = {
    "C": 12.0,
    "H": 1.00782503223,
    "N": 14.00307400443,
    "O": 15.99491461957,
    "S": 31.9720711744,
    "P": 30.97376199842,
}
PROTON = 1.007276466621
ELECTRON = 0.000548579909

# Adduct mass shifts.
ADDUCTS = {
    "[M+H]+": PROTON,
    "[M+Na]+": 22.989218 - ELECTRON,
    "[M+K]+": 38.963158 - ELECTRON,
    "[M+H-H2O]+": PROTON + 18.010564684,
    "[M]+": -ELECTRON,
    "[M-H]-": -PROTON,
    "[M+Cl]-": 34.96885268 - ELECTRON,
    "[M+CH3COO]-": 59.013851 - ELECTRON,
    "[M+2H]2+": 2 * PROTON,
    "[M+2H]": 2 * PROTON,
}
DOUBLY = ("[M+2H]2+", "[M+2H]")

# Order in which adducts are tried per polarity.
ADDUCT_ORDER = {
    "negative": ["[M-H]-", "[M+Cl]-", "[M+CH3COO]-"],
    "positive": ["[M+H]+", "[M]+", "[M+Na]+", "[M+K]+", "[M+H-H2O]+"],
    "": ["[M+H]+", "[M]+", "[M+Na]+", "[M-H]-", "[M+K]+", "[M+H-H2O]+", "[M+Cl]-"],
}

# Weight of a class rule by its stated confidence.
CONFIDENCE_WEIGHT = {"high": 1.0, "medium": 0.7, "low": 0.4}
GENERIC_NAMES = ["anthocyanin", "flavonoid", "alkaloid", "terpenoid"]


def neutral_mass(mz: Column, adduct: Column) -> Column:
    """Neutral mass of an ion; unknown adducts give NULL, 2+ doubles m/z."""
    out = F.lit(None).cast("double")
    for name, delta in ADDUCTS.items():
        factor = 2.0 if name in DOUBLY else 1.0
        out = F.when(adduct == name, mz * factor - F.lit(delta)).otherwise(out)
    return out


def ppm_error(obs: Column, ref: Column, tol: float) -> Column:
    """Error in ppm, NULL when the reference is not positive or out of range."""
    err = F.abs(obs - ref) / ref * 1e6
    return F.when((ref > 0) & (err <= tol), err)


def mass_bucket(mass: Column, tol_ppm: float) -> Column:
    """Bucket number such that masses within tolerance differ by at most one."""
    return F.floor(F.ln(mass) / F.lit(-math.log1p(-tol_ppm * 1e-6)))


def ppm_join(obs: DataFrame, ref: DataFrame, obs_mz: str, ref_mz: str, tol: float,
             on: list[str] | None = None) -> DataFrame:
    """All obs/ref rows within ``tol`` ppm, with ``ppm``.

    Reference rows go to three neighbouring buckets; a crowded bucket is an
    ordinary skewed join key that the adaptive skew join can split.
    """
    on = on or []
    left = obs.where(F.col(obs_mz) > 0).withColumn("_bkt", mass_bucket(F.col(obs_mz), tol))
    right = ref.where(F.col(ref_mz) > 0).withColumn("_c", mass_bucket(F.col(ref_mz), tol)).withColumn(
        "_bkt", F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1))
    ).drop("_c")
    return (
        left.join(right, on + ["_bkt"])
        .withColumn("ppm", ppm_error(F.col(obs_mz), F.col(ref_mz), tol))
        .where("ppm IS NOT NULL").drop("_bkt")
    )


def best_reference(matches: DataFrame, keys: list[str], cols: list[str], ref_mz: str) -> DataFrame:
    """Closest reference per key (ties to the smaller mass)."""
    best = matches.groupBy(*keys).agg(F.min(F.struct("ppm", ref_mz, *[c for c in cols if c != ref_mz])).alias("m"))
    return best.select(*keys, "m.*")


#: Peaks a task ranks: larger tables are dealt to more tasks than the session's setting.
RANK_ROWS = 1 << 18


def top_fragments(spectra: DataFrame, peaks: DataFrame, n: int = 20, extra: list[str] | None = None) -> DataFrame:
    """The n strongest peaks below 0.98 of the precursor, per scan (with ``extra`` columns of the spectra)."""
    scans, parts = spectra.select("scan_id", "precursor_mz", *(extra or [])), -(-peaks.count() // RANK_ROWS)
    if parts > int(peaks.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        scans, peaks = scans.repartition(parts, "scan_id"), peaks.repartition(parts, "scan_id")
    rows = peaks.join(scans, "scan_id").where(
        (F.col("mz") > 0) & (F.col("mz") < F.col("precursor_mz") * 0.98)
    )
    w = W.partitionBy("scan_id").orderBy(F.desc("intensity"), "mz")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# --- formulas ------------------------------------------------------------------
def rdbe(textbook: bool = False) -> Column:
    """Rings and double bonds; the default counts S as monovalent and
    subtracts P, ``textbook`` uses the usual valences."""
    c, h, n, s, p = (F.col(x) for x in "chnsp")
    if textbook:
        return c - h / 2.0 + (n + p) / 2.0 + 1.0
    return c - (h + s) / 2.0 + n / 2.0 + 1.0 - p


def hard_violations() -> Column:
    """Names of the broken hard composition rules."""
    c, h, n, o, s, p = (F.col(x) for x in "chnosp")
    r = rdbe()
    rule = lambda cond, name: F.when(cond, F.lit(name))
    return F.array_compact(F.array(
        rule(r < 0, "rdbe_invalid"), rule(r > 40, "rdbe_high"),
        rule((c > 0) & (h > 0) & (h / c > 3.5), "h_c"), rule((c > 0) & (n / c > 3), "n_c"),
        rule((c > 0) & (o / c > 4), "o_c"), rule(s / F.greatest(c, F.lit(1)) > 2, "s_c"),
        rule((c == 0) & ((o > 3) | (n > 3) | (p > 1)), "no_carbon"),
        rule(p > c + 1, "p_count"), rule(s > c + 2, "s_count"), rule(n > c + 3, "n_count"),
    ))


def soft_violations(mass: Column) -> Column:
    """Parity rules that ions may break."""
    c, h, n, o, s, p = (F.col(x) for x in "chnosp")
    rule = lambda cond, name: F.when(cond, F.lit(name))
    return F.array_compact(F.array(
        rule((mass > 0) & (h > 0) & ((F.rint(mass) + n) % 2 != 0), "nitrogen_rule"),
        rule((4 * c + h + 3 * n + 2 * o + 2 * s + 3 * p) % 2 != 0, "senior_parity"),
    ))


def compositions(spark: SparkSession, max_mass: Column | float, max_c: int = 60, max_h: int = 120,
                 max_n: int = 10, max_o: int = 30, max_s: int = 5, max_p: int = 3) -> DataFrame:
    """Every CHNOPS composition up to a mass: a fixed-size dimension table.

    One id range is decoded into atom counts, then hydrogens are added.
    """
    sizes = [max_c + 1, max_n + 1, max_o + 1, max_s + 1, max_p + 1]
    total = math.prod(sizes)
    df, rest = spark.range(total), F.col("id")
    for name, size in zip("cnosp", sizes):
        df = df.withColumn(name, (rest % size).cast("int"))
        rest = F.floor(rest / size)
    heavy = sum(F.col(x) * F.lit(MASSES[x.upper()]) for x in "cnosp")
    top = max_mass if isinstance(max_mass, Column) else F.lit(float(max_mass))
    df = df.withColumn("_heavy", heavy).withColumn("_top", top).where("_heavy <= _top")
    most = F.least(F.lit(max_h), F.floor((F.col("_top") - F.col("_heavy")) / MASSES["H"]).cast("int"))
    return (
        df.withColumn("h", F.explode(F.sequence(F.lit(0), most)))
        .withColumn("mass", F.col("_heavy") + F.col("h") * F.lit(MASSES["H"]))
        .where("mass > 0").select("c", "h", "n", "o", "s", "p", "mass")
    )


def formula_text() -> Column:
    part = lambda x: F.when(F.col(x) > 0, F.concat(F.lit(x.upper()), F.col(x).cast("string"))).otherwise("")
    return F.concat(*[part(x) for x in "chnosp"])


#: Most atoms of each element.
LIMITS = {"max_c": 60, "max_h": 120, "max_n": 10, "max_o": 30, "max_s": 5, "max_p": 3}
#: Rows of the C, H, O half that are broadcast, and mass x N, S, P rows a task handles.
HALF_ROWS, TASK_ROWS = 1 << 20, 1 << 19


def _decoded(df: DataFrame, code: str, atoms: str, limits: dict) -> DataFrame:
    """Atom counts of each code, the first element varying fastest."""
    rest = F.col(code)
    for x in atoms:
        size = limits[f"max_{x}"] + 1
        df, rest = df.withColumn(x, (rest % size).cast("int")), F.floor(rest / size)
    return df


def _weight(atoms: str) -> Column:
    return sum(F.col(x) * F.lit(MASSES[x.upper()]) for x in atoms)


def _most_codes(atoms: str, limits: dict) -> int:
    return math.prod(limits[f"max_{x}"] + 1 for x in atoms)


def half_masses(spark: SparkSession, top: Column, limits: dict, clean: bool) -> DataFrame:
    """The C, H, O half of every composition up to a mass, by ``half``.

    ``clean`` leaves out counts that break a hard rule whatever N, S and P are.
    """
    df = _decoded(spark.range(_most_codes("cho", limits)), "id", "cho", limits).withColumn("half", _weight("cho"))
    df = df.withColumn("_top", top).where("half <= _top")
    if clean:
        c, h, o = F.col("c"), F.col("h"), F.col("o")
        spare = limits["max_n"] + 2  # hydrogens beyond 2 C that nitrogen and the chain ends can hold
        df = df.where((h <= 2 * c + spare) & F.when(c > 0, (h <= 3.5 * c) & (o <= 4 * c)).otherwise(o <= 3))
    return df.select("c", "h", "o", "half")


def formula_hits(masses: DataFrame, ppm: float, clean: bool = False, atoms: str = "nsp", **limits) -> DataFrame:
    """Compositions within ppm of each ``neutral`` mass: two half-tables that meet in the middle.

    Every mass less every N, S, P half (a few hundred) leaves a residual for
    C, H and O, which meets the C, H, O half in narrow mass buckets. No table of whole
    compositions is built, so the work grows with masses, not with the mass
    range. ``clean``: only compositions without hard violations.
    ``atoms``: which of N, S and P may occur.
    """
    spark, limits = masses.sparkSession, LIMITS | limits
    limits |= {f"max_{x}": 0 for x in "nsp" if x not in atoms}
    slack = 1.01e-6 * ppm
    top = masses.agg(F.max("neutral") * (1 + slack)).scalar()
    n_half, n_other = _most_codes("cho", limits), _most_codes("nsp", limits)
    parts = max(1, -(-masses.count() * n_other // TASK_ROWS))
    asked = masses.withColumn("_top", top).repartition(parts, "neutral")
    # twice the widest window, so that a window lies in at most two buckets
    width = F.col("_top") * (2 * slack)
    asked = asked.withColumn("_code", F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    asked = _decoded(asked, "_code", "nsp", limits).withColumn("_rest", F.col("neutral") - _weight("nsp"))
    if clean:
        n, s, p = F.col("n"), F.col("s"), F.col("p")
        least = F.greatest(p - 1, s - 2, n - 3, F.lit(0))  # carbons that the count rules ask for
        asked = asked.where(F.col("_rest") >= least * MASSES["C"] - F.col("neutral") * slack)
    asked = asked.where(F.col("_rest") >= -F.col("neutral") * slack)
    ends = [F.floor((F.col("_rest") + side * slack * F.col("neutral")) / width) for side in (-1, 1)]
    asked = asked.withColumn("_bkt", F.explode(F.array_distinct(F.array(*ends))))
    half = half_masses(spark, top, limits, clean).withColumn("_t", top).withColumn("_bkt", F.floor(F.col("half") / (F.col("_t") * (2 * slack)))).drop("_t")
    near = F.abs(F.col("half") - F.col("_rest")) <= slack * F.col("neutral")
    # the half has at most n_half rows of three counts and a mass, known from the limits
    met = asked.join(F.broadcast(half) if n_half <= HALF_ROWS else half, "_bkt").where(near)
    met = met.withColumn("mass", _weight("cnosp") + F.col("h") * F.lit(MASSES["H"])).where("mass > 0")
    met = met.withColumn("ppm", ppm_error(F.col("mass"), F.col("neutral"), ppm)).where("ppm IS NOT NULL")
    if clean:
        met = met.where(F.size(hard_violations()) == 0)
    return met.select("neutral", *"chnosp", "mass", "ppm")


def formula_candidates(masses: DataFrame, mass: str, ppm: float = 5.0, **limits) -> DataFrame:
    """All formulas within ppm of each distinct mass, with rule violations."""
    distinct = settle(masses.select(F.col(mass).alias("neutral")).where("neutral > 0").distinct())
    return formula_hits(distinct, ppm, **limits).select(
        F.col("neutral").alias(mass), formula_text().alias("formula"), F.col("mass").alias("calc_mass"),
        "ppm", rdbe().alias("rdbe"), hard_violations().alias("hard"), soft_violations(F.col("neutral")).alias("soft"),
    )


def rank_formulas(cands: DataFrame, mass: str, top_k: int = 20) -> DataFrame:
    """Best formulas per mass by hard, then soft violations, then error."""
    w = W.partitionBy(mass).orderBy(F.size("hard"), F.size("soft"), "ppm", "formula")
    return cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def clean_masses(masses: DataFrame, ppm: float, **limits) -> DataFrame:
    """The masses (column ``neutral``) that have a formula without hard violations.

    Most masses have one of C, H, N and O alone; S and P are tried for the others.
    """
    distinct = settle(masses.where("neutral > 0").distinct())
    plain = settle(formula_hits(distinct, ppm, True, "n", **limits).select("neutral").distinct())
    rest = settle(distinct.join(plain, "neutral", "left_anti"))
    return plain.union(formula_hits(rest, ppm, True, **limits).select("neutral").distinct())


def infer_adducts(spectra: DataFrame, ppm: float = 10.0, **limits) -> DataFrame:
    """Adduct and neutral mass per scan, and whether a clean formula exists.

    A stated known adduct is kept; else the first of the polarity's order
    with a formula free of hard violations; else the polarity's default.
    Scans of one precursor, polarity and stated adduct are tried once.
    """
    known = F.coalesce(F.col("adduct").isin(list(ADDUCTS)), F.lit(False))
    scans = spectra.select(
        "scan_id", "precursor_mz", F.coalesce("polarity", F.lit("")).alias("pol"), F.when(known, F.col("adduct")).otherwise("").alias("given"))
    kinds = settle(scans.select("precursor_mz", "pol", "given").distinct())
    order = F.when(F.col("pol") == "negative", F.array(*map(F.lit, ADDUCT_ORDER["negative"]))).when(
        F.col("pol") == "positive", F.array(*map(F.lit, ADDUCT_ORDER["positive"]))
    ).otherwise(F.array(*map(F.lit, ADDUCT_ORDER[""])))
    tries = kinds.withColumn("_o", F.when(F.col("given") != "", F.array("given")).otherwise(order)).select(
        "precursor_mz", "pol", "given", F.posexplode("_o").alias("pos", "try")
    ).withColumn("neutral", neutral_mass(F.col("precursor_mz"), F.col("try")))
    tries = settle(tries)
    ok = clean_masses(tries.select("neutral"), ppm, **limits).withColumn("ok", F.lit(True))
    tried = settle(tries.join(ok, "neutral", "left").groupBy("precursor_mz", "pol", "given").agg(
        F.min(F.when(F.col("ok"), F.struct("pos", "try"))).alias("hit"),
        F.max(F.when(F.col("pos") == 0, F.col("try"))).alias("head"), F.count(F.lit(1)).alias("n"),
    ))
    best = same_rows(scans, tried, ["precursor_mz", "pol", "given"]).groupBy("scan_id").agg(
        F.min(F.struct("precursor_mz", "pol")).alias("of"), F.min("hit").alias("hit"), F.max("head").alias("head"), F.sum("n").alias("n"),
    ).select("scan_id", "of.*", "hit", "head", "n")
    fallback = F.when(F.col("n") == 1, F.col("head")).when(F.col("pol") == "negative", "[M-H]-").otherwise("[M+H]+")
    return best.select(
        "scan_id", "precursor_mz", F.coalesce("hit.try", fallback).alias("adduct"),
        F.col("hit").isNotNull().alias("formula_ok"),
    ).withColumn("neutral_mass", neutral_mass(F.col("precursor_mz"), F.col("adduct")))


def same_rows(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns where NULL equals NULL; the columns of ``rows`` stay."""
    other = other.withColumnsRenamed({c: f"_same_{c}" for c in on})
    match = [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in on]
    return rows.join(other, match, how).drop(*[f"_same_{c}" for c in on])


# --- annotation --------------------------------------------------------------------
def mass_matches(masses: DataFrame, fragments: DataFrame, tol: float = 10.0) -> DataFrame:
    """The closest reference of each class to each distinct ``mz``."""
    distinct = settle(masses.select("mz").distinct())
    return best_reference(ppm_join(distinct, fragments, "mz", "ref_mz", tol), ["class", "mz"], ["ref_mz"], "ref_mz")


def class_matches(top: DataFrame, fragments: DataFrame, tol: float = 10.0, masses: DataFrame | None = None) -> DataFrame:
    """Matched peaks per scan and class, each to its closest reference.

    What a peak matches depends on its m/z alone: distinct m/z are matched once and the scans' peaks look them up.
    ``masses`` is a table with every ``mz`` of ``top``, where that is cheaper to read.
    """
    met = settle(mass_matches(top if masses is None else masses, fragments, tol))
    return top.select("scan_id", "mz").distinct().join(met, "mz").select("scan_id", "class", "mz", "ppm", "ref_mz")


def loss_counts(precursors: DataFrame, fragments: DataFrame, losses: DataFrame, tol: float = 10.0) -> DataFrame:
    """Reference fragments of each class that a neutral loss explains, for each distinct ``precursor_mz``.

    Fragment + loss is the precursor to look for: these sums are made where their fragment lies and
    looked up at once, so they are never shuffled; only one row a fragment, precursor and task leaves.
    """
    asked = settle(precursors.select("precursor_mz").where("precursor_mz > 0").distinct())
    near = asked.withColumn("_c", mass_bucket(F.col("precursor_mz"), tol)).select("precursor_mz", F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1)).alias("_bkt"))
    own = settle(fragments.select("class", "ref_mz").distinct()).repartition("class", "ref_mz")
    sums = own.join(settle(losses.select("class", "delta").distinct()), "class").withColumn("expected", F.col("ref_mz") + F.col("delta")).where("expected > 0")
    hit = sums.withColumn("_bkt", mass_bucket(F.col("expected"), tol)).join(settle(near), "_bkt")
    # an error within tol of the loss is within tol of the larger sum
    hit = hit.where(ppm_error(F.col("precursor_mz"), F.col("expected"), tol).isNotNull() & ppm_error(F.col("precursor_mz") - F.col("ref_mz"), F.col("delta"), tol).isNotNull())
    return hit.select("class", "precursor_mz", "ref_mz").distinct().groupBy("class", "precursor_mz").agg(F.count(F.lit(1)).alias("n_losses"))


def class_losses(cands: DataFrame, fragments: DataFrame, losses: DataFrame, tol: float = 10.0,
                 observed: DataFrame | None = None, precursors: DataFrame | None = None) -> DataFrame:
    """Neutral losses per scan and class, at most one per fragment.

    Losses are measured from the class's reference fragments, or from the
    observed peaks when ``observed`` (scan_id, mz) is given. ``precursors`` is a table
    with every ``precursor_mz`` of ``cands``, where that is cheaper to read.
    """
    if observed is not None:
        rows = cands.select("scan_id", "class", "precursor_mz").join(observed, "scan_id")
        rows = rows.select("scan_id", "class", F.col("mz").alias("frag"), (F.col("precursor_mz") - F.col("mz")).alias("gap"))
        hit = ppm_join(rows, losses, "gap", "delta", tol, on=["class"])
        return hit.groupBy("scan_id", "class").agg(F.count_distinct("frag").alias("n_losses"))
    counts = settle(loss_counts(cands if precursors is None else precursors, fragments, losses, tol))
    return cands.select("scan_id", "class", "precursor_mz").join(counts, ["class", "precursor_mz"]).select("scan_id", "class", "n_losses")


#: What a marker hit depends on.
ION = ["precursor_mz", "adduct", "neutral_mass"]


def marker_ions(ions: DataFrame, markers: DataFrame, tol: float = 10.0) -> DataFrame:
    """Species marker metabolites of each distinct ion (columns ``ION``), with ``name`` and ``ppm``.

    Neutral masses are compared first; a singly charged ion may also match
    the marker's own m/z.
    """
    kinds = settle(ions.select(*ION).distinct())
    m = markers.withColumn("marker_neutral", F.coalesce(
        neutral_mass(F.col("marker_mz"), F.col("marker_adduct")), F.col("marker_mz") - F.lit(PROTON)
    ))
    a = ppm_join(kinds, m, "neutral_mass", "marker_neutral", tol).withColumn("way", F.lit(1))
    b = ppm_join(kinds.where(~F.col("adduct").endswith("2+")), m, "precursor_mz", "marker_mz", tol).withColumn("way", F.lit(2))
    both = a.unionByName(b).groupBy(*ION, "name").agg(F.min(F.struct("way", "ppm")).alias("h"))
    return both.select(*ION, "name", F.col("h.ppm").alias("ppm"))


def of_scans(ions: DataFrame, per_ion: DataFrame) -> DataFrame:
    """Rows of distinct ions for every scan with that ion."""
    return same_rows(ions.select("scan_id", *ION), per_ion, ION)


def marker_hits(ions: DataFrame, markers: DataFrame, tol: float = 10.0) -> DataFrame:
    """Species marker metabolites seen as precursors (``ions``: one row a scan).

    Scans of one ion share its hits, which meet the scans last.
    """
    return of_scans(ions, settle(marker_ions(ions, markers, tol))).select("scan_id", "name", "ppm")


def annotate(spectra: DataFrame, peaks: DataFrame, classes: DataFrame, fragments: DataFrame,
             losses: DataFrame, prior_classes: list[str] | None = None, tol: float = 10.0,
             min_matched: int = 1, top: int = 8, extra: list[str] | None = None, **limits) -> DataFrame:
    """Ranked compound-class candidates per scan (with ``extra`` columns of the ion, such as ``precursor_mz``).

    Score: matched share x rule weight, +0.15 per neutral loss, +0.25 when
    the class mass fits, +0.1 for classes expected in the species; level 2
    needs two matches and a clean formula, else level 3.
    """
    ions = settle(infer_adducts(spectra, tol, **limits))
    own = [*ION, "formula_ok"]
    # each peak brings its ion, so that scans are dealt out once and candidates stay where they are made
    peaks_of = top_fragments(ions, peaks, extra=own[1:]).select("scan_id", *own, "mz").distinct()
    matched = peaks_of.join(settle(mass_matches(peaks, fragments, tol)).select("class", "mz"), "mz")
    counts = matched.groupBy("scan_id", *own, "class").agg(F.count(F.lit(1)).alias("n_matched")).where(
        F.col("n_matched") >= min_matched
    )
    n_ref = fragments.groupBy("class").agg(F.count(F.lit(1)).alias("n_ref"))
    cands = counts.join(settle(classes.join(n_ref, "class")), "class")
    lost = settle(loss_counts(ions, fragments, losses, tol))
    weight = F.coalesce(
        F.create_map(*[F.lit(x) for kv in CONFIDENCE_WEIGHT.items() for x in kv])[F.col("confidence")], F.lit(0.7)
    )
    mass_fit = ppm_error(F.col("neutral_mass"), F.col("class_mass"), tol).isNotNull()
    one = F.lit(1.0)
    scored = cands.join(lost, ["class", "precursor_mz"], "left").withColumn("n_losses", F.coalesce("n_losses", F.lit(0)))
    score = F.col("n_matched") / F.greatest("n_ref", F.lit(1)) * weight
    score = F.when(F.col("n_losses") > 0, F.least(score + 0.15 * F.col("n_losses"), one)).otherwise(score)
    score = F.when(mass_fit, F.least(score + 0.25, one)).otherwise(score)
    if prior_classes:
        score = F.when(F.col("class").isin(prior_classes), F.least(score + 0.1, one)).otherwise(score)
    named = F.get(F.filter("known_metabolites", lambda k: ~k.isin(GENERIC_NAMES) & (F.length(k) > 3)), F.lit(0))
    w = W.partitionBy("scan_id").orderBy(F.desc("score"), "class")
    return (
        scored.withColumn("score", F.round(score, 3))
        .withColumn("msi_level", F.when((F.col("n_matched") >= 2) & F.col("formula_ok"), 2).otherwise(3))
        .withColumn("name", F.when(mass_fit, F.coalesce(named, F.col("class"))))
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        .select("scan_id", "rank", "class", "msi_level", "score", "n_matched", "n_losses", "adduct",
                "neutral_mass", "name", *(extra or []))
    )


def target_markers(hits: DataFrame, markers: DataFrame, target: str = "") -> DataFrame:
    """Marker hits with ``label`` and whether it names the ``target`` metabolite (any case; no target, no match)."""
    match = F.contains(F.lower("label"), F.lit(target.lower())) if target else F.lit(False)
    return hits.join(markers.select("name", "label"), "name").withColumn("target_match", match)


def marker_names(annotated: DataFrame, hits: DataFrame, markers: DataFrame, classes: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Annotated candidates with the names, formulas and masses of the markers seen in their scans.

    ``markers`` has name (its key in ``hits``), label, formula, marker_mz and pos. A marker names
    the candidates whose class contains its label (of a class without a name: whose known
    metabolites do); of several the last by ``pos`` names, and the last that has one gives formula and
    mass. Without a marker a candidate that fits its class mass has the class's formula and
    mass. ``species_anchor`` tells the scans with any marker. ``on``: the columns by which hits belong
    to candidates (``scan_id``, or ``ION`` for hits of distinct ions).
    """
    on = on or ["scan_id"]
    known = settle(classes.select("class", F.col("formula").alias("_cf"), F.col("class_mass").alias("_cm"), F.lower(F.array_join("known_metabolites", " ")).alias("_known")))
    has = lambda c, cond: F.when(cond, F.struct(F.col("pos").alias("p"), F.col(c).alias("v")))
    marks = markers.select("name", "label", "pos", has("formula", F.col("formula") != "").alias("_f"), has("marker_mz", F.col("marker_mz") > 0).alias("_m"))
    best = [F.max("_l").alias("_l"), F.max("_f").alias("_f"), F.max("_m").alias("_m")]
    # the last marker of each label, then of all labels that a class contains
    labels = hits.select(*on, "name").join(marks, "name").withColumn("_l", F.struct(F.col("pos").alias("p"), F.col("label").alias("v"))).groupBy(*on, "label").agg(*best)
    text = F.when(F.coalesce("class", F.lit("")) != "", F.lower("class")).otherwise(F.col("_known"))
    fit = settle(markers.select("label").distinct().join(known.select("class", text.alias("_text")), F.contains("_text", F.lower("label"))).drop("_text"))
    named = settle(labels.join(fit, "label").groupBy(*on, "class").agg(*best).select(
        *on, "class", F.col("_l.v").alias("_label"), F.col("_f.v").alias("_lf"), F.col("_m.v").alias("_lm")))
    anchors = settle(hits.select(*on).distinct().withColumn("_anchor", F.lit(True)))
    rows = same_rows(same_rows(annotated.join(known.drop("_known"), "class"), named, [*on, "class"], "left"), anchors, on, "left")
    fits = F.col("name").isNotNull()
    return rows.withColumns({
        "formula": F.coalesce("_lf", F.when(fits, F.col("_cf"))), "mass": F.coalesce("_lm", F.when(fits, F.col("_cm"))),
        "name": F.coalesce("_label", "name"), "species_anchor": F.coalesce("_anchor", F.lit(False)),
    }).drop("_cf", "_cm", "_label", "_lf", "_lm", "_anchor")


def annotation_table(annotated: DataFrame) -> DataFrame:
    """Best class per scan, as written to the annotation file."""
    return annotated.where("rank = 1").drop("rank")


def msi_counts(annotated: DataFrame) -> DataFrame:
    return annotation_table(annotated).groupBy("msi_level").agg(F.count(F.lit(1)).alias("n"))
