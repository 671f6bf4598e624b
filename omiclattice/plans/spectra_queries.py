"""Queries on spectra derived from orders (scans) and their lines (peaks)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from omiclattice.functions.materialise import settle, shared_dir
from omiclattice.operators import spectra as sp
from omiclattice.plans.matrix_queries import R
from omiclattice.plans.registry import query
from omiclattice.plans.views import table
from omiclattice.sources import spectra as src

TOL = 20.0

_SPEC = """spec AS (SELECT 'S' || o_orderkey AS scan_id, round(120 + (o_totalprice * 7) % 300, 4) AS precursor_mz,
    CASE o_orderstatus WHEN 'F' THEN 'positive' WHEN 'O' THEN 'negative' END AS polarity, CASE WHEN o_orderkey % 10 = 0 THEN '[M+Na]+' END AS adduct FROM orders),
  peaks AS (SELECT 'S' || l_orderkey AS scan_id, round(50 + (l_extendedprice * 3) % 250, 4) AS mz, l_quantity AS intensity FROM lineitem),
  frag AS (SELECT DISTINCT p_brand AS class, round(50 + (p_partkey * 7.31::DOUBLE) % 250, 4) AS ref_mz FROM part),
  loss AS (SELECT DISTINCT 'Brand#' || (1 + s_suppkey % 25) AS class, round(10 + (s_suppkey * 3.7::DOUBLE) % 120, 4) AS delta FROM supplier),
  cls AS (SELECT p_brand AS class, CASE length(p_brand) WHEN 7 THEN 'high' ELSE 'medium' END AS confidence,
    round(119 + min(p_retailprice * 11) % 300, 4) AS class_mass, [p_brand, 'alkaloid'] AS known_metabolites FROM part GROUP BY p_brand)"""


def spectra_view(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("scan_id"),
        F.round(120 + (F.col("o_totalprice") * 7) % 300, 4).alias("precursor_mz"),
        F.when(F.col("o_orderstatus") == "F", "positive").when(F.col("o_orderstatus") == "O", "negative").alias("polarity"),
        F.when(F.col("o_orderkey") % 10 == 0, "[M+Na]+").alias("adduct"),
    )


def peaks_view(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_orderkey").cast("string")).alias("scan_id"),
        F.round(50 + (F.col("l_extendedprice") * 3) % 250, 4).alias("mz"), F.col("l_quantity").alias("intensity"),
    )


def rules_view(spark, sf):
    """(classes, fragments, losses) from part and supplier."""
    p = table(spark, sf, "part")
    frag = p.select(
        F.col("p_brand").alias("class"),
        F.round(50 + (F.col("p_partkey") * F.lit(7.31)) % 250, 4).alias("ref_mz"),
    ).distinct()
    cls = p.groupBy(F.col("p_brand").alias("class")).agg(
        F.round(119 + (F.min(F.col("p_retailprice") * 11)) % 300, 4).alias("class_mass")
    ).select(
        "class", F.when(F.length("class") == 7, "high").otherwise("medium").alias("confidence"), "class_mass",
        F.array(F.col("class"), F.lit("alkaloid")).alias("known_metabolites"),
    )
    k = F.col("s_suppkey")
    loss = table(spark, sf, "supplier").select(
        F.concat(F.lit("Brand#"), (1 + k % 25).cast("string")).alias("class"),
        F.round(10 + (k * F.lit(3.7)) % 120, 4).alias("delta"),
    ).distinct()
    return cls, frag, loss


def _neutral(mz, adduct):
    rows = " ".join(
        f"WHEN '{a}' THEN {mz} * {2.0 if a in sp.DOUBLY else 1.0} - {d!r}" for a, d in sp.ADDUCTS.items()
    )
    return f"(CASE {adduct} {rows} END)"


_TOP = """topf AS (SELECT * FROM (SELECT scan_id, mz, intensity, precursor_mz, row_number() OVER (PARTITION BY scan_id ORDER BY intensity DESC, mz) AS rank
  FROM peaks JOIN spec USING (scan_id) WHERE mz > 0 AND mz < precursor_mz * 0.98) WHERE rank <= 20)"""
_MATCH = f"""mt AS (SELECT scan_id, class, mz, min(abs(mz - ref_mz) / ref_mz * 1e6) AS ppm FROM (SELECT DISTINCT scan_id, mz FROM topf) JOIN frag
  ON ref_mz BETWEEN mz * (1 - 2.1e-5) AND mz * (1 + 2.1e-5) WHERE abs(mz - ref_mz) / ref_mz * 1e6 <= {TOL} GROUP BY 1, 2, 3)"""


@query("top_fragments", f"WITH {_SPEC}, {_TOP} SELECT scan_id, mz, intensity, rank FROM topf")
def top_fragments(spark, sf):
    return sp.top_fragments(spectra_view(spark, sf), peaks_view(spark, sf)).select("scan_id", "mz", "intensity", "rank")


@query("ppm_range_join", f"""WITH {_SPEC} SELECT scan_id, mz, class, ref_mz, round(abs(mz - ref_mz) / ref_mz * 1e6, 4) AS ppm FROM peaks JOIN frag
  ON ref_mz BETWEEN mz * (1 - 2.1e-5) AND mz * (1 + 2.1e-5) WHERE abs(mz - ref_mz) / ref_mz * 1e6 <= {TOL}""")
def ppm_range_join(spark, sf):
    _, frag, _ = rules_view(spark, sf)
    hit = sp.ppm_join(peaks_view(spark, sf), frag, "mz", "ref_mz", TOL)
    return hit.select("scan_id", "mz", "class", "ref_mz", R("ppm", 4).alias("ppm"))


@query("class_fragment_matches", f"WITH {_SPEC}, {_TOP}, {_MATCH} SELECT scan_id, class, mz, round(ppm, 4) AS ppm FROM mt")
def class_fragment_matches(spark, sf):
    _, frag, _ = rules_view(spark, sf)
    peaks = peaks_view(spark, sf)
    return sp.class_matches(sp.top_fragments(spectra_view(spark, sf), peaks), frag, TOL, peaks).select("scan_id", "class", "mz", R("ppm", 4).alias("ppm"))


_LOSS = f"""cand AS (SELECT DISTINCT scan_id, class, precursor_mz FROM mt JOIN spec USING (scan_id)),
  ls AS (SELECT scan_id, class, count(DISTINCT ref_mz) AS n_losses FROM cand JOIN frag USING (class) JOIN loss USING (class)
    WHERE abs((precursor_mz - ref_mz) - delta) / delta * 1e6 <= {TOL} GROUP BY 1, 2)"""


@query("neutral_losses", f"WITH {_SPEC}, {_TOP}, {_MATCH}, {_LOSS} SELECT scan_id, class, n_losses FROM ls")
def neutral_losses(spark, sf):
    _, frag, loss = rules_view(spark, sf)
    spec, peaks = spectra_view(spark, sf), peaks_view(spark, sf)
    met = settle(sp.mass_matches(peaks, frag, TOL)).select("class", "mz")
    cands = sp.top_fragments(spec, peaks).join(met, "mz").select("scan_id", "class", "precursor_mz").distinct()
    return sp.class_losses(cands, frag, loss, TOL, precursors=spec)


@query("adduct_neutral_mass", f"""WITH {_SPEC}, a AS (SELECT unnest([{', '.join(repr(a) for a in sp.ADDUCTS)}]) AS ad)
  SELECT scan_id, ad AS adduct, round({_neutral('precursor_mz', 'ad')}, 6) AS neutral_mass FROM spec, a""")
def adduct_neutral_mass(spark, sf):
    d = spectra_view(spark, sf).select(
        "scan_id", "precursor_mz", F.explode(F.array(*map(F.lit, sp.ADDUCTS))).alias("adduct")
    )
    return d.select("scan_id", "adduct", R(sp.neutral_mass(F.col("precursor_mz"), F.col("adduct"))).alias("neutral_mass"))


_L = sp.LIMITS
# every composition up to the heaviest mass that is asked for; queries meet it in mass buckets of 1 mDa
_COMP = f"""heavy AS (SELECT c, n, o, s, p, c * 12.0::DOUBLE + n * {sp.MASSES['N']}::DOUBLE + o * {sp.MASSES['O']}::DOUBLE + s * {sp.MASSES['S']}::DOUBLE + p * {sp.MASSES['P']}::DOUBLE AS hm
    FROM range(0, {_L['max_c'] + 1}) a(c), range(0, {_L['max_n'] + 1}) d(n), range(0, {_L['max_o'] + 1}) e(o), range(0, {_L['max_s'] + 1}) f(s), range(0, {_L['max_p'] + 1}) g(p)),
  light AS (SELECT * FROM heavy, (SELECT max(precursor_mz) + 25 AS top FROM spec) WHERE hm <= top),
  comp AS (SELECT c, h, n, o, s, p, hm + h * {sp.MASSES['H']}::DOUBLE AS mass, c - (h + s) / 2.0 + n / 2.0 + 1 - p AS rdbe
    FROM light, range(0, {_L['max_h'] + 1}) b(h) WHERE hm + h * {sp.MASSES['H']}::DOUBLE <= top AND c + h + n + o + s + p > 0),
  cv AS (SELECT *, floor(mass * 1000)::BIGINT AS mda, (rdbe < 0)::INT + (rdbe > 40)::INT + (c > 0 AND h > 0 AND h > 3.5 * c)::INT + (c > 0 AND n > 3 * c)::INT + (c > 0 AND o > 4 * c)::INT
    + (s > 2 * greatest(c, 1))::INT + (c = 0 AND (o > 3 OR n > 3 OR p > 1))::INT + (p > c + 1)::INT + (s > c + 2)::INT + (n > c + 3)::INT AS hard,
    (4 * c + h + 3 * n + 2 * o + 2 * s + 3 * p) % 2 AS par FROM comp)"""
_MDA = lambda src, ppm: f"""(SELECT neutral, unnest(range(floor(neutral * (1 - {ppm * 1.01e-6}) * 1000)::BIGINT, floor(neutral * (1 + {ppm * 1.01e-6}) * 1000)::BIGINT + 1)) AS mda FROM {src})"""
_FORM = lambda src, ppm: f"""fm AS (SELECT neutral, c, h, n, o, s, p, mass, rdbe, hard, par + (h > 0 AND (round_even(neutral, 0) + n) % 2 <> 0)::INT AS soft,
    abs(mass - neutral) / neutral * 1e6 AS ppm FROM {_MDA(src, ppm)} JOIN cv USING (mda) WHERE abs(mass - neutral) / neutral * 1e6 <= {ppm})"""
_FTEXT = "concat(" + ", ".join(f"CASE WHEN {x} > 0 THEN '{x.upper()}' || {x} ELSE '' END" for x in "chnosp") + ")"


@query("formula_enumeration", f"""WITH {_SPEC}, {_COMP}, nm AS (SELECT DISTINCT precursor_mz - {sp.PROTON!r} AS neutral FROM spec), {_FORM('nm', 5.0)},
  r AS (SELECT *, {_FTEXT} AS formula FROM fm), k AS (SELECT *, row_number() OVER (PARTITION BY neutral ORDER BY hard, soft, ppm, formula) AS rank FROM r)
  SELECT round(neutral, 6) AS neutral, rank, formula, round(ppm, 4) AS ppm, rdbe, hard AS n_hard, soft AS n_soft FROM k WHERE rank <= 8""")
def formula_enumeration(spark, sf):
    m = spectra_view(spark, sf).select((F.col("precursor_mz") - F.lit(sp.PROTON)).alias("neutral"))
    top = sp.rank_formulas(sp.formula_candidates(m, "neutral", 5.0), "neutral", 8)
    return top.select(
        R("neutral").alias("neutral"), "rank", "formula", R("ppm", 4).alias("ppm"), "rdbe",
        F.size("hard").alias("n_hard"), F.size("soft").alias("n_soft"),
    )


_ORD = lambda pol: "[" + ", ".join(repr(a) for a in sp.ADDUCT_ORDER[pol]) + "]"
_ION = f"""tr0 AS (SELECT scan_id, precursor_mz, coalesce(polarity, '') AS pol, CASE WHEN adduct IS NOT NULL THEN [adduct] WHEN polarity = 'negative' THEN {_ORD('negative')}
    WHEN polarity = 'positive' THEN {_ORD('positive')} ELSE {_ORD('')} END AS o FROM spec),
  tr AS (SELECT scan_id, precursor_mz, pol, len(o) AS n, generate_subscripts(o, 1) AS pos, unnest(o) AS ad FROM tr0),
  tn AS (SELECT *, {_neutral('precursor_mz', 'ad')} AS neutral FROM tr), dn AS (SELECT DISTINCT neutral FROM tn WHERE neutral > 0),
  cb AS (SELECT DISTINCT mass, mda FROM cv WHERE hard = 0),
  okn AS (SELECT DISTINCT neutral FROM {_MDA('dn', TOL)} JOIN cb USING (mda) WHERE abs(mass - neutral) / neutral * 1e6 <= {TOL}),
  ion0 AS (SELECT scan_id, any_value(precursor_mz) AS precursor_mz, any_value(pol) AS pol, any_value(n) AS n, max(ad) FILTER (pos = 1) AS head,
    min((pos, ad)) FILTER (okn.neutral IS NOT NULL) AS hit FROM tn LEFT JOIN okn ON tn.neutral = okn.neutral GROUP BY 1),
  ion AS (SELECT scan_id, precursor_mz, hit IS NOT NULL AS formula_ok, CASE WHEN hit IS NOT NULL THEN hit[2] WHEN n = 1 THEN head WHEN pol = 'negative' THEN '[M-H]-' ELSE '[M+H]+' END AS adduct FROM ion0)"""


@query("adduct_inference", f"WITH {_SPEC}, {_COMP}, {_ION} SELECT scan_id, adduct, formula_ok, round({_neutral('precursor_mz', 'adduct')}, 6) AS neutral_mass FROM ion")
def adduct_inference(spark, sf):
    ions = sp.infer_adducts(spectra_view(spark, sf), TOL)
    return ions.select("scan_id", "adduct", "formula_ok", R("neutral_mass").alias("neutral_mass"))


_ANN = f"""WITH {_SPEC}, {_TOP}, {_MATCH}, {_LOSS}, {_COMP}, {_ION}, im AS (SELECT *, {_neutral('precursor_mz', 'adduct')} AS neutral_mass FROM ion),
  nr AS (SELECT class, count(*) AS n_ref FROM frag GROUP BY 1), mc AS (SELECT scan_id, class, count(*) AS n_matched FROM mt GROUP BY 1, 2),
  s0 AS (SELECT *, coalesce(ls.n_losses, 0) AS nl, n_matched / n_ref * CASE confidence WHEN 'high' THEN 1.0 ELSE 0.7 END AS b,
    abs(neutral_mass - class_mass) / class_mass * 1e6 <= {TOL} AS fit FROM mc JOIN im USING (scan_id) JOIN cls USING (class) JOIN nr USING (class) LEFT JOIN ls USING (scan_id, class)),
  s1 AS (SELECT *, CASE WHEN nl > 0 THEN least(b + 0.15 * nl, 1.0) ELSE b END AS b1 FROM s0),
  s2 AS (SELECT *, CASE WHEN fit THEN least(b1 + 0.25, 1.0) ELSE b1 END AS b2 FROM s1),
  s3 AS (SELECT *, CASE WHEN class IN ('Brand#1', 'Brand#2') THEN least(b2 + 0.1, 1.0) ELSE b2 END AS b3 FROM s2),
  s4 AS (SELECT *, round(b3, 3) AS score, CASE WHEN n_matched >= 2 AND formula_ok THEN 2 ELSE 3 END AS msi_level FROM s3),
  an AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, class) AS rank FROM s4)"""


def _annotated(spark, sf, **kw):
    cls, frag, loss = rules_view(spark, sf)
    return sp.annotate(
        spectra_view(spark, sf), peaks_view(spark, sf), cls, frag, loss, ["Brand#1", "Brand#2"], TOL, **kw
    )


@query("spectrum_annotation", _ANN + """ SELECT scan_id, rank, class, msi_level, score, n_matched, nl AS n_losses, adduct,
  CASE WHEN fit THEN class END AS name FROM an WHERE rank <= 8""")
def spectrum_annotation(spark, sf):
    return _annotated(spark, sf).drop("neutral_mass")


@query("msi_level_counts", _ANN + " SELECT msi_level, count(*) AS n FROM an WHERE rank = 1 GROUP BY 1")
def msi_level_counts(spark, sf):
    return sp.msi_counts(_annotated(spark, sf))


@query("marker_anchors", f"""WITH {_SPEC}, {_COMP}, {_ION}, im AS (SELECT *, {_neutral('precursor_mz', 'adduct')} AS neutral_mass FROM ion),
  mk AS (SELECT p_name || p_partkey AS name, round(120 + (p_partkey * 13.7::DOUBLE) % 300, 4) AS mz FROM part),
  h AS (SELECT scan_id, name, 1 AS way, abs(neutral_mass - (mz - {sp.PROTON!r})) / (mz - {sp.PROTON!r}) * 1e6 AS ppm FROM im JOIN mk
    ON mz - {sp.PROTON!r} BETWEEN neutral_mass * (1 - 2.1e-5) AND neutral_mass * (1 + 2.1e-5)
    UNION ALL SELECT scan_id, name, 2, abs(precursor_mz - mz) / mz * 1e6 FROM im JOIN mk ON mz BETWEEN precursor_mz * (1 - 2.1e-5) AND precursor_mz * (1 + 2.1e-5) WHERE NOT suffix(adduct, '2+'))
  SELECT scan_id, name, round(arg_min(ppm, way), 4) AS ppm FROM h WHERE ppm <= {TOL} GROUP BY 1, 2""")
def marker_anchors(spark, sf):
    p = table(spark, sf, "part")
    markers = p.select(
        F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.round(120 + (F.col("p_partkey") * F.lit(13.7)) % 300, 4).alias("marker_mz"), F.lit("[M+H]+").alias("marker_adduct"),
    )
    ions = settle(sp.infer_adducts(spectra_view(spark, sf), TOL))
    return sp.marker_hits(ions, markers, TOL).withColumn("ppm", R("ppm", 4))


_MARK = f"""mk AS (SELECT p_partkey::VARCHAR AS name, substr(p_brand, 1, 1 + p_partkey % 8) AS label, CASE WHEN p_partkey % 3 > 0 THEN 'C' || p_size ELSE '' END AS formula,
    round(120 + (p_partkey * 13.7::DOUBLE) % 300, 4) AS mz, p_partkey AS pos FROM part),
  mh AS (SELECT DISTINCT scan_id, mk.name FROM im JOIN mk ON mz - {sp.PROTON!r} BETWEEN neutral_mass * (1 - 2.1e-5) AND neutral_mass * (1 + 2.1e-5)
      WHERE abs(neutral_mass - (mz - {sp.PROTON!r})) / (mz - {sp.PROTON!r}) * 1e6 <= {TOL}
    UNION SELECT scan_id, mk.name FROM im JOIN mk ON mz BETWEEN precursor_mz * (1 - 2.1e-5) AND precursor_mz * (1 + 2.1e-5)
      WHERE NOT suffix(adduct, '2+') AND abs(precursor_mz - mz) / mz * 1e6 <= {TOL})"""


def _labelled_markers(spark, sf):
    """Parts as markers whose labels are beginnings of their brands."""
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.cast("string").alias("name"), F.col("p_brand").substr(F.lit(1), (1 + k % 8).cast("int")).alias("label"),
        F.when(k % 3 > 0, F.concat(F.lit("C"), F.col("p_size").cast("string"))).otherwise("").alias("formula"),
        F.round(120 + (k * F.lit(13.7)) % 300, 4).alias("marker_mz"), F.lit("[M+H]+").alias("marker_adduct"), k.alias("pos"),
    )


@query("marker_named_candidates", _ANN + f""", {_MARK}, nm AS (SELECT an.scan_id, an.class, arg_max(label, pos) AS label, arg_max(formula, pos) FILTER (formula <> '') AS lf, arg_max(mz, pos) AS lm
    FROM an JOIN mh USING (scan_id) JOIN mk ON mk.name = mh.name WHERE rank <= 8 AND contains(lower(class), lower(mk.label)) GROUP BY 1, 2)
  SELECT scan_id, class, rank, coalesce(label, CASE WHEN fit THEN class END) AS name, coalesce(lf, CASE WHEN fit THEN 'F' || class END) AS formula,
    round(coalesce(lm, CASE WHEN fit THEN class_mass END), 4) AS mass, scan_id IN (SELECT scan_id FROM mh) AS species_anchor FROM an LEFT JOIN nm USING (scan_id, class) WHERE rank <= 8""")
def marker_named_candidates(spark, sf):
    cls, frag, loss = rules_view(spark, sf)
    spec, markers = spectra_view(spark, sf), _labelled_markers(spark, sf)
    hits = settle(sp.marker_ions(sp.infer_adducts(spec, TOL), markers, TOL))
    got = sp.marker_names(_annotated(spark, sf, extra=["precursor_mz"]), hits, markers, cls.withColumn("formula", F.concat(F.lit("F"), "class")), sp.ION)
    return got.select("scan_id", "class", "rank", "name", "formula", R("mass", 4).alias("mass"), "species_anchor")


@query("target_markers", f"""WITH {_SPEC}, {_COMP}, {_ION}, im AS (SELECT *, {_neutral('precursor_mz', 'adduct')} AS neutral_mass FROM ion), {_MARK}
  SELECT scan_id, name, label, contains(lower(label), 'brand#2') AS target_match FROM mh JOIN mk USING (name)""")
def target_markers(spark, sf):
    markers = _labelled_markers(spark, sf)
    ions = settle(sp.infer_adducts(spectra_view(spark, sf), TOL))
    hits = settle(sp.target_markers(sp.marker_ions(ions, markers, TOL), markers, "Brand#2"))
    return sp.of_scans(ions, hits).select("scan_id", "name", "label", "target_match")


# --- text formats: one record per line item, written as text and parsed back ------
def _record_lines(spark, sf, sep):
    """Header fields and two peak lines per record."""
    li = table(spark, sf, "lineitem")
    mz = F.round(50 + (F.col("l_extendedprice") * 3) % 250, 4)
    line = lambda m, i: F.concat(F.format_string("%.4f", m), F.lit(sep), F.format_string("%.1f", i))
    return li.select(
        F.concat_ws("-", F.lit("S"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("title"),
        F.format_string("%.4f", F.round(120 + (F.col("l_extendedprice") * 7) % 300, 4)).alias("pm"), "l_returnflag", "l_orderkey", "l_extendedprice",
        F.concat(line(mz, F.col("l_quantity")), F.lit("\n"), line(mz + 1.5, F.lit(7.0))).alias("body"),
    )


_PARSED = """SELECT concat_ws('-', 'S', l_orderkey, l_linenumber, l_partkey) AS scan_id, round(120 + (l_extendedprice * 7) % 300, 4) AS precursor_mz, 2 AS n_peaks,
  round(round(50 + (l_extendedprice * 3) % 250, 4) * 2 + 1.5, 3) AS sum_mz, l_quantity + 7 AS sum_intensity, {extra} FROM lineitem"""


def _parsed(df, *extra):
    total = lambda f: F.aggregate("fragments", F.lit(0.0), lambda s, x: s + x[f])
    return df.select(
        "scan_id", "precursor_mz", F.size("fragments").alias("n_peaks"), F.round(total("mz"), 3).alias("sum_mz"),
        total("intensity").alias("sum_intensity"), *extra,
    )


@query("parse_mgf", _PARSED.format(extra="CASE l_returnflag WHEN 'A' THEN 'positive' ELSE 'negative' END AS polarity, CASE l_returnflag WHEN 'R' THEN 2 END AS precursor_charge"))
def parse_mgf(spark, sf):
    r = _record_lines(spark, sf, " ")
    charge = F.when(F.col("l_returnflag") == "A", "1+").when(F.col("l_returnflag") == "R", "2").otherwise("1-")
    text = F.concat(
        F.lit("\nBEGIN IONS\nTITLE="), "title", F.lit("\nPEPMASS="), "pm", F.lit(" 100.0\nCHARGE="), charge, F.lit("\n"), "body", F.lit("\n"),
    )
    got = src.parse_mgf(r.select(text.alias("value")))
    return _parsed(got, F.coalesce("polarity", F.lit("negative")).alias("polarity"), "precursor_charge")


@query("parse_msp", _PARSED.format(extra="CASE l_returnflag WHEN 'A' THEN 'positive' ELSE 'negative' END AS polarity, '[M+H]+' AS adduct"))
def parse_msp(spark, sf):
    r = _record_lines(spark, sf, "\t")
    text = F.concat(
        F.lit("Name: "), "title", F.lit("\nPrecursorMZ: "), "pm", F.lit("\nPrecursor_type: '[M+H]+'\nIon_mode: "),
        F.when(F.col("l_returnflag") == "A", "P").otherwise("N"), F.lit("\nNum Peaks: 2\n"), "body",
    )
    return _parsed(src.parse_msp(r.select(text.alias("value"))), "polarity", "adduct")


@query("parse_fragment_rows", """SELECT 'S' || l_orderkey AS scan_id, arg_min(round(100 + l_discount * 1000, 2), (l_linenumber, l_extendedprice)) AS precursor_mz,
  CASE arg_min(l_returnflag, (l_linenumber, l_extendedprice)) WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' END AS polarity, count(*) AS n_peaks FROM lineitem GROUP BY l_orderkey""")
def parse_fragment_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(
        F.col("l_extendedprice").cast("string").alias("mz"), F.col("l_quantity").cast("string").alias("intensity"),
        F.concat(F.lit("S"), F.col("l_orderkey").cast("string")).alias("scan"),
        F.round(100 + F.col("l_discount") * 1000, 2).cast("string").alias("precursor_mz"),
        F.when(F.col("l_returnflag") == "A", "Positive").when(F.col("l_returnflag") == "R", "neg").alias("polarity"),
        F.struct("l_linenumber", "l_extendedprice", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("pos"),  # of equal ones the first row
    )
    spectra, peaks = src.parse_fragment_rows(rows)
    n = peaks.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n_peaks"))
    return spectra.join(n, "scan_id").select("scan_id", "precursor_mz", "polarity", "n_peaks")


# --- the same records written to files and read back by byte range ---------------
def _folder(spark):
    return f"{shared_dir(spark)}/omiclattice/files-{uuid.uuid4().hex}"


def _mixed_ends(text):
    """Every other order with carriage returns, every third with markers in small letters."""
    ends = F.when(F.col("l_orderkey") % 2 == 0, F.regexp_replace(text, "\n", "\r\n")).otherwise(text)
    return F.when(F.col("l_orderkey") % 3 == 0, F.regexp_replace(F.regexp_replace(ends, "BEGIN IONS", "begin ions"), "END IONS", "end ions")).otherwise(ends)


@query("spectra_files_mgf", _PARSED.format(extra="CASE l_returnflag WHEN 'A' THEN 'positive' ELSE 'negative' END AS polarity, CASE l_returnflag WHEN 'R' THEN 2 END AS precursor_charge"))
def spectra_files_mgf(spark, sf):
    r = _record_lines(spark, sf, " ")
    charge = F.when(F.col("l_returnflag") == "A", "1+").when(F.col("l_returnflag") == "R", "2").otherwise("1-")
    text = F.concat(
        F.lit("BEGIN IONS\nTITLE="), "title", F.lit("\nPEPMASS="), "pm", F.lit(" 100.0\nCHARGE="), charge, F.lit("\n"), "body", F.lit("\nEND IONS"),
    )
    path = _folder(spark)
    r.select(_mixed_ends(text).alias("value")).write.text(path)
    got = src.load_spectra(spark, path, "mgf", split_bytes=1 << 20)
    return _parsed(got, F.coalesce("polarity", F.lit("negative")).alias("polarity"), "precursor_charge")


@query("spectra_files_msp", _PARSED.format(extra="CASE l_returnflag WHEN 'A' THEN 'positive' ELSE 'negative' END AS polarity, '[M+H]+' AS adduct"))
def spectra_files_msp(spark, sf):
    r = _record_lines(spark, sf, "\t")
    text = F.concat(
        F.lit("Name: "), "title", F.lit("\nPrecursorMZ: "), "pm", F.lit("\nPrecursor_type: '[M+H]+'\nIon_mode: "),
        F.when(F.col("l_returnflag") == "A", "P").otherwise("N"), F.lit("\nNum Peaks: 2\n"), "body", F.when(F.col("l_orderkey") % 5 == 0, "\n \t").otherwise("\n"),
    )
    path = _folder(spark)
    r.select(_mixed_ends(text).alias("value")).write.text(path)
    return _parsed(src.load_spectra(spark, path, "msp", split_bytes=1 << 20), "polarity", "adduct")


@query("spectra_files_csv", _PARSED.replace("l_partkey)", "l_partkey, printf('%.2f', l_extendedprice))").format(extra="CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' END AS polarity"))
def spectra_files_csv(spark, sf):
    r = _record_lines(spark, sf, ",")
    r = r.withColumn("title", F.concat_ws("-", "title", F.format_string("%.2f", "l_extendedprice")))  # one scan a line item
    peaks = r.select("title", "pm", "l_returnflag", F.explode(F.split("body", "\n")).alias("line"))
    rows = peaks.withColumn("peak", F.split("line", ",")).select(
        F.col("peak")[0].alias("mz"), F.col("peak")[1].alias("intensity"), F.col("title").alias("scan_id"), F.col("pm").alias("precursor_mz"),
        F.when(F.col("l_returnflag") == "A", "Positive").when(F.col("l_returnflag") == "R", "neg").otherwise("?").alias("polarity"),
    )
    path = _folder(spark)
    rows.write.csv(path, header=True)
    return _parsed(src.load_spectra(spark, path, split_bytes=1 << 20), "polarity")


def _library_text(spark, sf):
    """One payload per order: an array of its record, every third one cut off."""
    o = table(spark, sf, "orders")
    rec = F.to_json(F.struct(
        F.concat(F.lit("A"), (F.col("o_orderkey") % 9000).cast("string")).alias("accession"),
        F.format_string("T%09d", F.col("o_orderkey")).alias("title"),
        F.struct(F.array("o_orderstatus").alias("names"), F.col("o_totalprice").alias("mass"),
                 F.array(F.struct(F.lit("KEGG").alias("database"), F.col("o_custkey").cast("string").alias("identifier"))).alias("link")).alias("compound"),
        F.struct(F.struct(F.array(F.struct(F.col("o_totalprice").alias("mz"), F.lit(5.0).alias("intensity"))).alias("values")).alias("peak")).alias("peak"),
    ))
    cut = F.concat(F.lit("["), rec, F.lit(', {"accession": "cut'))
    return o.select(F.when(F.col("o_custkey") % 3 == 0, cut).otherwise(F.concat(F.lit("["), rec, F.lit("]"))).alias("value"))


@query("parse_library_json", """SELECT 'A' || (o_orderkey % 9000) AS accession, printf('T%09d', o_orderkey) AS title, o_totalprice AS mass, 1 AS n_peaks,
  o_custkey::VARCHAR AS kegg FROM orders""")
def parse_library_json(spark, sf):
    lib = src.parse_library(_library_text(spark, sf))
    return lib.select("accession", "title", "mass", F.size("peaks").alias("n_peaks"), F.col("links")[0]["identifier"].alias("kegg"))


@query("library_dedup", "SELECT 'A' || (o_orderkey % 9000) AS accession, min(printf('T%09d', o_orderkey)) AS title FROM orders GROUP BY 1")
def library_dedup(spark, sf):
    return src.dedup_library(src.parse_library(_library_text(spark, sf)).select("accession", "title"))


@query("library_dedup_report", """SELECT count(DISTINCT o_orderkey % 9000) AS total, count(*) - count(DISTINCT o_orderkey % 9000) AS duplicates_dropped,
  count(DISTINCT o_orderkey % 9000) > 10 AS has_more FROM orders""")
def library_dedup_report(spark, sf):
    return src.dedup_report(src.parse_library(_library_text(spark, sf)), 10)
