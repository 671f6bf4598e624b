import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from omiclattice.operators import motifs as mo, spectra as sp
from omiclattice.sources import sequences as sq, spectra as src


def peaks_of(spark, rows):
    return spark.createDataFrame([(s, float(m), float(i)) for s, m, i in rows], "scan_id string, mz double, intensity double")


@pytest.fixture(scope="module")
def rules(spark):
    cls = spark.createDataFrame(
        [("berberine_protoberberine", "high", 336.1230, ["berberine"]), ("flavonol", "high", None, ["quercetin"])],
        "class string, confidence string, class_mass double, known_metabolites array<string>",
    )
    frag = spark.createDataFrame(
        [("berberine_protoberberine", m) for m in (321.0996, 306.0761, 292.0968, 278.0812)] + [("flavonol", m) for m in (153.0182, 137.0233, 229.0495)],
        "class string, ref_mz double",
    )
    loss = spark.createDataFrame([("berberine_protoberberine", 15.0235), ("flavonol", 28.0)], "class string, delta double")
    return cls, frag, loss


def test_annotation_classes(spark, rules):
    spec = spark.createDataFrame(
        [("b", 336.1230, "positive", None), ("f", 303.0499, "positive", None), ("none", 400.1234, "positive", None)],
        "scan_id string, precursor_mz double, polarity string, adduct string",
    )
    pk = peaks_of(spark, [("b", 336.1230, 100), ("b", 321.0996, 80), ("b", 306.0761, 50), ("b", 278.0812, 30),
                          ("f", 303.0499, 100), ("f", 153.0182, 80), ("f", 137.0233, 60), ("f", 229.0495, 20),
                          ("none", 250.0, 9), ("none", 180.5, 8), ("none", 120.3, 7)])
    got = {r.scan_id: r for r in sp.annotate(spec, pk, *rules).where("rank = 1").collect()}
    assert got["b"]["class"] == "berberine_protoberberine" and got["b"].msi_level == 2 and got["b"].score >= 0.5
    assert got["f"]["class"] == "flavonol" and got["f"].msi_level == 2
    assert "none" not in got


def test_formulas_and_masses(spark):
    m = spark.createDataFrame([(302.0427,), (123.456,)], "m double")
    got = sp.formula_candidates(m, "m", 5.0, max_s=1, max_p=1).where(F.size("hard") == 0).collect()
    assert any(r.formula == "C15H10O7" for r in got if r.m == 302.0427)
    two = sp.formula_candidates(m.where("m < 200"), "m", 2.0).where((F.size("hard") == 0) & (F.size("soft") == 0)).collect()
    assert not two
    d = spark.createDataFrame([(303.0499, "[M+H]+"), (200.0, "[M+2H]2+"), (1.0, "odd")], "mz double, a string")
    r = [x[0] for x in d.select(sp.neutral_mass(F.col("mz"), F.col("a"))).collect()]
    assert abs(r[0] - 302.0426) < 1e-4 and abs(r[1] - (400.0 - 2 * sp.PROTON)) < 1e-9 and r[2] is None


def test_formula_table_matches_enumeration(spark):
    mass, ppm = 180.0634, 10.0
    want = set()
    for c, n, o, s in itertools.product(range(16), range(4), range(12), range(2)):
        heavy = c * 12.0 + n * sp.MASSES["N"] + o * sp.MASSES["O"] + s * sp.MASSES["S"]
        h = round((mass - heavy) / sp.MASSES["H"]) if heavy <= mass else -1
        if 0 <= h <= 40 and abs(heavy + h * sp.MASSES["H"] - mass) / mass * 1e6 <= ppm:
            want.add((c, h, n, o, s))
    got = sp.ppm_join(sp.compositions(spark, 200.0, 15, 40, 3, 11, 1, 0), spark.createDataFrame([(mass,)], "neutral double"), "mass", "neutral", ppm)
    assert {(r.c, r.h, r.n, r.o, r.s) for r in got.collect()} == want and (6, 12, 0, 6, 0) in want


def test_ppm_join_is_complete_at_the_edge(spark):
    tol = 50.0
    ref = [100.0 * (1.0003 ** k) for k in range(300)]
    obs = [r * (1 + d * tol * 1e-6) for r in ref for d in (-0.999, 0.999, -1.001, 1.001)]
    a = spark.createDataFrame([(float(x),) for x in obs], "o double")
    b = spark.createDataFrame([(float(x),) for x in ref], "r double")
    assert sp.ppm_join(a, b, "o", "r", tol).count() == 600


def test_spectrum_files(spark, tmp_path):
    p = tmp_path / "x_neg.mgf"
    p.write_text("BEGIN IONS\nTITLE=A\nPEPMASS=336.1230 1000\nCHARGE=1+\n321.0996 80\n306.0761\nEND IONS\nBEGIN IONS\nPEPMASS=0\n1 1\nEND IONS\n")
    r = src.load_spectra(spark, str(p), "mgf").collect()
    assert len(r) == 1 and r[0].scan_id == "A" and r[0].polarity == "negative" and [tuple(f) for f in r[0].fragments] == [(321.0996, 80.0), (306.0761, 1.0)]
    q = tmp_path / "y.msp"
    q.write_text("Name: one\nPrecursorMZ: 303.05\nPrecursor_type: [M+H]+\nIon_mode: P\nNum Peaks: 2\n153.0 10\n137.0 5\n\nName: empty\nPrecursorMZ: 9\n")
    r = src.load_spectra(spark, str(q), "msp").collect()
    assert [(x.scan_id, x.adduct, x.polarity, len(x.fragments)) for x in r] == [("one", "[M+H]+", "positive", 2)]


def test_truncated_library(spark):
    recs = [f'{{"accession": "A{i % 12}", "title": "t{i:02d}", "peak": {{"peak": {{"values": [{{"mz": {i}.5}}]}}}}}}' for i in range(13)]
    pay = spark.createDataFrame([("[" + ", ".join(recs) + ', {"accession": "cut',)], "value string")
    lib = src.parse_library(pay)
    rep = src.dedup_report(lib, 10).first()
    assert (rep.total, rep.duplicates_dropped, rep.has_more) == (12, 1, True)
    first = {r.accession: r.title for r in src.dedup_library(lib).collect()}
    assert len(first) == 12 and first["A0"] == "t00"


def seqs(spark, *texts):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "seq_id string, sequence string")


def test_motifs_and_conservation(spark):
    rows = [(f, p, n, 1.0) for n, p, f in mo.CONSENSUS_MOTIFS]
    got = {(r.seq_id, r.motif) for r in mo.motif_hits(seqs(spark, "NNNNCACGTGNNNN", "NNNTTGACTNNN"), rows, 4).collect()}
    assert ("s0", "bHLH-Gbox") in got and ("s1", "WRKY-Wbox") in got
    s = seqs(spark, "CACGTGTTGACTACCAACC", "CACGTGTTGACTACCAACC", "N" * 19, "")
    prof = mo.family_profile(s)
    pairs = spark.createDataFrame([("s0", "s1"), ("s0", "s2"), ("s0", "s3")], "source string, target string")
    sc = {r.target: r.score for r in mo.conservation(pairs, prof).collect()}
    assert sc["s1"] > 0.7 and sc["s2"] < 0.5 and sc["s3"] == 0.0


def test_motif_rollup_equals_hits(spark):
    rng = np.random.default_rng(0)
    s = seqs(spark, *["".join(rng.choice(list("ACGT"), 400)) for _ in range(6)])
    hits = mo.hit_rollup(mo.motif_hits(s)).toPandas().sort_values("seq_id")
    roll = mo.motif_rollup(s).toPandas().sort_values("seq_id")
    assert (hits.n_hits.values == roll.n_hits.values).all() and np.allclose(hits.best_score, roll.best_score)
    assert (hits.n_families.values == roll.n_families.values).all()


def test_pwm_scan_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ACGTN"), 120)) for _ in range(4)]
    m = rng.random((4, 5))
    lo = mo.log_odds(m)
    got = {(r.seq_id, r.start): r.pwm_score for r in mo.pwm_hits(seqs(spark, *texts), {"x": ("F", m.tolist())}, 0.5).collect()}
    want = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - 4):
            v = sum(lo["ACGT".index(c), j] for j, c in enumerate(t[i:i + 5]) if c in "ACGT")
            if v >= 0.5:
                want[(f"s{k}", i)] = round(v, 3)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_reading_frames(spark):
    orf = "ATG" + "GCT" * 35 + "TAA"
    flip = orf.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    got = {r.seq_id: r.protein for r in mo.longest_orf(seqs(spark, "CC" + orf + "GG", "A" + flip, "GCT" * 40, "ATG")).collect()}
    assert got["s0"] == "M" + "A" * 35 and got["s1"] == "M" + "A" * 35 and got["s3"] is None
    assert len(got["s2"]) >= 39


def _score(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = -2 * np.arange(len(a) + 1), -2 * np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = max(d[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), d[i - 1, j] - 2, d[i, j - 1] - 2)
    i, j, m, n = len(a), len(b), 0, 0
    while i or j:
        n += 1
        if i and j and d[i, j] == d[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
            m += a[i - 1] == b[j - 1]
            i, j = i - 1, j - 1
        elif i and d[i, j] == d[i - 1, j] - 2:
            i -= 1
        else:
            j -= 1
    return m / n * 100, n


def test_alignment_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [("".join(rng.choice(list("ACD"), rng.integers(1, 30))), "".join(rng.choice(list("ACD"), rng.integers(1, 30)))) for _ in range(25)]
    d = spark.createDataFrame(rows, "seq_a string, seq_b string")
    for r in mo.alignment_identity(d).collect():
        ident, n = _score(r.seq_a, r.seq_b)
        assert abs(r.identity - ident) < 1e-9 and r.aln_length == n
    k = mo.alignment_identity(d, long_over=0).where("seq_a = seq_b").count()
    assert k >= 0
    one = spark.createDataFrame([("ABCDEF", "XBCDEY")], "seq_a string, seq_b string")
    assert mo.alignment_identity(one, long_over=0).first().identity == 50.0


def test_family_rules_all_beats_any(spark):
    hits = spark.createDataFrame([("g", "PF1", 50.0, 1e-9), ("g", "PF2", 25.0, 1e-5), ("h", "PF1", 10.0, 1e-2)], "gene_id string, pfam string, bitscore double, evalue double")
    rules = spark.createDataFrame([("Any", "any", ["PF1"]), ("Both", "all", ["PF1", "PF2"])], "family string, rule string, pfam array<string>")
    got = mo.family_rules(hits, rules).collect()
    assert [(r.gene_id, r.family, r.score, r.evalue) for r in got] == [("g", "Both", 25.0, 1e-5)]


def test_fasta_suffixes(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">x one\nacg\nTT\n>y\nGG\n>x\nCC\n")
    got = {r.seq_id: r.sequence for r in sq.read_fasta(spark, str(p)).collect()}
    assert got == {"x": "ACGTT", "y": "GG", "x_2": "CC"}
