"""Formulas by meeting in the middle against an enumeration of every composition."""

import random

import pytest
from pyspark.sql import functions as F

from omiclattice.operators import spectra as sp

SMALL = {"max_c": 9, "max_h": 20, "max_n": 4, "max_o": 5, "max_s": 3, "max_p": 2}


def every_composition(limits):
    out = []
    for c in range(limits["max_c"] + 1):
        for n in range(limits["max_n"] + 1):
            for o in range(limits["max_o"] + 1):
                for s in range(limits["max_s"] + 1):
                    for p in range(limits["max_p"] + 1):
                        heavy = c * 12.0 + n * sp.MASSES["N"] + o * sp.MASSES["O"] + s * sp.MASSES["S"] + p * sp.MASSES["P"]
                        out += [((c, h, n, o, s, p), heavy + h * sp.MASSES["H"]) for h in range(limits["max_h"] + 1)]
    return out


def broken(c, h, n, o, s, p):
    r = c - (h + s) / 2 + n / 2 + 1 - p
    ratios = c > 0 and (h > 3.5 * c or n > 3 * c or o > 4 * c)
    return r < 0 or r > 40 or ratios or s > 2 * max(c, 1) or c == 0 and (o > 3 or n > 3 or p > 1) or p > c + 1 or s > c + 2 or n > c + 3


@pytest.mark.parametrize("ppm", [5.0, 20.0, 400.0])
def test_hits_equal_enumeration(spark, ppm, monkeypatch):
    monkeypatch.setattr(sp, "TASK_ROWS", 500)
    rng, every = random.Random(ppm), every_composition(SMALL)
    # near compositions, light and heavy, rich in S and P, at the edge of the window and anywhere
    masses = [m * (1 + rng.choice([0, 0.3, -0.9, 0.999, -0.999, 1.001]) * ppm * 1e-6) for _, m in rng.sample(every, 60) if m > 0]
    masses += [m for x, m in every if x in ((0, 0, 2, 0, 1, 1), (0, 2, 0, 1, 0, 0), (1, 4, 0, 0, 0, 0), (2, 6, 0, 0, 2, 0), (0, 1, 0, 0, 0, 0))] + [rng.uniform(1, 250) for _ in range(30)]
    table = spark.createDataFrame([(m,) for m in masses], "neutral double").distinct()
    near = {(m, x) for m in masses for x, mass in every if mass > 0 and abs(mass - m) / m * 1e6 <= ppm}
    got = sp.formula_hits(table, ppm, **SMALL).collect()
    assert len(got) == len(near) and {(r.neutral, (r.c, r.h, r.n, r.o, r.s, r.p)) for r in got} == near
    clean = {(m, x) for m, x in near if not broken(*x)}
    found = sp.formula_hits(table, ppm, True, **SMALL)
    assert {(r.neutral, (r.c, r.h, r.n, r.o, r.s, r.p)) for r in found.collect()} == clean
    assert {r.neutral for r in sp.clean_masses(table, ppm, **SMALL).collect()} == {m for m, _ in clean}


def test_a_half_too_large_to_broadcast(spark, monkeypatch):
    table = spark.createDataFrame([(180.0633881,), (46.0418648,)], "neutral double")
    want = {tuple(r) for r in sp.formula_hits(table, 5.0).collect()}
    monkeypatch.setattr(sp, "HALF_ROWS", 0)
    assert {tuple(r) for r in sp.formula_hits(table, 5.0).collect()} == want and len(want) > 5


def test_no_table_of_whole_compositions(spark):
    """The plan reads the C, H, O half and the masses; its rows stay below the compositions up to the mass."""
    table = spark.createDataFrame([(1000.4,), (950.2,)], "neutral double")
    half = sp.half_masses(spark, F.lit(1000.5), sp.LIMITS, False)
    assert half.count() < 229_000
    assert 500 < sp.formula_hits(table, 5.0).count() < 3000


def test_nothing(spark):
    none = spark.createDataFrame([], "neutral double")
    assert sp.formula_hits(none, 5.0).count() == 0 and sp.clean_masses(none, 5.0).count() == 0


def test_markers_name_candidates(spark):
    ann = spark.createDataFrame([("s", "flavonol", 1, "class name"), ("s", "", 2, None), ("t", "flavonol", 1, "class name"), ("u", "flavonol", 1, None)], "scan_id string, class string, rank int, name string")
    cls = spark.createDataFrame([("flavonol", "CF", 302.0, ["x"]), ("", "CE", 9.0, ["Some Rutin here"])], "class string, formula string, class_mass double, known_metabolites array<string>")
    markers = spark.createDataFrame([("1", "Flavo", "F1", 300.0, 1), ("2", "NOL", "", 301.0, 2), ("3", "rutin", "F3", 0.0, 3)], "name string, label string, formula string, marker_mz double, pos int")
    hits = spark.createDataFrame([("s", "1"), ("s", "2"), ("s", "3"), ("u", "3")], "scan_id string, name string")
    got = {(r.scan_id, r["class"]): (r.name, r.formula, r.mass, r.species_anchor) for r in sp.marker_names(ann, hits, markers, cls).collect()}
    assert got == {
        ("s", "flavonol"): ("NOL", "F1", 301.0, True), ("s", ""): ("rutin", "F3", None, True),
        ("t", "flavonol"): ("class name", "CF", 302.0, False), ("u", "flavonol"): (None, None, None, True)}
    flags = lambda target: {r.label for r in sp.target_markers(hits, markers, target).where("target_match").collect()}
    assert flags("RUT") == {"rutin"} and flags("") == set()
