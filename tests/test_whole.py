"""Registered queries and operators do the whole job: each test names a former cut."""

from omiclattice.operators import spectra as sp
from omiclattice.plans import network_queries, spectra_queries


def test_betweenness_query_keeps_weak_edges(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", 0.31), ("b", "c", 0.35), ("c", "d", 0.9)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "feature_id string")
    monkeypatch.setattr(network_queries, "_graph", lambda spark, sf: (edges, nodes))
    got = {r.feature_id: r.betweenness for r in network_queries.betweenness(spark, "").collect()}
    assert got == {"a": 0.0, "b": 0.666667, "c": 0.666667, "d": 0.0}


def test_spectra_queries_take_every_composition(spark, monkeypatch):
    sulfur, adenine = 2 * 12.0 + 6 * sp.MASSES["H"] + 2 * sp.MASSES["S"], 5 * 12.0 + 5 * sp.MASSES["H"] + 5 * sp.MASSES["N"]
    spec = spark.createDataFrame(
        [("s", sulfur + sp.PROTON, "positive", "[M+H]+"), ("a", adenine + sp.PROTON, "positive", "[M+H]+")],
        "scan_id string, precursor_mz double, polarity string, adduct string",
    )
    peaks = spark.createDataFrame([("s", 60.0, 9.0), ("s", 70.0, 8.0)], "scan_id string, mz double, intensity double")
    cls = spark.createDataFrame([("k", "high", 50.0, ["known"])], "class string, confidence string, class_mass double, known_metabolites array<string>")
    frag = spark.createDataFrame([("k", 60.0), ("k", 70.0)], "class string, ref_mz double")
    loss = spark.createDataFrame([("k", 5.0)], "class string, delta double")
    for name, value in (("spectra_view", spec), ("peaks_view", peaks), ("rules_view", (cls, frag, loss))):
        monkeypatch.setattr(spectra_queries, name, lambda spark, sf, value=value: value)
    tops = {r.formula for r in spectra_queries.formula_enumeration(spark, "").where("rank = 1").collect()}
    assert tops == {"C2H6S2", "C5H5N5"}
    assert {r.scan_id: r.formula_ok for r in spectra_queries.adduct_inference(spark, "").collect()} == {"s": True, "a": True}
    assert [r.msi_level for r in spectra_queries.spectrum_annotation(spark, "").collect()] == [2]
    assert [(r.msi_level, r.n) for r in spectra_queries.msi_level_counts(spark, "").collect()] == [(2, 1)]
