"""What the spectra operators send between tasks, and rows that their order leaves tied."""

import pytest
from pyspark.sql import functions as F

from omiclattice.operators import spectra as sp
from omiclattice.plans import spectra_queries as queries


@pytest.fixture
def sent(spark):
    """Rows written to shuffles while an action runs."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def stages():
        none = spark.sparkContext._gateway.new_array(jvm.double, 0)
        got = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (got.apply(i) for i in range(got.size()))}

    def run(df):
        before = set(stages())
        n = df.count()
        return n, sum(v for k, v in stages().items() if k not in before)

    return run


def test_equal_rows_of_a_scan_are_headed_by_the_first(spark, tmp_path):
    rows = [(1, 1, 10.0, 5.0, d / 100, f) for d, f in ((3, "R"), (5, "A"), (9, "N"))] + [(2, 1, 10.0, 5.0, 0.01, "A")]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.scan_id: (r.precursor_mz, r.polarity, r.n_peaks) for r in queries.parse_fragment_rows(spark, str(tmp_path)).collect()}
    assert got == {"S1": (130.0, "negative", 3), "S2": (110.0, "positive", 1)}


def test_marker_hits_of_one_ion_are_found_once(spark, sent):
    ions = spark.range(200).select(F.col("id").cast("string").alias("scan_id"), F.lit(201.5).alias("precursor_mz"), F.lit("[M+H]+").alias("adduct"), F.lit(201.5 - sp.PROTON).alias("neutral_mass"))
    markers = spark.range(300).select(F.col("id").cast("string").alias("name"), F.lit(201.5).alias("marker_mz"), F.lit("[M+H]+").alias("marker_adduct"))
    n, rows = sent(sp.marker_hits(ions, markers, 20.0))
    assert n == 60_000 and rows < 20_000


def test_losses_of_one_precursor_are_counted_once(spark, sent):
    classes = spark.range(60).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("class"))
    frag = classes.crossJoin(spark.createDataFrame([(100.0,), (101.0,), (102.0,)], "ref_mz double"))
    loss = classes.crossJoin(spark.createDataFrame([(25.0,), (23.0,), (60.0,)], "delta double"))
    cands = spark.range(500).select(F.col("id").cast("string").alias("scan_id"), F.lit(125.0).alias("precursor_mz")).crossJoin(classes)
    found = sp.class_losses(cands, frag, loss, 20.0)
    assert {tuple(r) for r in found.groupBy("n_losses").count().collect()} == {(2, 30_000)}
    assert sent(sp.class_losses(cands, frag, loss, 20.0))[1] < 5_000
    none = cands.limit(5).withColumn("precursor_mz", F.lit(None).cast("double"))
    assert sp.class_losses(none, frag, loss, 20.0).count() == 0


def test_candidates_stay_where_they_are_made(spark, sent):
    spec = spark.range(500).select(F.col("id").cast("string").alias("scan_id"), F.lit(336.123).alias("precursor_mz"), F.lit("positive").alias("polarity"), F.lit("[M+H]+").alias("adduct"))
    peaks = spec.select("scan_id", F.lit(306.0761).alias("mz"), F.lit(5.0).alias("intensity"))
    frag = spark.range(60).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("class"), F.lit(306.0761).alias("ref_mz"))
    cls = frag.select("class", F.lit("medium").alias("confidence"), F.lit(None).cast("double").alias("class_mass"), F.array("class").alias("known_metabolites"))
    loss = spark.createDataFrame([("k1", 30.0469)], "class string, delta double")
    out = sp.annotate(spec, peaks, cls, frag, loss, tol=20.0, max_c=25, max_h=40, max_n=1, max_o=5, max_s=0, max_p=0)
    got = out.where("scan_id = '7'").orderBy("rank").collect()
    assert [(r["class"], r.n_losses) for r in got][:2] == [("k1", 1), ("k0", 0)] and len(got) == 8
    n, rows = sent(out)
    assert n == 4_000 and rows < 10_000


def test_an_ion_without_precursor_keeps_its_row(spark):
    spec = spark.createDataFrame([("a", None, None, None), ("b", 181.0707, "positive", None)], "scan_id string, precursor_mz double, polarity string, adduct string")
    got = {r.scan_id: (r.adduct, r.formula_ok) for r in sp.infer_adducts(spec, 5.0, max_c=8, max_h=14, max_n=1, max_o=7, max_s=0, max_p=0).collect()}
    assert got == {"a": ("[M+H]+", False), "b": ("[M+H]+", True)}
