from itertools import product

from pyspark.sql import functions as F

from omiclattice.operators import motifs as mo, text as tx
from omiclattice.sources import spectra as src


def test_every_letter_counts(spark):
    d = spark.createDataFrame([("A" * 500 + "XYZ" * 200,)], "s string")
    assert d.select(mo.is_nucleotide(F.col("s"))).first()[0] is False
    assert d.select(mo.is_nucleotide(F.col("s"), first=500)).first()[0] is True


def test_cells_are_kept_whole(spark):
    d = spark.createDataFrame([(1, "x" * 200 + "a"), (2, "x" * 200 + "b")], "o int, v string")
    assert tx.column_chunks(d, ["v"], "o").first().chunk == "、".join("x" * 200 + e for e in "ab")
    assert tx.column_chunks(d, ["v"], "o", cut=200).first().chunk == "x" * 200


def _memory(spark):
    """A thousand words in two entries each; "zebra" only in the last entry."""
    rows = [(i, " ".join("q" + "".join(w) for w in product("abcdefghij", repeat=3)), 3, "2024-01-01", []) for i in (1, 2)] + [(3, "zebra", 3, "2024-01-01", [])]
    return spark.createDataFrame(rows, "id int, content string, importance int, created_at string, tags array<string>").withColumn(
        "created_at", F.col("created_at").cast("timestamp")
    )


def test_rare_words_find_their_entry(spark):
    m = _memory(spark)
    assert [r.id for r in tx.recall_corrections(m, "zebra").collect()] == [3]
    assert not tx.recall_corrections(m, "zebra", vocab=1000).collect()
    now = F.lit("2024-03-01").cast("timestamp")
    best = tx.hybrid_ranking(m, "zebra", now).first()
    assert best.id == 3 and abs(best.relevance - 1.0) < 1e-9
    assert tx.hybrid_ranking(m, "zebra", now, vocab=1000).agg(F.max("relevance")).first()[0] == 0.0


def test_single_layout_keeps_large_masses(spark):
    rows = spark.createDataFrame([("4000.5", "1", None, "10", "pos", 1), ("6000.5", "2", None, "10", "pos", 2)],
                                 "mz string, intensity string, scan string, precursor_mz string, polarity string, pos int")
    mz = lambda **k: sorted(r.mz for r in src.parse_fragment_rows(rows, multi_scan=False, **k)[1].collect())
    assert mz() == [4000.5, 6000.5] and mz(max_mz=5000) == [4000.5]
