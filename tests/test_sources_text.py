import datetime as dt

import pytest
from pyspark.sql import functions as F

from omiclattice.functions.safe import attempt
from omiclattice.operators import catalog, evidence as ev, knowledge as kn, text as tx
from omiclattice.plans.analysis import run_analysis
from omiclattice.plans.views import expr, groups, metab, table
from omiclattice.sources import matrices, rules, sinks
from omiclattice.streaming import ingest

SF = "/root/testdata/sf0.001"


def write(path, text, enc="utf-8"):
    path.write_bytes(text.encode(enc))
    return str(path)


def cells(df):
    return {(r.feature_id, r.sample_id): r.value for r in df.collect()}


def test_expression_files(spark, tmp_path):
    a = write(tmp_path / "a.csv", "gene,S1,S2\n" + "".join(f"g{i},{i},NA\n" for i in range(6)))
    got = cells(matrices.read_expression(spark, a))
    assert got[("g3", "S1")] == 3.0 and got[("g3", "S2")] is None and len(got) == 12
    b = write(tmp_path / "b.tsv", "id\tAT1G1\tAT1G2\nGSM1\t1\t2\nGSM2\t3\t4\n")
    assert cells(matrices.read_expression(spark, b))[("AT1G2", "GSM2")] == 4.0
    c = write(tmp_path / "c.csv", "a;b;c\n1;2;3\n")
    assert matrices.sniff_delimiter(spark, c, "loader") == ";" and matrices.sniff_delimiter(spark, c, "detector") == ";"


def test_encodings(spark, tmp_path):
    write(tmp_path / "u.csv", "a,b\n1,2\n")
    write(tmp_path / "g.csv", "基因,样本\n1,2\n", "gb18030")
    got = {r.path.rsplit("/", 1)[1]: (r.encoding, r.method) for r in matrices.sniff_encoding(spark, str(tmp_path)).collect()}
    assert got == {"u.csv": ("utf-8", "as_requested"), "g.csv": ("gb18030", "chinese_text")}


def test_peak_tables(spark, tmp_path):
    p = write(tmp_path / "p.csv", "Sample,m/z,RT,Intensity\nF-1,348.1230,3.25,1000\nF-1,177.05,1.10,2000\nL-1,348.1230,3.25,1500\nL-1,348.1230,3.25,9\nL-1,,1,5\n")
    got = cells(matrices.read_metabolites(spark, p))
    assert got == {("mz_348.1230_rt_3.250", "F-1"): 1000.0, ("mz_177.0500_rt_1.100", "F-1"): 2000.0, ("mz_348.1230_rt_3.250", "L-1"): 1500.0}
    with pytest.raises(ValueError):
        matrices.read_metabolites(spark, write(tmp_path / "q.csv", "mz,RT,intensity\n1,2,3\n"))
    w = write(tmp_path / "w.csv", "Name,mz,RT,F-1,L-1,Average_x\n" + "".join(f"m{i},1,2,{i},{i},7\n" for i in range(6)))
    assert {s for _, s in cells(matrices.read_metabolites(spark, w))} == {"F-1", "L-1"}


def test_metadata_annotation_results(spark, tmp_path):
    m = matrices.read_sample_metadata(spark, write(tmp_path / "m.csv", "id,Condition,depth\ns1,hot,3\ns2,,4\ns2,,4\n"))
    r = m.where("sample_id = 's1'").first()
    assert r.condition == "hot" and r.tissue == "" and r.extra == {"depth": "3"}
    assert {(x.warning, x.subject) for x in matrices.metadata_warnings(m).collect()} == {("duplicate_sample", "s2"), ("missing_column", "tissue")}
    a = matrices.read_annotation(spark, write(tmp_path / "a.csv", "GeneID,KEGG_annot,len\ng1,chalcone synthase|x,5\ng2,--,6\n"))
    assert [(x.gene_id, x.term) for x in a.collect()] == [("g1", "chalcone synthase|x")]
    d = matrices.read_results(spark, write(tmp_path / "d.csv", "gene,logFC,padj\ng1,1.5,0.01\n")).first()
    assert (d.feature_id, d.log2fc, d.p_value, d.q_value) == ("g1", 1.5, None, 0.01)


def test_rule_files(spark, tmp_path):
    p = write(tmp_path / "flav.json", '{"flav": [{"class": "flavonol", "fragments": [{"mz": 153.0}], "mass": 302.0}], "neutral_losses": [{"delta": 18.01}]}')
    c, f, n = rules.compound_rules(spark, {"flav": p})
    assert c.first()["class_mass"] == 302.0 and f.count() == 1 and n.first()["delta"] == 18.01


def test_snapshot_stream_replaces_blocks(spark, tmp_path):
    def upload(block, value, pos):
        spark.createDataFrame([("s", block, "g", "x", value, pos)], "session_id string, block string, feature_id string, sample_id string, value double, pos long").write.mode("append").parquet(f"{tmp_path}/in")

    upload("expr", 1.0, 1), upload("metab", 2.0, 2)
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    ingest.start_upload_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    upload("expr", 9.0, 3)
    ingest.start_upload_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = {r.block: r.value for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"expr": 9.0, "metab": 2.0}
    upload("expr", 5.0, 0), upload("metab", 4.0, 1), upload("new", 7.0, 0)  # older ones that come late
    ingest.start_upload_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    kept = spark.read.parquet(f"{tmp_path}/out")
    assert {r.block: (r.value, r.pos) for r in kept.collect()} == {"expr": (9.0, 3), "metab": (2.0, 2), "new": (7.0, 0)}
    again = spark.createDataFrame([("s", "expr", "g", "x", 9.0, 3)], schema)
    ingest.merge_uploads(again, f"{tmp_path}/out")  # a batch that is run again
    assert kept.sparkSession.read.parquet(f"{tmp_path}/out").where("block = 'expr'").count() == 1


def test_safe_step_and_catalog(spark):
    df, why = attempt(spark, lambda: spark.range(1).select("nope"), "a int")
    assert df.count() == 0 and df.columns == ["a"] and why
    names = catalog()
    assert "stats.deg_multigroup" in names and len(names) > 150


def test_fusion_known_gene(spark):
    g = spark.createDataFrame([("g", 0.9, 0.8, 0.1, 0.0)], "gene_id string, correlation double, module_membership double, motif double, pathway double")
    g = g.select("*", *[F.lit(None).cast("double").alias(d) for d in ev.DIMENSIONS if d not in g.columns])
    r = ev.fuse(g).first()
    assert r.raw_score == round((0.9 * 0.15 + 0.8 * 0.1 + 0.1 * 0.08) / 0.33, 4)
    assert [c["pattern"] for c in r.contradictions] == ["high_correlation_no_motif"] and r.n_sources == 2
    empty = g.select("gene_id", *[F.lit(0.0).alias(d) for d in ev.DIMENSIONS])
    assert ev.fuse(empty).first().level == "None"


def test_species_mismatch_and_gaps(spark):
    e = spark.createDataFrame(
        [("m", "H1", "support", "a", 0.4, "supports", None, "rice"), ("m", "H1", "gap", "no promoter", 0.0, "insufficient", None, None)],
        "metabolite string, hypothesis string, role string, kind string, score double, relation string, severity string, species_scope string",
    )
    ctx = spark.createDataFrame([("m", 12, ["leaf"], "maize")], "metabolite string, n_samples int, tissues array<string>, species string")
    reg = spark.createDataFrame([("m", "H1", "g1")], "metabolite string, hypothesis string, gene_id string")
    genes = spark.createDataFrame([("g1",)], "gene_id string")
    kinds = {r.kind for r in ev.falsify(e, ctx, reg, genes).where("role = 'contradiction'").collect()}
    assert kinds == {"evidence_diversity_check", "tissue_mismatch_check", "species_mismatch_check", "causal_gap_check"}


def test_reference_chain_merges(spark):
    rows = [(1, "Full title", "", "J", "10.1/X", "77", ""), (2, "Other words", "B", "", "", "77", ""), (3, "full title.", "", "", "", "", "u"), (4, "New", "", "", "", "", "")]
    d = spark.createDataFrame(rows, "pos int, title string, authors string, journal string, doi string, pmid string, url string")
    got = {r.pos: r for r in tx.merge_references(d).collect()}
    assert set(got) == {1, 4} and got[1].authors == "B" and got[1].url == "u" and got[1].doi == "10.1/X"


def test_names(spark):
    d = spark.createDataFrame([("OsNAC6",), ("xMYB",), ("ATMYBL",), ("HD-ZIP 4",), ("my_WRKY",)], "s string")
    got = {r.s: r.f for r in d.select("s", kn.symbol_family(F.col("s")).alias("f")).collect()}
    assert got == {"OsNAC6": "NAC", "xMYB": "MYB", "ATMYBL": "", "HD-ZIP 4": "HD-ZIP", "my_WRKY": "WRKY"}


def test_recency_future_counts_as_now(spark):
    now = F.lit("2024-01-08 00:00:00").cast("timestamp")
    d = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2030, 1, 1),)], "t timestamp")
    r = [x[0] for x in d.select(tx.recency(F.col("t"), now)).collect()]
    assert abs(r[0] - 0.5) < 1e-9 and r[1] == 1.0


def test_whole_analysis(spark, tmp_path):
    p = table(spark, SF, "part").select(F.col("p_brand").alias("set_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("feature_id"))
    done = run_analysis(expr(spark, SF), metab(spark, SF), groups(spark, SF), str(tmp_path / "run"), p, with_modules=False, min_abs_r=0.6)
    assert done["quality"].first()["passed"] and done["deg"].count() == 200
    assert {r.step for r in done["digest"].collect()} == {"quality", "deg", "dam", "pairs", "candidates"}
    assert sinks.candidate_table(done["candidates"]).count() == done["candidates"].count() > 0
