"""Queries on texts, memory, references, file formats and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from omiclattice.functions.materialise import settle, shared_dir
from omiclattice.operators import evidence as ev, text as tx
from omiclattice.plans.evidence_queries import candidates, _fuse_sql
from omiclattice.plans.matrix_queries import R
from omiclattice.plans.registry import query
from omiclattice.plans.views import METAB, metab, table, texts
from omiclattice.sources import matrices, sequences as sq, sinks
from omiclattice.streaming import ingest

_TOK = lambda c: f"regexp_extract_all(lower({c}), '[a-zA-Z一-鿿]+')"
_STOP = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"


@query("tokenise", f"""WITH t AS (SELECT doc_id, {_TOK('text')} AS tk FROM documents) SELECT doc_id, len(tk)::INT AS n, md5(array_to_string(tk, ' ')) AS tokens_md5 FROM t""")
def tokenise(spark, sf):
    t = texts(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("tk"))
    return t.select("doc_id", F.size("tk").alias("n"), F.md5(F.array_join("tk", " ")).alias("tokens_md5"))


@query("script_detection", "SELECT doc_id, regexp_matches(text, '[㐀-鿿]') AS has_cjk FROM documents")
def script_detection(spark, sf):
    return texts(spark, sf).select("doc_id", tx.has_cjk(F.col("text")).alias("has_cjk"))


@query("cas_extraction", r"""WITH n AS (SELECT p_partkey, [p_name, CASE WHEN p_partkey % 3 = 0 THEN '50' || p_size || '-78-' || (p_partkey % 10) ELSE '1-2' END, '64-17-5'] AS names FROM part)
  SELECT p_partkey, list_filter(names, lambda s: regexp_matches(s, '^\d{2,7}-\d{2}-\d$'))[1] AS cas FROM n""")
def cas_extraction(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    odd = F.when(k % 3 == 0, F.concat(F.lit("50"), s, F.lit("-78-"), (k % 10).cast("string"))).otherwise("1-2")
    return table(spark, sf, "part").select("p_partkey", tx.cas_number(F.array("p_name", odd, F.lit("64-17-5"))).alias("cas"))


_NOW = "2024-02-01 00:00:00"


@query("recency_decay", f"""SELECT event_id, round(exp(-greatest(epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts), 0) / 3.6e9 * ln(2) / 168), 6) AS recency, round(greatest(least(((event_id % 10) - 1) / 9, 1), 0), 6) AS importance FROM events""")
def recency_decay(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", R(tx.recency(F.col("ts"), F.lit(_NOW).cast("timestamp"))).alias("recency"),
        R(tx.importance_score(F.col("event_id") % 10)).alias("importance"),
    )


@query("wording_lint", """WITH w AS (SELECT unnest(['the', 'copyright', 'confirmed', 'license', 'und ', 'proved']) AS p) SELECT doc_id, count(p) AS n_issues FROM documents LEFT JOIN w ON contains(lower(text), p) GROUP BY 1""")
def wording_lint(spark, sf):
    words = ["the", "copyright", "confirmed", "license", "und ", "proved"]
    return texts(spark, sf).select("doc_id", F.size(tx.wording_issues(F.col("text"), words)).alias("n_issues"))


@query("level_labels", _fuse_sql() + """ SELECT label, count(*) AS n FROM (SELECT CASE level WHEN 'Gold' THEN 'plausible' WHEN 'Silver' THEN 'weakly supported' ELSE 'insufficient evidence' END AS label FROM fz) GROUP BY 1""")
def level_labels(spark, sf):
    f = ev.fuse(candidates(spark, sf), plausibility="plausibility")
    return f.groupBy(tx.level_label(F.col("level")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("json_fields", """SELECT event_id, (props->>'k')::INT AS k FROM events""")
def json_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# --- chunks -----------------------------------------------------------------
@query("markdown_chunks", """WITH m AS (SELECT doc_id, lang || chr(10) || replace(text, chr(10), chr(10) || '## ') AS text FROM documents), c AS (SELECT doc_id, unnest(string_split(text, chr(10) || '## ')) AS ch FROM m)
  SELECT doc_id, count(*) AS n_chunks, sum(length(ch))::BIGINT + 3 * (count(*) - 1) AS n_chars FROM c GROUP BY 1""")
def markdown_chunks(spark, sf):
    """Every line of a text after the first becomes a section."""
    d = texts(spark, sf).select("doc_id", F.concat("lang", F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("text"))
    c = tx.markdown_chunks(d, "doc_id")
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_raw").alias("n_chars"))


@query("column_chunks", """WITH l AS (SELECT p_partkey AS o, unnest(['p_name', 'p_brand', 'p_type']) AS "column", unnest([p_name, p_brand, p_type]) AS v FROM part), f AS (SELECT "column", v, min(o) AS o FROM l GROUP BY 1, 2),
  k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY o, v) AS rk FROM f) SELECT "column", string_agg(v, '、' ORDER BY rk) AS chunk FROM k WHERE rk <= 15 GROUP BY 1""")
def column_chunks(spark, sf):
    return tx.column_chunks(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], "p_partkey")


# --- retrieval ------------------------------------------------------------------
def _tfidf(src, key, text, vocab, stop):
    return f"""tk AS (SELECT {key} AS id, unnest({_TOK(text)}) AS token FROM {src}), tf AS (SELECT id, token, count(*) AS tf FROM tk WHERE length(token) > 1 AND token NOT IN {_STOP(stop)} GROUP BY 1, 2),
  dfr AS (SELECT token, count(*) AS df FROM tf GROUP BY 1 ORDER BY df DESC, token LIMIT {vocab}), rw AS (SELECT id, token, tf * (ln(((SELECT count(*) FROM {src}) + 1) / (df + 1)) + 1) AS w FROM tf JOIN dfr USING (token)),
  ix AS (SELECT id, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM rw)"""


_QV = lambda q: f"""qt AS (SELECT unnest({_TOK("'" + q + "'")}) AS token), qc AS (SELECT token, count(*) AS c FROM qt WHERE token IN (SELECT token FROM dfr) GROUP BY 1),
  qv AS (SELECT token, c / sqrt((SELECT sum(c * c) FROM qc)) AS qw FROM qc), rel AS (SELECT id, sum(weight * qw) AS score FROM ix JOIN qv USING (token) GROUP BY 1)"""
_Q = "and the oneren of ention que eau der"


@query("tfidf_index", f"WITH {_tfidf('documents', 'doc_id', 'text', 2000, tx.STOPWORDS)} SELECT id AS doc_id, count(*) AS n, round(sum(weight), 4) AS total FROM ix GROUP BY 1")
def tfidf_index(spark, sf):
    ix = tx.tfidf_index(texts(spark, sf), "doc_id", vocab=2000)
    return ix.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), R(F.sum("weight"), 4).alias("total"))


@query("retrieval_top_k", f"WITH {_tfidf('documents', 'doc_id', 'text', 2000, tx.STOPWORDS)}, {_QV(_Q)} SELECT id AS doc_id, round(score, 6) AS score FROM rel WHERE score > 0 ORDER BY round(score, 9) DESC, id LIMIT 8")
def retrieval_top_k(spark, sf):
    ix = settle(tx.tfidf_index(texts(spark, sf), "doc_id", vocab=2000))
    return tx.search(ix, _Q, "doc_id").select("doc_id", R("score").alias("score"))


_MEM = f"""mem AS (SELECT conv_id * 1000 + turn AS id, text AS content, CASE WHEN role = 'user' THEN 'observation' ELSE 'reflection' END AS memory_type, (conv_id + turn) % 10 + 1 AS importance,
  TIMESTAMP '2024-01-01' + to_minutes((conv_id * 97 + turn)::BIGINT) AS created_at, (conv_id + turn) % 3 = 0 AS tagged FROM conversations)"""


def memory(spark, sf):
    c, t = F.col("conv_id"), F.col("turn")
    return table(spark, sf, "conversations").select(
        (c * 1000 + t).alias("id"), F.col("text").alias("content"),
        F.when(F.col("role") == "user", "observation").otherwise("reflection").alias("memory_type"), ((c + t) % 10 + 1).alias("importance"),
        F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (c * 97 + t) * 60).alias("created_at"),
        F.when((c + t) % 3 == 0, F.array(F.lit("correction"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(c % 2 == 0, "rice").otherwise("maize").alias("species"),
    )


@query("hybrid_memory_ranking", f"""WITH {_MEM}, {_tfidf('mem', 'id', 'content', 1000, tx.MEMORY_STOPWORDS)}, {_QV(_Q)},
  s AS (SELECT mem.id, greatest(coalesce(score, 0), 0) AS relevance, exp(-greatest(epoch_us(TIMESTAMP '2024-03-01') - epoch_us(created_at), 0) / 3.6e9 * ln(2) / 168) AS recency, (importance - 1) / 9 AS imp FROM mem LEFT JOIN rel ON rel.id = mem.id),
  f AS (SELECT *, 0.5 * relevance + 0.25 * recency + 0.25 * imp AS final FROM s) SELECT id, round(relevance, 6) AS relevance, round(recency, 6) AS recency, round(final, 6) AS final FROM f WHERE relevance >= 0.01 OR final >= 0.05 ORDER BY round(final, 9) DESC, id LIMIT 20""")
def hybrid_memory_ranking(spark, sf):
    """Restates the reference, whose vocabulary has 1,000 words."""
    m = tx.hybrid_ranking(memory(spark, sf), _Q, F.lit("2024-03-01 00:00:00").cast("timestamp"), 20, vocab=1000)
    return m.select("id", R("relevance").alias("relevance"), R("recency").alias("recency"), R("final").alias("final"))


@query("memory_consolidation", f"""WITH {_MEM}, l AS (SELECT * FROM mem ORDER BY created_at DESC, id DESC LIMIT 20), o AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rk FROM l WHERE memory_type = 'observation')
  SELECT 'consolidation' AS session_id, substr(string_agg(content, '; ' ORDER BY rk) FILTER (rk <= 5), 1, 500) AS content, 'reflection' AS memory_type, 8 AS importance FROM o HAVING count(*) >= 5""")
def memory_consolidation(spark, sf):
    return tx.consolidate(memory(spark, sf), cut=500)


@query("correction_tags", """WITH m AS (SELECT *, regexp_matches(text, '(?i)wrong|actually|the on|eau|und') AS c FROM conversations WHERE role = 'user')
  SELECT conv_id, turn, c AS is_correction, CASE WHEN c THEN 9 ELSE 3 END AS importance, md5((CASE WHEN c THEN 'USER CORRECTION: ' ELSE 'User asked: ' END) || substr(text, 1, 200)) AS content_md5 FROM m""")
def correction_tags(spark, sf):
    m = table(spark, sf, "conversations").where("role = 'user'")
    t = tx.tag_corrections(m, patterns=["wrong", "actually", "the on", "eau", "und"], cut=200)
    return t.select("conv_id", "turn", "is_correction", "importance", F.md5("content").alias("content_md5"))


@query("correction_recall", f"""WITH {_MEM}, {_tfidf('mem', 'id', 'content', 1000, tx.MEMORY_STOPWORDS)}, {_QV(_Q)}, a AS (SELECT id, 0 AS way FROM rel WHERE score > 0 ORDER BY round(score, 9) DESC, id LIMIT 2),
  b AS (SELECT id, 1 AS way FROM mem WHERE tagged ORDER BY created_at DESC, id DESC LIMIT 5) SELECT id, min(way) AS way FROM (FROM a UNION ALL FROM b) GROUP BY 1""")
def correction_recall(spark, sf):
    """Restates the reference, whose vocabulary has 1,000 words."""
    return tx.recall_corrections(memory(spark, sf), _Q, vocab=1000)


@query("memory_filters", f"WITH {_MEM} SELECT id FROM mem WHERE tagged AND (id // 1000) % 2 = 0 ORDER BY created_at DESC, id DESC LIMIT 10")
def memory_filters(spark, sf):
    return tx.recent_by(memory(spark, sf), 10, "correction", "rice").select("id")


# --- mentions ----------------------------------------------------------------------
_FAMS, _METS = ["THE", "UND", "QUE", "ON"], ["tion", "eau", "sch", "ing"]
_MENT = f"""fm AS (SELECT DISTINCT doc_id, f AS family FROM documents, (SELECT unnest({_FAMS}) AS f) WHERE regexp_matches(text, '(?i)(^|[^\\pL\\pN_])(' || f || '|' || f || 'S)([^\\pL\\pN_]|$)|(^|[^\\pL\\pN_])' || f || '\\s*TRANSCRIPTION\\s*FACTOR')),
  mm AS (SELECT DISTINCT doc_id, CASE m WHEN 'sch' THEN 'eau' ELSE m END AS cls FROM documents, (SELECT unnest({_METS}) AS m) WHERE contains(lower(text), m))"""


def _mentions(spark, sf):
    d = texts(spark, sf)
    return tx.family_mentions(d, "doc_id", families=_FAMS), tx.metabolite_mentions(d, "doc_id", names=_METS)


@query("entity_mentions", f"WITH {_MENT} SELECT family, count(*) AS n FROM fm GROUP BY 1 UNION ALL SELECT 'm:' || cls, count(*) FROM mm GROUP BY 1")
def entity_mentions(spark, sf):
    f, m = _mentions(spark, sf)
    cls = m.select("doc_id", tx.metabolite_class(F.col("metabolite"), {"sch": "eau"}).alias("c")).distinct()
    return f.groupBy("family").agg(F.count(F.lit(1)).alias("n")).unionByName(
        cls.groupBy(F.concat(F.lit("m:"), "c").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    )


@query("co_mentions", f"""WITH {_MENT}, b AS (SELECT family, cls, doc_id, row_number() OVER (PARTITION BY family, cls ORDER BY doc_id) AS rk FROM fm JOIN mm USING (doc_id))
  SELECT family, cls AS class, count(*) AS n_papers, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (rk <= 3) AS papers,
  CASE WHEN family = 'THE' AND cls = 'tion' AND count(*) >= 3 THEN 'strong' WHEN count(*) >= 2 OR (family = 'THE' AND cls = 'tion') THEN 'moderate' ELSE 'weak' END AS strength,
  CASE WHEN family = 'THE' AND cls = 'tion' AND count(*) >= 3 THEN 0.8 WHEN (family = 'THE' AND cls = 'tion') OR (family = 'QUE' AND cls = 'eau' AND count(*) >= 2) THEN 0.55 WHEN count(*) >= 2 THEN 0.5 ELSE 0.3 END::DOUBLE AS score FROM b GROUP BY 1, 2""")
def co_mentions(spark, sf):
    f, m = _mentions(spark, sf)
    return tx.co_mentions(f, m, "doc_id", {"sch": "eau"}, [("THE", "tion")], [("QUE", "eau")])


# --- references: one per document, later copies by key ------------------------------
_REFS = """rf AS (SELECT doc_id AS pos, 'T' || (doc_id % 300) || '.' AS title, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS authors, CASE WHEN doc_id % 3 = 0 THEN lang END AS journal,
  CASE WHEN doc_id < 300 AND doc_id % 4 = 0 THEN '10.1/' || (doc_id % 300) WHEN doc_id % 9 = 0 AND (doc_id % 300) % 4 = 0 THEN '10.1/' || (doc_id % 300) ELSE '' END AS doi,
  CASE WHEN (doc_id % 300) % 8 = 0 THEN (5000 + doc_id % 300)::VARCHAR ELSE '' END AS pmid, '' AS url FROM documents)"""


@query("merge_references", f"""WITH {_REFS}, g AS (SELECT *, pos % 300 AS paper FROM rf) SELECT min(pos) AS pos, arg_min(title, pos) AS title, arg_min(nullif(trim(authors), ''), pos) FILTER (authors <> '') AS authors,
  arg_min(journal, pos) FILTER (journal IS NOT NULL) AS journal, arg_min(doi, pos) FILTER (doi <> '') AS doi, arg_min(pmid, pos) FILTER (pmid <> '') AS pmid, NULL::VARCHAR AS url FROM g GROUP BY paper""")
def merge_references(spark, sf):
    k = F.col("doc_id")
    p = k % 300
    text = p.cast("string")
    doi = F.when((k < 300) & (k % 4 == 0), F.concat(F.lit("10.1/"), text)).when((k % 9 == 0) & (p % 4 == 0), F.concat(F.lit("10.1/"), text)).otherwise("")
    refs = table(spark, sf, "documents").select(
        k.alias("pos"), F.concat(F.lit("T"), text, F.lit(".")).alias("title"), F.when(k % 2 == 0, F.col("source")).otherwise("").alias("authors"),
        F.when(k % 3 == 0, F.col("lang")).alias("journal"), doi.alias("doi"), F.when(p % 8 == 0, (5000 + p).cast("string")).otherwise("").alias("pmid"), F.lit("").alias("url"),
    )
    return tx.merge_references(refs)


# --- ratings -----------------------------------------------------------------------
@query("rating_distribution", "SELECT event_type, floor(value)::INT % 5 AS rating, count(*) AS n FROM events GROUP BY 1, 2")
def rating_distribution(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type", (F.floor("value").cast("int") % 5).alias("rating")).agg(F.count(F.lit(1)).alias("n"))


@query("rating_trend", """WITH d AS (SELECT ts::DATE AS day, avg(value) AS rating, count(*) AS n FROM events GROUP BY 1) SELECT day, n, round(rating, 6) AS rating, round(rating - lag(rating) OVER (ORDER BY day), 6) AS delta FROM d""")
def rating_trend(spark, sf):
    """Daily means first: the window sees one row per calendar day."""
    from pyspark.sql import Window as W

    d = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("rating"), F.count(F.lit(1)).alias("n"))
    w = W.orderBy("day")
    return d.withColumn("delta", R(F.col("rating") - F.lag("rating").over(w))).withColumn("rating", R("rating"))


# --- file formats: written from the tables, then read back ---------------------------
def _scratch(spark, name):
    return f"{shared_dir(spark)}/omiclattice/{name}-{uuid.uuid4().hex}"


@query("scan_wide_matrix", f"WITH {METAB} SELECT feature_id, sample_id, value FROM metab")
def scan_wide_matrix(spark, sf):
    """A wide matrix file: written with missing cells, sniffed, melted."""
    path = _scratch(spark, "wide")
    samples = [r[0] for r in table(spark, sf, "nation").select("n_name").orderBy("n_name").collect()]
    sinks.write_matrix(metab(spark, sf), path, samples)
    return matrices.read_expression(spark, path).where("value IS NOT NULL")


@query("scan_peak_table", """WITH p AS (SELECT l_returnflag AS sample_id, printf('mz_%.4f_rt_%.3f', l_extendedprice, l_quantity) AS feature_id, l_tax AS value, (l_orderkey, l_linenumber, l_partkey) AS o FROM lineitem)
  SELECT feature_id, sample_id, arg_min(value, o) AS value FROM p GROUP BY 1, 2""")
def scan_peak_table(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("Sample"), F.col("l_extendedprice").alias("m/z"), F.col("l_quantity").alias("RT"), F.col("l_tax").alias("Area"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("row"),
    )
    return matrices.peaks_to_long(li, matrices.long_columns(["Sample", "m/z", "RT", "Area"]), "row")


@query("column_roles", """WITH p AS (SELECT unnest(['p_size', 'p_name', 'p_retailprice', 'p_type', 'S1', 'S2', 'avg_S', 'mz']) AS name,
    unnest([p_name, p_name, p_type, p_type, CAST(p_size AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_type END, CAST(p_size AS VARCHAR), CAST(p_size AS VARCHAR)]) AS cell FROM part),
  r AS (SELECT name, count(TRY_CAST(cell AS DOUBLE)) / count(*)::DOUBLE AS ratio FROM p GROUP BY 1)
  SELECT name, round(ratio, 6) AS ratio, CASE WHEN name NOT IN ('avg_S', 'mz', 'p_name') AND (ratio > 0.5 OR (ratio > 0 AND regexp_matches(name, '^[A-Za-z]+[0-9]*(-[A-Za-z0-9]+)?$'))) THEN 'sample' ELSE 'metadata' END AS role FROM r""")
def column_roles(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    wide = p.select(
        "p_partkey", F.col("p_name").alias("p_size"), "p_name", F.col("p_type").alias("p_retailprice"), "p_type", size.alias("S1"),
        F.when(F.col("p_partkey") % 3 == 0, size).otherwise(F.col("p_type")).alias("S2"), size.alias("avg_S"), size.alias("mz"),
    )
    text = wide.select(*[F.col(c).cast("string").alias(c) for c in wide.columns])
    kinds = matrices.classify_columns(text)
    role = F.create_map(*[x for k, v in kinds.items() for x in (F.lit(k), F.lit(v))])
    return matrices.numeric_shares(text).select("name", R("ratio").alias("ratio"), role[F.col("name")].alias("role"))


@query("tf_list_scan", """SELECT p_brand AS species, 'T' || p_partkey AS tf_id, 'G' || p_partkey AS gene_id, upper(split_part(p_name, ' ', 2)) AS family FROM part""")
def tf_list_scan(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    fam = F.upper(F.split("p_name", " ")[1])
    lines = p.select(F.col("p_brand").alias("species"), F.concat_ws("\t", F.concat(F.lit("T"), k), F.concat(F.lit("G"), k), fam).alias("value"))
    known = [r[0] for r in p.select(fam).distinct().collect()]  # the nouns of the part names
    return sq.parse_tf_list(lines, known, min_rows=3)


@query("classification_ids", """SELECT gene_id, count(*) AS hits FROM (SELECT 'g' || l_partkey || '.1' AS gene_id FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT 'g' || l_partkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1""")
def classification_ids(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit(" g"), F.col("l_partkey").cast("string"), F.lit(".1 ")).alias("raw"), F.when(F.col("l_linenumber") == 1, "PF00249").otherwise("Rx1").alias("dom")
    )
    return sq.classification_ids(rows, F.col("raw"), F.col("dom"))


@query("candidate_table", _fuse_sql() + " SELECT gene_id, level, round(cal + 1e-9, 4)::DOUBLE AS calibrated_score, n AS n_evidence FROM fz")
def candidate_table(spark, sf):
    return sinks.candidate_table(ev.fuse(candidates(spark, sf), plausibility="plausibility")).drop("top_sources")


@query("evidence_table", _fuse_sql() + " SELECT gene_id, source, round(raw, 4) AS score FROM e")
def evidence_table(spark, sf):
    return sinks.evidence_table(ev.fuse(candidates(spark, sf), plausibility="plausibility")).drop("contribution")


@query("session_snapshot", """SELECT session_id, block, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT 's' || (l_suppkey % 3) AS session_id, l_returnflag AS block, CASE WHEN l_returnflag = 'A' THEN l_quantity * 2 ELSE l_quantity END AS value FROM lineitem) GROUP BY 1, 2""")
def session_snapshot(spark, sf):
    """Three blocks per session, then block A is uploaded again."""
    path = _scratch(spark, "snapshot")
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("session_id"), F.col("l_returnflag").alias("block"),
        F.col("l_partkey").cast("string").alias("feature_id"), F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_quantity").alias("value"),
    )
    sinks.write_snapshot(li, path)
    sinks.write_snapshot(li.where("block = 'A'").withColumn("value", F.col("value") * 2), path)
    return spark.read.parquet(path).groupBy("session_id", "block").agg(F.count(F.lit(1)).alias("n"), R(F.sum("value"), 2).alias("total"))


@query("upload_stream", """WITH u AS (SELECT 's' || (l_suppkey % 3) AS session_id, l_returnflag AS block, l_linenumber % 4 AS pos, l_quantity FROM lineitem
    WHERE NOT (l_returnflag = 'A' AND l_linenumber % 4 = 3))
  SELECT session_id, block, pos::BIGINT AS pos, count(*) AS n, sum(l_quantity) AS total FROM u
  WHERE pos = (SELECT max(pos) FROM u v WHERE v.session_id = u.session_id AND v.block = u.block) GROUP BY 1, 2, 3""")
def upload_stream(spark, sf):
    """Four uploads of every block (block A has three) arrive one a batch, out of order: the newest of each stays."""
    arrived, path = _scratch(spark, "arrived"), _scratch(spark, "uploads")
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("session_id"), F.col("l_returnflag").alias("block"),
        F.col("l_partkey").cast("string").alias("feature_id"), F.col("l_orderkey").cast("string").alias("sample_id"),
        F.col("l_quantity").alias("value"), (F.col("l_linenumber") % 4).cast("long").alias("pos"),
    ).where("NOT (block = 'A' AND pos = 3)")
    for k, pos in enumerate((1, 3, 2, 0)):
        li.where(F.col("pos") == pos).write.parquet(f"{arrived}/batch={k}")
        # one batch for each arrival; the progress of the stream is kept between them
        stream = spark.readStream.schema(li.schema).option("basePath", arrived).parquet(f"{arrived}/batch=*")
        ingest.start_upload_stream(stream.select(*li.columns), path, f"{path}-state").awaitTermination()
    kept = spark.read.parquet(path)
    return kept.groupBy("session_id", "block", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


# --- streams ----------------------------------------------------------------------------
def _events(spark, sf):
    e = ingest.file_stream(spark, sf, "events", table(spark, sf, "events").schema)
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_windowed_counts", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events
  WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def stream_windowed_counts(spark, sf):
    out = ingest.run_to_table(ingest.windowed_counts(_events(spark, sf), "ts", "event_type"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_decayed_relevance", """WITH w AS (SELECT time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, user_id, value, ts FROM events)
  SELECT window_end, user_id, round(sum(value * exp(-(epoch_us(window_end) - epoch_us(ts)) / 3.6e9 * ln(2) / 168)), 6) AS relevance FROM w WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2""")
def stream_decayed_relevance(spark, sf):
    out = ingest.run_to_table(ingest.decayed_relevance(_events(spark, sf), "ts", "user_id", "value"))
    return out.withColumns({"relevance": R("relevance"), "window_end": F.col("window_end").cast("timestamp_ntz")})


@query("stream_access_counters", "SELECT user_id, count(*) AS access_count, max(ts) AS last_accessed FROM events GROUP BY 1")
def stream_access_counters(spark, sf):
    upd = ingest.run_to_table(ingest.access_counters(_events(spark, sf), "user_id", "ts"), "update")
    return ingest.latest(upd, "user_id").withColumn("last_accessed", F.col("last_accessed").cast("timestamp_ntz"))


@query("stream_deduplicated_cells", "SELECT DISTINCT event_type, user_id FROM events")
def stream_deduplicated_cells(spark, sf):
    s = ingest.deduplicated(_events(spark, sf).select("ts", "event_type", "user_id"), "ts", "60 days", ["event_type", "user_id"])
    return ingest.run_to_table(s).select("event_type", "user_id")


@query("listing_since", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00'")
def listing_since(spark, sf):
    return ingest.since(table(spark, sf, "events"), "ts", "2024-01-10 12:00:00").select("event_id")
