"""Queries on sequences derived from document texts, and on enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from omiclattice.functions.materialise import settle
from omiclattice.functions.scalars import round_half_up
from omiclattice.operators import enrich, motifs as mo, stats
from omiclattice.plans.matrix_queries import R, _AOV, _BASE, _logged
from omiclattice.plans.registry import query
from omiclattice.plans.views import EXPR, METAB, expr, groups, metab, sql_bh, sql_hypergeom, table, texts
from omiclattice.sources import sequences as sq

_AZ, _NT = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
_AA = "ACDEFGHIKLMNPQRSTVWYACDEFG"
_SEQ = f"""sq AS (SELECT 'D' || doc_id AS seq_id, doc_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_AZ}', '{_NT}') AS sequence FROM documents)"""


def seqs_view(spark, sf, alphabet=_NT):
    """Letters of each whole text mapped to nucleotides (or amino acids)."""
    return texts(spark, sf).select(
        F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("seq_id"), "doc_id",
        F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _AZ, alphabet).alias("sequence"),
    )


@query("reverse_complement", f"WITH {_SEQ} SELECT seq_id, md5(reverse(translate(sequence, 'ACGT', 'TGCA'))) AS rc FROM sq")
def reverse_complement(spark, sf):
    return seqs_view(spark, sf).select("seq_id", F.md5(mo.reverse_complement(F.col("sequence"))).alias("rc"))


@query("nucleotide_test", """SELECT doc_id, length(text) > 0 AND length(regexp_replace(upper(substr(text, 1, 500)), '[^ACGTUN]', '', 'g')) / length(substr(text, 1, 500)) > 0.9 AS is_nt FROM documents""")
def nucleotide_test(spark, sf):
    """Restates the reference, which judges the first 500 letters."""
    return table(spark, sf, "documents").select("doc_id", mo.is_nucleotide(F.col("text"), first=500).alias("is_nt"))


_MOTS = lambda rows: " UNION ALL ".join(
    f"SELECT '{f}' AS family, '{mo.iupac_regex(p)}' AS rx, '{n}' AS motif, {s}::DOUBLE AS sc" for f, p, n, s in rows
)


@query("motif_hit_counts", f"""WITH {_SEQ}, m AS ({_MOTS(mo.SCORED_MOTIFS)})
  SELECT seq_id, motif, len(regexp_extract_all(sequence, rx)) AS n_hits, strpos(sequence, regexp_extract(sequence, rx)) - 1 AS first_start
  FROM sq, m WHERE length(sequence) >= 10 AND regexp_matches(sequence, rx)""")
def motif_hit_counts(spark, sf):
    return mo.motif_hits(seqs_view(spark, sf)).groupBy("seq_id", "motif").agg(
        F.count(F.lit(1)).alias("n_hits"), F.min("start").alias("first_start")
    )


@query("motif_rollup", f"""WITH {_SEQ}, m AS ({_MOTS(mo.SCORED_MOTIFS)}), h AS (SELECT seq_id, family, motif, len(regexp_extract_all(sequence, rx)) AS n,
    sc * greatest(0, 1 - (strpos(sequence, regexp_extract(sequence, rx)) - 1) / length(sequence) * 0.5) AS s FROM sq, m WHERE length(sequence) >= 10 AND regexp_matches(sequence, rx))
  SELECT seq_id, sum(n)::INT AS n_hits, round(max(s) + 1e-9, 4) AS best_score, count(DISTINCT family)::INT AS n_families FROM h GROUP BY 1""")
def motif_rollup(spark, sf):
    return mo.motif_rollup(seqs_view(spark, sf)).select("seq_id", "n_hits", round_half_up(F.col("best_score"), 4).alias("best_score"), "n_families")


_CONS = " UNION ALL ".join(f"SELECT '{f}' AS family, '{mo.iupac_regex(p)}' AS rx" for _, p, f in mo.CONSENSUS_MOTIFS)


@query("motif_conservation", f"""WITH {_SEQ}, m AS ({_CONS}), h AS (SELECT doc_id, family, len(regexp_extract_all(sequence, rx)) AS n FROM sq, m
    WHERE length(sequence) >= 4 AND regexp_matches(sequence, rx)),
  pf AS (SELECT doc_id, coalesce(sum(n), 0) AS n, coalesce(list(DISTINCT family) FILTER (family IS NOT NULL), []) AS fam FROM sq LEFT JOIN h USING (doc_id) GROUP BY 1)
  SELECT 'D' || a.doc_id AS source, 'D' || b.doc_id AS target, array_to_string(list_sort(list_intersect(a.fam, b.fam)), ',') AS shared_families,
  CASE WHEN a.n = 0 OR b.n = 0 THEN 0 ELSE round(len(list_intersect(a.fam, b.fam)) / len(list_distinct(list_concat(a.fam, b.fam))) * 0.7::DOUBLE
    + (0.5::DOUBLE + 0.5::DOUBLE * least(a.n / b.n, b.n / a.n)) * 0.3::DOUBLE + 1e-9, 3) END::DOUBLE AS score FROM pf a JOIN pf b ON b.doc_id = a.doc_id + 1""")
def motif_conservation(spark, sf):
    s = seqs_view(spark, sf)
    pairs = s.select("doc_id", F.col("seq_id").alias("source")).join(
        s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("seq_id").alias("target")), "doc_id"
    ).select("source", "target")
    return mo.conservation(pairs, settle(mo.family_profile(s)))


@query("pwm_scan")
def pwm_scan(spark, sf):
    """Weight matrices built from the scored consensus words (0.9 per letter)."""
    words = {"Gbox": ("bHLH", "CACGTG"), "GCCbox": ("AP2-ERF", "GCCGCC"), "MRE": ("MYB", "TAACTA")}
    col = lambda ch: [0.9 if ch == b else 0.1 / 3 for b in "ACGT"]
    pwms = {k: (f, [list(r) for r in zip(*[col(ch) for ch in w])]) for k, (f, w) in words.items()}
    return mo.hit_rollup(mo.pwm_hits(seqs_view(spark, sf), pwms)).withColumn("best_score", R("best_score"))


@query("longest_orf")
def longest_orf(spark, sf):
    return mo.longest_orf(seqs_view(spark, sf)).where("protein IS NOT NULL").select(
        "seq_id", F.length("protein").alias("n_aa"), F.md5("protein").alias("protein_md5")
    )


@query("kmer_identity", f"""WITH {_SEQ}, k AS (SELECT doc_id, list_distinct(list_transform(range(1, length(sequence) - 4), lambda i: substr(sequence, i::BIGINT, 6))) AS g FROM sq WHERE length(sequence) >= 6)
  SELECT a.doc_id, round(len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)) * 100, 6) AS identity FROM k a JOIN k b ON b.doc_id = a.doc_id + 1""")
def kmer_identity(spark, sf):
    s = seqs_view(spark, sf).where(F.length("sequence") >= 6)
    b = s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("sequence").alias("other"))
    return s.join(b, "doc_id").select("doc_id", R(mo.kmer_identity(F.col("sequence"), F.col("other"), 6)).alias("identity"))


@query("alignment_identity")
def alignment_identity(spark, sf):
    """Neighbouring benchmark items as proteins, aligned at any length."""
    b = table(spark, sf, "benchmark").select(
        "item_id", F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _AZ, _AA).alias("s")
    )
    pairs = b.select("item_id", F.col("s").alias("seq_a")).join(
        b.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("seq_b")), "item_id"
    )
    return mo.alignment_identity(pairs).select("item_id", R("identity").alias("identity"), "aln_length", "confidence")


@query("parse_fasta", """WITH d AS (SELECT doc_id, lang AS id, regexp_replace(upper(regexp_replace(text, '[^a-zA-Z]', '', 'g')), '\\s+', '', 'g') AS s,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents)
  SELECT CASE WHEN nth = 1 THEN id ELSE id || '_' || nth END AS seq_id, length(s) AS n, md5(s) AS seq_md5 FROM d""")
def parse_fasta(spark, sf):
    letters = F.regexp_replace("text", "[^a-zA-Z]", "")
    folded = F.regexp_replace(letters, "(.{60})", "$1\n")
    rec = table(spark, sf, "documents").select(
        F.concat(F.lit(">"), F.col("lang"), F.lit(" some description\n"), folded, F.lit("\n")).alias("value"), F.col("doc_id").alias("pos")
    )
    return sq.parse_fasta(rec).select("seq_id", F.length("sequence").alias("n"), F.md5("sequence").alias("seq_md5"))


_HITS = """hit AS (SELECT l_partkey AS gene_id, 'PF' || lpad((l_suppkey % 40)::VARCHAR, 5, '0') AS pfam, max(l_quantity) AS bitscore FROM lineitem GROUP BY 1, 2),
  rule AS (SELECT 'F' || s AS family, CASE WHEN s % 2 = 0 THEN 'all' ELSE 'any' END AS rule, 'PF' || lpad(p::VARCHAR, 5, '0') AS pfam
    FROM (SELECT DISTINCT s_suppkey % 12 AS s FROM supplier), range(0, 40) r(p) WHERE p % 12 = s AND p < 36)"""


@query("tf_family_rules", f"""WITH {_HITS}, n AS (SELECT family, count(*) AS need FROM rule GROUP BY 1),
  f AS (SELECT gene_id, family, rule, count(*) AS k, min(bitscore) AS lo, max(bitscore) AS hi, string_agg(pfam, ',' ORDER BY pfam) AS domains FROM hit JOIN rule USING (pfam) GROUP BY 1, 2, 3),
  c AS (SELECT gene_id, family, domains, CASE rule WHEN 'all' THEN 2 ELSE 1 END AS spec, CASE rule WHEN 'all' THEN lo ELSE hi END AS score FROM f JOIN n USING (family) WHERE rule = 'any' OR k = need),
  r AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY spec DESC, score DESC, family) AS rk FROM c WHERE score >= 20)
  SELECT gene_id, family, round(score, 1) AS score, domains FROM r WHERE rk = 1""")
def tf_family_rules(spark, sf):
    return _assigned(spark, sf).select("gene_id", "family", "score", "domains")


def _assigned(spark, sf):
    code = lambda c: F.concat(F.lit("PF"), F.lpad(c.cast("string"), 5, "0"))
    hits = table(spark, sf, "lineitem").groupBy(
        F.col("l_partkey").alias("gene_id"), code(F.col("l_suppkey") % 40).alias("pfam")
    ).agg(F.max("l_quantity").alias("bitscore"), F.lit(1e-10).alias("evalue"))
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") % 12).alias("s")).distinct()
    rules = s.select(
        F.concat(F.lit("F"), F.col("s").cast("string")).alias("family"),
        F.when(F.col("s") % 2 == 0, "all").otherwise("any").alias("rule"),
        F.transform(F.array(F.lit(0), F.lit(12), F.lit(24)), lambda k: code(k + F.col("s"))).alias("pfam"),
    )
    return mo.family_rules(hits, rules)


@query("tf_family_counts", f"""WITH {_HITS}, n AS (SELECT family, count(*) AS need FROM rule GROUP BY 1),
  f AS (SELECT gene_id, family, rule, count(*) AS k, min(bitscore) AS lo, max(bitscore) AS hi FROM hit JOIN rule USING (pfam) GROUP BY 1, 2, 3),
  c AS (SELECT gene_id, family, CASE rule WHEN 'all' THEN 2 ELSE 1 END AS spec, CASE rule WHEN 'all' THEN lo ELSE hi END AS score FROM f JOIN n USING (family) WHERE rule = 'any' OR k = need),
  r AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY spec DESC, score DESC, family) AS rk FROM c WHERE score >= 20)
  SELECT family, count(*) AS n FROM r WHERE rk = 1 GROUP BY 1""")
def tf_family_counts(spark, sf):
    return _assigned(spark, sf).groupBy("family").agg(F.count(F.lit(1)).alias("n"))


@query("domain_orthologs", """WITH t AS (SELECT p_partkey AS target, unnest([p_type, 'S' || p_size, p_brand]) AS domain FROM part),
  s AS (SELECT s_suppkey AS source, unnest(['Brand#' || (1 + s_suppkey % 25), 'S' || (1 + s_suppkey % 50), 'ECONOMY', 'Brand#' || (1 + s_suppkey % 7)]) AS domain, unnest([0, 1, 2, 3]) AS pos FROM supplier),
  p AS (SELECT source, target, 0.25 AS v FROM s JOIN (SELECT DISTINCT target, domain FROM t) USING (domain) WHERE pos < 3
    UNION ALL SELECT s_suppkey, target, 0.3 FROM supplier JOIN (SELECT DISTINCT target, domain FROM t) ON domain = 'S' || (1 + s_suppkey % 50)),
  c AS (SELECT source, target, least(sum(v::DOUBLE) * 100, 100) AS score FROM p GROUP BY 1, 2)
  SELECT source, target, round(score, 6) AS score, CASE WHEN round(score, 9) >= 80 THEN 'high' WHEN round(score, 9) >= 40 THEN 'medium' ELSE 'low' END AS confidence FROM c""")
def domain_orthologs(spark, sf):
    p = table(spark, sf, "part")
    targets = p.select(F.col("p_partkey").alias("target"), F.explode(F.array(
        F.col("p_type"), F.concat(F.lit("S"), F.col("p_size").cast("string")), F.col("p_brand"))).alias("domain"))
    k = F.col("s_suppkey")
    size = F.concat(F.lit("S"), (1 + k % 50).cast("string"))
    brand = lambda m: F.concat(F.lit("Brand#"), (1 + k % m).cast("string"))
    base = table(spark, sf, "supplier")
    sources = base.select(k.alias("source"), F.posexplode(F.array(brand(25), size, F.lit("ECONOMY"), brand(7))).alias("pos", "domain"), F.lit(4).alias("n_domains"))
    pfam = base.select(k.alias("source"), size.alias("domain"))
    return mo.domain_orthologs(sources, targets, pfam, first=3, digits=6)


# --- enrichment ------------------------------------------------------------------
_ENR = """hit AS (SELECT doc_id FROM labels WHERE quality = 1), back AS (SELECT DISTINCT doc_id FROM documents),
  mem AS (SELECT DISTINCT 'L:' || lang AS set_id, doc_id FROM documents UNION SELECT DISTINCT 'S:' || source, doc_id FROM documents),
  drawn AS (SELECT DISTINCT doc_id FROM hit SEMI JOIN back USING (doc_id)),
  cnt AS (SELECT set_id, count(*) AS set_size, count(d.doc_id) AS overlap, (SELECT count(*) FROM drawn) AS n_hits, (SELECT count(*) FROM back) AS n_background
    FROM mem LEFT JOIN drawn d USING (doc_id) GROUP BY 1)"""


def _doc_sets(spark, sf):
    d = table(spark, sf, "documents")
    hits = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("feature_id"))
    member = lambda p, c: d.select(F.concat(F.lit(p), F.col(c)).alias("set_id"), F.col("doc_id").alias("feature_id"))
    members = member("L:", "lang").unionByName(member("S:", "source"))
    return hits, members, d.select(F.col("doc_id").alias("feature_id"))


@query("over_representation", f"""WITH {_ENR} SELECT set_id, set_size, overlap, round(n_hits * set_size / n_background, 6) AS expected,
  round(overlap / (n_hits * set_size / n_background), 6) AS fold, round({sql_hypergeom('overlap', 'set_size', 'n_hits', 'n_background')}, 6) AS p_value FROM cnt""")
def over_representation(spark, sf):
    res = enrich.over_representation(*_doc_sets(spark, sf))
    return res.select("set_id", "set_size", "overlap", R("expected").alias("expected"), R("fold").alias("fold"), R("p_value").alias("p_value"))


@query("fisher_combined", """WITH p AS (SELECT l_returnflag, l_shipdate::DATE AS d, (l_quantity - 1) / 50 AS p FROM lineitem), c AS (SELECT l_returnflag, d,
    count(*) FILTER (p > 0 AND p <= 1) AS k, sum(ln(p)) FILTER (p > 0 AND p <= 1) AS s FROM p GROUP BY 1, 2)
  SELECT l_returnflag, d, round(CASE WHEN k = 0 THEN 1 ELSE least(1, list_sum(list_transform(range(0, k), lambda i: exp(s + i * ln(greatest(-s, 1e-300)) - lgamma(i + 1))))) END, 6)::DOUBLE AS p_combined FROM c""")
def fisher_combined(spark, sf):
    p = table(spark, sf, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("d"), ((F.col("l_quantity") - 1) / 50).alias("p"))
    return enrich.fisher_combined(p, ["l_returnflag", "d"], "p").withColumn("p_combined", R("p_combined"))


_JOINT = f"""WITH {_ENR}, g AS (SELECT *, {sql_hypergeom('overlap', 'set_size', 'n_hits', 'n_background')} AS p_deg FROM cnt),
  mp AS (SELECT 'L:' || lang AS set_id, (1 + n_chars % 97) / 98.0 AS p FROM documents),
  ms AS (SELECT set_id, count(*) AS n_dam, sum(ln(p)) AS s FROM mp GROUP BY 1),
  b AS (SELECT set_id, overlap, p_deg, coalesce(n_dam, 0) AS n_dam, CASE WHEN n_dam IS NULL THEN 1.0 ELSE least(1, list_sum(list_transform(range(0, n_dam), lambda i: exp(s + i * ln(-s) - lgamma(i + 1))))) END AS p_dam FROM g LEFT JOIN ms USING (set_id)),
  c AS (SELECT *, least(1.0, p_deg * p_dam * (1 - ln(p_deg * p_dam))) AS p_combined FROM b), q1 AS ({sql_bh('c', 'p_combined')}),
  q2 AS ({sql_bh('(SELECT set_id, p_deg FROM c)', 'p_deg')})
  SELECT q1.set_id, overlap, n_dam, round(p_deg, 6) AS p_deg, round(p_dam, 6) AS p_dam, round(p_combined, 6) AS p_combined, round(q1.q_raw, 6) AS q_combined, round(q2.q_raw, 6) AS q_deg
  FROM q1 JOIN (SELECT set_id AS sid, q_raw FROM q2) q2 ON sid = q1.set_id"""


@query("joint_enrichment", _JOINT.replace("(SELECT set_id, p_deg FROM c)", "(SELECT set_id, p_deg FROM c) cc"))
def joint_enrichment(spark, sf):
    mp = table(spark, sf, "documents").select(
        F.concat(F.lit("L:"), "lang").alias("set_id"), ((1 + F.col("n_chars") % 97) / 98.0).alias("p_value")
    )
    res = enrich.joint_enrichment(*_doc_sets(spark, sf), mp)
    return res.select("set_id", "overlap", "n_dam", *[R(c).alias(c) for c in ("p_deg", "p_dam", "p_combined", "q_combined", "q_deg")])


_WORDS = ["the", "que", "der", "and", "ing", "tion", "est", "http", "copyright", "eau"]
_TERMS_SQL = " UNION ALL ".join(f"SELECT '{w}' AS word" for w in _WORDS)


@query("term_enrichment", f"""WITH hit AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1), back AS (SELECT DISTINCT doc_id FROM documents ANTI JOIN hit USING (doc_id)),
  w AS ({_TERMS_SQL}), tg AS (SELECT DISTINCT doc_id, word FROM documents, w WHERE contains(lower(text), word)),
  c AS (SELECT word, count(*) FILTER (doc_id IN (SELECT doc_id FROM hit)) AS in_set, count(*) FILTER (doc_id IN (SELECT doc_id FROM back)) AS in_background,
    (SELECT count(*) FROM hit) AS n_set, (SELECT count(*) FROM back) AS n_back FROM tg GROUP BY 1 HAVING count(*) FILTER (doc_id IN (SELECT doc_id FROM hit)) >= 2),
  t AS (SELECT *, {sql_hypergeom('in_set', 'in_set + in_background', 'n_set', 'n_set + n_back')} AS p FROM c), q AS ({sql_bh('t', 'p')})
  SELECT word, in_set, in_background, round(p, 6) AS p_value, round(q_raw, 6) AS q_value FROM q WHERE q_raw < 0.9999""")
def term_enrichment(spark, sf):
    d = texts(spark, sf)
    hits = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("feature_id"))
    ann = d.select(F.col("doc_id").alias("feature_id"), F.col("text").alias("term"))
    res = enrich.term_enrichment(hits, d.select(F.col("doc_id").alias("feature_id")), ann, _WORDS, alpha=0.9999)
    return res.select("word", "in_set", "in_background", R("p_value").alias("p_value"), R("q_value").alias("q_value"))


@query("gene_name_match", """WITH nm AS (SELECT DISTINCT p_name AS name FROM part), ids AS (SELECT DISTINCT upper(p_name) || '_' || p_partkey AS feature_id FROM part),
  m AS (SELECT name, feature_id, row_number() OVER (PARTITION BY name ORDER BY length(feature_id), feature_id) AS rk FROM nm JOIN ids
    ON contains(upper(feature_id), upper(name)) OR contains(upper(name), upper(feature_id)))
  SELECT name, feature_id FROM m WHERE rk = 1""")
def gene_name_match(spark, sf):
    p = table(spark, sf, "part")
    ids = p.select(F.concat(F.upper("p_name"), F.lit("_"), F.col("p_partkey").cast("string")).alias("feature_id"))
    return enrich.match_gene_names(p.select(F.col("p_name").alias("name")).distinct(), ids)


@query("pathway_activity", f"""WITH {EXPR}, en AS (SELECT p_brand AS set_id, 'P' || p_partkey AS feature_id FROM part),
  mn AS (SELECT feature_id, avg(value) AS m FROM expr GROUP BY 1), z AS (SELECT feature_id, (m - (SELECT avg(m) FROM mn)) / ((SELECT stddev_pop(m) FROM mn) + 1e-10) AS z FROM mn),
  zs AS (SELECT set_id, avg(z) AS mean_z, count(*) AS n_enzymes FROM en JOIN z USING (feature_id) GROUP BY 1),
  st AS (SELECT feature_id, avg(value) AS m, var_pop(value) * count(*) AS ss FROM expr GROUP BY 1 HAVING count(*) >= 3 AND var_pop(value) > 0),
  u AS (SELECT set_id, sample_id, sum((value - m) / sqrt(ss)) AS s FROM en JOIN expr USING (feature_id) JOIN st USING (feature_id) GROUP BY 1, 2),
  k AS (SELECT set_id, count(*) AS k FROM en JOIN st USING (feature_id) GROUP BY 1),
  c AS (SELECT set_id, greatest((sum(s * s) - any_value(k)) / (any_value(k) * (any_value(k) - 1)), 0) AS coherence FROM u JOIN k USING (set_id) WHERE k >= 2 GROUP BY 1)
  SELECT set_id, n_enzymes, round(mean_z, 6) AS mean_z, round(coherence, 6) AS coherence, coalesce(coherence >= 0.2, false) AS is_active FROM zs LEFT JOIN c USING (set_id)""")
def pathway_activity(spark, sf):
    en = table(spark, sf, "part").select(
        F.col("p_brand").alias("set_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("feature_id")
    )
    res = enrich.pathway_activity(settle(expr(spark, sf)), en)
    return res.withColumns({"mean_z": R("mean_z"), "coherence": R("coherence")})
