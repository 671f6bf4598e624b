"""Text evidence: tokens, mentions, retrieval, memory, references.

Texts are processed whole. Retrieval explodes tokens once, counts them with
partial aggregation and meets the query by an equality join on tokens.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from omiclattice.functions.materialise import settle

# Stop words of document and memory retrieval.
STOPWORDS = ["the", "a", "an", "is", "are", "was", "were", "of", "in", "to", "and", "for", "on", "with", "as", "at", "by", "or"]
MEMORY_STOPWORDS = STOPWORDS + ["this", "that", "from", "it", "its", "be", "has", "have"]

# Wording that claims too much.
FORBIDDEN = ["identified regulator", "confirmed", "proved", "master regulator", "strongly proves", "demonstrates causality"]
CAUSAL_VERBS = ["regulates", "controls", "activates", "represses", "is a master regulator of", "directly binds"]

# Label of an uncertainty or confidence level.
LEVEL_LABELS = {
    "high": "insufficient evidence",
    "moderate": "weakly supported",
    "low": "moderately plausible",
    "gold": "plausible",
    "silver": "weakly supported",
    "weak": "insufficient evidence",
    "insufficient": "insufficient evidence",
}

# Phrases by which a user corrects an answer.
CORRECTIONS = [
    "不对", "错了", "应该是", "其实是", "不是.*而是", "纠正", "修正", "搞错了", "说错了", "弄错了",
    "你错了", "wrong", "incorrect", "that's not", "actually", "should be", "correct that", "it is not", "that is wrong",
]

# Families and metabolites looked for in papers.
TF_FAMILIES = [
    "MYB", "bHLH", "WRKY", "ERF", "NAC", "bZIP", "WD40", "SPL", "GRAS", "ARF", "HD-ZIP", "MADS-box", "TCP", "C2H2",
    "HSF", "Dof", "GATA", "Trihelix", "LOB", "GeBP",
]
METABOLITE_CLASSES = ["alkaloid", "flavonoid", "anthocyanin", "terpenoid", "phenylpropanoid", "lignin", "glucosinolate", "phenolic"]
SPECIFIC_METABOLITES = [
    "berberine", "nicotine", "artemisinin", "taxol", "vinblastine", "caffeine", "morphine", "quercetin", "resveratrol",
    "tanshinone", "gossypol", "catharanthine", "solanine", "capsaicin",
]

# Class of each specific metabolite.
CLASS_OF = {
    "berberine": "alkaloid", "nicotine": "alkaloid", "morphine": "alkaloid",
    "caffeine": "alkaloid", "vinblastine": "alkaloid", "catharanthine": "alkaloid",
    "solanine": "alkaloid", "capsaicin": "alkaloid",
    "quercetin": "flavonoid", "resveratrol": "phenylpropanoid",
    "artemisinin": "terpenoid", "taxol": "terpenoid", "tanshinone": "terpenoid",
    "gossypol": "terpenoid", "glucosinolate": "phenylpropanoid", "phenolic": "phenylpropanoid",
}

# Well and moderately studied family/class pairs.
STRONG_PAIRS = [
    ("MYB", "flavonoid"), ("MYB", "anthocyanin"), ("MYB", "lignin"), ("bHLH", "anthocyanin"), ("WD40", "anthocyanin"),
    ("WRKY", "alkaloid"), ("ERF", "alkaloid"), ("NAC", "lignin"), ("bHLH", "flavonoid"), ("bZIP", "flavonoid"),
]
MODERATE_PAIRS = [
    ("WRKY", "terpenoid"), ("ERF", "terpenoid"), ("bHLH", "alkaloid"), ("MYB", "alkaloid"), ("NAC", "anthocyanin"),
    ("bZIP", "alkaloid"), ("SPL", "flavonoid"), ("TCP", "flavonoid"), ("ARF", "flavonoid"), ("HD-ZIP", "phenylpropanoid"),
]

HALF_LIFE_HOURS = 168.0


# --- scalars -------------------------------------------------------------------
def tokens(text: Column) -> Column:
    """Lower-case runs of Latin letters or CJK characters."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z一-鿿]+"), F.lit(0))


def has_cjk(text: Column) -> Column:
    return text.rlike("[\\u3400-\\u9fff]")


def cas_number(names: Column) -> Column:
    """First name that looks like a CAS number."""
    return F.get(F.filter(names, lambda s: s.rlike(r"^\d{2,7}-\d{2}-\d$")), F.lit(0))


def recency(created: Column, now: Column) -> Column:
    """Exponential decay with a one-week half-life; the future counts as now."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    hours = F.greatest((micros(now) - micros(created)) / 3.6e9, F.lit(0.0))
    return F.exp(-hours * F.ln(F.lit(2.0)) / HALF_LIFE_HOURS)


def importance_score(importance: Column) -> Column:
    return F.greatest(F.least((importance - 1) / 9.0, F.lit(1.0)), F.lit(0.0))


def wording_issues(text: Column, phrases: list[str] = FORBIDDEN + CAUSAL_VERBS) -> Column:
    """Phrases found that an unvalidated conclusion must not use."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases]))


def level_label(level: Column) -> Column:
    out = F.lit("insufficient evidence")
    for k, v in LEVEL_LABELS.items():
        out = F.when(F.lower(level) == k, v).otherwise(out)
    return out


# --- chunks ------------------------------------------------------------------------
def markdown_chunks(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Sections split at level-two headings, with their titles."""
    parts = docs.select(key, F.posexplode(F.split(text, r"\n(?=## )")).alias("pos", "chunk"))
    head = F.split("chunk", "\n")[0]
    return parts.select(
        key, "pos", F.when(F.col("chunk").startswith("## "), F.trim(F.trim(head, F.lit("# ")))).otherwise("概述").alias("section"),
        F.regexp_replace("chunk", r"^\s+|\s+$", "").alias("chunk"), F.length("chunk").alias("n_raw"),
    )


def column_chunks(df: DataFrame, columns: list[str], order: str, top: int = 15, cut: int | None = None) -> DataFrame:
    """First distinct values per column, in order of appearance, as one text; with ``cut`` so many characters of each.

    Distinct values keep their first position map-side; the rank limit is
    pushed below the shuffle.
    """
    from omiclattice.operators.network import top_per_group

    long = df.select(F.col(order).alias("_o"), *[_first(F.col(c).cast("string"), cut).alias(c) for c in columns]).unpivot(
        "_o", columns, "column", "v"
    )
    first = long.where("v IS NOT NULL AND v NOT IN ('', '--', 'nan')").groupBy("column", "v").agg(F.min("_o").alias("o"))
    kept = top_per_group(first, ["column"], [F.col("o"), F.col("v")], top)
    return kept.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "v"))).alias("a")).select(
        "column", F.array_join(F.transform("a", lambda x: x["v"]), "、").alias("chunk")
    )


# --- retrieval ------------------------------------------------------------------------
def tfidf_index(docs: DataFrame, key: str, text: str = "text", vocab: int | None = None, stopwords=STOPWORDS) -> DataFrame:
    """``key, token, weight`` of unit-length document vectors.

    The vocabulary is every token, or with ``vocab`` only so many of the most
    frequent by documents (ties alphabetical).
    """
    words = docs.select(key, F.explode(tokens(F.col(text))).alias("token")).where(
        (F.length("token") > 1) & ~F.col("token").isin(stopwords)
    )
    tf = settle(words.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf")))
    n = docs.agg(F.count(F.lit(1))).scalar()
    top = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    if vocab is not None:
        top = top.orderBy(F.desc("df"), "token").limit(vocab)
    idf = top.withColumn("_n", n).select("token", (F.ln((F.col("_n") + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    raw = settle(tf.join(idf, "token").select(key, "token", (F.col("tf") * F.col("idf")).alias("w")))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "token", (F.col("w") / F.col("norm")).alias("weight"))


def query_vector(queries: DataFrame, index: DataFrame, query_key: str, text: str) -> DataFrame:
    """Unit vectors of query texts over the index vocabulary."""
    vocab = index.select("token").distinct()
    q = queries.select(query_key, F.explode(tokens(F.col(text))).alias("token")).join(vocab, "token", "left_semi")
    c = q.groupBy(query_key, "token").agg(F.count(F.lit(1)).alias("c"))
    norm = c.groupBy(query_key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("qn"))
    return c.join(norm, query_key).select(query_key, "token", (F.col("c") / F.col("qn")).alias("qw"))


def relevance(index: DataFrame, query: str, key: str) -> DataFrame:
    """Cosine similarity of one query text with every matching document."""
    spark = index.sparkSession
    one = spark.range(1).select(F.lit(0).alias("q"), F.lit(query).alias("text"))
    qv = query_vector(one, index, "q", "text")
    return index.join(qv, "token").groupBy(key).agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


def search(index: DataFrame, query: str, key: str, top_k: int = 8) -> DataFrame:
    hits = relevance(index, query, key).where("score > 0")
    return hits.orderBy(F.desc(F.round("score", 9)), key).limit(top_k)


# --- memory ------------------------------------------------------------------------------
def hybrid_ranking(memory: DataFrame, query: str, now: Column, top_k: int = 5, key: str = "id",
                   vocab: int | None = None) -> DataFrame:
    """Half relevance, a quarter recency, a quarter importance.

    ``memory``: id, content, importance, created_at. Relevance counts every
    word, or with ``vocab`` only so many of the most frequent.
    """
    index = tfidf_index(memory, key, "content", vocab, MEMORY_STOPWORDS)
    rel = relevance(index, query, key)
    d = memory.join(rel, key, "left").withColumn("relevance", F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)))
    d = d.withColumn("recency", recency(F.col("created_at"), now))
    d = d.withColumn("final", 0.50 * F.col("relevance") + 0.25 * F.col("recency") + 0.25 * importance_score(F.col("importance")))
    d = d.where((F.col("relevance") >= 0.01) | (F.col("final") >= 0.05))
    return d.select(key, "relevance", "recency", "final").orderBy(F.desc(F.round("final", 9)), key).limit(top_k)


def _first(text: Column, cut: int | None) -> Column:
    return text if cut is None else F.substring(text, 1, cut)


def consolidate(memory: DataFrame, recent: int = 20, need: int = 5, use: int = 5, cut: int | None = None) -> DataFrame:
    """One reflection from the latest observations, or nothing if too few; with ``cut`` so many characters of it."""
    last = memory.orderBy(F.desc("created_at"), F.desc("id")).limit(recent).where("memory_type = 'observation'")
    packed = last.agg(F.array_sort(F.collect_list(F.struct(
        (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), (-F.col("id")).alias("i"), "content"
    ))).alias("a"))
    return packed.where(F.size("a") >= need).select(
        F.lit("consolidation").alias("session_id"),
        _first(F.array_join(F.transform(F.slice("a", 1, use), lambda x: x["content"]), "; "), cut).alias("content"),
        F.lit("reflection").alias("memory_type"), F.lit(8).alias("importance"),
    )


def tag_corrections(messages: DataFrame, text: str = "text", patterns: list[str] = CORRECTIONS, cut: int | None = None) -> DataFrame:
    """Importance, tags and stored text of user messages; with ``cut`` so many characters of them."""
    hit = F.col(text).rlike("(?i)" + "|".join(patterns))
    short = _first(F.col(text), cut)
    return messages.withColumn("is_correction", hit).withColumns({
        "importance": F.when(hit, 9).otherwise(3),
        "tags": F.when(hit, F.array(F.lit("correction"), F.lit("feedback"))).otherwise(F.array().cast("array<string>")),
        "content": F.concat(F.when(hit, "USER CORRECTION: ").otherwise("User asked: "), short),
    })


def recall_corrections(memory: DataFrame, query: str, key: str = "id", by_meaning: int = 2, by_tag: int = 5,
                       vocab: int | None = None) -> DataFrame:
    """Best matches and newest tagged entries, each id once; with ``vocab`` matches by so many of the most frequent words."""
    index = tfidf_index(memory, key, "content", vocab, MEMORY_STOPWORDS)
    a = search(index, query, key, by_meaning).select(key, F.lit(0).alias("way"))
    b = memory.where(F.array_contains("tags", "correction")).orderBy(F.desc("created_at"), F.desc(key)).limit(by_tag).select(key, F.lit(1).alias("way"))
    return a.unionByName(b).groupBy(key).agg(F.min("way").alias("way"))


def recent_by(memory: DataFrame, n: int = 10, tag: str | None = None, species: str | None = None) -> DataFrame:
    """Newest entries, optionally of one tag or species."""
    d = memory
    if tag:
        d = d.where(F.array_contains("tags", tag))
    if species:
        d = d.where(F.col("species") == species)
    return d.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


# --- mentions --------------------------------------------------------------------------------
def family_mentions(docs: DataFrame, key: str, text: str = "text", families: list[str] = TF_FAMILIES) -> DataFrame:
    """Families named as whole words, plurals or transcription factors.

    The dictionary is an argument: each text is tested against literals, so
    there is no join at all.
    """
    def named(f):
        w = re.escape(f.upper().replace("-", " "))
        return F.col(text).rlike(rf"(?iU)\b{w}\b|\b{w}S\b|\b{w}\s*TRANSCRIPTION\s*FACTOR")

    hit = F.array_compact(F.array(*[F.when(named(f), F.lit(f)) for f in families]))
    return docs.select(key, F.explode(hit).alias("family"))


def metabolite_mentions(docs: DataFrame, key: str, text: str = "text",
                        names: list[str] = METABOLITE_CLASSES + SPECIFIC_METABOLITES) -> DataFrame:
    low = F.lower(F.col(text))
    return docs.select(key, F.explode(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(n)), F.lit(n)) for n in names]))).alias("metabolite"))


def metabolite_class(name: Column, classes: dict[str, str] = CLASS_OF) -> Column:
    out = name
    for k, v in classes.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def pair_strength(family: Column, cls: Column, n: Column, strong=STRONG_PAIRS, moderate=MODERATE_PAIRS) -> tuple[Column, Column]:
    """Strength and score from how well a pair is studied and the paper count."""
    pair = F.concat_ws("|", family, cls)
    is_s, is_m = pair.isin(["|".join(p) for p in strong]), pair.isin(["|".join(p) for p in moderate])
    label = F.when(is_s & (n >= 3), "strong").when(is_s | (is_m & (n >= 2)), "moderate").when(n >= 2, "moderate").otherwise("weak")
    score = F.when(is_s & (n >= 3), 0.80).when(is_s | (is_m & (n >= 2)), 0.55).when(n >= 2, 0.50).when(n >= 1, 0.30).otherwise(0.20)
    return label, score


def co_mentions(families: DataFrame, metabolites: DataFrame, key: str, classes=CLASS_OF, strong=STRONG_PAIRS,
                moderate=MODERATE_PAIRS, show: int = 3) -> DataFrame:
    """Evidence rows per family and class from papers naming both.

    Each paper holds at most one row per dictionary entry on either side.
    """
    m = metabolites.select(key, metabolite_class(F.col("metabolite"), classes).alias("class")).distinct()
    both = settle(families.distinct().join(m, key).select("family", "class", key))
    n = both.groupBy("family", "class").agg(F.count(F.lit(1)).alias("n_papers"))
    from omiclattice.operators.network import top_per_group

    first = top_per_group(both, ["family", "class"], [F.col(key)], show).groupBy("family", "class").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("papers")
    )
    label, score = pair_strength(F.col("family"), F.col("class"), F.col("n_papers"), strong, moderate)
    return n.join(first, ["family", "class"]).withColumn("strength", label).withColumn("score", score)


# --- references ---------------------------------------------------------------------------------
FIELDS = ["authors", "journal", "doi", "pmid", "url"]


def merge_references(refs: DataFrame, order: str = "pos") -> DataFrame:
    """One row per paper: DOI, else PMID, else cleaned title identify it.

    ``refs``: pos (source order), title, authors, journal, doi, pmid, url
    (blank or NULL = unknown). Later copies fill blank fields. A paper known
    only by PMID or title joins the earlier one that carries that key.
    """
    blank = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    r = refs.select(
        F.col(order).alias("pos"), blank("title").alias("title"), *[blank(f).alias(f) for f in FIELDS]
    ).where("title IS NOT NULL")
    clean = F.rtrim(F.trim(F.regexp_replace(F.lower("title"), r'[<>*/\[\]()&"]+', "")), F.lit("."))
    r = r.withColumns({"k_doi": F.lower("doi"), "k_pmid": F.col("pmid"), "k_title": F.nullif(F.substring(clean, 1, 80), F.lit(""))})
    r = r.withColumn("key", F.coalesce(F.concat(F.lit("d:"), "k_doi"), F.concat(F.lit("p:"), "k_pmid"), F.concat(F.lit("t:"), "k_title"))).where("key IS NOT NULL")

    def fold(df, by):
        first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c)
        return df.groupBy(by).agg(F.min("pos").alias("pos"), *[first(c) for c in ["title", *FIELDS, "k_doi", "k_pmid", "k_title"]])

    reps = settle(fold(r, "key"))
    keys = reps.select("key", "pos", F.explode(F.array_compact(F.array(
        F.concat(F.lit("p:"), "k_pmid"), F.concat(F.lit("t:"), "k_title"), F.col("key")
    ))).alias("k"))
    owner = keys.groupBy("k").agg(F.min_by("key", "pos").alias("root"), F.min("pos").alias("opos"))
    link = settle(reps.select("key", "pos", F.col("key").alias("k")).join(owner, "k").select(
        "key", F.when(F.col("opos") < F.col("pos"), F.col("root")).otherwise(F.col("key")).alias("root")
    ))
    # a title-only copy may hang on a PMID copy of a DOI paper: one more hop
    hop = link.select(F.col("key").alias("root"), F.col("root").alias("top"))
    final = link.join(hop, "root").select("key", "top")
    return fold(reps.join(final, "key"), "top").select("pos", "title", *FIELDS)
