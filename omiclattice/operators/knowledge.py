"""Lookups in knowledge tables: priors, orthologs, ontologies, names.

Knowledge tables (family rules, prior edges, ontology nodes, species
profiles) are inputs. They are dimension tables; whether a join broadcasts
them is left to the planner's size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from omiclattice.functions.materialise import settle
from omiclattice.functions.scalars import contained_in

# Metabolite names with a direct canonical name.
METABOLITE_SYNONYMS = {
    "berberine": "berberine_alkaloid",
    "ber": "berberine_alkaloid",
    "nicotine": "nicotine_alkaloid",
    "nic": "nicotine_alkaloid",
    "anthocyanin": "anthocyanin_flavonoid",
    "cyanidin": "anthocyanin_flavonoid",
    "delphinidin": "anthocyanin_flavonoid",
    "artemisinin": "artemisinin_terpenoid",
    "arte": "artemisinin_terpenoid",
    "kaempferol": "kaempferol_flavonoid",
    "quercetin": "quercetin_flavonoid",
    "naringenin": "naringenin_flavonoid",
    "juglone": "juglone_naphthoquinone",
    "camptothecin": "camptothecin_alkaloid",
    "vinblastine": "vinblastine_alkaloid",
}

# Class patterns tried in order when no synonym is known.
METABOLITE_PATTERNS = [
    ("isoquinoline|berberine|benzylisoquinoline", "alkaloid"),
    ("anthocyanin|flavonol|flavone|flavonoid", "flavonoid"),
    ("terpenoid|terpene|sesquiterpene", "terpenoid"),
    ("alkaloid", "alkaloid"),
    ("lignin|lignan", "lignin"),
    ("phenolic|phenylpropanoid", "phenylpropanoid"),
]

# Gene id formats in matching order.
ID_FORMATS = [
    ("evm", r"evm\.\S+"),
    ("maker", r"maker\S+"),
    ("trinity", r"TRINITY_\S+"),
    ("refseq", r"(NM_|XM_|NP_|XP_)\d+"),
    ("ensembl", r"(ENS\w+G\d+)"),
    ("arabidopsis", r"AT\wG\d+"),
    ("generic", r"\w+"),
]

# Locus id formats in matching order.
LOCUS_FORMATS = [
    ("rapdb", r"^Os\d{2}g\d{7}$"),
    ("msu", r"^LOC_Os\d{2}g\d{5,6}$"),
    ("tair", r"^AT[1-5MC]G\d{5}(\.[0-9]+)?$"),
    ("ncbi_gene", r"^\d{4,}$"),
    ("ensembl_plant", r"^(Zm|Solyc|Glyma\.|Bradi|GSVIV|Sobic|Traes|GRMZM|AC|evm\.)\w+$"),
]

# Families looked for in gene symbols.
SYMBOL_FAMILIES = [
    "NAC", "WRKY", "MYB", "BHLH", "ERF", "BZIP", "WD40", "AP2",
    "DREB", "HD-ZIP", "TCP", "GRAS", "SPL", "ARF", "GATA", "DOF", "NF-Y",
    "MADS", "HSF", "LOB", "C2H2", "Trihelix",
]


# --- names and ids ---------------------------------------------------------------
def normalise_metabolite(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"[_\- ]+", "_")


def map_metabolite(name: Column, synonyms=METABOLITE_SYNONYMS, patterns=METABOLITE_PATTERNS) -> dict[str, Column]:
    """Canonical name and how it was found (synonym, pattern, raw)."""
    norm = normalise_metabolite(name)
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    syn = F.get(F.array(table[norm]), F.lit(0))
    by_pattern, kind = norm, F.lit("raw")
    for rx, cls in reversed(patterns):
        hit = norm.rlike("(?i)" + rx)
        named = F.when(F.contains(norm, F.lit(cls)), norm).otherwise(F.concat_ws("_", norm, F.lit(cls)))
        by_pattern = F.when(hit, named).otherwise(by_pattern)
        kind = F.when(hit, F.lit(f"pattern:{cls}")).otherwise(kind)
    return {
        "canonical": F.coalesce(syn, by_pattern),
        "mapping": F.when(syn.isNotNull(), F.concat(F.lit("synonym:"), syn)).otherwise(kind),
    }


def map_species(names: DataFrame, species: str, table: DataFrame) -> DataFrame:
    """Canonical species with confidence 1.0, raw name with 0.5 otherwise.

    ``table``: alias, canonical.
    """
    key = F.replace(F.lower(F.trim(species)), F.lit("-"), F.lit("_"))
    t = table.select(F.lower("alias").alias("_k"), "canonical")
    return names.withColumn("_k", key).join(t, "_k", "left").select(
        *names.columns, F.coalesce("canonical", "_k").alias("canonical"),
        F.when(F.col("canonical").isNotNull(), 1.0).otherwise(0.5).alias("confidence"),
    )


def synonym_key(term: Column) -> Column:
    out = F.lower(F.trim(term))
    out = F.replace(F.replace(out, F.lit("β-"), F.lit("beta_")), F.lit("β"), F.lit("beta"))
    return F.replace(F.replace(out, F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))


def id_format(gene: Column, formats=ID_FORMATS) -> Column:
    out = F.lit("unknown")
    for name, rx in reversed(formats):
        out = F.when(gene.rlike("(?i)^(?:" + rx + ")"), F.lit(name)).otherwise(out)
    return out


def locus_format(gene: Column) -> Column:
    g = F.trim(gene)
    out = F.when(F.coalesce(g, F.lit("")) == "", F.lit("unknown")).otherwise(F.lit("symbol"))
    for name, rx in reversed(LOCUS_FORMATS):
        out = F.when(g.rlike("(?i)" + rx), F.lit(name)).otherwise(out)
    return out


def fix_prefix(gene: Column) -> Column:
    """GENE_ in front of ids that start with a digit."""
    return F.when(gene.rlike(r"^\d"), F.concat(F.lit("GENE_"), gene)).otherwise(gene)


def duplicate_ids(df: DataFrame, gene: str = "feature_id") -> DataFrame:
    """Ids that clash when case is ignored."""
    return df.groupBy(F.lower(gene).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def symbol_family(text: Column, families=SYMBOL_FAMILIES) -> Column:
    """Longest family name in a text that stands at a name boundary.

    Before it: the start, or a non-upper-case letter within three characters;
    after it: no letter.
    """
    out = F.lit("")
    ordered = sorted(enumerate(families), key=lambda x: (-len(x[1]), x[0]))
    for _, fam in reversed(ordered):
        up = F.upper(text)
        at = F.instr(up, F.lit(fam.upper()))
        before = F.when(at > 1, F.substring(text, F.greatest(at - 3, F.lit(1)), F.least(at - 1, F.lit(3)))).otherwise("")
        ok_before = (at == 1) | before.rlike(r"[^A-Z]")
        after = F.substring(text, at + len(fam), F.lit(1))
        ok = (at > 0) & ok_before & ~after.rlike(r"\p{L}")
        out = F.when(ok, F.lit(fam)).otherwise(out)
    return out


def alias_score(alias: Column) -> Column:
    """How readable a gene alias is; sentences and placeholders lose."""
    digits = F.length(F.regexp_replace(alias, r"[^0-9]", ""))
    low = F.lower(alias)
    bad = (
        (F.length(alias) > 30) | F.contains(alias, F.lit(" ")) | low.startswith("domain-containing")
        | low.isin("protein", "putative", "uncharacterized", "predicted")
    )
    pts = lambda cond, v: F.when(cond, v).otherwise(0)
    s = (
        pts(alias.rlike("^(LOC|OsJ_)"), -10) + pts(digits > 3, -5) + pts(alias.rlike("[A-Za-z]"), 3)
        + pts(alias.rlike("^(Os|AT|Zm|GRMZM|Solyc|Glyma)"), 2) + pts(symbol_family(alias) != "", 5)
        + pts((F.length(alias) >= 3) & (F.length(alias) <= 12), 2)
    )
    return F.when(bad, -1000).otherwise(s)


def best_alias(aliases: DataFrame) -> DataFrame:
    """Best alias per gene (``gene_id, alias, pos``); earlier wins ties."""
    scored = aliases.withColumn("score", alias_score(F.col("alias")))
    return scored.groupBy("gene_id").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "pos", "alias")).alias("b")
    ).select("gene_id", F.col("b.alias").alias("alias"), (-F.col("b.neg")).alias("score"))


# --- annotation search -----------------------------------------------------------------
def annotation_tokens(ann: DataFrame) -> DataFrame:
    """``token, gene_id`` index of annotation terms (tokens of two letters up)."""
    return (
        ann.select("gene_id", F.explode(F.split(F.lower("term"), r"[|;\s]+")).alias("token"))
        .where(F.length("token") >= 2).distinct()
    )


def search_annotation(ann: DataFrame, keywords: list[str]) -> DataFrame:
    """Genes whose annotation contains a keyword (any case).

    The keyword list is an argument, so each row is tested once against
    literals; nothing is joined.
    """
    low = F.lower("term")
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in keywords]))
    return ann.select("gene_id", F.explode(hits).alias("keyword")).distinct()


def resolve_ids(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Ids found as written, else without the part after the last dot."""
    k = known.select("feature_id").distinct()
    base = F.regexp_replace("hit", r"\.[^.]*$", "")
    a = k.select(F.col("feature_id").alias("hit"), F.col("feature_id").alias("exact"))
    b = k.select(F.col("feature_id").alias("_base"), F.col("feature_id").alias("stripped"))
    return hits.join(a, "hit", "left").withColumn("_base", base).join(b, "_base", "left").select(
        *hits.columns, F.coalesce("exact", "stripped").alias("feature_id")
    ).where("feature_id IS NOT NULL")


def tf_membership(genes: DataFrame, classified: DataFrame, domains: DataFrame, name_pattern: str) -> DataFrame:
    """TF score: 0.8 classified, 0.7 by domain, else 0.5 by name."""
    c = classified.select("gene_id").distinct().withColumn("_c", F.lit(0.8))
    d = domains.select("gene_id", "hits").withColumn("_d", F.lit(0.7))
    j = genes.join(c, "gene_id", "left").join(d, "gene_id", "left")
    strong = F.greatest("_c", "_d")
    return j.withColumn(
        "score", F.coalesce(strong, F.when(F.col("gene_id").rlike(name_pattern), 0.5))
    ).where("score IS NOT NULL").select("gene_id", "score", F.coalesce("hits", F.lit(0)).alias("domain_hits"))


# --- priors ---------------------------------------------------------------------------------
def _contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def prior_lookup(queries: DataFrame, prior: DataFrame) -> DataFrame:
    """Prior score per query (``family, target``) with ranked fallback.

    Tier 1: class and target contain one another (first such edge by ``pos``);
    tier 2: a word of one in the other, best score; tier 3: half of the
    family's best. ``prior``: family, metabolite_class, score, pos. The join
    is on the family; a query meets only its own family's edges.
    """
    q = queries.withColumn("_t", F.lower(F.trim("target"))).withColumn("_f", F.lower(F.replace("family", F.lit("/"), F.lit("-"))))
    p = prior.select(
        F.lower(F.replace("family", F.lit("/"), F.lit("-"))).alias("_f"), "metabolite_class", F.col("score").alias("ps"), "pos"
    )
    j = q.join(p, "_f")
    cls = F.col("metabolite_class")
    words = F.exists(F.split(cls, "_"), lambda w: F.contains(F.col("_t"), w)) | F.exists(
        F.split(F.col("_t"), r"\s+"), lambda w: (w != "") & F.contains(cls, w)
    )
    tier = F.when(_contains_either(cls, F.col("_t")), 1).when(words, 2).otherwise(3)
    j = j.withColumn("tier", tier)
    # within tier 1 the first edge wins, in tiers 2 and 3 the best score
    key = F.struct(
        "tier", F.when(F.col("tier") == 1, F.col("pos").cast("double")).otherwise(-F.col("ps")).alias("o"), "pos",
        "metabolite_class", "ps",
    )
    best = j.groupBy("family", "target").agg(F.min(key).alias("b"))
    return best.select(
        "family", "target", F.when(F.col("b.tier") == 3, "general").otherwise(F.col("b.metabolite_class")).alias("matched"),
        F.when(F.col("b.tier") == 3, F.col("b.ps") * 0.5).otherwise(F.col("b.ps")).alias("score"), F.col("b.tier").alias("tier"),
    )


def inherited_prior(queries: DataFrame, prior: DataFrame, closure: DataFrame) -> DataFrame:
    """Best prior score of a target or its ancestors (only inheritable edges).

    ``prior``: family, target, score, inheritable; ``closure``: node,
    ancestor, depth.
    """
    own = queries.select("family", "target", F.col("target").alias("at"), F.lit(0).alias("depth"))
    up = queries.join(closure, F.col("target") == F.col("node")).select("family", "target", F.col("ancestor").alias("at"), "depth")
    p = prior.select("family", F.col("target").alias("at"), "score", "inheritable")
    hit = own.unionByName(up).join(p, ["family", "at"]).where((F.col("depth") == 0) | F.col("inheritable"))
    return hit.groupBy("family", "target").agg(
        F.min(F.struct((-F.col("score")).alias("n"), "depth", "at")).alias("b")
    ).select("family", "target", (-F.col("b.n")).alias("score"), F.col("b.at").alias("matched"), F.col("b.depth").alias("depth"))


def query_priors(prior: DataFrame, metabolite: str = "", family: str = "", species: str = "",
                 min_score: float = 0.0, resolved_class: str = "") -> DataFrame:
    """Prior edges filtered by family, metabolite, species scope and score.

    An edge of another species stays only when it is strong.
    """
    has = lambda col, text: F.contains(F.lower(col), F.lit(text))
    out = prior.where(F.col("score") >= min_score)
    f, m, s = family.lower().strip(), metabolite.lower().strip(), species.lower().strip()
    if f:
        out = out.where(has("tf_family", f))
    if m:
        hit = has("metabolite_class", m) | has("specific_metabolite", m) | has("description", m)
        if resolved_class:
            hit = hit | has("metabolite_class", resolved_class)
        out = out.where(hit)
    if s:
        out = out.where((F.col("species_scope") == "general") | has("species_scope", s) | (F.col("strength") == "strong"))
    return out


def families_by_score(prior: DataFrame) -> DataFrame:
    return prior.groupBy("tf_family").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "tf_family")


def ortholog_prior(score: Column, matched: Column, has_ortholog: Column, identity: Column) -> Column:
    """Model-species prior: half when the pathway differs, scaled by identity."""
    factor = F.when(has_ortholog == F.lit(False), 0.5).when(
        has_ortholog & identity.isNotNull(),
        F.when(identity >= 70, 1.0).when(identity >= 50, 0.8).otherwise(0.6),
    ).otherwise(1.0)
    return F.when(matched, F.least(score * factor, F.lit(1.0))).otherwise(score * 0.5)


def ortholog_map(genes: DataFrame, curated: DataFrame, families: list[str]) -> DataFrame:
    """Curated partner, else the first enzyme family in the gene name."""
    low = F.lower("gene_id")
    fam = F.coalesce(*[F.when(F.contains(low, F.lit(f.lower())), F.lit(f)) for f in families])
    return genes.join(curated, "gene_id", "left").select(
        "gene_id", F.coalesce("ortholog", fam).alias("ortholog"),
        F.when(F.col("ortholog").isNotNull(), "curated").when(fam.isNotNull(), "family").alias("source"),
    ).where("ortholog IS NOT NULL")


def species_knowledge(queries: DataFrame, profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """Profile answer, else ortholog rule, else an explicit gap, with the level.

    ``queries``: species, metabolite; ``profiles``: species, metabolite,
    answer; ``rules``: metabolite, rule.
    """
    has_profile = profiles.select("species").distinct().withColumn("_p", F.lit(True))
    j = (
        queries.join(has_profile, "species", "left").join(profiles, ["species", "metabolite"], "left")
        .join(rules, "metabolite", "left")
    )
    return j.select(
        "species", "metabolite", F.when(F.col("_p"), F.col("answer")).otherwise(F.col("rule")).alias("answer"),
        F.when(F.col("_p"), "profile").when(F.col("rule").isNotNull(), "ortholog").otherwise("gap").alias("level"),
    )


def shared_families(a: DataFrame, b: DataFrame) -> DataFrame:
    """Families known in both species (set intersection)."""
    return a.select("family").intersect(b.select("family"))


def clean_references(refs: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Keep PMIDs that were really retrieved and recognised database refs.

    ``refs``: ref_id, ref. Returns ref_id, kept, ref.
    """
    pmid = F.regexp_extract(F.trim("ref"), r"^PMID[:\s]*(\d{4,9})$", 1)
    usable = refs.where(F.length(F.trim("ref")) >= 2).withColumn("pmid", F.nullif(pmid, F.lit("")))
    got = retrieved.select(F.col("pmid").cast("string").alias("pmid")).distinct().withColumn("_ok", F.lit(True))
    other = F.col("ref").rlike("药典|NCBI|Taxonomy")
    return usable.join(got, "pmid", "left").select(
        "ref_id", F.when(F.col("pmid").isNotNull(), F.coalesce("_ok", F.lit(False))).otherwise(other).alias("kept"),
        F.when(F.col("pmid").isNotNull(), F.concat(F.lit("PMID: "), "pmid")).otherwise(F.col("ref")).alias("ref"),
    )


def pathway_lookup(names: DataFrame, pathways: DataFrame, class_words: list[tuple[str, str]]) -> DataFrame:
    """Pathway per compound: exact key, key inside the name, class keyword.

    ``pathways``: key, pathway_id; keys found inside a name come from the
    name's own tokens, so no compound meets every key.
    """
    k = names.select("name", F.regexp_replace(F.lower(F.trim("name")), r"[\- ]", "_").alias("key"))
    parts = F.split("key", "_")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.transform(
        F.sequence(i, F.size(parts)), lambda j: F.array_join(F.slice(parts, i, j - i + 1), "_")
    )))
    cand = k.select("name", F.explode(F.array_distinct(F.concat(F.array("key"), runs))).alias("key"), F.col("key").alias("full"))
    direct = cand.select("name", "key", F.when(F.col("key") == F.col("full"), 1).otherwise(2).alias("tier"))
    word = F.coalesce(*[F.when(F.contains(F.col("key"), F.lit(w)), F.lit(ref)) for w, ref in class_words])
    fallback = k.select("name", word.alias("key"), F.lit(3).alias("tier")).where("key IS NOT NULL")
    hit = direct.unionByName(fallback).join(pathways, "key")
    return hit.groupBy("name").agg(F.min(F.struct("tier", (-F.length("key")).alias("l"), "key", "pathway_id")).alias("b")).select(
        "name", F.col("b.key").alias("key"), F.col("b.pathway_id").alias("pathway_id"), F.col("b.tier").alias("tier")
    )


def pathway_evidence(n_pathways: Column) -> Column:
    return F.least(n_pathways / 5.0, F.lit(1.0))


def resolve_terms(terms: DataFrame, synonyms: DataFrame, pathway_aliases: DataFrame, families: DataFrame) -> DataFrame:
    """Node per term: pathway words first, then synonym, pathway, family, fuzzy.

    ``synonyms``: alias, canonical; ``pathway_aliases``: alias, node;
    ``families``: family. A fuzzy match is a term that is part of an alias.
    """
    t = settle(terms.select("term").distinct().withColumn("_k", synonym_key(F.col("term"))).withColumn("_u", F.upper(F.trim("term"))))
    syn = synonyms.select(synonym_key(F.col("alias")).alias("_k"), F.col("canonical").alias("syn")).groupBy("_k").agg(F.min("syn").alias("syn"))
    pw = pathway_aliases.select(synonym_key(F.col("alias")).alias("_k"), F.col("node").alias("pw")).groupBy("_k").agg(F.min("pw").alias("pw"))
    fam = families.select(F.upper("family").alias("_u")).distinct().withColumn("fam", F.col("_u"))
    hay = synonyms.select(synonym_key(F.col("alias")).alias("_text"), "canonical")
    fuzzy = contained_in(t.select("term", "_k"), "_k", hay, "_text").groupBy("term").agg(F.min("canonical").alias("fuzzy"))
    j = t.join(syn, "_k", "left").join(pw, "_k", "left").join(fam, "_u", "left").join(fuzzy, "term", "left")
    is_path = F.lower("term").rlike("biosynthesis|pathway|metabolism") & F.col("pw").isNotNull()
    kind = (
        F.when(is_path, "pathway").when(F.col("syn").isNotNull(), "metabolite").when(F.col("pw").isNotNull(), "pathway")
        .when(F.col("fam").isNotNull(), "tf_family").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("unknown")
    )
    node = F.when(is_path, F.col("pw")).otherwise(F.coalesce("syn", "pw", "fam", "fuzzy", "term"))
    return j.select("term", kind.alias("node_type"), node.alias("node"))


def expand_query(queries: DataFrame, synonyms: DataFrame, most: int | None = None) -> DataFrame:
    """Gene words replaced by (id OR synonym ...); words keep their order.

    ``queries``: query_id, text; ``synonyms``: gene, synonym. With ``most`` only so
    many synonyms, in name order, are added per gene.
    """
    w = queries.select("query_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "word"))
    rk = W.partitionBy("gene").orderBy("synonym")
    if most is not None:
        synonyms = synonyms.withColumn("rn", F.row_number().over(rk)).where(F.col("rn") <= most)
    syn = synonyms.groupBy("gene").agg(
        F.array_sort(F.collect_list("synonym")).alias("syn")
    )
    j = w.join(syn, F.lower("word") == F.lower("gene"), "left")
    text = F.when(F.col("syn").isNull(), F.col("word")).otherwise(
        F.concat(F.lit("("), F.array_join(F.concat(F.array("word"), "syn"), " OR "), F.lit(")"))
    )
    return j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))).alias("a")).select(
        "query_id", F.array_join(F.transform("a", lambda x: x["t"]), " ").alias("expanded")
    )
