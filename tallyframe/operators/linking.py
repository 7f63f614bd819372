"""Linking mentions of one thing across files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.similarity import jaccard, similarity
from tallyframe.operators.graph import star_components

#: Weights of name, formula, meaning and archetype; least score; mentions of a file; size of a cluster.
WEIGHTS, THRESHOLD, MENTIONS_PER_FILE, LARGEST_CLUSTER = (0.40, 0.25, 0.25, 0.10), 0.60, 50, 100
#: Terms that mean the same.
SYNONYMS = (
    ("revenue", "net sales", "sales revenue", "turnover", "net revenue", "gross revenue", "total revenue"),
    ("cost of sales", "cost of goods sold", "cogs", "cost of revenue"),
    ("sg&a", "selling general and administrative", "operating expenses", "opex"),
    ("additional paid-in capital", "apic", "share premium", "capital surplus"),
    ("treasury stock", "treasury shares", "own shares held"),
    ("accounts receivable", "trade receivables", "trade and other receivables", "a/r", "ar"),
    ("accounts payable", "trade payables", "trade and other payables", "a/p", "ap"),
    ("retained earnings", "accumulated profits", "revenue reserves"),
    ("goodwill", "goodwill on acquisition"),
    ("inventory", "inventories", "stock", "merchandise"),
    ("property plant and equipment", "ppe", "fixed assets", "tangible assets"),
    ("intangible assets", "intangibles"),
    ("depreciation", "depreciation expense", "depreciation and amortisation", "d&a"),
    ("amortization", "amortisation", "amortization expense"),
    ("cecl", "current expected credit loss", "expected credit loss", "ecl", "allowance for credit losses"),
    ("right-of-use asset", "rou asset", "lease asset", "operating lease rou"),
    ("lease liability", "operating lease liability", "finance lease liability"),
    ("cash and cash equivalents", "cash", "cash & equivalents", "liquid assets"),
    ("operating cash flow", "cash from operations", "cfo"),
    ("income tax expense", "tax expense", "provision for income taxes", "tax provision"),
    ("deferred tax asset", "dta", "deferred tax"),
    ("deferred tax liability", "dtl"),
    ("common stock", "ordinary shares", "share capital", "capital stock"),
    ("preferred stock", "preference shares"),
    ("intercompany receivable", "ic receivable", "due from affiliate", "due from related party"),
    ("intercompany payable", "ic payable", "due to affiliate", "due to related party"),
    ("net income", "net profit", "profit for the period", "net earnings", "bottom line"),
    ("gross profit", "gross margin"),
    ("operating income", "operating profit", "ebit"),
    ("ebitda", "earnings before interest taxes depreciation amortization"),
)
#: Archetypes by group, and scores of pairs of groups.
GROUPS = {"finance": ("Financial Report", "Financial Statement", "Budget", "Forecast", "Consolidation"), "data": ("Data Extract", "Data Export", "Database Extract"), "model": ("Model/Template", "Template", "Calculation Model"), "reporting": ("Dashboard", "Report", "Analysis")}
GROUP_SCORES = {("finance", "reporting"): 0.7, ("finance", "model"): 0.6, ("model", "reporting"): 0.5}
#: Words that say nothing in long names, and words that tell of a domain.
STOP_WORDS = (
    "the", "a", "an", "of", "for", "in", "on", "to", "and", "or", "is", "are", "was", "by", "from", "with", "as", "at",
    "this", "that", "it", "its", "calculate", "calculates", "calculated", "calculation", "calculations", "compute", "computes", "computed", "determine", "determines", "determined", "value", "values", "data",
    "based", "used", "using",
)
DOMAINS = {
    "revenue": ("revenue", "sales", "income", "turnover", "top_line"),
    "expense": ("expense", "cost", "spend", "opex", "cogs", "overhead"),
    "balance": ("balance", "asset", "liability", "equity", "net_worth"),
    "margin": ("margin", "gross_margin", "net_margin", "ebitda", "profit"),
    "account": ("account", "acct", "gl_", "ledger", "chart_of_accounts", "coa"),
    "tax": ("tax", "vat", "gst", "withholding"),
    "intercompany": ("interco", "intercompany", "elimination", "consolidation"),
    "headcount": ("headcount", "fte", "employee", "personnel", "salary", "wage"),
}


def normalized_name(c: Column) -> Column:
    """Lower case, runs of other than letters and digits as one underscore, none outside."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _synonym_set(c: Column) -> Column:
    terms = [(t, i) for i, same in enumerate(SYNONYMS) for t in same]
    return F.try_element_at(F.create_map(*[F.lit(x) for p in terms for x in p]), F.lower(F.trim(c)))


def synonym_score(a: Column, b: Column) -> Column:
    """1 for equal terms (case and outer blanks aside) and for terms of one set, else 0."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(_synonym_set(a) == _synonym_set(b), 1.0).otherwise(0.0)


def _group(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for g, names in GROUPS.items() for n in names for x in (n, g)]), c), F.lit("unknown"))


def archetype_score(a: Column, b: Column) -> Column:
    x, y = _group(a), _group(b)
    pair = F.concat_ws("|", F.array_sort(F.array(x, y)))
    score = F.when(x == y, 1.0)
    for (p, q), v in GROUP_SCORES.items():
        score = score.when(pair == "|".join(sorted((p, q))), v)
    return score.when((x == "unknown") | (y == "unknown"), 0.3).otherwise(0.1)


def name_score(raw_a: Column, norm_a: Column, raw_b: Column, norm_b: Column) -> Column:
    """The better of character similarity and synonymy; long names that are
    sentences compare by their words at four fifths."""
    long = lambda n: (F.size(F.split(n, "_")) > 5) & (F.length(n) > 40)
    words = lambda n: F.array_except(F.array_distinct(F.split(n, "_")), F.array(*map(F.lit, STOP_WORDS)))
    wa, wb = words(norm_a), words(norm_b)
    spaced = lambda n: F.translate(n, "_", " ")
    syn = F.greatest(synonym_score(raw_a, raw_b), synonym_score(spaced(norm_a), spaced(norm_b)))
    return F.when((F.coalesce(norm_a, F.lit("")) == "") | (F.coalesce(norm_b, F.lit("")) == ""), 0.0).when(long(norm_a) | long(norm_b), F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(jaccard(wa, wb) * 0.8)).otherwise(F.greatest(similarity(norm_a, norm_b), syn))


def _texts(a: Column, b: Column) -> Column:
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(similarity(a, b))


def capped_mentions(mentions: DataFrame, most: int | None = MENTIONS_PER_FILE) -> DataFrame:
    """The first ``most`` mentions of each file by ``pos``; all for None."""
    if most is None:
        return mentions
    return mentions.withColumn("__r", F.row_number().over(Window.partitionBy("file_path").orderBy("pos", "mention_id"))).where(F.col("__r") <= most).drop("__r")


def _block_keys() -> Column:
    """What two mentions must share to be compared: a word of the name, a synonym
    set, a word of the meaning, or the formula's shape.  Pairs that share none of
    these but are spelled alike are found only without blocks."""
    words = F.transform(F.filter(F.array_distinct(F.split("normalized_name", "_")), lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)), lambda w: F.concat(F.lit("w"), w))
    syn = F.concat(F.lit("s"), F.coalesce(_synonym_set(F.col("raw_name")), _synonym_set(F.translate("normalized_name", "_", " "))).cast("string"))
    shape = F.concat(F.lit("f"), F.nullif(F.regexp_replace("formula", r"[A-Z]+\d+(?::[A-Z]+\d+)?", "REF"), F.lit("")))
    meant = F.transform(F.filter(F.array_distinct(F.split(F.lower(F.coalesce("business_meaning", F.lit(""))), "[^a-z0-9]+")), lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS)), lambda w: F.concat(F.lit("m"), w))
    return F.array_compact(F.concat(words, meant, F.array(syn, shape)))


def link_pairs(mentions: DataFrame, threshold: float = THRESHOLD, blocked: bool = True) -> DataFrame:
    """(mention_a_id, mention_b_id, composite_score and its four parts) of pairs
    of different files; the file earlier by name is a.  ``blocked`` compares only
    mentions that share a word, synonym or formula shape; without it every pair
    of files is compared whole, for sets of capped mentions."""
    m = mentions.select("mention_id", "file_path", "archetype", "raw_name", F.coalesce("normalized_name", normalized_name(F.col("raw_name"))).alias("normalized_name"), "formula", "business_meaning")
    keyed = m.select("mention_id", "file_path", F.explode(_block_keys()).alias("k"))
    a, b = (keyed.select("k", F.col("mention_id").alias(f"mention_{x}_id"), F.col("file_path").alias(f"f{x}")) for x in "ab")
    if blocked:
        met = a.join(b, "k").where("fa < fb").select("mention_a_id", "mention_b_id").distinct()
    else:
        one, other = (m.select(F.col("mention_id").alias(f"mention_{x}_id"), F.col("file_path").alias(f"f{x}")) for x in "ab")
        met = one.join(other, F.col("fa") < F.col("fb")).select("mention_a_id", "mention_b_id")
    ra, rb = (m.select(F.col("mention_id").alias(f"mention_{x}_id"), F.struct("archetype", "raw_name", "normalized_name", "formula", "business_meaning").alias(x)) for x in "ab")
    j = met.join(ra, "mention_a_id").join(rb, "mention_b_id")
    c = F.col
    parts = j.select(
        "mention_a_id", "mention_b_id", name_score(c("a.raw_name"), c("a.normalized_name"), c("b.raw_name"), c("b.normalized_name")).alias("name_similarity"), _texts(c("a.formula"), c("b.formula")).alias("formula_similarity"),
        _texts(F.lower("a.business_meaning"), F.lower("b.business_meaning")).alias("business_meaning"), archetype_score(c("a.archetype"), c("b.archetype")).alias("archetype_compatibility"),
    )
    total = sum((F.col(n) * w for n, w in zip(("name_similarity", "formula_similarity", "business_meaning", "archetype_compatibility"), WEIGHTS, strict=True)), F.lit(0.0))
    return parts.withColumn("composite_score", F.round(total, 4)).where(F.col("composite_score") >= threshold)


def clusters(mentions: DataFrame, links: DataFrame, largest: int = LARGEST_CLUSTER, drop_larger: bool = False) -> DataFrame:
    """cluster_id, canonical_name, domain, n_mentions, n_files, avg_score, the
    conflicts found (formula_mismatch, sign_reversal) and over_limit of the
    connected groups; groups of more than ``largest`` mentions are marked so, or
    left out if asked.  The canonical name is that of the first mention
    of the best link (ties: shorter, then lesser name).  The id is a hash of the
    least member."""
    comp = star_components(links.select(F.col("mention_a_id").alias("u"), F.col("mention_b_id").alias("v")))
    member = mentions.join(comp.withColumnRenamed("vertex", "mention_id"), "mention_id")
    text = F.concat_ws(" ", "normalized_name", F.lower("business_meaning"))
    flags = {(d, i): F.max(F.coalesce(text.contains(w), F.lit(False))).alias(f"d_{d}_{i}") for d, words in DOMAINS.items() for i, w in enumerate(words)}
    shape = F.regexp_replace("formula", r"[A-Z]+\d+(?::[A-Z]+\d+)?", "REF")
    stats = member.groupBy("label").agg(
        F.count("*").alias("n_mentions"), F.count_distinct("file_path").alias("n_files"), *flags.values(), F.count_distinct(F.when(F.col("formula") != "", shape)).alias("shapes"),
        F.max(F.coalesce(F.upper("formula").contains("SUM"), F.lit(False))).alias("adds"), F.max(F.coalesce(F.col("formula").startswith("-"), F.lit(False)) | F.coalesce(F.upper("business_meaning").contains("SUBTRACT"), F.lit(False))).alias("subtracts"),
    )
    score = {d: sum((F.col(f"d_{d}_{i}").cast("int") for i in range(len(words))), F.lit(0)) for d, words in DOMAINS.items()}
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, (d, s) in enumerate(score.items())]))
    domain = F.when(best["s"] > 0, best["d"]).otherwise("general")
    names = mentions.select(F.col("mention_id").alias("mention_a_id"), "raw_name")
    scored = links.join(comp.select(F.col("vertex").alias("mention_a_id"), "label"), "mention_a_id").join(names, "mention_a_id")
    canon = scored.groupBy("label").agg(F.max_by("raw_name", F.struct("composite_score", -F.length("raw_name"), F.sha2("raw_name", 256))).alias("canonical_name"), F.round(F.avg("composite_score"), 4).alias("avg_score"), F.count("*").alias("n_links"))
    kept = stats.where(F.col("n_mentions") <= largest) if drop_larger else stats
    return kept.join(canon, "label").select(
        F.concat(F.lit("cluster_"), F.substring(F.sha2("label", 256), 1, 12)).alias("cluster_id"), "label", "canonical_name", domain.alias("domain"), "n_mentions", "n_files", "n_links", "avg_score",
        F.array_compact(F.array(F.when(F.col("shapes") > 1, "formula_mismatch"), F.when(F.col("adds") & F.col("subtracts"), "sign_reversal"))).alias("conflicts"),
        (F.col("n_mentions") > largest).alias("over_limit"),
    )


def cluster_members(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """label, mention_id, raw_name, file_path of every linked mention."""
    comp = star_components(links.select(F.col("mention_a_id").alias("u"), F.col("mention_b_id").alias("v")))
    return comp.withColumnRenamed("vertex", "mention_id").join(mentions, "mention_id").select("label", "mention_id", "raw_name", "file_path")


def entity_map(cluster_rows: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters with their members as an array (by id), the largest first, then by name."""
    m = members.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("mention_id", "raw_name", "file_path"))).alias("mentions"))
    return cluster_rows.join(m, "label").orderBy(F.desc("n_mentions"), "canonical_name", "cluster_id")


def cluster_by_id(cluster_rows: DataFrame, cluster_id: str) -> DataFrame:
    """The cluster of that id; no row for none."""
    return cluster_rows.where(F.col("cluster_id") == cluster_id)


def find_entity(cluster_rows: DataFrame, member_names: DataFrame, query: str, top: int = 5, least: float = 0.3) -> DataFrame:
    """The ``top`` clusters whose canonical or members' names (label, raw_name) are most like ``query``."""
    names = cluster_rows.select("label", F.col("canonical_name").alias("raw_name")).unionByName(member_names.select("label", "raw_name"))
    s = names.where("raw_name is not null").withColumn("score", similarity(F.lower(F.lit(query)), F.lower("raw_name"))).groupBy("label").agg(F.max("score").alias("score")).where(F.col("score") > least)
    return cluster_rows.join(s, "label").orderBy(F.desc("score"), "canonical_name").limit(top)


#: Beginnings of accounting terms that name something in a text.
TERMS = r"total\s+\w|net\s+\w|gross\s+\w|operating\s+\w|capital\s+\w|cash\s+flow|ebitda|revenue|cost\s+of\s+\w|depreciation|amortization|interest\s+\w|retained\s+earnings|working\s+capital|accounts\s+[rp]\w|profit\s+\w|loss\s+\w|margin|variance|budget|forecast"


def names_in(text: Column) -> Column:
    """Names that a text mentions, in this order: quoted, with underscores, in
    CamelCase, and accounting terms with the words after them (without trailing
    small words, over three letters)."""
    quoted = F.regexp_extract_all(text, F.lit('"([^"]{2,50})"'), F.lit(1))
    snake = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)\b"), F.lit(1))
    camel = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"), F.lit(1))
    terms = F.regexp_extract_all(text, F.lit(rf"(?i)\b((?:{TERMS})[\w\s]{{0,28}})"), F.lit(1))
    trimmed = F.filter(F.transform(terms, lambda t: F.regexp_replace(F.trim(t), r"(?i)\s+(is|are|was|for|the|of|in|and|or)\s*$", "")), lambda t: F.length(t) > 3)
    return F.concat(F.transform(quoted, F.trim), snake, camel, trimmed)


def mentions_from_dna(documents: DataFrame, most: int | None = None) -> DataFrame:
    """Mentions in formula descriptions: documents with file_path, archetype and
    formula_intents (cell_ref, raw_formula, business_meaning), and cross_references
    (relationship, source_cell, target_cell) if there.  A meaning that names
    nothing stands for itself if short, else its first clause does."""
    doc = documents.withColumns({c: F.lit(None).cast("string") for c in ("file_path", "archetype") if c not in documents.columns})
    base = doc.select("file_path", "archetype", F.posexplode("formula_intents").alias("pos", "x"))
    meaning = F.col("x.business_meaning")
    fallback = F.when(F.length(meaning) <= 120, meaning).otherwise(F.regexp_extract(meaning, r"^[^.,;:]+", 0))
    found = F.when(F.size(names_in(meaning)) > 0, names_in(meaning)).otherwise(F.array(fallback))
    m = base.select("file_path", "archetype", "pos", F.posexplode_outer(found).alias("k", "raw_name"), F.col("x.cell_ref").alias("cell_ref"), F.col("x.raw_formula").alias("formula"), meaning.alias("business_meaning"), F.lit("formula_intent").alias("source_type"))
    if "cross_references" in documents.columns:
        c = doc.select("file_path", "archetype", F.posexplode("cross_references").alias("pos", "x"))
        m = m.unionByName(c.select("file_path", "archetype", (F.col("pos") + 1_000_000).alias("pos"), F.posexplode(names_in(F.col("x.relationship"))).alias("k", "raw_name"), F.col("x.source_cell").alias("cell_ref"), F.lit("").alias("formula"), F.col("x.relationship").alias("business_meaning"), F.lit("cross_reference").alias("source_type")))
    m = m.where("length(raw_name) > 3 and length(raw_name) <= 150").withColumn("pos", F.col("pos") * 1000 + F.col("k")).drop("k")
    key = F.concat_ws("\u0001", "file_path", F.col("pos").cast("string"), "raw_name", "cell_ref")
    return capped_mentions(m.withColumn("mention_id", F.concat(F.lit("mention_"), F.substring(F.sha2(key, 256), 1, 12))).withColumn("normalized_name", normalized_name(F.col("raw_name"))), most)
