"""Detection rules from knowledge-base documents, as a projection over nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.text import blank_to_null

#: Node types that make rules (``terminology`` only on request).
NODE_TYPES = ("rule", "standard", "pattern", "gap", "capability_gap", "fact", "guardrail", "formula_domain", "hierarchy_type", "complexity_pattern")
#: Words that tell a finding's type, in order of trial.
FINDING_NAMES = {
    "sign_reversal": "sign_reversal",
    "sign_convention": "sign_reversal",
    "rounding": "rounding_discrepancy",
    "rounding_tolerance": "rounding_discrepancy",
    "missing": "missing_account",
    "duplicate": "duplicate_account",
    "hierarchy": "hierarchy_break",
    "naming": "naming_violation",
    "naming_convention": "naming_violation",
    "balance": "balance_mismatch",
    "trial_balance": "balance_mismatch",
    "formula": "formula_anomaly",
    "classification": "classification_error",
}
FINDING_TYPES = (*dict.fromkeys(FINDING_NAMES.values()), "custom")
SEVERITIES = ("critical", "high", "medium", "low", "info")
#: Words that make no keyword; keywords of a rule at most.
PLAIN_WORDS = "the and for with from that this are was has have been not but its any all can only into per via each use new one two".split()
KEYWORDS = 6

NODES = """nodes array<struct<id:string,type:string,name:string,confidence:double,tags:array<string>,properties:struct<description:string,severity:string,standard:string,detection_pattern:string,pattern:string,detection_field:string,
field_targets:array<string>,gap_id:string,sheet_name_patterns:array<string>,functions:array<string>,category:string,detection_rule:struct<pattern:string,field_targets:array<string>,finding_type:string,severity:string,standard:string,description:string>>>>"""


def keywords(*texts: Column) -> Column:
    """The first words of three letters or more, each once, plain ones left out."""
    words = F.split(F.lower(F.concat_ws(" ", *texts)), "[^a-z0-9]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*PLAIN_WORDS))), 1, KEYWORDS)


def any_of(words: Column) -> Column:
    """A pattern for any of the words, whole and by any case; null for none."""
    safe = F.transform(words, lambda w: F.regexp_replace(w, r"([\\^$.|?*+()\[\]{}])", r"\\$1"))
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?i)\b(?:"), F.array_join(safe, "|"), F.lit(r")\b")))


def _severity(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.when(s.isin(*SEVERITIES), s).otherwise("medium")


def _finding(c: Column) -> Column:
    s = F.lower(F.trim(c))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in FINDING_NAMES.items() for x in p]), s), F.when(s.isin(*FINDING_TYPES), s), F.lit("custom"))


def knowledge_rules(documents: DataFrame, types: tuple[str, ...] = NODE_TYPES) -> DataFrame:
    """Rules (rule_id, name, standard, finding_type, pattern, field_targets,
    severity, description, confidence, tags, kb_source_file) of documents with
    ``nodes`` and ``file``.  A rule given in a node comes before one made of the
    node's type and words; nodes that give no pattern, or no id, make none."""
    n = documents.select("file", F.explode("nodes").alias("n")).where("n.id is not null")
    p, r, kind = F.col("n.properties"), F.col("n.properties.detection_rule"), F.col("n.type")
    said = F.coalesce(p["description"], F.col("n.name"))
    made = any_of(keywords(F.col("n.name"), said))
    own = F.coalesce(blank_to_null(p["detection_pattern"]), blank_to_null(p["pattern"]))
    told = F.concat_ws(" ", F.lower(F.array_join(F.coalesce("n.tags", F.array()), " ")), F.lower("n.name"))
    by_words = F.coalesce(*[F.when(told.contains(w), F.lit(t)) for w, t in FINDING_NAMES.items()], F.lit("custom"))
    direct = kind.isin("rule", "standard", "pattern", "guardrail", "terminology")
    names = lambda *c: F.array(*map(F.lit, c))
    sev = _severity(p["severity"])
    kinds = (  # when, pattern, finding, fields, severity
        (r.isNotNull(), blank_to_null(r["pattern"]), _finding(r["finding_type"]), F.coalesce(r["field_targets"], F.array()), _severity(r["severity"])),
        (~kind.isin(*types), None, None, None, None),
        (kind.isin("gap", "capability_gap"), F.when(blank_to_null(p["gap_id"]).isNotNull(), made), F.lit("classification_error"), names("account_name", "description", "category"), sev),
        (kind == "hierarchy_type", any_of(p["sheet_name_patterns"]), F.lit("hierarchy_break"), names("sheet_name", "hierarchy_type", "category"), F.lit("info")),
        (kind == "formula_domain", any_of(p["functions"]), F.lit("formula_anomaly"), names("formula", "formula_text", "expression"), F.lit("info")),
        (kind == "fact", F.when(p["category"] == "gap", made), F.lit("classification_error"), names("account_name", "description"), F.lit("medium")),
        (direct, F.coalesce(own, made), by_words, F.when(blank_to_null(p["detection_field"]).isNotNull(), F.array(p["detection_field"])).otherwise(F.coalesce(p["field_targets"], names("account_name", "description"))), sev),
        (kind == "complexity_pattern", made, F.lit("formula_anomaly"), names("formula", "expression", "description"), F.lit("low")),
    )

    def chosen(k: int, typ: str) -> Column:
        out = None
        for row in kinds:
            v = F.lit(None).cast(typ) if row[k] is None else row[k]
            c = F.coalesce(row[0], F.lit(False))
            out = F.when(c, v) if out is None else out.when(c, v)
        return out

    rules = n.select(
        F.concat(F.lit("rule_"), "n.id").alias("rule_id"), F.col("n.name").alias("name"), F.coalesce(r["standard"], p["standard"], F.lit("")).alias("standard"), chosen(2, "string").alias("finding_type"), chosen(1, "string").alias("pattern"),
        chosen(3, "array<string>").alias("field_targets"), chosen(4, "string").alias("severity"), F.coalesce(r["description"], said).alias("description"), F.coalesce("n.confidence", F.lit(0.9)).alias("confidence"), F.col("n.tags").alias("tags"), F.col("file").alias("kb_source_file"),
    )
    return rules.where("pattern is not null")


def load_rules(spark: SparkSession, folder: str, types: tuple[str, ...] = NODE_TYPES) -> DataFrame:
    """Rules of all JSON documents of a folder; broken documents give none."""
    docs = spark.read.schema(NODES).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(folder)
    return knowledge_rules(docs.select(F.col("_metadata.file_path").alias("file"), "nodes").where("nodes is not null"), types)


def fenced_json(text: Column) -> Column:
    """The JSON object in a model's answer, in compact form: the whole text
    without code fences, or else what stands from its first to its last brace;
    ``{}`` where neither is JSON."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    braces = F.regexp_extract(bare, r"\{[\s\S]*\}", 0)
    parsed = lambda c: F.to_json(F.try_parse_json(F.nullif(c, F.lit(""))))
    return F.coalesce(parsed(bare), parsed(braces), F.lit("{}"))
