"""Rule-grounded detection over rows of text columns: pattern scan, sequential
test, caps, feedback, monitors, outliers and the verification passes.

Rows need an explicit ``row_index``; sequences run per ``file``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut

#: Sequential test (rates of clean and anomalous files, error rates, least rows), cap of findings.
P0, P1, ALPHA, BETA, LEAST_ROWS, MOST_FINDINGS = 0.001, 0.01, 0.05, 0.05, 100, 500
#: Row numbers of a block within which running sums are taken in order.
BLOCK_ROWS = 1_000_000
#: Feedback steps, bounds of confidence, dismissals that suppress.
CONFIRMED_STEP, DISMISSED_STEP, LEAST_CONFIDENCE, MOST_CONFIDENCE, DISMISSALS = 0.05, 0.08, 0.05, 1.0, 3
#: Columns that name an account, number columns, rate columns, monetary fields, name fields.
ACCOUNT_COLUMNS = ("account_name", "account", "name", "description", "account_id", "acct_name", "account_number", "gl_account", "account_code", "acct", "accountname", "accountid")
NUMERIC_WORDS = ("rate", "fx_rate", "fx", "amount", "balance", "translated", "debit", "credit", "adjustment")
RATE_COLUMNS = ("rate", "fx_rate")
MONETARY_FIELDS = ("amount", "balance", "translated_balance", "local_balance", "fx_rate", "rate", "debit", "credit", "gaap_balance", "ifrs_balance", "ifrs_adjustment")
NAME_FIELDS = ("account_name", "description", "name")
#: Plausible rates to the dollar, in order of trial.
RATE_RANGES = (("EUR", 0.8, 1.3), ("GBP", 1.1, 1.6), ("JPY", 0.005, 0.012), ("CAD", 0.65, 0.85), ("AUD", 0.55, 0.80), ("CHF", 0.95, 1.25), ("CNY", 0.12, 0.18), ("INR", 0.010, 0.015), ("BRL", 0.15, 0.25), ("MXN", 0.04, 0.07), ("SGD", 0.70, 0.80))
SEVERITIES = ("critical", "high", "medium", "low", "info")

FINDING = "file string, row_index long, rule_id string, rule_name string, finding_type string, severity string, field string, matched_value string, account string, confidence double"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    field_targets: tuple[str, ...] = ()
    name: str = ""
    finding_type: str = "custom"
    severity: str = "medium"
    confidence: float = 0.9


def rules_from(df: DataFrame) -> list[Rule]:
    """Rules of a rule table (one per rule_id, the last loaded if ``loaded_at`` is
    there).  A knowledge base of rules is small by nature; a larger one than
    100,000 is refused."""
    order = [F.col("loaded_at")] if "loaded_at" in df.columns else [F.lit(0)]
    body = F.struct(*order, "pattern", F.transform(F.array_compact("field_targets"), F.trim).alias("t"), "name", "finding_type", "severity", "confidence")
    rows = df.where("rule_id is not null").groupBy("rule_id").agg(F.max(body).alias("r")).select("rule_id", "r.*").orderBy("rule_id").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("too many rules for one plan")
    return [Rule(r.rule_id, r.pattern or "", tuple(x for x in r.t or () if x), r.name or "", r.finding_type or "custom", (r.severity or "medium").lower(), r.confidence if r.confidence is not None else 0.9) for r in rows]


def usable(rules: Sequence[Rule], columns: Sequence[str], least_confidence: float = 0.0) -> list[tuple[Rule, list[str]]]:
    """Rules with a valid pattern and enough confidence, with the columns they
    look at: their targets, exact or else by any case; all if they name none.
    Rules none of whose targets is there are left out."""
    by_case = {}
    for c in columns:
        by_case.setdefault(c.lower(), c)
    out = []
    for r in rules:
        try:
            re.compile(r.pattern)
        except re.error:
            continue
        if not r.pattern.strip() or r.confidence < least_confidence:
            continue
        at = list(dict.fromkeys(c for t in r.field_targets for c in [t if t in columns else by_case.get(t.lower())] if c)) if r.field_targets else list(columns)
        if at:
            out.append((r, at))
    return out


def account_label(columns: Sequence[str]) -> Column:
    """The first account-like column with a value, else the first column with
    one; over 120 characters cut to 117 and dots."""
    by_case = {c.lower(): c for c in reversed(columns)}
    order = [by_case[c] for c in ACCOUNT_COLUMNS if c in by_case] + list(columns)
    v = F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in order], F.lit(""))
    return F.when(F.length(v) > 120, F.concat(F.substring(v, 1, 117), F.lit("..."))).otherwise(v)


def _group_whole(pattern: str) -> str:
    """The pattern with all of it as the first group; leading flags stay in front."""
    flags = re.match(r"\(\?[a-zA-Z]+\)", pattern)
    head = flags.group() if flags else ""
    return f"{head}({pattern[len(head):]})"


def scan(rows: DataFrame, rules: Sequence[Rule], columns: Sequence[str], least_confidence: float = 0.0) -> DataFrame:
    """A finding for each row and rule: the first of the rule's columns whose
    text has the pattern.  ``rows`` has file, row_index and ``columns``; null
    fields match nothing.

    One scan serves all rules.  Each distinct pattern is tried once on each
    column it is asked of, however many rules share it; which rules that makes is
    settled within the row."""
    live = usable(rules, columns, least_confidence)
    if not live:
        return rows.sparkSession.createDataFrame([], FINDING)
    tried = list(dict.fromkeys((r.pattern, c) for r, at in live for c in at))
    name = {pc: f"__m{i}" for i, pc in enumerate(tried)}
    text = lambda c: F.col(f"`{c}`").cast("string")
    first = rows.select("file", "row_index", account_label(columns).alias("account"), *[F.when(text(c).rlike(p), F.substring(F.regexp_extract(text(c), _group_whole(p), 1), 1, 200)).alias(name[p, c]) for p, c in tried])
    at_ = {pc: i for i, pc in enumerate(tried)}
    wanted = ", ".join(f"named_struct('r', {i}, 'p', array({', '.join(str(at_[r.pattern, c]) for c in at)}))" for i, (r, at) in enumerate(live))
    hit = F.array_compact(F.array(*[F.when(F.col(name[pc]).isNotNull(), F.lit(i)) for i, pc in enumerate(tried)]))
    # of each rule's columns the first that was hit
    settled = F.filter(F.transform(F.expr(f"array({wanted})"), lambda u: F.struct(u["r"].alias("__rule"), F.get(F.filter(u["p"], lambda i: F.array_contains(F.col("__hit"), i)), F.lit(0)).alias("__i"))), lambda x: x["__i"].isNotNull())
    some = first.withColumn("__hit", hit).where(F.size("__hit") > 0)
    found = some.select("file", "row_index", "account", F.array(*[F.col(name[pc]) for pc in tried]).alias("__v"), F.inline(settled))
    found = found.select("file", "row_index", "account", "__rule", F.element_at(F.array(*[F.lit(c) for _, c in tried]), F.col("__i") + 1).alias("field"), F.element_at("__v", F.col("__i") + 1).alias("matched_value"))
    # as many rows as rules, whose number is bounded where they are read
    table = rows.sparkSession.createDataFrame([(i, r.rule_id, r.name, r.finding_type, r.severity, float(r.confidence)) for i, (r, _) in enumerate(live)], "__rule int, rule_id string, rule_name string, finding_type string, severity string, confidence double")
    return found.join(F.broadcast(table), "__rule").select("file", "row_index", "rule_id", "rule_name", "finding_type", "severity", "field", "matched_value", "account", "confidence")


def running_sums(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums along each file, the row itself included.  They run
    within blocks of ``BLOCK_ROWS`` row numbers and over the blocks' totals, so
    a file of any length is spread over many tasks."""
    b = rows.withColumns({f"__v{i}": c for i, c in enumerate(sums.values())}).withColumn("__b", F.floor(F.col("row_index") / BLOCK_ROWS))
    w = Window.partitionBy("file").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = b.groupBy("file", "__b").agg(*[F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(sums))])
    before = totals.select("file", "__b", *[F.coalesce(F.sum(f"__t{i}").over(w), F.lit(0)).alias(f"__s{i}") for i in range(len(sums))])
    inside = Window.partitionBy("file", "__b").orderBy("row_index").rowsBetween(Window.unboundedPreceding, 0)
    j = b.select("*", *[F.sum(f"__v{i}").over(inside).alias(f"__i{i}") for i in range(len(sums))]).join(before, ["file", "__b"])
    return j.select(*rows.columns, *[(F.col(f"__s{i}") + F.col(f"__i{i}")).alias(n) for i, n in enumerate(sums)])


def sequential_test(rows: DataFrame) -> DataFrame:
    """Adds ``llr``, ``seen`` and ``decision`` to rows of (file, row_index, hit):
    Wald's test of the rate of hits along a file.  ``anomalous`` from the row on
    where the upper bound was first met, ``clean`` where the lower one was and
    the upper had not been; never before ``LEAST_ROWS`` rows."""
    step = F.when(F.col("hit"), math.log(P1 / P0)).otherwise(math.log((1 - P1) / (1 - P0)))
    r = running_sums(rows, {"llr": step, "seen": F.lit(1).cast("long")})
    ripe = F.col("seen") >= LEAST_ROWS
    met = r.where(ripe).groupBy("file").agg(
        F.min(F.when(F.col("llr") >= math.log((1 - BETA) / ALPHA), F.col("seen"))).alias("__u"), F.min(F.when(F.col("llr") <= math.log(BETA / (1 - ALPHA)), F.col("seen"))).alias("__d")
    )
    first = F.when(F.col("__u").isNotNull() & (F.col("__d").isNull() | (F.col("__u") < F.col("__d"))), F.struct(F.col("__u").alias("at"), F.lit("anomalous").alias("d"))).when(F.col("__d").isNotNull(), F.struct(F.col("__d").alias("at"), F.lit("clean").alias("d")))
    return r.join(met.select("file", first.alias("__f")), "file", "left").withColumn("decision", F.when(F.col("seen") >= F.col("__f.at"), F.col("__f.d")).otherwise("undecided")).drop("__f")


def certificates(tested: DataFrame) -> DataFrame:
    """One row per file: decision, rows until it was certified clean (else all),
    rows in all and log-likelihood ratio there."""
    last = tested.groupBy("file").agg(F.count("*").alias("total_rows"), F.min(F.when(F.col("decision") == "clean", F.col("seen"))).alias("clean_at"), F.max_by("decision", "row_index").alias("at_end"), F.max_by("llr", "row_index").alias("llr_end"), F.min_by("llr", F.when(F.col("decision") == "clean", F.col("seen"))).alias("llr_clean"))
    clean = F.col("clean_at").isNotNull()
    return last.select("file", F.when(clean, "clean").otherwise(F.col("at_end")).alias("decision"), F.coalesce("clean_at", "total_rows").alias("rows_scanned"), "total_rows", F.round(F.when(clean, F.col("llr_clean")).otherwise(F.col("llr_end")), 4).alias("log_likelihood_ratio"))


def within_limits(rows: DataFrame, findings: DataFrame, most: int = MOST_FINDINGS) -> DataFrame:
    """Findings of the rows a scan would have reached: up to where the file was
    certified clean, and only rows before which there were fewer than ``most``."""
    n = findings.groupBy("file", "row_index").agg(F.count("*").alias("n"))
    marked = rows.select("file", "row_index").join(n, ["file", "row_index"], "left").select("file", "row_index", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("hit"))
    tested = sequential_test(running_sums(marked, {"upto": F.col("n")}))
    stop = tested.where("decision = 'clean'").groupBy("file").agg(F.min("seen").alias("stop"))
    reached = tested.join(stop, "file", "left").where((F.col("upto") - F.col("n") < most) & (F.col("stop").isNull() | (F.col("seen") <= F.col("stop")))).select("file", "row_index")
    return findings.join(reached, ["file", "row_index"], "left_semi")


def feedback_tallies(feedback: DataFrame) -> DataFrame:
    """(rule_id, finding_type, n, confirmed, dismissed); records without a rule are skipped."""
    f = feedback.where("trim(rule_id) != ''")
    return f.groupBy("rule_id", "finding_type").agg(F.count("*").alias("n"), F.count_if(F.col("action") == "confirmed").alias("confirmed"), F.count_if(F.col("action") == "dismissed").alias("dismissed"))


def apply_feedback(findings: DataFrame, tallies: DataFrame, strategy: str = "threshold", min_trust: float = 0.1, seed: int = 0) -> DataFrame:
    """Findings not suppressed, with adjusted confidence.  ``threshold``
    suppresses rules dismissed more than three times and never confirmed;
    ``thompson`` those whose draw from Beta(confirmed + 1, dismissed + 1) under
    ``seed`` is below ``min_trust``, one draw per rule.  Confidence moves with
    confirmed less dismissed, within its bounds, to four places.  The tallies
    are as many as rules and types; the optimizer broadcasts them by their size."""
    t = tallies.select("rule_id", "finding_type", "confirmed", "dismissed")
    if strategy == "thompson":

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import random

            for pdf in batches:
                pdf["gone"] = [random.Random(seed).betavariate(c + 1, d + 1) < min_trust for c, d in zip(pdf["confirmed"], pdf["dismissed"], strict=True)]
                yield pdf

        t = t.mapInPandas(draw, "rule_id string, finding_type string, confirmed long, dismissed long, gone boolean")
    elif strategy == "threshold":
        t = t.withColumn("gone", (F.col("dismissed") > DISMISSALS) & (F.col("confirmed") == 0))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    net = F.coalesce(F.col("confirmed") - F.col("dismissed"), F.lit(0))
    moved = F.col("confidence") + net * F.when(net >= 0, CONFIRMED_STEP).otherwise(DISMISSED_STEP)
    known = F.col("confirmed").isNotNull()
    new = F.when(known, F.round(F.least(F.lit(MOST_CONFIDENCE), F.greatest(F.lit(LEAST_CONFIDENCE), moved)), 4)).otherwise(F.col("confidence"))
    return findings.join(t, ["rule_id", "finding_type"], "left").where(~F.coalesce("gone", F.lit(False))).withColumn("confidence", new).select(*findings.columns)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Totals over all feedback: n, confirmed, dismissed, confirmation_rate, patterns, suppressed_patterns, active_patterns."""
    t = feedback_tallies(feedback)
    g = t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("confirmed"), F.lit(0)).alias("confirmed"), F.coalesce(F.sum("dismissed"), F.lit(0)).alias("dismissed"), F.count("*").alias("patterns"), F.count_if((F.col("dismissed") > DISMISSALS) & (F.col("confirmed") == 0)).alias("suppressed_patterns"))
    g = g.withColumn("active_patterns", F.col("patterns") - F.col("suppressed_patterns"))
    return g.withColumn("confirmation_rate", F.when(F.col("n") > 0, F.round(F.col("confirmed") / F.col("n"), 4)))


def monitors(findings: DataFrame) -> DataFrame:
    """(monitor, account, field, n) of inconsistencies among findings: an account
    and field both missing and duplicate, confidence out of bounds, no rule, and
    the same row, rule and field again."""
    t = F.col("finding_type")
    contra = findings.groupBy("account", "field").agg(F.max(t == "missing_account").alias("m"), F.max(t == "duplicate_account").alias("d"), F.count("*").alias("n")).where("m and d").select(F.lit("contradiction").alias("monitor"), "account", "field", "n")
    nul = F.lit(None).cast("string")
    bounds = findings.where("confidence < 0 or confidence > 1").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("confidence_bounds").alias("monitor"), nul.alias("account"), nul.alias("field"), "n")
    no_rule = findings.where("coalesce(rule_id, '') = ''").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("missing_rule").alias("monitor"), nul.alias("account"), nul.alias("field"), "n")
    again = findings.groupBy("row_index", "rule_id", "field").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("monitor"), F.col("rule_id").alias("account"), "field", F.col("n") - 1)
    return contra.unionByName(bounds).unionByName(no_rule).unionByName(again.toDF("monitor", "account", "field", "n"))


def numeric_outliers(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(file, row_index, field, value, ratio, finding_type, severity, confidence)
    of values over ten times the upper median of their column's absolute values
    (with a product near 1 a rate turned over), and of rates under a tenth.
    Zeros and other texts do not count; columns with fewer than three values are
    left out.  The median is exact."""
    names = list(columns) if columns else [c for c in rows.columns if c not in ("file", "row_index") and any(w in c.lower() for w in NUMERIC_WORDS)]
    if not names:
        return rows.sparkSession.createDataFrame([], "file string, row_index long, field string, value double, ratio double, finding_type string, severity string, confidence double")
    number = lambda c: F.replace(F.col(f"`{c}`").cast("string"), F.lit(","), F.lit("")).try_cast("double")
    long = rows.select("file", "row_index", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), number(c).alias("value")) for c in names]))).where("value is not null and value != 0")
    # the median's rank is first found among buckets of close values, then within its bucket
    counts = long.groupBy("file", "field", F.abs("value").alias("x")).agg(F.count("*").alias("c")).withColumn("k", F.floor(F.log2("x") * 256))
    all_ = Window.partitionBy("file", "field")
    buckets = counts.groupBy("file", "field", "k").agg(F.sum("c").alias("t"))
    ranked = buckets.withColumn("n", F.sum("t").over(all_)).withColumn("before", F.coalesce(F.sum("t").over(all_.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    mid = ranked.where("n >= 3 and before <= floor(n / 2) and before + t > floor(n / 2)").select("file", "field", "k", "n", "before")
    upto = F.col("before") + F.sum("c").over(all_.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    med = counts.join(mid, ["file", "field", "k"]).withColumn("upto", upto).where("upto > floor(n / 2)").groupBy("file", "field").agg(F.min("x").alias("median"))
    j = long.join(med, ["file", "field"]).withColumn("ratio", F.abs("value") / F.col("median"))
    turned = (F.abs("value") * F.col("median") > 0.5) & (F.abs("value") * F.col("median") < 2.0)
    big, small = F.col("ratio") > 10, (F.col("ratio") < 0.1) & F.lower("field").isin(*RATE_COLUMNS)
    return j.where(big | small).select(
        "file", "row_index", "field", "value", "ratio", F.when(big & turned, "sign_reversal").otherwise("balance_mismatch").alias("finding_type"),
        F.when(big, "critical").otherwise("high").alias("severity"), F.when(big & turned, 0.95).when(big, 0.85).otherwise(0.75).alias("confidence"),
    )


def triage(findings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``decision`` (keep, dismiss, escalate) in the order of ``candidate``:
    informal findings off monetary columns and short generic hits on names go;
    then only the first rule that hit a row stays; grave findings on monetary
    columns are escalated."""
    money = [c for c in MONETARY_FIELDS if c in {x.lower() for x in columns}]
    field = F.lower(F.coalesce("field", F.lit("")))
    on_money = field.isin(*money) if money else F.lit(False)
    early = ((F.col("severity") == "info") & ~on_money) | ((F.col("finding_type") == "custom") & (F.length("matched_value") <= 20) & field.isin(*NAME_FIELDS))
    first = F.min(F.when(~F.coalesce(early, F.lit(False)), F.struct("candidate", "rule_id"))).over(Window.partitionBy("file", "row_index"))["rule_id"]
    d = F.when(early, "dismiss").when(F.col("rule_id") != first, "dismiss").when(F.col("severity").isin("critical", "high") & on_money, "escalate").otherwise("keep")
    return findings.withColumn("decision", d)


def verify(triaged: DataFrame) -> DataFrame:
    """Findings that were not dismissed with ``adjusted`` confidence of at least
    0.3: escalated ones gain 0.1; a number in a rate column loses 0.2 (down to
    0.3) at the first plausible range, and gains 0.2 for each range tried before
    that if it is beyond 10 or 0.001."""
    x = F.col("matched_value").try_cast("double")
    rate = F.lower("field").contains("rate") | F.lower("field").contains("fx")
    c = F.col("confidence") + F.when(F.col("decision") == "escalate", 0.1).otherwise(0.0)
    c = F.least(F.lit(1.0), c)
    start = F.struct(c.alias("c"), F.lit(False).alias("done"))
    ranges = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for _, lo, hi in RATE_RANGES])

    def step(acc: Column, r: Column) -> Column:
        inside = (x >= r["lo"]) & (x <= r["hi"])
        odd = (x > 10.0) | (x < 0.001)
        new = F.when(inside, F.greatest(F.lit(0.3), acc["c"] - 0.2)).when(odd, F.least(F.lit(1.0), acc["c"] + 0.2)).otherwise(acc["c"])
        return F.struct(F.when(acc["done"], acc["c"]).otherwise(new).alias("c"), (acc["done"] | F.coalesce(inside, F.lit(False))).alias("done"))

    checked = F.when(rate & x.isNotNull(), F.aggregate(ranges, start, step)["c"]).otherwise(c)
    return triaged.where("decision != 'dismiss'").withColumn("adjusted", F.round(checked, 4)).where("adjusted >= 0.3")


def reconcile_findings(verified: DataFrame, outliers: DataFrame) -> DataFrame:
    """Verified findings and outliers on other fields of a row, one for each
    account, row and type, the verified first; gravest and surest on top."""
    rest = outliers.join(verified.select("file", "row_index", "field"), ["file", "row_index", "field"], "left_anti")
    cols = ["file", "row_index", "account", "finding_type", "severity", "field"]
    a = verified.select(*cols, F.col("adjusted").alias("confidence"), F.lit("rules").alias("source"), F.lit(0).alias("p"), "rule_id")
    b = rest.select("file", "row_index", F.lit("").alias("account"), "finding_type", "severity", "field", "confidence", F.lit("numbers").alias("source"), F.lit(1).alias("p"), F.lit("").alias("rule_id"))
    w = Window.partitionBy("file", "account", "row_index", "finding_type").orderBy("p", "rule_id", "field")
    one = a.unionByName(b).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "p", "rule_id")
    rank = F.coalesce(*[F.when(F.col("severity") == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(2))
    return one.withColumn("severity_rank", rank)


def detect(rows: DataFrame, rules: Sequence[Rule], columns: Sequence[str], feedback: DataFrame | None = None, least_confidence: float = 0.0, most: int | None = MOST_FINDINGS) -> DataFrame:
    """The scan of all files in one plan, with feedback; with ``most`` also the
    limits of ``within_limits``, without it every row of every file counts."""
    found = scan(rows, rules, columns, least_confidence)
    if most is not None:
        found = within_limits(rows, cut(found), most)
    return apply_feedback(found, feedback_tallies(feedback)) if feedback is not None else found


def detect_and_verify(rows: DataFrame, rules: Sequence[Rule], columns: Sequence[str], feedback: DataFrame | None = None, most: int | None = MOST_FINDINGS) -> DataFrame:
    """Findings of ``detect`` after triage and verification, with outliers of the numbers beside them."""
    found = detect(rows, rules, columns, feedback, most=most)
    order = F.row_number().over(Window.partitionBy("file", "row_index").orderBy("rule_id", "field"))
    return reconcile_findings(verify(triage(found.withColumn("candidate", order), columns)), numeric_outliers(rows))
