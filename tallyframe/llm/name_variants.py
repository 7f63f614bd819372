"""Variant spellings of names: a pigeonhole segment join.

A name within k edits of another keeps at least one of its k+1 segments
untouched, shifted by at most k.  Segments of every name go into an inverted
index; the substrings of a name that could be such a segment are looked up, and
what meets is verified with a banded edit distance.  Names alone say little in
a large register, so a segment is looked up together with a place (postcode,
house, town, phone or web name), which also keeps postings short however
common a syllable is.  A town is shared by so many that segments of words meet
too often there: its words meet by their deletions instead, which lose nothing
either and meet hardly any but near words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from tallyframe.llm.names import LEAST_FIRST, LEGAL, SHORT_SHARE, Activities, orders, parse_name, parse_phone, parse_street, parse_web, plain
from tallyframe.session import cut, release, spread

#: Edits within a whole name and within one of its words.
NAME_EDITS, WORD_EDITS = 2, 1
#: Letters of a word from which two edits are allowed within it, and up to which words meet in a town by deletions (both ways for words at the border).
LONG_WORD, DELETED_WORD = 8, 26
#: Letters below which whole names meet by deletions: their segments would be a letter or two.
SHORT_NAME = 8
#: How tables that grow with the data are joined: Spark takes rows of exploded keys for no larger than the packed table they
#: come from, and would gather and broadcast them at the driver.
MERGE = "merge"

PARSED = StructType([
    StructField("core", ArrayType(StringType())), StructField("given", StringType()), StructField("person", BooleanType()), StructField("activity", StringType()),
    StructField("number", StringType()), StructField("legal", StringType()), StructField("house", StringType()), StructField("road", StringType()),
    StructField("zip", StringType()), StructField("town", StringType()), StructField("phone", StringType()), StructField("web", StringType()),
])
FIELDS = [f.name for f in PARSED.fields]
RAW = ("name", "street", "zip", "town", "phone", "web")


def segment_bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of ``parts`` even segments, the longer ones last."""
    short, longer = divmod(size, parts)
    out, at = [], 0
    for i in range(parts):
        n = short + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def index_keys(text: str, k: int) -> list[tuple[int, int, str]]:
    """(length, segment number, segment) of the k+1 segments."""
    return [(len(text), i, text[a : a + n]) for i, (a, n) in enumerate(segment_bounds(len(text), k + 1))] if len(text) > k else [(len(text), -1, text)]


def probe_keys(text: str, k: int, longer: bool = False) -> list[tuple[int, int, str]]:
    """The keys under which names of up to ``len(text)`` characters (with
    ``longer`` of any length) within k edits are indexed."""
    out = []
    for size in range(max(1, len(text) - k), len(text) + (k if longer else 0) + 1):
        if size <= k:
            continue
        gap = len(text) - size
        for i, (a, n) in enumerate(segment_bounds(size, k + 1)):
            # of the segments that survive, one has at most i edits before and k - i after it
            lo, hi = max(0, a - i, a + gap - (k - i)), min(len(text) - n, a + i, a + gap + (k - i))
            out += [(size, i, text[p : p + n]) for p in range(lo, hi + 1)]
    return out if len(text) > k else [(len(text), -1, text)]


def deletion_keys(text: str, k: int) -> set[str]:
    """What is left of a text after at most ``k`` deletions."""
    out = last = {text}
    for _ in range(k):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


def places(r: dict) -> tuple[list[str], list[str]]:
    """Places that few share, and the town."""
    out = []
    if r["zip"]:
        out.append("z" + "".join(sorted(r["zip"])))  # transposed figures meet
    if r["house"] and r["road"]:
        out.append(f"h{r['house']} {r['road'][:2]}")
    if r["phone"]:
        out.append("p" + r["phone"])
    if r["web"]:
        out.append("w" + r["web"])
    return out, ["t" + r["town"][:5]] if r["town"] else []


def _hashes(keys: set[tuple]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest("\u0001".join(map(str, x))) for x in sorted(keys)], np.uint64)


def _crossed(places_: list[str], keys: np.ndarray) -> np.ndarray:
    """One key for each place and segment."""
    with np.errstate(over="ignore"):
        h = _hashes({(p,) for p in places_})[:, None] * np.uint64(0x9E3779B97F4A7C15) + keys[None, :]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).ravel().view(np.int64)


def lookup_keys(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Index keys and probe keys of a parsed record.  Whole names are looked up in
    every place, words in every place but the town, where ``town_words`` has all
    but the longest."""
    rare, town = places(r)
    ix: set[tuple] = set()
    pr: set[tuple] = set()
    forms = orders(r["core"])
    if forms and forms[0]:
        # of two names that are near, both have segments or both have deletions, with the same edits on both sides
        if len(forms[0]) >= SHORT_NAME:
            ix |= {("n", *x) for x in index_keys(forms[0], NAME_EDITS)}
        if len(forms[0]) < SHORT_NAME + NAME_EDITS:
            ix |= {("d", x) for x in deletion_keys(forms[0], NAME_EDITS)}
        for f in forms:
            if len(f) >= SHORT_NAME:
                pr |= {("n", *x) for x in probe_keys(f, NAME_EDITS)}
            if len(f) < SHORT_NAME + NAME_EDITS:
                pr |= {("d", x) for x in deletion_keys(f, NAME_EDITS)}
    word_ix: set[tuple] = set()
    word_pr: set[tuple] = set()
    for w in r["core"]:
        if len(w) >= 4 and not w.endswith("."):
            # of two words that are near, both are this long or both have deletions
            own_ix, own_pr = (ix, pr) if len(w) > DELETED_WORD - NAME_EDITS else (word_ix, word_pr)
            own_ix |= {("w", *x) for x in index_keys(w, WORD_EDITS)}
            own_pr |= {("w", *x) for x in probe_keys(w, WORD_EDITS)}
            if len(w) >= LONG_WORD:  # a swap of two letters counts as two edits here
                own_ix |= {("W", *x) for x in index_keys(w, NAME_EDITS)}
                own_pr |= {("W", *x) for x in probe_keys(w, NAME_EDITS)}
    out = []
    for every, some in ((ix, word_ix), (pr, word_pr)):
        out.append(np.concatenate([_crossed(rare, _hashes(every | some)), _crossed(town, _hashes(every))]))
    return out[0], out[1]


def learn_activities(rows: DataFrame) -> Activities:
    """What the firms of a register do, from the words before their legal forms.
    What is collected is bounded by the least share of a short form."""
    words = F.filter(F.split(F.regexp_replace(F.lower("name"), r"[.']", ""), "[^a-z0-9]+"), lambda w: w != "")
    firms = rows.select(words.alias("w")).where((F.size("w") >= 3) & F.try_element_at("w", F.lit(-1)).isin(*LEGAL))
    counts = cut(firms.groupBy(F.try_element_at("w", F.lit(-2)).alias("word")).agg(F.count("*").alias("n"), F.approx_count_distinct(F.col("w")[0]).alias("firsts")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = counts.where((F.col("n") >= total * SHORT_SHARE) & (F.col("n") >= LEAST_FIRST)).collect()
    release(counts)
    return Activities.learned([(r.word, r.n, r.firsts) for r in frequent], total)


def _parse(r: tuple, activities: Activities) -> dict:
    out = parse_name(r[0], activities)
    out["house"], out["road"] = parse_street(r[1])
    out["zip"], out["town"], out["phone"], out["web"] = plain(r[2]), plain(r[3]), parse_phone(r[4]), parse_web(r[5])
    return out


def _parsed(activities: Activities) -> Column:
    @F.pandas_udf(PARSED)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            rows = [_parse(r, activities) for r in zip(*(c.where(c.notna(), None) for c in cols), strict=True)]
            yield pd.DataFrame([[r[f] for f in FIELDS] for r in rows], columns=FIELDS)

    return run(*RAW)


_KEYS = StructType([StructField("ix", ArrayType(LongType())), StructField("pr", ArrayType(LongType()))])


@F.pandas_udf(_KEYS)
def _lookup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [lookup_keys({**r, "core": list(r["core"]) if r["core"] is not None else []}) for r in pdf.to_dict("records")]
        yield pd.DataFrame({"ix": [r[0] for r in rows], "pr": [r[1] for r in rows]})


def records(df: DataFrame, side: str, key: str, **columns: str) -> DataFrame:
    """(side, key, name, street, zip, town, phone, web) of a register; columns not
    given are null.  Rows without a key are left out."""
    return df.select(F.lit(side).alias("side"), F.trim(F.col(f"`{key}`").cast("string")).alias("key"), *[(F.col(f"`{columns[c]}`").cast("string") if c in columns else F.lit(None).cast("string")).alias(c) for c in RAW]).where("key != ''")


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed contents, each once (cid and the parsed fields), and who has them
    (cid, side, key).  Records that are alike go through the join as one."""
    # parsing in Python outweighs moving the rows once more, which would else come coalesced by their size
    cores = rows.sparkSession.sparkContext.defaultParallelism
    p = rows.distinct().repartition(cores).withColumn("p", _parsed(learn_activities(rows)))
    p = cut(p.select("side", "key", "p.*").withColumn("cid", F.xxhash64(*FIELDS)))
    return cut(p.groupBy("cid").agg(*[F.first(f).alias(f) for f in FIELDS])), p.select("cid", "side", "key").distinct()


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """(a, b), a < b, of contents whose names, or two of whose longer words, are
    near and that share a place, or whose whole names are and that have no kind
    of place in common."""
    keyed = cut(spread(classes).select("cid", _lookup(F.struct(*FIELDS)).alias("k")))
    ix = keyed.select(F.col("cid").alias("a"), F.explode("k.ix").alias("key"))
    pr = keyed.select(F.col("cid").alias("b"), F.explode("k.pr").alias("key"))
    met = ix.join(pr.hint(MERGE), "key").where("a != b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(unplaced_pairs(classes))
    return verified(classes, met.distinct()).unionByName(town_words(classes)).distinct()


def _kinds() -> Column:
    """Which kinds of place a content has, one bit each."""
    there = [F.col(c).isNotNull() for c in ("zip", "town", "phone", "web")] + [F.col("house").isNotNull() & F.col("road").isNotNull()]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(there)), F.lit(0)).cast("int")


def unplaced_pairs(classes: DataFrame) -> DataFrame:
    """(a, b), a < b, of contents whose whole names may be an edit apart and that
    have no kind of place in common, so that none can be compared.

    Of two such contents one has at most two of the five kinds.  Those look
    their name's segments up together with each set of kinds that shares none
    with their own; so contents with a comparable place never meet here, and a
    name that many bear meets only where something is missing."""
    kinds = classes.where(F.size("core") > 0).select("cid", "core", _kinds().alias("kinds"))

    @F.pandas_udf(ArrayType(LongType()))
    def filed(core: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([_crossed([f"kinds{k}"], _hashes(whole_name_keys(list(c))[0])) for c, k in zip(core, own, strict=True)])

    @F.pandas_udf(ArrayType(LongType()))
    def asked(core: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([_crossed([f"kinds{m}" for m in range(32) if not m & k], _hashes(whole_name_keys(list(c))[1])) for c, k in zip(core, own, strict=True)])

    ix = kinds.select(F.col("cid").alias("a"), F.explode(filed("core", "kinds")).alias("key"))
    pr = kinds.where(F.bit_count("kinds") <= 2).select(F.col("cid").alias("b"), F.explode(asked("core", "kinds")).alias("key"))
    met = ix.join(pr.hint(MERGE), "key").where("a != b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def whole_name_keys(core: list[str], k: int = WORD_EDITS) -> tuple[set[tuple], set[tuple]]:
    """Keys under which a whole name is filed, and under which it is looked up
    (its words in any turn); short names by deletions, as in ``lookup_keys``."""
    forms = [f for f in orders(core) if f]
    ix: set[tuple] = set()
    pr: set[tuple] = set()
    for at, f in enumerate(forms):
        if len(f) >= SHORT_NAME:
            pr |= {("n1", *x) for x in probe_keys(f, k, longer=True)}
            if not at:
                ix |= {("n1", *x) for x in index_keys(f, k)}
        if len(f) < SHORT_NAME + k:
            pr |= {("d1", x) for x in deletion_keys(f, k)}
            if not at:
                ix |= {("d1", x) for x in deletion_keys(f, k)}
    return ix, pr


def near_words(words: DataFrame) -> DataFrame:
    """(u, v), u <= v, of all distinct ``word``s of at most ``DELETED_WORD``
    letters within the edits allowed in a word.  Words k edits apart have in
    common what is left after at most k deletions in each."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, F.length(w))))
    own = words.where(F.length("word") <= DELETED_WORD).select("word").distinct()
    once = own.withColumn("one", less(F.col("word")))
    left = F.concat(F.array("word"), F.col("one"), F.when(F.length("word") >= LONG_WORD, F.flatten(F.transform("one", less))).otherwise(F.array().cast("array<string>")))
    keyed = once.select("word", F.explode(F.array_distinct(F.transform(left, lambda x: F.xxhash64(x)))).alias("key"))
    met = keyed.withColumnRenamed("word", "u").join(keyed.withColumnRenamed("word", "v").hint(MERGE), "key").where("u < v").select("u", "v").distinct()
    return met.where(_near_word(F.col("u"), F.col("v"))).unionByName(own.select(F.col("word").alias("u"), F.col("word").alias("v")))


def town_words(classes: DataFrame) -> DataFrame:
    """(a, b), a < b, of contents in one town with near words."""
    at = cut(classes.where("town != ''").select("cid", F.substring("town", 1, 5).alias("town"), F.explode(F.array_distinct(_words())).alias("word")))
    a, b = (at.withColumnsRenamed({"cid": x, "word": w}) for x, w in (("a", "u"), ("b", "v")))
    met = a.join(cut(near_words(at)).hint(MERGE), "u").join(b.hint(MERGE), ["town", "v"]).where("a != b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _words() -> Column:
    """The longer words of a name that are written out."""
    return F.filter("core", lambda w: (F.length(w) >= 4) & ~w.endswith("."))


def _near_word(x: Column, y: Column) -> Column:
    near = lambda k: F.levenshtein(x, y, k) >= 0
    return near(WORD_EDITS) | ((F.least(F.length(x), F.length(y)) >= LONG_WORD) & near(NAME_EDITS))


def verified(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose names, in some order of their words, or two of whose longer
    words are within the edits allowed; checked in the JVM, whose edit distance
    keeps to the band."""
    words = F.transform("core", lambda w: F.regexp_replace(w, r"\.", ""))
    flat = classes.select("cid", F.array_join(words, "").alias("n"), F.array_join(F.reverse(words), "").alias("r"), _words().alias("w"))
    a, b = (flat.withColumnsRenamed({"cid": x, "n": f"n{x}", "r": f"r{x}", "w": f"w{x}"}) for x in "ab")
    near = lambda x, y, k: F.levenshtein(x, y, k) >= 0
    both = pairs.join(a.hint(MERGE), "a").join(b.hint(MERGE), "b")
    word = F.exists("wa", lambda x: F.exists("wb", lambda y: _near_word(x, y)))
    return both.where(near(F.col("na"), F.col("nb"), NAME_EDITS) | near(F.col("na"), F.col("rb"), NAME_EDITS) | word).select("a", "b")
