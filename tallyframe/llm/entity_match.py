"""Matching entities across sources without keys: a label model.

Candidates come from the segment join of names and from exact agreement in two
of address, phone and web name.  Heuristic matching functions vote on each
candidate, each on one attribute and with an opinion graded by how far it
agrees; all that is said of an opinion beforehand is whether it agrees,
disagrees or abstains.  A generative model with a hidden match variable learns
how accurate each function is by expectation-maximisation, begun from the
unweighted majority of votes: first with functions that are independent given
the match, which finds the two classes, then with a tree of correlated
functions (Chow and Liu 1968, given the match).  Its posterior is the
confidence, and nothing else decides.  That two records match a third is the
vote of one more function, whose accuracy is learned from the pairs judged
before.

What is collected is the count of each pattern of votes, whose number is bounded
by the functions' opinions and does not grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import name_variants
from tallyframe.llm.name_variants import MERGE
from tallyframe.llm.names import edits, orders
from tallyframe.session import cut

#: The matching functions, and for each of their opinions whether it agrees (1), disagrees (-1) or abstains (0).
STANCES = {
    "name": (-1, 0, 1, 1, 1), "given": (0, 1, 0, -1, -1), "activity": (0, 1, 0, -1), "number": (0, 1, 0, -1), "street": (0, 1, 0, -1),
    "zip": (0, 1, 0, -1), "town": (0, 1, -1), "phone": (0, 1, 0, -1), "web": (0, 1, -1), "legal": (0, 1, -1),
}
#: The matching functions and the number of their opinions.
FUNCTIONS = {k: len(v) for k, v in STANCES.items()}
#: Members of a group that are paired within one task; larger groups are salted.
CELL = 500
#: Pairs with at least this posterior are matches.
CONFIDENT = 0.5


def vote_name(a: list[str], b: list[str]) -> int:
    """4 equal (in any order), 3 within edits, 2 word by word (abbreviations
    too), 1 one word, or two thirds of the letters in order, in common, 0 neither."""
    x, y = [w.rstrip(".") for w in a], [w.rstrip(".") for w in b]
    jx, jy = "".join(x), "".join(y)
    if not jx or not jy:
        return 0
    if jx == jy or sorted(x) == sorted(y):
        return 4
    most = 2 if min(len(jx), len(jy)) >= 8 else 1
    forms = orders(b)
    if any(f == jx for f in forms):
        return 4
    if any(edits(jx, f, most) <= most for f in forms):
        return 3

    def alike(p: str, q: str) -> int:
        u, v = p.rstrip("."), q.rstrip(".")
        e = 2 if min(len(u), len(v)) >= 8 else 1
        if min(len(u), len(v)) >= 4 and edits(u, v, e) <= e:
            return 2
        if (p.endswith(".") and len(u) >= 3 and len(v) > len(u) and edits(u, v[: len(u)], 1) <= (len(u) > 3)) or (q.endswith(".") and len(v) >= 3 and len(u) > len(v) and edits(v, u[: len(v)], 1) <= (len(v) > 3)):
            return 1
        return 0

    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    free = list(long_)
    got = []
    for p in short:
        best = max(free, key=lambda q: alike(p, q), default=None)
        s = alike(p, best) if best is not None else 0
        got.append(s)
        if s:
            free.remove(best)
    if all(got) and max(got) == 2 and len(short) >= 2:
        return 2
    return 1 if 2 in got or any(_in_order(jx, f) * 3 >= 2 * max(len(jx), len(f)) for f in forms) else 0


def _in_order(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def vote_given(a: dict, b: dict) -> int:
    """0 no persons, 1 same given name, 2 initial or unknown, 3 different, 4 person and firm."""
    if not a["person"] and not b["person"]:
        return 0
    g, h = a["given"], b["given"]
    if bool(a["person"]) != bool(b["person"]):
        return 4
    if not g or not h:
        return 2
    if len(g) == 1 or len(h) == 1:
        return 2 if g[0] == h[0] else 3
    return 1 if g == h else 3


def _three(a: object, b: object) -> int:
    """0 both missing, 1 same, 2 one missing, 3 different."""
    return 0 if not a and not b else 2 if not a or not b else 1 if a == b else 3


def vote_street(a: dict, b: dict) -> int:
    if not a["road"] or not b["road"]:
        return 0
    road, house = edits(a["road"], b["road"], 2) <= 2, a["house"] == b["house"] and bool(a["house"])
    return 1 if road and house else 2 if road or house else 3


def vote_zip(a: str | None, b: str | None) -> int:
    if not a or not b:
        return 0
    return 1 if a == b else 2 if sorted(a) == sorted(b) or edits(a, b, 1) <= 1 else 3


def vote_phone(a: str | None, b: str | None) -> int:
    """2: the same exchange, another line."""
    return 0 if not a or not b else 1 if a == b else 2 if a[:5] == b[:5] and len(a) == len(b) else 3


def vote_web(a: dict, b: dict) -> int:
    """A web name also agrees with the other's name spelled out."""
    x, y = a["web"], b["web"]
    if x and y:
        return 1 if edits(x, y, 1) <= 1 else 2
    spelled = lambda r: "".join(w.rstrip(".") for w in r["core"])
    one, other = (x, spelled(b)) if x else (y, spelled(a))
    return 1 if one and one == other else 0


def votes(a: dict, b: dict) -> str:
    town = 0 if not a["town"] or not b["town"] else 1 if edits(a["town"], b["town"], 2) <= 2 else 2
    legal = 0 if not a["legal"] or not b["legal"] else 1 if a["legal"] == b["legal"] else 2
    v = (vote_name(a["core"], b["core"]), vote_given(a, b), _three(a["activity"], b["activity"]), _three(a["number"], b["number"]), vote_street(a, b), vote_zip(a["zip"], b["zip"]), town, vote_phone(a["phone"], b["phone"]), vote_web(a, b), legal)
    return "".join(map(str, v))


class LabelModel:
    """P(match) by pattern of votes: a hidden class over a tree of functions.

    ``rounds`` bounds the rounds of the independent model, which stop when no
    posterior moves; ``correlated`` is the number of rounds with the tree.
    Those only adjust the classes found before for votes that repeat each
    other: run to their end they would explain the rarer kinds of match away
    as correlation among non-matches, since either reading fits the counts."""

    def __init__(self, stances: dict[str, Sequence[int]] = STANCES, rounds: int = 200, correlated: int = 3, smooth: float = 0.5) -> None:
        self.names, self.stances = list(stances), [np.array(x) for x in stances.values()]
        self.rounds, self.correlated, self.smooth = rounds, correlated, smooth
        self.parent = [-1] * len(stances)
        self.information = [0.0] * len(stances)

    def majority(self, v: np.ndarray) -> np.ndarray:
        """Agreements less disagreements of each pattern."""
        return sum((s[v[:, j]] for j, s in enumerate(self.stances)), np.zeros(len(v)))

    def _tree(self, v: np.ndarray, w: np.ndarray, q: np.ndarray) -> None:
        """Parent of each function (-1: none) by mutual information given the class."""
        m = v.shape[1]
        info = np.full((m, m), -1.0)
        for i in range(m):
            for j in range(i):
                s = 0.0
                for c in (q, 1 - q):
                    t = np.zeros((len(self.stances[i]), len(self.stances[j]))) + 1e-6
                    np.add.at(t, (v[:, i], v[:, j]), w * c)
                    p = t / t.sum()
                    s += (w * c).sum() / w.sum() * float((p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum())
                info[i, j] = info[j, i] = s
        inside = {0}
        while len(inside) < m:
            i, j = max(((i, j) for i in inside for j in range(m) if j not in inside), key=lambda x: info[x])
            self.parent[j], self.information[j] = i, float(info[i, j])
            inside.add(j)

    def _learn(self, v: np.ndarray, w: np.ndarray, q: np.ndarray) -> None:
        """Log-probabilities of the opinions in either class, given the parent's."""
        self.tables = []
        for c in (q, 1 - q):
            wc = w * c
            own_of = []
            for j, (s, p) in enumerate(zip(self.stances, self.parent, strict=True)):
                own = np.zeros(len(s)) + self.smooth
                np.add.at(own, v[:, j], wc)
                own /= own.sum()
                if p < 0:
                    own_of.append(np.log(own)[None, :])
                    continue
                t = np.zeros((len(self.stances[p]), len(s))) + 4 * self.smooth * own
                np.add.at(t, (v[:, p], v[:, j]), wc)
                own_of.append(np.log(t / t.sum(1, keepdims=True)))
            self.tables.append((np.log(wc.sum() + 1), own_of))

    def log_odds(self, v: np.ndarray) -> np.ndarray:
        """Log-odds of a match for any patterns."""
        sides = []
        for prior, tables in self.tables:
            x = np.full(len(v), prior)
            for j, (t, p) in enumerate(zip(tables, self.parent, strict=True)):
                x += t[v[:, p] if p >= 0 else 0, v[:, j]]
            sides.append(x)
        return sides[0] - sides[1]

    def fit(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Posterior of each pattern in ``v`` (rows) with counts ``w``."""
        self.tables = [(0.0, [np.zeros((1, len(s))) for s in self.stances])] * 2
        if not len(v):
            return np.zeros(0)
        q = confidence_of(self.majority(v))
        for _ in range(self.rounds):
            self._learn(v, w, q)
            before, q = q, confidence_of(self.log_odds(v))
            if np.abs(q - before).max() < 1e-4:
                break
        for _ in range(self.correlated):
            self._tree(v, w, q)
            self._learn(v, w, q)
            q = confidence_of(self.log_odds(v))
        return q

    def report(self, v: np.ndarray, w: np.ndarray, q: np.ndarray) -> list[tuple[str, float, float, str | None, float]]:
        """(function, coverage, accuracy, function it is most correlated with,
        mutual information in nats): how often each function agrees or
        disagrees at all, and how often it is then right by the posterior."""
        out = []
        for j, name in enumerate(self.names):
            s = self.stances[j][v[:, j]] if len(v) else np.zeros(0)
            said = float((w * (s != 0)).sum())
            right = float((w * np.where(s > 0, q, np.where(s < 0, 1 - q, 0))).sum())
            parent = self.names[self.parent[j]] if self.parent[j] >= 0 else None
            out.append((name, said / max(float(w.sum()), 1.0), right / said if said else 0.0, parent, self.information[j]))
        return out


def confidence_of(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -50, 50)))


def pairs_within(keyed: DataFrame) -> DataFrame:
    """(a, b, ca, cb), a < b, of every two ``cid`` with one ``key``, and their
    ``c``; repeated if they share several.  Members of a large group are spread
    over cells, each of which meets each, so no task pairs a whole group."""
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    k = keyed.join(size.hint(MERGE), "key").withColumn("cells", F.ceil(F.col("n") / CELL)).withColumn("cell", F.pmod(F.xxhash64("cid"), F.col("cells")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    a = k.select("key", F.col("cid").alias("a"), F.col("c").alias("ca"), F.col("cell").alias("x"), every.alias("y"))
    b = k.select("key", F.col("cid").alias("b"), F.col("c").alias("cb"), F.col("cell").alias("y"), every.alias("x"))
    return a.join(b.hint(MERGE), ["key", "x", "y"]).where("a < b").select("a", "b", "ca", "cb")


def exact_place_pairs(classes: DataFrame) -> DataFrame:
    """(a, b), a < b, of contents that agree in house, road and town or postcode
    together with phone or web name, or in phone and web name, whatever their
    names and however many share them."""
    have = lambda *c: F.concat_ws("\u0001", *c)
    ok = lambda *c: F.forall(F.array(*c), lambda x: x.isNotNull())
    zip_ = F.concat_ws("", F.array_sort(F.split("zip", "")))
    combos = []
    for tag, c in (("hp", ("house", "road", "phone")), ("hw", ("house", "road", "web")), ("hz", ("house", "road", "zip")), ("pw", ("phone", "web"))):
        cols = [F.col(x) if x != "zip" else F.when(F.col("zip").isNotNull(), zip_) for x in c]
        combos.append(F.when(ok(*cols), F.xxhash64(F.lit(tag), have(*cols))))
    keyed = classes.select("cid", F.explode(F.array_compact(F.array(*combos))).alias("key"))
    return pairs_within(keyed.withColumn("c", F.lit(1.0))).select("a", "b").distinct()


def voted(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, pattern): the functions' opinions on pairs of contents."""
    a, b = (classes.select(F.col("cid").alias(x), F.struct(*name_variants.FIELDS).alias(f"r{x}")) for x in "ab")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ra, rb in zip(pdf["ra"], pdf["rb"], strict=True):
                for r in (ra, rb):
                    r["core"] = list(r["core"]) if r["core"] is not None else []
                out.append(votes(ra, rb))
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "pattern": out})

    return pairs.join(a.hint(MERGE), "a").join(b.hint(MERGE), "b").select("a", "b", "ra", "rb").mapInPandas(judge, "a long, b long, pattern string")


def closed(classes: DataFrame, judged: DataFrame, model: LabelModel, confident: float = CONFIDENT) -> DataFrame:
    """(a, b, pattern, confidence) of the matches among ``judged``, and of pairs
    that become one by a third content both match, as when one has only an
    address and the other only a phone.

    Having such a third is a vote of its own, whose weight is learned from the
    judged pairs: how many matches have one, and how many others.  It is added
    to what the model makes of the pair's other votes, so a contradiction still
    counts.  Every third content counts, however many matches it has."""
    judged = cut(judged.select("a", "b", "pattern", "confidence"))
    good = judged.where(F.col("confidence") >= confident)
    ways = good.where("a != b").select("a", "b").unionByName(good.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    third = cut(pairs_within(ways.select(F.col("a").alias("key"), F.col("b").alias("cid"), F.lit(1.0).alias("c"))).select("a", "b").distinct())
    seen = judged.where("a != b").join(third.withColumn("t", F.lit(True)).hint(MERGE), ["a", "b"], "left")
    c, has = F.col("confidence"), F.col("t").isNotNull()
    n, matches, having, matches_having = (float(x or 0) for x in seen.agg(F.count("*"), F.sum(c), F.count("t"), F.sum(F.when(has, c))).first())
    weight = np.log((matches_having + 0.5) / (matches + 1)) - np.log((having - matches_having + 0.5) / (n - matches + 1))
    again = cut(voted(classes, third.join(good.select("a", "b").hint(MERGE), ["a", "b"], "left_anti")))
    patterns = [r["pattern"] for r in again.select("pattern").distinct().collect()]
    table = _table(again.sparkSession, patterns, confidence_of(model.log_odds(_matrix(patterns)) + weight))
    more = again.join(F.broadcast(table), "pattern").where(F.col("confidence") >= confident)
    return good.unionByName(more.select("a", "b", "pattern", "confidence"))


def _matrix(patterns: Sequence[str]) -> np.ndarray:
    return np.array([[int(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), len(FUNCTIONS))


def _table(spark: SparkSession, patterns: Sequence[str], confidence: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(p, float(c)) for p, c in zip(patterns, confidence, strict=True)], "pattern string, confidence double")


def candidates(classes: DataFrame, members: DataFrame, places_too: bool = True) -> DataFrame:
    """(a, b, pattern) of all candidate pairs of contents; contents with a name
    and several members are paired with themselves."""
    named = classes.where(F.size("core") > 0).select("cid")
    several = members.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").join(named.hint(MERGE), "cid", "left_semi").select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    pairs = name_variants.candidate_pairs(classes).unionByName(several)
    if places_too:
        pairs = pairs.unionByName(exact_place_pairs(classes)).distinct()
    return cut(voted(classes, pairs))


def fitted(seen: DataFrame) -> tuple[LabelModel, list[str], np.ndarray, np.ndarray]:
    """A model of the votes in ``seen``, their patterns, counts and posteriors."""
    counts = seen.groupBy("pattern").count().orderBy("pattern").collect()
    patterns, w = [r["pattern"] for r in counts], np.array([r["count"] for r in counts], float)
    model = LabelModel()
    return model, patterns, w, model.fit(_matrix(patterns), w)


def matched(classes: DataFrame, members: DataFrame, confident: float, places_too: bool = True) -> DataFrame:
    """(a, b, pattern, confidence) of all pairs of contents that match."""
    seen = candidates(classes, members, places_too)
    model, patterns, _, q = fitted(seen)
    return closed(classes, seen.join(F.broadcast(_table(seen.sparkSession, patterns, q)), "pattern"), model, confident)


def functions_learned(rows: DataFrame) -> DataFrame:
    """function, coverage, accuracy, correlated_with, information: what the model
    learns of each matching function from the votes on ``rows``, records of all
    registers."""
    seen = candidates(*name_variants.classes_of(rows))
    model, patterns, w, q = fitted(seen)
    return rows.sparkSession.createDataFrame(model.report(_matrix(patterns), w, q), "function string, coverage double, accuracy double, correlated_with string, information double")


def match(left: DataFrame, right: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """(key_left, key_right, confidence) of records of two registers (in the form
    of ``name_variants.records``) that mean the same firm or person.

    Nulls and blanks in any attribute are abstentions; a record without a name
    matches nothing by its name.  Repeated rows count
    once; a key with several contents matches by its best.  Empty registers
    match nothing."""
    classes, members = name_variants.classes_of(left.unionByName(right))
    side = left.select("side").limit(1).collect()
    good = matched(classes, members, confident)
    own = side[0][0] if side else ""
    both = good.select("a", "b", "confidence").unionByName(good.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "confidence"))
    a, b = (members.withColumnsRenamed({"cid": x, "side": f"side_{x}", "key": f"key_{x}"}) for x in "ab")
    hit = both.join(a.where(F.col("side_a") == own).hint(MERGE), "a").join(b.where(F.col("side_b") != own).hint(MERGE), "b")
    return hit.groupBy(F.col("key_a").alias("key_left"), F.col("key_b").alias("key_right")).agg(F.max("confidence").alias("confidence"))


def variants(rows: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """(key_a, key_b, confidence), key_a < key_b, of different records of one
    register whose names are variants of one and that mean the same, judged as
    in ``match``; nulls, repeats and empty tables as there."""
    classes, members = name_variants.classes_of(rows)
    good = matched(classes, members, confident, places_too=False).where(F.substring("pattern", 1, 1) != "0")
    a, b = (members.withColumnsRenamed({"cid": x, "side": f"side_{x}", "key": f"key_{x}"}) for x in "ab")
    hit = good.join(a.hint(MERGE), "a").join(b.hint(MERGE), "b").where("side_a = side_b and key_a != key_b")
    return hit.groupBy(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).agg(F.max("confidence").alias("confidence"))
