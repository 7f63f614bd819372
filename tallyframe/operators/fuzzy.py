"""Similarity joins on the Indel ratio, and what is built on them.

Two texts of lengths m and n with ratio at least t differ by at most
(1 - t)(m + n) insertions and deletions, so one of that many plus one segments
of the one stands in the other.  Candidates meet on such segments, within the
lengths the ratio allows, instead of in a product of all texts; a bound from
lengths and letters and the exact ratio follow.  Texts too short to be cut that
often into two letters or more, as with a low threshold (below about 85 for
texts of 20 letters), meet by length alone, each pair once and in cells, so
that no task has all texts of a length.  That part is quadratic in the texts of
like length, which such thresholds ask for: they call most of them near.

Where only the best match of each text is asked for, all pairs of like length
meet instead: of counts of letters, the differences add up to no more than the
insertions and deletions between two texts, and with a bit for the first, second
... of each letter they are counted a machine word at a time.  Only pairs that
differ by no more than the best match met so far allows are compared, many at a
time.  That is quadratic as well, at a few nanoseconds a pair, and holds a few
parts of the texts and a cell of their pairs at once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tallyframe.functions.similarity import indel, indel_ratio, similarity
from tallyframe.session import cut, release

#: Cells into which the texts of one length are spread where they meet by length alone.
CELLS = 16
#: Texts of the left side met at once, letters and texts in a part, parts of the right side in a task, pairs compared and signs of pairs at a time.
BLOCK, LETTERS, PART, TURNS, PAIRS, CELL = 4096, 1 << 22, 100_000, 10, 1 << 15, 1 << 17
#: Numbers of bits in a sign that are taken for one.
SIMILAR = 2
#: Letters of a text that fit in a machine word; kinds of letters that are counted apart, up to which count, in how many words of signs.
WORD, KINDS, EXACT, WORDS = 64, 96, 4, 4
_KEYS = StructType([StructField("ix", ArrayType(LongType())), StructField("pr", ArrayType(LongType()))])


def _lengths(n: int, t: float) -> tuple[int, int]:
    """Lengths that texts within ratio t of one of length n may have."""
    return math.ceil(n * t / (2 - t) - 1e-9), math.floor(n * (2 - t) / t + 1e-9)


def _cuts(n: int, t: float) -> tuple[int, list[tuple[int, int]]]:
    """The edits allowed for a text of length n, and its segments (start, length)."""
    k = math.floor((1 - t) * (n + _lengths(n, t)[1]) + 1e-9)
    if 2 * (k + 1) > n:  # segments of single letters would let pairs meet many times over
        return k, []
    short, longer = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = short + (i > k - longer)
        out.append((at, size))
        at += size
    return k, out


def segment_keys(text: str, t: float) -> tuple[list[tuple], list[tuple]]:
    """Keys under which a text is filed, and under which it looks for others."""
    n = len(text)
    _, own = _cuts(n, t)
    ix = [(n, i, text[a : a + s]) for i, (a, s) in enumerate(own)] or [(n, -1, str(zlib.crc32(text.encode()) % CELLS))]
    pr: set[tuple] = set()
    lo, hi = _lengths(n, t)
    for m in range(lo, hi + 1):
        k, cuts = _cuts(m, t)
        k = min(k, math.floor((1 - t) * (m + n) + 1e-9))
        if not cuts:
            pr |= {(m, -1, str(c)) for c in range(CELLS)}
        for i, (a, s) in enumerate(cuts):
            # of the segments that survive, one has at most i edits before and k - i after it
            lo_p, hi_p = max(0, a - i, a + n - m - (k - i)), min(n - s, a + i, a + n - m + (k - i))
            pr |= {(m, i, text[p : p + s]) for p in range(lo_p, hi_p + 1)}
    return ix, sorted(pr)


def _keyed(values: DataFrame, t: float) -> DataFrame:
    @F.pandas_udf(_KEYS)
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        def h(x: tuple) -> int:
            v = xxhash.xxh64_intdigest("\u0001".join(map(str, x)))
            return v - (1 << 64) if v >= 1 << 63 else v

        for s in batches:
            rows = [segment_keys(x, t) for x in s]
            yield pd.DataFrame({"ix": [[h(k) for k in r[0]] for r in rows], "pr": [[h(k) for k in r[1]] for r in rows]})

    return values.select("v", keys("v").alias("k"))


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of all values of one-column frames ``left`` and ``right``
    (column v) with an Indel ratio of at least ``threshold`` percent.  Repeats
    count once; nulls match nothing; two empty texts score 100."""
    t = max(threshold, 1e-6) / 100
    a, b = left.where("v is not null").distinct(), right.where("v is not null").distinct()
    pr = _keyed(a, t).select(F.col("v").alias("a"), F.explode("k.pr").alias("key"))
    ix = _keyed(b, t).select(F.col("v").alias("b"), F.explode("k.ix").alias("key"))
    la, lb = F.length("a"), F.length("b")
    met = pr.join(ix, "key").where(200.0 * F.least(la, lb) >= F.lit(float(threshold)) * (la + lb))
    # an edit distance is never more than insertions and deletions alone; this check is banded, stays in the JVM, and
    # comes before pairs are moved to be counted once
    most = F.floor((1 - t) * (la + lb) + 1e-9).cast("int")
    near = met.withColumn("most", most).where(F.expr("levenshtein(a, b, most) >= 0")).select("a", "b").distinct()
    return near.withColumn("score", indel("a", "b")).where(F.col("score") >= threshold)


class Block:
    """Texts with their letters as numbers (0: none) and counts of kinds of letters."""

    def __init__(self, texts: list[str], letters: dict[str, int]) -> None:
        self.texts, self.n = texts, np.array([len(x) for x in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        number = np.zeros(int(points.max(initial=0)) + 1, np.int32)
        for c in np.flatnonzero(np.bincount(points)):
            number[c] = letters.setdefault(chr(c), len(letters) + 1)
        codes = number[points]
        row = np.repeat(np.arange(len(texts)), self.n)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.codes = np.zeros((max(int(self.n.max()), 1), len(texts)), np.int32)  # letters of one place side by side
        self.codes[at, row] = codes
        counts = np.bincount(row * KINDS + codes % KINDS, minlength=len(texts) * KINDS).reshape(len(texts), KINDS)
        self.counts = np.minimum(counts, EXACT).astype(np.uint8)

    @cached_property
    def kinds(self) -> list[tuple[int, int]]:
        """Kinds of letters and how many of them: what about half of the texts have comes first, as it tells most apart."""
        share = np.array([(self.counts >= k).mean(0) for k in range(1, EXACT + 1)])
        return [(x % KINDS, x // KINDS + 1) for x in np.argsort(-(share * (1 - share)).ravel(), kind="stable")[: 64 * WORDS].tolist()]

    def signs(self, kinds: list[tuple[int, int]]) -> np.ndarray:
        """A bit for each of ``kinds`` that a text has so many of; words by texts."""
        bits = self.counts[:, [c for c, _ in kinds]] >= np.array([k for _, k in kinds])
        return np.ascontiguousarray(np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64).T)

    @cached_property
    def alike(self) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """The texts' places by length and bits of the first sign (by ``SIMILAR``), their signs in that order, and of each such pair the first and end."""
        signs = self.signs(self.kinds)
        ones = np.bitwise_count(signs[0]).astype(np.int64) // SIMILAR * SIMILAR
        order = np.lexsort((ones, self.n))
        both, start = np.unique((self.n * 128 + ones)[order], return_index=True)
        ends = [*start[1:].tolist(), len(order)]
        return order, np.ascontiguousarray(signs[:, order]), [(x >> 7, x & 127, lo, hi) for x, lo, hi in zip(both.tolist(), start.tolist(), ends, strict=True)]

    def masks(self, letters: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Where each letter stands in each text, a bit each; the place of letters in it; its width."""
        own = np.unique(self.codes)
        own = own[own > 0]
        place = np.full(letters + 1, len(own), np.int64)  # letters that these texts do not have
        place[own] = np.arange(len(own))
        out = np.zeros((len(self.texts), len(own) + 1), np.uint64)
        for i, c in enumerate(self.codes[:WORD]):
            have = np.flatnonzero(c)
            out[have, place[c[have]]] |= np.uint64(1 << i)
        return out.ravel(), place, len(own) + 1


def ratios(a: Block, masks: tuple[np.ndarray, np.ndarray, int], b: Block, ai: np.ndarray, bi: np.ndarray) -> np.ndarray:
    """Indel ratios of pairs of texts in two blocks, as ``indel_ratio``."""
    if a.n.max() > WORD:
        return np.array([indel_ratio(a.texts[i], b.texts[j]) for i, j in zip(ai, bi, strict=True)], float)
    out = np.empty(len(ai))
    where, place, width = masks
    full = np.array([(1 << int(n)) - 1 for n in a.n], np.uint64)
    for lo in range(0, len(ai), PAIRS):
        i, j = ai[lo : lo + PAIRS], bi[lo : lo + PAIRS]
        base, s = i * width, np.full(len(i), np.uint64(0xFFFFFFFFFFFFFFFF))
        for c in b.codes[: int(b.n[j].max())]:
            u = s & where.take(base + place.take(c.take(j)))
            s = (s + u) | (s - u)
        both = a.n[i] + b.n[j]
        out[lo : lo + PAIRS] = np.where(both == 0, 100.0, 200.0 * (a.n[i] - np.bitwise_count(s & full[i])) / np.maximum(both, 1))
    return out


def best_of(a: Block, blocks: list[Block], threshold: float, letters: int) -> list[tuple[str, str, float]]:
    """(a, b, score): the best match in ``blocks`` of each text of a block, the least of equals."""
    best, who = np.full(len(a.texts), float(threshold)), [None] * len(a.texts)
    better(a, blocks, best, who, letters)
    return [(x, y, float(s)) for x, y, s in zip(a.texts, who, best, strict=True) if y is not None]


def better(a: Block, blocks: list[Block], best: np.ndarray, who: list[str | None], letters: int) -> None:
    """Puts matches in ``blocks`` that are better than ``best`` in it, and their texts in ``who``.
    Texts of nearest length come first, and of those the pairs whose letters
    differ least, as what they reach spares most of the others."""
    masks = a.masks(letters)

    def edits(ai: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Insertions and deletions between a text and one of length n that reach its best match."""
        return np.floor((1 - best[ai] / 100) * (a.n[ai] + n) + 1e-6).astype(np.int64)

    def take(b: Block, ai: np.ndarray, bi: np.ndarray) -> None:
        score = ratios(a, masks, b, ai, bi)
        good = np.flatnonzero(score >= best[ai])
        for k in good[np.argsort(-score[good], kind="stable")]:
            i, v, x = ai[k], score[k], b.texts[bi[k]]
            if v > best[i] or v == best[i] and (who[i] is None or x < who[i]):
                best[i], who[i] = v, x

    def compare(b: Block, found: list[tuple[np.ndarray, ...]]) -> None:
        ai, bi, differ = map(np.concatenate, zip(*found, strict=True))
        turns = np.argsort(differ / np.maximum(a.n[ai] + b.n[bi], 1), kind="stable")
        at = 0
        while at < len(turns):
            size = max(len(a.texts), at)
            k = turns[at : at + size]
            k = k[differ[k] <= edits(ai[k], b.n[bi[k]])]  # what was met so far spares some
            if len(k):
                take(b, ai[k], bi[k])
            at += size

    every = np.arange(len(a.texts))
    own = [a.signs(b.kinds) for b in blocks]
    has = [np.bitwise_count(x[0]).astype(np.int64) for x in own]
    middle, usual = float(np.median(a.n)), [float(np.median(x)) for x in has]
    met = sorted((abs(n - middle), n, k, abs(p - usual[k]), p, lo, hi) for k, b in enumerate(blocks) for n, p, lo, hi in b.alike[2])
    found, many = [], 0
    words, ones, near = np.empty(CELL, np.uint64), np.empty(CELL, np.uint8), np.zeros(CELL, bool)
    for at, (_, n, k, _, p, lo, hi) in enumerate(met):
        b, mine = blocks[k], own[k]
        order, theirs, _ = b.alike
        if not at or met[at - 1][1:3] != (n, k):
            most, rest = edits(every, n), n - a.n + has[k]
        # letters without a bit in the first sign differ in number at least
        first = most - np.maximum(np.abs(2 * (rest - p) - SIMILAR + 1) - SIMILAR + 1, 0) // 2
        rows = np.flatnonzero(first >= np.maximum(np.abs(2 * (has[k] - p) - SIMILAR + 1) - SIMILAR + 1, 0) // 2)
        for left in range(lo, hi, CELL):
            cols = theirs[0, left : min(left + CELL, hi)]
            step = CELL // len(cols)
            for r in range(0, len(rows), step):
                i = rows[r : r + step]
                size = len(i) * len(cols)
                w, o, m = (x[:size].reshape(len(i), -1) for x in (words, ones, near))
                np.bitwise_xor(mine[0, i][:, None], cols, out=w)
                np.bitwise_count(w, out=o)
                np.less_equal(o, np.clip(first[i], 0, 64).astype(np.uint8)[:, None], out=m)
                near[size : size + -size % 8] = False
                eight = np.flatnonzero(near[: size + -size % 8].view(np.uint64) != 0)  # few are near
                if not len(eight):
                    continue
                bit = np.flatnonzero(near.reshape(-1, 8)[eight])
                y, x = np.divmod(eight[bit >> 3] * 8 + (bit & 7), len(cols))
                ai, bi = i[y], left + x
                differ = o[y, x].astype(np.int64)
                for word in range(1, WORDS):  # instead of their number, each of them
                    differ += np.bitwise_count(mine[word, ai] ^ theirs[word, bi])
                    ok = differ <= most[ai]
                    ai, bi, differ = ai[ok], bi[ok], differ[ok]
                found.append((ai, order[bi], differ))
                many += len(ai)
                if many >= 8 * PAIRS:
                    compare(b, found)
                    found, many = [], 0
        if many and (at + 1 == len(met) or met[at + 1][1:3] != (n, k)):
            compare(b, found)
            found, many = [], 0


def _blocks(values: DataFrame, x: str, texts: int) -> DataFrame:
    """Parts of distinct values ``v``: the values, their least and greatest length.  A part
    has about ``texts`` values, all of up to a word of letters or all of like length."""
    n = F.length("v")
    kind = F.when(n <= WORD, 0).otherwise(WORD + 1 + F.floor(8 * F.log2(n / WORD))).cast("int")
    v = values.select("v", kind.alias("kind"), n.alias("n"))
    cells = v.groupBy("kind").agg(F.ceil(F.greatest(F.count("*") / texts, F.sum("n") / LETTERS)).alias("cells"))
    cell = F.when(F.col("cells") > 1, F.pmod(F.xxhash64("v"), F.col("cells"))).otherwise(0)
    grouped = v.join(cells, "kind").groupBy("kind", cell.alias("cell")).agg(F.collect_list("v").alias(x), F.min("n").alias(f"lo_{x}"), F.max("n").alias(f"hi_{x}"))
    return cut(grouped.select(F.concat_ws("-", "kind", "cell").alias(f"id_{x}"), x, f"lo_{x}", f"hi_{x}"))


def best_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score): for each value of one-column frame ``left`` (column v) the best
    match among those of ``right`` with an Indel ratio of at least ``threshold``
    percent; ties go to the least value.  Nulls match nothing; two empty texts score 100."""
    a, b = (cut(x.where("v is not null").distinct()) for x in (left, right))
    # not by broadcast, which would gather a table that grows with the data at the driver
    same = a.join(b.hint("merge"), "v").where(F.lit(float(threshold)) <= 100).select(F.col("v").alias("a"), F.col("v").alias("b"), F.lit(100.0).alias("score"))
    if threshold >= 100:
        return same
    rest, bb = cut(a.join(b.hint("merge"), "v", "left_anti")), _blocks(b, "b", PART)
    cores = a.sparkSession.sparkContext.defaultParallelism
    # a task has one part of the left side and some of the right, whose matches spare it work; as many tasks as keep all cores busy
    turns = math.ceil(bb.count() / TURNS)
    ba = _blocks(rest, "a", min(PART // 2, max(BLOCK // 8, math.ceil(rest.count() * turns / (4 * cores)))))
    ba, bb = ba.repartitionByRange(max(1, ba.count()), "id_a"), bb.repartitionByRange(max(1, turns), "id_b")  # one and as many a task
    # some lengths in the two parts allow the ratio
    near = (200.0 * F.col("hi_a") + 1e-6 >= threshold * (F.col("hi_a") + F.greatest("hi_a", "lo_b"))) & (200.0 * F.col("hi_b") + 1e-6 >= threshold * (F.col("hi_b") + F.greatest("hi_b", "lo_a")))
    met = ba.hint("shuffle_replicate_nl").join(bb, near).select("id_a", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters: dict[str, int] = {}
        now, own = None, []

        def said() -> Iterator[pa.RecordBatch]:
            for block, best, who in own:
                k = [i for i, y in enumerate(who) if y is not None]
                yield pa.RecordBatch.from_arrays([pa.array([block.texts[i] for i in k], pa.string()), pa.array([who[i] for i in k], pa.string()), pa.array(best[k], pa.float64())], ["a", "b", "score"])

        for batch in batches:
            ids_a, va, vb = batch.columns
            for k in range(batch.num_rows):
                if ids_a[k].as_py() != now:
                    yield from said()
                    now, texts = ids_a[k].as_py(), sorted(va[k].as_py(), key=len)
                    blocks = [Block(texts[lo : lo + BLOCK], letters) for lo in range(0, len(texts), BLOCK)]
                    own = [(x, np.full(len(x.texts), float(threshold)), [None] * len(x.texts)) for x in blocks]
                right = Block(vb[k].as_py(), letters)
                for block, best, who in own:
                    better(block, [right], best, who, len(letters))
        yield from said()

    return same.unionByName(met.mapInArrow(run, "a string, b string, score double"))


def difflib_matches(words: DataFrame, word: str, candidates: DataFrame, candidate: str, n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """(word, candidate, similarity, rank): the ``n`` best candidates of each
    word by the Ratcliff-Obershelp ratio, from ``cutoff`` on; ties go to the
    greater candidate.  That ratio never exceeds the Indel ratio, since matching
    blocks are a common subsequence, so the similarity join finds all of them."""
    from pyspark.sql import Window

    one = lambda df, c: df.select(F.col(f"`{c}`").cast("string").alias("v"))
    near = similar_pairs(one(words, word), one(candidates, candidate), cutoff * 100)
    scored = near.withColumn("s", similarity("b", "a")).where(F.col("s") >= cutoff)
    w = Window.partitionBy("a").orderBy(F.desc("s"), F.desc("b"))
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return best.select(F.col("a").alias("word"), F.col("b").alias("candidate"), similarity("a", "b").alias("similarity"), "rank")


def fuzzy_match(a: DataFrame, column_a: str, b: DataFrame, column_b: str, threshold: float = 80) -> DataFrame:
    """(value_a, value_b, score): for each distinct value of ``a`` its best match
    in ``b``; ties go to the least value."""
    one = lambda df, c: df.select(F.col(f"`{c}`").cast("string").alias("v"))
    s = best_pairs(one(a, column_a), one(b, column_b), threshold)
    return s.groupBy("a").agg(F.max("score").alias("score"), F.min_by("b", F.struct(-F.col("score"), "b")).alias("value_b")).select(F.col("a").alias("value_a"), "value_b", "score")


def fuzzy_dedupe(df: DataFrame, column: str, threshold: float = 90, order: str | None = None) -> DataFrame:
    """(value, leader, score): groups of alike values as a reader going through
    them in order would make them: a value joins the first leader it is like, or
    leads.  Order: the least ``order`` of a value's rows, or the value itself.

    Leaders are the lexicographically first maximal independent set of the
    similarity graph, found in rounds; a value left without an undecided earlier
    neighbour leads, and its neighbours follow."""
    c = F.col(f"`{column}`").cast("string")
    nodes = df.select(c.alias("v"), *([F.col(f"`{order}`").alias("o")] if order else [])).where("v is not null").groupBy("v").agg((F.min("o") if order else F.min(F.lit(0))).alias("o"))
    pairs = similar_pairs(nodes.select("v"), nodes.select("v"), threshold).where("a != b")
    rank = nodes.select("v", F.struct("o", "v").alias("k"))
    # (a before b): every edge once, from the earlier to the later value
    edges = pairs.join(rank.withColumnsRenamed({"v": "a", "k": "ka"}), "a").join(rank.withColumnsRenamed({"v": "b", "k": "kb"}), "b").where("ka < kb").select("a", "b", "score", "ka")
    edges = cut(edges)
    open_ = cut(nodes.select("v"))
    leaders = cut(open_.limit(0))
    while True:
        live = edges.join(open_.withColumnRenamed("v", "a"), "a", "left_semi").join(open_.withColumnRenamed("v", "b"), "b", "left_semi")
        lead = cut(open_.join(live.select(F.col("b").alias("v")).distinct(), "v", "left_anti"))
        follow = edges.join(lead.withColumnRenamed("v", "a"), "a", "left_semi").select(F.col("b").alias("v")).unionByName(lead)
        leaders, old, last = cut(leaders.unionByName(lead)), leaders, open_
        open_ = cut(open_.join(follow.distinct(), "v", "left_anti"))
        release(old)
        release(last)
        if not open_.limit(1).count():
            break
    mine = edges.join(leaders.withColumnRenamed("v", "a"), "a", "left_semi").groupBy("b").agg(F.min_by(F.struct("a", "score"), "ka").alias("m"))
    led = leaders.select(F.col("v").alias("value"), F.col("v").alias("leader"), F.lit(100.0).alias("score"))
    return led.unionByName(mine.join(leaders.withColumnRenamed("v", "b"), "b", "left_anti").select(F.col("b").alias("value"), F.col("m.a").alias("leader"), F.col("m.score").alias("score")))


def close_matches(words: DataFrame, word: str, candidates: DataFrame, candidate: str, n: int = 5, cutoff: float = 60) -> DataFrame:
    """(word, candidate, score, rank): the ``n`` best candidates of each word."""
    from pyspark.sql import Window

    s = similar_pairs(words.select(F.col(f"`{word}`").alias("v")), candidates.select(F.col(f"`{candidate}`").alias("v")), cutoff)
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(F.col("a").alias("word"), F.col("b").alias("candidate"), "score", "rank")
