"""Mixing sources to target weights by Pfair scheduling.

A source's records, repeated as often as allowed, are laid end to end in tokens
and cut into blocks.  A source of weight w has its k-th block (from 0) released
at slot floor(k / w) and due by slot ceil((k + 1) / w); in each slot the released
block with the earliest deadline goes next.  With weights that add up to one
every deadline is met, so at any point no source is a whole block away from its
share.  Weights are exact fractions, which makes the schedule periodic: one
period is worked out on the driver, and a record's slot follows from its block
number, so all records find their place at once.

A mix has a size in tokens.  A source that may not be repeated often enough for
its share of it gives all it may and ends; the others go on at their weights
among themselves, in a phase of the schedule of its own, and make up the size.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import cut, spread

#: Most slots of a period.  Weights whose common denominator is larger become multiples of its inverse, none of them 0.
PERIOD = 100_000
#: Tokens of a block, and records of a bucket within which offsets are summed in order.
BLOCK_TOKENS, BUCKET_ROWS = 1024, 20_000
#: Place of the vocabulary (public byte-level BPE ranks) and its splitting pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which that vocabulary splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def source_form(c: Column) -> Column:
    """Source names without case, outer blanks, hyphens and underscores; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "[-_]", ""), F.lit(""))


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``documents`` (doc_id, source, text) as doc_id, source, n_tokens and h, a hash
    of id and text, counted over whole texts; null and empty texts have none.  The vocabulary file must
    be at that path on every worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": n, "h": pdf["h"]})

    # ids travel as text: pandas has no integer column with nulls
    own = documents.select(F.col("doc_id").cast("string"), source_form(F.col("source")).alias("source"), "text", F.xxhash64("doc_id", "text").alias("h"))
    return spread(own).mapInPandas(run, "doc_id string, source string, n_tokens long, h long").withColumn("doc_id", F.col("doc_id").cast("long"))


def in_period(weights: dict[str, float], most: int = PERIOD) -> dict[str, int]:
    """Weights as slots of a period: exactly, over their common denominator, if
    that is at most ``most``; else over ``most`` by largest remainders, with one
    slot at least for each weight (what a source gets in all is bounded by its
    share of the mix, whatever the slots)."""
    exact = {k: Fraction(repr(float(w))).limit_denominator(10**9) for k, w in weights.items()}
    total = sum(exact.values())
    exact = {k: w / total for k, w in exact.items()}
    period = math.lcm(*(w.denominator for w in exact.values()))
    if period <= most:
        return {k: int(w * period) for k, w in exact.items()}
    out = {k: max(1, int(w * most)) for k, w in exact.items()}
    rest = most - sum(out.values())
    for k in sorted(weights, key=lambda k: (out[k] - exact[k] * most, k))[: max(0, rest)]:
        out[k] += 1
    return out


def pfair(slots: dict[str, int]) -> list[str]:
    """The source of each slot of one period, earliest deadline first among released blocks."""
    period = sum(slots.values())
    due: list[tuple[int, str, int]] = []
    coming = [(0, k, 0) for k, n in slots.items() if n]
    heapq.heapify(coming)
    order = []
    for t in range(period):
        while coming and coming[0][0] <= t:
            _, k, i = heapq.heappop(coming)
            heapq.heappush(due, (-(-(i + 1) * period // slots[k]), k, i))
        _, k, i = heapq.heappop(due)
        order.append(k)
        if i + 1 < slots[k]:
            heapq.heappush(coming, ((i + 1) * period // slots[k], k, i + 1))
    return order


def largest_lag(order: list[str], slots: dict[str, int]) -> float:
    """The most that any source is ahead or behind its share, in blocks."""
    period, seen, worst = len(order), dict.fromkeys(slots, 0), 0.0
    for t, k in enumerate(order, 1):
        seen[k] += 1
        worst = max(worst, max(abs(seen[x] - t * n / period) for x, n in slots.items()))
    return worst


def sizes_of_mix(weights: dict[str, float], most: dict[str, int], tokens: float) -> dict[str, float]:
    """Tokens that each source gives to a mix of ``tokens``: its share, or all it
    may (``most``) where that is less; the others make up for it in proportion
    to their weights.  Where all give all they may, the mix is smaller."""
    out: dict[str, float] = {}
    left = dict(weights)
    while left:
        scale = max(0.0, tokens - sum(out.values())) / sum(left.values())
        short = [k for k, w in left.items() if scale * w >= most[k]]
        if not short:
            return {**out, **{k: scale * w for k, w in left.items()}}
        for k in short:
            out[k] = float(most[k])
            del left[k]
    return out


@dataclass(frozen=True)
class Part:
    """What a mix takes of a source: blocks of ``block`` tokens, one more or fewer for rounding."""

    mix: str
    source: str
    label: str
    share: float
    max_repeats: int
    available: int
    blocks: int
    block: int


@dataclass(frozen=True)
class Phase:
    """A stretch of a mix in which the same sources take turns: its first slot,
    the order of one period, and the first and last block (exclusive) of each source."""

    mix: str
    number: int
    slot: int
    order: tuple[str, ...]
    first: dict[str, int]
    last: dict[str, int]


def phases(mix: str, weights: dict[str, float], blocks: dict[str, int], period: int = PERIOD) -> list[Phase]:
    """The phases of a mix: each ends when a source has given its ``blocks``."""
    out: list[Phase] = []
    first, slot = dict.fromkeys(blocks, 0), 0
    live = {k for k, n in blocks.items() if n > 0}
    while live:
        slots = in_period({k: weights[k] for k in live}, period)
        order = pfair(slots)
        at: dict[str, list[int]] = {k: [] for k in live}
        for t, k in enumerate(order):
            at[k].append(t)
        # the slot after which the first source has nothing left
        end = min((blocks[k] - first[k] - 1) // slots[k] * len(order) + at[k][(blocks[k] - first[k] - 1) % slots[k]] + 1 for k in live)
        full, rest = divmod(end, len(order))
        last = {k: first[k] + full * slots[k] + bisect.bisect_left(at[k], rest) for k in live}
        out.append(Phase(mix, len(out), slot, tuple(order), {k: first[k] for k in live}, last))
        first, slot = {**first, **last}, slot + end
        live = {k for k in live if first[k] < blocks[k]}
    return out


def plan(targets: list[tuple[str, str, str, float, int]], sizes: dict[str, int], block: int = BLOCK_TOKENS, period: int = PERIOD, tokens: int | None = None, keep_shares: bool = False) -> tuple[list[Part], list[Phase]]:
    """Parts and phases of all mixes.  ``targets``: mix, source in comparable
    form, source as written, share, most repeats.

    A mix has ``tokens`` tokens, by default as many as its heaviest source can
    give its share of (lighter ones that cannot end alone); with ``keep_shares``
    only as many as leave every share exact, which its scarcest source decides.  Sources without tokens get nothing and the others
    keep their proportions.  Blocks are of at most ``block`` tokens, and of so
    few that the source that gives least still has one; last blocks are partial."""
    parts: list[Part] = []
    all_phases: list[Phase] = []
    for mix in sorted({t[0] for t in targets}):
        own = [t for t in targets if t[0] == mix]
        weights = {t[1]: t[3] for t in own if t[3] > 0 and t[4] > 0 and sizes.get(t[1], 0) > 0}
        most = {t[1]: t[4] * sizes[t[1]] for t in own if t[1] in weights}
        size, blocks = block, {}
        if weights:
            whole, heaviest = sum(weights.values()), max(weights.values())
            total = min(most[k] for k, w in weights.items() if w == heaviest) / heaviest * whole if tokens is None else float(tokens)
            if keep_shares:
                total = min(total, min(most[k] / w for k, w in weights.items()) * whole)
            give = sizes_of_mix(weights, most, total)
            size = max(1, min(block, int(min(give.values()))))
            blocks = {k: max(1, -(-int(n) // size)) for k, n in give.items()}
        all_phases += phases(mix, weights, blocks, period)
        parts += [Part(mix, s, label, share, cap, sizes.get(s, 0), blocks.get(s, 0), size) for _, s, label, share, cap in own]
    return parts, all_phases


def _targets(mix_targets: DataFrame) -> list[tuple[str, str, str, float, int]]:
    """One row per mix and source: shares of repeated rows add up only if the rows differ."""
    t = mix_targets.select(F.trim("mix_name").alias("m"), source_form(F.col("source")).alias("s"), F.trim("source").alias("l"), "target_share", F.coalesce("max_repeats", F.lit(1)).alias("r")).where("m is not null and s is not null and target_share is not null").distinct()
    g = t.groupBy("m", "s").agg(F.min("l").alias("l"), F.sum("target_share").alias("w"), F.max("r").alias("r"))
    return [(r.m, r.s, r.l, float(r.w), int(r.r)) for r in g.collect()]


def offsets(counted: DataFrame, sizes: dict[str, tuple[int, int]]) -> DataFrame:
    """Adds ``start``: the tokens of the source before the record, in the order
    of their hashes.  Sums run within buckets of about ``BUCKET_ROWS``
    records, and over the buckets' totals, so no source is put in one task."""
    spark = counted.sparkSession
    n = spark.createDataFrame([(s, max(1, math.ceil(rows / BUCKET_ROWS))) for s, (_, rows) in sizes.items()] or [("", 1)], "source string, n_buckets long")
    b = counted.join(F.broadcast(n), "source").withColumn("bucket", F.pmod(F.xxhash64("h"), F.col("n_buckets")))
    totals = b.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = totals.withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    within = b.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return within.join(before, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))


def mix(documents: DataFrame, mix_targets: DataFrame, block: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY, period: int = PERIOD, tokens: int | None = None, keep_shares: bool = False) -> tuple[DataFrame, list[Part], list[Phase]]:
    """All mixes: rows (mix_name, slot, source, block, start, doc_id, repeat,
    n_tokens), the parts they are made of, and the phases of the schedule
    (``tokens`` and ``keep_shares`` as in ``plan``).

    A record belongs to the block in which its first token falls, so sources are
    off by less than a block and a record.  Records with a null source belong to
    no mix; records without tokens go along with their neighbours; repeated rows
    are records of their own.  A mix without usable sources has no rows.  What
    is collected is one row per source of a mix and its token count.
    """
    spark = documents.sparkSession
    targets = _targets(mix_targets)
    wanted = spark.createDataFrame([(s,) for s in sorted({t[1] for t in targets})] or [("",)], "source string")
    counted = cut(count_tokens(documents.join(F.broadcast(wanted.withColumnRenamed("source", "__s")), source_form(F.col("source")) == F.col("__s"), "left_semi"), vocabulary))
    sizes = {r.source: (r.t, r.n) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    parts, stretches = plan(targets, {s: t for s, (t, _) in sizes.items()}, block, period, tokens, keep_shares)
    used = [(p.mix, p.source, p.available, min(p.max_repeats, -(-p.blocks * p.block // p.available)), p.block) for p in parts if p.blocks]
    table = spark.createDataFrame(used or [("", "", 1, 1, 1)], "mix_name string, source string, size long, repeats long, block_tokens long")
    turns, place = [], []
    for p in stretches:
        for s in p.first:
            turns.append((p.mix, s, p.number, p.first[s], p.last[s], p.slot, p.order.count(s), len(p.order)))
        seen: dict[str, int] = {}
        for at, s in enumerate(p.order):
            place.append((p.mix, s, p.number, seen.get(s, 0), at))
            seen[s] = seen.get(s, 0) + 1
    # phases and one period of each: rows bounded by the targets, not by the documents
    turn = spark.createDataFrame(turns or [("", "", 0, 0, 0, 0, 1, 1)], "mix_name string, source string, phase int, first long, last long, slot0 long, slots long, period long")
    at = spark.createDataFrame(pd.DataFrame(place or [("", "", 0, 0, 0)], columns=["mix_name", "source", "phase", "k", "at"]), "mix_name string, source string, phase int, k long, at long")
    rows = offsets(counted, sizes).join(F.broadcast(table), "source")
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)))
    rows = rows.withColumn("start", F.col("repeat") * F.col("size") + F.col("start")).withColumn("block", F.floor(F.col("start") / F.col("block_tokens")))
    rows = rows.join(F.broadcast(turn), ["mix_name", "source"]).where("block >= first and block < last")
    rows = rows.withColumn("k", (F.col("block") - F.col("first")) % F.col("slots"))
    placed = rows.join(F.broadcast(at) if len(place) <= 500_000 else at, ["mix_name", "source", "phase", "k"])
    slot = F.col("slot0") + F.floor((F.col("block") - F.col("first")) / F.col("slots")) * F.col("period") + F.col("at")
    return placed.select("mix_name", slot.alias("slot"), "source", "block", "start", "doc_id", "repeat", "n_tokens"), parts, stretches


def shares(rows: DataFrame, parts: list[Part], stretches: list[Phase]) -> DataFrame:
    """Per mix and source: target and actual share, tokens, records, repeats, and
    the largest lag of the schedule in blocks, behind the weights of the sources
    that take turns."""
    spark = rows.sparkSession
    lag: dict[str, float] = {}
    for p in stretches:
        lag[p.mix] = max(lag.get(p.mix, 0.0), largest_lag(list(p.order), {s: p.order.count(s) for s in p.first}))
    schema = "mix_name string, source string, name string, target_share double, max_repeats int, available_tokens long, largest_lag double"
    t = spark.createDataFrame([(p.mix, p.source, p.label, p.share, p.max_repeats, p.available, lag.get(p.mix, 0.0)) for p in parts], schema)
    got = rows.groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_records"), F.max(F.col("repeat") + 1).alias("repeats_used"))
    all_ = t.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "n_records", "repeats_used"])
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return all_.select("mix_name", F.col("name").alias("source"), "target_share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)).alias("actual_share"), "tokens", "n_records", "available_tokens", "max_repeats", "repeats_used", "largest_lag")
