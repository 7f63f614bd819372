import random

import pytest

from tallyframe.llm import source_mix

SCHEMA = "doc_id long, source string, text string, slot string, start string"


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.715, "b": 0.285}, {"a": 0.9, "b": 0.05, "c": 0.03, "d": 0.02}])
def test_no_source_is_a_block_off(weights):
    slots = source_mix.in_period(weights, 1000)
    period = sum(slots.values())
    assert period <= 1000 and all(slots[k] / period == pytest.approx(w) for k, w in weights.items())
    order = source_mix.pfair(slots)
    assert {k: order.count(k) for k in slots} == slots
    assert source_mix.largest_lag(order, slots) < 1


def test_random_weights_keep_every_deadline():
    rnd = random.Random(0)
    for _ in range(20):
        slots = source_mix.in_period({f"s{i}": rnd.random() + 0.01 for i in range(rnd.randint(2, 12))}, 500)
        order = source_mix.pfair(slots)
        for s, n in slots.items():
            at = [t for t, x in enumerate(order) if x == s]
            for k, t in enumerate(at):
                assert k * 500 // n <= t < -(-(k + 1) * 500 // n)


def docs(spark, n=400):
    rnd = random.Random(1)
    data = [(i, rnd.choice(["Big-One", "big_one ", "BIGONE", "bigone", "small"]), "word " * rnd.randint(1, 60), "x", "y") for i in range(n)]
    return spark.createDataFrame([*data, (n, None, "text", "", ""), (n + 1, "small", None, "", ""), (n + 2, "small", "", "", ""), (3, "big one", "word", "", "")], SCHEMA)


def test_shares_repeats_and_whole_records(spark):
    t = spark.createDataFrame([("m", "BIG ONE", 0.0, 1), ("m", "big-one", 0.5, 1), ("m", "Small", 0.5, 3), ("gap", "none", 0.4, 2), ("gap", "small", 0.6, 2), ("nil", "none", 1.0, 1), (None, "small", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    d = docs(spark)
    rows, parts, orders = source_mix.mix(d, t, block=64, keep_shares=True)
    rows = rows.cache()
    s = {(r.mix_name, r.source): r for r in source_mix.shares(rows, parts, orders).collect()}
    assert abs(s["m", "big-one"].actual_share - 0.5) < 0.02 and s["m", "Small"].repeats_used in (2, 3)
    assert s["gap", "small"].actual_share == 1.0 and s["gap", "none"].tokens == 0 and s["nil", "none"].tokens == 0
    assert all(r.repeats_used <= r.max_repeats and r.largest_lag < 1 for r in s.values())
    size = {r.doc_id: r.n_tokens for r in source_mix.count_tokens(d).where("source = 'small'").collect()}
    got = [r for r in rows.where("mix_name = 'gap'").orderBy("slot", "start", "n_tokens").collect()]
    assert all(r.n_tokens == size[r.doc_id] for r in got)
    at = 0
    for r in got:  # records lie end to end
        assert r.start == at
        at += r.n_tokens
    # a mix is a sequence in which no source is more than a block and a record ahead or behind
    seen, total, worst = {}, 0, 0
    for r in rows.where("mix_name = 'm'").orderBy("slot", "start", "n_tokens").collect():
        seen[r.source] = seen.get(r.source, 0) + r.n_tokens
        total += r.n_tokens
        worst = max(worst, abs(seen.get("small", 0) - total / 2))
    assert worst <= 64 + 2 * 61


def test_offsets_do_not_depend_on_buckets(spark, monkeypatch):
    c = source_mix.count_tokens(docs(spark)).where("source is not null").cache()
    sizes = {r.source: (r.t, r.n) for r in c.groupBy("source").agg({"n_tokens": "sum", "*": "count"}).toDF("source", "t", "n").collect()}
    for bucket in (20_000, 17):
        monkeypatch.setattr(source_mix, "BUCKET_ROWS", bucket)
        for s, (t, _) in sizes.items():
            at = 0
            for r in source_mix.offsets(c, sizes).where(f"source = '{s}'").orderBy("start", "n_tokens").collect():
                assert r.start == at
                at += r.n_tokens
            assert at == t


def test_empty_tables(spark):
    t = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    d = docs(spark)
    for x, y in ((d.limit(0), t), (d, t.limit(0)), (d.limit(0), t.limit(0))):
        rows, parts, orders = source_mix.mix(x, y)
        assert rows.count() == 0 and all(r.tokens == 0 for r in source_mix.shares(rows, parts, orders).collect())


def test_tokens_round_trip(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(source_mix.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=source_mix.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Grüße <|endoftext|> 12,5 %", "a\n\n b", "x" * 5000]
    d = spark.createDataFrame([(i, "s", x, "", "") for i, x in enumerate(texts)], SCHEMA)
    assert [r.n_tokens for r in source_mix.count_tokens(d).orderBy("doc_id").collect()] == [len(enc.encode_ordinary(x)) for x in texts]
    assert all(enc.decode(enc.encode_ordinary(x)) == x for x in texts)


def test_scarce_source_is_used_to_its_end(spark):
    d = spark.createDataFrame([(0, "tiny", "word " * 40, "", ""), *[(i, "large", "word " * 50, "", "") for i in range(1, 200)]], SCHEMA)
    t = spark.createDataFrame([("m", "tiny", 0.1, 3), ("m", "large", 0.9, 2), ("n", "tiny", 0.002, 30), ("n", "large", 0.998, 1)], "mix_name string, source string, target_share double, max_repeats int")
    got = {(r.mix_name, r.source): r for r in source_mix.shares(*source_mix.mix(d, t, keep_shares=True)).collect()}
    tiny, large = got["m", "tiny"], got["m", "large"]
    assert tiny.n_records == tiny.repeats_used == 3 and tiny.tokens == 3 * tiny.available_tokens
    assert abs(large.tokens - 9 * tiny.tokens) <= 60
    # the last block of a source used up is partial
    assert got["n", "large"].tokens == got["n", "large"].available_tokens and 1 <= got["n", "tiny"].repeats_used <= 30
    # without it the scarce source ends alone and the mix has its size
    free = {(r.mix_name, r.source): r for r in source_mix.shares(*source_mix.mix(d, t)).collect()}
    tiny, large = free["m", "tiny"], free["m", "large"]
    assert tiny.tokens == 3 * tiny.available_tokens and large.tokens == 2 * large.available_tokens
    assert large.repeats_used == 2 and large.largest_lag < 1


def test_no_mix_is_emptied_and_no_source_vanishes():
    targets = [("m", "huge", "huge", 0.999, 1), ("m", "tiny", "tiny", 0.001, 1), ("n", "huge", "huge", 0.99996, 1), ("n", "other", "other", 0.00004, 1)]
    parts, stretches = source_mix.plan(targets, {"huge": 10**9, "tiny": 300, "other": 10**7})
    got = {(p.mix, p.source): p for p in parts}
    assert got["m", "tiny"].blocks * got["m", "tiny"].block >= 300 and got["m", "huge"].blocks * got["m", "huge"].block >= 10**9 - 10**4
    other = got["n", "other"]
    assert abs(other.blocks * other.block - 0.00004 / 0.99996 * 10**9) <= 2 * other.block
    assert len({p.mix for p in stretches}) == 2


def test_phases_cover_every_block_once():
    rnd = random.Random(6)
    for _ in range(30):
        names = [f"s{i}" for i in range(rnd.randint(1, 6))]
        weights = {k: rnd.choice([0.1, 0.25, 0.3, rnd.random()]) for k in names}
        blocks = {k: rnd.choice([0, 1, 7, rnd.randint(1, 3000)]) for k in names}
        slots = {}
        for p in source_mix.phases("m", weights, blocks, 400):
            period = len(p.order)
            for k in p.first:
                at = [t for t, x in enumerate(p.order) if x == k]
                for b in range(p.first[k], p.last[k]):
                    i = b - p.first[k]
                    slots[k, b] = p.slot + i // len(at) * period + at[i % len(at)]
        assert set(slots) == {(k, b) for k, n in blocks.items() for b in range(n)}
        assert sorted(slots.values()) == list(range(len(slots)))  # no slot is empty or taken twice
