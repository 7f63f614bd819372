import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import entity_match, name_variants, names

COLS = "k string, n string, s string, z string, t string, p string, w string, side string, cid string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_segments_find_every_near_string():
    rnd = random.Random(3)
    for _ in range(3000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(3, 14)))
        b = list(a)
        for _ in range(rnd.randint(0, 2)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "c"])
        b = "".join(b)
        k = 2
        if b and levenshtein(a, b) <= k and min(len(a), len(b)) > k:
            short, long_ = sorted((a, b), key=len)
            assert set(name_variants.index_keys(short, k)) & set(name_variants.probe_keys(long_, k)), (a, b)


def test_edit_band():
    rnd = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 7))) for _ in "ab")
        d = levenshtein(a, b)
        got = names.edits(a, b, 3)
        assert got <= min(d, 4) and (got == d or got == 4 or got < d)
    assert names.edits("abcd", "abdc", 2) == 1


@pytest.mark.parametrize("name,core,rest", [
    ("Fa.  Ozpra Yofenost Catering BV", ["ozpra", "yofenost"], {"activity": "catering", "legal": "bv"}),
    ("HesfrogilVikbra Services, Inc. *old*", ["hesfrogilvikbra"], {"activity": "services", "legal": "inc"}),
    ("Stogarhes-Yocha E.", ["stogarhes", "yocha"], {"given": "e", "person": True}),
    ("Kasmunsil Tithu, Grégory", ["kasmunsil", "tithu"], {"given": "gregory", "person": True}),
    ("Mr Ted Pelgargar Umbpel", ["pelgargar", "umbpel"], {"given": "theodore", "person": True}),
    ("Instrmts 36 Hesg. Towelthu G.m.b.H.", ["hesg.", "towelthu"], {"activity": "instruments", "number": "36", "legal": "gmbh"}),
    ("Ve1klepel & Chabra Lab., Inc.", ["velklepel", "chabra"], {"activity": "laboratories"}),
    (None, [], {}), ("", [], {}), ("***", [], {}), ("  &  ", [], {}), ("x" * 50_000, ["x" * 50_000], {}),
])
def test_names_as_typed(name, core, rest):
    got = names.parse_name(name, names.Activities(["catering", "services", "instruments", "laboratories"]))
    assert got["core"] == core and all(got[k] == v for k, v in rest.items())


def test_activities_are_learned_from_a_register(spark):
    rnd = random.Random(4)
    data = []
    for i in range(3000):
        what = rnd.choice(["Zymurgy", "Zymurgy", "Falconry", "Falconries", "Glazing", "Glaz.", "Glzg", "Zymrg"] if rnd.random() < 0.3 else ["Zymurgy", "Falconry", "Glazing"])
        data.append((f"k{i}", f"{''.join(rnd.sample('abcdefghij', 6)).title()} {''.join(rnd.sample('klmnopqrst', 6)).title()} {what} {rnd.choice(['Ltd', 'GmbH', 'S.A.'])}", None, None, None, None, None, "", ""))
    a = name_variants.learn_activities(records(spark, data, "l"))
    assert sorted(a.words) == ["falconry", "glazing", "zymurgy"]
    assert [a.of(t, d) for t, d in (("zymurgy", False), ("falconries", False), ("glzg", False), ("zymrg", False), ("glaz", True), ("zym", True), ("hulim", False))] == [(True, "zymurgy"), (True, "falconry"), (True, "glazing"), (True, "zymurgy"), (True, "glazing"), (True, "zymurgy"), (False, None)]
    assert name_variants.learn_activities(records(spark, [], "l")).words == ()


def test_a_form_of_two_words_stands_for_neither():
    a = names.Activities.learned([("construction", 500, 400), ("consulting", 500, 400), ("con", 20, 18), ("cons", 20, 18), ("constr", 20, 18), ("12", 90, 80)], 2000)
    assert a.words == ("construction", "consulting") and a.short == {"con": None, "cons": None, "constr": "construction"}
    assert a.of("con", False) == (True, None)


def test_contacts():
    assert names.parse_phone("+99 966 429 4536") == names.parse_phone("00999664294536") == names.parse_phone("(0966) 429-4536") == "9664294536"
    assert names.parse_street("118 Markle Rosd") == names.parse_street("118 markle St.") == ("118", "markle")
    assert names.parse_web("https://www.a-b.example/x") == names.parse_web("Info@ab.example") == "ab"
    assert names.parse_phone(None) is None and names.parse_street("") == (None, None) and names.parse_web(" ") is None


def world(n, seed):
    """Firms in two registers, with typos, and look-alikes elsewhere; truth by id."""
    rnd = random.Random(seed)
    syl = "bar cor del fen gil hes jor kas lim mun nor ost pel que rek sil tam umb vel wix".split()
    left, right, truth = [], [], set()

    def typo(s):
        i = rnd.randrange(1, len(s) - 1)
        return s[:i] + rnd.choice("aeiou") + s[i + 1 :] if rnd.random() < 0.4 else s

    for i in range(n):
        core = ("".join(rnd.sample(syl, 3)).title(), "".join(rnd.sample(syl, 2)).title())
        what = rnd.choice(["Foods", "Metals", "Software", "Transport"])
        at = lambda: (f"{rnd.randint(1, 180)} {''.join(rnd.sample(syl, 2)).title()} Road", str(rnd.randint(10000, 99999)), "".join(rnd.sample(syl, 2)).title() + "ham", f"+99 {rnd.randint(100, 999)} {rnd.randint(100, 999)} {rnd.randint(1000, 9999)}", "".join(core).lower() + ".example")
        hide = lambda a: tuple(None if rnd.random() < 0.2 else x for x in a)
        a = at()
        left.append((f"L{i}", f"{typo(core[0])} {core[1]} {what} Ltd", *hide(a), "", ""))
        if rnd.random() < 0.7:
            right.append((f"R{i}", f"{core[1]} {typo(core[0])} {what} Limited", *hide(a), "", ""))
            truth.add((f"L{i}", f"R{i}"))
        if rnd.random() < 0.3:
            right.append((f"S{i}", f"{core[0]} {core[1]} {rnd.choice(['Security', 'Printing'])} Ltd", *hide(at()), "", ""))
    return left, right, truth


def records(spark, data, side):
    return name_variants.records(spark.createDataFrame(data, COLS), side, "k", name="n", street="s", zip="z", town="t", phone="p", web="w")


def test_matching_finds_the_truth(spark):
    left, right, truth = world(400, 1)
    got = {(r.key_left, r.key_right) for r in entity_match.match(records(spark, left, "l"), records(spark, right, "r")).collect()}
    hit = len(got & truth)
    assert hit >= 0.97 * len(truth) and hit >= 0.98 * len(got)


def test_variants_within_one_register(spark):
    left, right, truth = world(300, 2)
    got = {(r.key_a, r.key_b) for r in entity_match.variants(records(spark, left + right, "l")).collect()}
    hit = len(got & truth)
    assert hit >= 0.97 * len(truth) and hit >= 0.98 * len(got)


def test_odd_rows(spark):
    left, right, _ = world(60, 5)
    odd = [(None, "A B Ltd", "1 X Road", "1", "T", "1", "w", "", ""), ("N", None, None, None, None, None, None, "", ""), ("E", "", "", "", "", "", "", "", ""), ("G", "x" * 20_000, "1 X Road", "1", "T", "1", "w", "", ""), left[0], left[0]]
    got = entity_match.match(records(spark, left + odd, "l"), records(spark, right + odd, "r")).collect()
    assert len({(r.key_left, r.key_right) for r in got}) == len(got) and all(0 <= r.confidence <= 1 for r in got)
    assert not [r for r in got if r.key_left in "NE"]
    none = records(spark, [], "l")
    assert entity_match.match(none, records(spark, [], "r")).collect() == [] and entity_match.variants(none).collect() == []
    assert entity_match.match(none, records(spark, right, "r")).collect() == []


def test_label_model_learns_from_votes_alone():
    rnd = np.random.default_rng(0)
    sizes = list(entity_match.FUNCTIONS.values())
    n = 4000
    y = rnd.random(n) < 0.4
    v = np.zeros((n, len(sizes)), np.int64)
    pick = lambda yes, no: np.where(y, rnd.choice(*yes[:1], n, p=yes[1]), rnd.choice(*no[:1], n, p=no[1]))
    v[:, 0] = pick(([4, 3, 2], [0.7, 0.2, 0.1]), ([4, 1, 0], [0.2, 0.4, 0.4]))
    v[:, 4] = pick(([1, 0, 2], [0.75, 0.2, 0.05]), ([3, 0, 2], [0.7, 0.2, 0.1]))
    v[:, 5] = np.where(v[:, 4] == 1, pick(([1, 2, 0], [0.7, 0.1, 0.2]), ([3, 0, 0], [0.8, 0.1, 0.1])), pick(([1, 0, 0], [0.6, 0.2, 0.2]), ([3, 0, 0], [0.8, 0.1, 0.1])))
    v[:, 7] = pick(([1, 2, 0], [0.6, 0.15, 0.25]), ([3, 0, 0], [0.7, 0.15, 0.15]))
    pats, inv, count = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    model = entity_match.LabelModel()
    q = model.fit(pats, count.astype(float))
    assert ((q[inv.ravel()] > 0.5) == y).mean() > 0.98
    report = {r[0]: r for r in model.report(pats, count.astype(float), q)}
    assert report["phone"][2] > 0.95 and report["number"][1] == 0 and {report["zip"][3], report["street"][3]} & {"street", "zip"}
    assert model.fit(pats[:0], count[:0].astype(float)).size == 0


def _contents(spark, data):
    """Contents of (cid, core, town); other fields are null."""
    none = dict.fromkeys(name_variants.FIELDS)
    rows = [(c, *{**none, "core": core, "person": False, "town": t}.values()) for c, core, t in data]
    types = {"core": "array<string>", "person": "boolean"}
    return spark.createDataFrame(rows, "cid long, " + ", ".join(f"{f} {types.get(f, 'string')}" for f in name_variants.FIELDS))


def test_words_meet_in_a_town(spark):
    rnd = random.Random(8)

    def change(w, n):
        for _ in range(n):
            i = rnd.randrange(len(w))
            w = w[:i] + rnd.choice(["", "x", w[i] + "y"]) + w[i + 1 :]
        return w

    data = [(1, ["hulim", "drer."], "oldham"), (2, ["hulin", "vorbek"], "oldham"), (3, ["hulim", "other"], "farham"), (4, ["mo", "abcd."], "oldham")]
    for i in range(10, 150):
        size = rnd.choice([4, 5, 6, 7, 8, 9, 24, 25, 26, 27, 40])
        w = "".join(rnd.choice("abc") for _ in range(size))
        data += [(2 * i, [w, f"rest{i}zzzz"], rnd.choice(["oldham", "farham"])), (2 * i + 1, ["quo" * (i % 3 + 1), change(w, rnd.randint(0, 2))], rnd.choice(["oldham", "farham"]))]
    near = lambda x, y: levenshtein(x, y) <= (2 if min(len(x), len(y)) >= 8 else 1)
    long_ = lambda c: [w for w in c if len(w) >= 4 and not w.endswith(".")]
    want = {(a, b) for a, x, s in data for b, y, t in data if a < b and s == t and any(near(u, v) for u in long_(x) for v in long_(y))}
    got = {(r.a, r.b) for r in name_variants.candidate_pairs(_contents(spark, data)).collect()}
    assert (1, 2) in want and want <= got


def test_names_meet_where_no_place_can_be_compared(spark):
    rnd = random.Random(15)
    field = {"zip": "12345", "town": "oldham", "phone": "9664294536", "web": "abc", "house": "12"}
    rows, none = [], dict.fromkeys(name_variants.FIELDS)
    for i in range(120):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(5, 11)))
        v = list(w)
        for _ in range(rnd.randint(0, 2)):
            v[rnd.randrange(len(v))] = rnd.choice("abcx")
        for j, core in ((0, [w, "tail"]), (1, ["".join(v), "tail"] if i % 2 else ["tail", "".join(v)])):
            has = {k: (x if k != "phone" else str(i * 2 + j)) for k, x in field.items() if rnd.random() < 0.3}
            rows.append((2 * i + j, *{**none, "core": core, "person": False, **has, "road": "markle" if "house" in has else None}.values()))
    types = {"core": "array<string>", "person": "boolean"}
    c = spark.createDataFrame(rows, "cid long, " + ", ".join(f"{f} {types.get(f, 'string')}" for f in name_variants.FIELDS))
    at = [0, *[1 + name_variants.FIELDS.index(f) for f in ("core", "zip", "town", "phone", "web", "house")]]
    short = [[r[k] for k in at] for r in rows]
    apart = lambda x, y: not any(p and q for p, q in zip(x[2:], y[2:], strict=True))
    want = {(x[0], y[0]) for x in short for y in short if x[0] < y[0] and apart(x, y) and min(levenshtein("".join(x[1]), f) for f in names.orders(y[1])) <= 1}
    got = {(r.a, r.b) for r in name_variants.unplaced_pairs(c).collect()}
    by = {x[0]: x for x in short}
    assert want and want <= got and all(apart(by[a], by[b]) for a, b in got)


def test_places_shared_by_many(spark, monkeypatch):
    monkeypatch.setattr(entity_match, "CELL", 20)
    c = _contents(spark, [(i, [f"n{i}"], None) for i in range(120)])
    c = c.withColumns({"house": F.lit("12"), "road": F.lit("markle"), "phone": F.lit("9664294536")})
    assert sorted((r.a, r.b) for r in entity_match.exact_place_pairs(c).collect()) == [(a, b) for a in range(120) for b in range(a + 1, 120)]


def test_pairs_through_any_third(spark):
    ids = [1, 2, 3, 10, 20, *range(11, 16), *range(21, 26)]
    c = _contents(spark, [(i, ["hulimbar"], "oldham") for i in ids])
    links = [(1, 3), (2, 3), (1, 10), (2, 20), *((10, i) for i in range(11, 16)), *((20, i) for i in range(21, 26))]
    judged = spark.createDataFrame([(a, b, "4" + "0" * 9, 0.9) for a, b in links], "a long, b long, pattern string, confidence double")
    model = entity_match.LabelModel()
    v = entity_match._matrix(["4010111000", "4000101000", "3000011000", "0030332000", "0000302000", "0030032000"])
    model.fit(v, np.full(6, 1000.0))
    beside = lambda x: {b if a == x else a for a, b in links if x in (a, b)}
    want = {(a, b) for a in ids for b in ids if a < b and ((a, b) in links or beside(a) & beside(b))}
    got = {(r.a, r.b): r.confidence for r in entity_match.closed(c, judged, model).collect()}
    assert set(got) == want and 0.5 <= got[1, 2] <= 1


def test_short_whole_names_meet_across_every_length(spark):
    rnd = random.Random(12)
    data = [(1, ["abel", "fox"], "oldham"), (2, ["abell", "fox"], "oldham")]
    for i in range(2, 150):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(6, 9)))
        v = w
        for _ in range(rnd.randint(0, 2)):
            j = rnd.randrange(len(v))
            v = v[:j] + rnd.choice(["", "x", v[j] + "y"]) + v[j + 1 :]
        data += [(2 * i, [w], "oldham"), (2 * i + 1, [v], "oldham")]
    want = {(a, b) for a, x, _ in data for b, y, _ in data if a < b and levenshtein("".join(x), "".join(y)) <= 2}
    got = {(r.a, r.b) for r in name_variants.candidate_pairs(_contents(spark, data)).collect()}
    assert (1, 2) in want and want <= got


def _broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Broadcast")


def test_growing_tables_are_not_gathered_at_the_driver(spark):
    data = [(f"k{i}", f"Pelmun Zanthu{i} Foods Ltd", f"{i} Oak St", "12345", "Limford", f"0908 63396{i:02d}", None, "", "") for i in range(12)]
    classes, members = name_variants.classes_of(records(spark, data, "l"))
    pairs = classes.select(F.col("cid").alias("a")).crossJoin(classes.select(F.col("cid").alias("b"))).where("a < b").localCheckpoint()
    for df in (name_variants.near_words(spark.createDataFrame([("pelmun",), ("pelmum",)], "word string")), name_variants.town_words(classes), name_variants.unplaced_pairs(classes), name_variants.verified(classes, pairs), entity_match.exact_place_pairs(classes), entity_match.voted(classes, pairs)):
        assert _broadcasts(df) == 0


def test_members_are_not_gathered_at_the_driver(spark, monkeypatch):
    data = [(f"k{i}", f"Pelmun Zanthu{i % 3} Foods Ltd", "1 Oak St", "12345", "Limford", "0908 6339600", None, "", "") for i in range(6)]
    pairs = spark.createDataFrame([(1, 2, "4000000000", 0.9)], "a long, b long, pattern string, confidence double")
    monkeypatch.setattr(entity_match, "matched", lambda *x, **k: pairs)
    rows_ = records(spark, data, "l")
    assert _broadcasts(entity_match.variants(rows_)) == 0 and _broadcasts(entity_match.match(rows_, rows_)) == 0
