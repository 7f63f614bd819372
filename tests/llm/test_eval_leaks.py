import random

from tallyframe.llm import eval_leaks

WORDS = [f"{a}{b}" for a in ("al", "be", "cor", "dun", "ev", "fi") for b in ("na", "to", "mik", "res", "ul")]


def find(spark, docs, items):
    d = spark.createDataFrame([(*x, "own") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, "own") for x in items], "item_id long, item_text string, answer string, doc_id string")
    return {(r.doc_id, r.item_id): r for r in eval_leaks.find_leaks(d, i).collect()}


ITEM = "Zur Prüfung: the quick (brown) fox's œuvre jumps over 1,234.50 lazy dogs near Zürich while nobody watches it closely today"


def test_notation_and_edges(spark):
    w = ITEM.split()
    docs = [
        (1, "so " + " ".join(w[2:14]) + ". Ende"),
        (2, "so " + " ".join(w[2:13]) + " unlike"),  # eleven words
        (3, "<b>THE</b> quick-BROWN fox’s oeu­vre ju-\nmps&nbsp;over 1234.50 LAZY\tdogs near Zürich whi le nobody watches"),
        (4, None), (5, ""), (6, "xx" + "".join(w[2:14])), (7, ITEM), (8, "a" * 300_000 + " " + " ".join(w[3:16]) + " " + "b " * 100_000),
        (None, ITEM), (2**60 + 1, ITEM), (9, "bathe " + " ".join(w[3:14]) + "!"),  # the first word is no word of its own
    ]
    got = find(spark, docs, [(1, ITEM, "4,379.05 EUR"), (1, ITEM, "4,379.05 EUR"), (2, None, None), (3, "too short", ""), (None, ITEM, "x")])
    assert set(got) == {(1, 1), (3, 1), (7, 1), (8, 1), (None, 1), (2**60 + 1, 1)}
    assert got[7, 1].n_words == len(w)
    text = dict(docs)[1]
    assert text[got[1, 1].char_start : got[1, 1].char_end].rstrip(".") == " ".join(w[2:14])
    text = dict(docs)[8]
    assert text[got[8, 1].char_start : got[8, 1].char_end] == " ".join(w[3:16])


def test_empty_tables(spark):
    assert find(spark, [], [(1, ITEM, "a")]) == {} and find(spark, [(1, ITEM)], []) == {}


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(5)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(8, 40))), None) for i in range(40)]
    docs = []
    for d in range(120):
        w = [rnd.choice(WORDS) for _ in range(30)]
        for _ in range(2):
            own = rnd.choice(items)[1].split()
            a = rnd.randrange(len(own))
            w[10:10] = own[a : a + rnd.randint(9, 15)]
        docs.append((d, " ".join(w)))

    def leaks(doc, item):
        a, b = doc.split(), item.split()
        runs = {tuple(a[i : i + 12]) for i in range(len(a) - 11)}
        return any(tuple(b[i : i + 12]) in runs for i in range(len(b) - 11))

    want = {(d, i) for d, t in docs for i, x, _ in items if leaks(t, x)}
    assert len(want) > 30 and set(find(spark, docs, items)) == want
    monkeypatch.setattr(eval_leaks, "BLOCK_CHARS", 2000)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, item_text string, answer string")
    assert {(r.doc_id, r.item_id) for r in eval_leaks.find_leaks(d, i, block_chars=2000).collect()} == want


def test_passages_parted_by_a_change_of_equal_length(spark):
    rnd = random.Random(7)
    w = [f"{rnd.choice(WORDS)}{rnd.choice(WORDS)}" for _ in range(60)]

    def changed(*at):
        return " ".join("q" + x[1:] if i in at else x for i, x in enumerate(w))

    docs = [(1, changed(8)), (2, changed(8, 20, 33)), (3, changed(*range(8, 60, 9))), (4, "xy " + changed(7, 19, 59))]
    got = find(spark, docs, [(1, " ".join(w), None)])
    assert {d: r.n_words for (d, _), r in got.items()} == {1: 51, 2: 26, 4: 39}
    text = dict(docs)[2]
    assert text[got[2, 1].char_start : got[2, 1].char_end] == " ".join(w[34:])
