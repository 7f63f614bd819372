import random

from tallyframe.llm import languages

PARTS = {
    "en": (["the invoice", "this account", "our auditor", "every ledger", "the report"], ["was checked before", "does not match with", "has been posted against", "will be closed after"], ["the end of the month", "another statement", "a missing voucher", "the yearly review"]),
    "de": (["die Rechnung", "dieses Konto", "unser Prüfer", "jedes Hauptbuch", "der Bericht"], ["wurde geprüft vor", "stimmt nicht überein mit", "ist gebucht worden gegen", "wird geschlossen nach"], ["dem Ende des Monats", "einem anderen Auszug", "einem fehlenden Beleg", "der jährlichen Durchsicht"]),
    "fr": (["la facture", "ce compte", "notre réviseur", "chaque grand livre", "le rapport"], ["a été vérifié avant", "ne correspond pas avec", "a été enregistré contre", "sera fermé après"], ["la fin du mois", "un autre relevé", "une pièce manquante", "la revue annuelle"]),
}


def sentence(rnd, lang):
    a, b, c = PARTS[lang]
    s = f"{rnd.choice(a)} {rnd.choice(b)} {rnd.choice(c)}"
    return s[0].upper() + s[1:] + "."


def corpus(rnd, n):
    out = []
    for i in range(n):
        lang = rnd.choice(list(PARTS))
        out.append((i, " ".join(sentence(rnd, lang) for _ in range(4)), lang if rnd.random() < 0.9 else rnd.choice(["sv", "en", "de"]), lang))
    return out


SCHEMA = "doc_id long, text string, lang string, lang_code string"


def judged(spark, docs, train=None):
    model = languages.train(spark.createDataFrame(train if train is not None else docs, SCHEMA))
    return spark.createDataFrame(docs, SCHEMA), model


def test_held_out_accuracy_with_noisy_labels(spark):
    rnd = random.Random(2)
    s = judged(spark, corpus(rnd, 300), corpus(rnd, 400))
    truth = {d: x for d, _, _, x in corpus(random.Random(2), 300)}
    got = {r.doc_id: r.lang_code for r in languages.document_languages(*s).collect()}
    assert sum(got[d] == x for d, x in truth.items()) >= 0.99 * len(truth)
    assert {r.lang_code for r in languages.label_sentences(*s).select("lang_code").distinct().collect()} == set(PARTS)  # what sv labels hold is no language


def test_cases(spark, rows):
    rnd = random.Random(4)
    en, de, fr = (lambda n=1, x=x: " ".join(sentence(rnd, x) for _ in range(n)) for x in ("en", "de", "fr"))
    docs = [
        (1, en(3), "en-GB", ""), (2, en(3), " English ", ""), (3, en(3), "ENG", ""), (4, en(3), "de", ""), (5, en(3), " ", ""), (6, en(3), None, ""), (7, en(3), "und", ""),
        (8, en(2) + " " + de(), "en", ""), (9, en(2) + "\n\n- " + fr() + "\n- " + de(), "mul", ""), (10, en(2) + " “" + de() + "”", "en", ""), (11, "12.5 | 13,00 EUR\n99 | 88 EUR 77 USD", "de", ""),
        (12, None, None, ""), (13, "", "xx", ""), (14, de(3).upper(), "DE", ""), (15, de(400), "en", ""), (None, en(2), "de", ""), (None, fr(2), "de", ""),
    ]
    s = judged(spark, docs, corpus(random.Random(1), 400))
    d = languages.document_languages(*s)
    assert rows(languages.wrong_labels(d)) == sorted([(4, "en"), (5, "en"), (6, "en"), (7, "en"), (8, "de"), (8, "en"), (9, "de"), (9, "en"), (9, "fr"), (15, "de"), (None, "en"), (None, "fr")], key=lambda r: tuple(map(str, r)))
    seg = [(r.lang_code, r.n_sentences) for r in languages.segments(*s).where("doc_id = 8").orderBy("char_start").collect()]
    assert seg == [("en", 2), ("de", 1)]
    assert all(0 < r.confidence <= 1 for r in languages.segments(*s).collect())


def test_empty_tables(spark, rows):
    s = judged(spark, [], [])
    assert rows(languages.document_languages(*s)) == [] and rows(languages.segments(*s)) == []
    assert rows(languages.label_sentences(*judged(spark, [(1, "Some text without a model at all.", "en", "")], []))) == []
