"""Languages of documents and of their sentences.

Multinomial naive Bayes over hashed character n-grams, trained here on the
documents' own labels.  Labels are noisy, so training is done twice: models of
two halves judge each other's sentences first, and only sentences whose label
is borne out train the final model.  The matrix of log-probabilities has a
fixed size and is broadcast; batches of sentences are hashed and scored as
arrays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import cut, release, spread

#: Hash buckets of n-grams, and lengths of n-grams.
BITS, NGRAMS = 15, (1, 2, 3, 4)
BUCKETS = 1 << BITS
#: Bound of the training sample, in documents for each label.
DOCS_PER_LABEL = 3000
#: A label is learned if at least this share of its sentences is borne out by the other half.
BORNE_OUT = 0.5
#: Sentences need this many words of letters to count, and this lead per n-gram to leave their document's main language.
LEAST_WORDS, LEAD = 3, 0.05
#: Nats per n-gram are multiplied by this for a confidence; n-grams of one text are far from independent.
SHARPNESS = 12.0

#: ISO 639 codes and English names of languages.
LANGUAGES = """
en eng english|de deu ger german|fr fra fre french|es spa spanish castilian|pt por portuguese|it ita italian|nl nld dut dutch flemish
sv swe swedish|pl pol polish|da dan danish|no nor norwegian|nb nob bokmal|nn nno nynorsk|fi fin finnish|is isl ice icelandic|cs ces cze czech|sk slk slo slovak
sl slv slovenian|hu hun hungarian|ro ron rum romanian|bg bul bulgarian|el ell gre greek|tr tur turkish|ru rus russian|uk ukr ukrainian
sr srp serbian|hr hrv croatian|et est estonian|lv lav latvian|lt lit lithuanian|ga gle irish|cy cym wel welsh|ca cat catalan|gl glg galician|eu eus baq basque|la lat latin
zh zho chi chinese|ja jpn japanese|ko kor korean|vi vie vietnamese|th tha thai|id ind indonesian|ms msa may malay|hi hin hindi|ar ara arabic|he heb hebrew|fa fas per persian
"""


def language_codes() -> dict[str, str]:
    """Every known notation of a language and its two-letter code."""
    return {form: names[0] for names in (x.split() for x in re.split(r"[|\n]", LANGUAGES) if x.strip()) for form in names}


def label_code(label: Column) -> Column:
    """The two-letter code a label names (region, script, case, three letters or
    English name make no difference); null where it names no language."""
    form = F.regexp_extract(F.lower(F.trim(label)), r"^(\p{L}+)(?:[-_ ].*)?$", 1)
    known = F.create_map(*[F.lit(x) for pair in language_codes().items() for x in pair])
    return F.try_element_at(known, form)


_QUOTED = re.compile(r"“[^“”\n]{0,300}”|«[^«»\n]{0,300}»|„[^„“”\n]{0,300}[“”]|\"[^\"\n]{0,300}\"")
_PIECES = re.compile(r"[^\n]+(?:\n(?!\s*\n|\s*[-*•] )[^\n]+)*")
_END = re.compile(r"(?<=[.?!…])[\"”»)\]]*\s+(?=[^a-zß-ÿ]|[a-zß-ÿ]\w*\s)")
_WORD = re.compile(r"[^\W\d_]{2,}")
_FIGURE = re.compile(r"\d")
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&[a-z]+;|\*\*")


def sentences(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, words to judge, whole) of a text's sentences and fragments.
    Blank lines, list items and sentence ends part; quotations and markup are
    left out of what is judged, as are parts with fewer letters than figures.  Whole: it ends as a sentence does and has
    enough words."""
    out = []
    for piece in _PIECES.finditer(text):
        at = piece.start()
        body = piece.group()
        cuts = [m.span() for m in _END.finditer(body)] + [(len(body), len(body))]
        begin = 0
        for a, b in cuts:
            # closing marks belong to the sentence they follow
            part = body[begin:b]
            own = _QUOTED.sub(" ", _MARKUP.sub(" ", part))
            words = _WORD.findall(own)
            if len(words) >= LEAST_WORDS and sum(map(len, words)) > len(_FIGURE.findall(own)):
                whole = bool(re.search(r"[.?!…][\"”»)\]]*\s*$", part)) and not re.search(r"…[\"”»)\]]*\s*$", part)
                out.append((at + begin, at + begin + len(part.rstrip()), own, whole))
            begin = b
    return out


def _letters(text: str) -> str:
    return " " + _NOT_LETTERS.sub(" ", unicodedata.normalize("NFC", text).casefold()).strip() + " "


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, and the index of each one's text."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters of the text from here on
    buckets, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(NGRAMS) + 1):
            shifted = np.zeros_like(codes)
            shifted[: len(codes) - n + 1] = codes[n - 1 :]
            h = (h ^ shifted) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
            if n in NGRAMS:
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                ok = left >= n
                buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int32)[ok])
                owners.append(owner[ok])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """Log-probabilities, one row for each bucket, one column for each language."""

    langs: tuple[str, ...]
    logp: np.ndarray

    def parts(self) -> tuple[tuple[str, ...], np.ndarray]:
        """What is broadcast: plain values, so workers need no class of ours."""
        return self.langs, self.logp

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text under each language, and its n-grams."""
        forms = [_letters(t) for t in texts]
        buckets, owner = hashed(forms)
        n = np.bincount(owner, minlength=len(forms)).astype(float)
        out = np.zeros((len(forms), len(self.langs)))
        if self.langs and len(owner):
            # owners rise within each length of n-gram: sums over runs of one owner
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            np.add.at(out, owner[starts], np.add.reduceat(self.logp[buckets], starts, axis=0))
        return out, n


def model_of(counts: dict[str, np.ndarray]) -> Model:
    langs = tuple(sorted(counts))
    if not langs:
        return Model((), np.zeros((BUCKETS, 0), np.float32))
    c = np.stack([counts[x] for x in langs], axis=1) + 0.2
    return Model(langs, np.log(c / c.sum(axis=0)).astype(np.float32))


def _counts(sample: DataFrame, judge=None) -> dict[tuple[int, str], np.ndarray]:
    """N-gram counts by (half, label).  Summed before anything is collected, which
    is then bounded by buckets and labels.  ``judge``: broadcast models by half;
    a sentence counts if the other half's model gives it its label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, str], np.ndarray] = {}
        for pdf in batches:
            for (half, label), g in pdf.groupby(["half", "label"]):
                parts = [s[2] for t in g["text"] for s in sentences(t)]
                if judge is not None and parts:
                    m = Model(*judge.value[1 - half])
                    if label not in m.langs:
                        continue
                    sc, _ = m.scores(parts)
                    parts = [p for p, k in zip(parts, sc.argmax(axis=1), strict=True) if m.langs[k] == label]
                forms = [_letters(p) for p in parts]
                for f in (forms, [_bare(x) for x in forms]):
                    b, _ = hashed(f)
                    one = sums.setdefault((half, label), np.zeros(BUCKETS))
                    one += np.bincount(b, minlength=BUCKETS)
        for (half, label), v in sums.items():
            at = np.flatnonzero(v)
            yield pd.DataFrame({"half": half, "label": label, "bucket": at, "n": v[at]})

    rows = sample.mapInPandas(count, "half int, label string, bucket int, n double").groupBy("half", "label", "bucket").agg(F.sum("n").alias("n"))
    out: dict[tuple[int, str], np.ndarray] = {}
    for (half, label), g in rows.toPandas().groupby(["half", "label"]):
        v = np.zeros(BUCKETS)
        v[g["bucket"].to_numpy()] = g["n"].to_numpy()
        out[(int(half), label)] = v
    return out


def _borne_out(sample: DataFrame, judge) -> dict[str, float]:
    """Share of each label's sentences that the other half's model gives the label."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (half, label), g in pdf.groupby(["half", "label"]):
                parts = [s[2] for t in g["text"] for s in sentences(t)]
                m = Model(*judge.value[1 - half])
                hit = 0
                if parts and label in m.langs:
                    sc, _ = m.scores(parts)
                    hit = int((sc.argmax(axis=1) == m.langs.index(label)).sum())
                yield pd.DataFrame({"label": [label], "n": [len(parts)], "hit": [hit]})

    rows = sample.mapInPandas(score, "label string, n long, hit long").groupBy("label").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).collect()
    return {r["label"]: r["hit"] / r["n"] for r in rows if r["n"]}


def train(documents: DataFrame, docs_per_label: int = DOCS_PER_LABEL) -> Model:
    """Fits the model on at most about ``docs_per_label`` documents of each label,
    drawn by a hash of their id.  No labels, no languages."""
    spark: SparkSession = documents.sparkSession
    labelled = documents.select("doc_id", "text", label_code(F.col("lang")).alias("label")).where("label is not null and text is not null")
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not sizes:
        return model_of({})
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, docs_per_label / v))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1_000_000)) / 1_000_000
    sample = labelled.where(draw < F.element_at(share, F.col("label"))).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    # read three times below; its size is bounded by labels and docs_per_label
    sample = cut(spread(sample.select("half", "label", "text")))
    first = _counts(sample)
    halves = spark.sparkContext.broadcast([model_of({k: v for (h, k), v in first.items() if h == half}).parts() for half in (0, 1)])
    good = {k for k, v in _borne_out(sample, halves).items() if v >= BORNE_OUT}
    kept = _counts(sample.where(F.col("label").isin(*good)) if good else sample.limit(0), halves)
    total: dict[str, np.ndarray] = {}
    for (_, k), v in kept.items():
        total[k] = total.get(k, 0) + v
    release(sample)
    return model_of(total)


def judge_text(model: Model, text: str | None) -> list[tuple[int, int, bool, str, float]]:
    """(start, end, whole, language, confidence) of a text's sentences."""
    return judge_texts(model, [text])[0]


def judge_texts(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, bool, str, float]]]:
    parts = [sentences(t) if isinstance(t, str) else [] for t in texts]
    flat = [s[2] for p in parts for s in p]
    if not model.langs or not flat:
        return [[] for _ in texts]
    sc, n = model.scores(flat)
    each = sc / np.maximum(n, 1)[:, None]
    best = each.argmax(axis=1)
    soft = np.exp(SHARPNESS * (each - each.max(axis=1, keepdims=True)))
    soft /= soft.sum(axis=1, keepdims=True)
    out, at = [], 0
    for p in parts:
        rows = []
        if p:
            own = slice(at, at + len(p))
            main = int(sc[own].sum(axis=0).argmax()) if len(p) == 1 else int(np.bincount(best[own], weights=n[own], minlength=len(model.langs)).argmax())
            for i, (a, b, _, whole) in enumerate(p, at):
                k = int(best[i])
                if k != main and each[i, k] - each[i, main] < LEAD:
                    k = main
                rows.append((a, b, whole, model.langs[k], float(soft[i, k])))
            at += len(p)
        out.append(rows)
    return out


def _per_text(documents: DataFrame, model: Model, rows_of: Callable, schema: str) -> DataFrame:
    """Rows that ``rows_of`` makes of a text's judged sentences, without a shuffle:
    a text's sentences never leave its batch."""
    sent = documents.sparkSession.sparkContext.broadcast(model.parts())
    names = ["doc_id", "label", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model(*sent.value)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                yield pd.DataFrame([(d, lab, *row) for d, lab, judged in zip(part["doc_id"], part["label"], judge_texts(own, part["text"].tolist()), strict=True) if judged for row in rows_of(judged)], columns=names)

    # ids travel as text: pandas has no integer column with nulls
    docs = documents.select(F.col("doc_id").cast("string"), label_code(F.col("lang")).alias("label"), "text")
    return spread(docs).mapInPandas(run, f"doc_id string, label string, {schema}").withColumn("doc_id", F.col("doc_id").cast("long"))


def label_sentences(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, label (code the document's label names, or null), char_start,
    char_end, whole, lang_code, confidence: a row for each sentence.  Null and
    empty texts and texts without words give none."""
    return _per_text(documents, model, lambda judged: judged, "char_start int, char_end int, whole boolean, lang_code string, confidence double")


def runs(judged: list[tuple[int, int, bool, str, float]]) -> list[tuple[str, int, int, int, float]]:
    """(language, start, end, sentences, confidence by length) of runs of one language."""
    out: list[list] = []
    for a, b, _, lang, conf in judged:
        if not out or out[-1][0] != lang:
            out.append([lang, a, b, 0, 0.0, 0])
        r = out[-1]
        r[2], r[3], r[4], r[5] = b, r[3] + 1, r[4] + conf * (b - a), r[5] + b - a
    return [(r[0], r[1], r[2], r[3], r[4] / max(r[5], 1)) for r in out]


def segments(documents: DataFrame, model: Model) -> DataFrame:
    """Runs of sentences of one language: doc_id, label, lang_code, char_start,
    char_end, n_sentences, confidence (mean by length)."""
    return _per_text(documents, model, runs, "lang_code string, char_start int, char_end int, n_sentences int, confidence double")


def main_language(judged: list[tuple[int, int, bool, str, float]]) -> list[tuple[str, float, list[str]]]:
    size: dict[str, float] = {}
    sure: dict[str, float] = {}
    for a, b, _, lang, conf in judged:
        size[lang] = size.get(lang, 0.0) + b - a
        sure[lang] = sure.get(lang, 0.0) + conf * (b - a)
    best = max(size, key=lambda k: (size[k], k))
    return [(best, sure[best] / max(sum(size.values()), 1.0), sorted({x[3] for x in judged if x[2]}))]


def document_languages(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, label, lang_code (main language, by length), confidence (its share
    of the text times the mean confidence) and whole_langs, the languages with a
    whole sentence; a row for each text with sentences."""
    return _per_text(documents, model, main_language, "lang_code string, confidence double, whole_langs array<string>")


def wrong_labels(doc_rows: DataFrame) -> DataFrame:
    """(doc_id, lang_code) of documents with a whole sentence whose label is
    missing, names another language, or that have whole sentences in more than
    one; a row for each of those languages."""
    langs = F.col("whole_langs")
    case = F.col("label").isNull() | (F.size(langs) > 1) | ~F.array_contains(langs, F.col("label"))
    return doc_rows.where((F.size(langs) > 0) & case).select("doc_id", F.explode(langs).alias("lang_code"))
