"""Evaluation texts leaking into training text.

Texts are folded to a stream of letters and digits, without markup, accents,
case, punctuation or blanks, so hyphenation, line breaks and odd spacing leave
no trace.  One Aho-Corasick automaton holds the answers and aligned blocks of
``ANCHOR`` words of every item: a run of ``2 * ANCHOR`` words contains such a
block whole, so one pass over a document meets every long enough passage.  Each
hit is extended word by word on both sides, and its place in the original text
is looked up.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import spread

#: Words in a row that make a leak, and words of an anchor (half of them).
LEAST_WORDS, ANCHOR = 12, 6
#: Folded characters from which an answer has a place in the automaton; shorter ones are looked up where their item is found.
SHORT_ANSWER = 5
#: Characters of item text in one automaton; more items than that go in further passes.
BLOCK_CHARS = 16_000_000

_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,500}>|<!--.*?-->|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});", re.S)
_OUT = re.compile(r"[\W_]+")
#: Letters without a decomposition.
_LETTERS = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def fold(text: str) -> str:
    """Letters and digits of a text without markup, in base letters and lower case."""
    if "<" in text or "&" in text:
        text = _MARKUP.sub(lambda m: html.unescape(m.group()) if m.group()[0] == "&" else "", text)
    return _OUT.sub("", unicodedata.normalize("NFKD", text).casefold().translate(_LETTERS))


def _plain(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters) of the original's pieces without markup."""
    at = 0
    for m in _MARKUP.finditer(text):
        yield from ((i, i + 1, text[i]) for i in range(at, m.start()))
        if m.group()[0] == "&":
            yield m.start(), m.end(), html.unescape(m.group())
        at = m.end()
    yield from ((i, i + 1, text[i]) for i in range(at, len(text)))


def offsets(text: str) -> tuple[list[int], list[int], list[bool]]:
    """For each character of ``fold(text)``: start and end in ``text``, and
    whether a word may begin there; one more entry for the end."""
    starts: list[int] = []
    ends: list[int] = []
    edge: list[bool] = []
    open_ = True
    for a, b, piece in _plain(text):
        kept = fold(piece)
        if not kept:
            # a soft hyphen or an accent is no edge
            if not all(unicodedata.category(c) in ("Mn", "Cf") for c in piece):
                open_ = True
            continue
        for k in range(len(kept)):
            starts.append(a)
            ends.append(b)
            edge.append(open_ and k == 0)
        open_ = False
    edge.append(True)
    return starts, ends, edge


class Items:
    """The automaton over items of (id, text, answer), and how to extend a hit."""

    def __init__(self, items: list[tuple[int, str | None, str | None]], least: int = LEAST_WORDS) -> None:
        import ahocorasick

        self.least = least
        block = max(1, least // 2)
        self.streams: list[tuple[int, str, list[int]]] = []
        self.short: list[str] = []
        patterns: dict[str, list[tuple[int, int]]] = {}
        for item_id, text, answer in items:
            # markup is taken out before words are told apart
            plain = _MARKUP.sub(lambda m: html.unescape(m.group()) if m.group()[0] == "&" else "", text or "")
            words = [w for w in map(fold, plain.split()) if w]
            bounds = [0]
            for w in words:
                bounds.append(bounds[-1] + len(w))
            me = len(self.streams)
            self.streams.append((item_id, "".join(words), bounds))
            for i in range(0, len(words) - block + 1, block):
                patterns.setdefault("".join(words[i : i + block]), []).append((me, bounds[i]))
            a = fold(answer or "")
            self.short.append(a if len(a) < SHORT_ANSWER else "")
            if len(a) >= SHORT_ANSWER:
                patterns.setdefault(a, []).append((me, -1))
        self.automaton = ahocorasick.Automaton()
        for p, places in patterns.items():
            self.automaton.add_word(p, (len(p), places))
        self.empty = not patterns
        if not self.empty:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int, bool]]:
        """(item id, words, start, end, answer seen) of the longest passage of each item."""
        stream = fold(text)
        if self.empty or not stream:
            return []
        hits: set[tuple[int, int, int]] = set()
        answers: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.automaton.iter(stream):
            for me, at in places:
                if at < 0:
                    answers.setdefault(me, []).append((last - size + 1, last + 1))
                else:
                    hits.add((last - size + 1, me, last - size + 1 - at))
        best: dict[int, tuple[int, int, int]] = {}
        place = None
        done: dict[tuple[int, int], int] = {}
        for begin, me, shift in sorted(hits):
            # hits of one passage share their shift, but so do passages parted by a change of equal length
            if begin < done.get((me, shift), 0):
                continue
            _, own, bounds = self.streams[me]
            i, j = begin - shift, begin
            while i > 0 and j > 0 and own[i - 1] == stream[j - 1]:
                i, j = i - 1, j - 1
            k, m = begin - shift, begin
            while k < len(own) and m < len(stream) and own[k] == stream[m]:
                k, m = k + 1, m + 1
            done[me, shift] = m
            # whole words within, that begin and end where the document's words do
            inside = [x for x, b in enumerate(bounds) if i <= b <= k]
            if len(inside) - 1 < self.least:
                continue
            if place is None:
                place = offsets(text)
            on_edge = [x for x in inside if place[2][bounds[x] + shift]]
            if not on_edge or (n := on_edge[-1] - on_edge[0]) < self.least:
                continue
            if n > best.get(me, (0,))[0]:
                best[me] = (n, place[0][bounds[on_edge[0]] + shift], place[1][bounds[on_edge[-1]] + shift - 1])
        return [(self.streams[me][0], *x, self._answered(me, answers.get(me, []), stream, place[2])) for me, x in sorted(best.items())]

    def _answered(self, me: int, at: list[tuple[int, int]], stream: str, edge: list[bool]) -> bool:
        """Whether an item's answer stands in the text in whole words.  Short
        answers, which would hit everywhere, are looked for in texts with a
        passage of their item only."""
        if short := self.short[me]:
            at, i = [], stream.find(short)
            while i >= 0:
                at.append((i, i + len(short)))
                i = stream.find(short, i + 1)
        return any(edge[i] and edge[j] for i, j in at)


def find_leaks(documents: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_words, char_start, char_end, answer_seen: one row per
    document and item of which it holds at least ``least_words`` words in a row,
    with the longest passage, its place in the original text, and whether the
    item's answer stands anywhere in the document in whole words.

    ``documents`` needs doc_id and text, ``items`` item_id, item_text and
    answer; other columns play no part.  Null and empty texts match nothing;
    repeated items count once (the greatest text).  The documents are scanned
    whole and once for each block of items; a block is sent to the workers only
    within ``block_chars`` characters, and one larger item makes its own block.
    """
    spark = documents.sparkSession
    clean = items.where("item_id is not null").groupBy("item_id").agg(F.max("item_text").alias("item_text"), F.max("answer").alias("answer"))
    chars = clean.agg(F.coalesce(F.sum(F.length("item_text") + F.coalesce(F.length("answer"), F.lit(0))), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * chars // block_chars)) if chars > block_chars else 1
    out = None
    for b in range(blocks):
        part = clean if blocks == 1 else clean.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            automaton = Items(sent.value, least_words)
            for pdf in batches:
                rows = [(d, *x) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) if isinstance(t, str) for x in automaton.find(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_words", "char_start", "char_end", "answer_seen"])

        # ids travel as text: pandas has no integer column with nulls
        found = spread(documents.select(F.col("doc_id").cast("string"), "text")).mapInPandas(scan, "doc_id string, item_id long, n_words int, char_start int, char_end int, answer_seen boolean").withColumn("doc_id", F.col("doc_id").cast("long"))
        out = found if out is None else out.unionByName(found)
    return out


def leaks_by_item(leaks: DataFrame) -> DataFrame:
    """item_id, number of documents with it and its longest passage in words."""
    return leaks.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))
