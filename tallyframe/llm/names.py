"""Names, addresses, phones and web names as typed, in comparable parts."""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Sequence

#: Legal forms (dots and blanks taken out) and the form they stand for.
LEGAL = {
    "gmbh": "gmbh", "mbh": "gmbh", "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "llc": "llc", "bv": "bv", "sa": "sa",
    "ag": "ag", "kg": "kg", "plc": "plc", "nv": "nv", "srl": "srl", "sarl": "sarl", "spa": "spa", "oy": "oy", "ab": "ab", "as": "as", "co": "co", "company": "co", "llp": "llp", "lp": "lp",
}
#: A word is an activity if it stands before the legal form of at least this share of the names that have one, and a
#: short form of an activity from this share on; either after at least so many different first words.
WORD_SHARE, SHORT_SHARE, LEAST_FIRST = 0.005, 0.0002, 3
#: Common given names and their short forms.
GIVEN = """
theodore ted theo teddy|michael mike mick mickey|daniel dan danny|rebecca becky becca|gregory greg|edward ed eddie ned|josephine jo josie|jennifer jen jenny|renata rena|nicholas nick nicky
charlotte lottie charlie|amelie amy|katherine kate kathy katie kat|oskar ossi|joachim jochen achim|christopher chris kit|samuel sam sammy|margaret maggie meg peggy|susanna sue susie suzy|william will bill billy
andrew andy drew|isabella bella izzy isa|lorenzo enzo renzo|benjamin ben benny|eleanor ellie nell nora|matilda tilda tilly|victoria vicky tori|beatriz bea|anthony tony|elizabeth liz beth lizzy eliza betty
robert rob bob bobby|alexander alex sandy xander|frederick fred freddy|ludmila mila|paloma palo|patricia pat patty trish|stefan steff|tobias toby tobi|ingrid inga|henrik henk rik
james jim jimmy|john jack johnny|thomas tom tommy|richard dick rick|joseph joe|david dave|peter pete|steven steve|matthew matt|timothy tim|lawrence larry|ronald ron|kenneth ken|barbara barb|catherine cathy|deborah deb|susan susy|dorothy dot
"""
#: Words before a name, and remarks after it.
BEFORE = ("the", "messrs", "firma", "fa", "mr", "mrs", "ms", "dr", "prof", "herr", "frau", "company")
PERSON_TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau")
_REMARKS = re.compile(r"\*[^*]*\*|\([^)]*\)|\bc/o\b.*$|-\s*duplicate\s*$|\bdo not use\b|\bold\b\s*$")
_ROAD = {"street": "st", "str": "st", "road": "rd", "avenue": "ave", "av": "ave", "lane": "ln", "drive": "dr", "boulevard": "blvd"}

FULL_NAME = {short: names[0] for names in (x.split() for x in re.split(r"[|\n]", GIVEN) if x.strip()) for short in names}

LONG_NAMES = tuple(sorted({n for n in FULL_NAME.values() if len(n) >= 6}))


def base(text: str | None) -> str:
    """Base letters in lower case."""
    text = unicodedata.normalize("NFKD", text or "").casefold()
    return "".join(c for c in text if not unicodedata.combining(c)).replace("ß", "ss").replace("ø", "o").replace("æ", "ae").replace("œ", "oe").replace("ł", "l")


def edits(a: str, b: str, most: int) -> int:
    """Edit distance within a band of ``most`` (adjacent swaps count one); ``most + 1`` beyond it."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    wide = most + 1
    before2: list[int] = []
    before = [j if j <= most else wide for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        row = [wide] * (len(b) + 1)
        row[0] = i if i <= most else wide
        for j in range(lo, hi + 1):
            best = min(before[j - 1] + (x != b[j - 1]), before[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before2[j - 2] + 1)
            row[j] = best
        if min(row[max(0, lo - 1) : hi + 1]) > most:
            return wide
        before2, before = before, row
    return min(before[-1], wide)


def _digits_as_letters(t: str) -> str:
    if any(c.isalpha() for c in t) and any(c.isdigit() for c in t):
        return t.translate(str.maketrans("015348", "olseab"))
    return t


def _in_order(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


def short_for(token: str, words: Sequence[str]) -> list[str]:
    """The words that a token may be short for, the likeliest kind only: another
    ending of the word (supplies, supply), its beginning, or letters of it in
    order from the first (and, better, to the last)."""
    best, kind = [], 0
    for w in words:
        same = len(os.path.commonprefix([token, w]))
        if same >= 5 and same * 5 >= 3 * max(len(token), len(w)):
            k = 4
        elif len(token) >= 3 and w.startswith(token):
            k = 3
        elif len(token) >= 2 and token[0] == w[0] and len(token) < len(w) and _in_order(token, w):
            k = 2 if token[-1] == w[-1] else 1
        else:
            continue
        if k > kind:
            best, kind = [], k
        if k == kind:
            best.append(w)
    return best


class Activities:
    """What firms do, as learned from a register: words and their short forms."""

    def __init__(self, words: Sequence[str] = (), short: dict[str, str | None] | None = None) -> None:
        self.words, self.short = tuple(words), dict(short or {})
        self.known = set(words)

    @classmethod
    def learned(cls, counts: Sequence[tuple[str, int, int]], total: int) -> Activities:
        """From (word before a legal form, names, different first words) and the
        number of such names.  Of the frequent words those are activities that
        are short for no much more frequent one; a form that may stand for several
        words stands for an unknown one."""
        rows = sorted((x for x in counts if not x[0].isdigit() and x[2] >= LEAST_FIRST), key=lambda x: (-x[1], x[0]))
        words: dict[str, int] = {}
        short: dict[str, str | None] = {}
        for w, n, _ in rows:
            meant = short_for(w, list(words))
            if meant and (n < total * WORD_SHARE or 5 * n <= words[meant[0]] or len(os.path.commonprefix([w, meant[0]])) >= 5):
                short[w] = meant[0] if len(meant) == 1 else None
            elif n >= total * WORD_SHARE:
                words[w] = n
        return cls(list(words), short)

    def of(self, token: str, dotted: bool) -> tuple[bool, str | None]:
        """Whether a word tells an activity, and which (None if it may be several):
        itself, a learned short form, a beginning with a full stop, one typo away
        in long words, or mostly consonants of the word."""
        t = token.replace("'", "")
        if t in self.known:
            return True, t
        if t in self.short:
            return True, self.short[t]
        if dotted and len(t) >= 3 and (begun := [w for w in self.words if w.startswith(t)]):
            return True, begun[0] if len(begun) == 1 else None
        if len(t) >= 7:
            for w in self.words:
                if abs(len(t) - len(w)) <= 1 and (t[0] == w[0] or t[-1] == w[-1]) and edits(t, w, 1) <= 1:
                    return True, w
        if len(t) >= 3 and sum(c in "aeiou" for c in t) <= len(t) // 5:
            meant = [w for w in self.words if w[0] == t[0] and w[-1] == t[-1] and len(t) < len(w) and _in_order(t, w)]
            if meant:
                return True, meant[0] if len(meant) == 1 else None
        return False, None


def given_name(token: str) -> str | None:
    """The full given name a word stands for, one typo in longer names allowed."""
    if token in FULL_NAME:
        return FULL_NAME[token]
    if len(token) >= 6:
        for n in LONG_NAMES:
            if abs(len(n) - len(token)) <= 1 and (n[0] == token[0] or n[-1] == token[-1]) and edits(token, n, 1) <= 1:
                return n
    return None


def parse_name(name: str | None, activities: Activities = Activities()) -> dict[str, object]:
    """core (words without a general meaning, a final full stop kept on
    abbreviations), given (full given name or an initial), person, activity,
    number, legal."""
    s = _REMARKS.sub(" ", base(name))
    s = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m.group(1).replace(".", "") + " ", s)  # g.m.b.h.
    s = re.sub(r"\s[&+]\s|&|\bund\b|\band\b|\s\+\s", " ", s)
    s = re.sub(r"\bs a\b", "sa", re.sub(r"\bl l c\b", "llc", re.sub(r"\bb v\b", "bv", re.sub(r"\bg m b h\b", "gmbh", s))))
    out: dict[str, object] = {"given": None, "person": False, "activity": None, "number": None, "legal": None}
    words: list[tuple[str, bool]] = []
    for raw in re.findall(r"[a-z0-9']+\.?", s):
        dotted = raw.endswith(".")
        t = raw.rstrip(".")
        if t in BEFORE and not words:
            out["person"] = out["person"] or t in PERSON_TITLES
            continue
        if t.isdigit():
            out["number"] = str(int(t))
            continue
        words.append((_digits_as_letters(t).replace("'", "") if "'" not in t else t.replace("'", ""), dotted))
    while len(words) > 1 and words[-1][0] in LEGAL:
        out["legal"] = LEGAL[words.pop()[0]]
    if out["legal"] is None and len(words) > 2:
        for i, (t, _) in enumerate(words):
            if i and t in LEGAL:
                out["legal"] = LEGAL[t]
                words.pop(i)
                break
    # a given name first, or last after a comma; an initial
    for i in (0, len(words) - 1) if len(words) > 1 else ():
        t, _ = words[i]
        g = given_name(t) if out["legal"] is None else None
        if g or (len(t) == 1 and t.isalpha()):
            out["given"], out["person"] = g or t, True
            words.pop(i)
            break
    if not out["person"] and len(words) > 1:
        for i in range(len(words) - 1, -1, -1):
            told, out["activity"] = activities.of(*words[i])
            if told:
                words.pop(i)
                break
    out["core"] = [t + ("." if d else "") for t, d in words if t]
    return out


def parse_street(street: str | None) -> tuple[str | None, str | None]:
    """(house number, street name without the kind of road)."""
    s = base(street)
    m = re.search(r"\d+", s)
    words = [w for w in re.findall(r"[a-z]+", s)]
    if len(words) > 1:
        words = words[:-1] if len(words[-1]) <= 6 and (words[-1] in _ROAD or words[-1] in _ROAD.values() or any(edits(words[-1], r, 2) <= 2 for r in _ROAD)) else words
    return (m.group() if m else None), ("".join(words) or None)


def parse_phone(phone: str | None) -> str | None:
    """National digits: without the country code (+99, 0099) and the leading zero."""
    d = re.sub(r"\D", "", phone or "")
    if (phone or "").strip().startswith("+"):
        d = d[2:]
    elif d.startswith("00"):
        d = d[4:]
    return d.lstrip("0") or None


def parse_web(web: str | None) -> str | None:
    """The name under which a web page or mail box runs, without its ending."""
    s = re.sub(r"^https?://", "", base(web).strip())
    s = s.rpartition("@")[2].removeprefix("www.").split("/")[0]
    return s.rpartition(".")[0].replace("-", "") or s or None


def plain(text: str | None) -> str | None:
    return re.sub(r"[^a-z0-9]", "", base(text)) or None


def orders(core: list[str]) -> list[str]:
    """A name's words run together, as they stand and turned round."""
    t = [x.rstrip(".") for x in core]
    turned = [t[i:] + t[:i] for i in range(len(t))] if len(t) <= 4 else [t, sorted(t)]
    if len(t) == 3:
        turned += [x[::-1] for x in turned]
    return list(dict.fromkeys("".join(x) for x in turned))
