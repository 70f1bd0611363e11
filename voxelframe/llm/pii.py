"""Personal data in plain and disguised writing, with spans in the source text."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like Latin ones, by code point order.
LOOKALIKES = (
    "ΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧXαaιiκkνvοoρpυuϲc"
    "ЅSІIЈJАAВBЕEКKМMНHОOРPСCТTУYХXаaеeоoрpсcуyхxѕsіiјjһhԁdԛqԝw"
    "ıiɑaɡgƖl․.‐-‑-‒-–-—-−-。.｡."
)
# First code points of runs of decimal digits.
DIGIT_RUNS = (0x0660, 0x06F0, 0x0966, 0xFF10, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6)
# Digits 0 to 9 in words.
SPELLED = (
    ("zero", "oh", "null", "zéro", "cero"),
    ("one", "eins", "un", "uno"),
    ("two", "zwei", "zwo", "deux", "dos"),
    ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"),
    ("six", "sechs", "seis"),
    ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"),
    ("nine", "neun", "neuf", "nueve"),
)
AT_WORDS = "at|arobase|arroba|ät"
DOT_WORDS = "dot|punkt|point|punto"

DIGIT_OF = {word: str(d) for d, words in enumerate(SPELLED) for word in words}
TIMES = {"double": 2, "triple": 3}
#: Mathematical letters, by their compatibility forms.
MATHEMATICAL = {chr(c): x for c in range(0x1D400, 0x1D6A4) if (x := unicodedata.normalize("NFKC", chr(c))).isascii() and x.isalpha()}
LETTERS = {
    **MATHEMATICAL,
    **{LOOKALIKES[i]: LOOKALIKES[i + 1] for i in range(0, len(LOOKALIKES), 2)},
    **{chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)},
    **{chr(first + d): str(d) for first in DIGIT_RUNS for d in range(10)},
}

_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can't begin within a run of digits whose beginning doesn't match.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}|(?<=[0-9])(?!)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of plainly written data, by kind, then start; leftmost matches that don't overlap within a kind."""
    out = [("email", s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGIT.findall(m[0])) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


class Mapped:
    """A text on its way through the transducers: every character knows its stretch of the source, and if it was made."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start, self.end, self.made = list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, pattern: re.Pattern, write: Callable[[re.Match], str]) -> None:
        """Replace every match by what ``write`` returns for it; its characters stand for the whole match."""
        out, start, end, made, at, mark = [], [], [], bytearray(), 0, 0
        for m in pattern.finditer(self.text):
            new = write(m)
            a, b = m.span()
            if new == m[0] or a == b:
                continue
            out += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            kept = self.made[at:a]
            if mark and kept:
                kept[0] = 1
            made += kept + b"\1" * len(new)
            at, mark = b, not new
        if at:
            kept = self.made[at:]
            if mark and kept:
                kept[0] = 1
            self.text, self.start, self.end, self.made = "".join(out) + self.text[at:], start + self.start[at:], end + self.end[at:], made + kept

    def spans(self) -> list[tuple[str, int, int]]:
        """Spans of the source for what is found in the rewritten text and touches a rewritten character."""
        return [(kind, self.start[a], self.end[b - 1]) for kind, a, b in plain_spans(self.text) if 1 in self.made[a:b]]


_INVISIBLE = re.compile("[\u0300-\u036f­​-‍⁠﻿]")
#: Beyond the first plane ranges alone, which a search passes at once.
_LETTER = re.compile("[" + "".join(re.escape(c) for c in LETTERS if c < "\U00010000") + "\U0001d400-\U0001d6a3\U0001d7ce-\U0001d7ff\u0300-\u036f­​-‍⁠﻿]")
_ENTITY = re.compile(r"(?i)&#0*(?:64|x40);|&commat;|%40|&#0*(?:46|x2e);|&period;")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT = re.compile(rf"(?i)(?<=[a-z0-9]) *{_OPEN} *(?:{AT_WORDS}|@) *{_CLOSE} *(?=[a-z0-9])")
_DOT = re.compile(rf"(?i)(?<=[a-z0-9]) *{_OPEN} *(?:{DOT_WORDS}|\.) *{_CLOSE} *(?=[a-z0-9])")
_BRACKET = re.compile(rf"(?i){_OPEN} *(?:{AT_WORDS}|{DOT_WORDS}|[@.]) *{_CLOSE}")
_PLAIN_DOT = re.compile(rf"(?i)(?<=[a-z0-9]) +(?:{DOT_WORDS}) +(?=[a-z0-9])")
# In bare words both disguises must stand in one address: name at host dot domain.
_HOST = r"[a-z0-9-]+(?:\.[a-z0-9-]+)*"
_PLAIN_AT = re.compile(rf"(?i)(?<=[a-z0-9])( +(?:{AT_WORDS}) +)(?={_HOST} +(?:{DOT_WORDS}) +{_HOST})")
_AFTER_AT = re.compile(rf"(?i)@{_HOST}(?:(?: +(?:{DOT_WORDS}) +|\.){_HOST})+")
_WORD_AFTER_AT = re.compile(rf"(?i)@{_HOST} +(?:{DOT_WORDS}) +[a-z0-9]")
#: A local part with dots in words, backwards from its at sign.
_BEFORE_AT = re.compile(rf"(?i)[a-z0-9._%+-]+(?: +(?:{'|'.join(w[::-1] for w in DOT_WORDS.split('|'))}) +[a-z0-9._%+-]+)+")
_IP_WORDS = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?: +(?:{DOT_WORDS}) +[0-9]{{1,3}}){{3}}(?![0-9])")
_SPACED = re.compile(rf"(?i)(?<=[a-z0-9]) +@ +(?={_HOST}(?:\.| +(?:{DOT_WORDS}) +){_HOST})")
_NUMERAL = "|".join(sorted(DIGIT_OF, key=lambda w: (-len(w), w)))
_TIMES = rf"(?:(?:{'|'.join(TIMES)}) +)?"
_JOIN = rf"(?:dash|hyphen|minus|tiret|strich|guion|guión|{DOT_WORDS})"
#: Four or more digits of which the first and one of the next are words.
_RUN = re.compile(rf"(?i)(?<!\w)(?:\+|plus +)?\(?{_TIMES}(?:{_NUMERAL})(?:[ ,().-]+(?:{_JOIN}[ ]+)?(?:{_TIMES}(?:{_NUMERAL})(?!\w)|[0-9]+(?!\w))){{3,}}\)?")
_RUN_PART = re.compile(rf"(?i)(?P<plus>plus +)|(?<!\w)(?:(?P<times>{'|'.join(TIMES)}) +)?(?P<word>{_NUMERAL})(?!\w)|[ ,-]*(?<!\w)(?P<dot>{DOT_WORDS})(?!\w)[ ,]*|[ ,-]*(?<!\w)(?P<dash>dash|hyphen|minus|tiret|strich|guion|guión)(?!\w)[ ,]*|(?P<gap>[ ,-]+)")
_FEW = re.compile(rf"(?i)(?<!\w)(?:{_NUMERAL})[ ,().-]+(?:{_JOIN} +)?{_TIMES}(?:{_NUMERAL}|[0-9])")


def _spelled(m: re.Match) -> str:
    return "+" if m["plus"] else DIGIT_OF[m["word"].lower()] * TIMES.get((m["times"] or "").lower(), 1) if m["word"] else "." if m["dot"] else "-" if m["dash"] else ""


def _digits(mapped: Mapped) -> list[tuple[str, int, int]]:
    """Rewrite runs of spelled digits; returns runs of 10 to 15 spelled digits, telephone numbers even without a plus."""
    found: list[tuple[str, int, int]] = []
    text, runs = mapped.text, [m.span() for m in _RUN.finditer(mapped.text)]
    if not runs:
        return found
    spans = []
    for a, b in runs:
        parts = list(_RUN_PART.finditer(text, a, b))
        spans += [(m.span(), _spelled(m)) for m in parts]
        words = [m for m in parts if m["word"]]
        told = re.findall(rf"(?i)(?:({'|'.join(TIMES)}) +)?({_NUMERAL}|[0-9])", text[a:b])
        digits = "".join(DIGIT_OF.get(x.lower(), x) * TIMES.get(times.lower(), 1) for times, x in told)
        plain = text[a] != "+" and text[a - 1 : a] != "+" and not any(m["plus"] or m["dot"] for m in parts)
        # Counting up, and a word said over and over (an article may be a numeral too), are no telephone numbers.
        if plain and sum(TIMES.get((m["times"] or "").lower(), 1) for m in words) >= 7 and 10 <= len(digits) <= 15 and len({m["word"].lower() for m in words}) >= 4 and digits not in "0123456789" * 3:
            found.append(("phone", mapped.start[words[0].start()], mapped.end[words[-1].end() - 1]))
    within = dict(spans)
    mapped.rewrite(_RUN_PART, lambda m: within.get(m.span(), m[0]))
    return found


def _locals(mapped: Mapped) -> list[tuple[int, int]]:
    """Stretches of local parts with dots in words, in front of at signs that were made; plain ones may follow a word like "point"."""
    made = [m.start() for m in re.finditer("@", mapped.text) if mapped.made[m.start()]]
    back, n = mapped.text[::-1] if made else "", len(mapped.text)
    return [(n - m.end(), n - m.start()) for at in made if (m := _BEFORE_AT.match(back, n - at))]


def disguised_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the source that only show once disguises are undone.

    The transducers run in a fixed order: letters and digits of other scripts and invisible characters, bracketed and
    bare words for the at sign and the dot, spelled digits. Texts without a trace of these are left after a few
    searches.
    """
    letters = not text.isascii() and _LETTER.search(text)
    low = text.lower()
    dots = any(w in low for w in DOT_WORDS.split("|"))
    bracket = ("(" in text or "[" in text or "{" in text or "<" in text) and _BRACKET.search(text)
    spaced = " @ " in text
    entity = ("&" in text or "%40" in text) and _ENTITY.search(text)
    numbers = _FEW.search(low)
    dots = dots and (_PLAIN_AT.search(text) or _IP_WORDS.search(text) or _WORD_AFTER_AT.search(text))
    if not (letters or dots or bracket or spaced or entity or numbers):
        return []
    mapped = Mapped(text)
    if letters:
        mapped.rewrite(_INVISIBLE, lambda m: "")
        mapped.rewrite(_LETTER, lambda m: LETTERS.get(m[0], m[0]))
    if entity:
        mapped.rewrite(_ENTITY, lambda m: "@" if re.search("(?i)64|x40|mat|%40", m[0]) else ".")
    more = _digits(mapped)
    mapped.rewrite(_AT, lambda m: "@")
    mapped.rewrite(_DOT, lambda m: ".")
    mapped.rewrite(_PLAIN_AT, lambda m: "@")
    mapped.rewrite(_SPACED, lambda m: "@")
    stretches = [m.span() for p in (_AFTER_AT, _IP_WORDS) for m in p.finditer(mapped.text)] + _locals(mapped)
    if stretches:
        inside = {m.span() for a, b in stretches for m in _PLAIN_DOT.finditer(mapped.text, a, b)}
        mapped.rewrite(_PLAIN_DOT, lambda m: "." if m.span() in inside else m[0])
    return mapped.spans() + more


def find_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, all spans), each by kind, then start."""
    plain = plain_spans(text)
    everything = sorted({*plain, *disguised_spans(text)}, key=lambda s: (KINDS.index(s[0]), *s[1:]))
    return plain, everything


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of plain spans by kind, base_sha256 of these spans, all spans, n_added.

    Spans are ``kind:start:end`` in code points of the source text, end exclusive. Disguised data are added to the
    plain ones: letters of other scripts, spelled digits, at signs and dots in words, invisible characters. A null text
    counts as empty and has no spans; null and repeated ids are passed through; other columns are ignored; an empty
    table gives no rows. Texts are read whole, in time proportional to their length.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1).to_pylist():
                plain, every = find_spans(text or "")
                kinds = [k for k, _, _ in plain]
                row = [*map(kinds.count, KINDS), hashlib.sha256(_joined(plain).encode()).hexdigest(), _joined(every), len(every) - len(plain)]
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
            kinds_of = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds_of, strict=True))], names)

    source = batched(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = ["long"] * 4 + ["string"] * 2 + ["long"]
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in zip(names[1:], kinds, strict=True)))
