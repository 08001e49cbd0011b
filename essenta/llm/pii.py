"""Personal data in texts, also where it is disguised, by spans of the source text.

The base patterns find e-mail addresses, IP addresses, card and phone numbers as they stand. The
method runs a text through a chain of transducers that normalise look-alike characters, spelled
digits and disguises of "@" and "." (``TRANSDUCERS``). Each one keeps, for every character it writes,
the first and the last source character it stands for, so a span found in the normalised text
maps back to the source. Only spans that contain a rewritten character are added: what stands
openly is the base patterns' to find.

A text is one pass in one task, nothing is shuffled. Every pattern is linear in the text: local parts
are read backwards from "@", numbers are taken possessively.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# starts with a digit that follows none, in the order that lets the search skip to digits
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPANS = "array<struct<kind: string, start: long, end: long, base: boolean, value: string>>"

# Words that stand for signs and digits in the four languages, and letters that look like Latin ones.
AT_WORDS = ("at", "arroba", "arobase", "ät")
DOT_WORDS = ("dot", "punto", "punkt", "point")
DIGIT_WORDS = (
    ("zero", "null", "zéro", "cero", "oh"), ("one", "eins", "un", "uno"), ("two", "zwei", "deux", "dos"), ("three", "drei", "trois", "tres"),
    ("four", "vier", "quatre", "cuatro"), ("five", "fünf", "cinq", "cinco"), ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"),
    ("eight", "acht", "huit", "ocho"), ("nine", "neun", "neuf", "nueve"))
ENDINGS = ("com", "org", "net", "edu", "gov", "int", "info", "biz", "io", "ai", "co", "me", "tv", "eu", "de", "at", "ch", "fr", "be", "es", "mx", "ar",
           "it", "nl", "pt", "br", "pl", "ru", "uk", "ie", "us", "ca", "au", "in", "jp", "cn", "test", "example", "invalid")
LOOK_ALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ",
    "T": "ТΤ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ", "a": "аα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "k": "к",
    "m": "м", "n": "ո", "o": "оο", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υ", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уү",
    "-": "‐‑‒–—―−", ".": "。․", " ": "      　"}
UNSEEN = "­​‌‍⁠﻿"


def _single_signs() -> dict[int, str]:
    """Look-alikes, and every character whose compatibility form or decimal value is one ASCII character."""
    out = {ord(c): sign for sign, like in LOOK_ALIKES.items() for c in like}
    for code in range(0x180, 0x1FBFA):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c) if not 0xAC00 <= code <= 0xD7FF else c
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            out.setdefault(code, str(digit))
        elif len(plain) == 1 and "!" <= plain <= "~" and unicodedata.category(c) not in ("Lm", "No"):
            out.setdefault(code, plain)
    return out


SINGLE = _single_signs()


def _any(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_DIGIT = {w: str(k) for k, row in enumerate(DIGIT_WORDS) for w in row}
_SPELLED = rf"(?<!\w)(?:{_any(_DIGIT)})(?!\w)"
_ONE_SPELLED = re.compile(_SPELLED, re.I)
_GAP = r"(?:[ \t,]+|[ ]?-[ ]?)"


def _bracketed(inner: str) -> str:
    return rf"\s?[(\[{{<]\s?(?:{inner})\s?[)\]}}>]\s?"


# four digits in a row, some of them spelled, are a number; "double" words and others are left alone
_NUMBER = re.compile(rf"(?:{_SPELLED}|(?<!\w)[0-9](?!\w))(?:{_GAP}(?:{_SPELLED}|(?<!\w)[0-9](?!\w))){{2,}}", re.I)
_PLUS = re.compile(rf"(?<!\w)(?:plus|más|mas)\s+(?=[0-9]|{_SPELLED})", re.I)
_BRACKETS = re.compile(rf"(?P<at>{_bracketed('@|' + _any(AT_WORDS))})|(?P<dot>{_bracketed('[.]|' + _any(DOT_WORDS))})", re.I)
_LABEL = r"[A-Za-z0-9-]+"
_DOT_GAP = rf"(?:\s+(?:{_any(DOT_WORDS)})\s+|_(?:{_any(DOT_WORDS)})_)"
# a bare "at" counts before a domain with a spelled dot and a usual ending, a bare " @ " before any domain
_BARE = re.compile(
    rf"(?<=[A-Za-z0-9])(?:\s+(?:{_any(AT_WORDS)})\s+|_(?:{_any(AT_WORDS)})_)(?={_LABEL}(?:(?:\.|{_DOT_GAP}){_LABEL}){{0,6}}{_DOT_GAP}(?:{_any(ENDINGS)})(?![A-Za-z0-9-]))"
    rf"|(?<=[A-Za-z0-9])(?:\s+@\s*|\s*@\s+)(?={_LABEL}(?:(?:\.|{_DOT_GAP}){_LABEL})+)", re.I)
_DOT = re.compile(rf"(?<=[A-Za-z0-9]){_DOT_GAP}(?=[A-Za-z0-9])", re.I)
_AFTER_AT = re.compile(rf"@{_LABEL}(?:(?:\.|{_DOT_GAP}){_LABEL})+", re.I)
_LOCAL_DOTS = re.compile(rf"(?<![A-Za-z0-9-]){_LABEL}+(?:{_DOT_GAP}{_LABEL}+){{1,6}}(?=@)", re.I)
_IP_DOTS = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:\.|{_DOT_GAP})[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_MIXED = re.compile(
    r"(?<![A-Za-z0-9])(?=[OoIl]*[0-9]|[OoIl](?:[ .-][OoIl]){0,9}[ .-][0-9])[0-9OoIl]+(?![A-Za-z0-9])"
    r"|(?<=[0-9][ .-])[OoIl]{2,}(?![A-Za-z0-9])|(?<=[0-9][.])[OoIl](?=[.][0-9OoIl]|(?![A-Za-z0-9.]))")
_LETTER_DIGITS = str.maketrans("OoIl", "0011")
# a superset of all signs to rewrite, in one range
_MAYBE_ODD = re.compile("[\u00a0\u00ad\u0180-\U0010ffff]")
_ODD = frozenset(map(chr, SINGLE)) | frozenset(UNSEEN)
_BRACKET_HINT = re.compile(rf"[(\[{{<]\s?(?:@|[.]|{_any(AT_WORDS + DOT_WORDS)})\s?[)\]}}>]", re.I)
_LETTER_HINT = re.compile(r"[0-9](?:[ .-]?[OoIl]|(?<=[OoIl][0-9])|(?<=[OoIl][ .-][0-9]))")
_TOKEN_ENDS = "-,_().;:"
_DIGIT_TOKENS = frozenset(_DIGIT) | frozenset("0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, found from their "@"."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start, size = at, 64
        # the run of local characters before "@", read backwards in growing steps
        while start > free:
            low = max(free, start - size)
            other = _NOT_LOCAL.search(text[low:start][::-1])
            if other:
                start -= other.start()
                break
            start, size = low, size * 4
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", max(at + 1, free))
    return out


def detect(text: str) -> list[tuple[str, int, int]]:
    """Base spans of all kinds."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


class Tape:
    """A text with the source span and a rewritten mark of each character."""

    def __init__(self, text: str):
        self.text = text
        self.start, self.end = np.arange(len(text)), np.arange(1, len(text) + 1)
        self.new = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ``[a, b)`` by a text, for spans in order that do not overlap."""
        if not edits:
            return
        parts, starts, ends, news, at = [], [], [], [], 0
        for a, b, put in edits:
            parts += [self.text[at:a], put]
            k = len(put)
            starts += [self.start[at:a], np.full(k, self.start[a])]
            ends += [self.end[at:a], np.full(k, self.end[b - 1])]
            news += [self.new[at:a], np.ones(k, bool)]
            if not k:  # what follows a character that is left out counts as rewritten
                self.new[b:b + 1] = True
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.start, self.end, self.new = (np.concatenate([*x, y[at:]]) for x, y in ((starts, self.start), (ends, self.end), (news, self.new)))

    def each(self, pattern: re.Pattern, put) -> None:
        self.rewrite([(m.start(), m.end(), put(m)) for m in pattern.finditer(self.text)])


def _within(tape: Tape, outer: re.Pattern, inner: re.Pattern, put: str) -> None:
    tape.rewrite([(m.start(), m.end(), put) for o in outer.finditer(tape.text) for m in inner.finditer(tape.text, o.start(), o.end())])


def look_alikes(tape: Tape) -> None:
    tape.rewrite([(m.start(), m.end(), SINGLE.get(ord(m.group()), "")) for m in _MAYBE_ODD.finditer(tape.text) if m.group() in _ODD])


def spelled_digits(tape: Tape) -> None:
    tape.each(_NUMBER, lambda m: re.sub(_GAP, "", _ONE_SPELLED.sub(lambda w: _DIGIT[w.group().lower()], m.group())))
    tape.each(_PLUS, lambda m: "+")


def letter_digits(tape: Tape) -> None:
    tape.rewrite([(m.start() + k, m.start() + k + 1, c.translate(_LETTER_DIGITS))
                  for m in _MIXED.finditer(tape.text) for k, c in enumerate(m.group()) if c in "OoIl"])


def at_and_dot(tape: Tape) -> None:
    tape.each(_BRACKETS, lambda m: "@" if m.group("at") else ".")
    tape.each(_BARE, lambda m: "@")
    _within(tape, _AFTER_AT, _DOT, ".")
    _within(tape, _LOCAL_DOTS, _DOT, ".")
    _within(tape, _IP_DOTS, _DOT, ".")


# In this order: signs first, so that later ones read plain letters.
TRANSDUCERS = (look_alikes, spelled_digits, letter_digits, at_and_dot)


def disguised(text: str) -> bool:
    """Whether any transducer could change ``text`` (a cheap look; it may say yes in vain)."""
    if not text.isascii() and any(m.group() in _ODD for m in _MAYBE_ODD.finditer(text)):
        return True
    if _BRACKET_HINT.search(text) or " @" in text or "@ " in text or _LETTER_HINT.search(text):
        return True
    low = text.lower()
    for sign in _TOKEN_ENDS:
        low = low.replace(sign, " ")
    tokens = low.split()
    seen = set(tokens)
    if not seen.isdisjoint(DOT_WORDS) and _DOT.search(text):
        return True
    if not seen.isdisjoint(("plus", "más", "mas")) and _PLUS.search(text):
        return True
    return not seen.isdisjoint(_DIGIT) and any(
        a in _DIGIT_TOKENS and b in _DIGIT_TOKENS for a, b in zip(tokens, tokens[1:])) and bool(_NUMBER.search(text))


def find_spans(text: str | None) -> list[tuple[int, int, int, bool, str]]:
    """``(start, number of the kind, end, base, value)`` in order; the value is the normalised text."""
    text = text or ""
    base = detect(text)
    out = {(a, KINDS.index(k), b): (True, text[a:b]) for k, a, b in base}
    if disguised(text):
        tape = Tape(text)
        for transduce in TRANSDUCERS:
            transduce(tape)
        for k, a, b in detect(tape.text):
            if tape.new[a:b].any():
                out.setdefault((int(tape.start[a]), KINDS.index(k), int(tape.end[b - 1])), (False, tape.text[a:b]))
    return [(*key, *out[key]) for key in sorted(out)]


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of ``docs (doc_id, text)``: kind, start and end in code points of the source, base, value.

    Spans come by start, then kind (email, ip, card, phone), then end. Base spans always stay; a
    disguised one may overlap them. A null or empty text has none, a null id is kept, repeated rows are
    answered one by one, further columns are not read, no rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string())])

    def step(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b, "base": base, "value": value} for a, k, b, base, value in find_spans(t)]
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(step, f"doc_id {kind}, spans {SPANS}")


def report(found: DataFrame) -> DataFrame:
    """Counts and hash of the base spans, and all spans as text, of the rows of ``find_pii``."""
    base = F.filter("spans", lambda s: s["base"])

    def line(s: Column) -> Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[number(k) for k in KINDS],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"))
