import hashlib
import random
import re

import pytest

from essenta.llm import pii
from essenta.llm.queries import QUERIES
from tests.llm.odd import DIR, odd, table

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_luhn(digits):
    flat = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(digits[::-1])]
    return sum(x // 10 + x % 10 for x in flat) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) < 256 for p in m.group().split(".") if kind == "ip"),
                    "card": 14 <= len(digits) <= 19 and brute_luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0]), s[2]))


def test_base_patterns_on_random_texts():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["@", ".", "a", "b-", "1", "25", "4111111111111111", "+", " ", "(", "-", "é", "%", "0", "_"]) for _ in range(rng.randint(0, 30)))
        assert sorted(pii.detect(text)) == sorted(brute(text)), text


# a disguised span, what it stands for
CASES = [
    ("bob.lee [at] mail7 [dot] example [dot] com", "email", "bob.lee@mail7.example.com"),
    ("bob(at)mail.example.com", "email", "bob@mail.example.com"),
    ("bob at mail dot example dot com", "email", "bob@mail.example.com"),
    ("bob AT mail DOT com", "email", "bob@mail.com"),
    ("bob dot lee at mail dot com", "email", "bob.lee@mail.com"),
    ("bob_at_mail_dot_com", "email", None),
    ("bob @ mail.example.com", "email", "bob@mail.example.com"),
    ("bоb@mаil.example.com", "email", "bob@mail.example.com"),
    ("ｂｏｂ＠ｍａｉｌ．ｃｏｍ", "email", "bob@mail.com"),
    ("b​ob@ma​il.com", "email", "bob@mail.com"),
    ("juan arroba correo punto es", "email", "juan@correo.es"),
    ("192[.]168[.]1[.]17", "ip", "192.168.1.17"),
    ("192 dot 168 dot 1 dot 17", "ip", "192.168.1.17"),
    ("one nine two dot one six eight dot 1 dot 17", "ip", "192.168.1.17"),
    ("192.168.O.1", "ip", "192.168.0.1"), ("l92.168.1.1O", "ip", "192.168.1.10"),
    ("+1 (five five five) 555-0199", "phone", "+1 (555) 555-0199"),
    ("plus one five five five one two three four five six seven", "phone", "+15551234567"),
    ("＋１ ５５５ １２３ ４５６７", "phone", "+1 555 123 4567"), ("+1 (555) 555–0199 – ", "phone", "+1 (555) 555-0199"),
    ("٤١١١١١١١١١١١١١١١", "card", "4111111111111111"), ("4111 1111 1111 llll", "card", "4111 1111 1111 1111"),
    ("four one one one one one one one one one one one one one one one", "card", "4111111111111111"),
    ("vier eins eins eins 1111 1111 1111", "card", None),
]


@pytest.mark.parametrize("text,kind,value", CASES)
def test_disguises_map_back(text, kind, value):
    for before, after in (("", ""), ("See the é note: ", ", and so on."), ("Ciónas des\n", "\nend")):
        found = [(k, a, b, v) for a, k, b, base, v in pii.find_spans(before + text + after) if not base]
        span = text.rstrip(" –")
        if value is None:
            continue
        assert (pii.KINDS.index(kind), len(before), len(before) + len(span), value) in found, found


CLEAN = ["look at the dot on the map", "one two three four five six", "meet me at example.com today", "He was at home. Point two: look.", "Il arrive à point pour un deux trois",
         "a [at] b", "10 O'clock at 5.4.3", "the point at which one dot two is 1.2", "version 1.2 dot 4 of l2", "plus one more, at 12:30", "été à Î № ½ ² ™"]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_have_no_spans(text):
    assert pii.find_spans(text) == []


def test_long_texts_are_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " * 60_000, "at dot " * 30_000, "one " * 50_000, "l " * 100_000, " " * 200_000, "a dot " * 40_000 + "@", "(" * 200_000, "a." * 100_000 + "@x"):
        pii.find_spans(text)


def test_query_equals_brute_force(spark):
    got = QUERIES["op12_pii_spans"](spark, DIR)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = {r.doc_id: r for r in got.collect()}
    docs = table(spark, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want = brute(d.text)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = rows[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in BASE]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.spans == text  # nothing is disguised in these documents


def test_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "1 as spans", "2 as base")
    got = pii.report(pii.find_pii(docs)).collect()
    assert len(got) == docs.count() and all(r.spans == "" and r.n_email == 0 for r in got)
    assert pii.report(pii.find_pii(odd(spark, []))).collect() == []
