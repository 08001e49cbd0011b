import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from essenta.llm import spelling as sp
from essenta.llm.queries import QUERIES
from tests.llm.odd import DIR, lowered, odd, table


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_counts(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def brute_rows(counts):
    """Links by deleting each place in turn."""
    holes = defaultdict(set)
    for w in counts:
        holes[w].add(w)
        for k in range(len(w)):
            holes[w[:k] + w[k + 1:]].add(w)
    links = defaultdict(set)
    for group in holes.values():
        for a in group:
            links[a] |= {b for b in group if b != a and b not in links[a] and near(a, b)}
    form = {}
    for w, n in counts.items():
        if links[w]:
            best = min(links[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 10 * n:
                form[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(links[w]), counts[form[w]] if w in form else None))
    return out


def test_composition_equals_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        z = rng.randint(0, 5)
        short = {"".join(rng.choice("abé") for _ in range(z)) for _ in range(rng.randint(0, 12))}
        longer = {"".join(rng.choice("abé") for _ in range(z + 1)) for _ in range(rng.randint(0, 12))}
        got = list(sp.compose(list(short), list(longer), True))
        assert len(got) == len(set(got))
        assert {frozenset(p) for p in got} == {frozenset((a, b)) for a in short for b in short | longer if a != b and near(a, b)}


def test_acceptor_is_minimal():
    machine = sp.Acceptors()
    machine.add(sorted(a + b for a in "xyz" for b in ("aa", "ab")))
    assert len(machine.arcs) == 4  # the end, before the last letter, after the first, the start


@pytest.mark.parametrize("limit", [3, 40, 10_000])
def test_partitions_of_every_size(spark, limit):
    rng = random.Random(limit)
    made = {"".join(rng.choice("aabéz") for _ in range(rng.choice([1, 2, 5, 7, 8, 8, 9]))) for _ in range(700)} | {"a" * k for k in range(1, 12)}
    made |= {"b" * 3000, "b" * 3001, "b" * 2000 + "c" + "b" * 999}
    words = {w: rng.choice([2, 3, 20, 25, 300, 4000]) for w in made}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    pairs = [(r.a, r.b) for r in sp.near_pairs(df, limit).collect()]
    want = {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}
    assert len(pairs) == len(want) and {frozenset(p) for p in pairs} == want
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in sp.variants(df, limit=limit).collect()}
    assert got == brute_rows(words)


def test_query_equals_brute_force(spark):
    got = QUERIES["op13_spelling_variants"](spark, DIR)
    assert sorted(got.columns) == ["form", "form_n", "n", "n_near", "root", "word"]
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()]
    want = brute_rows(brute_counts([(d.doc_id, d.text) for d in table(spark, "documents").collect()]))
    assert len(rows) == len(want) and set(rows) == want
    assert any(r[1] for r in rows)


def test_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "1 as word", "2 as n", "3 as root")
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in sp.spelling_variants(docs, sp.dropped_letter).collect()}
    assert got == brute_rows(brute_counts([(d.doc_id, d.text) for d in docs.collect()]))
    assert sp.spelling_variants(odd(spark, [])).collect() == []
