import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from essenta.llm import periodic_runs as pr
from essenta.llm.queries import QUERIES, planted_period
from tests.llm.odd import DIR, odd, table, words


def brute_runs(w):
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if length >= max(6, 4 * p):
                out.setdefault((i, length), p)
            i = j
    return sorted((s, n_, p) for (s, n_), p in out.items())


def brute_row(w):
    runs = brute_runs(w)
    drop = {k for s, n, p in runs for k in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            sha(" ".join(x for k, x in enumerate(w) if k not in drop)))


def brute_edit(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def made(rng, n):
    """Words with repeated blocks, some inside others."""
    out = []
    while len(out) < n:
        block = [rng.choice("abcd") for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 21, 40]))]
        if rng.random() < 0.3:
            block = block * rng.randint(2, 6)
        out += block * rng.randint(1, 7)
    return out[:n]


@pytest.mark.parametrize("tile", [16, 64, 8192])
def test_tiles_and_stitching(spark, tile):
    rng = random.Random(tile)
    lists = [made(rng, rng.choice([0, 1, 5, 7, 33, 90, 300, 700])) for _ in range(150)]
    lists += [["a"] * 500, ["a"] * 5, ["a"] * 6, list("abcdefg" * 60), list("ab" * 3), list("ab" * 4), list("abc" * 100) + ["c"] * 90]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(lists)], "doc_id long, text string").repartition(3)
    got = pr.collapse_runs(docs, keep_text=True, tile=tile).collect()
    assert len(got) == len(lists)
    for r in got:
        w = lists[r.doc_id]
        runs = brute_runs(w)
        assert [(x.start, x.length, x.period) for x in r.runs] == runs, (tile, r.doc_id)
        assert r.collapsed_sha256 == brute_row(w)[-1] == hashlib.sha256(r.collapsed.encode()).hexdigest()


def test_long_period_in_a_long_text():
    rng = random.Random(5)
    block = [rng.randrange(9) for _ in range(3000)]
    w = np.array([10, *block * 5, 11])
    found = {(p, s + a, s + b) for low, high, a0, b0 in pr.tiles(len(w)) for s in [a0] for p, a, b in pr.solve(w[a0:b0], low, high) if p > 1}
    assert {p for p, _, _ in found} == {3000} and min(a for _, a, _ in found) == 1 and max(b for _, _, b in found) == 1 + 4 * 3000


def test_one_repeated_word_is_cheap():
    assert pr.solve(np.zeros(200_000, np.int64), 0, 18)[0] == (1, 0, 199_999)


def test_query_equals_brute_force(spark):
    got = QUERIES["op11_periodic_runs"](spark, DIR)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    docs = table(spark, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        w = brute_edit(d.doc_id, words(d.text))
        assert planted_period(d.doc_id, words(d.text)) == w
        assert rows[d.doc_id] == brute_row(w), d.doc_id


def test_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "1 as rid", "2 as runs", "3 as period")
    got = pr.report(pr.collapse_runs(docs)).collect()
    want = [(d.doc_id, *brute_row(words(d.text))) for d in docs.collect() if len(words(d.text)) < 1000]
    assert len(got) == docs.count()
    assert sorted([tuple(r) for r in got if r.doc_id not in (6, 7)], key=repr) == sorted(want, key=repr)
    assert pr.report(pr.collapse_runs(odd(spark, []))).collect() == []
