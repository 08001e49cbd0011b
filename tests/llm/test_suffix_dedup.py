import random
from collections import Counter

from essenta.llm.suffix_dedup import PASSAGE, repeated_passages
from tests.llm.odd import lowered, odd, table, words


def brute(rows):
    texts = [(r.doc_id, words(lowered(r.text))) for r in rows]
    seen = Counter(tuple(w[s:s + PASSAGE]) for _, w in texts for s in range(len(w) - PASSAGE + 1))
    out = []
    for key, w in texts:
        a = b = None
        for s in range(len(w) - PASSAGE + 1):
            if seen[tuple(w[s:s + PASSAGE])] > 1:
                if a is not None and s <= b:
                    b = s + PASSAGE
                else:
                    if a is not None:
                        out.append((key, a, b - a))
                    a, b = s, s + PASSAGE
        if a is not None:
            out.append((key, a, b - a))
    return sorted(out, key=repr)


def same(docs):
    assert sorted([(r.doc_id, r.start, r.words) for r in repeated_passages(docs).collect()], key=repr) == brute(docs.collect())


def test_table(spark):
    same(table(spark, "documents"))


def test_planted_passages(spark):
    """Passages of just enough words, cut out of copies, at the edges and twice in a text."""
    rng = random.Random(3)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    p, q, r = text(PASSAGE), text(PASSAGE + 9), text(PASSAGE - 1)
    base = text(40) + q + text(70)
    rows = [base, base, text(20) + q + text(30), p + text(30), text(30) + p, p, text(10) + p + text(5) + p, r, text(5) + r + text(40),
            base[10:90], q[3:] + text(3), text(60), ["z"] * 200, ["y"] * 60 + ["z"] * 55]
    docs = spark.createDataFrame([(k, " ".join(w), k) for k, w in enumerate(rows)], "doc_id long, text string, start long")
    same(docs)
    same(docs.repartition(5))


def test_odd_rows(spark):
    same(odd(spark).selectExpr("*", "1 as rid", "2 as pos", "3 as start"))
    assert repeated_passages(odd(spark, [])).collect() == []
