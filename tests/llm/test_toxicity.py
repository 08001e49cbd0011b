import random
import zlib

import numpy as np

from essenta.llm import toxicity
from essenta.llm.toxicity import held_out, hit_counts, label_model, score_toxicity, tokens, votes
from tests.llm.odd import odd, table


def corpus(n=900):
    """Invented prose in which three insults and one stem with any ending mark the toxic rows."""
    rng = random.Random(11)
    syllables = ["ka", "lo", "mi", "ru", "te", "so", "pa", "ne"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(n):
        text, toxic = [word() for _ in range(rng.randint(5, 60))], k % 6 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["grob", "fies", "dumm", "zwick" + word()]))
        rows.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, known).collect()}
    assert len(got) == len(rows)
    truth = {k: t for k, _, t in labels}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in got.items())
    held = [(truth[k], r.predicted) for k, r in got.items() if r.held_out]
    assert sum(t == p for t, p in held) >= 0.97 * len(held)
    assert sum(p for t, p in held if t) >= 0.95 * sum(t for t, _ in held)


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    turned = known.withColumn("toxic", toxicity.F.when(held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    pick = lambda lab: sorted((r.doc_id, round(r.score, 9)) for r in score_toxicity(docs, lab).collect())
    assert pick(known) == pick(turned)


def test_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "1 as score", "2 as hits", "3 as toxic")
    labels = spark.createDataFrame([(1, 1, 1), (6, 1, 0), (6, 0, 1), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("doc_id = 1"), table(spark, "labels")):
        got = score_toxicity(docs, known).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert score_toxicity(odd(spark, []), labels).collect() == []


def test_tokens_and_disguises():
    assert tokens("You IDIOT!! (really) well-known") == ({"you", "idiot", "really", "well", "known"}, {"wellknown"})
    assert hit_counts("an 1d10t, a m.o.r.o.n and s t u p i d", {}, frozenset(toxicity.INSULTS))[-2:] == [0, 3]
    assert hit_counts(None, {}, frozenset()) == hit_counts("", {}, frozenset()) == [0] * len(toxicity.HITS)


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    hits = np.zeros((4000, len(toxicity.HITS)), int)
    for k, (yes, no) in enumerate([(0.9, 0.02), (0.6, 0.1), (0.5, 0.05)]):
        hits[:, k] = rng.random(4000) < np.where(truth, yes, no)
    hits[:, 3] = hits[:, 1]  # a voter that copies another
    label = np.where(rng.random(4000) < 0.05, ~truth, truth).astype(int)
    q, model = label_model(votes(hits, label), np.ones(4000))
    assert ((q > 0.5) == truth).mean() > 0.94
    assert abs(model["share"] - 0.3) < 0.05
    assert model["correlation"][1, 3] > 0.9 and model["discount"][1] < model["discount"][0] + 0.2
