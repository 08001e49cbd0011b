"""Toxicity scores by weak supervision.

1. Words and word beginnings that mark toxic documents are mined from labelled training rows
   by a likelihood ratio test; together with a short fixed list they make the lexicons.
2. Voters look at a text: words and word beginnings, each by tier of precision, the fixed
   list, disguised spellings, the absence of any hit, and the given label.
3. A generative model with the true class as the hidden variable estimates by expectation
   maximisation how often each voter votes either way in either class. Voters that agree
   beyond what the class explains are correlated; the model estimates these correlations
   and discounts such voters, so a hit seen by three of them does not count three times.
4. A linear classifier (logistic regression on the voters' hit counts) is trained on the
   posterior labels and scores every document.

The fit reads at most about ``FIT_ROWS`` labelled rows, chosen by a hash of their ids; the
lexicons hold at most ``LEXICON`` entries. All documents are scored, whole texts. Ids choose
rows, but language, source and id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from essenta.llm.common import Folder

FIT_ROWS, LEXICON, THRESHOLD = 50_000, 20_000, 0.3
LEAST_GAIN, ROUNDS, SKETCH = 14.0, 60, 4
LABEL_ACCURACY = 0.99  # prior of the label model; it weighs as much as the data
PREFIXES = (3, 4, 5, 6, 7, 8)
TIERS = (0.95, 0.85, 0.7)  # smoothed precision of the keys of a lexicon part
# Plain insults that need no evidence from labels.
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard", "asshole"]
# Letters that digits and signs stand for in disguised spellings.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"})
HITS = [*(f"word{t}" for t in TIERS), *(f"start{t}" for t in TIERS), "listed", "disguised"]
VOTERS = [*HITS, "no_word", "no_start", "label"]
_EDGE = ".,;:!?\"'()[]{}<>*#%&|-_~`…«»“”‘’¿¡\\/"
_NOT_LETTER = re.compile(r"[\W\d_]+")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 4, is 2 (null ids are not held out)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tokens(text: str) -> tuple[set[str], set[str]]:
    """Distinct lower-case words, and letters of tokens that hide a word behind other signs."""
    words, hidden = set(), set()
    pieces = text.lower().split()
    for piece in set(pieces):
        bare = piece.strip(_EDGE)
        if bare.isalpha():
            words.add(bare)
        elif bare:
            parts = [x for x in _NOT_LETTER.split(bare) if x]
            words.update(x for x in parts if len(x) > 1)
            whole = _NOT_LETTER.sub("", bare.translate(DISGUISE))
            if len(whole) > 3 and (len(parts) != 1 or parts[0] != whole):
                hidden.add(whole)
    single = 0
    for k, piece in enumerate([*pieces, "--"]):  # spelled out: i d i o t
        if len(piece) == 1 and piece.isalpha():
            single += 1
        else:
            if single > 3:
                hidden.add("".join(pieces[k - single:k]))
            single = 0
    return words, hidden


def marks(words: set[str]) -> set[str]:
    """Lexicon keys of a set of words: the words and their beginnings."""
    return words | {f"{w[:n]}*" for n in PREFIXES for w in words if len(w) > n}


def hit_counts(text: str | None, lexicon: dict[str, int], listed: frozenset[str]) -> list[int]:
    """Distinct hits of each voter in ``HITS``; the lexicon gives the voter of each key."""
    counts = [0] * len(HITS)
    words, hidden = tokens(text or "")
    for key in marks(words) & lexicon.keys():
        counts[lexicon[key]] += 1
    counts[-2] = len(words & listed)
    for whole in hidden:
        short = re.sub(r"(.)\1+", r"\1", whole)
        if whole in lexicon or whole in listed or short in lexicon or short in listed:
            counts[-1] += 1
    return counts


def voter_of(key: str, precision: float) -> int:
    """Position in ``HITS``: words and beginnings apart, by tier of precision."""
    tier = next(k for k, t in enumerate(TIERS) if precision >= t)
    return tier + len(TIERS) * key.endswith("*")


def mine_lexicon(sample: DataFrame, size: int = LEXICON) -> dict[str, int]:
    """Keys that mark toxic rows of ``sample (text, toxic)``, at most ``size`` of them."""

    def step(batches: Iterator[pa.RecordBatch]):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update(marks(tokens(text or "")[0]))
        keys = list(toxic.keys() | clean.keys())
        yield pa.RecordBatch.from_pydict({
            "key": pa.array(keys, pa.string()), "a": pa.array([toxic[k] for k in keys], pa.int64()), "b": pa.array([clean[k] for k in keys], pa.int64())})

    totals = sample.agg(F.sum((F.col("toxic") == 1).cast("long")), F.sum((F.col("toxic") != 1).cast("long"))).first()
    n1, n0 = (max(1, x or 0) for x in totals)
    rate = n1 / (n1 + n0)
    counted = sample.select("text", "toxic").mapInArrow(step, "key string, a long, b long").groupBy("key").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    seen = F.col("a") + F.col("b")
    part = lambda x, share: F.when(x > 0, x * F.log(x / (seen * share))).otherwise(0.0)
    gain = 2 * (part(F.col("a"), rate) + part(F.col("b"), 1 - rate))
    found = counted.where(F.col("a") > 1).withColumn("gain", gain).withColumn("precision", F.col("a") / (seen + 1)).where(
        (F.col("gain") >= LEAST_GAIN) & (F.col("precision") >= TIERS[-1])).orderBy(F.desc("gain"), "key").limit(size)
    return {r["key"]: voter_of(r["key"], r["precision"]) for r in found.collect()}


def votes(hits: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Votes in {-1, 0, 1}, one column per voter; 0 abstains."""
    n, t = len(HITS), len(TIERS)
    out = np.zeros((len(hits), len(VOTERS)), np.int8)
    out[:, :n] = hits > 0
    out[:, n] = -(hits[:, :t].sum(1) == 0).astype(np.int8)
    out[:, n + 1] = -(hits[:, t:2 * t].sum(1) == 0).astype(np.int8)
    out[:, n + 2] = np.where(label == 1, 1, -1)
    return out


def label_model(patterns: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, dict]:
    """Posterior of the toxic class for each vote pattern, and the estimated model.

    ``weight`` counts the documents of a pattern. The model holds the class share, each
    voter's vote probabilities by class, the correlations given the class and the discounts.
    """
    m = patterns.shape[1]
    q = 1 / (1 + np.exp(-(0.5 * patterns.sum(1) + 3.0 * patterns[:, -1])))
    discount = np.ones(m)
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    for _ in range(ROUNDS):
        by_class = np.stack([(1 - q) * weight, q * weight])
        share = np.clip(by_class.sum(1) / max(1e-9, weight.sum()), 1e-4, 1 - 1e-4)
        table = np.einsum("cn,nmv->cmv", by_class, onehot) + 0.5
        table[:, -1] += by_class.sum(1)[:, None] * np.array([[LABEL_ACCURACY, 0, 1 - LABEL_ACCURACY], [1 - LABEL_ACCURACY, 0, LABEL_ACCURACY]])
        table /= table.sum(2, keepdims=True)
        # correlation given the class, from the residuals of the votes
        mean = table[:, :, 2] - table[:, :, 0]
        inside = np.zeros((m, m))
        for c in (0, 1):
            r = patterns - mean[c]
            inside += (r * by_class[c][:, None]).T @ r
        sd = np.sqrt(np.maximum(np.diag(inside), 1e-9))
        correlation = inside / np.outer(sd, sd)
        discount = 1 / (1 + np.maximum(correlation - np.eye(m), 0).sum(1))
        discount[-1] = 1.0  # the label was not made from the text's hits
        evidence = np.einsum("nmv,cmv->cnm", onehot, np.log(table)) @ discount + np.log(share)[:, None]
        new = 1 / (1 + np.exp(np.clip(evidence[0] - evidence[1], -50, 50)))
        if np.abs(new - q).max() < 1e-9:
            q = new
            break
        q = new
    return q, {"share": share[1], "votes": table, "correlation": correlation, "discount": discount}


def with_hits(docs: DataFrame, lexicon: dict[str, int], rest: list[str]) -> DataFrame:
    """Columns ``rest`` of ``docs (.., text)`` and ``hits``, the counts of each voter."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, frozenset(INSULTS)))

    def step(batches: Iterator[pa.RecordBatch]):
        known, listed = shared.value
        for batch in batches:
            hits = [hit_counts(t, known, listed) for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hits, pa.list_(pa.int32()))], names=[*rest, "hits"])

    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.select(*rest, "text").mapInArrow(step, ", ".join([f"`{c}` {kind[c]}" for c in rest] + ["hits array<int>"]))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """``text, toxic`` of at most about ``bound`` labelled rows that are not held out.

    An id with several labels counts as toxic if any of them says so; null labels and ids are
    left out. Texts whose ``SKETCH`` smallest word hashes agree are copies and count once:
    the words of a copied document would pass for evidence otherwise.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, bound / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * float(1 << 30))
    # about `bound` rows of two numbers, so the texts need not be shuffled
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"))
    sketch = F.slice(F.sort_array(F.transform(words, lambda w: F.xxhash64(w))), 1, SKETCH)
    return rows.groupBy(sketch.alias("sketch")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, folder: Folder) -> dict:
    """Lexicon, label model and the classifier's weights (last one: intercept)."""
    sample = folder.write(training_rows(docs, labels), "sample")
    lexicon = mine_lexicon(sample)
    seen = folder.write(with_hits(sample, lexicon, ["toxic"]), "sample_hits")
    # rows with equal hits and labels are one training row with a weight
    grouped = seen.groupBy("hits", "toxic").agg(F.count(F.lit(1)).alias("n")).orderBy("hits", "toxic").collect()
    if not grouped:
        return {"lexicon": lexicon, "weights": [0.0] * len(HITS) + [-5.0], "model": None}
    hits, label, n = (np.array(x) for x in zip(*[(r["hits"], r["toxic"], float(r["n"])) for r in grouped]))
    posterior, model = label_model(votes(hits, label), n)
    rows = [(np.log1p(h).tolist(), float(y), float(w * p)) for h, w, q in zip(hits, n, posterior) for y, p in ((1.0, q), (0.0, 1 - q)) if w * p > 1e-6]
    train = docs.sparkSession.createDataFrame(rows, "f array<double>, label double, w double").select(array_to_vector("f").alias("features"), "label", "w")
    if len({y for _, y, _ in rows}) < 2:
        return {"lexicon": lexicon, "weights": [0.0] * len(HITS) + [5.0 if rows[0][1] else -5.0], "model": model}
    best = LogisticRegression(weightCol="w", regParam=1e-4, standardization=False, maxIter=200, tol=1e-9).fit(train)
    return {"lexicon": lexicon, "weights": [*best.coefficients.toArray().tolist(), float(best.intercept)], "model": model}


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the voters' ``hits`` of every row of ``docs``.

    Null and empty texts have no hits and get the score of a text without evidence. Repeated
    rows are scored alike. Without training labels every score is low. No rows give no rows.
    """
    folder = Folder(docs.sparkSession, "toxicity")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fitted = fit(rows, labels, folder)
    *weights, intercept = fitted["weights"]
    z = F.lit(intercept)
    for k, w in enumerate(weights):
        z = z + w * F.log1p(F.col("hits")[k])
    score = 1 / (1 + F.exp(-z))
    return with_hits(rows, fitted["lexicon"], ["doc_id"]).select("doc_id", held_out().alias("held_out"), score.alias("score"), "hits").select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "hits")
