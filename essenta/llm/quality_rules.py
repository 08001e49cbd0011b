"""Quality rules: repetition counts and bands of n-gram perplexity.

The base rules count words, symbols, repeated lines and repeated word windows of the whole
text. The method is a Kneser-Ney model counted and estimated in Spark and stored, a part for each bucket
of documents, in sorted hash arrays (``kneser_ney.HashArrays``): a text is kept when its score lies between the lower
and the upper bound of its language. Unlike the quality classifier, which looks only upwards,
a text that is far too predictable goes as well.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.llm import kneser_ney as kn
from essenta.llm.common import WORD, Folder
from essenta.llm.quality_classifier import PRIOR, TAIL

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, MOST_REPEATED = 50, 3, 50  # words, words, percent
_WORD = re.compile(WORD)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key = numbers[:n]
    for k in range(1, window):
        # numbered anew at each step, so the key cannot overflow
        key = np.unique(key * len(ids) + numbers[k:n + k], return_inverse=True)[1]
    inside = np.zeros(len(words) + 1, np.int64)
    again = np.nonzero(np.bincount(key)[key] > 1)[0]
    np.add.at(inside, again, 1)
    np.add.at(inside, again + window, -1)
    return int((inside.cumsum() > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of one text."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: id, base counts, ``base_failed``, ``kept``, the score and its band.

    A null text has no words, so it fails the base rules, like any of fewer than 50 words. The
    band is that of the trusted documents of the language; where it has none, null counting as
    a language, the base rules decide alone. Repeated rows are judged alike. No rows give no rows. Further columns are not read.
    """
    folder = Folder(docs.sparkSession, "rules")
    trusted = folder.write(kn.trusted_ids(labels), "trusted")
    slim = docs.select("doc_id", F.col("lang").alias("language"), "text")
    rows = kn.scored(slim, trusted, folder, "text", "doc_id", ("symbols", "cost"), (", ".join(f"{c} long" for c in COUNTS), base_counts), keep_text=False)
    bounds = folder.write(kn.bounds_of(rows.select("doc_id", "language", "symbols", "cost"), trusted, PRIOR, TAIL), "bounds")
    out = kn.with_bounds(rows, bounds, "language", ("centre", "low", "high"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    score = kn.shrunk("symbols", "cost", "centre", PRIOR)
    inside = F.coalesce(score.between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & inside).alias("kept"),
                      score.alias("score"), "low", "high")
