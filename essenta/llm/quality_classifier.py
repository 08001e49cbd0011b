"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

The trusted documents are those labelled as good. Their n-grams are counted in Spark, sharded
joins of counts, context sums and lower orders give the probabilities, and joins with the
n-grams of the documents, by bucket of documents, each one's perplexity (see ``kneser_ney``).
A document is rejected above the quantile ``1 - TAIL`` of its language's trusted documents.

The mean cost of a short text strays widely, so a score adds ``PRIOR`` code points at the typical
cost of the language before the bound is applied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.llm import kneser_ney as kn
from essenta.llm.common import Folder, own_name

PRIOR, TAIL = 200, 0.005


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang",
             keep_text: bool = True, tail: float = TAIL) -> DataFrame:
    """``docs`` with ``n_symbols, perplexity, score, bound, accepted`` (a clashing name gets an underscore).

    ``accepted`` is false where the score is above the bound of the language, or where the
    text is null or empty (its perplexity is null). A language without any trusted document, null counting as a
    language, has no bound and no score, and its texts with a code point are accepted: they are not held against the bounds of other
    languages. Repeated rows are scored alike; labels without an id or with mixed judgements for an id do
    not make it trusted. No rows give no rows. Without ``keep_text`` the text is left out.
    """
    folder = Folder(docs.sparkSession, "quality")
    trusted = folder.write(kn.trusted_ids(labels), "trusted")
    symbols, perplexity, score, bound, accepted, centre, low = own_name(
        docs, "n_symbols", "perplexity", "score", "bound", "accepted", "centre", "low")
    rows = kn.scored(docs, trusted, folder, text, doc_id, (symbols, perplexity), keep_text=keep_text)
    slim = rows.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("language"), F.col(symbols).alias("symbols"), F.col(perplexity).alias("cost"))
    bounds = folder.write(kn.bounds_of(slim, trusted, PRIOR, tail), "bounds")
    out = kn.with_bounds(rows, bounds, lang, (centre, low, bound)).withColumn(score, kn.shrunk(symbols, perplexity, centre, PRIOR))
    fine = F.col(perplexity).isNotNull() & F.coalesce(F.col(score) <= F.col(bound), F.lit(True))
    return out.select(*[c for c in docs.columns if keep_text or c != text], symbols, F.pow(F.lit(2.0), perplexity).alias(perplexity), score, bound, fine.alias(accepted))


def drop_poor(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """The accepted rows of ``docs`` with their columns."""
    (accepted,) = own_name(docs, "accepted")
    return classify(docs, labels, text, doc_id, lang).where(F.col(accepted)).select(*docs.columns)
