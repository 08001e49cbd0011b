"""Repeated passages by a sparse suffix array.

Only suffixes at minimisers are kept: of every ``SPREAD`` neighbouring ``GRAM``-word starts the
one with the smallest hash, so the choice depends on the content and falls on the same word
wherever a passage stands. Suffixes are sorted by the hash of their next ``NEAR`` words, and
neighbours in that order tell which of them occur elsewhere. The sort is a range partition with
the row number as the last key, so no passage is gathered in one task however often it occurs.

Matches are then extended to the left and right over the words that a passage through the
suffix can have: up to ``SPREAD - 1`` before it and ``PASSAGE`` from it on. Suffixes that agree
in all these words form a group; they repeat each other there. Where suffixes with the same
next words fall into several groups, one member of each compares its windows of ``PASSAGE``
words with those of the other groups. Each window belongs to the minimiser of its own first
words, which is the same in all its copies, so the result is exact: all words of all windows
of ``PASSAGE`` words that occur at least twice, and no others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from essenta.llm.common import WORD, Folder

GRAM, PASSAGE = 8, 50
SPREAD = PASSAGE // 2  # a minimiser is among the first SPREAD words of a passage
NEAR = PASSAGE - SPREAD + 1  # words that surely follow it inside the passage
SUFFIX = ["rid", "pos", "near", "around", "before", "after"]
_WORD = re.compile(WORD)
_FACTOR = 0x9E3779B97F4A7C15  # any odd number
_INVERSE = pow(_FACTOR, -1, 1 << 64)


class _Hashes(dict):
    """Hash of a word; kept for a batch."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode())
        return h


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


_LOWER = {65 + k: 97 + k for k in range(26)}


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(n, np.uint64)
    up, down = ones.copy(), ones.copy()
    up[1:], down[1:] = np.uint64(_FACTOR), np.uint64(_INVERSE)
    return np.cumprod(up), np.cumprod(down)


def _room(n: int) -> int:
    return 1 << max(10, n.bit_length())


class Words:
    """Word hashes of one text and hashes of any run of its words."""

    def __init__(self, text: str, known: _Hashes):
        words = _WORD.findall(lower_ascii(text))
        self.n = len(words)
        up, self.down = _powers(_room(self.n))
        values = np.fromiter((known[w] for w in words), np.uint64, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:self.n])])

    def runs(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Hash of ``length`` words from each start."""
        x = (self.sums[starts + length] - self.sums[starts]) * self.down[starts]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))

    def owners(self) -> np.ndarray:
        """For each start of a passage the minimiser it belongs to (leftmost smallest hash)."""
        grams = self.runs(np.arange(self.n - PASSAGE + SPREAD), GRAM)
        return np.lib.stride_tricks.sliding_window_view(grams, SPREAD).argmin(1) + np.arange(self.n - PASSAGE + 1)


def _suffixes(batches: Iterator[pa.RecordBatch]):
    """Sparse suffixes ``rid, pos, near, around, before, after`` of ``(rid, text)``.

    ``around`` hashes the ``before`` words to the left and the ``after`` words from the suffix on.
    """
    for batch in batches:
        known, parts = _Hashes(), [[] for _ in range(6)]
        for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text or len(text) < 2 * PASSAGE - 1:
                continue
            words = Words(text, known)
            if words.n < PASSAGE:
                continue
            at = np.unique(words.owners())
            before, after = np.minimum(at, SPREAD - 1), np.minimum(words.n - at, PASSAGE)
            around = words.runs(at - before, before + after) + (before * 64 + after).astype(np.uint64)
            for part, x in zip(parts, (np.full(len(at), rid), at, words.runs(at, NEAR), around, before, after)):
                part.append(x)
        if parts[0]:
            rid, pos, near, around, before, after = map(np.concatenate, parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(pos.astype(np.int32)), pa.array(near.view(np.int64)), pa.array(around.view(np.int64)),
                 pa.array(before.astype(np.int8)), pa.array(after.astype(np.int8))], names=SUFFIX)


def _compare(batches: Iterator[pa.RecordBatch]):
    """Sorted suffixes in; out those with a neighbour that agrees, and always the first and last of the partition."""

    def out(rows, same, edge):
        keep = same | edge
        return pa.RecordBatch.from_arrays([*[pa.array(x[keep]) for x in rows], pa.array(same[keep]), pa.array(edge[keep])], names=[*SUFFIX, "same", "edge"])

    carry, before, first = None, False, True
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(rows[0]):
            continue
        if carry is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(carry, rows)]
        agree = np.concatenate([[before], rows[2][1:] == rows[2][:-1], [False]])
        carry, before = [x[-1:] for x in rows], agree[-2]
        if len(rows[0]) > 1:
            edge = np.zeros(len(rows[0]) - 1, bool)
            edge[0], first = first, False
            yield out([x[:-1] for x in rows], (agree[:-1] | agree[1:])[:-1], edge)
    if carry is not None:
        yield out(carry, np.array([before]), np.array([True]))


def _windows(batches: Iterator[pa.RecordBatch]):
    """Windows ``window, rid, pos, alone`` of ``(rid, text, hits)``; hits are suffixes and whether their group has no other member."""
    for batch in batches:
        known, parts = _Hashes(), [[], [], [], []]
        for rid, text, hits in zip(*(c.to_pylist() for c in batch.columns)):
            words = Words(text, known)
            owners = words.owners()
            wanted = np.zeros(words.n, np.int8)
            wanted[[h["pos"] for h in hits]] = [1 + h["alone"] for h in hits]
            starts = np.nonzero(wanted[owners])[0]
            for part, x in zip(parts, (words.runs(starts, PASSAGE), np.full(len(starts), rid), starts, wanted[owners[starts]] == 2)):
                part.append(x)
        if parts[0]:
            window, rid, pos, alone = map(np.concatenate, parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(window.view(np.int64)), pa.array(rid), pa.array(pos.astype(np.int32)), pa.array(alone)], names=["window", "rid", "pos", "alone"])


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per repeated passage of a document: ``doc_id, start, words``.

    ``start`` counts words from 0. A passage is a maximal run of words covered by windows of
    ``PASSAGE`` words that occur at least twice in the whole table, in one document or in
    several (words compared after lower-casing A-Z). Repeated rows are documents of their own.
    Texts that are null, empty or shorter give no rows; a null id is carried along. No rows
    give no rows.
    """
    folder = Folder(docs.sparkSession, "suffixes")
    rows = folder.numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "rid")
    suffixes = folder.write(rows.select("rid", "text").mapInArrow(
        _suffixes, "rid long, pos int, near long, around long, before byte, after byte"), "suffixes")
    key = ["near", "around", "rid", "pos"]
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(suffixes.inputFiles()))
    ordered = suffixes.repartitionByRange(partitions, *key).sortWithinPartitions(*key)
    hits = folder.write(ordered.mapInArrow(_compare, "rid long, pos int, near long, around long, before byte, after byte, same boolean, edge boolean"), "hits")
    # suffixes that agree across a partition boundary are both at an edge
    crossing = hits.where("edge").groupBy("near").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("near")
    found = hits.where("same").drop("same", "edge").unionByName(
        hits.where("edge and not same").drop("same", "edge").join(crossing, "near", "left_semi"))
    groups = folder.write(found.groupBy("near", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "pos")).alias("one")), "groups")
    # members of one group repeat each other in all the words around
    together = found.join(groups.where("n > 1").select("near", "around"), ["near", "around"], "left_semi").where(
        f"before + after >= {PASSAGE}").select("rid", (F.col("pos") - F.col("before")).alias("a"), (F.col("pos") + F.col("after")).alias("b"))
    several = groups.groupBy("near").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("near")
    asking = groups.join(several, "near", "left_semi").select("one.rid", "one.pos", (F.col("n") == 1).alias("alone"))
    by_doc = asking.groupBy("rid").agg(F.collect_list(F.struct("pos", "alone")).alias("hits"))
    windows = folder.write(rows.select("rid", "text").join(by_doc, "rid").select("rid", "text", "hits").mapInArrow(
        _windows, "window long, rid long, pos int, alone boolean"), "windows")
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    apart = windows.where("alone").join(again, "window", "left_semi").select("rid", F.col("pos").alias("a"), (F.col("pos") + PASSAGE).alias("b"))
    pieces = together.unionByName(apart).groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("p"))
    merged = folder.write(pieces.select("rid", "p").mapInArrow(_merge, "rid long, start long, words long"), "merged")
    return merged.join(rows.select("rid", "doc_id"), "rid").select("doc_id", "start", "words")


def _merge(batches: Iterator[pa.RecordBatch]):
    """Maximal runs of the sorted intervals of each row."""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for rid, intervals in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = None, -1
            for piece in [*intervals, {"a": 1 << 60, "b": 1 << 60}]:
                if piece["a"] <= b:
                    b = max(b, piece["b"])
                    continue
                if a is not None:
                    for column, x in zip(out, (rid, a, b - a)):
                        column.append(x)
                a, b = piece["a"], piece["b"]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["rid", "start", "words"])
