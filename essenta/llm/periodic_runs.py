"""Periodic runs of words: stretches that repeat one block four times or more.

A document is exploded into overlapping tiles per octave of periods ``[P, 2P)``. A tile holds
16 P words and starts every 8 P words, so any stretch of three periods lies whole in some tile.
Tiles are solved alone: boundaries stand every P words, a hash of 2 P words finds the periods
that may pass a boundary, and the Z-values of the boundary (how far the words go on equal to
those one period later, forwards and backwards) give the exact fragment. Fragments are shuffled by
document and period and stitched into runs. The octaves whose tiles fit into ``TILE`` words share
one tile; a document of up to ``TILE`` words is one tile, solved where it is read.

Facts used: a stretch of ``length >= 4 * period`` contains a boundary followed by 2 P words of it.
Two periods of one octave at one boundary have a common divisor that is a shorter period, found in
its own octave; a boundary keeps its period only when it is the only one, so a text of one repeated
word costs no more than any other. Four periods of a stretch show whether a divisor of the period is
one as well; such fragments go, so every run that is stitched has its smallest period.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from essenta.llm.common import WORD, Folder

TILE = 8192  # words; a power of two
BATCH = 1 << 19  # words of short documents that are solved together
REPEATS, LEAST = 4, 6  # a run holds so many periods and so many words
_WORD = re.compile(WORD)
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(32)
FRAGMENT = pa.struct([("period", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
RUNS = "array<struct<start: long, length: long, period: long>>"
Edit = Callable[[object, list[str]], list[str]]


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = x * _A
    out += y
    out ^= out >> _S
    out *= _B
    return out


def z_value(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on (``step`` 1) or before it (-1) equal the word one period later."""
    n, found, size = len(words), 0, 32
    room = n - period - at if step > 0 else at
    while found < room:
        size = min(size, room - found)
        low = at + found if step > 0 else at - found - size
        same = words[low:low + size] == words[low + period:low + period + size]
        if not same.all():
            return found + int(np.argmin(same if step > 0 else same[::-1]))
        found, size = found + size, size * 4
    return found


def is_block(words: np.ndarray, at: int, period: int) -> bool:
    """Whether the block of ``period`` words at ``at``, which is repeated there, is no repetition itself."""
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            part = period // prime
            if (words[at:at + period] == words[at + part:at + part + period]).all():
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def solve(words: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """Fragments ``(period, start, stop)`` for the octaves ``low`` to ``high - 1``.

    In a fragment every word from ``start`` up to but not including ``stop`` equals the one a period
    later; it has at least three periods of such words, cannot be made longer within ``words``, and no
    smaller period divides its own.
    """
    out: set[tuple[int, int, int]] = set()
    h = _mix(words.astype(np.uint64), np.uint64(1))
    for k in range(high):
        size = 1 << k
        if len(words) < REPEATS * size:
            break
        h = _mix(h[:-size], h[size:])  # of windows of 2 * size words
        if k < low:
            continue
        rows = (len(h) - 1) // size
        if rows < 1:
            break
        later = h[size:(rows + 1) * size]
        hits = np.flatnonzero(later == np.repeat(h[:rows * size:size], size)[:len(later)])
        if not len(hits):
            continue
        row = hits // size
        new = np.concatenate([[True], row[1:] != row[:-1]])
        single = new & np.concatenate([new[1:], [True]])
        row, period = row[single], size + hits[single] % size
        if not len(row):
            continue
        first = np.concatenate([[True], (row[1:] != row[:-1] + 1) | (period[1:] != period[:-1])])
        for at, p in zip((row[first] * size).tolist(), period[first].tolist()):
            start, stop = at - z_value(words, at, p, -1), at + z_value(words, at, p, 1)
            if stop - start >= (REPEATS - 1) * p and is_block(words, start, p):
                out.add((p, start, stop))
    return sorted(out)


def tiles(n: int, tile: int = TILE) -> Iterator[tuple[int, int, int, int]]:
    """``(low, high, start, stop)``: octaves and words of the tiles of a document of ``n`` words."""
    low, high, size = 0, (tile // 16).bit_length(), tile
    while True:
        if size >= n:
            high = max(high, n.bit_length())
        start = 0
        while True:
            yield low, high, start, min(n, start + size)
            if start + size >= n:
                break
            start += size // 2
        if REPEATS << high > n:
            return
        low, high, size = high, high + 1, 16 << high


def numbered(words: list[str], known: dict[str, int]) -> np.ndarray:
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def _split(docs: DataFrame, edit: Edit | None, tile: int, keep_text: bool) -> DataFrame:
    """Each document with the fragments of its only tile, or its words and no fragments.

    ``text`` (words joined by one space) stays only where it is read again; ``digest`` is final where
    nothing can be dropped.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, texts, at = batch.column(1).to_pylist(), batch.column(2).to_pylist(), 0
            while at < len(ids):
                first, parts, size, mark, known = at, [], 0, -1, {}
                lists: list[list[str]] = []
                while at < len(ids) and size < BATCH:
                    words = _WORD.findall(texts[at] or "")
                    if edit and words:
                        words = edit(ids[at], words)
                    lists.append(words)
                    if len(words) <= tile:
                        # a number that occurs once keeps the documents apart
                        parts += [numbered(words, known), np.array([mark])]
                        mark, size = mark - 1, size + len(words) + 1
                    at += 1
                short = [k for k, w in enumerate(lists) if len(w) <= tile]
                edges = np.cumsum([0] + [len(lists[k]) + 1 for k in short])
                found: list[list | None] = [[] if len(w) <= tile else None for w in lists]
                if short:
                    for p, a, b in solve(np.concatenate(parts), 0, tile.bit_length()):
                        k = int(np.searchsorted(edges, a, "right")) - 1
                        found[short[k]].append({"period": p, "start": a - int(edges[k]), "stop": b - int(edges[k])})
                final = [f == [] for f in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, at - first), batch.column(1).slice(first, at - first), pa.array([len(w) for w in lists], pa.int64()),
                    pa.array([_digest(w) if f else None for w, f in zip(lists, final)], pa.string()),
                    pa.array([None if f and not keep_text else " ".join(w) for w, f in zip(lists, final)], pa.string()),
                    pa.array(found, pa.list_(FRAGMENT))], names=["rid", "doc_id", "n_words", "digest", "text", "found"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return rows.mapInArrow(step, f"rid long, doc_id {kind}, n_words long, digest string, text string, "
                                 "found array<struct<period: long, start: long, stop: long>>")


def _tiled(long: DataFrame, tile: int) -> DataFrame:
    """Fragments ``rid, period, start, stop`` of documents of several tiles, which are dealt out one by one."""

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = numbered(text.split(" "), {})
                for low, high, start, stop in tiles(len(words), tile):
                    yield pa.RecordBatch.from_pydict({
                        "rid": [rid], "low": [low], "high": [high], "first": [start], "words": [words[start:stop].astype(np.int32).tobytes()]})

    def each(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for rid, low, high, first, words in zip(*[c.to_pylist() for c in batch.columns]):
                found = solve(np.frombuffer(words, np.int32), low, high)
                yield pa.RecordBatch.from_arrays([
                    pa.array([rid] * len(found), pa.int64()), *[pa.array([f[0] if c == 0 else f[c] + first for f in found], pa.int64()) for c in (0, 1, 2)]],
                    names=["rid", "period", "start", "stop"])

    dealt = long.select("rid", "text").mapInArrow(cut, "rid long, low long, high long, first long, words binary").repartition("rid", "low", "first")
    return dealt.mapInArrow(each, "rid long, period long, start long, stop long")


def stitch(fragments: DataFrame) -> DataFrame:
    """Runs ``rid, start, length, period``: overlapping or touching fragments of a period are one stretch."""
    order = Window.partitionBy("rid", "period").orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    parts = parts.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = parts.groupBy("rid", "period", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    return whole.select("rid", "start", length.alias("length"), "period").where(f"length >= {LEAST}")


def collapse_runs(docs: DataFrame, edit: Edit | None = None, keep_text: bool = False, tile: int = TILE) -> DataFrame:
    """``doc_id, n_words, runs, collapsed_sha256`` (and ``collapsed``) of ``docs (doc_id, text)``.

    ``runs`` are the maximal stretches of ``length >= max(6, 4 * period)`` words by start and period,
    ``period`` the smallest. In the collapsed text each run keeps its first period; words are joined by
    one space. ``edit(doc_id, words)`` may change the words first. A null or empty text has no words, no
    runs and an empty collapsed text; a null id is kept. Repeated rows are answered one by one, further
    columns are not read, no rows give no rows. The runs of one document are gathered in one row: there
    are fewer of them than words.
    """
    folder = Folder(docs.sparkSession, "runs")
    solved = folder.write(_split(docs.select("doc_id", "text"), edit, tile, keep_text), "solved")
    found = solved.where("size(found) > 0").select("rid", F.inline("found"))
    long = _tiled(solved.where("found IS NULL"), tile)
    runs = stitch(found.unionByName(long)).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    again = solved.where("digest IS NULL").select("rid", "doc_id", "n_words", "text").join(runs, "rid", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def collapse(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts, digests = [], []
            for text, stretches in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split(" ") if text else []
                edge = np.zeros(len(words) + 1, np.int64)
                for s in stretches or ():
                    edge[s["start"] + s["period"]] += 1
                    edge[s["start"] + s["length"]] -= 1
                inside = edge.cumsum()[:-1] > 0
                kept = [w for w, drop in zip(words, inside.tolist()) if not drop]
                digests.append(_digest(kept))
                texts.append(" ".join(kept) if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], batch.column(3), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed_sha256", "collapsed"])

    schema = f"doc_id {kind}, n_words long, runs {RUNS}, collapsed_sha256 string, collapsed string"
    done = again.select("doc_id", "n_words", "text", "runs").mapInArrow(collapse, schema)
    rest = solved.where("digest IS NOT NULL").select(
        "doc_id", "n_words", F.lit(None).cast(RUNS).alias("runs"), F.col("digest").alias("collapsed_sha256"), F.col("text").alias("collapsed"))
    out = done.unionByName(rest).withColumn("runs", F.coalesce("runs", F.array().cast(RUNS)))
    return out if keep_text else out.drop("collapsed")


def report(found: DataFrame) -> DataFrame:
    """Digest columns of ``collapse_runs``: the run of greatest ``length / period`` and a hash of all."""
    runs = F.col("runs")
    # cross products compare the exact ratios; ties keep the earlier one, by start and then period
    best = F.reduce(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda a, b: F.when(
        b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), "collapsed_sha256")
