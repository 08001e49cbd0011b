"""Interpolated modified Kneser-Ney model over code point 5-grams, counted and joined in Spark.

A text is read as its code points, after ``ORDER - 1`` spaces. The n-grams are strings, so contexts and
suffixes are substrings and every join is exact; nothing bounds their number but the texts.

1. Documents are dealt by a hash of their id to buckets of about ``BUCKET`` bytes and travel as
   compressed record batches. Each bucket is reduced to its distinct n-grams with their counts in
   trusted documents (``bucket_grams``).
2. N-grams are added up over all buckets, and joins sharded by n-gram, context and suffix give the
   interpolated probability of every n-gram that occurs in any document (``estimate``).
3. The probabilities go back to the buckets that asked for them, as sorted arrays of 64-bit hashes with
   their costs, and every document is scored there (``scored``).

Buckets of even and of odd numbers have a model each, counted in the trusted documents of the other half: no
document is scored by a model that has seen it, so the trusted documents' scores are a fair sample for
quantiles. No text, n-gram or id passes the driver, and nothing is broadcast.
"""

from __future__ import annotations

import ctypes
import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from essenta.llm.common import Folder, own_name

ORDER = 5
ALPHABET = 0x110000  # code points; below single code points the model is uniform over them
BUCKET, CHUNK, PIECE = 32 << 20, 32 << 20, 1 << 19
ROWS = 1 << 16  # of a result that are sent to Spark at once
LEADING = 20  # bits of a hash that index the sorted ones
DRAWN = 100  # rows of all languages that a language's own quantiles are drawn towards
_STEP, _LAST, _REST = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 64) - 1), np.uint64(64 - LEADING)


def hashed(columns: Sequence[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams, given their first, second and further code points."""
    out = columns[0].astype(np.uint64)
    for k in range(1, ORDER):
        out ^= out >> np.uint64(29)
        out *= _STEP
        out += columns[k]
    out ^= out >> np.uint64(32)
    out *= _STEP
    return out


def hashes(points: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that ends at each code point from the first of the text on."""
    return hashed([points[k:len(points) - ORDER + 1 + k] for k in range(ORDER)])


def pieces(text: str) -> Iterator[np.ndarray]:
    """The code points after the spaces before the start, in pieces of at most ``PIECE`` n-grams, so that very long texts need no more memory.

    U+0000, which ends strings in arrays, is read as U+0001.
    """
    padded = " " * (ORDER - 1) + text.replace("\0", "\1")
    for start in range(0, len(text), PIECE):
        yield np.frombuffer(padded[start:start + PIECE + ORDER - 1].encode("utf-32-le", "replace"), np.uint32)


def as_strings(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = np.ascontiguousarray(points[at[:, None] + np.arange(ORDER)])
    return rows.view(f"<U{ORDER}").ravel()


class Hashes:
    """Sorted hashes, looked up by leading bits."""

    def __init__(self, keys: np.ndarray):
        self.size = len(keys)
        self.keys = np.append(keys, _LAST)  # where a search ends
        self.starts = np.zeros((1 << LEADING) + 1, np.int32)
        np.bincount((keys >> _REST).astype(np.int64), minlength=1 << LEADING).cumsum(out=self.starts[1:])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of the first hash that is not less than each of the keys."""
        at = self.starts[keys >> _REST]
        less = np.flatnonzero(self.keys[at] < keys)
        while len(less):
            at[less] += 1
            less = less[self.keys[at[less]] < keys[less]]
        return at


class Counts:
    """Distinct n-grams of a bucket with their counts, merged ``PIECE`` by ``PIECE``.

    Besides a piece only the distinct n-grams are in memory: the n-grams of a piece are looked up among
    them, and those that are new are put in between.
    """

    def __init__(self):
        self.known, self.grams, self.counts = Hashes(np.zeros(0, np.uint64)), np.zeros(0, f"<U{ORDER}"), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.shares: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str, trusted: bool) -> None:
        for points in pieces(text):
            self.waiting.append(points)
            self.shares.append(np.full(len(points) - ORDER + 1, trusted, bool))
            self.size += len(points)
            if self.size >= PIECE:
                self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        keys = np.concatenate([hashes(p) for p in self.waiting])
        counted = np.concatenate(self.shares)
        at = self.known.find(keys)
        new = np.flatnonzero((at == self.known.size) | (self.known.keys[at] != keys))
        if len(new):
            # places of the n-grams in the joined code points: each piece has ORDER - 1 more of these
            points, ends = np.concatenate(self.waiting), np.cumsum([len(s) for s in self.shares])
            fresh, first = np.unique(keys[new], return_index=True)
            first, places = new[first], at[new[first]]
            grams = as_strings(points, first + np.searchsorted(ends, first, "right") * (ORDER - 1))
            self.grams, self.counts = np.insert(self.grams, places, grams), np.insert(self.counts, places, 0)
            self.known = Hashes(np.insert(self.known.keys[:-1], places, fresh))
            at = self.known.find(keys)
        self.counts += np.bincount(at[counted], minlength=self.known.size)
        self.waiting, self.shares, self.size = [], [], 0


class HashArrays:
    """A bucket's part of the model: sorted hashes of its n-grams and their costs."""

    def __init__(self, grams: pa.ChunkedArray, bits: np.ndarray):
        keys = [np.zeros(0, np.uint64)]
        for chunk in grams.chunks:  # as many rows as Spark sends at once
            points = np.array(chunk.to_pylist(), f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)
            keys.append(hashed(points.T))
        keys = np.concatenate(keys)
        order = keys.argsort()
        self.known, self.costs = Hashes(keys[order]), bits[order]

    def total(self, text: str) -> tuple[int, float]:
        """Number of code points and their cost in bits."""
        size, total = 0, 0.0
        for points in pieces(text):
            keys = hashes(points)
            # every n-gram was asked for, so each is found
            total += float(self.costs[self.known.find(keys)].sum(dtype=np.float64))
            size += len(keys)
        return size, total


def released() -> None:
    """Gives memory that Arrow and numpy no longer need back to the system: Spark keeps a worker for the stages to come."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc, which else keeps what lies below anything in use
    if trim:
        trim(0)


def bucket_of(key: Column, number: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(number)).cast("int")


def packed(docs: DataFrame, bucket: str) -> DataFrame:
    """``bucket, rows``: the rows of ``docs`` by bucket, as compressed record batches without the bucket."""

    def step(batches: Iterator[pa.RecordBatch]):
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= CHUNK:
                yield from cut(waiting)
                waiting, size = [], 0
        yield from cut(waiting)
        released()

    def cut(waiting):
        if not sum(b.num_rows for b in waiting):
            return
        rows = pa.Table.from_batches(waiting)
        buckets = rows.column(bucket).to_numpy()
        order = buckets.argsort(kind="stable")
        starts = np.flatnonzero(np.diff(buckets[order], prepend=-1))
        rows, options = rows.drop_columns([bucket]), pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))
        for start, end in zip(starts, [*starts[1:], len(order)]):
            part = rows.take(order[start:end])
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_table(part, max_chunksize=256)
            yield pa.RecordBatch.from_arrays([pa.array([buckets[order[start]]], pa.int32()), pa.array([sink.getvalue()], pa.binary())], names=["bucket", "rows"])

    return docs.mapInArrow(step, "bucket int, rows binary")


def unpacked(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for blob in table.column("rows"):
        with pa.ipc.open_stream(blob.as_buffer()) as stream:
            yield from stream


def bucket_grams(blobs: DataFrame, trusted: DataFrame, key: str, text: str) -> DataFrame:
    """``bucket, gram, c``: distinct n-grams of each bucket and their counts in its trusted documents."""

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        known, counts = set(right.column("id").to_pylist()), Counts()
        for batch in unpacked(left):
            for name, value in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist()):
                if value:
                    counts.add(value, name in known)
        counts.merge()
        bucket = left.column("bucket")[0].as_py() if left.num_rows else 0
        found = pa.table({"bucket": pa.array(np.full(len(counts.grams), bucket), pa.int32()), "gram": pa.array(counts.grams, pa.string()), "c": pa.array(counts.counts)})
        del known, counts
        released()
        return pa.Table.from_batches(found.to_batches(ROWS), found.schema)

    return blobs.groupBy("bucket").cogroup(trusted.groupBy("bucket")).applyInArrow(step, "bucket int, gram string, c long")


def _discounts(counts: DataFrame) -> dict[int, list[float]]:
    """Modified Kneser-Ney discounts of each model from the numbers of n-grams seen once to four times."""
    out = {0: [0.5, 1.0, 1.5], 1: [0.5, 1.0, 1.5]}
    for row in counts.groupBy("model").agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect():
        n = [max(1, row[f"n{k}"]) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        out[row["model"]] = [min(float(k), max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3)]
    return out


def estimate(counts: DataFrame, folder: Folder) -> DataFrame:
    """``model, gram, p``: the interpolated probability of the last code point of each n-gram.

    ``counts (model, gram, c)`` holds every n-gram that is asked for; ``c`` is 0 for those that the model has not
    seen. Lower orders count the code points that an n-gram was seen after. Each order is joined
    with the sums of its contexts and with the order below, sharded by context and by suffix; an
    n-gram whose context was never seen has the probability of its suffix.
    """
    by_order = {ORDER: counts}
    for o in range(ORDER - 1, 0, -1):
        by_order[o] = folder.write(by_order[o + 1].groupBy("model", F.substring("gram", 2, o).alias("gram")).agg(
            F.sum((F.col("c") > 0).cast("long")).alias("c")), f"continuations{o}")
    lower = None
    for o in range(1, ORDER + 1):
        d = _discounts(by_order[o])
        off = F.lit(0.0)
        for m in d:
            c = F.col("c")
            off = F.when((F.col("model") == m) & (c > 0), F.when(c >= 3, d[m][2]).when(c == 2, d[m][1]).otherwise(d[m][0])).otherwise(off)
        rows = by_order[o].select("model", "gram", "c", off.alias("off"), F.substring("gram", 1, o - 1).alias("context"))
        sums = rows.groupBy("model", "context").agg(F.sum("c").alias("total"), F.sum("off").alias("left"))
        rows = rows.join(sums, ["model", "context"])
        if o == 1:
            rows = rows.withColumn("lower", F.lit(1.0 / ALPHABET))
        else:
            below = lower.select("model", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            rows = rows.withColumn("suffix", F.substring("gram", 2, o - 1)).join(below, ["model", "suffix"])
        p = F.when(F.col("total") > 0, (F.col("c") - F.col("off") + F.col("left") * F.col("lower")) / F.col("total")).otherwise(F.col("lower"))
        lower = folder.write(rows.select("model", "gram", p.alias("p")), f"model{o}")
    return lower


def scored(docs: DataFrame, trusted: DataFrame, folder: Folder, text: str, doc_id: str, names: tuple[str, str],
           extra: tuple[str, Callable[[str | None], tuple]] | None = None, keep_text: bool = True) -> DataFrame:
    """``docs`` with the number of code points and their mean cost in bits (null for an empty text), stored.

    ``trusted (doc_id)`` names the documents that the model is trained on. ``extra`` is a schema of long
    columns and the function of a text that gives them. Rows without an id are dealt by their text.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    number = 2 * max(1, -(-size // (2 * BUCKET)))
    bucket, key = own_name(docs, "bucket", "key")
    rows = docs.withColumn(key, F.col(doc_id).cast("string"))
    rows = rows.withColumn(bucket, bucket_of(F.coalesce(F.col(key), F.col(text)), number))
    schema, columns = rows.schema, [c for c in docs.columns if keep_text or c != text]
    blobs = packed(rows, bucket)
    ids = trusted.select(F.col("doc_id").cast("string").alias("id"))
    asked = folder.write(bucket_grams(blobs, ids.withColumn("bucket", bucket_of(F.col("id"), number)), key, text), "asked")
    # asked of the model of the own half, counted for the model of the other one
    half = F.col("bucket") % 2
    both = asked.select(F.inline(F.array(
        F.struct(half.alias("model"), "gram", F.lit(0).cast("long").alias("c")), F.struct((1 - half).alias("model"), "gram", "c"))))
    model = estimate(folder.write(both.groupBy("model", "gram").agg(F.sum("c").alias("c")), "counts"), folder)
    answers = asked.select("bucket", half.alias("model"), "gram").join(model, ["model", "gram"]).select(
        "bucket", "gram", (-F.log2("p")).cast("float").alias("bits"))

    def step(left: pa.Table, right: pa.Table) -> pa.Table:
        part = HashArrays(right.column("gram"), right.column("bits").to_numpy())
        out = []
        for batch in unpacked(left):
            texts = batch.column(text).to_pylist()
            totals = [part.total(t) if t else (0, 0.0) for t in texts]
            new = [pa.array([n for n, _ in totals], pa.int64()), pa.array([x / n if n else None for n, x in totals], pa.float64())]
            if extra:
                new += [pa.array(c, pa.int64()) for c in zip(*[extra[1](t) for t in texts])]
            out.append(pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *new], names=[*columns, *fields]))
        del part
        released()
        return pa.Table.from_batches(out) if out else empty

    fields = [*names, *([c.split()[0] for c in extra[0].split(", ")] if extra else [])]
    kinds = [f"`{c}` {schema[c].dataType.simpleString()}" for c in columns] + [f"`{names[0]}` long", f"`{names[1]}` double"] + ([extra[0]] if extra else [])
    empty = to_arrow_schema(StructType.fromDDL(", ".join(kinds))).empty_table()
    return folder.write(blobs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(step, ", ".join(kinds)), "scored")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say quality 1."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def shrunk(symbols: str, cost: str, centre: str, prior: int) -> Column:
    """Mean cost with ``prior`` more code points at the typical cost: that of a short text strays widely."""
    return (F.col(symbols) * F.col(cost) + prior * F.col(centre)) / (F.col(symbols) + prior)


def bounds_of(scored: DataFrame, trusted: DataFrame, prior: int, tail: float, drawn: int = DRAWN) -> DataFrame:
    """``language, centre, low, high`` of every language with a trusted document, from ``scored (doc_id, language, symbols, cost)``.

    ``centre`` is the median of the language's trusted documents, ``low`` and ``high`` are the ``tail`` and ``1 - tail`` quantiles of
    their scores. With n trusted documents the distance of a quantile from the centre is the mean of the own
    one, weight n, and of the one over all languages, weight ``drawn``: there is no switch at any n.
    """
    rows = scored.where("cost is not null").join(trusted, "doc_id", "left_semi")
    centres = rows.groupBy("language").agg(F.percentile_approx("cost", 0.5, 20_000).alias("centre"))
    known = centres.select(F.col("language").alias("l"), "centre")
    away = rows.join(known, F.col("language").eqNullSafe(F.col("l"))).select(
        "language", "centre", (shrunk("symbols", "cost", "centre", prior) - F.col("centre")).alias("away"))
    qs = F.percentile_approx("away", [tail, 1 - tail], 20_000)
    own = away.groupBy("language", "centre").agg(qs.alias("q"), F.count(F.lit(1)).alias("n"))
    every = F.broadcast(away.agg(qs.alias("all")))  # one row
    side = lambda k: F.col("centre") + (F.col("n") * F.col("q")[k] + drawn * F.col("all")[k]) / (F.col("n") + drawn)
    return own.crossJoin(every).select("language", "centre", side(0).alias("low"), side(1).alias("high"))


def with_bounds(df: DataFrame, bounds: DataFrame, language: str, names: tuple[str, str, str]) -> DataFrame:
    """``df`` with the centre and the bounds of its language, null where it has no trusted document."""
    own = bounds.select(F.col("language").alias("_l"), *[F.col(c).alias(f"_{c}") for c in ("centre", "low", "high")])
    joined = df.join(own, df[language].eqNullSafe(F.col("_l")), "left")
    return joined.select(*[df[c] for c in df.columns], *[F.col(f"_{c}").alias(n) for c, n in zip(("centre", "low", "high"), names)])
