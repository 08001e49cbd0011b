"""Order statistics that never put a whole group into one task.

Ranks, positions, running totals and exact quantiles need an order within a group, and
a plain window sorts each group in one task. Here a group with more than ``splitRows``
rows is first cut into value ranges:

1. the range bounds of a large group come from a sample that is a pure function of its
   values (the value with the smallest hash per hash class), so every branch of the
   plan and every retried task sees the same bounds;
2. a window runs inside each (group, range);
3. the totals of the lower ranges are added to it.

The result equals the plain window. The split target grows with the input
(``total / 65536``), so at most about 131,072 bounds exist in all, and broadcasting
them is safe at any input size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from essenta.session import broadcast_rows, cut, split_rows

_MAX_RANGES = 65536
_OVERSAMPLE = 8
_SAMPLED = 128
_IN_MEMORY_ROWS = 100_000
_STEPS = [1 << k for k in range(17, -1, -1)]


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Join one statistics row per key; without keys ``stats`` is a single row."""
    if keys:
        return df.join(stats, list(keys), how)
    one = F.broadcast(stats.withColumn("_one", F.lit(1)))
    return df.withColumn("_one", F.lit(1)).join(one, "_one", how).drop("_one")


def _search(bounds: Column, value: Column) -> Column:
    """Number of bounds that are <= value, by binary search over the sorted array."""
    return F.aggregate(
        F.array(*[F.lit(s) for s in _STEPS]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= F.size(bounds)) & (F.get(bounds, at + step - 1) <= value), at + step
        ).otherwise(at),
    )


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups.

    One aggregate with map-side combine; a single row comes back.
    """
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    top = per.agg(F.max("_rows").alias("largest"), F.sum("_rows").alias("total")).first()
    return top["largest"] or 0, top["total"] or 0


def split_goal(df: DataFrame, keys: Sequence[str], sizes: tuple[int, int] | None = None) -> int | None:
    """Rows per range when some group is too large for one task, else None. ``sizes``: of ``group_sizes``, when known."""
    largest, total = group_sizes(df, keys) if sizes is None else sizes
    goal = max(split_rows(df.sparkSession), -(-total // _MAX_RANGES))
    return goal if largest > goal else None


def with_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], goal: int) -> DataFrame:
    """Add ``_range`` (0 for small groups) and ``_hot``; equal order values share a range."""
    keys = list(keys)
    every = df.withColumn("_ord", F.struct(*order))
    per = every.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    ranges = F.ceil(F.col("_rows") / goal)
    hot = per.where(F.col("_rows") > goal).select(
        *keys, ranges.alias("_ranges"), F.least(F.lit(1.0), ranges * _SAMPLED / F.col("_rows")).alias("_share"))
    sample = (
        attach(every.select(*keys, "_ord"), F.broadcast(hot), keys)
        .withColumn("_hash", F.xxhash64("_ord"))
        # only small hashes can be the smallest of a class, the rest need not be sorted
        .where(F.shiftrightunsigned("_hash", 1) <= F.col("_share") * float(1 << 63))
        .groupBy(*keys, F.pmod("_hash", F.col("_ranges") * _OVERSAMPLE).alias("_class"))
        .agg(F.min(F.struct("_hash", "_ord")).alias("_pick"))
    )
    bounds = sample.groupBy(*keys).agg(F.sort_array(F.collect_list("_pick._ord")).alias("_sorted"))
    bounds = bounds.select(
        *keys,
        F.filter("_sorted", lambda x, i: i % _OVERSAMPLE == _OVERSAMPLE - 1).alias("_bounds"),
    )
    joined = attach(every, F.broadcast(bounds), keys, "left")
    return joined.withColumns({
        "_hot": F.col("_bounds").isNotNull(),
        "_range": F.when(F.col("_bounds").isNull(), F.lit(0)).otherwise(
            _search(F.col("_bounds"), F.col("_ord"))),
    }).drop("_bounds", "_ord")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, str] | None = None,
    mins: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
    largest: int | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Running values in ascending ``order`` within ``keys``.

    ``sums``: output name -> column, the sum over all rows strictly before this one
    (``order`` must be unique within a group).
    ``mins``: output name -> column, the minimum up to and including this row.
    ``totals``: output name -> column, the sum over the whole group.
    ``largest``: an upper bound of the group size, when the caller knows one. ``sizes``: what ``group_sizes`` says of ``df``.
    """
    keys, sums, mins, totals = list(keys), sums or {}, mins or {}, totals or {}
    known_small = largest is not None and largest <= split_rows(df.sparkSession)
    goal = None if known_small else split_goal(df, keys, sizes)
    if goal is None:
        return _windowed(df, keys or [F.lit(1)], order, sums, mins, totals)

    # Several branches read the rows below, so they are written once and read from there.
    cut_rows = with_ranges(cut(df), keys, order, goal)
    part = [*keys, "_range"]
    partial = {f"_p_{c}": F.sum(c) for c in {*sums.values(), *totals.values()}}
    partial |= {f"_m_{c}": F.min(c) for c in set(mins.values())}
    blocks = cut_rows.where("_hot").groupBy(*part).agg(*[e.alias(n) for n, e in partial.items()])
    group = Window.partitionBy(*(keys or [F.lit(1)]))
    lower = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *part,
        *[F.sum(f"_p_{c}").over(lower).alias(f"_o_{o}") for o, c in sums.items()],
        *[F.min(f"_m_{c}").over(lower).alias(f"_o_{o}") for o, c in mins.items()],
        *[F.sum(f"_p_{c}").over(group).alias(f"_o_{o}") for o, c in totals.items()],
    )
    inner = _windowed(cut_rows, part, order, sums, mins, totals)
    out = inner.join(F.broadcast(offsets), part, "left")
    new: dict[str, Column] = {}
    for o in sums:
        new[o] = F.col(o) + F.coalesce(F.col(f"_o_{o}"), F.lit(0))
    for o in mins:
        new[o] = F.least(o, f"_o_{o}")
    for o in totals:
        new[o] = F.coalesce(f"_o_{o}", o)
    return out.withColumns(new).drop("_hot", "_range", *[f"_o_{o}" for o in (*sums, *mins, *totals)])


def _windowed(df, part, order, sums, mins, totals) -> DataFrame:
    whole = Window.partitionBy(*part)
    local = whole.orderBy(*order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({
        **{o: F.coalesce(F.sum(c).over(before), F.lit(0)) for o, c in sums.items()},
        **{o: F.min(c).over(upto) for o, c in mins.items()},
        **{o: F.sum(c).over(whole) for o, c in totals.items()},
    })


def value_counts(df: DataFrame, keys: Sequence[str], value: str, largest: int | None = None) -> DataFrame:
    """One row per (keys, value) with ``_c``, ``_before`` (rows below) and ``_n`` (group rows)."""
    keys = list(keys)
    base = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return running(base, keys, [value], sums={"_before": "_c"}, totals={"_n": "_c"}, largest=largest)


def tied_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average-tie rank of each distinct (keys, value); broadcast where the table is small enough."""
    keys = list(keys)
    base = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    sizes = group_sizes(base, keys)
    ranks = running(base, keys, [value], sums={"_before": "_c"}, sizes=sizes).select(
        *keys, value, (F.col("_before") + (F.col("_c") + 1) / F.lit(2.0)).alias(out))
    return F.broadcast(ranks) if sizes[1] <= broadcast_rows(df.sparkSession) else ranks


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", largest: int | None = None
) -> DataFrame:
    """Average-tie rank of ``value`` within ``keys`` (null values get no row).

    Groups that fit a task are ranked by one window. Otherwise ties are collapsed before
    the ordering, so a value shared by a third of all rows is one row there; the join back
    is split by adaptive execution when it is skewed. ``largest``: an upper bound of the
    group size, when the caller knows one.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    known_small = largest is not None and largest <= split_rows(df.sparkSession)
    if known_small or split_goal(rows, keys) is None:
        w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(value)
        tied = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        return rows.withColumn(out, F.rank().over(w) + (tied - 1) / F.lit(2.0))
    return rows.join(tied_ranks(rows, keys, value, out), [*keys, value])


def position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """1-based position in a total order (the exact ``row_number``), keyed by ``keys``."""
    numbered = running(df.withColumn("_unit", F.lit(1)), keys, order, sums={out: "_unit"})
    return numbered.withColumn(out, (F.col(out) + 1).cast("long")).drop("_unit")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], largest: int | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation: one row per key, one column per name.

    The built-in aggregate holds the distinct values of a group in memory, so it serves
    small groups only; larger ones are picked from the ordered value counts. ``largest``
    is the size of the largest group when the caller knows it.
    """
    largest = group_sizes(df, keys)[0] if largest is None else largest
    if largest <= min(_IN_MEMORY_ROWS, split_rows(df.sparkSession)):
        all_at_once = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()]))
        return df.groupBy(*keys).agg(all_at_once.alias("_q")).select(
            *keys, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(probs)])
    picked = pick_quantiles(value_counts(df, keys, value, largest), keys, value, probs)
    if not keys:
        return picked
    # groups without a value have a row of nulls, as above; a null key is a group too
    groups = df.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).distinct()
    same = reduce(and_, [F.col(f"_key{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)])
    return groups.join(picked, same, "left").select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], *probs)


def pick_quantiles(counted: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles from a ``value_counts`` table."""
    picks, finals = [], []
    for name, p in probs.items():
        at = (F.col("_n") - 1) * F.lit(float(p))
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_c"))
            picks.append(F.max(F.when(inside, F.col(value))).alias(f"_{name}_{side}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_w"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        finals.append((lo + (hi - lo) * F.col(f"_{name}_w")).alias(name))
    return counted.groupBy(*keys).agg(*picks).select(*keys, *finals)


def median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median", largest: int | None = None
) -> DataFrame:
    return quantiles(df, keys, value, {out: 0.5}, largest)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key; without keys the first ``k`` of the table.

    Without keys every task keeps ``k`` rows before they meet. With keys Spark does the same
    up to its window group limit (1,000 by default); for a larger ``k`` use ``position``.
    """
    if not keys:
        df = df.orderBy(*order).limit(k)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w).cast("long")).where(F.col(out) <= k)
