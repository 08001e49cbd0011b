"""Single-cell quality control and reduction on non-zero count rows.

Rows ``(plate, cell, gene, count)`` hold non-zero counts only. Means and variances count
the absent zeros through the number of cells, so no matrix is ever filled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from essenta.functions import columns as C
from essenta.functions.columns import dot
from essenta.operators.order import attach, group_sizes, median, quantiles, running, top_rows
from essenta.operators.topk import top_with_ties
from essenta.session import bounded_broadcast, cut

CELL = ["plate", "cell"]
# Outlier width, top genes, total per gene, share of variable genes.
OUTLIER_MADS = 5
TOP_GENES = 20
GENE_TOTAL = 200
VARIABLE_SHARE = 0.1
# Scale that makes the median absolute deviation a normal sd.
_MAD_TO_SD = 0.6744897501960817
_LEAF_ROWS = 2048
_PIVOTS = 4096
_WAYS = 4
_TILE = 16  # blocks of neighbours that travel together: about 32,768 rows
_PIECE = 128  # rows whose distances to a tile or to all pivots are in memory at once


def gene_flags(gene: Column) -> dict[str, Column]:
    return {"mito": C.is_mito(gene), "ribo": C.is_ribo(gene), "hb": C.is_hemo(gene)}


def cell_metrics(counts: DataFrame, top: int = TOP_GENES, flags: dict[str, Column] | None = None) -> DataFrame:
    """Totals, genes seen, their log1p, share of the top genes and of every flagged class."""
    flags = flags if flags is not None else gene_flags(F.col("gene"))
    rows = counts.where("count > 0")
    count = F.col("count")
    per = rows.groupBy(*CELL).agg(
        F.sum("count").alias("total_counts"), F.count(F.lit(1)).alias("n_genes"),
        *[F.sum(F.when(flag, count).otherwise(0)).alias(f"_{name}") for name, flag in flags.items()])
    best = top_rows(rows, CELL, [F.desc("count"), F.col("gene")], top).groupBy(*CELL).agg(F.sum("count").alias("_top"))
    total = F.col("total_counts")
    return per.join(best, CELL).select(
        *CELL, "total_counts", "n_genes", F.log1p(total).alias("log1p_total"), F.log1p("n_genes").alias("log1p_genes"),
        (F.col("_top") / total * 100).alias(f"pct_top_{top}"),
        *[(F.col(f"_{name}") / total * 100).alias(f"pct_{name}") for name in flags])


def gene_metrics(counts: DataFrame, n_cells: DataFrame) -> DataFrame:
    """Per gene: cells it is seen in, total, mean over all cells, dropout. ``n_cells``: one row."""
    per = counts.where("count > 0").groupBy("gene").agg(
        F.count(F.lit(1)).alias("cells_seen"), F.sum("count").alias("total_counts"))
    n = F.col("n_cells")
    return attach(per, n_cells).select(
        "gene", "cells_seen", "total_counts", F.log1p("total_counts").alias("log1p_total"),
        (F.col("total_counts") / n).alias("mean_counts"), ((1 - F.col("cells_seen") / n) * 100).alias("pct_dropout"))


def cell_number(counts: DataFrame) -> DataFrame:
    return counts.select(*CELL).distinct().agg(F.count(F.lit(1)).alias("n_cells"))


def mad_outlier(df: DataFrame, metric: str, keys: Sequence[str] = ("plate",), mads: float = OUTLIER_MADS, out: str = "outlier") -> DataFrame:
    """True when further than ``mads`` raw median absolute deviations from the group median."""
    keys = list(keys)
    largest = group_sizes(df, keys)[0]  # the deviations fall into the same groups
    mid = median(df, keys, metric, "_mid", largest)
    dev = attach(df, mid, keys).withColumn("_dev", F.abs(F.col(metric) - F.col("_mid")))
    spread = median(dev, keys, "_dev", "_mad", largest)
    wide = F.col("_mad") * mads
    return attach(dev, spread, keys).withColumn(
        out, (F.col(metric) < F.col("_mid") - wide) | (F.col("_mid") + wide < F.col(metric))).drop("_mid", "_mad", "_dev")


def outlier_cells(metrics: DataFrame, columns: Sequence[str] = ("log1p_total", "log1p_genes", "pct_top_20")) -> DataFrame:
    """Cells that are an outlier of their plate in any of the metrics."""
    # the medians read the metrics, one row per cell and metric, several times
    metrics = cut(metrics)
    long = metrics.select(*CELL, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        CELL, list(columns), "_metric", "_x")
    flags = mad_outlier(long, "_x", ["plate", "_metric"], out="_out").groupBy(*CELL).agg(F.bool_or("_out").alias("outlier"))
    return metrics.join(flags, CELL)


def keep_genes(counts: DataFrame, keys: Sequence[str] = ("plate",), total: int = GENE_TOTAL) -> DataFrame:
    """Rows of the genes whose total per plate is above the limit."""
    keys = list(keys)
    good = counts.groupBy(*keys, "gene").agg(F.sum("count").alias("_s")).where(F.col("_s") > total)
    return counts.join(good.select(*keys, "gene"), [*keys, "gene"], "left_semi")


def join_plates(*plates: DataFrame) -> DataFrame:
    """Row union of plates; genes missing in a plate need no fill. Cell ids get the plate as suffix."""
    out = plates[0]
    for other in plates[1:]:
        out = out.unionByName(other)
    return out.withColumn("cell_id", F.concat_ws("-", "cell", "plate"))


def filter_plates(counts: DataFrame) -> DataFrame:
    """The whole plate-wise filter: metrics, outliers, then genes by total."""
    flagged = outlier_cells(cell_metrics(counts))
    kept = counts.join(flagged.where("NOT outlier").select(*CELL), CELL, "left_semi")
    return join_plates(keep_genes(kept))


# Variable genes and scaling -------------------------------------------------------


def gene_moments(values: DataFrame, n_cells: DataFrame, value: str = "value") -> DataFrame:
    """Mean and sample variance per gene with absent zeros counted."""
    x = F.col(value)
    sums = values.groupBy("gene").agg(F.sum(x).alias("_s"), F.sum(x * x).alias("_ss"))
    n = F.col("n_cells").cast("double")
    mean = F.col("_s") / n
    return attach(sums, n_cells).select(
        "gene", mean.alias("mean"), F.greatest((F.col("_ss") - n * mean * mean) / F.nullif(n - 1, F.lit(0.0)), F.lit(0.0)).alias("variance"))


def variable_genes(moments: DataFrame, share: float = VARIABLE_SHARE, number: int | None = None) -> DataFrame:
    """Genes with the largest dispersion relative to genes of similar mean.

    Bins of the mean have their edges at the 10, 15, ..., 100 % quantiles; the dispersion is
    centred by the bin median and divided by the bin's scaled median absolute deviation.
    """
    table = cut(moments.withColumn("dispersion", F.col("variance") / F.greatest("mean", F.lit(1e-12))))
    probs = {f"_e{p}": p / 100 for p in range(10, 105, 5)}
    edges = quantiles(table, [], "mean", probs)
    binned = attach(table, edges).withColumn("bin", sum(
        (F.when(F.col(e) < F.col("mean"), 1).otherwise(0) for e in probs), F.lit(0))).drop(*probs)
    binned = cut(binned)
    mid = attach(binned, median(binned, ["bin"], "dispersion", "_mid"), ["bin"])
    dev = mid.withColumn("_dev", F.abs(F.col("dispersion") - F.col("_mid")))
    spread = median(dev, ["bin"], "_dev", "_mad")
    normal = (F.col("dispersion") - F.col("_mid")) / F.nullif(F.col("_mad") / _MAD_TO_SD, F.lit(0.0))
    scored = attach(dev, spread, ["bin"]).withColumn("score", normal).drop("_mid", "_mad", "_dev")
    k = number if number is not None else int(table.count() * share)
    return top_with_ties(scored.where("score IS NOT NULL"), [], "score", k).drop("rank")


def scale_genes(values: DataFrame, moments: DataFrame, most: float = 10.0, value: str = "value") -> DataFrame:
    """Scaled values of the rows that occur, capped, with the value a zero has (``background``).

    The centring of the zeros stays implicit in one number per gene.
    """
    sd = F.when(F.col("variance") > 0, F.sqrt("variance")).otherwise(F.lit(1.0))
    stats = moments.select("gene", F.col("mean").alias("_m"), sd.alias("_sd"))
    return values.join(bounded_broadcast(stats), "gene").withColumns({
        "scaled": F.least((F.col(value) - F.col("_m")) / F.col("_sd"), F.lit(most)),
        "background": F.least(-F.col("_m") / F.col("_sd"), F.lit(most))}).drop("_m", "_sd")


def components(scaled: DataFrame, genes: DataFrame, k: int = 50) -> DataFrame:
    """Principal components ``(plate, cell, z ARRAY)`` of the selected genes.

    Components do not change when a constant vector is added to every cell, so a cell only
    holds ``scaled - background``, which is 0 for absent counts; scores are centred after.
    """
    names = genes.select("gene").distinct().agg(F.array_sort(F.collect_list("gene")).alias("_genes"))
    kept = scaled.join(genes.select("gene"), "gene", "left_semi")
    packed = kept.groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct(
        "gene", F.col("scaled") - F.col("background")))).alias("_x"))
    dense = attach(packed, names).select(*CELL, array_to_vector(F.transform(
        "_genes", lambda g: F.coalesce(F.try_element_at("_x", g), F.lit(0.0)))).alias("features"))
    dense = cut(dense)
    model = PCA(k=k, inputCol="features", outputCol="_pc").fit(dense)
    scores = model.transform(dense).select(*CELL, vector_to_array("_pc").alias("z"))
    centre = scores.agg(F.array(*[F.avg(F.get("z", F.lit(i))) for i in range(k)]).alias("_c"))
    return attach(scores, centre).select(*CELL, F.zip_with("z", "_c", lambda a, b: a - b).alias("z"))


# Neighbours -----------------------------------------------------------------------


def _closest(
    queries: np.ndarray, asking: np.ndarray, data: np.ndarray, names: np.ndarray, k: int, most: np.ndarray | None = None, piece: int = 512,
) -> pd.DataFrame:
    """Up to ``k`` rows of ``data`` for each query, itself excluded, by distance and then by name.

    ``most``: a distance per query above which no row is wanted. ``piece`` queries are compared at a time.
    """
    out: tuple[list, list, list] = ([], [], [])
    place = np.argsort(np.argsort(names, kind="stable"), kind="stable")
    squares = (data * data).sum(axis=1)
    own = {name: j for j, name in enumerate(names)}
    for at in range(0, len(queries), piece):
        part, who = queries[at:at + piece], asking[at:at + piece]
        near = part @ data.T
        near *= -2
        near += (part * part).sum(axis=1)[:, None]
        near += squares[None, :]
        for i, name in enumerate(who):
            if name in own:
                near[i, own[name]] = np.inf
        # all that the fast form cannot tell from the k-th are measured exactly
        slack = 1e-9 * ((part * part).sum(axis=1) + squares.max(initial=0.0)) + 1e-12
        bound = np.full(len(part), np.inf) if most is None else most[at:at + piece] ** 2 + slack
        for i, row in enumerate(near):
            found = np.nonzero((row <= bound[i]) & (row < np.inf))[0]
            if len(found) > k:
                close = row[found]
                found = found[close <= np.partition(close, k - 1)[k - 1] + slack[i]]
            gap = np.sqrt(((part[i] - data[found]) ** 2).sum(axis=1))
            best = np.lexsort((place[found], gap))[:k]
            out[0].append(np.repeat(who[i], len(best)))
            out[1].append(names[found[best]])
            out[2].append(gap[best])
    flat = [np.concatenate(x) if x else np.array([]) for x in out]
    return pd.DataFrame({"sample": flat[0], "neighbour": flat[1], "distance": flat[2].astype(float)})


def _leaf_neighbours(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, names = np.vstack(pdf["z"].to_numpy()), pdf["sample"].to_numpy()
        return _closest(z, names, z, names, k)

    return run


def _gaps(z: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((z * z).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * z @ pivots.T, 0.0))


def nearest(z: DataFrame, k: int = 20, cell: int = _LEAF_ROWS, seed: int = 0) -> DataFrame:
    """The k nearest neighbours of every ``(sample, z ARRAY)``: ``(sample, neighbour, distance, rank)``.

    Exact at every size. Samples belong to the cell of their nearest pivot (a hash sample of
    at most ``_PIVOTS``), cells are dealt into blocks of about ``cell`` rows. The k-th distance
    inside the own block bounds the search; another block is asked only if the triangle inequality
    with its pivot and radius does not rule it out. Blocks of near cells travel as tiles of at most
    ``_TILE`` blocks: a task compares a tile of queries with those blocks of another tile that any of the
    queries asks for and returns at most k rows per query, so its memory does not grow with the
    input. Where nothing can be ruled out (many dimensions), every tile meets every
    other: pairs grow with the square of the rows. Ties go by name.
    """
    z = cut(z.select("sample", "z"))
    kind = z.schema["sample"].dataType.simpleString()
    n = z.count()
    count = min(_PIVOTS, max(1, -(-n // cell)))
    pivots = np.array([r["z"] for r in z.orderBy(F.xxhash64("sample", F.lit(seed)), "sample").limit(count).collect()], dtype=float)
    if not n:
        return z.select("sample", F.col("sample").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(1).cast("long").alias("rank"))

    def place(batches):
        for pdf in batches:
            for at in range(0, len(pdf), _PIECE):
                part = pdf.iloc[at:at + _PIECE]
                gap = _gaps(np.vstack(part["z"].to_numpy()), pivots)
                yield part.assign(cell=gap.argmin(1), gap=gap.min(1))

    placed = cut(z.mapInPandas(place, f"sample {kind}, z array<double>, cell long, gap double"))
    found = {r["cell"]: (r["radius"], -(-r["n"] // cell)) for r in placed.groupBy("cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    radius = np.array([found.get(c, (-np.inf, 0))[0] for c in range(count)])
    blocks = np.array([found.get(c, (0, 0))[1] for c in range(count)], dtype=int)
    many = F.element_at(F.lit(blocks.tolist()).cast("array<int>"), (F.col("cell") + 1).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("sample"), many).cast("int"))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        own, names = np.vstack(pdf["z"].to_numpy()), pdf["sample"].to_numpy()
        best = _closest(own, names, own, names, k)
        by = {name: (list(g["neighbour"]), list(g["distance"])) for name, g in best.groupby("sample", sort=False)}
        lists = [by.get(name, ([], [])) for name in names]
        return pdf.assign(most=[d[-1] if len(d) == k else np.inf for _, d in lists], neighbours=[m for m, _ in lists], distances=[d for _, d in lists])[
            ["sample", "z", "cell", "block", "most", "neighbours", "distances"]]

    bounded = cut(placed.groupBy("cell", "block").applyInPandas(
        bound, f"sample {kind}, z array<double>, cell long, block int, most double, neighbours array<{kind}>, distances array<double>"))
    found_here = bounded.select("sample", F.explode(F.arrays_zip("neighbours", "distances")).alias("e")).select(
        "sample", F.col("e.neighbours").alias("neighbour"), F.col("e.distances").alias("distance"))
    if blocks.sum() == 1:  # every sample was compared with all others
        return top_rows(found_here, ["sample"], [F.col("distance"), F.col("neighbour")], k)

    # cells in the order of the nearest of a few pivots, so that a tile holds cells that lie together
    far = _gaps(pivots, pivots[:max(1, int(np.sqrt(count)))])
    order = np.lexsort((far.min(1), far.argmin(1)))
    first = np.zeros(count, dtype=int)
    first[order] = np.concatenate([[0], np.cumsum(blocks[order])[:-1]])
    wide = int(min(_TILE, max(1, -(-blocks.sum() // 8))))
    number = F.element_at(F.lit(first.tolist()).cast("array<int>"), (F.col("cell") + 1).cast("int")) + F.col("block")
    tile = F.floor(number / wide).cast("int")

    def ask(batches):
        for pdf in batches:
            for at in range(0, len(pdf), _PIECE):
                part = pdf.iloc[at:at + _PIECE]
                gap = _gaps(np.vstack(part["z"].to_numpy()), pivots)
                most, mine = part["most"].to_numpy()[:, None], part["tile"].to_numpy()
                hit = gap - radius[None, :] <= most + 1e-6 * (1 + np.where(np.isfinite(most), most, 0))
                for t in np.unique(mine):
                    asked = np.nonzero(hit[mine == t].any(axis=0) & (blocks > 0))[0]
                    yield pd.DataFrame({"tile": np.full(len(asked), t), "cell": asked})

    queries = bounded.select("sample", "z", "most", tile.alias("tile"))
    asks = cut(queries.select("z", "most", "tile").mapInPandas(ask, "tile int, cell long").distinct())
    to = F.explode(F.sequence(*[
        F.floor((F.element_at(F.lit(ends.tolist()).cast("array<int>"), (F.col("cell") + 1).cast("int"))) / wide).cast("int")
        for ends in (first, first + np.maximum(blocks, 1) - 1)]))
    wanted = bounded_broadcast(asks.select("tile", to.alias("other")).distinct())
    asked = queries.join(wanted, "tile")
    data = placed.select("sample", "z", "cell", tile.alias("other")).join(bounded_broadcast(asks), "cell").drop("cell")

    def meet(asked: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(stored):
            return pd.DataFrame({"sample": [], "neighbour": [], "distance": []})
        return _closest(np.vstack(asked["z"].to_numpy()), asked["sample"].to_numpy(), np.vstack(stored["z"].to_numpy()), stored["sample"].to_numpy(),
                        k, asked["most"].to_numpy(), _PIECE)

    key = ["tile", "other"]
    pairs = asked.groupBy(*key).cogroup(data.groupBy(*key)).applyInPandas(meet, f"sample {kind}, neighbour {kind}, distance double")
    return top_rows(pairs, ["sample"], [F.col("distance"), F.col("neighbour")], k)


def nearest_by_trees(z: DataFrame, k: int = 20, trees: int = 8, leaf: int = _LEAF_ROWS, seed: int = 0) -> DataFrame:
    """Approximate neighbours, as ``nearest``.

    Random-projection trees cut the samples at exact quantiles into leaves of at most
    ``leaf`` rows, however the data are spread, and the best of all trees is kept.
    """
    z = cut(z.select("sample", "z"))
    n = z.count()
    width = z.select(F.size("z").alias("d")).first()["d"] if n else 0
    levels = 0
    while n / _WAYS**levels > leaf:
        levels += 1
    trees = trees if levels else 1
    rng = np.random.default_rng(seed)
    ways = rng.standard_normal((trees, max(levels, 1), width))
    spots = F.array(*[F.struct(F.lit(i).alias("tree"), F.array(*[
        dot(F.col("z"), F.array(*[F.lit(float(x)) for x in ways[i, j]])) for j in range(levels)]).cast(
            "array<double>").alias("cuts")) for i in range(trees)])
    placed = z.select("sample", F.explode(spots).alias("s")).select("sample", "s.tree", "s.cuts", F.lit(0).cast("long").alias("node"))
    placed = placed.withColumn("_one", F.lit(1))
    for level in range(levels):
        at = placed.withColumn("_at", F.get("cuts", F.lit(level)))
        spread = running(at, ["tree", "node"], ["_at", "sample"], sums={"_pos": "_one"}, totals={"_n": "_one"})
        part = F.floor(F.col("_pos") * _WAYS / F.col("_n"))
        placed = cut(spread.withColumn("node", F.col("node") * _WAYS + part).drop("_at", "_pos", "_n"))
    leaves = placed.select("sample", "tree", "node").join(z, "sample")
    pairs = leaves.groupBy("tree", "node").applyInPandas(
        _leaf_neighbours(k), f"sample {z.schema['sample'].dataType.simpleString()}, "
        f"neighbour {z.schema['sample'].dataType.simpleString()}, distance double")
    once = pairs.groupBy("sample", "neighbour").agg(F.min("distance").alias("distance")) if levels else pairs
    return top_rows(once, ["sample"], [F.col("distance"), F.col("neighbour")], k)
