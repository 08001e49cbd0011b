"""The low-rank factor model: splits, scaling, moment tables, fits and search.

``Z = G W`` (samples x K), responses are predicted as ``Z h``. Every step of a fit depends
on the rows only through the second moments of ``v = (features, responses, 1)``, so the
rows are read once: blocks of rows become partial ``v'v`` matrices inside their tasks, and
the partials are added. The fits of all (model, trial, fold) then run in parallel on
matrices of at most a few hundred columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from essenta.operators.order import running
from essenta.operators.statistics import spearman
from essenta.operators.topk import arg_min, feature_set, top_features
from essenta.session import bounded_broadcast

MOST_FEATURES = 4096
_BLOCK_ROWS = 100_000
_FLUSH_DOUBLES = 1 << 24
_PARTIALS = 1000

# The search space.
LATENT_LOW, LATENT_HIGH, LATENT_STEP = 10, 70, 5
RATE_LOW, RATE_HIGH = 1e-5, 1e-2
LAMBDA_LOW, LAMBDA_HIGH = 1e-5, 1e-1


# Splits and scaling ---------------------------------------------------------------


def split_samples(
    cohort: DataFrame, keys: Sequence[str] = ("model_id",), seed: str = "seed",
    n_splits: int = 5, test_size: float = 0.2,
) -> DataFrame:
    """Seeded hold-out split and contiguous folds: ``(*keys, sample, split, fold)``.

    Samples are ordered by a hash of name and seed. The first ``floor(n * test_size)`` are
    the test set; the rest form ``n_splits`` folds, the first ones a sample larger. Test
    rows carry fold -1.
    """
    keys = list(keys)
    hashed = cohort.select(*keys, seed, "sample").distinct().withColumns({
        "_hash": F.md5(F.concat_ws("|", "sample", F.col(seed).cast("string"))), "_one": F.lit(1)})
    placed = running(hashed, keys, ["_hash", "sample"], sums={"_pos": "_one"}, totals={"_n": "_one"})
    held = F.floor(F.col("_n") * F.lit(float(test_size)))
    at, left = F.col("_pos") - held, F.col("_n") - held  # 0-based place in the training part
    small = F.floor(left / n_splits)
    larger = left % n_splits
    edge = larger * (small + 1)
    fold = F.when(at < edge, F.floor(at / (small + 1))).otherwise(larger + F.floor((at - edge) / F.greatest(small, F.lit(1))))
    is_test = F.col("_pos") < held
    return placed.select(
        *keys, "sample", F.when(is_test, "test").otherwise("train").alias("split"),
        F.when(is_test, F.lit(-1)).otherwise(fold).cast("int").alias("fold"))


def centre(responses: DataFrame, split: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Subtract the training mean of each response; the mean stays as ``mean``."""
    keys = list(keys)
    train = split.where("split = 'train'").select(*keys, "sample")
    means = responses.join(train, [*keys, "sample"], "left_semi").groupBy(*keys, "response").agg(
        F.avg("value").alias("mean"))
    return responses.join(means, [*keys, "response"]).withColumn("value", F.col("value") - F.col("mean"))


def scale_stats(
    expression: DataFrame, features: DataFrame, split: DataFrame,
    keys: Sequence[str] = ("model_id",), scope: str = "train", ddof: int = 1,
) -> DataFrame:
    """Mean and sd per feature over the training samples (``train``) or all (``all``)."""
    keys = list(keys)
    members = split if scope == "all" else split.where("split = 'train'")
    rows = expression.join(bounded_broadcast(features.select(*keys, "gene")), "gene").join(
        members.select(*keys, "sample"), [*keys, "sample"])
    sd = F.stddev_samp("value") if ddof else F.stddev_pop("value")
    return rows.groupBy(*keys, "gene").agg(F.avg("value").alias("mean"), sd.alias("sd"))


def scaled(expression: DataFrame, stats: DataFrame, samples: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """Scaled rows ``(*keys, sample, gene, value)`` of the given samples; constant features become 0."""
    keys = list(keys)
    z = (F.col("value") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return (
        expression.join(bounded_broadcast(stats), "gene")
        .join(samples, [*keys, "sample"])
        .withColumn("value", F.coalesce(z, F.lit(0.0)))
        .drop("mean", "sd")
    )


def select_features(
    expression: DataFrame, responses: DataFrame, split: DataFrame, models: DataFrame, k: int = 100
) -> DataFrame:
    """Top ``k`` features per response on training rows, united per model, target added."""
    train = responses.join(split.where("split = 'train'").select("model_id", "sample"), ["model_id", "sample"], "left_semi")
    corr = spearman(expression, train, ["model_id", "response"], ["model_id"])
    top = top_features(corr, ["model_id", "response"], k)
    targets = models.select("model_id", F.col("target").alias("gene")).join(
        expression.select("gene").distinct(), "gene", "left_semi")
    return feature_set(top, ["model_id"], targets)


# Second moments -------------------------------------------------------------------


def _block_moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial ``v'v`` per (group, fold) of the rows one task holds."""
    held: dict[tuple, np.ndarray] = {}

    def flush() -> pd.DataFrame:
        out = [(g, f, slot, i, row) for (g, f), a in held.items() for i, row in enumerate(a)]
        held.clear()
        return pd.DataFrame(out, columns=["_group", "fold", "slot", "i", "row"])

    slot = TaskContext.get().partitionId() // _PARTIALS

    for batch in batches:
        for key, part in batch.groupby(["_group", "fold"], sort=False):
            v = np.vstack(part["v"].to_numpy())
            a = v.T @ v
            held[key] = held[key] + a if key in held else a
        if sum(a.size for a in held.values()) > _FLUSH_DOUBLES:
            yield flush()
    if held:
        yield flush()


def sum_arrays(values: Column, size: Column) -> Column:
    return F.aggregate(
        values, F.array_repeat(F.lit(0.0), size), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))


def vector_moments(vectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of ``v'v`` per (keys, fold) over rows ``(*keys, fold, v ARRAY<DOUBLE>)``.

    Returns ``(*keys, fold, d, a)`` with the d x d matrix row by row in ``a``.
    """
    keys = list(keys)
    group = F.to_json(F.struct(*keys))
    parts = vectors.select(group.alias("_group"), "fold", "v").mapInPandas(
        _block_moments, "_group string, fold int, slot int, i int, row array<double>")
    rows = parts
    steps = [["_group", "fold", "i"]]
    if int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) > _PARTIALS:
        # with very many tasks the partials are added in two steps, a bounded list each
        steps.insert(0, ["_group", "fold", "slot", "i"])
    for by in steps:
        rows = rows.groupBy(*by).agg(F.collect_list("row").alias("_rows"))
        rows = rows.select(*by, sum_arrays(F.col("_rows"), F.size(F.get("_rows", F.lit(0)))).alias("row"))
    packed = rows.groupBy("_group", "fold").agg(
        F.array_sort(F.collect_list(F.struct("i", "row"))).alias("_m"))
    schema = ", ".join(f"{k} {vectors.schema[k].dataType.simpleString()}" for k in keys)
    named = packed.withColumn("_k", F.from_json("_group", schema))
    return named.select(
        *[F.col("_k")[k].alias(k) for k in keys], "fold", F.size("_m").alias("d"),
        F.flatten(F.transform("_m", lambda m: m["row"])).alias("a"))


def pack_samples(
    rows: DataFrame, features: DataFrame, responses: DataFrame, split: DataFrame
) -> DataFrame:
    """One row per (model, sample): ``v = (scaled features, centred responses, 1)``.

    Long rows are shuffled once, by model and a block of its samples, so that a model with
    very many samples spreads over tasks and a small one stays in one.
    """
    size = features.groupBy("model_id").agg(F.count(F.lit(1)).alias("_p"))
    widest = size.agg(F.max("_p")).first()[0] or 0
    if widest > MOST_FEATURES:  # a sample is packed into one row, so its width is bounded
        raise ValueError(f"a model has {widest} features, more than {MOST_FEATURES}")
    counts = split.groupBy("model_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(_BLOCK_ROWS)).alias("_blocks"))
    placed = split.join(counts, "model_id").select(
        "model_id", "sample", "fold", F.pmod(F.xxhash64("sample"), F.col("_blocks")).alias("_block"))
    y = responses.select("model_id", "sample", F.lit(1).alias("_part"), F.col("response").alias("_name"), "value")
    x = rows.select("model_id", "sample", F.lit(0).alias("_part"), F.col("gene").alias("_name"), "value")
    both = x.unionByName(y).join(placed, ["model_id", "sample"]).repartition("model_id", "_block")
    items = both.groupBy("model_id", "_block", "sample", "fold").agg(
        F.array_sort(F.collect_list(F.struct("_part", "_name", "value"))).alias("_v"),
        F.count_if(F.col("_part") == 0).alias("_seen"))
    checked = items.join(bounded_broadcast(size), "model_id").where(
        F.when(F.col("_seen") == F.col("_p"), True).otherwise(F.raise_error(F.concat(
            F.lit("sample "), "sample", F.lit(" lacks features of model "), "model_id")).cast("boolean")))
    return checked.select("model_id", "sample", "fold", F.concat(
        F.transform("_v", lambda e: e["value"]), F.array(F.lit(1.0))).alias("v"))


def unfit_models(models: DataFrame, rows: DataFrame, features: DataFrame, split: DataFrame) -> DataFrame:
    """``model_id, status`` of the models that cannot be packed, with the reason."""
    size = features.groupBy("model_id").agg(F.count(F.lit(1)).alias("_p"))
    seen = rows.groupBy("model_id", "sample").agg(F.count(F.lit(1)).alias("_seen"))
    lacking = split.select("model_id", "sample").join(seen, ["model_id", "sample"], "left").join(size, "model_id").where(
        F.coalesce("_seen", F.lit(0)) < F.col("_p")).select("model_id").distinct()
    reasons = [
        (models.select("model_id").join(split.select("model_id").distinct(), "model_id", "left_anti"), "no complete sample"),
        (models.select("model_id").join(size, "model_id", "left_anti"), "no feature"),
        (size.where(F.col("_p") > MOST_FEATURES).select("model_id"), f"more than {MOST_FEATURES} features"),
        (lacking, "a sample lacks a feature")]
    rows = None
    for order, (found, status) in enumerate(reasons):
        part = found.select("model_id", F.struct(F.lit(order).alias("o"), F.lit(status).alias("s")).alias("r"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("model_id").agg(F.min("r").alias("r")).select("model_id", F.col("r.s").alias("status"))


def moments(packed: DataFrame, features: DataFrame, responses: DataFrame) -> DataFrame:
    """Moment table per (model, fold) with the names its rows and columns stand for."""
    genes = features.groupBy("model_id").agg(F.array_sort(F.collect_list("gene")).alias("genes"))
    names = responses.select("model_id", "response").distinct().groupBy("model_id").agg(
        F.array_sort(F.collect_list("response")).alias("responses"))
    labels = genes.join(names, "model_id")
    return vector_moments(packed, ["model_id"]).join(labels, "model_id")


def long_moments(table: DataFrame) -> DataFrame:
    """Moments as rows ``(model_id, fold, row, col, s)`` named by feature, response or ``1``."""
    names = F.concat("genes", "responses", F.array(F.lit("1")))
    cells = table.select("model_id", "fold", "d", names.alias("_names"), F.posexplode("a").alias("_at", "s"))
    return cells.select(
        "model_id", "fold", F.get("_names", F.expr("_at div d").cast("int")).alias("row"),
        F.get("_names", (F.col("_at") % F.col("d")).cast("int")).alias("col"), "s")


def quadratic_loss(long: DataFrame, beta: DataFrame, weights: DataFrame) -> DataFrame:
    """Mean squared error per (model, fold) from moments and coefficients, mixed by weight.

    ``beta``: (model_id, response, gene, beta). ``weights``: (model_id, response, weight).
    """
    key = ["model_id", "fold"]
    b = beta.select("model_id", "response", F.col("gene").alias("row"), F.col("beta").alias("_b"))
    b2 = beta.select("model_id", "response", F.col("gene").alias("col"), F.col("beta").alias("_b2"))
    names = weights.select("model_id", F.col("response").alias("col"))
    squares = long.join(b, ["model_id", "row"]).join(b2, ["model_id", "response", "col"]).groupBy(*key, "response").agg(
        F.sum(F.col("s") * F.col("_b") * F.col("_b2")).alias("_bsb"))
    cross = long.join(b, ["model_id", "row"]).where(F.col("col") == F.col("response")).groupBy(*key, "response").agg(
        F.sum(F.col("s") * F.col("_b")).alias("_bc"))
    own = long.where(F.col("row") == F.col("col")).join(names, ["model_id", "col"], "left_semi").select(
        *key, F.col("col").alias("response"), F.col("s").alias("_yy"))
    n = long.where("row = '1' AND col = '1'").select(*key, F.col("s").alias("_n"))
    mse = (F.col("_bsb") - 2 * F.col("_bc") + F.col("_yy")) / F.col("_n")
    each = squares.join(cross, [*key, "response"]).join(own, [*key, "response"]).join(n, key).join(
        weights, ["model_id", "response"])
    return each.groupBy(*key).agg(F.sum(F.col("weight") * mse).alias("loss"))


# Trials ---------------------------------------------------------------------------


def _uniform(trial: Column, name: str, seed: int) -> Column:
    """A number in [0, 1) that depends on trial, parameter and seed only."""
    digest = F.md5(F.concat_ws("|", trial.cast("string"), F.lit(name), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def trial_parameters(trial: Column, seed: int) -> Column:
    """Seeded draw from the search space: latent size, learning rate and L1 weight."""
    steps = (LATENT_HIGH - LATENT_LOW) // LATENT_STEP + 1
    latent = LATENT_LOW + LATENT_STEP * F.floor(_uniform(trial, "latent_dim", seed) * steps)

    def log_uniform(name: str, low: float, high: float) -> Column:
        return F.pow(F.lit(10.0), F.lit(np.log10(low)) + _uniform(trial, name, seed) * float(np.log10(high / low)))

    return F.struct(
        trial.cast("int").alias("trial"), latent.cast("int").alias("latent_dim"),
        log_uniform("learning_rate", RATE_LOW, RATE_HIGH).alias("learning_rate"),
        log_uniform("lambda", LAMBDA_LOW, LAMBDA_HIGH).alias("lambda"))


def random_trials(n_trials: int, seed: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_trials - 1)), lambda i: trial_parameters(i, seed))


def grid_trials(latent: Sequence[int], rates: Sequence[float], lambdas: Sequence[float]) -> Column:
    """Every combination of the given values."""
    grid = [(k, r, m) for k in latent for r in rates for m in lambdas]
    return F.array(*[
        F.struct(F.lit(i).alias("trial"), F.lit(int(k)).alias("latent_dim"),
                 F.lit(float(r)).alias("learning_rate"), F.lit(float(m)).alias("lambda"))
        for i, (k, r, m) in enumerate(grid)])


# Fits -----------------------------------------------------------------------------


def loss_of(a: np.ndarray, beta: np.ndarray, weights: np.ndarray) -> float:
    """Weighted mean squared error of coefficients on a moment matrix."""
    p, m = beta.shape
    s, c, yy = a[:p, :p], a[:p, p:p + m], np.diag(a)[p:p + m]
    per = (np.sum(beta * (s @ beta), axis=0) - 2 * np.sum(beta * c, axis=0) + yy) / a[-1, -1]
    return float(per @ weights)


def descend(a: np.ndarray, p: int, weights: np.ndarray, w: np.ndarray, rate: float, penalty: float, epochs: int):
    """Closed-form heads and one gradient step on ``W`` per epoch.

    The heads that come back belong to ``W`` before its last step. A fit that leaves the
    finite numbers returns None.
    """
    m = len(weights)
    s, c = a[:p, :p], a[:p, p:p + m]
    train = float("nan")
    h = np.zeros((w.shape[1], m))
    for _ in range(epochs):
        sw = s @ w
        try:
            h = np.linalg.pinv(w.T @ sw, hermitian=True) @ (w.T @ c)
        except np.linalg.LinAlgError:
            return None
        train = loss_of(a, w @ h, weights)
        w = w - rate * (4.0 * (sw @ h - c) @ h.T + penalty * np.sign(w))
        if not np.isfinite(train) or not np.isfinite(w).all():
            return None
    return w, h, train


def _seed_of(*parts) -> int:
    out = 0
    for x in parts:
        out = (out * 1_000_003 + int(x)) % (1 << 63)
    return out


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    out = []
    for row in pdf.itertuples(index=False):
        d = int(row.d)
        a, val = (np.asarray(x, dtype=float).reshape(d, d) for x in (row.a_train, row.a_val))
        weights = np.asarray(row.weights, dtype=float)
        p = d - len(weights) - 1
        for t in row.trials:
            rng = np.random.default_rng(_seed_of(row.seed, t["trial"], row.fold + 1))
            start = rng.standard_normal((p, int(t["latent_dim"])))
            with np.errstate(all="ignore"):
                done = descend(a, p, weights, start, t["learning_rate"], t["lambda"], int(row.epochs))
            base = (row.model_id, int(row.fold), int(t["trial"]), int(t["latent_dim"]), t["learning_rate"], t["lambda"])
            if done is None:
                out.append((*base, "diverged", None, None, None, None))
                continue
            w, h, train = done
            with np.errstate(all="ignore"):
                held = loss_of(val, w @ h, weights) if val[-1, -1] > 0 else float("nan")
            ok = bool(np.isfinite(held)) or val[-1, -1] == 0
            keep = bool(row.keep) and ok
            out.append((*base, "ok" if ok else "diverged", train, held if np.isfinite(held) else None,
                        w.tolist() if keep else None, h.T.tolist() if keep else None))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _FIT_COLUMNS])


_FIT_COLUMNS = [
    "model_id string", "fold int", "trial int", "latent_dim int", "learning_rate double", "lambda double",
    "status string", "train_loss double", "val_loss double", "w array<array<double>>", "h array<array<double>>",
]


def response_weights(responses: DataFrame, dependency: str = "dep") -> DataFrame:
    """Half for the dependency and half shared by the drugs; 1 for a single response."""
    names = responses.select("model_id", "response").distinct()
    sizes = names.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("_m"), F.count_if(F.col("response") == dependency).alias("_d"))
    weight = (
        F.when(F.col("_d") == 0, 1 / F.col("_m"))
        .when(F.col("_m") == 1, F.lit(1.0))
        .when(F.col("response") == dependency, F.lit(0.5))
        .otherwise(0.5 / (F.col("_m") - 1))
    )
    return names.join(sizes, "model_id").select("model_id", "response", weight.cast("double").alias("weight"))


def _with_weights(table: DataFrame, weights: DataFrame) -> DataFrame:
    lists = weights.groupBy("model_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("response", "weight"))), lambda e: e["weight"]).alias("weights"))
    return table.join(lists, "model_id")


def _zip(left: str, right: str, sign: int) -> Column:
    return F.zip_with(left, right, lambda a, b: a + b if sign > 0 else a - b)


def _totals(table: DataFrame) -> DataFrame:
    """Sum of the training folds per model."""
    return table.where("fold >= 0").groupBy("model_id", "d").agg(F.collect_list("a").alias("_all")).select(
        "model_id", sum_arrays(F.col("_all"), F.col("d") * F.col("d")).alias("total"))


def _run(jobs: DataFrame) -> DataFrame:
    cols = ["model_id", "fold", "chunk", "d", "a_train", "a_val", "weights", "trials", "seed", "epochs", "keep"]
    return jobs.select(*cols).groupBy("model_id", "fold", "chunk").applyInPandas(_fit_group, ", ".join(_FIT_COLUMNS))


def search(
    table: DataFrame, weights: DataFrame, models: DataFrame, trials: Column, epochs: int = 500, per_task: int = 10,
    done: DataFrame | None = None,
) -> DataFrame:
    """Fit every trial on every fold: one loss row per (model, trial, fold).

    The training table of a fold is the total minus the fold. Trials travel in chunks so a
    matrix is shipped once per chunk. Fits in ``done (model_id, trial, fold)`` are left out.
    """
    folds = table.where("fold >= 0").join(_totals(table), "model_id")
    jobs = _with_weights(folds, weights).join(models.select("model_id", "seed"), "model_id").withColumns({
        "a_train": _zip("total", "a", -1), "a_val": F.col("a"), "epochs": F.lit(epochs), "keep": F.lit(False),
        "_all": trials})
    if done is not None:  # at most one entry per trial and fold of a model
        lists = done.groupBy("model_id", "fold").agg(F.collect_set("trial").alias("_done"))
        jobs = jobs.join(lists, ["model_id", "fold"], "left").withColumn(
            "_all", F.filter("_all", lambda t: ~F.array_contains(F.coalesce("_done", F.array().cast("array<int>")), t["trial"])))
        jobs = jobs.where("size(_all) > 0").drop("_done")
    chunks = F.sequence(F.lit(0), F.ceil(F.size("_all") / F.lit(per_task)).cast("int") - 1)
    jobs = jobs.withColumn("chunk", F.explode(chunks)).withColumn(
        "trials", F.slice("_all", F.col("chunk") * per_task + 1, F.lit(per_task)))
    return _run(jobs).drop("w", "h")


def trial_losses(fits: DataFrame) -> DataFrame:
    """Mean validation loss per (model, trial); a trial with a diverged fold has no loss."""
    return fits.groupBy("model_id", "trial", "latent_dim", "learning_rate", "lambda").agg(
        F.count_if(F.col("status") == "diverged").alias("diverged"),
        F.avg("train_loss").alias("train_loss"), F.avg("val_loss").alias("val_loss"),
    ).withColumn("val_loss", F.when(F.col("diverged") == 0, F.col("val_loss")))


def best_trials(losses: DataFrame, absolute: bool = False) -> DataFrame:
    """The trial with the smallest mean loss per model."""
    ranked = losses.withColumn("_by", F.abs("val_loss") if absolute else F.col("val_loss"))
    return arg_min(ranked, ["model_id"], "_by", "trial").drop("_by")


def fit_final(table: DataFrame, weights: DataFrame, models: DataFrame, best: DataFrame, epochs: int = 1000) -> DataFrame:
    """Fit on all training folds with each model's best trial; the loss is on the hold-out."""
    held = table.where("fold < 0").select("model_id", F.col("a").alias("_held"))
    base = table.where("fold >= 0").select("model_id", "d").distinct()
    jobs = base.join(_totals(table), "model_id").join(held, "model_id", "left")
    empty = F.array_repeat(F.lit(0.0), F.col("d") * F.col("d"))
    one = F.array(F.struct("trial", "latent_dim", "learning_rate", "lambda"))
    jobs = _with_weights(jobs, weights).join(models.select("model_id", "seed"), "model_id").join(
        best.select("model_id", one.alias("trials")), "model_id")
    jobs = jobs.withColumns({
        "fold": F.lit(-1), "chunk": F.lit(0), "a_train": F.col("total"), "a_val": F.coalesce("_held", empty),
        "epochs": F.lit(epochs), "keep": F.lit(True)})
    return _run(jobs)


def model_tables(fits: DataFrame, table: DataFrame, stats: DataFrame, centred: DataFrame, models: DataFrame, split: DataFrame) -> dict[str, DataFrame]:
    """The registry tables of final fits."""
    labels = table.select("model_id", "genes", "responses").distinct()
    ok = fits.where("status = 'ok'").join(labels, "model_id")
    weights = ok.select("model_id", F.explode(F.arrays_zip("genes", "w")).alias("e")).select(
        "model_id", F.col("e.genes").alias("gene"), F.col("e.w").alias("w"))
    heads = ok.select("model_id", F.explode(F.arrays_zip("responses", "h")).alias("e")).select(
        "model_id", F.col("e.responses").alias("response"), F.col("e.h").alias("h"))
    means = centred.select("model_id", "response", "mean").distinct()
    params = F.struct("trial", "latent_dim", "learning_rate", "lambda", "train_loss", "val_loss", "status")
    return {
        "model": models.join(fits.select("model_id", params.alias("params")), "model_id"),
        "model_weight": weights.join(stats, ["model_id", "gene"]),
        "model_head": heads.join(means, ["model_id", "response"]),
        "model_split": split,
    }
