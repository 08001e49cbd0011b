"""Model registry: the learnt tables as parquet, one folder per table and save, with commits.

A save writes its rows below new folders ``<table>/batch=<name>``, ``model`` last, and then one small
file ``commits/<number>.json`` that names the batch. Readers know only committed batches and take every
model from the last one that holds it, so a save that fails half-way changes nothing that
anybody sees: the old state stays readable and the new models stay to be fitted. The losses of a search
are stored the same way, so a search that was killed goes on with the trials that are left. The
number of folders follows the saves, not the models.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("model_weight", "model_head", "model_split", "model")
LOSSES = "trial_loss"
_LOSS_KEY = ["model_id", "trial", "fold"]


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _write(tables: dict[str, DataFrame], path: str) -> None:
    """Write all tables, then the commit that makes them visible."""
    root, batch = path.rstrip("/"), f"b{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{name}/batch={batch}")
    spark = next(iter(tables.values())).sparkSession
    number = max((c["number"] for c in commits(spark, root)), default=0)
    while True:
        number += 1
        marker, fs = _hadoop(spark, f"{root}/commits/{number:012d}.json")
        if fs.exists(marker):
            continue
        try:
            out = fs.create(marker, False)
        except Exception as err:  # another save took this number
            if "AlreadyExists" not in str(err):
                raise
            continue
        out.write(bytearray(json.dumps({"number": number, "batch": batch, "tables": list(tables)}).encode()))
        out.close()
        return


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The commits by number, one per save; a marker that was not written to its end is none."""
    folder, fs = _hadoop(spark, f"{path.rstrip('/')}/commits")
    if not fs.exists(folder):
        return []
    found = spark.read.schema("number long, batch string, tables array<string>").json(folder.toString())
    return sorted((r.asDict() for r in found.where("number IS NOT NULL AND tables IS NOT NULL").collect()), key=lambda c: c["number"])


def _read(spark: SparkSession, path: str, name: str, known: list[dict]) -> DataFrame | None:
    """Rows of a table from all committed batches, with ``batch`` and its ``number``."""
    mine = [c for c in known if name in c["tables"]]
    if not mine:
        return None
    root = f"{path.rstrip('/')}/{name}"
    rows = spark.read.option("basePath", root).option("mergeSchema", True).parquet(*[f"{root}/batch={c['batch']}" for c in mine])
    # one row per save, as many as the paths above
    return rows.join(F.broadcast(spark.createDataFrame([(c["batch"], c["number"]) for c in mine], "batch string, number long")), "batch")


def save_models(tables: dict[str, DataFrame], path: str) -> None:
    """Store the learnt tables of some models in one commit. Raw matrices are never stored.

    A model that is stored again replaces its former state and no other model, so a retried batch
    leaves every model once.
    """
    _write({name: tables[name] for name in TABLES if name in tables}, path)


def load_models(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Reload the tables of the last commit of each model; data is attached by joining on ``sample`` and ``gene``."""
    known = [c for c in commits(spark, path) if "model" in c["tables"]]
    if not known:
        raise FileNotFoundError(f"no model table below {path}")
    found = {name: _read(spark, path, name, known) for name in TABLES}
    last = found["model"].groupBy("model_id").agg(F.max("number").alias("number"))
    return {name: rows.join(last, ["model_id", "number"], "left_semi").drop("batch", "number") for name, rows in found.items() if rows is not None}


def saved_models(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The ``model`` table, or an empty one of that schema before the first commit."""
    try:
        return load_models(spark, path)["model"]
    except FileNotFoundError:
        return spark.createDataFrame([], schema)


def still_to_fit(grid: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs whose model is not in the registry yet."""
    return grid.join(models.select(*keys).distinct(), keys, "left_anti")


def save_losses(fits: DataFrame, path: str) -> None:
    """Store loss rows of a search, ``(model_id, fold, trial, ...)``, in one commit."""
    _write({LOSSES: fits}, path)


def load_losses(spark: SparkSession, path: str) -> DataFrame | None:
    """All stored loss rows, the last one of each model, trial and fold; None before the first commit."""
    rows = _read(spark, path, LOSSES, commits(spark, path))
    if rows is None:
        return None
    names = [c for c in rows.columns if c not in ("batch", "number", *_LOSS_KEY)]
    last = rows.groupBy(*_LOSS_KEY).agg(F.max_by(F.struct(*names), "number").alias("last"))
    return last.select(*_LOSS_KEY, "last.*")


def resume_search(spark: SparkSession, path: str, trials: Column, run, every: int = 10) -> DataFrame:
    """All loss rows of a search that commits after every ``every`` trials.

    ``run(trials, done)`` returns the loss rows of the given trials that are not in ``done
    (model_id, trial, fold)`` (None: nothing is). What an earlier, killed run has committed is not
    fitted again.
    """
    number = spark.range(1).select(F.size(trials)).first()[0]
    for first in range(0, number, every):
        stored = load_losses(spark, path)
        part = F.slice(trials, first + 1, every)
        save_losses(run(part, None if stored is None else stored.select(*_LOSS_KEY)), path)
    return load_losses(spark, path)
