"""Training of many models in one plan: split, features, scale, search, fit, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from essenta.operators import factor_model as M
from essenta.operators import scores as S
from essenta.session import cut
from essenta.sources.registry import resume_search


def complete_cases(responses: DataFrame) -> DataFrame:
    """Rows of the samples that have a value for every response of their model.

    A null or NaN value is a missing one. Models keep their own samples: a gap in one model
    takes nothing from another.
    """
    rows = responses.where(F.col("value").isNotNull() & ~F.isnan("value"))
    wanted = responses.groupBy("model_id").agg(F.countDistinct("response").alias("_wanted"))
    whole = rows.groupBy("model_id", "sample").agg(F.countDistinct("response").alias("_found")).join(wanted, "model_id").where(
        "_found = _wanted").select("model_id", "sample")
    return rows.join(whole, ["model_id", "sample"], "left_semi")


def prepare(
    expression: DataFrame, responses: DataFrame, models: DataFrame, k: int = 100, n_splits: int = 5,
    test_size: float = 0.2, scope: str = "train", ddof: int = 1,
    split: DataFrame | None = None, features: DataFrame | None = None, strict: bool = True,
) -> dict[str, DataFrame]:
    """Everything up to the moment tables, for all models together.

    ``models``: (model_id, target, seed, ...). ``responses``: (model_id, response, sample,
    value); samples without expression or with a gap in one of a model's responses are left
    out of that model. A given ``split`` and ``features`` are reused as they are. A model that
    cannot be fitted is an error, or with ``strict=False`` a row of ``status`` that says why,
    while the others go on.
    """
    known = expression.select("sample").distinct()
    responses = cut(complete_cases(responses.join(known, "sample", "left_semi")))
    if split is None:
        cohort = responses.select("model_id", "sample").distinct().join(models.select("model_id", "seed"), "model_id")
        split = cut(M.split_samples(cohort, n_splits=n_splits, test_size=test_size))
    if features is None:
        features = cut(M.select_features(expression, responses, split, models, k))
    stats = cut(M.scale_stats(expression, features, split, scope=scope, ddof=ddof))
    centred = M.centre(responses, split)
    rows = M.scaled(expression, stats, split.select("model_id", "sample"))
    status = models.select("model_id", F.lit("ok").alias("status"))
    if not strict:
        unfit = cut(M.unfit_models(models, rows, features, split))
        status = models.select("model_id").join(unfit, "model_id", "left").select("model_id", F.coalesce("status", F.lit("ok")).alias("status"))
        models, rows, features, centred, split, stats = (
            d.join(unfit, "model_id", "left_anti") for d in (models, rows, features, centred, split, stats))
    packed = M.pack_samples(rows, features, centred, split)
    table = cut(M.moments(packed, features, centred))
    return {"split": split, "features": features, "stats": stats, "centred": centred, "moments": table, "models": models,
            "status": status}


def train(
    expression: DataFrame, responses: DataFrame, models: DataFrame, trials: Column | None = None,
    n_trials: int = 100, tuning_epochs: int = 500, training_epochs: int = 1000, trial_seed: int = 20357,
    absolute: bool = False, losses: str | None = None, **options,
) -> dict[str, DataFrame]:
    """Search, final fit and hold-out metrics for every model of the grid.

    Returns the registry tables plus ``trials`` (loss rows), ``metrics`` and ``status``: a
    model that cannot be fitted has its reason there and ends no other one. ``losses`` is a registry
    path for the losses of the search: a batch that was killed goes on with the trials that are left.
    """
    ready = prepare(expression, responses, models, **{"strict": False, **options})
    models = ready["models"]
    weights = M.response_weights(ready["centred"])
    plan = trials if trials is not None else M.random_trials(n_trials, trial_seed)
    if losses is None:
        fits = cut(M.search(ready["moments"], weights, models, plan, tuning_epochs))
    else:
        stored = resume_search(expression.sparkSession, losses, plan, lambda part, done: M.search(
            ready["moments"], weights, models, part, tuning_epochs, done=done))
        fits = cut(stored.join(models.select("model_id"), "model_id", "left_semi"))
    best = M.best_trials(M.trial_losses(fits), absolute)
    final = cut(M.fit_final(ready["moments"], weights, models, best, training_epochs))
    out = M.model_tables(final, ready["moments"], ready["stats"], ready["centred"], models, ready["split"])
    predicted = S.predict(
        M.scaled(expression, ready["stats"], ready["split"].select("model_id", "sample")), out)
    truth = ready["centred"].join(ready["split"], ["model_id", "sample"])
    # one row per sample and response; two rankings and the error sums read it
    both = cut(predicted.join(
        truth.select("model_id", "response", "sample", "value", "split"), ["model_id", "response", "sample"]))
    out["metrics"] = S.model_metrics(both)
    out["trials"], out["status"] = fits, ready["status"]
    return out
