"""Batch scoring with fold models: one narrow pass over the table, whatever the number of models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsafe.errors import InferenceError
from foldsafe.functions.numeric import over_threshold, sigmoid
from foldsafe.operators import preprocess



def positive_score(scored: DataFrame) -> Column | None:
    """Score of class 1: probability, else sigmoid of the decision value, else nothing."""
    if "probability" in scored.columns:
        return F.get(vector_to_array("probability"), F.lit(1))
    if "rawPrediction" in scored.columns:
        return sigmoid(F.get(vector_to_array("rawPrediction"), F.lit(1)))
    return None


def _apply(model: Transformer, df: DataFrame, output: str, task: str) -> tuple[DataFrame, bool]:
    """Add one score column and drop everything else the model added."""
    scored = model.transform(df)
    score = positive_score(scored) if task == "binary" else None
    column = score if score is not None else F.col("prediction")
    return scored.select(*df.columns, column.alias(output)), score is not None


def _direct(model: Transformer, df: DataFrame, vector: str, task: str) -> tuple[DataFrame, Column] | None:
    """The table with the feature vector of a model of this library as an array, and the model's score of it."""
    stages = getattr(model, "stages", [])
    if not stages or not hasattr(stages[-1], "score_of") or stages[-1].recall()["task"] != task:
        return None
    found = preprocess.direct(stages[:-1], df)
    if found is None:
        return None
    ready, features = found
    return ready.select(*df.columns, features.alias(vector)), stages[-1].score_of(F.col(vector))


def fold_average(
    models: Sequence[Transformer], df: DataFrame, task: str = "binary", name: str = "p"
) -> DataFrame:
    """Add ``p``, the mean score over the fold models, under that or another name.

    For binary tasks models without any score vote with their labels, but only if no model has one.
    """
    if not models:
        raise InferenceError("there are no fold models")
    out, names, rated = df, [], []
    later: dict[str, Column] = {}
    for i, model in enumerate(models):
        names.append(f"_p{i}")
        found = _direct(model, out, f"_x{i}", task)
        if found is None:
            out, has_score = _apply(model, out, names[-1], task)
        else:
            out, later[names[-1]] = found
            has_score = task == "binary"
        rated.append(has_score)
    # All these scores in one step, so those that Python computes share a worker.
    out = out.withColumns(later) if later else out
    if task == "binary" and any(rated):
        used = [n for n, ok in zip(names, rated) if ok]
    else:
        used = names
    mean = sum((F.col(n) for n in used[1:]), F.col(used[0])) / len(used)
    if task == "binary" and not any(rated):
        mean = over_threshold(mean, 0.5).cast("double")
    return out.select(*df.columns, mean.alias(name))


def run_average(runs: Mapping[str, Sequence[Transformer]], df: DataFrame, task: str = "binary") -> DataFrame:
    """Add ``p``, the mean over runs of their fold averages: all models of all runs in one narrow pass.

    Rows are scored where they are and never matched by id, so rows that share an id each keep their own score.
    Runs without a score for a row are left out of its mean. An input column ``p`` is replaced.
    """
    if not runs:
        raise InferenceError("no runs to combine")
    out, scores = df, []
    for i, models in enumerate(runs.values()):
        scores.append(f"_run{i}")
        out = fold_average(models, out, task, scores[-1])
    known = F.filter(F.array(*scores), lambda p: p.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, b: a + b)
    own = [F.col(f"`{c}`") for c in df.columns if c.lower() != "p"]
    return out.select(*own, F.try_divide(total, F.size(known)).alias("p"))


def predict(
    models: Sequence[Transformer],
    df: DataFrame,
    id_col: str,
    target: str,
    threshold: float = 0.5,
) -> DataFrame:
    """``(id, label)`` from averaged fold scores."""
    scored = fold_average(models, df)
    return scored.select(id_col, over_threshold(F.col("p"), threshold).alias(target))


def predict_best(
    model: Transformer, df: DataFrame, id_col: str, target: str, task: str = "binary"
) -> DataFrame:
    """``(id, label)`` from a single model's own decision; probabilities are cut above one half.

    A regression keeps its predicted value.
    """
    scored = model.transform(df)
    if "prediction" in scored.columns:
        label = F.col("prediction")
    else:
        score = positive_score(scored)
        if score is None:
            raise InferenceError("the model gives neither a prediction nor a score")
        label = over_threshold(score, 0.5, strict=True)
    kind = "int" if task == "binary" else "double"
    return scored.select(id_col, label.cast(kind).alias(target))
