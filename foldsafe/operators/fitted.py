"""Fitted models of this library as Spark ML stages: they read the feature vector and save as parameters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsafe.errors import TrainingError
from foldsafe.functions.numeric import sigmoid
from foldsafe.operators import boosting, forest
from foldsafe.operators.stages import _FeatureReader, _FeatureWriter, _JsonState

FEATURES, LABEL = "features", "label"
# Linear scores of at most this many terms are written out.
_MOST_TERMS = 128


class _Scored(Transformer, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `prediction`, and for a binary task `rawPrediction` and `probability`."""

    def _margin(self, features: Column) -> Column:
        raise NotImplementedError

    def score_of(self, features: Column) -> Column:
        """The probability of class 1, or the predicted value, of a vector that is an array."""
        margin = self._margin(features)
        return sigmoid(margin) if self.recall()["task"] == "binary" else margin

    def _transform(self, df: DataFrame) -> DataFrame:
        read = df.withColumn("_values", vector_to_array(F.col(FEATURES)))
        margin = self._margin(F.col("_values"))
        if self.recall()["task"] != "binary":
            return read.withColumn("prediction", margin).drop("_values")
        scored = read.withColumn("_margin", margin).drop("_values").withColumn("_one", sigmoid(F.col("_margin")))
        return scored.withColumns({
            "rawPrediction": array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))),
            "probability": array_to_vector(F.array(1 - F.col("_one"), F.col("_one"))),
            "prediction": (F.col("_one") > 0.5).cast("double"),
        }).drop("_margin", "_one")


class LinearModel(_Scored):
    """A linear score, by column functions alone."""

    @classmethod
    def make(cls, coefficients: list[float], intercept: float, task: str) -> LinearModel:
        return cls().remember(coefficients=list(coefficients), intercept=intercept, task=task)

    @property
    def coefficients(self) -> np.ndarray:
        return np.array(self.recall()["coefficients"])

    @property
    def intercept(self) -> float:
        return self.recall()["intercept"]

    def _margin(self, features: Column) -> Column:
        state = self.recall()
        if len(state["coefficients"]) <= _MOST_TERMS:
            # Compiled with the rest of the query; functions over arrays would be interpreted, with all they read.
            total = F.lit(float(state["intercept"]))
            for i, weight in enumerate(state["coefficients"]):
                total = total + F.get(features, F.lit(i)) * F.lit(float(weight))
            return total
        weights = F.lit(np.array(state["coefficients"], np.float64))
        parts = F.zip_with(features, weights, lambda x, w: x * w)
        return F.aggregate(parts, F.lit(float(state["intercept"])), lambda a, b: a + b)


class BoostedModel(_Scored):
    """The sum of an ensemble's trees, in Arrow batches; a blank feature (NaN) goes where the tree learnt to send it."""

    @classmethod
    def make(cls, ensemble: boosting.Ensemble) -> BoostedModel:
        return cls().remember(**ensemble.state())

    def _margin(self, features: Column) -> Column:
        state = self.recall()

        @F.arrow_udf("double")
        def margin(column: pa.Array) -> pa.Array:
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            return pa.array(boosting.margins(state, x.reshape(len(column), state["width"])))

        return margin(features)


class ForestModel(Transformer, _JsonState, MLReadable, MLWritable):
    """The mean of a forest's trees, in Arrow batches: for a binary task the share of class 1. Trees are a table, saved beside the parameters."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: dict[str, DataFrame] = {}
        self._sent: Broadcast | None = None

    @classmethod
    def make(cls, found: forest.Found) -> ForestModel:
        model = cls()
        model.tables = {"trees": found.pieces}
        edges = [ends.tolist() for ends in found.edges]
        model.remember(edges=edges, base=found.base, trees=found.trees, task=found.task)
        return model

    def copy(self, extra: dict | None = None) -> ForestModel:
        twin = super().copy(extra)
        twin.tables, twin._sent = self.tables, self._sent
        return twin

    def score_of(self, features: Column) -> Column:
        """The probability of class 1, or the predicted value, of a vector that is an array."""
        if self._sent is None:
            state, trees = self.recall(), self.tables["trees"]
            rows = trees.select("tree", "root", "body").toArrow().to_pylist()
            packed = forest.Forest(state["edges"], state["base"], state["trees"], [(r["tree"], r["root"], r["body"]) for r in rows])
            self._sent = trees.sparkSession.sparkContext.broadcast(packed)
        sent = self._sent

        @F.arrow_udf("double")
        def score(column: pa.Array) -> pa.Array:
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            return pa.array(sent.value.scores(x.reshape(len(column), len(sent.value.edges))))

        return score(features)

    def _transform(self, df: DataFrame) -> DataFrame:
        state = self.recall()
        scored = df.withColumn("_values", vector_to_array(F.col(FEATURES)))
        if state["task"] != "binary":
            return scored.withColumn("prediction", self.score_of(F.col("_values"))).drop("_values")
        one = F.col("_one")
        return scored.withColumn("_one", self.score_of(F.col("_values"))).withColumns({
            "rawPrediction": array_to_vector(F.array((1 - one) * state["trees"], one * state["trees"])),
            "probability": array_to_vector(F.array(1 - one, one)),
            "prediction": (one > 0.5).cast("double"),
        }).drop("_values", "_one")

    def write(self) -> MLWriter:
        return _FeatureWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestReader(_FeatureReader):
    kind = ForestModel


class _Boosted(Estimator):
    """Trains one model on all rows of a table with `features` and `label`."""

    task = "binary"

    def __init__(self, settings: boosting.Settings) -> None:
        super().__init__()
        self.settings = settings

    def _fit(self, df: DataFrame) -> BoostedModel:
        features = vector_to_array(F.col(FEATURES))
        rows = df.select(
            F.lit(0).alias("lane"), F.xxhash64(features, LABEL).alias("key"),
            F.col(LABEL).cast("double").alias("label"), features.alias("features"),
        )
        found = boosting.fit(rows, self.settings, self.task)
        if not found:
            raise TrainingError("there are no rows to learn from")
        return BoostedModel.make(found[0])


class BoostedClassifier(_Boosted):
    task = "binary"


class BoostedRegressor(_Boosted):
    task = "regression"
