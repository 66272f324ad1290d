"""Fitted preprocessing stages for a Spark ML pipeline.

A stage keeps small state as JSON in a parameter. Key counts have no size bound, so the feature
stage keeps them as a table and saves them as Parquet beside its parameters.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsafe.config import FeatureColumns, FeaturesConfig
from foldsafe.functions.numeric import known
from foldsafe.functions.text import null_as_text
from foldsafe.operators import features
from foldsafe.operators.joins import lookup


class _JsonState(Params):
    state = Param(Params._dummy(), "state", "fitted values as JSON", TypeConverters.toString)

    def remember(self, **values: Any) -> "_JsonState":
        self._set(state=json.dumps(values))
        return self

    def recall(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault(self.state))


class NumericModel(Transformer, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    """Fill blanks and standardise: ``(x or fill) - mean) / sd`` into one output column each.

    Without a fill value blanks stay blank.
    """

    def _transform(self, df: DataFrame) -> DataFrame:
        made = {}
        for name, output, fill, mean, deviation in self.recall()["columns"]:
            value = known(F.col(name)) if fill is None else F.coalesce(known(F.col(name)), F.lit(fill))
            made[output] = (value - mean) / deviation
        return df.withColumns(made) if made else df


class TextFillModel(Transformer, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    """Fill blanks of text columns into one output column each."""

    def _transform(self, df: DataFrame) -> DataFrame:
        made = {
            output: F.coalesce(F.col(name).cast("string"), F.lit(fill))
            for name, output, fill in self.recall()["columns"]
        }
        return df.withColumns(made) if made else df


def _config_as_dict(cfg: FeaturesConfig) -> dict[str, Any]:
    return {"flags": cfg.flags(), "columns": vars(cfg.columns), "drop": list(cfg.drop_cols)}


def _config_from_dict(saved: dict[str, Any]) -> FeaturesConfig:
    return FeaturesConfig.from_flags(
        saved["flags"], columns=FeatureColumns(**saved["columns"]), drop_cols=tuple(saved["drop"])
    )


class FeatureModel(Transformer, _JsonState, MLReadable, MLWritable):
    """Add engineered features; ticket and title counts come from the training rows."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: dict[str, DataFrame] = {}

    @classmethod
    def make(
        cls, cfg: FeaturesConfig, tables: dict[str, DataFrame], sizes: dict[str, int]
    ) -> "FeatureModel":
        """``sizes`` are the tables' row counts: they decide how a table is looked up."""
        model = cls()
        model.tables = tables
        model.remember(config=_config_as_dict(cfg), sizes=sizes)
        return model

    def copy(self, extra: dict | None = None) -> "FeatureModel":
        twin = super().copy(extra)
        twin.tables = self.tables
        return twin

    def _look_up(self, df: DataFrame, table: str, key: str) -> DataFrame:
        # Keys that are frequent in training are taken to be the frequent ones here as well.
        counts = self.tables[table].select("key", F.col("n").alias("_n"))
        size = self.recall()["sizes"].get(table)
        return lookup(df, null_as_text(F.col(key)), counts, "key", ["_n"], "_n", size)

    def _transform(self, df: DataFrame) -> DataFrame:
        cfg = _config_from_dict(self.recall()["config"])
        out = features.stateless(df, cfg)
        wanted = sum(features.available(df.columns, cfg), [])
        if features.TICKET_GROUP in wanted:
            out = self._look_up(out, "tickets", cfg.columns.ticket)
            size = F.coalesce("_n", F.lit(1)).cast("int")
            out = out.withColumn(features.TICKET_GROUP, size).drop("_n")
        if features.TITLE in wanted:
            out = self._look_up(out, "titles", features.TITLE)
            title = features.rare_title(F.col(features.TITLE), F.col("_n"), cfg.rare_title_threshold)
            out = out.withColumn(features.TITLE, title).drop("_n")
        return out

    def write(self) -> MLWriter:
        return _FeatureWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FeatureReader()


class LevelModel(Transformer, _JsonState, MLReadable, MLWritable):
    """Number a text column by a table of its levels in text order; unseen levels come after the last."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: dict[str, DataFrame] = {}

    @classmethod
    def make(cls, column: str, output: str, levels: DataFrame, size: int) -> "LevelModel":
        """``levels`` has one row ``(level, place, n)`` per level, ``n`` its rows in training."""
        model = cls()
        model.tables = {"levels": levels}
        model.remember(column=column, output=output, size=size)
        return model

    def copy(self, extra: dict | None = None) -> "LevelModel":
        twin = super().copy(extra)
        twin.tables = self.tables
        return twin

    def _transform(self, df: DataFrame) -> DataFrame:
        state = self.recall()
        levels = self.tables["levels"].select("level", F.col("place").alias("_place"), F.col("n").alias("_n"))
        found = lookup(df, F.col(state["column"]), levels, "level", ["_place"], "_n", state["size"])
        place = F.coalesce("_place", F.lit(state["size"])).cast("double")
        # What an encoder reads: how many values the column can take.
        kind = {"ml_attr": {"type": "nominal", "name": state["output"], "num_vals": state["size"] + 1}}
        return found.select(*df.columns, place.alias(state["output"], metadata=kind))

    def labels(self) -> list[str]:
        return [r["level"] for r in self.tables["levels"].orderBy("place").select("level").collect()]

    def write(self) -> MLWriter:
        return _FeatureWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LevelReader()


class _FeatureWriter(MLWriter):
    def __init__(self, model: FeatureModel | LevelModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        extra = {"tables": sorted(self.model.tables)}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extra)
        for name, table in self.model.tables.items():
            table.write.parquet(f"{path}/{name}")


class _FeatureReader(MLReader):
    kind: type = FeatureModel

    def load(self, path: str) -> FeatureModel | LevelModel:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.kind()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.tables = {name: spark.read.parquet(f"{path}/{name}") for name in metadata["tables"]}
        return model


class _LevelReader(_FeatureReader):
    kind = LevelModel
