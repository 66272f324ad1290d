"""Learn preprocessing for all folds together and hand out one fitted pipeline per fold.

Fitting a pipeline per fold would scan the table several times per fold. Here the table is scanned
once for moments, once for medians, once for text levels and once per learnt feature, and each
fold's pipeline is put together from sums over its training folds.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, OneHotEncoderModel, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.config import FeaturesConfig
from foldsafe.errors import SchemaError
from foldsafe.functions import text
from foldsafe.functions.numeric import known
from foldsafe.operators import features, loo, ranks
from foldsafe.operators.models import FEATURES, LABEL
from foldsafe.operators.splits import FOLD
from foldsafe.operators.stages import FeatureModel, LevelModel, NumericModel, TextFillModel
from foldsafe.operators.threads import in_threads
from foldsafe.sources.scratch import written

# Columns with at most this many levels keep them as a list in the model, others as a table.
_MANY_LEVELS = 10_000
# Feature vectors of at most this many slots are also written as one array expression.
_MOST_SLOTS = 128

log = logging.getLogger(__name__)


def feature_columns(
    schema: T.StructType, cfg: FeaturesConfig, exclude: Iterable[str]
) -> tuple[list[str], list[str]]:
    """Sorted numeric and sorted text columns that enter the feature vector."""
    left_out = {*exclude, *cfg.drop_cols, FOLD}
    kept = [f for f in schema.fields if f.name not in left_out]
    numbers = [f.name for f in kept if isinstance(f.dataType, T.NumericType)]
    texts = [f.name for f in kept if not isinstance(f.dataType, T.NumericType)]
    more_numbers, more_texts = features.available(schema.names, cfg)
    numbers = sorted({*numbers, *more_numbers})
    texts = sorted({*texts, *more_texts} - set(numbers))
    return numbers, texts if cfg.encode_categorical else []


def _ticket_stats(tables: list[DataFrame]) -> dict[int, tuple[float, float, float]]:
    """Fill, mean and deviation of the ticket count over training rows, from the counts alone:
    a ticket counted c times gives c rows of value c."""
    tagged = [t.select(F.lit(h).alias("holdout"), F.col("n").cast("double")) for h, t in enumerate(tables)]
    counts = reduce(DataFrame.unionByName, tagged)
    rows = F.sum("n")
    firsts = counts.groupBy("holdout").agg((F.sum(F.col("n") * F.col("n")) / rows).alias("mean"))
    means = {r["holdout"]: r["mean"] for r in firsts.collect()}
    if not means:
        return {}
    own = F.create_map(*[F.lit(x) for pair in means.items() for x in pair])[F.col("holdout")]
    mean = F.first("mean")
    spread = F.sum(F.col("n") * F.pow(F.col("n") - F.col("mean"), F.lit(2.0))) / rows
    found = (
        counts.withColumn("mean", own)
        .groupBy("holdout")
        .agg(loo.safe_deviation(spread, mean, rows).alias("sd"))
    )
    return {r["holdout"]: (1.0, means[r["holdout"]], r["sd"]) for r in found.collect()}


def _holdout_counts(
    folded: DataFrame, key: str, n_splits: int, scheme: str, name: str
) -> tuple[list[DataFrame], int]:
    """``(key, n)`` of the training rows for every holdout, from one written count table, and the
    number of its keys."""
    by_fold = written(features.fold_counts(folded, F.col(key), n_splits), name)
    per_holdout = [
        by_fold.select(
            "key",
            features.training_count(F.col("by_fold"), F.lit(h), n_splits, scheme).alias("n"),
        ).filter("n > 0")
        for h in range(n_splits)
    ]
    return per_holdout, by_fold.count()


def _title_levels(tables: list[DataFrame], threshold: int) -> DataFrame:
    """Levels of the title after rare ones are merged, per holdout."""
    merged = features.rare_title(F.col("key"), F.col("n"), threshold)
    parts = [
        counts.select(F.lit(holdout).alias("holdout"), merged.alias("level"), "n")
        for holdout, counts in enumerate(tables)
    ]
    levels = reduce(DataFrame.unionByName, parts).groupBy("holdout", "level").agg(F.sum("n").alias("n"))
    return levels.select("holdout", F.lit(features.TITLE).alias("column"), "level", "n")


@dataclass(frozen=True)
class LevelTable:
    """Levels of one column for one holdout as rows ``(level, place, n)``."""

    rows: DataFrame
    size: int


def _collect_levels(counts: DataFrame) -> tuple[dict, dict]:
    """Sorted levels and most frequent level per (holdout, column).

    Columns with few levels give lists; those with many keep them as a table, numbered without
    gathering them. The numbers, and so the features, are the same.
    """
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("level")))
    sizes = counts.groupBy("holdout", "column").agg(
        F.count(F.lit(1)).alias("levels"), best["level"].alias("fill")
    ).collect()
    fills = {(r["holdout"], r["column"]): r["fill"] for r in sizes}
    many = sorted({r["column"] for r in sizes if r["levels"] > _MANY_LEVELS})
    levels: dict[tuple[int, str], list[str] | LevelTable] = {}
    if many:
        log.warning("more than %d levels in %s: free text?", _MANY_LEVELS, ", ".join(many))
        placed = written(ranks.places(counts.filter(F.col("column").isin(many)), ["holdout", "column"], "level"), "level-places")
        for r in sizes:
            if r["column"] in many:
                own = (F.col("holdout") == r["holdout"]) & (F.col("column") == r["column"])
                levels[r["holdout"], r["column"]] = LevelTable(placed.filter(own).select("level", "place", "n"), r["levels"])
    # At most _MANY_LEVELS levels each.
    few = counts.filter(~F.col("column").isin(many)) if many else counts
    listed = few.groupBy("holdout", "column").agg(F.sort_array(F.collect_list("level")).alias("levels"))
    for row in listed.collect():
        levels[row["holdout"], row["column"]] = row["levels"]
    return levels, fills


def _index(column: str, levels: list[str] | LevelTable) -> Transformer:
    if isinstance(levels, LevelTable):
        return LevelModel.make(f"txt__{column}", f"idx__{column}", levels.rows, levels.size)
    return StringIndexerModel.from_labels(levels, f"txt__{column}", f"idx__{column}", "keep")


def _encoders(schema_only: DataFrame, texts: list[str], levels: dict, holdout: int) -> list:
    """Index levels in text order and turn them into indicator vectors.

    An unseen level gets the slot after the last one, which the encoder drops: all zeros.
    """
    kept = [c for c in texts if levels.get((holdout, c))]
    if not kept:
        return []
    # One indexer per column: the many-column form takes label lists of one length only.
    indexers = [_index(c, levels[holdout, c]) for c in kept]
    encoder = OneHotEncoder(
        inputCols=[f"idx__{c}" for c in kept], outputCols=[f"hot__{c}" for c in kept], dropLast=True
    )
    filled = schema_only.select([F.lit("").alias(f"txt__{c}") for c in kept])
    # The encoder learns its sizes from column metadata, without a job.
    fitted = encoder.fit(PipelineModel(indexers).transform(filled))
    return [*indexers, fitted]


def learn(
    folded: DataFrame,
    cfg: FeaturesConfig,
    n_splits: int,
    scheme: str = "stratified",
    exclude: Iterable[str] = (),
) -> list[PipelineModel]:
    """One fitted preprocessing pipeline per holdout; output column ``features``.

    The vector holds sorted numeric columns, then for each sorted text column its sorted levels.
    ``folded`` is read several times, so persist it first.
    """
    numbers, texts = feature_columns(folded.schema, cfg, exclude)
    if not numbers and not texts:
        raise SchemaError("no feature columns are left")
    wanted = sum(features.available(folded.columns, cfg), [])
    base = features.stateless(folded, cfg)
    tables: list[dict[str, DataFrame]] = [{} for _ in range(n_splits)]
    sizes: dict[str, int] = {}

    stats: dict[tuple[int, str], tuple[float, float, float]] = {}
    plain = [c for c in numbers if not (c == features.TICKET_GROUP and c in wanted)]
    if plain:
        rows = loo.numeric_stats(base, plain, n_splits, cfg.impute_numeric, scheme).collect()
        stats = {(r["holdout"], r["column"]): (r["fill"], r["mean"], r["sd"]) for r in rows}
    if features.TICKET_GROUP in wanted:
        tickets, sizes["tickets"] = _holdout_counts(base, cfg.columns.ticket, n_splits, scheme, "tickets")
        for holdout, found in _ticket_stats(tickets).items():
            stats[holdout, features.TICKET_GROUP] = found
            tables[holdout]["tickets"] = tickets[holdout]

    counted = [c for c in texts if not (c == features.TITLE and c in wanted)]
    if cfg.impute_categorical == "constant":
        filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(loo.CONSTANT_TEXT)) for c in counted}
        base = base.withColumns(filled) if filled else base
    levels, fills = {}, {}
    if counted:
        counts = loo.level_counts(base, counted, n_splits, scheme)
        levels, fills = _collect_levels(written(counts, "levels"))
    if features.TITLE in wanted:
        titles, sizes["titles"] = _holdout_counts(base, features.TITLE, n_splits, scheme, "titles")
        for holdout in range(n_splits):
            tables[holdout]["titles"] = titles[holdout]
        if features.TITLE in texts:
            more, more_fills = _collect_levels(_title_levels(titles, cfg.rare_title_threshold))
            levels.update(more)
            fills.update(more_fills)

    constant = cfg.impute_categorical == "constant"

    def assemble(h: int) -> PipelineModel:
        scaled = []
        for c in numbers:
            fill, mean, deviation = stats.get((h, c), (loo.CONSTANT_NUMBER, 0.0, 1.0))
            if not cfg.scale_numeric:
                mean, deviation = 0.0, 1.0
            scaled.append((c, f"num__{c}", fill, mean, deviation))
        blanks = [
            (c, f"txt__{c}", loo.CONSTANT_TEXT if constant else fills.get((h, c), text.NULL_TEXT))
            for c in texts
        ]
        encoders = _encoders(folded.sparkSession.range(1), texts, levels, h)
        hot = [f"hot__{c}" for c in texts if levels.get((h, c))]
        stages = [FeatureModel.make(cfg, tables[h], sizes), NumericModel().remember(columns=scaled)]
        if hot:
            stages += [TextFillModel().remember(columns=blanks), *encoders]
        inputs = [output for _, output, *_ in scaled] + hot
        if not inputs:
            raise SchemaError(f"no feature has a value in the training rows of fold {h}")
        stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
        return PipelineModel(stages)

    return in_threads(folded.sparkSession, assemble, range(n_splits), n_splits)


def width(prep: PipelineModel) -> int:
    """How many slots the feature vector has, from the fitted stages alone."""
    total = 0
    for stage in prep.stages:
        if isinstance(stage, NumericModel):
            total += len(stage.recall()["columns"])
        elif isinstance(stage, StringIndexerModel):
            total += len(stage.labels)
        elif isinstance(stage, LevelModel):
            total += stage.recall()["size"]
    return total


def direct(stages: Sequence[Transformer], df: DataFrame) -> tuple[DataFrame, Column] | None:
    """The table after the stages that are column functions, and its feature vector as an array of them.

    The array has the values of the assembled vector without indexing, encoding and assembling row by row. None for wide
    vectors and for stages that are not those of `learn`.
    """
    labels: dict[str, tuple[str, list[str]]] = {}
    hot: dict[str, str] = {}
    plain: list[Transformer] = []
    for stage in stages:
        if isinstance(stage, (FeatureModel, NumericModel, TextFillModel)) and not labels:
            plain.append(stage)
        elif isinstance(stage, StringIndexerModel) and stage.getHandleInvalid() == "keep":
            labels[stage.getOutputCol()] = (stage.getInputCol(), list(stage.labels))
        elif isinstance(stage, OneHotEncoderModel) and stage.getDropLast():
            hot |= dict(zip(stage.getOutputCols(), stage.getInputCols()))
        elif not (isinstance(stage, VectorAssembler) and stage is stages[-1] and stage.getHandleInvalid() in ("keep", "error")):
            return None
    if not stages or not isinstance(stages[-1], VectorAssembler) or not set(hot.values()) <= set(labels):
        return None
    inputs, strict = stages[-1].getInputCols(), stages[-1].getHandleInvalid() == "error"
    if sum(len(labels[hot[c]][1]) if c in hot else 1 for c in inputs) > _MOST_SLOTS:
        return None
    blank = F.raise_error(F.lit("blank in a feature")).cast("double") if strict else F.lit(float("nan"))
    slots: list[Column] = []
    for c in inputs:
        if c in hot:
            text_col, levels = labels[hot[c]]
            slots += [F.coalesce((F.col(text_col) == F.lit(level)).cast("double"), F.lit(0.0)) for level in levels]
        else:
            slots.append(F.coalesce(known(F.col(c)), blank))
    for stage in plain:
        df = stage.transform(df)
    return df, F.array(*slots)


def with_blanks(prep: PipelineModel) -> PipelineModel:
    """The same fitted pipeline, but blank numbers reach the feature vector as NaN instead of being filled."""
    out = []
    for stage in prep.stages:
        if isinstance(stage, NumericModel):
            kept = [(name, output, None, mean, sd) for name, output, _, mean, sd in stage.recall()["columns"]]
            stage = NumericModel().remember(columns=kept)
        elif isinstance(stage, VectorAssembler):
            stage = VectorAssembler(inputCols=stage.getInputCols(), outputCol=stage.getOutputCol(), handleInvalid="keep")
        out.append(stage)
    return PipelineModel(out)


class Preprocessor(Estimator):
    """Preprocessing as an estimator for an ordinary Spark ML pipeline: learns from all rows given."""

    def __init__(self, cfg: FeaturesConfig, exclude: Iterable[str] = ()) -> None:
        super().__init__()
        self.cfg = cfg
        self.exclude = tuple(exclude)

    def _fit(self, df: DataFrame) -> PipelineModel:
        whole = df.withColumn(FOLD, F.lit(-1))
        return learn(whole, self.cfg, 1, "kfold", self.exclude)[0]


def build_pipeline(
    schema: T.StructType,
    target: str,
    id_col: str | None,
    cfg: FeaturesConfig | None = None,
    model: Estimator | None = None,
) -> tuple[Pipeline, list[str], list[str]]:
    """Unfitted pipeline with its numeric and text columns; the target and id are never features."""
    cfg = cfg or FeaturesConfig()
    exclude = [c for c in (target, id_col, LABEL) if c]
    numbers, texts = feature_columns(schema, cfg, exclude)
    stages: list[Estimator] = [Preprocessor(cfg, exclude)]
    if model is not None:
        stages.append(model)
    return Pipeline(stages=stages), numbers, texts


def feature_names(pipeline: PipelineModel) -> list[str]:
    """Names of the vector's slots in order."""
    names: list[str] = []
    labels: dict[str, list[str]] = {}
    for stage in pipeline.stages:
        if isinstance(stage, StringIndexerModel):
            labels[stage.getOutputCol().removeprefix("idx__")] = list(stage.labels)
        if isinstance(stage, LevelModel):
            labels[stage.recall()["column"].removeprefix("txt__")] = stage.labels()
        if isinstance(stage, VectorAssembler):
            for column in stage.getInputCols():
                kind, name = column.split("__", 1)
                names += [name] if kind == "num" else [f"{name}={level}" for level in labels[name]]
    return names
