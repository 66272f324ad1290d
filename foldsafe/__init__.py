"""Tabular machine-learning analytics written as Spark DataFrame jobs."""

from foldsafe.config import CVConfig, FeatureColumns, FeaturesConfig, ModelSpec
from foldsafe.errors import FoldsafeError, InferenceError, MetricError, SchemaError, TrainingError

__all__ = [
    "CVConfig",
    "FeatureColumns",
    "FeaturesConfig",
    "FoldsafeError",
    "InferenceError",
    "MetricError",
    "ModelSpec",
    "SchemaError",
    "TrainingError",
]
