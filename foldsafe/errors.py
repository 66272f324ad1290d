"""Typed errors, so a caller can tell a bad table from a bad model."""


class FoldsafeError(Exception):
    """Base of every error this package raises on purpose."""


class SchemaError(FoldsafeError):
    """A table does not meet the contract an operator states."""


class TrainingError(FoldsafeError):
    """A model or a cross-fit cannot be built as asked."""


class InferenceError(FoldsafeError):
    """A run cannot score the given table."""


class MetricError(FoldsafeError):
    """No metric exists for the given task."""
