"""Job parameters. Plain dataclasses: a job is configured by code, not by files."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any

from foldsafe.errors import SchemaError

# More distinct labels than this are taken for a measured value, not for classes.
MOST_CLASSES = 1000
SCHEMES = ("kfold", "stratified", "group", "timeseries")


@dataclass(frozen=True)
class CVConfig:
    """How rows are put into folds.

    ``group_column`` is needed by the ``group`` scheme and ``time_column`` by ``timeseries``. A target of more
    than ``most_classes`` values is refused by the ``stratified`` scheme.
    """

    # Setting names and defaults users already have in their configurations.
    scheme: str = "kfold"
    n_splits: int = 5
    shuffle: bool = True
    random_state: int = 42
    group_column: str | None = None
    time_column: str | None = None
    most_classes: int = MOST_CLASSES

    def __post_init__(self) -> None:
        if self.scheme not in SCHEMES:
            raise SchemaError(f"unknown scheme {self.scheme!r}; use one of {', '.join(SCHEMES)}")
        if self.n_splits < 2:
            raise SchemaError("n_splits must be at least 2")
        if self.scheme == "group" and not self.group_column:
            raise SchemaError("the group scheme needs group_column")
        if self.scheme == "timeseries" and not self.time_column:
            raise SchemaError("the timeseries scheme needs time_column")

    def flags(self) -> dict[str, Any]:
        """The settings as the ledger keeps them: the class limit only where it was changed."""
        flat = asdict(self)
        if self.most_classes == MOST_CLASSES:
            del flat["most_classes"]
        return flat


@dataclass(frozen=True)
class FeatureColumns:
    """Names of the input columns the engineered features read."""

    siblings: str = "SibSp"
    parents: str = "Parch"
    name: str = "Name"
    cabin: str = "Cabin"
    ticket: str = "Ticket"
    fare: str = "Fare"
    age: str = "Age"


@dataclass(frozen=True)
class FeaturesConfig:
    """Which features to add and how to impute, scale and encode."""

    # Setting names and defaults users already have in their configurations.
    scale_numeric: bool = True
    encode_categorical: bool = True
    impute_numeric: str = "median"
    impute_categorical: str = "most_frequent"
    add_family: bool = False
    add_is_alone: bool = False
    add_title: bool = False
    add_deck: bool = False
    add_ticket_group_size: bool = False
    log_fare: bool = False
    bin_age: bool = False
    rare_title_threshold: int = 10
    columns: FeatureColumns = field(default_factory=FeatureColumns)
    drop_cols: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.impute_numeric not in ("median", "mean", "most_frequent", "constant"):
            raise SchemaError(f"unknown numeric imputation {self.impute_numeric!r}")
        if self.impute_categorical not in ("most_frequent", "constant"):
            raise SchemaError(f"unknown text imputation {self.impute_categorical!r}")

    def flags(self) -> dict[str, Any]:
        """The flat settings that a ledger entry keeps as a snapshot."""
        flat = asdict(self)
        flat.pop("columns")
        flat.pop("drop_cols")
        return flat

    @classmethod
    def from_flags(cls, flags: dict[str, Any], **extra: Any) -> "FeaturesConfig":
        known = {f.name for f in fields(cls)}
        unknown = sorted(set(flags) - known)
        if unknown:
            raise SchemaError(f"unknown feature settings: {', '.join(unknown)}")
        return cls(**{**flags, **extra})


@dataclass(frozen=True)
class ModelSpec:
    """A model name with the parameters that differ from its defaults."""

    name: str
    params: dict[str, Any] = field(default_factory=dict)
