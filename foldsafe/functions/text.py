"""Text features: honorific titles, deck letters and value replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These decide the feature values and must stay as they are.
TITLE_PATTERN = r",\s*([^\.]+)\."
UNKNOWN_TITLE = "Unknown"
RARE_TITLE = "Rare"
TITLE_VARIANTS = {"Mlle": "Miss", "Ms": "Miss", "Mme": "Mrs"}
TITLE_GROUPS = {
    "Mlle": "Miss",
    "Ms": "Miss",
    "Mme": "Mrs",
    "Lady": "Royal",
    "Countess": "Royal",
    "Dona": "Royal",
    "Sir": "Royal",
    "Don": "Royal",
    "Jonkheer": "Rare",
    "Capt": "Rare",
    "Col": "Rare",
    "Dr": "Rare",
    "Major": "Rare",
    "Rev": "Rare",
}
DECKS = "ABCDEFGT"
UNKNOWN_DECK = "U"
NULL_TEXT = "nan"

# Java's \s is ASCII-only unless this flag is set.
_UNICODE = "(?U)"


def null_as_text(column: Column) -> Column:
    """Text form of a column in which a missing value is the text ``nan``."""
    return F.coalesce(column.cast("string"), F.lit(NULL_TEXT))


def strip(column: Column) -> Column:
    return F.regexp_replace(column, _UNICODE + r"^\s+|\s+$", "")


def title(name: Column) -> Column:
    """The word between the first comma and the following dot, ``Unknown`` when there is none."""
    text = null_as_text(name)
    pattern = _UNICODE + TITLE_PATTERN
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1))).otherwise(
        F.lit(UNKNOWN_TITLE)
    )


def replace_values(column: Column, mapping: dict[str, str]) -> Column:
    """Swap the listed values and keep all others."""
    table = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    return F.coalesce(table[column], column)


def normal_title(name: Column) -> Column:
    """Title with its spelling variants merged."""
    return replace_values(title(name), TITLE_VARIANTS)


def grouped_title(name: Column) -> Column:
    """Title merged into the wider groups used while exploring."""
    return replace_values(title(name), TITLE_GROUPS)


def deck(cabin: Column) -> Column:
    """First letter of the cabin where it names a deck, else ``U``."""
    letter = F.substring(cabin.cast("string"), 1, 1)
    return F.when(letter.isin(*DECKS), letter).otherwise(F.lit(UNKNOWN_DECK))


def ellipsis(column: Column, width: int = 80) -> Column:
    """Cut text longer than ``width`` so that it ends in three dots."""
    cut = F.concat(F.substring(column, 1, width - 3), F.lit("..."))
    return F.when(F.length(column) > width, cut).otherwise(column)


def first_filled(*columns: Column) -> Column:
    """First text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
