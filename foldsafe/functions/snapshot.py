"""JSON snapshots and time stamps held as text in ledger rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order in which a summary lists feature flags, and the stamp formats.
SUMMARY_FLAGS = (
    "add_title",
    "add_family",
    "add_is_alone",
    "add_deck",
    "add_ticket_group_size",
    "log_fare",
    "bin_age",
)
LEDGER_STAMP = "yyyy-MM-dd HH:mm:ss"
RUN_STAMP = "yyyyMMdd-HHmmss"


def valid_json(text: Column) -> Column:
    """The text itself where it parses as JSON, else null."""
    parsed = F.try_parse_json(F.nullif(text, F.lit("")))
    return F.when(parsed.isNotNull(), text)


def json_object(text: Column) -> Column:
    """The text itself where it is a JSON object, else null."""
    document = valid_json(text)
    return F.when(F.ltrim(document).startswith("{"), document)


def _flag_text(document: Column, flag: str) -> Column:
    value = F.get_json_object(document, f"$.{flag}")
    spoken = F.when(value == "true", "True").when(value == "false", "False").otherwise(value)
    return F.when(value.isNotNull(), F.concat(F.lit(f"{flag}="), spoken))


def flag_summary(text: Column) -> Column:
    """``flag=value`` pairs of the flags a JSON object holds; null for anything but an object."""
    document = json_object(text)
    # concat_ws leaves out the null entries of flags that are not in the object.
    pairs = F.concat_ws(", ", *[_flag_text(document, flag) for flag in SUMMARY_FLAGS])
    return F.when(document.isNotNull(), pairs)


def first_model(text: Column) -> Column:
    """Name of the first model in a JSON list of models."""
    return F.get_json_object(valid_json(text), "$[0].name")


def ledger_stamp(moment: Column) -> Column:
    return F.date_format(moment, LEDGER_STAMP)


def run_stamp(moment: Column) -> Column:
    return F.date_format(moment, RUN_STAMP)
