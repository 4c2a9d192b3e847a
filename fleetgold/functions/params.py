"""Product parameters as column expressions over arrays of ``key=value`` text.

A product's parameter list sits in one launch document row, so these stay
inside the row: no explode, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _entry_key(entry: Column) -> Column:
    return F.split_part(entry, F.lit("="), F.lit(1))


def _entry_value(entry: Column) -> Column:
    return F.split_part(entry, F.lit("="), F.lit(2))


def _is_bad(entry: Column) -> Column:
    return F.coalesce(F.size(F.split(entry, "=")) != 2, F.lit(True))


def matching_params(transformers: Column, transformer_id: Column) -> Column:
    """Parameters of all transformers with this name, in listing order."""
    mine = F.filter(
        F.coalesce(transformers, F.array().cast("array<struct<transformerName:string,parameters:array<string>>>")),
        lambda t: t["transformerName"] == transformer_id,
    )
    return F.flatten(
        F.transform(mine, lambda t: F.coalesce(t["parameters"], F.array().cast("array<string>")))
    )


def bad_entries(params: Column) -> Column:
    """Entries that do not hold exactly one ``=``."""
    return F.filter(params, _is_bad)


def good_entries(params: Column) -> Column:
    return F.filter(params, lambda p: ~_is_bad(p))


def last_value(params: Column, key: str) -> Column:
    """Value of the last entry with this key, or null."""
    return _entry_value(
        F.try_element_at(F.filter(params, lambda p: _entry_key(p) == key), F.lit(-1))
    )


def as_map(params: Column) -> Column:
    """All parameters as a map; a repeated key keeps its last value."""
    keys = F.array_distinct(F.transform(params, _entry_key))
    return F.map_from_arrays(
        keys,
        F.transform(
            keys,
            lambda k: _entry_value(
                F.try_element_at(F.filter(params, lambda p: _entry_key(p) == k), F.lit(-1))
            ),
        ),
    )


def change_feed_flag(value: Column) -> Column:
    """True when absent or ``true`` in any case; any other text is false."""
    return F.lower(F.coalesce(value, F.lit("true"))) == "true"


def expected_tables(value: Column) -> Column:
    """Comma list without trimming; null and empty text mean nothing is expected."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(value, ",")
    )
