"""Arrays and maps to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(
    df: DataFrame,
    keep: Sequence[str],
    values: Column | str,
    names: Sequence[str],
    pos: str | None = None,
) -> DataFrame:
    """One row per entry of an array (one name) or a map (two names).

    A plain explode makes the optimizer add a filter on the array's size below
    it, which evaluates the array again; for parsed JSON that is a second parse
    of every document. The outer form has no such filter, and rows of empty
    arrays are dropped by their null position.
    """
    at = pos or "_pos"
    rows = df.select(*keep, F.posexplode_outer(values).alias(at, *names)).where(F.col(at).isNotNull())
    return rows if pos else rows.drop(at)
