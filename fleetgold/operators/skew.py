"""Joins that stay splittable when one key is hot, and checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 200_000


def lookup_join(rows: DataFrame, index: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join many ``rows`` to a small number of ``index`` rows per key.

    ``index`` usually comes out of an aggregate on the same keys. Spark would
    reuse that partitioning for the join, and adaptive execution cannot split a
    hot partition whose other side is not a plain shuffle. The extra hash column
    makes the join keys differ from the aggregate's, so both sides get their own
    shuffle and a hot key's rows are split over many tasks. The index is already
    aggregated, so shuffling it again is cheap; when it is small, adaptive
    execution broadcasts it by its measured size.

    Rows with a null key match nothing; they are spread by a hash of the whole
    row, so that they do not meet in one partition.
    """
    hashable = [c for c, t in rows.dtypes if "map<" not in t]
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = F.when(no_key, F.xxhash64(*hashable)).otherwise(F.xxhash64(*keys))
    joined = rows.withColumn("_mark", spread).join(
        index.withColumn("_mark", F.xxhash64(*keys)), ["_mark", *keys], how
    )
    return joined.drop("_mark")


def broadcast_checked(df: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Mark ``df`` for broadcast only if it has at most ``row_limit`` rows.

    For key lists only (a few short columns). The check stops after
    ``row_limit + 1`` rows; beyond it Spark picks a shuffled join.
    """
    return F.broadcast(df) if df.limit(row_limit + 1).count() <= row_limit else df
