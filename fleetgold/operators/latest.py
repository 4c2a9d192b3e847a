"""Latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep, per key, the row with the highest ``order`` values (nulls lowest).

    An aggregate, not a window: each map task sends at most one row per key, so
    a key that holds a large part of the log does not become one large task.
    Rows equal in ``order`` are decided by their other columns, so the result
    does not depend on how the rows were spread; maps, which have no order, by their JSON text. Spark sorts for this aggregate;
    with a hash leading the keys the sort compares one number instead of several
    strings that begin alike.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*[F.col(c) for c in [*order, *rest]])
    best = F.max(row)
    if any("map<" in kind for name, kind in df.dtypes if name in rest):
        best = F.max_by(row, F.struct(*order, F.to_json(F.struct(*rest)).alias("_tie")))
    return (
        df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys)
        .agg(best.alias("_row"))
        .select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])
    )
