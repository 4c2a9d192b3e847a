"""Row changes between two states of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSERT, DELETE = "insert", "delete"
BEFORE, AFTER = "update_preimage", "update_postimage"
CHANGE_COLUMN = "change_type"


def change_feed(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inserts, deletes and both images of updates, by key. Keys must be unique."""
    sided = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    return changes_by_side(sided, keys, "_new")


def changes_by_side(sided: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Change feed of rows marked old (``side`` false) and new (``side`` true).

    One shuffle for both sides, and one sort after it: keys are unique by contract, so
    combining before the shuffle would sort everything and remove nothing. A key that
    occurs more than once on a side is an error; its rows are only counted, where a
    join would first build all pairs.
    """
    values = [c for c in sided.columns if c not in keys and c != side]
    image = F.struct(*values) if values else F.struct(F.lit(True).alias("_present"))
    is_new = F.col(side)
    grouped = sided.repartition(*keys).groupBy(*keys).agg(
        F.count_if(~is_new).alias("_n_old"),
        F.count_if(is_new).alias("_n_new"),
        F.first(F.when(~is_new, image), ignorenulls=True).alias("_old"),
        F.first(F.when(is_new, image), ignorenulls=True).alias("_new_row"),
    )
    old, new = F.col("_old"), F.col("_new_row")

    def change(kind: str, row):
        return F.struct(F.lit(kind).alias("kind"), row.alias("row"))

    changes = (
        F.when(
            (F.col("_n_old") > 1) | (F.col("_n_new") > 1),
            F.raise_error(F.lit(f"the key ({', '.join(keys)}) is not unique")),
        )
        .when(old.isNull(), F.array(change(INSERT, new)))
        .when(new.isNull(), F.array(change(DELETE, old)))
        .when(~old.eqNullSafe(new), F.array(change(BEFORE, old), change(AFTER, new)))
    )
    return grouped.select(*keys, F.explode(changes).alias("_c")).select(
        *keys,
        *[F.col("_c.row")[c].alias(c) for c in values],
        F.col("_c.kind").alias(CHANGE_COLUMN),
    )


def overwrite_feed(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a full overwrite without a key shows: all old rows out, all new rows in."""
    return old.withColumn(CHANGE_COLUMN, F.lit(DELETE)).unionByName(
        new.withColumn(CHANGE_COLUMN, F.lit(INSERT))
    )


BEFORE_KINDS, AFTER_KINDS = (DELETE, BEFORE), (INSERT, AFTER)


def net_changes(feeds: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Fold change feeds of many versions into the one feed from before the first to after the last.

    ``feeds`` has the keys, values, ``change_type`` and a ``version`` column. Of every key only its first row (does it
    begin with an image of before?) and its last one (does it end with one of after?) count, so versions combine
    before the shuffle, however many there are. What was inserted and deleted again, and
    what came back to its old values, is no change.
    """
    kind = F.col(CHANGE_COLUMN)
    values = [c for c in feeds.columns if c not in (*keys, version, CHANGE_COLUMN)]
    image = F.struct(kind.isin(*BEFORE_KINDS).alias("before"), F.struct(*values, F.lit(True).alias("_there")).alias("row"))
    # Within a version the image of before comes first.
    order = F.struct(F.col(version), kind.isin(*AFTER_KINDS))
    folded = feeds.groupBy(*keys).agg(F.min_by(image, order).alias("_first"), F.max_by(image, order).alias("_last"))
    old = F.when(F.col("_first.before"), F.col("_first.row"))
    new = F.when(~F.col("_last.before"), F.col("_last.row"))

    def change(name: str, row):
        return F.struct(F.lit(name).alias("kind"), row.alias("row"))

    changes = (
        F.when(old.isNull() & new.isNotNull(), F.array(change(INSERT, new)))
        .when(new.isNull() & old.isNotNull(), F.array(change(DELETE, old)))
        .when(~old.eqNullSafe(new), F.array(change(BEFORE, old), change(AFTER, new)))
    )
    return folded.select(*keys, F.explode(changes).alias("_c")).select(
        *keys, *[F.col("_c.row")[c].alias(c) for c in values], F.col("_c.kind").alias(CHANGE_COLUMN)
    )


def apply_changes(state: DataFrame, feed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state after a change feed; with ``change_feed`` and ``net_changes`` it closes the circle.

    One shuffle for both, by key, and no join: a key's state row, images of before and of after meet in one group. A feed that
    does not fit the state fails: an insert of a key that is there, a deletion or update of one that is not, or
    an image of before that differs from the row.
    """
    values = [c for c in state.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in values], F.lit(True).alias("_there"))
    kind = F.col(CHANGE_COLUMN)
    sided = state.select(*keys, row.alias("_row"), F.lit("state").alias("_side")).unionByName(
        feed.select(*keys, row.alias("_row"), F.when(kind.isin(*BEFORE_KINDS), F.lit("before")).otherwise(F.lit("after")).alias("_side"))
    )

    def of(side: str):
        return F.when(F.col("_side") == side, F.col("_row"))

    sides = ("state", "before", "after")
    grouped = sided.repartition(*keys).groupBy(*keys).agg(
        *[F.count(of(s)).alias(f"_n_{s}") for s in sides], *[F.first(of(s), ignorenulls=True).alias(f"_{s}") for s in sides]
    )
    many = F.greatest(*[F.col(f"_n_{s}") for s in sides]) > 1
    named = ", ".join(keys)
    after = (
        F.when(many, F.raise_error(F.lit(f"the key ({named}) is not unique")))
        .when(
            ~F.col("_before").eqNullSafe(F.when(F.col("_before").isNotNull() | F.col("_after").isNotNull(), F.col("_state"))),
            F.raise_error(F.lit(f"the feed does not fit the state at a key ({named})")),
        )
        .when(F.col("_before").isNotNull() | F.col("_after").isNotNull(), F.col("_after"))
        .otherwise(F.col("_state"))
    )
    return (
        grouped.select(*keys, after.alias("_row"))
        .where(F.col("_row").isNotNull())
        .select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in state.columns])
    )
