"""Writing to a Delta table, for sessions that have Delta on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def change_feed_statement(location: str) -> str:
    quoted = location.replace("`", "``")
    return f"ALTER TABLE delta.`{quoted}` SET TBLPROPERTIES (delta.enableChangeDataFeed = true)"


def enable_change_feed(spark: SparkSession, location: str) -> None:
    """Only versions written after this carry change rows."""
    spark.sql(change_feed_statement(location))


def delta_writer(df: DataFrame, change_feed: bool = True):
    """A writer that sets the change feed as a property of the table it makes.

    So the first version is in the feed too; a table that is there already needs
    ``enable_change_feed``.
    """
    return df.write.format("delta").option("delta.enableChangeDataFeed", str(change_feed).lower())
