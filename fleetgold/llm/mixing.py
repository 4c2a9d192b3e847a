"""Mix sources to target weights: capped water-filling, then whole and fractional repetitions.

All of it is DataFrame operations. A source's target is the smaller of its cap
(``max_epochs`` times its size) and a common level times its weight; the level is
the one at which the targets add up to ``epochs`` times all sizes. It comes in
closed form from the sources sorted by cap over weight, which gives the same
targets as resharing the excess until no source is above its cap.

A target is met by whole repetitions of every document and one fractional
repetition, for which documents are taken in a seeded random order until the
target is reached to the nearest document. The running sum behind that order is
made in two levels (sums of hash ranges of a source, then inside one range), so
no source is sorted in one task, however many rows it holds.

Defined results: a null text has size 0; sources sort by code point, null last
and a source of its own; documents of size 0 are taken as often as their place in
the order says and add no words; repeated rows count each; an empty table gives
an empty result; if all caps together are below the wanted sum, every source gets
its cap. Other columns are carried untouched inside ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgold.llm.common import WORD, saved, text_of
from fleetgold.operators.skew import lookup_join

#: Hash ranges of a source, three hexadecimal digits.
RANGE_DIGITS = 3


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: float = 1.5, max_epochs: float = 2.0
) -> DataFrame:
    """``sizes`` (source, source_size), one row per source, with ``weight`` and ``target``.

    The windows run over one row per source, never over documents.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    weighted = sizes.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    ).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(everything) * F.lit(float(epochs))
    level = (wanted - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = weighted.withColumn("n", F.row_number().over(by_fill)).withColumn("level", level)
    first_open = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("n", "level"))).over(everything)
    return levels.withColumn("open", first_open).select(
        "source",
        "source_size",
        "weight",
        F.least(F.col("cap"), F.coalesce(F.col("open.level") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    epochs: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    size: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: row (struct), size, source_size, target, copies, taken.

    ``docs`` needs doc_id, text and source. ``copies`` is how often the mix takes
    the row, ``taken`` its words times that.
    """
    ticket = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
        F.col("source").isNull().alias("unnamed"),
        F.col("doc_id").alias("doc_id"),
        (word_count() if size is None else size).alias("size"),
        ticket.alias("ticket"),
        F.substring(ticket, 1, RANGE_DIGITS).alias("range"),
    )
    # One short row per source and hash range: read by every later step.
    ranges = saved(rows.groupBy("source", "name", "unnamed", "range").agg(F.sum("size").alias("range_size")))
    targets = source_targets(
        ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, epochs, max_epochs
    )
    ordered = Window.partitionBy("name", "unnamed").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        ranges.withColumn("below", F.coalesce(F.sum("range_size").over(ordered), F.lit(0)))
        .join(
            targets.select(
                F.coalesce("source", F.lit("")).alias("name"),
                F.col("source").isNull().alias("unnamed"),
                "source_size",
                "target",
            ),
            ["name", "unnamed"],
        )
        .withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("name", "unnamed", "range", "below", "source_size", "target", "whole", "rest")
    )
    inside = (
        Window.partitionBy("name", "unnamed", "range")
        .orderBy("ticket", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = F.col("below") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    return (
        lookup_join(rows, plan, ["name", "unnamed", "range"], "inner")
        .withColumn("reached", reached)
        .withColumn("copies", (F.col("whole") + (F.col("reached") <= F.col("rest")).cast("long")).cast("long"))
        .select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The documents of a mix, each row as often as the mix takes it."""
    return (
        mixed.where("copies > 0")
        .withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .select(*[F.col("row").getField(c).alias(c) for c in columns])
    )
