"""What a new contract changes for the readers of an old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgold.sources.contracts import contract_columns

SAME, ADDED, ADDED_REQUIRED, DROPPED = "same", "added", "added_required", "dropped"
WIDENED, NARROWED, REQUIRED, OPTIONAL = "widened", "narrowed", "now_required", "now_optional"
#: Changes that old rows may not fit.
BREAKING = (ADDED_REQUIRED, NARROWED, REQUIRED)

# The decimal digits before the point that every value of an integer type fits into.
INTEGER_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}
# Pairs of types (from, to) besides integers and decimals, where every value of the first is one of the second.
WIDER = (
    ("date", "timestamp_ntz"), ("smallint", "double"), ("int", "double"),
    ("boolean", "string"), ("smallint", "string"), ("int", "string"), ("bigint", "string"),
    ("date", "string"), ("timestamp_ntz", "string"),
)


def _digits(kind: Column) -> Column:
    """Digits before the point and after it, or null for a type that is no exact number."""
    numbers = F.regexp_extract_all(kind, F.lit(r"(\d+)"), F.lit(1))
    precision, scale = F.try_element_at(numbers, F.lit(1)).cast("int"), F.try_element_at(numbers, F.lit(2)).cast("int")
    found = F.when(
        kind.startswith("decimal("), F.struct((precision - scale).alias("whole"), scale.alias("part"))
    )
    for name, digits in INTEGER_DIGITS.items():
        found = found.when(kind == name, F.struct(F.lit(digits).alias("whole"), F.lit(0).alias("part")))
    return found


def holds(old: Column, new: Column) -> Column:
    """Does type ``new`` hold every value of type ``old``?

    The order of the types is a lattice: exact numbers by their digits before and after the point
    (an integer type is as wide as its longest number, so decimal(19, 0) holds a bigint, but not the other
    way round), the pairs of ``WIDER``, and any decimal below string.
    """
    a, b = _digits(old), _digits(new)
    integers = list(INTEGER_DIGITS)
    # A decimal fits an integer type only if all its numbers do: one digit less than the longest.
    spare = F.when(new.isin(*integers) & old.startswith("decimal("), 1).otherwise(0)
    exact = (a["whole"] <= b["whole"] - spare) & (a["part"] <= b["part"])
    pairs = F.lit(False)
    for x, y in WIDER:
        pairs = pairs | ((old == x) & (new == y))
    return F.coalesce((old == new) | exact | pairs | (old.startswith("decimal(") & (new == "string")), F.lit(False))


def contract_diff(old: DataFrame, new: DataFrame, contract: str = "contract") -> DataFrame:
    """One row per document, entity and column that either side has: what the change is, and whether it breaks.

    ``old`` and ``new`` are documents with the same key columns. Columns: the keys, ``entity``, ``column_name``,
    ``old_type``, ``new_type``, ``change`` and ``breaking``. A column that changes its type and its null rule has the
    worse of the two. Columns meet by a join on document, entity and name; an entity that only one side has shows up
    as all its columns.
    """
    keys = [c for c in old.columns if c != contract]
    on = [*keys, "entity", "column_name"]
    sides = [
        contract_columns(docs, contract).select(*on, F.col("type").alias(f"{s}_type"), F.col("nullable").alias(f"_{s}_null"))
        for s, docs in (("old", old), ("new", new))
    ]
    both = sides[0].join(sides[1], on, "full")
    a, b = F.col("old_type"), F.col("new_type")
    change = (
        F.when(a.isNull() & F.col("_new_null"), F.lit(ADDED))
        .when(a.isNull(), F.lit(ADDED_REQUIRED))
        .when(b.isNull(), F.lit(DROPPED))
        .when(~holds(a, b), F.lit(NARROWED))
        .when(F.col("_old_null") & ~F.col("_new_null"), F.lit(REQUIRED))
        .when(a != b, F.lit(WIDENED))
        .when(~F.col("_old_null") & F.col("_new_null"), F.lit(OPTIONAL))
        .otherwise(F.lit(SAME))
    )
    return both.select(*on, "old_type", "new_type", change.alias("change")).withColumn(
        "breaking", F.col("change").isin(*BREAKING)
    )
