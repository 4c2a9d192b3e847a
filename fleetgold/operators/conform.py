"""Fit a DataFrame to a contract schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Reserved names: no published table may have a column with one of them.
REJECT_COLUMN, VALUES_COLUMN = "fg_reason", "fg_values"


def _source_names(df: DataFrame, schema: StructType) -> dict[str, str | None]:
    """Contract field name to the DataFrame column it reads; ignores case."""
    by_lower: dict[str, list[str]] = {}
    for c in df.columns:
        by_lower.setdefault(c.lower(), []).append(c)
    found: dict[str, str | None] = {}
    for field in schema.fields:
        names = by_lower.get(field.name.lower(), [])
        if field.name in names:
            names = [field.name]
        if len(names) > 1:
            raise ValueError(f"column {field.name!r} is ambiguous: {names}")
        found[field.name] = names[0] if names else None
        if not names and not field.nullable:
            raise ValueError(f"the contract needs column {field.name!r}")
    return found


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def conform(df: DataFrame, schema: StructType, carry: Sequence[str] = ()) -> DataFrame:
    """Columns in contract order and type; extra columns dropped.

    Missing nullable columns become typed nulls, a missing required column is an
    error at once. A value that cannot be cast, or a null in a required column,
    fails the job. One projection: no shuffle, and the source scan reads only
    the contract's columns. ``carry`` columns are kept in front as they are.
    """
    types = dict(df.dtypes)
    sources = _source_names(df, schema)
    out = [_column(c) for c in carry]
    for field in schema.fields:
        source, target = sources[field.name], field.dataType
        if source is None:
            value = F.lit(None).cast(target)
        else:
            value = raw = _column(source)
            if types[source] != target.simpleString():
                value = raw.try_cast(target)
                value = F.when(
                    raw.isNotNull() & value.isNull(),
                    F.raise_error(F.lit(f"column {field.name}: value does not fit {target.simpleString()}")),
                ).otherwise(value)
            if not field.nullable:
                value = F.coalesce(
                    value, F.raise_error(F.lit(f"column {field.name}: null in a required column")).cast(target)
                )
        out.append(value.alias(field.name, metadata=field.metadata))
    return df.select(*out)


def conform_marked(df: DataFrame, schema: StructType, carry: Sequence[str] = ()) -> DataFrame:
    """As ``conform``, but bad rows stay in, with ``fg_reason`` and ``fg_values`` filled.

    ``fg_reason`` lists the faulty columns in contract order, or is null.
    ``fg_values`` maps each column whose value does not fit to that value as text.
    Write the result once, partitioned by ``fg_reason is null``, to get the
    good and the bad rows from a single pass.
    """
    types = dict(df.dtypes)
    sources = _source_names(df, schema)
    out, faults, kept = [_column(c) for c in carry], [], []
    for field in schema.fields:
        source, target = sources[field.name], field.dataType
        if source is None:
            out.append(F.lit(None).cast(target).alias(field.name, metadata=field.metadata))
            continue
        raw = _column(source)
        value = raw if types[source] == target.simpleString() else raw.try_cast(target)
        out.append(value.alias(field.name, metadata=field.metadata))
        if types[source] != target.simpleString():
            misfit = raw.isNotNull() & value.isNull()
            faults.append(F.when(misfit, F.lit(f"{field.name}: type")))
            text = raw.cast("string") if "map" not in types[source] else F.to_json(raw)
            kept.append(F.when(misfit, F.struct(F.lit(field.name).alias("k"), text.alias("v"))))
        if not field.nullable:
            faults.append(F.when(raw.isNull(), F.lit(f"{field.name}: null")))
    reason = F.nullif(F.concat_ws("; ", *faults), F.lit("")) if faults else F.lit(None).cast("string")
    values = F.map_from_entries(F.array_compact(F.array(*kept))) if kept else F.create_map().cast("map<string,string>")
    return df.select(
        *out, reason.alias(REJECT_COLUMN), F.when(reason.isNotNull(), values).alias(VALUES_COLUMN)
    )
