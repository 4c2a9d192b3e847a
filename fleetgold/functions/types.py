"""Contract type names to Spark types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public CDS core type names and the Spark type each one becomes.
CONTRACT_TYPES = {
    "cds.Binary": "binary",
    "cds.Boolean": "boolean",
    "cds.Date": "date",
    "cds.DateTime": "timestamp_ntz",
    "cds.Double": "double",
    "cds.Int16": "smallint",
    "cds.Int32": "int",
    "cds.Int64": "bigint",
    "cds.Integer": "int",
    "cds.Integer64": "bigint",
    "cds.LargeString": "string",
    "cds.String": "string",
    "cds.Timestamp": "timestamp_ntz",
    "cds.UUID": "string",
}
DECIMAL_TYPE = "cds.Decimal"


def spark_type(type_name: Column, precision: Column, scale: Column) -> Column:
    """Spark type text of a contract element. Unknown names raise."""
    names = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in CONTRACT_TYPES.items()) + ")")
    decimal = F.concat(
        F.lit("decimal("),
        precision.cast("string"),
        F.lit(","),
        F.coalesce(scale, F.lit(0)).cast("string"),
        F.lit(")"),
    )
    return F.coalesce(
        F.when(type_name == DECIMAL_TYPE, decimal).otherwise(F.try_element_at(names, type_name)),
        F.raise_error(
            F.concat(F.lit("no Spark type for contract type "), F.coalesce(type_name, F.lit("null")))
        ).cast("string"),
    )
