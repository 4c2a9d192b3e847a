"""Run status: an append-only log and its latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgold.operators.latest import latest

STATUS_SCHEMA = (
    "launch_id string, tenant_id string, product_id string, correlation_id string, "
    "severity string, type string, text string, seq bigint"
)
# Fixed values.
INFO, ERROR = "INFO", "ERROR"
JOB_STATUS = "JOB_STATUS"
ACTIVE, SUCCESS, FAILED = "active", "success", "error"
# Of runs that were ready when an earlier product failed.
NOT_STARTED = "NOT_STARTED"


def status_rows(runs: DataFrame, text, severity: str, seq: int) -> DataFrame:
    """One status per run. ``text`` is a fixed text or a column."""
    return runs.select(
        "launch_id",
        "tenant_id",
        "product_id",
        "correlation_id",
        F.lit(severity).alias("severity"),
        F.lit(JOB_STATUS).alias("type"),
        (F.lit(text) if isinstance(text, str) else text).alias("text"),
        F.lit(seq).cast("bigint").alias("seq"),
    )


def latest_status(log: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Latest status per tenant and product."""
    return latest(log, ["tenant_id", "product_id"], order)


def status_counts(latest_rows: DataFrame, by: Sequence[str] = ("text",)) -> DataFrame:
    return latest_rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
