"""Table registry: registrations, current rows and lookups by coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgold.functions.address import clean_version, table_key
from fleetgold.operators.latest import latest
from fleetgold.operators.skew import lookup_join

COORDINATES = ["layer", "namespace", "name", "version"]
TABLE_KEYS = ["tenant_id", *COORDINATES]
NOT_FOUND, NO_CONTRACT = "NOT_FOUND", "NO_CONTRACT"


def current_registrations(log: DataFrame, order: Sequence[str]) -> DataFrame:
    """Latest registration per tenant and coordinates."""
    return latest(log, TABLE_KEYS, order)


def lookup_tables(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Add location, contract and ``problem`` to requests by tenant and coordinates.

    The requested version is cleaned first. ``problem`` is ``NOT_FOUND``,
    ``NO_CONTRACT`` (absent or empty text) or null.
    """
    index = current.select(*TABLE_KEYS, "location", "contract", F.lit(True).alias("_hit"))
    found = lookup_join(requests.withColumn("version", clean_version(F.col("version"))), index, TABLE_KEYS)
    return found.withColumn(
        "problem",
        F.when(F.col("_hit").isNull(), F.lit(NOT_FOUND)).when(
            F.coalesce("contract", F.lit("")) == "", F.lit(NO_CONTRACT)
        ),
    ).drop("_hit")


def lookup_given(requests: DataFrame, current: DataFrame, request_keys: Sequence[str]) -> DataFrame:
    """All current tables that match the given coordinates of each request; a null coordinate matches any.

    ``requests`` has ``request_keys``, ``tenant_id`` and the coordinates. The requests
    that give the same coordinates are one equi join, so there are at most 16 joins
    and no condition with "or". Result: the request's keys, the found table's
    coordinates and its location.
    """
    asked = requests.withColumn("version", clean_version(F.col("version")))
    given = F.concat(*[F.col(c).isNotNull().cast("int").cast("string") for c in COORDINATES])
    asked = asked.withColumn("_given", given)
    patterns = sorted(r[0] for r in asked.select("_given").distinct().collect())  # at most 16
    found = []
    for pattern in patterns:
        keys = ["tenant_id", *[c for c, g in zip(COORDINATES, pattern, strict=True) if g == "1"]]
        index = current.select(*TABLE_KEYS, "location")
        some = asked.where(F.col("_given") == pattern).select(*{*request_keys, *keys})
        found.append(some.join(index, keys).select(*request_keys, *[c for c in TABLE_KEYS if c not in request_keys], "location"))
    if not found:
        return asked.join(current.select(*TABLE_KEYS, "location"), TABLE_KEYS).select(
            *request_keys, *[c for c in TABLE_KEYS if c not in request_keys], "location"
        )
    return reduce(DataFrame.unionByName, found)


def contract_text(requests: DataFrame, current: DataFrame) -> DataFrame:
    """Contract text per request; an unknown table or an empty contract fails the job."""
    found = lookup_tables(requests, current)
    key = table_key(*[F.coalesce(c, F.lit("?")) for c in COORDINATES])
    failed = F.raise_error(F.concat(F.col("problem"), F.lit(" "), key)).cast("string")
    return found.withColumn(
        "contract", F.when(F.col("problem").isNotNull(), failed).otherwise(F.col("contract"))
    ).drop("problem")


def merge_requests(requests: DataFrame, current: DataFrame, owner: Sequence[str], order: str) -> DataFrame:
    """Tables of each owner's ordered request list, all or nothing.

    If one request of an owner finds nothing, the owner gets no rows. Of several
    requests for one table the last stays. An owner's requests are one list in
    one document, so the window's groups are short.
    """
    found = lookup_tables(requests, current).withColumn(
        "_missing",
        F.max(F.coalesce(F.col("problem") == NOT_FOUND, F.lit(False))).over(Window.partitionBy(*owner)),
    )
    return (
        found.where(~F.col("_missing"))
        .withColumn("table_key", table_key(*[F.col(c) for c in COORDINATES]))
        .groupBy(*owner, "table_key")
        .agg(F.max_by("location", order).alias("location"), F.max_by("contract", order).alias("contract"))
    )
