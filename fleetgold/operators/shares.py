"""Share registry: which tables a product can see, and from where.

Listings are rows ``(tenant_id, share_id, table_key, is_list, ord, location,
format)``; ``ord`` is unique within one share's list of one table. A location
list is kept as rows ordered by ``(port_ord, ord)``, never as one array, so a
list of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgold.functions.rows import each
from fleetgold.operators.skew import lookup_join

RUN_KEYS = ["launch_id", "tenant_id", "product_id"]
# Formats a table may have to count as readable: what Spark reads with a schema of its own. Fixed value.
READABLE_FORMATS = ("delta", "orc", "parquet")


def _kept(df: DataFrame, keys: Sequence[str], found) -> DataFrame:
    """Add ``kept``: does this port's entry survive the merge of one table key?

    Lists are appended in port order. Where one side is not a list, the later
    port replaces everything before it. So what survives are the lists after the
    last non-list entry, or that entry itself if nothing follows it. A group
    here is one product's ports for one table: no longer than its port list,
    which came out of one document row.
    """
    ports = Window.partitionBy(*keys)
    single, last = F.col("_single"), F.col("_last")
    return (
        df.select(
            "*",
            F.max(F.when(found & ~F.col("is_list"), F.col("port_ord"))).over(ports).alias("_single"),
            F.max(F.when(found, F.col("port_ord"))).over(ports).alias("_last"),
        )
        .withColumn(
            "kept",
            found
            & (
                single.isNull()
                | (F.col("port_ord") > single)
                | ((F.col("port_ord") == single) & (single == last))
            ),
        )
        .drop("_single", "_last")
    )


# Column types the inputs must have. Fixed values.
LISTING_TYPES = {
    "tenant_id": "string",
    "share_id": "string",
    "table_key": "string",
    "is_list": "boolean",
    "ord": "bigint",
    "location": "string",
}
RUN_TYPES = {"tenant_id": "string", "product_id": "string", "share_ids": "array<string>"}


def _need_types(df: DataFrame, types: dict[str, str]) -> None:
    found = dict(df.dtypes)
    wrong = {c: found.get(c, "absent") for c, t in types.items() if found.get(c) != t}
    if wrong:
        raise TypeError(f"expected {({c: types[c] for c in wrong})}, found {wrong}")


def _no_broadcast(ports: DataFrame) -> DataFrame:
    """Rows exploded from documents: far more than their files' size suggests.

    Spark judges a broadcast by file size, so the join is asked to shuffle;
    adaptive execution still splits its hot partitions.
    """
    return ports.hint("merge")


def _surviving_ports(runs: DataFrame, listings: DataFrame, first: Sequence[str] = ("location",)) -> DataFrame:
    """Ports of every run with the tables they bring, after the merge rule; ``first`` are columns of a list's first entry."""
    _need_types(runs, RUN_TYPES)
    _need_types(listings, LISTING_TYPES)
    ports = each(runs, RUN_KEYS, "share_ids", ["share_id"], pos="_at").select(
        *RUN_KEYS, (F.col("_at") + 1).alias("port_ord"), "share_id"
    )
    tables = listings.groupBy("tenant_id", "share_id", "table_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("is_list").alias("is_list"),
        *[F.min_by(c, "ord").alias(c) for c in first],
    )
    joined = lookup_join(_no_broadcast(ports), tables, ["tenant_id", "share_id"], "inner")
    return _kept(joined, [*RUN_KEYS, "table_key"], F.lit(True)).where("kept")


def share_merge(runs: DataFrame, listings: DataFrame) -> DataFrame:
    """Tables each run sees: number of locations and the first of them."""
    return (
        _surviving_ports(runs, listings)
        .groupBy(*RUN_KEYS, "table_key")
        .agg(F.sum("n").alias("n"), F.min_by("location", "port_ord").alias("first_location"))
    )


def visible_tables(runs: DataFrame, listings: DataFrame) -> DataFrame:
    """Tables each run sees, with ``location`` and ``format`` of the first entry of the merged list: what a job reads."""
    _need_types(listings, {"format": "string"})
    return (
        _surviving_ports(runs, listings, ("location", "format"))
        .groupBy(*RUN_KEYS, "table_key")
        .agg(F.min_by("location", "port_ord").alias("location"), F.min_by("format", "port_ord").alias("format"))
    )


def share_locations(runs: DataFrame, listings: DataFrame) -> DataFrame:
    """The merged location lists as rows; list order is ``(port_ord, ord)``."""
    ports = _surviving_ports(runs, listings).select(*RUN_KEYS, "table_key", "port_ord", "share_id")
    entries = listings.select("tenant_id", "share_id", "table_key", "ord", "location")
    return _no_broadcast(ports).join(entries, ["tenant_id", "share_id", "table_key"]).select(
        *RUN_KEYS, "table_key", "port_ord", "ord", "location"
    )


def _share_index(listings: DataFrame, readable: Sequence[str]) -> DataFrame:
    """One row per table of a share.

    Only fixed-width aggregates, so Spark hashes and combines before shuffling.
    """
    ok = F.coalesce(F.col("format").isin(*readable), F.lit(False))
    return (
        listings.groupBy("tenant_id", "share_id", "table_key")
        .agg(
            F.min("ord").alias("_first"),
            F.min(F.when(ok, F.col("ord"))).alias("_first_ok"),
            F.min("is_list").alias("is_list"),
        )
        .select(
            "tenant_id",
            "share_id",
            "table_key",
            "is_list",
            F.coalesce(F.col("_first") == F.col("_first_ok"), F.lit(False)).alias("readable"),
            F.lit(True).alias("known"),
        )
    )


def _ports(runs: DataFrame, *carry: str) -> DataFrame:
    return each(runs, [*RUN_KEYS, *carry], "share_ids", ["share_id"], pos="port_ord")


def run_checks(
    runs: DataFrame,
    listings: DataFrame,
    carry: Sequence[str] = (),
    readable: Sequence[str] = READABLE_FORMATS,
) -> DataFrame:
    """Check shares and wanted tables of all runs: one row per run.

    ``runs`` has ``share_ids`` and ``wants`` arrays. Only the ports become rows. A port meets the tables of its
    share and keeps those that the run's ``wants`` contain; an unknown share leaves one marker. These few rows
    meet the run's own row, where the wanted tables without a readable first location are
    what the array difference leaves. Result: the run's keys and carried columns, ``wants``,
    ``shares_missing`` and ``missing``, the gaps in list order.
    """
    _need_types(runs, {**RUN_TYPES, "wants": "array<string>"})
    _need_types(listings, {**LISTING_TYPES, "format": "string"})
    index = _share_index(listings, readable)
    joined = lookup_join(_no_broadcast(_ports(runs, "wants")), index, ["tenant_id", "share_id"])
    known = F.coalesce("known", F.lit(False))
    met = joined.withColumn("known", known).where(~F.col("known") | F.array_contains("wants", F.col("table_key")))
    found = met.select(*RUN_KEYS, "port_ord", "table_key", "is_list", "readable", "known")
    own = runs.select(*RUN_KEYS, *carry, "wants", F.lit(False).alias("known"))
    by_run = own.unionByName(found, allowMissingColumns=True).repartition(*RUN_KEYS)
    once = [F.first(c, ignorenulls=True).alias(c) for c in (*carry, "wants")]
    per_table = (
        _kept(by_run, [*RUN_KEYS, "table_key"], F.col("known"))
        .groupBy(*RUN_KEYS, "table_key")
        .agg(
            *once,
            F.count_if(F.col("port_ord").isNotNull() & ~F.col("known")).alias("unknown"),
            F.min_by("readable", F.when(F.col("kept"), F.col("port_ord"))).alias("readable"),
        )
    )
    per_run = per_table.groupBy(*RUN_KEYS).agg(
        *once,
        F.sum("unknown").alias("shares_missing"),
        F.collect_set(F.when(F.col("readable"), F.col("table_key"))).alias("_readable"),
    )
    missing = F.filter("wants", lambda w: ~F.array_contains("_readable", w))
    return per_run.withColumn("missing", missing).drop("_readable")


def share_readiness(runs: DataFrame, listings: DataFrame) -> DataFrame:
    """Are all shares of the run known to the tenant? True when it has none.

    The first port, or the null one of a run without any, stands for the run; others go on only if they are unknown.
    So a run's row comes out of the join, whose tasks hold a bounded number of them, and not out of a scan of its own.
    """
    _need_types(runs, RUN_TYPES)
    _need_types(listings, {**LISTING_TYPES, "format": "string"})
    shares = listings.select("tenant_id", "share_id").distinct().withColumn("known", F.lit(True))
    ports = runs.select(*RUN_KEYS, F.posexplode_outer("share_ids").alias("port_ord", "share_id"))
    found = lookup_join(_no_broadcast(ports), shares, ["tenant_id", "share_id"])
    unknown = F.col("port_ord").isNotNull() & F.col("known").isNull()
    own = F.coalesce("port_ord", F.lit(0)) == 0
    rows = found.where(own | unknown).select(*RUN_KEYS, unknown.alias("_unknown"))
    return rows.groupBy(*RUN_KEYS).agg((~F.max("_unknown")).alias("ready"))


def dependency_gaps(
    runs: DataFrame, listings: DataFrame, readable: Sequence[str] = READABLE_FORMATS
) -> DataFrame:
    """Runs with missing or unreadable wanted tables, and the first in list order."""
    checks = run_checks(runs.where(F.size("wants") > 0), listings, readable=readable)
    return checks.where(F.size("missing") > 0).select(
        *RUN_KEYS,
        F.size("missing").cast("bigint").alias("n_missing"),
        F.element_at("missing", 1).alias("first_missing"),
    )
