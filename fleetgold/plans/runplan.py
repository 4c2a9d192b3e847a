"""Which product runs for which tenant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgold.functions.address import LAYOUT_COORDINATES, address_problem
from fleetgold.functions.params import expected_tables, last_value
from fleetgold.functions.rows import each
from fleetgold.operators.shares import READABLE_FORMATS, RUN_KEYS, run_checks
from fleetgold.sources.launch import launch_runs

BAD_COORDINATES = "BAD_COORDINATES"
BAD_PARAMS = "BAD_PARAMS"
BAD_CYCLE = "BAD_CYCLE"
SKIP_SHARES = "SKIP_SHARES"
READY_UNCHECKED = "READY_UNCHECKED"
SKIP_TABLES = "SKIP_TABLES"
READY = "READY"
RUNNABLE = (READY, READY_UNCHECKED)
FAULTY = (BAD_COORDINATES, BAD_PARAMS, BAD_CYCLE)


def planned_runs(products: DataFrame) -> DataFrame:
    """Runs with what their checks need: shares, wanted tables, product faults, products that go first.

    A wanted table that another product of the launch makes is not looked for in the shares.
    """
    c = F.col("coordinates")
    problem = address_problem(F.lit(LAYOUT_COORDINATES), c["version"], c["namespace"], c["name"])
    bad_params = F.size("bad_params") > 0
    wants = expected_tables(last_value(F.col("params"), "input_tables"))
    linked = {"made_inside": F.array().cast("array<string>"), "producers": F.array().cast("array<string>"),
              "level": F.lit(0), "in_cycle": F.lit(False), "launch_linked": F.lit(False)}
    products = products.withColumns({k: v for k, v in linked.items() if k not in products.columns})
    outside = F.filter(wants, lambda w: ~F.array_contains("made_inside", w))
    return launch_runs(
        products.select(
            *[k for k in RUN_KEYS if k != "tenant_id"],
            "tenants",
            "correlation_id",
            problem.isNotNull().alias("bad_coordinates"),
            bad_params.alias("has_bad_params"),
            "share_ids",
            F.when(bad_params, F.array().cast("array<string>")).otherwise(outside).alias("wants"),
            (~bad_params & (F.size(wants) > 0)).alias("checked"),
            "level",
            "in_cycle",
            "producers",
            "launch_linked",
        )
    )


def _after_producers(states: DataFrame, more: Sequence[str]) -> DataFrame:
    """Of linked products only those stay runnable whose producers are, for the same tenant.

    A tenant's runs of one launch are one document's products, so they fit one row; sorted by
    level, every producer comes before what needs it.
    """
    names = F.array().cast("array<string>")
    run = F.struct("level", "product_id", "correlation_id", "state", "producers", *more)
    runs = states.groupBy("launch_id", "tenant_id").agg(F.array_sort(F.collect_list(run)).alias("_runs"))
    able = F.aggregate(
        "_runs",
        names,
        lambda ok, r: F.when(
            r["state"].isin(*RUNNABLE) & (F.size(F.array_except(r["producers"], ok)) == 0),
            F.concat(ok, F.array(r["product_id"])),
        ).otherwise(ok),
    )
    each_run = each(runs.withColumn("_able", able), ["launch_id", "tenant_id", "_able"], "_runs", ["r"])
    stopped = F.col("r.state").isin(*RUNNABLE) & ~F.array_contains("_able", F.col("r.product_id"))
    return each_run.select(
        *[F.col("r.product_id").alias(k) if k == "product_id" else F.col(k) for k in RUN_KEYS],
        F.col("r.correlation_id").alias("correlation_id"),
        F.when(stopped, F.lit(SKIP_TABLES)).otherwise(F.col("r.state")).alias("state"),
        *[F.col(f"r.{c}").alias(c) for c in more],
    )


def run_plan(
    products: DataFrame, listings: DataFrame, readable: Sequence[str] = READABLE_FORMATS, more: Sequence[str] = ()
) -> DataFrame:
    """One row per tenant and product with its state; the first that applies wins. ``more`` columns of the runs come along.

    Faults of the product come before readiness, so a bad parameter also marks
    an unready product. Shuffles: listings to their index, index and
    ports to the join, what they found and the runs' own rows to their run; launches whose products
    need each other once more, by launch and tenant.
    """
    carry = ["correlation_id", "bad_coordinates", "has_bad_params", "checked", "level", "in_cycle", "producers", "launch_linked", *more]
    checks = run_checks(planned_runs(products), listings, carry, readable)
    state = (
        F.when(F.col("bad_coordinates"), BAD_COORDINATES)
        .when(F.col("has_bad_params"), BAD_PARAMS)
        .when(F.col("in_cycle"), BAD_CYCLE)
        .when(F.col("shares_missing") > 0, SKIP_SHARES)
        .when(~F.col("checked"), READY_UNCHECKED)
        .when(F.size("missing") > 0, SKIP_TABLES)
        .otherwise(READY)
    )
    states = checks.withColumn("state", state)
    wanted = [*RUN_KEYS, "correlation_id", "state", *more]
    if "launch_linked" not in products.columns:
        return states.select(wanted)
    alone = states.where(~F.col("launch_linked")).select(wanted)
    return alone.unionByName(_after_producers(states.where("launch_linked"), more))
