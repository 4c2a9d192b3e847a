"""What the physical plans must look like."""

import pytest
from checks import queries
from helpers import SMALL
from fleetgold.operators.latest import latest
from fleetgold.operators.skew import broadcast_checked, lookup_join
from fleetgold.plans.store import Coordinates, Store
from fleetgold.sources.shared import shared_folder
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [
    n
    for n in queries.QUERIES
    if n not in ("scan_counts", "scan_by_location", "snapshot_write", "snapshot_changes") and not n.startswith("fleet_")
]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_no_pairs(spark, name):
    text = plan(queries.QUERIES[name](spark, SMALL))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


@pytest.mark.parametrize(
    "name", ["product_projection", "contract_conform", "conform_rejects", "bad_params", "overwrite_feed", "address_layout"]
)
def test_narrow_operators_do_not_shuffle(spark, name):
    text = plan(queries.QUERIES[name](spark, SMALL))
    assert "hashpartitioning" not in text and "Sort" not in text


def test_scans_read_only_what_is_needed(spark):
    text = plan(queries.contract_conform(spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double,l_shipdate:timestamp_ntz>" in text
    one = plan(queries.contract_conform(spark, SMALL).where("line = 3").select("ship_date"))
    assert "l_extendedprice" not in one


def test_run_plan_shuffles(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(queries.run_plan(spark, SMALL))
    # Index aggregate, both sides of the join, what was found and the runs' own rows to their run; and the
    # products before tenants multiply them, once for each side. The round robin exchange belongs to the
    # fixture that writes the launch documents.
    assert text.count("Exchange hashpartitioning") == 6
    assert text.count("SortMergeJoin") == 1
    index = text[text.index("Exchange hashpartitioning(_mark"):]
    assert "SortAggregate" not in index


def test_wanted_tables_are_not_exploded(spark):
    text = queries.run_plan(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in text.splitlines() if "Generate " in line]
    assert generated and not any("wants" in line.split("[")[0] or "explode(wants" in line for line in generated)
    assert "array_contains(wants" in text


def test_readiness_needs_no_tables(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(queries.share_readiness(spark, SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_readiness_reads_the_runs_once(spark):
    text = plan(queries.share_readiness(spark, SMALL))
    assert text.count("from_json(") == 1
    assert "Union" not in text  # the runs' own rows are not aggregated in the few tasks of a scan of their own


def test_documents_are_parsed_once(spark):
    text = plan(queries.launch_runs(spark, SMALL))
    assert text.count("from_json(") == 1


def test_hot_lookup_key_is_split(spark, conf):
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="50KB",
    )
    source = spark.range(0, 300_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 1000)).alias("k"),
        F.col("id").alias("v"),
    )
    index = source.groupBy("k").agg(F.min("v").alias("first"))
    ran = lookup_join(source, index, ["k"]).groupBy("k").agg(F.count("first"), F.count_distinct("first"))
    assert ("hot", 100_000, 1) in [tuple(r) for r in ran.collect()]
    text = plan(ran)
    assert "skew=true" in text and "skewed" in text


def test_null_lookup_keys_are_spread(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__enabled="false")
    source = spark.range(0, 10_000, 1, 4).select(F.when(F.col("id") < 0, F.lit("a")).alias("k"), F.col("id").alias("v"))
    index = spark.createDataFrame([("a", 1)], "k string, x int")
    parts = lookup_join(source, index, ["k"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r[1] for r in parts) < 2_000


def test_latest_combines_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    text = plan(latest(df, ["k"], ["o"]))
    assert text.index("partial_max(") > text.index("Exchange hashpartitioning")
    assert "Window" not in text


def test_large_tenant_is_written_by_several_tasks(spark, conf, tmp_path):
    conf(spark__sql__adaptive__advisoryPartitionSizeInBytes="500KB")
    df = spark.range(0, 400_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("t"), F.col("id") % 50)).otherwise(F.lit("big")).alias("tenant_id"),
        F.xxhash64("id").alias("v"),
    )
    store, coords = Store(spark, str(tmp_path)), Coordinates("gold", "ns", "T", "1")
    snapshot = store.write_snapshot(df, coords)
    files = spark.read.parquet(snapshot.location).select("tenant_id", F.input_file_name().alias("f")).distinct()
    counts = dict(files.groupBy("tenant_id").count().collect())
    assert counts.pop("big") > 5
    assert sorted(counts.values())[len(counts) // 2] == 1


def test_broadcast_only_below_the_limit(spark):
    df = spark.range(10)
    assert "broadcast" in broadcast_checked(df, 10)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in broadcast_checked(df, 9)._jdf.queryExecution().logical().toString()


def test_shared_folder_is_the_named_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
