"""Tables read at the locations that listings name."""

import pytest
from fleetgold.sources import listed
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LISTED = "tenant_id string, location string, format string"


def listing(spark, *entries):
    return spark.createDataFrame(list(entries), LISTED)


def write(spark, path, *values, fmt="parquet", by=()):
    spark.createDataFrame([(v, f"v{v}") for v in values], "id long, v string").withColumns(
        {name: F.expr(value) for name, value in by}
    ).write.partitionBy(*[name for name, _ in by]).format(fmt).save(str(path))


def test_every_file_goes_to_the_tenants_that_are_listed_with_its_folder(spark, tmp_path):
    odd = tmp_path / "with space+100% é"
    write(spark, odd, 1, 2)
    write(spark, tmp_path / "x", 3)
    write(spark, tmp_path / "x2", 4)
    write(spark, tmp_path / "x" / "inside", 5)
    write(spark, tmp_path / "plain", 6, fmt="orc")
    found = listed.listed_table(
        spark,
        listing(
            spark,
            ("a", str(odd), "parquet"),
            ("b", f"file://{odd}/", "parquet"),
            ("b", f"{tmp_path}//x/", "parquet"),
            ("b", f"file:{tmp_path}/x", "parquet"),
            ("c", f"{tmp_path}/x/inside", "parquet"),
            ("c", str(tmp_path / "plain"), "orc"),
        ),
    )
    assert rows(found, "tenant_id", "id", "v") == [
        ("a", 1, "v1"), ("a", 2, "v2"), ("b", 1, "v1"), ("b", 2, "v2"), ("b", 3, "v3"), ("c", 5, "v5"), ("c", 6, "v6"),
    ]


def test_partition_folders_become_columns(spark, tmp_path):
    kind = ("kind", "case when id = 1 then null when id = 2 then 'a b/c%=+é' else concat('k', id) end")
    write(spark, tmp_path / "p", 1, 2, 3, by=[("day", "cast(id as int) * 10"), kind])
    write(spark, tmp_path / "flat", 9)
    entries = listing(spark, ("a", str(tmp_path / "p"), "parquet"), ("b", str(tmp_path / "flat"), "parquet"))
    assert rows(listed.listed_table(spark, entries), "tenant_id", "id", "day", "kind") == [
        ("a", 1, "10", None), ("a", 2, "20", "a b/c%=+é"), ("a", 3, "30", "k3"), ("b", 9, None, None),
    ]
    schema = StructType.fromDDL("id long, day int, kind string, more double")
    typed = listed.listed_table(spark, entries, schema)
    assert dict(typed.dtypes)["day"] == "int"
    assert rows(typed, "tenant_id", "id", "day", "more") == [
        ("a", 1, 10, None), ("a", 2, 20, None), ("a", 3, 30, None), ("b", 9, None, None),
    ]


def test_one_partition_can_be_a_tenants_table(spark, tmp_path):
    write(spark, tmp_path / "all", 1, 2, 3, by=[("home", "concat('h', id)")])
    entries = listing(spark, ("a", f"{tmp_path}/all/home=h1", "parquet"), ("b", f"{tmp_path}/all/home=h3", "parquet"))
    found = listed.listed_table(spark, entries)
    assert "home" not in found.columns and rows(found, "tenant_id", "id") == [("a", 1), ("b", 3)]


def test_a_folder_by_tenant_gives_each_its_own(spark, tmp_path):
    write(spark, tmp_path / "all", 1, 2, 3, by=[("fg_rejected", "id = 3"), ("tenant_id", "if(id = 1, 'a', 'b c%')")])
    entries = listing(spark, *[(t, str(tmp_path / "all"), "parquet") for t in ("a", "b c%", "d")])
    found = listed.listed_table(spark, entries)
    assert sorted(found.columns) == ["id", "tenant_id", "v"]
    assert rows(found, "tenant_id", "id") == [("a", 1), ("b c%", 2)]


def test_files_own_tenant_column_gives_way(spark, tmp_path):
    spark.range(2).withColumn("tenant_id", F.lit("theirs")).write.parquet(str(tmp_path / "t"))
    found = listed.listed_table(spark, listing(spark, ("a", str(tmp_path / "t"), "parquet")))
    assert rows(found, "tenant_id", "id") == [("a", 0), ("a", 1)]


def test_files_of_different_age_are_merged(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "old"))
    spark.range(1, 2).withColumn("more", F.lit("m")).write.parquet(str(tmp_path / "new"))
    entries = listing(spark, ("a", str(tmp_path / "old"), "parquet"), ("b", str(tmp_path / "new"), "parquet"))
    assert rows(listed.listed_table(spark, entries), "tenant_id", "id", "more") == [("a", 0, None), ("b", 1, "m")]


def test_other_formats_are_read_one_folder_at_a_time(spark, tmp_path):
    """The way a format goes that reads one table a scan, such as Delta; JSON stands for it."""
    for name, n in (("a", 1), ("b", 2)):
        spark.range(n).write.json(str(tmp_path / name))
    entries = listing(
        spark, ("t", str(tmp_path / "a"), "json"), ("u", str(tmp_path / "b"), "json"), ("v", str(tmp_path / "a"), "json")
    )
    assert rows(listed.listed_table(spark, entries), "tenant_id", "id") == [("t", 0), ("u", 0), ("u", 1), ("v", 0)]


def test_nothing_listed_and_nothing_there(spark, tmp_path):
    nothing = listing(spark, ("a", "x", "parquet")).limit(0)
    with pytest.raises(KeyError, match="no location"):
        listed.listed_table(spark, nothing)
    typed = listed.listed_table(spark, nothing, StructType.fromDDL("id long, tenant_id string"))
    assert typed.columns == ["id", "tenant_id"] and typed.isEmpty()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        listed.listed_table(spark, listing(spark, ("a", str(tmp_path / "gone"), "parquet")))


def test_one_scan_and_no_shuffle_of_rows(spark, tmp_path):
    for i in range(12):
        write(spark, tmp_path / f"t{i}", i)
    entries = listing(spark, *[(f"t{i}", str(tmp_path / f"t{i}"), "parquet") for i in range(12)])
    plan = listed.listed_table(spark, entries).select("tenant_id", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "ReadSchema: struct<id:bigint>" in plan
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
