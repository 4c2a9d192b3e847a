import pytest
from helpers import rows
from fleetgold.functions import address, params
from fleetgold.functions.rows import each
from fleetgold.functions.types import CONTRACT_TYPES, spark_type
from pyspark.sql import functions as F

PARAM_LISTS = [
    [],
    ["a=1", "b=2", "a=3"],
    ["a="],
    ["=x"],
    ["a"],
    [""],
    ["a=b=c"],
    ["a=1", "bad", "a=2"],
    ["enable_cdf=TRUE", "enable_cdf=no"],
    ["input_tables=x, y", "tier=1"],
]


@pytest.mark.parametrize("entries", PARAM_LISTS)
def test_parameters_like_a_dict(spark, entries):
    df = spark.createDataFrame([(entries,)], "p array<string>")
    got = df.select(
        params.bad_entries(F.col("p")).alias("bad"),
        params.as_map(params.good_entries(F.col("p"))).alias("good"),
        params.last_value(F.col("p"), "a").alias("a"),
    ).head()
    assert got["bad"] == [e for e in entries if e.count("=") != 1]
    expected = {}
    for key, value in (e.split("=") for e in entries if e.count("=") == 1):
        expected[key] = value
    assert got["good"] == expected
    if not got["bad"]:
        assert got["a"] == expected.get("a")


def test_matching_parameters(spark):
    df = spark.createDataFrame(
        [
            ([("x", ["a=1"]), ("y", ["a=2"]), ("x", None), ("x", ["a=3", "b=4"])],),
            (None,),
            ([],),
        ],
        "t array<struct<transformerName: string, parameters: array<string>>>",
    )
    got = df.select(params.matching_params(F.col("t"), F.lit("x"))).collect()
    assert [r[0] for r in got] == [["a=1", "a=3", "b=4"], [], []]


def test_change_feed_flag(spark):
    df = spark.createDataFrame([(None,), ("true",), ("TRUE",), ("yes",), ("",), ("false",)], "v string")
    got = [r[0] for r in df.select(params.change_feed_flag(F.col("v"))).collect()]
    assert got == [True, True, True, False, False, False]


def test_expected_tables_are_not_trimmed(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("a, b",), ("a,",)], "v string")
    got = [r[0] for r in df.select(params.expected_tables(F.col("v"))).collect()]
    assert got == [[], [], ["a"], ["a", " b"], ["a", ""]]


def test_versions_and_keys(spark):
    df = spark.createDataFrame(
        [("v1.0.0",), ("v1.0.0-rc",), ("v1.0.01",), ("v2.0.0",), ("1.0.0",), (None,)], "v string"
    )
    got = [r[0] for r in df.select(address.clean_version(F.col("v"))).collect()]
    assert got == ["1.0.0", "1.0.0-rc", "1.0.01", "v2.0.0", "1.0.0", None]
    key = F.lit("silver:sales:Orders:1.0.0")
    parts = spark.range(1).select(*[address.key_part(key, p) for p in ("layer", "namespace", "name", "version")])
    assert tuple(parts.head()) == ("silver", "sales", "Orders", "1.0.0")


def test_paths_and_their_problems(spark):
    schema = "layout string, layer string, version string, namespace string, name string"
    df = spark.createDataFrame(
        [
            ("coordinates", "", "1", "ns", "T"),
            ("short", None, None, None, "T"),
            ("coordinates", "silver", None, "ns", "T"),
            ("other", "silver", "1", "ns", "T"),
            (None, "silver", "1", "ns", "T"),
            ("short", "silver", "1", "ns", ""),
            ("short", "silver", "1", "ns", None),
        ],
        schema,
    )
    c = F.col
    got = df.select(
        address.result_path(
            c("layout"), F.lit("lake"), F.lit("t1"), c("layer"), c("version"), c("namespace"), c("name")
        ),
        address.address_problem(c("layout"), c("version"), c("namespace"), c("name")),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("lake/t1/gold/1/ns/T", None),
        ("lake/t1/gold/T", None),
        (None, "INCOMPLETE_COORDINATES"),
        (None, "UNKNOWN_LAYOUT"),
        (None, "UNKNOWN_LAYOUT"),
        (None, "NO_NAME"),
        (None, "NO_NAME"),
    ]


def test_required_path(spark):
    one = spark.range(1)
    path, no_path = F.lit("lake/t1"), F.lit(None).cast("string")
    assert one.select(address.required_path(path, no_path)).head()[0] == "lake/t1"
    with pytest.raises(Exception, match="no result path: NO_NAME"):
        one.select(address.required_path(no_path, F.lit("NO_NAME"))).collect()


def test_contract_types(spark):
    df = spark.createDataFrame([(t,) for t in CONTRACT_TYPES] + [("cds.Decimal",)], "t string")
    got = {r[0]: r[1] for r in df.select("t", spark_type(F.col("t"), F.lit(12), F.lit(2))).collect()}
    assert got == {**CONTRACT_TYPES, "cds.Decimal": "decimal(12,2)"}
    for name, precision in (("cds.Vector", 1), ("cds.Decimal", None), (None, 1)):
        row = spark.range(1).select(
            spark_type(F.lit(name).cast("string"), F.lit(precision).cast("int"), F.lit(2))
        )
        with pytest.raises(Exception, match="no Spark type"):
            row.collect()


def test_each_keeps_null_entries_and_drops_empty_arrays(spark):
    df = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "k int, v array<string>")
    assert rows(each(df, ["k"], "v", ["x"], pos="at")) == [(1, 0, "a"), (1, 1, None)]
