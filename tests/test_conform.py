import datetime

import pytest
from helpers import rows
from fleetgold.operators.conform import conform, conform_marked
from pyspark.sql import types as T

SCHEMA = (
    T.StructType()
    .add("id", T.LongType(), False)
    .add("n", T.IntegerType())
    .add("price", T.DecimalType(6, 2))
    .add("day", T.DateType())
    .add("note", T.StringType())
)


def frame(spark, *data):
    return spark.createDataFrame(list(data), "DAY timestamp_ntz, extra int, n string, id int, price double")


WHEN = datetime.datetime(2024, 5, 6, 7, 8)
GOOD = (WHEN, 1, "7", 5, 12.345)


def test_order_types_extras_and_gaps(spark):
    got = conform(frame(spark, GOOD), SCHEMA)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in SCHEMA]
    assert [str(v) for v in got.head()] == ["5", "7", "12.35", "2024-05-06", "None"]


def test_twice_is_once(spark):
    once = conform(frame(spark, GOOD, (None, None, None, 6, None)), SCHEMA)
    assert rows(conform(once, SCHEMA)) == rows(once)
    assert conform(once, SCHEMA).dtypes == once.dtypes


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    "row, message",
    [
        ((WHEN, 1, "x", 5, 1.0), "column n: value does not fit int"),
        ((WHEN, 1, "1", 5, 12345.0), "column price: value does not fit"),
        ((WHEN, 1, "1", None, 1.0), "column id: null"),
    ],
)
def test_bad_values_fail_whatever_the_ansi_mode(spark, conf, ansi, row, message):
    conf(spark__sql__ansi__enabled=ansi)
    with pytest.raises(Exception, match=message):
        conform(frame(spark, row), SCHEMA).collect()


def test_bad_values_marked(spark):
    df = frame(spark, GOOD, (WHEN, 1, "x", None, 99999.0), (WHEN, 1, None, 3, 1.0))
    got = rows(conform_marked(df, SCHEMA), "id", "n", "fg_reason", "fg_values")
    assert got == sorted(
        [
            (5, 7, None, None),
            (None, None, "id: null; n: type; price: type", {"n": "x", "price": "99999.0"}),
            (3, None, None, None),
        ],
        key=repr,
    )


def test_missing_required_and_ambiguous_columns(spark):
    with pytest.raises(ValueError, match="needs column 'id'"):
        conform(spark.range(1).toDF("x"), SCHEMA)
    two = spark.createDataFrame([(1, 2)], "Id bigint, iD bigint")
    with pytest.raises(ValueError, match="ambiguous"):
        conform(two, SCHEMA)
