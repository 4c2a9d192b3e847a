import random
from functools import reduce

import pytest
from helpers import rows
from fleetgold.operators.changes import apply_changes, change_feed, net_changes, overwrite_feed
from fleetgold.operators.latest import latest
from pyspark.sql import functions as F

SCHEMA = "a bigint, b string, v double, w string"


def table(r, n):
    keys = {(r.randint(0, 12), r.choice(["x", "y", None])) for _ in range(n)}
    return [(a, b, r.choice([None, 1.0, 2.0]), r.choice([None, "p", "q"])) for a, b in keys]


@pytest.mark.parametrize("seed", range(3))
def test_feed_applied_to_old_gives_new(spark, seed):
    r = random.Random(seed)
    old, new = table(r, 20), table(r, 20)
    feed = rows(change_feed(spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA), ["a", "b"]))
    state = set(old)
    for change in (c for c in feed if c[4] in ("delete", "update_preimage")):
        state.remove(change[:4])
    for change in (c for c in feed if c[4] in ("insert", "update_postimage")):
        assert change[:4] not in state
        state.add(change[:4])
    assert state == set(new)
    before = {c[:2] for c in feed if c[4] == "update_preimage"}
    assert before == {c[:2] for c in feed if c[4] == "update_postimage"}


def test_same_state_has_no_changes(spark):
    df = spark.createDataFrame(table(random.Random(9), 20), SCHEMA)
    assert change_feed(df, df, ["a", "b"]).isEmpty()


@pytest.mark.parametrize("side", [0, 1])
def test_repeated_key_fails(spark, side):
    frames = [spark.createDataFrame([(1, "x", 1.0, "p")], SCHEMA), spark.createDataFrame([(1, "x", 1.0, "p")] * 2, SCHEMA)]
    with pytest.raises(Exception, match=r"the key \(a, b\) is not unique"):
        change_feed(frames[side], frames[1 - side], ["a", "b"]).collect()


def test_table_of_keys_only(spark):
    old, new = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(2,), (3,)], "a int")
    assert rows(change_feed(old, new, ["a"])) == [(1, "delete"), (3, "insert")]


def test_overwrite_shows_everything(spark):
    old, new = spark.createDataFrame([(1,), (1,)], "a int"), spark.createDataFrame([(1,)], "a int")
    assert rows(overwrite_feed(old, new)) == [(1, "delete"), (1, "delete"), (1, "insert")]


def test_latest_with_null_order(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", 5, 2), ("k", 5, 1), ("n", None, 3)], "k string, o int, v int")
    assert rows(latest(df, ["k"], ["o", "v"])) == [("k", 5, 2), ("n", None, 3)]


def test_nothing_is_sorted_before_the_shuffle(spark):
    old = spark.range(50).selectExpr("id", "cast(id as string) as v")
    new = spark.range(25, 75).selectExpr("id", "'x' as v")
    plan = change_feed(old, new, ["id"])._jdf.queryExecution().executedPlan().toString().splitlines()
    exchange = next(i for i, line in enumerate(plan) if "Exchange" in line)
    assert not any("Sort" in line or "Aggregate" in line for line in plan[exchange:])
    assert sum("Exchange" in line for line in plan) == 1


@pytest.mark.parametrize("seed", range(3))
def test_feeds_of_many_versions_fold_to_the_net_feed(spark, seed):
    r = random.Random(seed)
    states = [spark.createDataFrame(table(r, 20), SCHEMA) for _ in range(5)]
    feeds = [change_feed(a, b, ["a", "b"]).withColumn("n", F.lit(i)) for i, (a, b) in enumerate(zip(states, states[1:], strict=False))]
    folded = net_changes(reduce(lambda x, y: x.unionByName(y), feeds), ["a", "b"], "n")
    assert rows(folded) == rows(change_feed(states[0], states[-1], ["a", "b"]))
    assert rows(apply_changes(states[0], folded, ["a", "b"])) == rows(states[-1])


def test_what_comes_and_goes_is_no_change(spark):
    feed = spark.createDataFrame(
        [(1, "x", "insert", 1), (1, "x", "delete", 2), (2, "x", "delete", 1), (2, "x", "insert", 3), (3, None, "delete", 1),
         (3, "y", "insert", 2), (4, "a", "update_postimage", 1), (4, "b", "update_preimage", 1)],
        "a int, v string, change_type string, n int",
    )
    assert rows(net_changes(feed, ["a"], "n")) == [
        (3, "y", "update_postimage"), (3, None, "update_preimage"), (4, "a", "update_postimage"), (4, "b", "update_preimage"),
    ]


@pytest.mark.parametrize(
    ("change", "message"),
    [
        ((1, "x", "insert"), "does not fit"),
        ((2, "x", "delete"), "does not fit"),
        ((1, "other", "delete"), "does not fit"),
        ((1, "x", "update_postimage"), "does not fit"),
    ],
)
def test_a_feed_that_does_not_fit_fails(spark, change, message):
    state = spark.createDataFrame([(1, "x")], "a int, v string")
    with pytest.raises(Exception, match=message):
        apply_changes(state, spark.createDataFrame([change], "a int, v string, change_type string"), ["a"]).collect()


def test_apply_to_keys_only_and_repeated_keys(spark):
    state, feed = spark.createDataFrame([(1,), (2,)], "a int"), spark.createDataFrame([(1, "delete"), (3, "insert")], "a int, change_type string")
    assert rows(apply_changes(state, feed, ["a"])) == [(2,), (3,)]
    with pytest.raises(Exception, match="not unique"):
        apply_changes(state, feed.union(feed), ["a"]).collect()


def test_latest_of_rows_with_maps(spark):
    df = spark.createDataFrame([("k", 1, {"a": 1}), ("k", 2, {"b": 1}), ("k", 2, {"b": 2}), ("n", 1, None)], "k string, o int, m map<string,int>")
    found = latest(df, ["k"], ["o"])
    assert found.columns == ["k", "o", "m"] and rows(found) == [("k", 2, {"b": 2}), ("n", 1, None)]
