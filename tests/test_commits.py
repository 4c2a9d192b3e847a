"""Numbers of commits, what reads them, and what they keep."""

import json
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from fleetgold.operators.compatibility import contract_diff, holds
from fleetgold.plans.publish import Product, breaking_changes, publish_standard
from fleetgold.plans.store import Coordinates, Store
from fleetgold.sources.commits import CommitConflict, claim, content, numbers
from helpers import rows
from pyspark.sql import functions as F

COORDS = Coordinates("gold", "ns", "Things", "1.0.0")


def document(**elements):
    return json.dumps({"definitions": {"svc.Things": {"elements": elements}}})


CONTRACT = document(id={"type": "cds.Integer"}, v={"type": "cds.Integer"})


def things(spark, *data):
    return spark.createDataFrame(list(data), "tenant_id string, id int, v int")


def tenants(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "tenant_id string")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_every_number_is_given_once(spark, tmp_path):
    folder = str(tmp_path / "c")
    with ThreadPoolExecutor(6) as pool:
        given = list(pool.map(lambda i: claim(spark, folder, f"s{i}"), range(12)))
    assert sorted(given) == numbers(spark, folder) == list(range(1, 13))
    assert {content(spark, folder, n) for n in given} == {f"s{i}" for i in range(12)}


def test_two_writers_and_a_clock_set_back(spark, store, monkeypatch):
    """The later registration counts, although its writer's clock is a day behind."""
    other = Store(spark, store.root)
    one = store.write_snapshot(things(spark, ("a", 1, 1)), COORDS)
    store.register(tenants(spark, "a"), COORDS, one, CONTRACT)
    now = time.time_ns()
    monkeypatch.setattr(time, "time_ns", lambda: now - 86_400 * 10**9)
    two = other.write_snapshot(things(spark, ("a", 2, 2)), COORDS)
    other.register(tenants(spark, "a"), COORDS, two, CONTRACT)
    assert rows(store.read(COORDS), "id") == [(2,)]


def test_a_writer_that_missed_a_commit_is_told(spark, store):
    other = Store(spark, store.root)
    seen = store.version()
    snapshot = store.write_snapshot(things(spark, ("a", 1, 1)), COORDS)
    elsewhere = Coordinates("gold", "ns", "Other", "1.0.0")
    other.register(tenants(spark, "a"), elsewhere, snapshot)  # of another table: no conflict
    number = store.register(tenants(spark, "a"), COORDS, snapshot, CONTRACT, based_on=seen)
    assert number == 2 == store.version()
    with pytest.raises(CommitConflict, match="gold:ns:Things:1.0.0 was committed as 2, after 0"):
        other.register(tenants(spark, "a"), COORDS, snapshot, CONTRACT, based_on=seen)
    assert other.register(tenants(spark, "a"), COORDS, snapshot, CONTRACT, based_on=other.version()) == 3


def test_reads_need_the_base_and_what_comes_after_it(spark, store):
    for n in range(4):
        snapshot = store.write_snapshot(things(spark, ("a", n, n), ("b", n, n)), COORDS)
        store.register(tenants(spark, "a", "b"), COORDS, snapshot, CONTRACT)
    store.rebase()
    late = store.write_snapshot(things(spark, ("b", 9, 9)), COORDS)
    store.register(tenants(spark, "b"), COORDS, late, CONTRACT)
    files = store._latest_registrations().inputFiles()
    assert {f.split("/")[-2].split("-")[0] for f in files} == {"rows", "append"}
    assert len({f.rpartition("/")[0] for f in files}) == 2  # of five appends one is read
    assert rows(store.read(COORDS), "tenant_id", "id") == [("a", 3), ("b", 9)]
    assert store.registrations().count() == 9
    # An append with a lower number that ends after the base was made still counts for its own table.
    other = Coordinates("gold", "ns", "Late", "1.0.0")
    store.register(tenants(spark, "c"), other, late, CONTRACT)
    assert rows(store.current(other), "tenant_id") == [("c",)]
    store.rebase()
    store.compact("registry")
    assert rows(store.read(COORDS), "tenant_id", "id") == [("a", 3), ("b", 9)]


def test_a_base_that_was_not_finished_does_not_count(spark, store, tmp_path):
    store.register(tenants(spark, "a"), COORDS, store.write_snapshot(things(spark, ("a", 1, 1)), COORDS), CONTRACT)
    store.rebase()
    spark.range(1).write.parquet(f"{store.root}/registry-base/base-99999999999999999999/rows")
    assert rows(store.read(COORDS), "id") == [(1,)]


def test_changes_over_several_publishes(spark, store):
    versions = [
        [("a", 1, 1), ("a", 2, 2)],
        [("a", 1, 5), ("a", 3, 3)],
        [("a", 1, 1), ("a", 3, 4), ("b", 7, 7)],
    ]
    numbers = []
    for data in versions:
        df = things(spark, *data)
        numbers.append(store.register(df.select("tenant_id").distinct(), COORDS, store.write_snapshot(df, COORDS), CONTRACT))
    columns = ["tenant_id", "id", "v", "change_type"]
    both = store.changes_between(COORDS, ["id"], numbers[0])
    assert rows(both, *columns) == [("a", 2, 2, "delete"), ("a", 3, 4, "insert"), ("b", 7, 7, "insert")]
    first = store.changes_between(COORDS, ["id"], numbers[0], numbers[1])
    assert rows(first, *columns) == [
        ("a", 1, 1, "update_preimage"), ("a", 1, 5, "update_postimage"), ("a", 2, 2, "delete"), ("a", 3, 3, "insert"),
    ]
    assert store.changes_between(COORDS, ["id"], numbers[2]).isEmpty()


def test_only_folders_that_nothing_needs_are_removed(spark, store):
    snapshots = []
    for n in range(4):
        snapshots.append(store.write_snapshot(things(spark, ("a", n, n), ("b", n, n)), COORDS))
        if n != 1:
            store.register(tenants(spark, "a") if n else tenants(spark, "a", "b"), COORDS, snapshots[-1], CONTRACT)
    assert store.unreferenced().isEmpty()  # all younger than a day
    # b still stands on the first; the second was never registered; a needs its last two.
    assert rows(store.unreferenced(grace_seconds=-3600), "files") == [(2,)]
    assert store.remove_unreferenced(grace_seconds=-3600)[0].endswith(snapshots[1].snapshot)
    assert rows(store.read(COORDS), "tenant_id", "id") == [("a", 3), ("b", 0)]
    assert store.remove_unreferenced(publishes=1, grace_seconds=-3600)[0].endswith(snapshots[2].snapshot)
    assert rows(store.read(COORDS), "tenant_id", "id") == [("a", 3), ("b", 0)]
    assert Store(spark, store.root + "-none").unreferenced().isEmpty()


@pytest.mark.parametrize(
    ("old", "new", "fits"),
    [
        ("int", "bigint", True), ("bigint", "int", False), ("int", "int", True), ("int", "double", True), ("bigint", "double", False),
        ("bigint", "decimal(19,0)", True), ("bigint", "decimal(18,0)", False), ("decimal(9,0)", "int", True),
        ("decimal(10,0)", "int", False), ("decimal(9,1)", "bigint", False), ("decimal(9,3)", "decimal(10,4)", True),
        ("decimal(9,3)", "decimal(10,5)", False), ("decimal(9,3)", "decimal(9,4)", False), ("date", "timestamp_ntz", True),
        ("timestamp_ntz", "date", False), ("decimal(5,2)", "string", True), ("string", "int", False), ("binary", "string", False),
        ("double", "string", False), ("smallint", "decimal(7,2)", True), ("smallint", "decimal(6,2)", False),
    ],
)
def test_types_that_hold_all_values_of_others(spark, old, new, fits):
    assert spark.range(1).select(holds(F.lit(old), F.lit(new))).first()[0] is fits


def test_diff_names_every_kind_of_change(spark):
    old = document(
        a={"type": "cds.Integer"}, b={"type": "cds.Integer64"}, c={"type": "cds.Date"}, d={"type": "cds.Date", "notNull": True},
        e={"type": "cds.Integer"}, f={"type": "cds.String"}, g={"type": "cds.Integer"},
    )
    new = document(
        a={"type": "cds.Integer64"}, b={"type": "cds.Integer"}, c={"type": "cds.Date", "notNull": True}, d={"type": "cds.Date"},
        f={"type": "cds.String"}, g={"type": "cds.Integer64", "notNull": True}, h={"type": "cds.Date"}, i={"type": "cds.Date", "notNull": True},
    )
    one = lambda text: spark.createDataFrame([(1, text)], "k int, contract string")
    found = rows(contract_diff(one(old), one(new)), "column_name", "change", "breaking")
    assert found == [
        ("a", "widened", False), ("b", "narrowed", True), ("c", "now_required", True), ("d", "now_optional", False),
        ("e", "dropped", False), ("f", "same", False), ("g", "now_required", True), ("h", "added", False), ("i", "added_required", True),
    ]


def test_a_breaking_contract_is_refused(spark, store, tmp_path):
    def product(text, name):
        (tmp_path / name).write_text(text)
        return Product("L", "p", COORDS, str(tmp_path / name), True)

    ready, df = tenants(spark, "a"), things(spark, ("a", 1, 1))
    first = product(document(id={"type": "cds.Integer"}, v={"type": "cds.Integer64"}), "first.json")
    assert breaking_changes(store, first, "any", "svc.Things") == []
    publish_standard(store, first, df, ready)
    publish_standard(store, first, df, ready)
    narrow = product(document(id={"type": "cds.Integer", "notNull": True}, v={"type": "cds.Integer"}), "narrow.json")
    with pytest.raises(ValueError, match=r"breaks the registered one: \[\('id', 'now_required'\), \('v', 'narrowed'\)\]"):
        publish_standard(store, narrow, df, ready)
    assert store.read(COORDS).schema["v"].dataType.simpleString() == "bigint"
    publish_standard(store, narrow, df, ready, allow_breaking=True)
    assert store.read(COORDS).schema["v"].dataType.simpleString() == "int"


def test_old_values_that_do_not_fit_are_null_or_fail(spark, store):
    texts = spark.createDataFrame([("a", 1, "7"), ("a", 2, "x"), ("a", 3, None)], "tenant_id string, id int, v string")
    store.register(tenants(spark, "a"), COORDS, store.write_snapshot(texts, COORDS), document(id={"type": "cds.Integer"}, v={"type": "cds.String"}))
    store.register(tenants(spark, "b"), COORDS, store.write_snapshot(things(spark, ("b", 1, 1)), COORDS), CONTRACT)
    assert rows(store.read(COORDS), "id", "v") == [(1, 1), (1, 7), (2, None), (3, None)]
    with pytest.raises(Exception, match="v: value does not fit int"):
        store.read(COORDS, strict=True).collect()
