import json

import pytest
from helpers import rows
from fleetgold.operators.conform import conform_marked
from fleetgold.operators.lookup import contract_text, merge_requests
from fleetgold.plans.store import Coordinates, Store
from fleetgold.sources.delta import change_feed_statement
from fleetgold.sources.tables import counted, load_table
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

COORDS = Coordinates("gold", "ns", "Things", "1.0.0")
SCHEMA = StructType().add("id", IntegerType()).add("v", IntegerType())
CONTRACT = json.dumps(
    {"definitions": {"svc.Things": {"elements": {"id": {"type": "cds.Integer"}, "v": {"type": "cds.Integer"}}}}}
)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def things(spark, *data):
    return spark.createDataFrame(list(data), "tenant_id string, id int, v int")


def tenants(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "tenant_id string")


def put(store, df, *ids, marked=False):
    snapshot = store.write_snapshot(df, COORDS, marked)
    store.register(tenants(store.spark, *ids), COORDS, snapshot, CONTRACT)
    return snapshot


def test_each_tenant_has_its_own_current_snapshot(spark, store):
    put(store, things(spark, ("a", 1, 1), ("b", 1, 1)), "a", "b")
    put(store, things(spark, ("a", 2, 2)), "a")
    assert rows(store.read(COORDS, SCHEMA), "tenant_id", "id", "v") == [("a", 2, 2), ("b", 1, 1)]
    assert rows(store.read(COORDS), "tenant_id", "id", "v") == [("a", 2, 2), ("b", 1, 1)]


def test_unregistered_snapshot_is_invisible(spark, store):
    put(store, things(spark, ("a", 1, 1)), "a")
    store.write_snapshot(things(spark, ("a", 9, 9)), COORDS)
    assert rows(store.read(COORDS, SCHEMA), "id") == [(1,)]


def test_table_rewritten_from_itself(spark, store):
    put(store, things(spark, ("a", 1, 1), ("b", 5, 5)), "a", "b")
    put(store, store.read(COORDS, SCHEMA).withColumn("v", F.col("v") + 1), "a", "b")
    assert rows(store.read(COORDS, SCHEMA), "id", "v") == [(1, 2), (5, 6)]


def test_ready_tenant_without_rows_becomes_empty(spark, store):
    put(store, things(spark, ("a", 1, 1), ("b", 1, 1)), "a", "b")
    snapshot = put(store, things(spark, ("a", 2, 2)), "a", "b")
    assert snapshot.rows == 1
    assert rows(store.read(COORDS, SCHEMA), "tenant_id", "id") == [("a", 2)]


def test_empty_result_is_counted_and_read(spark, store):
    put(store, things(spark, ("a", 1, 1)), "a")
    snapshot = put(store, things(spark, ("a", 1, 1)).where("id > 5"), "a")
    assert snapshot.rows == 0
    assert store.read(COORDS, SCHEMA).isEmpty()


def test_rejected_rows_come_from_the_same_write(spark, store):
    df = spark.createDataFrame([("a", "1", 1), ("a", "x", 2), ("b", "y", 3)], "tenant_id string, id string, v int")
    snapshot = put(store, conform_marked(df, SCHEMA, carry=["tenant_id"]), "a", "b", marked=True)
    assert snapshot.rows == 3
    assert rows(store.read(COORDS, SCHEMA), "tenant_id", "id", "v") == [("a", 1, 1)]
    rejected = store.read(COORDS, SCHEMA, rejected=True)
    assert rows(rejected, "tenant_id", "v", "fg_reason", "fg_values") == [
        ("a", 2, "id: type", {"id": "x"}),
        ("b", 3, "id: type", {"id": "y"}),
    ]


@pytest.mark.parametrize("name", ["fg_rejected", "FG_Snapshot", "fg_reason", "fg_values"])
def test_reserved_names_are_refused(spark, store, name):
    df = things(spark, ("a", 1, 1)).withColumnRenamed("v", name)
    with pytest.raises(ValueError, match="reserves"):
        store.write_snapshot(df, COORDS)


def test_latest_registration_wins_not_latest_write(spark, store):
    a, b = (store.write_snapshot(things(spark, ("a", v, v)), COORDS) for v in (1, 2))
    for snapshot in (b, a):
        store.register(tenants(spark, "a"), COORDS, snapshot, CONTRACT)
    assert rows(store.read(COORDS), "id") == [(1,)]


def test_contract_text_is_stored_once_and_not_read_for_rows(spark, store):
    for v in range(3):
        put(store, things(spark, ("a", v, v), ("b", v, v)), "a", "b")
    assert store.contracts().count() == 1
    assert "contract" not in store.registrations().columns
    assert rows(store.with_contracts(store.current(COORDS)), "contract") == [(CONTRACT,)] * 2


def test_append_without_marker_is_invisible_and_logs_compact(spark, store, tmp_path):
    put(store, things(spark, ("a", 1, 1)), "a")
    put(store, things(spark, ("a", 2, 2)), "a")
    half = next((tmp_path / "store" / "registry").glob("append-*"))
    before = rows(store.read(COORDS), "id")
    assert before == [(2,)] and store.registrations().count() == 2
    store.compact("registry")
    assert rows(store.read(COORDS), "id") == before and store.registrations().count() == 2
    appends = list((tmp_path / "store" / "registry").glob("append-*"))
    assert len(appends) == 1 and half not in appends
    (appends[0] / "_SUCCESS").unlink()
    assert store.registrations().isEmpty()


def test_orc_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "orc"), fmt="orc")
    put(store, things(spark, ("a", 1, 1)), "a")
    assert rows(store.read(COORDS), "id", "v") == [(1, 1)]
    with pytest.raises(ValueError, match="written as"):
        Store(spark, str(tmp_path / "x"), fmt="csv")


def test_tenant_on_an_older_contract_stays_readable(spark, store):
    old = spark.createDataFrame([("a", 1, "7"), ("b", 2, "x")], "tenant_id string, id int, v string")
    text = CONTRACT.replace('"v": {"type": "cds.Integer"}', '"v": {"type": "cds.String"}')
    store.register(tenants(spark, "a", "b"), COORDS, store.write_snapshot(old, COORDS), text)
    put(store, things(spark, ("b", 3, 3)), "b")
    assert rows(store.read(COORDS), "tenant_id", "id", "v") == [("a", 1, 7), ("b", 3, 3)]


def test_shared_folder_without_a_setting(spark, monkeypatch):
    from fleetgold.sources import shared

    class Conf(dict):
        def get(self, key, *default):
            return dict.get(self, key, *default)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context(), Conf({"spark.sql.warehouse.dir": "file:/w"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())
    Session.conf["spark.sql.warehouse.dir"] = "hdfs://n/w"
    assert shared.shared_folder(Session()) == "hdfs://n/w/fleetgold-shared"
    Session.conf["spark.sql.warehouse.dir"], Context.master = "file:/w", "local[2]"
    assert shared.shared_folder(Session()) == "file:/w/fleetgold-shared"


def test_changes_per_tenant(spark, store):
    put(store, things(spark, ("a", 1, 1), ("a", 2, 2)), "a")
    first = rows(store.changes(COORDS, ["id"], SCHEMA), "tenant_id", "id", "change_type")
    assert first == [("a", 1, "insert"), ("a", 2, "insert")]
    put(store, things(spark, ("a", 2, 3), ("b", 7, 7)), "a", "b")
    assert rows(store.changes(COORDS, ["id"]), "tenant_id", "id", "v", "change_type") == [
        ("a", 1, 1, "delete"),
        ("a", 2, 2, "update_preimage"),
        ("a", 2, 3, "update_postimage"),
        ("b", 7, 7, "insert"),
    ]


def test_same_registration_twice_is_one_publish(spark, store):
    put(store, things(spark, ("a", 1, 1)), "a")
    put(store, things(spark, ("a", 2, 2)), "a", "a")
    assert rows(store.changes(COORDS, ["id"], SCHEMA), "id", "change_type") == [(1, "delete"), (2, "insert")]


def test_changes_need_the_change_feed(spark, store):
    snapshot = put(store, things(spark, ("a", 1, 1)), "a")
    assert store.changes(COORDS, ["id"], SCHEMA).count() == 1
    store.register(tenants(spark, "b"), COORDS, snapshot, CONTRACT, change_feed=False)
    with pytest.raises(ValueError, match="switched off"):
        store.changes(COORDS, ["id"], SCHEMA)


def test_old_snapshots_are_pruned(spark, store):
    for v in range(3):
        put(store, things(spark, ("a", 1, v)), "a")
    plan = store.read(COORDS, SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_only_current_snapshots_are_listed(spark, store):
    for v in range(3):
        last = put(store, things(spark, ("a", 1, v)), "a")
    files = [f for f in store.read(COORDS, SCHEMA).inputFiles() if "/tables/" in f]
    assert files and all(last.snapshot in f for f in files)
    assert store.read(Coordinates("gold", "ns", "Other", "1.0.0"), SCHEMA).isEmpty()


def test_no_contract(spark, store):
    store.register(tenants(spark, "a"), COORDS, store.write_snapshot(things(spark, ("a", 1, 1)), COORDS))
    with pytest.raises(KeyError):
        store.schema_of(COORDS)


def test_table_keys():
    assert Coordinates.of_key("gold:ns:Things:1.0.0") == COORDS == Coordinates.of_key("gold:ns:Things:v1.0.0")
    for key in ("gold:ns:Things", "gold:ns::1.0.0", ""):
        with pytest.raises(KeyError):
            Coordinates.of_key(key)


def test_lookup_of_contract_text(spark):
    current = spark.createDataFrame(
        [("t", "gold", "ns", "A", "1.0.0", "/a", "{}"), ("t", "gold", "ns", "B", "1.0.0", "/b", "")],
        "tenant_id string, layer string, namespace string, name string, version string, location string, contract string",
    )
    asked = "tenant_id string, layer string, namespace string, name string, version string, owner string, n int"

    def ask(*data):
        return spark.createDataFrame([("t", "gold", "ns", name, version, o, n) for name, version, o, n in data], asked)

    assert rows(contract_text(ask(("A", "v1.0.0", "o", 1)), current), "contract") == [("{}",)]
    with pytest.raises(Exception, match="NOT_FOUND gold:ns:C:1.0.0"):
        contract_text(ask(("C", "1.0.0", "o", 1)), current).collect()
    with pytest.raises(Exception, match="NO_CONTRACT gold:ns:B:1.0.0"):
        contract_text(ask(("B", "1.0.0", "o", 1)), current).collect()
    merged = merge_requests(
        ask(("A", "v1.0.0", "o", 1), ("A", "1.0.0", "o", 2), ("B", "1.0.0", "o", 3), ("A", "1.0.0", "p", 1), ("A", "v2.0.0", "p", 2)),
        current,
        ["owner"],
        "n",
    )
    assert rows(merged, "owner", "table_key", "location") == [
        ("o", "gold:ns:A:1.0.0", "/a"),
        ("o", "gold:ns:B:1.0.0", "/b"),
    ]


def test_count_comes_with_the_write(spark, tmp_path):
    df, observed = counted(spark.range(10).where("id > 3"))
    df.write.parquet(str(tmp_path / "x"))
    assert observed.get == {"n": 6}
    assert load_table(spark, [str(tmp_path / "x")] * 2).count() == 12


def test_delta_statement():
    assert change_feed_statement("/lake/t`1") == (
        "ALTER TABLE delta.`/lake/t``1` SET TBLPROPERTIES (delta.enableChangeDataFeed = true)"
    )
