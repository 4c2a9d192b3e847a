import json
import threading
import time

import pytest
from checks import fleet
from helpers import SMALL, rows
from fleetgold.plans import status
from fleetgold.plans.publish import Product, in_order, load_published, product_order, publish_standard, run_fleet
from fleetgold.plans.store import Coordinates, Store
from pyspark.sql import functions as F

LISTING = "tenant_id string, share_id string, table_key string, is_list boolean, ord bigint, location string, format string"
KEY = "silver:ns:In:1.0.0"
CONTRACT = json.dumps(
    {
        "definitions": {
            "svc.In": {"elements": {"id": {"type": "cds.Integer"}, "v": {"type": "cds.String"}}},
            "svc.Out": {"elements": {"id": {"type": "cds.Integer64", "notNull": True}, "n": {"type": "cds.Integer"}}},
        }
    }
)
OUT = Coordinates("gold", "ns", "Out", "1.0.0")


@pytest.fixture
def case(spark, tmp_path):
    (tmp_path / "contracts").mkdir()
    (tmp_path / "contracts" / "out.json").write_text(CONTRACT)
    store = Store(spark, str(tmp_path / "store"))
    source = spark.createDataFrame(
        [("a", 1, "1"), ("a", 2, "2"), ("b", 3, "x")], "tenant_id string, id int, v string"
    )
    coords = Coordinates.of_key(KEY)
    snapshot = store.write_snapshot(source, coords)
    store.register(spark.createDataFrame([("a",), ("b",), ("c",)], "tenant_id string"), coords, snapshot, CONTRACT)

    def launch(tenants, *products):
        document = {
            "transformer": {"transformerId": "job"},
            "tenants": {t: {} for t in tenants},
            "storage": {"contractRoot": str(tmp_path / "contracts")},
            "dataProducts": {
                name: {
                    # No layer: it falls back to gold.
                    "coordinates": {k: v for k, v in vars(OUT).items() if k != "layer"},
                    "metadata": {"contractFile": "out.json"},
                    "transformers": [{"transformerName": "job", "parameters": parameters}],
                    "inputPorts": [{"shareIds": ["s"]}],
                }
                for name, parameters in products
            },
            "lifecycle": {"good": {"correlationId": "c1"}},
        }
        return spark.createDataFrame([("L", json.dumps(document))], "launch_id string, document string")

    def listings(*tenants):
        return spark.createDataFrame([(t, "s", KEY, True, 0, snapshot.location, "parquet") for t in tenants], LISTING)

    return store, launch, listings


def double(inputs, params):
    return inputs[KEY].select("tenant_id", "id", F.concat("v", F.lit(params.get("suffix", ""))).alias("n"))


GOOD = ("good", [f"input_tables={KEY}", "suffix=0", "enable_cdf=False"])


def test_ready_tenants_are_published_and_the_rest_recorded(spark, case):
    store, launch, listings = case
    done = run_fleet(store, launch("acd", GOOD, ("bad", ["x"])), listings("a", "c"), double)
    assert list(done) == [("L", "good")] and done[("L", "good")].rows == 2
    assert rows(store.read(OUT), "tenant_id", "id", "n") == [("a", 1, 10), ("a", 2, 20)]
    latest = status.latest_status(store.statuses())
    assert rows(latest, "tenant_id", "product_id", "correlation_id", "severity", "text") == [
        ("a", "bad", None, "ERROR", "BAD_PARAMS"),
        ("a", "good", "c1", "INFO", "success"),
        ("c", "bad", None, "ERROR", "BAD_PARAMS"),
        ("c", "good", "c1", "INFO", "success"),
        ("d", "bad", None, "ERROR", "BAD_PARAMS"),
        ("d", "good", "c1", "INFO", "SKIP_SHARES"),
    ]
    assert rows(store.statuses().where("text = 'active'").groupBy().count()) == [(2,)]
    assert rows(store.current(OUT), "tenant_id", "change_feed") == [("a", False), ("c", False)]


def test_failure_is_recorded_and_raised(spark, case):
    store, launch, listings = case
    with pytest.raises(Exception, match="value does not fit int"):
        run_fleet(store, launch("ab", GOOD), listings("a", "b"), double)
    latest = status.latest_status(store.statuses())
    assert rows(latest, "tenant_id", "severity", "text") == [("a", "ERROR", "error"), ("b", "ERROR", "error")]
    assert store.current(OUT).isEmpty()


def test_products_after_a_failure_are_not_left_active(spark, case):
    store, launch, listings = case
    with pytest.raises(Exception, match="value does not fit int"):
        run_fleet(store, launch("ab", GOOD, ("zlast", [f"input_tables={KEY}"])), listings("a", "b"), double)
    latest = status.latest_status(store.statuses())
    assert rows(latest, "product_id", "text") == [("good", "error")] * 2 + [("zlast", "NOT_STARTED")] * 2


def test_strict_fails_on_faulty_products(spark, case):
    store, launch, listings = case
    with pytest.raises(ValueError, match="faulty products"):
        run_fleet(store, launch("a", GOOD, ("bad", ["x"])), listings("a"), double, strict=True)
    assert rows(status.status_counts(status.latest_status(store.statuses()))) == [("BAD_PARAMS", 1)]


def test_own_publish_step_can_keep_rejects(spark, case):
    store, launch, listings = case

    def publish(store, product, result, ready):
        return publish_standard(store, product, result, ready, keep_rejects=True)

    done = run_fleet(store, launch("ab", GOOD), listings("a", "b"), double, publish=publish)
    assert done[("L", "good")].rows == 3
    assert rows(store.read(OUT), "tenant_id", "id") == [("a", 1), ("a", 2)]
    assert rows(store.read(OUT, rejected=True), "tenant_id", "id") == [("b", 3)]


def test_launch_document_of_the_test_tables(spark):
    docs = fleet.launch(spark, SMALL, "/shared/contract")
    document = json.loads(docs.head()["document"])
    assert len(document["tenants"]) == 25 and document["storage"] == {"contractRoot": "/shared"}


# inputs


def test_inputs_are_all_tables_of_the_shares(spark, case, tmp_path):
    """Without input_tables too; what no share brings is an error, not an empty table."""
    store, launch, listings = case
    spark.createDataFrame([(7, "7")], "id int, v string").write.parquet(str(tmp_path / "other"))
    both = listings("a", "c").unionByName(
        spark.createDataFrame([("c", "s", "silver:ns:Other:1.0.0", True, 0, str(tmp_path / "other"), "parquet")], LISTING)
    )
    seen = {}

    def transform(inputs, params):
        seen.update(keys=sorted(inputs), n=len(inputs), has="gold:x:y:1" in inputs)
        with pytest.raises(KeyError, match="no share of free brings 'gold:x:y:1'"):
            inputs["gold:x:y:1"]
        one, other = inputs[KEY], inputs["silver:ns:Other:1.0.0"]
        return one.unionByName(other).select("tenant_id", "id", F.col("v").alias("n"))

    run_fleet(store, launch("ac", ("free", [])), both, transform)
    assert seen == {"keys": [KEY, "silver:ns:Other:1.0.0"], "n": 2, "has": False}
    assert rows(store.read(OUT), "tenant_id", "id", "n") == [("a", 1, 1), ("a", 2, 2), ("c", 7, 7)]


def test_published_tables_can_be_the_inputs(spark, case):
    store, launch, listings = case
    elsewhere = listings("a").withColumn("location", F.lit("/not there"))
    run_fleet(store, launch("a", GOOD), elsewhere, double, load=load_published)
    assert rows(store.read(OUT), "tenant_id", "id", "n") == [("a", 1, 10), ("a", 2, 20)]


# products in order


def product(name, *producers, table=None):
    return Product("L", name, Coordinates("gold", "n", table or name, "1"), "f", True, {}, producers)


def test_products_wait_for_what_they_read():
    a, b, c, d = product("a", "d", "c"), product("b"), product("c", "d", "gone"), product("d")
    same = product("e", table="b")
    before = product_order([a, b, c, d, same])
    assert before == {a: {c, d}, b: set(), c: {d}, d: set(), same: {b}} and list(before).index(c) > list(before).index(d)
    began, ended, lock = [], [], threading.Lock()

    def job(p):
        with lock:
            began.append((p.product_id, set(ended), len(began) - len(ended)))
        time.sleep(0.05)
        with lock:
            ended.append(p.product_id)
        return p.product_id.upper()

    done, left, error = in_order(before, job, 2)
    assert {p.product_id: r for p, r in done.items()} == {x: x.upper() for x in "abcde"}
    assert left == [] and error is None
    assert all({q.product_id for q in before[p]} <= dict((n, e) for n, e, _ in began)[p.product_id] for p in before)
    assert max(n for *_, n in began) == 1  # never more than two at once


def test_nothing_starts_after_a_failure():
    a, b, c, d = product("a"), product("b"), product("c", "a"), product("d", "b")
    started = []

    def job(p):
        started.append(p.product_id)
        if p is a:
            raise RuntimeError("a failed")
        time.sleep(0.3)

    done, left, error = in_order(product_order([a, b, c, d]), job, 2)
    assert sorted(started) == ["a", "b"] and list(done) == [b] and {p.product_id for p in left} == {"c", "d"}
    assert str(error) == "a failed"


def test_a_failed_product_leaves_its_readers_unstarted(spark, case, tmp_path):
    store, launch, listings = case
    document = json.loads(launch("ab", GOOD).head()["document"])
    inner = json.loads(json.dumps(document["dataProducts"]["good"]))
    inner["coordinates"]["name"] = "In"
    inner["transformers"][0]["parameters"] = ["input_tables=gold:ns:Out:1.0.0"]
    inner["inputPorts"] = []
    document["dataProducts"]["after"] = inner
    docs = spark.createDataFrame([("L", json.dumps(document))], "launch_id string, document string")
    with pytest.raises(Exception, match="value does not fit int"):
        run_fleet(store, docs, listings("a", "b"), double)
    latest = status.latest_status(store.statuses())
    assert rows(latest, "product_id", "text") == [("after", "NOT_STARTED")] * 2 + [("good", "error")] * 2


def test_a_reader_runs_only_for_tenants_whose_producer_is_ready(spark, case):
    store, launch, listings = case
    document = json.loads(launch("ac", GOOD).head()["document"])
    inner = json.loads(json.dumps(document["dataProducts"]["good"]))
    inner["coordinates"]["name"] = "In"
    inner["transformers"][0]["parameters"] = ["input_tables=gold:ns:Out:1.0.0"]
    inner["inputPorts"] = []
    document["dataProducts"]["after"] = inner
    docs = spark.createDataFrame([("L", json.dumps(document))], "launch_id string, document string")

    def transform(inputs, params):
        if "suffix" in params:
            return double(inputs, params)
        return inputs["gold:ns:Out:1.0.0"].select("tenant_id", "id", F.col("n").alias("v"))

    run_fleet(store, docs, listings("a"), transform)
    latest = status.latest_status(store.statuses())
    assert rows(latest, "tenant_id", "product_id", "text") == [
        ("a", "after", "success"), ("a", "good", "success"), ("c", "after", "SKIP_TABLES"), ("c", "good", "SKIP_SHARES"),
    ]
    assert rows(store.read(Coordinates("gold", "ns", "In", "1.0.0")), "tenant_id", "id", "v") == [("a", 1, "10"), ("a", 2, "20")]


def test_jobs_of_a_product_do_not_grow_with_its_tenants(spark, case, tmp_path):
    store, launch, _ = case
    counts = []
    for n in (2, 20):
        tenants = [f"x{i}" for i in range(n)]
        for t in tenants:
            spark.createDataFrame([(1, "1")], "id int, v string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / t))
        some = spark.createDataFrame([(t, "s", KEY, True, 0, str(tmp_path / t), "parquet") for t in tenants], LISTING)
        run_fleet(store, launch(tenants, GOOD), some, double)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup("L/good")) - sum(counts))
    assert store.read(OUT).count() == 20 and 0 < counts[1] <= counts[0]
