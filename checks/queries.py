"""The registered queries: each operator over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import fleet
from fleetgold.functions import address
from fleetgold.functions.params import as_map, change_feed_flag, last_value
from fleetgold.functions.rows import each
from fleetgold.operators import changes, compatibility, conform, lookup, shares
from fleetgold.plans import runplan, status
from fleetgold.plans.publish import project_contract
from fleetgold.plans.store import Coordinates, Store
from fleetgold.sources import contracts
from fleetgold.sources import launch as launches
from fleetgold.sources.shared import new_folder
from fleetgold.sources.listed import listed_table
from fleetgold.sources.tables import counted, load_table

LINE_CONTRACT = """{"definitions": {
  "svc.LineItem": {"kind": "entity", "@owner": "sales", "elements": {
    "l_orderkey": {"type": "cds.Integer64", "notNull": true},
    "line": {"type": "cds.Integer64"},
    "price": {"type": "cds.Decimal", "precision": 12, "scale": 2},
    "ship_date": {"type": "cds.Date"},
    "note": {"type": "cds.String", "length": 40}}},
  "svc.Order": {"kind": "entity", "elements": {
    "o_orderkey": {"type": "cds.Integer64", "notNull": true},
    "code": {"type": "cds.Integer"},
    "customer": {"type": "cds.Integer64", "notNull": true}}},
  "svc.Contract": {"kind": "entity", "elements": {
    "o_orderkey": {"type": "cds.Integer64"},
    "o_custkey": {"type": "cds.Integer64"},
    "o_orderstatus": {"type": "cds.String"},
    "o_orderpriority": {"type": "cds.String"},
    "o_totalprice": {"type": "cds.Double"}}}},
 "meta": {"creator": "fixture"}}"""


def _schema(spark: SparkSession, name: str):
    docs = spark.range(1).select(F.lit(LINE_CONTRACT).alias("contract"))
    return contracts.find_entity(docs, name).schema


def _products(spark, d) -> DataFrame:
    return launches.launch_products(fx.launch_docs(spark, d))


def _runs(spark, d) -> DataFrame:
    return runplan.planned_runs(_products(spark, d))


# sources


def scan_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for name in ("orders", "lineitem", "part", "customer"):
        df, observed = counted(load_table(spark, f"{d}/{name}.parquet"), name)
        df.write.format("noop").mode("overwrite").save()
        rows.append((name, observed.get["n"]))
    return spark.createDataFrame(rows, "table_name string, n bigint")


def scan_by_location(spark, d) -> DataFrame:
    """Each tenant's own copy, found through its share listing and read in one scan."""
    store = Store(spark, new_folder(spark, "scan"))
    coords = Coordinates("silver", "sales", "Orders", "1.0.0")
    orders = fx.by_tenant(fx.table(spark, d, "orders"))
    tenants = orders.select("tenant_id").distinct()
    store.register(tenants, coords, store.write_snapshot(orders, coords))
    listed = store.current(coords).select(
        "tenant_id",
        F.lit("s").alias("share_id"),
        F.lit("silver:sales:Orders:1.0.0").alias("table_key"),
        F.lit(True).alias("is_list"),
        F.col("seq").alias("ord"),
        F.concat("location", F.lit("/fg_rejected=false/tenant_id="), "tenant_id").alias("location"),
        F.lit("parquet").alias("format"),
    )
    runs = listed.select(
        F.lit("L").alias("launch_id"), "tenant_id", F.lit("p").alias("product_id"), F.array("share_id").alias("share_ids")
    )
    tables = shares.visible_tables(runs, listed).where("table_key = 'silver:sales:Orders:1.0.0'")
    return listed_table(spark, tables, fx.table(spark, d, "orders").schema).drop("tenant_id")


def product_projection(spark, d) -> DataFrame:
    return project_contract(load_table(spark, f"{d}/orders.parquet"), _schema(spark, "Contract"))


def launch_runs(spark, d) -> DataFrame:
    return launches.launch_runs(_products(spark, d)).select(
        "launch_id", "tenant_id", "product_id", "transformer_id", "correlation_id", "contract_file"
    )


def product_levels(spark, d) -> DataFrame:
    products = launches.linked_products(fx.linked_docs(spark, d))
    made_by = F.array_join(F.array_sort("producers"), ",").alias("producers")
    return products.select("launch_id", "product_id", "level", "in_cycle", made_by)


def product_shares(spark, d) -> DataFrame:
    return launches.product_shares(_products(spark, d))


# contracts


def contract_columns(spark, d) -> DataFrame:
    return contracts.contract_columns(fx.contract_docs(spark, d).select("doc_key", "contract"))


def contract_annotations(spark, d) -> DataFrame:
    return contracts.contract_annotations(fx.contract_docs(spark, d).select("doc_key", "contract"))


def entity_match(spark, d) -> DataFrame:
    return contracts.match_entity(fx.contract_docs(spark, d)).select("doc_key", "name", "entity", "entity_match")


def contract_conform(spark, d) -> DataFrame:
    lines = fx.table(spark, d, "lineitem").select(
        "l_partkey",
        F.col("l_shipdate").alias("ship_date"),
        F.col("l_extendedprice").alias("PRICE"),
        F.col("l_linenumber").alias("line"),
        F.col("l_orderkey").alias("L_OrderKey"),
    )
    return conform.conform(lines, _schema(spark, "LineItem"))


def conform_rejects(spark, d) -> DataFrame:
    priority = F.col("o_orderpriority")
    orders = fx.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", priority).otherwise(F.substring(priority, 1, 1)).alias("code"),
        F.when((F.col("o_orderstatus") == "F") | (priority != "5-LOW"), F.col("o_custkey")).alias("customer"),
    )
    marked = conform.conform_marked(orders, _schema(spark, "Order"))
    raw = F.col(conform.VALUES_COLUMN)["code"].alias("raw_code")
    return marked.select("o_orderkey", "code", "customer", F.col(conform.REJECT_COLUMN).alias("reject_reason"), raw)


# parameters


def product_params(spark, d) -> DataFrame:
    good = _products(spark, d).where(F.size("bad_params") == 0)
    return each(good, ["product_id"], as_map(F.col("params")), ["k", "v"])


def product_flags(spark, d) -> DataFrame:
    return _products(spark, d).select(
        "product_id", change_feed_flag(last_value(F.col("params"), "enable_cdf")).alias("change_feed")
    )


def bad_params(spark, d) -> DataFrame:
    return each(_products(spark, d), ["product_id"], "bad_params", ["entry"])


def expected_tables(spark, d) -> DataFrame:
    wants = runplan.expected_tables(last_value(F.col("params"), "input_tables"))
    rows = each(_products(spark, d), ["product_id"], wants, ["want"], pos="at")
    return rows.select("product_id", (F.col("at") + 1).alias("pos"), "want")


# shares and plan


def share_merge(spark, d) -> DataFrame:
    return shares.share_merge(_runs(spark, d), fx.listings(spark, d)).drop("launch_id")


def share_locations(spark, d) -> DataFrame:
    return shares.share_locations(_runs(spark, d), fx.listings(spark, d)).drop("launch_id")


def share_readiness(spark, d) -> DataFrame:
    return shares.share_readiness(_runs(spark, d), fx.listings(spark, d)).drop("launch_id")


def dependency_gaps(spark, d) -> DataFrame:
    return shares.dependency_gaps(_runs(spark, d), fx.listings(spark, d)).drop("launch_id")


def run_plan(spark, d) -> DataFrame:
    return runplan.run_plan(_products(spark, d), fx.listings(spark, d))


# registry


def registry_upsert(spark, d) -> DataFrame:
    return lookup.current_registrations(fx.registrations(spark, d), fx.REGISTRATION_ORDER)


def registry_lookup(spark, d) -> DataFrame:
    return lookup.lookup_tables(fx.requests(spark, d), registry_upsert(spark, d))


def registry_lookup_partial(spark, d) -> DataFrame:
    """Requests that leave out coordinates: a missing one matches anything."""
    size = F.substring("product_id", 2, 20).cast("bigint") % 3
    asked = fx.requests(spark, d).where("req_ord = 1").select(
        "product_id",
        "tenant_id",
        F.when(size != 0, F.col("layer")).alias("layer"),
        F.lit(None).cast("string").alias("namespace"),
        "name",
        F.when(size == 2, F.col("version")).alias("version"),
    )
    return lookup.lookup_given(asked, registry_upsert(spark, d), ["product_id"])


def coordinates_merge(spark, d) -> DataFrame:
    return lookup.merge_requests(
        fx.requests(spark, d), registry_upsert(spark, d), ["product_id", "tenant_id"], "req_ord"
    )


def address_layout(spark, d) -> DataFrame:
    return _addresses(spark, d).where(F.col("problem").isNull()).drop("problem", "layout")


def address_rejects(spark, d) -> DataFrame:
    return _addresses(spark, d).where(F.col("problem").isNotNull()).select("p_partkey", "layout", "problem")


def _addresses(spark, d) -> DataFrame:
    size = F.col("p_size")
    key = F.concat_ws(
        ":",
        F.when(size % 3 == 0, F.lit("")).otherwise(F.lit("silver")),
        "p_brand",
        F.when(size % 19 == 0, F.lit("")).otherwise(F.col("p_name")),
        F.when(size % 4 == 0, F.lit("v1.0.0")).when(size % 4 == 1, F.lit("v1.0.0-rc")).when(size % 4 == 2, F.lit("v2.0.0")).otherwise(F.lit("1.0.0")),
    )
    layout = F.when(size % 23 == 0, F.lit("other")).when(size % 2 == 0, F.lit("coordinates")).otherwise(F.lit("short"))
    parts = fx.table(spark, d, "part").select(
        "p_partkey",
        address.layer_or_default(address.key_part(key, "layer")).alias("layer"),
        address.key_part(key, "namespace").alias("namespace"),
        address.key_part(key, "name").alias("name"),
        address.clean_version(address.key_part(key, "version")).alias("version"),
        layout.alias("layout"),
    )
    c = {n: F.col(n) for n in ("layer", "namespace", "name", "version", "layout")}
    tenant = F.concat(F.lit("t"), (F.col("p_partkey") % 5).cast("string"))
    return parts.select(
        "*",
        address.result_path(
            c["layout"], F.lit("lake"), tenant, c["layer"], c["version"], c["namespace"], c["name"]
        ).alias("path"),
        address.address_problem(c["layout"], c["version"], c["namespace"], c["name"]).alias("problem"),
    )


# snapshots and changes


def change_feed(spark, d) -> DataFrame:
    return changes.change_feed(fx.table(spark, d, "orders"), fx.edited_orders(spark, d), ["o_orderkey"])


def document_changes(spark, d) -> DataFrame:
    """Changes of whole texts: documents against a trimmed, re-labelled copy."""
    old = fx.table(spark, d, "documents").select("doc_id", "lang", "text")
    new = old.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit("xx")).otherwise(F.col("lang")).alias("lang"), F.trim("text").alias("text"))
    return changes.change_feed(old, new, ["doc_id"])


def overwrite_feed(spark, d) -> DataFrame:
    return changes.overwrite_feed(fx.table(spark, d, "orders"), fx.edited_orders(spark, d))


def _two_snapshots(spark, d) -> tuple[Store, Coordinates]:
    store = Store(spark, new_folder(spark, "store"))
    coords = Coordinates("gold", "sales", "Orders", "1.0.0")
    for orders in (fx.table(spark, d, "orders"), fx.edited_orders(spark, d)):
        rows = fx.by_tenant(orders)
        store.register(rows.select("tenant_id").distinct(), coords, store.write_snapshot(rows, coords))
    return store, coords


def snapshot_write(spark, d) -> DataFrame:
    store, coords = _two_snapshots(spark, d)
    return store.read(coords, fx.table(spark, d, "orders").schema)


def reserved_columns(spark, d) -> DataFrame:
    """A product's own columns named as an older store named its, read back as written."""
    store, coords = Store(spark, new_folder(spark, "own")), Coordinates("gold", "sales", "Own", "1.0.0")
    own = fx.by_tenant(fx.table(spark, d, "orders")).select(
        "tenant_id",
        "o_orderkey",
        (F.col("o_orderstatus") == "P").alias("rejected"),
        F.col("o_orderpriority").alias("snapshot"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("reject_reason"),
    )
    store.register(own.select("tenant_id").distinct(), coords, store.write_snapshot(own, coords))
    return store.read(coords, own.schema)


def reject_side(spark, d) -> DataFrame:
    """Rows that do not fit their contract, from the store: why, and the raw value."""
    store, coords = Store(spark, new_folder(spark, "rejects")), Coordinates("gold", "sales", "Order", "1.0.0")
    priority = F.col("o_orderpriority")
    orders = fx.by_tenant(fx.table(spark, d, "orders")).select(
        "tenant_id",
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", priority).otherwise(F.substring(priority, 1, 1)).alias("code"),
        F.col("o_custkey").alias("customer"),
    )
    marked = conform.conform_marked(orders, _schema(spark, "Order"), carry=["tenant_id"])
    snapshot = store.write_snapshot(marked, coords, marked=True)
    store.register(orders.select("tenant_id").distinct(), coords, snapshot, LINE_CONTRACT)
    values = F.col(conform.VALUES_COLUMN)["code"].alias("raw_code")
    rejected = store.read(coords, rejected=True)
    return rejected.select("tenant_id", "o_orderkey", "code", "customer", F.col(conform.REJECT_COLUMN).alias("reason"), values)


def registration_order(spark, d) -> DataFrame:
    """Snapshot A is written before B and registered after it: A counts."""
    store, coords = Store(spark, new_folder(spark, "order")), Coordinates("gold", "sales", "Orders", "1.0.0")
    first, second = (fx.by_tenant(o) for o in (fx.table(spark, d, "orders"), fx.edited_orders(spark, d)))
    a, b = store.write_snapshot(first, coords), store.write_snapshot(second, coords)
    tenants = first.select("tenant_id").distinct()
    store.register(tenants, coords, b)
    store.register(tenants, coords, a)
    return store.read(coords, fx.table(spark, d, "orders").schema)


def _element(kind: str) -> str:
    elements = f'{{"o_orderkey": {{"type": "cds.Integer64"}}, "code": {{"type": "{kind}"}}}}'
    return f'{{"definitions": {{"svc.Mixed": {{"kind": "entity", "elements": {elements}}}}}}}'


def mixed_contracts(spark, d) -> DataFrame:
    """One tenant has moved to a contract with another type; the others stay readable."""
    store, coords = Store(spark, new_folder(spark, "mixed")), Coordinates("gold", "sales", "Mixed", "1.0.0")
    orders = fx.by_tenant(fx.table(spark, d, "orders"))
    old = orders.select("tenant_id", "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("code"))
    store.register(old.select("tenant_id").distinct(), coords, store.write_snapshot(old, coords), _element("cds.String"))
    new = orders.where("tenant_id = 't1'").select("tenant_id", "o_orderkey", F.col("o_custkey").alias("code"))
    store.register(new.select("tenant_id").distinct(), coords, store.write_snapshot(new, coords), _element("cds.Integer64"))
    return store.read(coords)


def snapshot_changes(spark, d) -> DataFrame:
    store, coords = _two_snapshots(spark, d)
    return store.changes(coords, ["o_orderkey"], fx.table(spark, d, "orders").schema)


def _versions(spark, d) -> list[DataFrame]:
    """Orders in four states, the last with some values back as they were."""
    key, orders = F.col("o_orderkey"), fx.table(spark, d, "orders")
    first, second = orders.where(key % 17 != 0), fx.edited_orders(spark, d)
    third = second.where(key % 7 != 0).withColumn("o_orderpriority", F.when(key % 3 == 0, F.lit("x")).otherwise(F.col("o_orderpriority")))
    fourth = orders.where(key % 4 != 0).withColumn("o_custkey", F.when(key % 9 == 0, -key).otherwise(F.col("o_custkey")))
    return [first, second, third, fourth]


def _feeds(spark, d) -> DataFrame:
    states = _versions(spark, d)
    feeds = [
        changes.change_feed(a, b, ["o_orderkey"]).withColumn("version", F.lit(n))
        for n, (a, b) in enumerate(zip(states, states[1:], strict=False))
    ]
    return feeds[0].unionByName(feeds[1]).unionByName(feeds[2])


def changes_folded(spark, d) -> DataFrame:
    """Three feeds, folded into what they add up to."""
    return changes.net_changes(_feeds(spark, d), ["o_orderkey"], "version")


def changes_applied(spark, d) -> DataFrame:
    """The folded feeds, applied to the first state."""
    return changes.apply_changes(_versions(spark, d)[0], changes_folded(spark, d), ["o_orderkey"])


def changes_between(spark, d) -> DataFrame:
    """Net changes from the first to the last of four publishes, and of a tenant that joined later."""
    store, coords = Store(spark, new_folder(spark, "between")), Coordinates("gold", "sales", "Orders", "1.0.0")
    numbers = []
    for n, state in enumerate(_versions(spark, d)):
        rows = fx.by_tenant(state.withColumn("o_custkey", F.abs("o_custkey")))
        rows = rows.where("tenant_id <> 't3'") if n == 0 else rows
        numbers.append(store.register(rows.select("tenant_id").distinct(), coords, store.write_snapshot(rows, coords)))
    schema = fx.table(spark, d, "orders").schema
    return store.changes_between(coords, ["o_orderkey"], numbers[0], numbers[-1], schema)


def registry_incremental(spark, d) -> DataFrame:
    """A base with appends after it, one of them a tenant's way back to an older snapshot."""
    store, coords = Store(spark, new_folder(spark, "base")), Coordinates("gold", "sales", "Orders", "1.0.0")
    first, second = (fx.by_tenant(o) for o in (fx.table(spark, d, "orders"), fx.edited_orders(spark, d)))
    a, b = store.write_snapshot(first, coords), store.write_snapshot(second, coords)
    tenants = first.select("tenant_id").distinct()
    store.register(tenants, coords, a)
    store.rebase()
    store.register(tenants, coords, b)
    store.rebase()
    store.register(tenants.where("tenant_id in ('t2', 't5')"), coords, a)
    return store.read(coords, fx.table(spark, d, "orders").schema)


def unreferenced_files(spark, d) -> DataFrame:
    """Rows in the snapshot folders that nothing refers to: one that was replaced twice, one never registered."""
    store, coords = Store(spark, new_folder(spark, "retention")), Coordinates("gold", "sales", "Orders", "1.0.0")
    states = [fx.by_tenant(s.withColumn("o_custkey", F.abs("o_custkey"))).withColumn("state", F.lit(n)) for n, s in enumerate(_versions(spark, d))]
    for n, rows in enumerate(states):
        snapshot = store.write_snapshot(rows, coords)
        if n != 1:
            store.register(rows.select("tenant_id").distinct(), coords, snapshot)
    locations = sorted(r[0] for r in store.unreferenced(publishes=2, grace_seconds=-3600).select("location").collect())
    reader = spark.read.option("recursiveFileLookup", "true").schema(states[0].drop("tenant_id").schema)
    return reader.parquet(*locations)


def contract_diff(spark, d) -> DataFrame:
    """Every part's contract against the one that the part before it has under the same names."""
    return compatibility.contract_diff(*fx.contract_pair(spark, d))


# status


def run_status(spark, d) -> DataFrame:
    return status.latest_status(fx.status_log(spark, d), ["ts", "event_id"])


def status_counts(spark, d) -> DataFrame:
    return status.status_counts(run_status(spark, d), ["tenant_id", "text"])


# whole fleet


def fleet_publish(spark, d) -> DataFrame:
    return fleet.run(spark, d).read(fleet.CHECKED)


def fleet_unchecked(spark, d) -> DataFrame:
    return fleet.run(spark, d).read(fleet.UNCHECKED)


def fleet_status(spark, d) -> DataFrame:
    rows = status.latest_status(fleet.run(spark, d).statuses())
    return rows.select("tenant_id", "product_id", "correlation_id", "severity", "text")


def fleet_registry(spark, d) -> DataFrame:
    return fleet.run(spark, d).current().select("tenant_id", "layer", "name", "version", "change_feed")


def fleet_listed_inputs(spark, d) -> DataFrame:
    """Tables that others wrote, at the locations their listings name."""
    return fleet.run_listed(spark, d).read(fleet.JOINED)


def fleet_levels(spark, d) -> DataFrame:
    return fleet.run_levels(spark, d).read(fleet.TOP)


def fleet_levels_status(spark, d) -> DataFrame:
    rows = status.latest_status(fleet.run_levels(spark, d).statuses())
    return rows.select("tenant_id", "product_id", "severity", "text")


QUERIES = {
    f.__name__: f
    for f in (
        scan_counts,
        scan_by_location,
        product_projection,
        launch_runs,
        product_levels,
        product_shares,
        contract_columns,
        contract_annotations,
        entity_match,
        contract_conform,
        conform_rejects,
        product_params,
        product_flags,
        bad_params,
        expected_tables,
        share_merge,
        share_locations,
        share_readiness,
        dependency_gaps,
        run_plan,
        registry_upsert,
        registry_lookup,
        registry_lookup_partial,
        coordinates_merge,
        address_layout,
        address_rejects,
        change_feed,
        document_changes,
        overwrite_feed,
        snapshot_write,
        reserved_columns,
        reject_side,
        registration_order,
        mixed_contracts,
        snapshot_changes,
        changes_folded,
        changes_applied,
        changes_between,
        registry_incremental,
        unreferenced_files,
        contract_diff,
        run_status,
        status_counts,
        fleet_publish,
        fleet_unchecked,
        fleet_status,
        fleet_registry,
        fleet_listed_inputs,
        fleet_levels,
        fleet_levels_status,
    )
}
