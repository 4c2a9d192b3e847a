"""A whole fleet run over the test tables: silver orders in, two gold products out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import named, table, write_text
from fleetgold.plans.publish import run_fleet
from fleetgold.plans.store import Coordinates, Store
from fleetgold.sources.shared import new_folder

SILVER_KEY = "silver:sales:Orders:1.0.0"
SILVER = Coordinates.of_key(SILVER_KEY)
CHECKED = Coordinates("gold", "sales", "OrderBook", "1.0.0")
UNCHECKED = Coordinates("gold", "sales", "OrderValues", "1.0.0")

_ORDER = {
    "o_orderkey": {"type": "cds.Integer64", "notNull": True},
    "o_custkey": {"type": "cds.Integer64"},
    "o_orderstatus": {"type": "cds.String"},
    "o_orderpriority": {"type": "cds.String"},
}
CONTRACT = json.dumps(
    {
        "definitions": {
            "raw.Orders": {
                "kind": "entity",
                "elements": {
                    **_ORDER,
                    "o_totalprice": {"type": "cds.Double"},
                    "o_orderdate": {"type": "cds.Timestamp"},
                },
            },
            "svc.OrderBook": {
                "kind": "entity",
                "@title": "Order book",
                "elements": {**_ORDER, "o_totalprice": {"type": "cds.Decimal", "precision": 12, "scale": 2}},
            },
            "svc.OrderValues": {
                "kind": "entity",
                "elements": {
                    "o_orderkey": {"type": "cds.Integer64", "notNull": True},
                    "o_orderdate": {"type": "cds.Date"},
                    "o_totalprice": {"type": "cds.Double"},
                    "remark": {"type": "cds.String"},
                },
            },
        },
        "meta": {"creator": "fixture"},
    }
)


def _products(contract_file: str) -> str:
    def product(coords: Coordinates, parameters: list[str], shares: list[str]) -> dict:
        return {
            "coordinates": vars(coords),
            "metadata": {"contractFile": contract_file},
            "transformers": [{"transformerName": "gold-builder", "parameters": parameters}],
            "inputPorts": [{"name": "in", "shareIds": shares}],
        }

    return json.dumps(
        {
            "checked": product(CHECKED, [f"source={SILVER_KEY}", f"input_tables={SILVER_KEY}"], ["crm"]),
            "unchecked": product(UNCHECKED, [f"source={SILVER_KEY}", "enable_cdf=FALSE"], ["raw"]),
        }
    )


def launch(spark: SparkSession, sf_dir: str, contract_folder: str) -> DataFrame:
    """One launch document for all nations; tenants are the nation table's rows."""
    root, _, file = contract_folder.rpartition("/")
    tenants = F.map_from_entries(
        F.transform(
            F.collect_list(F.struct(named("t", F.col("n_nationkey")).alias("id"), "n_name")),
            lambda n: F.struct(n["id"], F.create_map(F.lit("name"), n["n_name"])),
        )
    )
    # n_nationkey is a fixed list of 25 in these tables at every scale.
    one = table(spark, sf_dir, "nation").agg(F.to_json(tenants).alias("tenants"))
    return one.select(
        F.lit("fleet").alias("launch_id"),
        F.concat(
            F.lit('{"transformer": {"transformerId": "gold-builder"}, "tenants": '),
            F.col("tenants"),
            F.lit(', "storage": ' + json.dumps({"contractRoot": root}) + ', "dataProducts": '),
            F.lit(_products(file)),
            F.lit(', "lifecycle": {"checked": {"correlationId": "corr-1"}}}'),
        ).alias("document"),
    )


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("o_custkey"), named("t", F.col("c_nationkey")).alias("tenant_id")
    )
    return table(spark, sf_dir, "orders").join(customers, "o_custkey")


def run(spark: SparkSession, sf_dir: str) -> Store:
    """Publish the silver table, then plan and run both products for every nation."""
    store = Store(spark, new_folder(spark, "fleet"))
    contract_folder = write_text(spark, CONTRACT, "contract")
    nations = table(spark, sf_dir, "nation").select(named("t", F.col("n_nationkey")).alias("tenant_id"))
    silver = _silver(spark, sf_dir)
    snapshot = store.write_snapshot(silver, SILVER)
    store.register(nations, SILVER, snapshot, CONTRACT)

    listings = table(spark, sf_dir, "supplier").select(
        named("t", F.col("s_nationkey")).alias("tenant_id"),
        F.lit("crm").alias("share_id"),
        F.lit(SILVER_KEY).alias("table_key"),
        F.lit(True).alias("is_list"),
        F.col("s_suppkey").cast("bigint").alias("ord"),
        F.lit(snapshot.location).alias("location"),
        F.when(F.col("s_acctbal") < 1000, F.lit("csv")).otherwise(F.lit("parquet")).alias("format"),
    )

    raw = nations.select(
        "tenant_id",
        F.lit("raw").alias("share_id"),
        F.lit(SILVER_KEY).alias("table_key"),
        F.lit(True).alias("is_list"),
        F.lit(0).cast("bigint").alias("ord"),
        F.lit(snapshot.location).alias("location"),
        F.lit("parquet").alias("format"),
    )
    run_fleet(
        store,
        launch(spark, sf_dir, contract_folder),
        listings.unionByName(raw),
        transform=lambda inputs, params: inputs[params["source"]],
    )
    return store


ORDERS_KEY, CUSTOMERS_KEY = SILVER_KEY, "silver:crm:Customers:1.0.0"
JOINED = Coordinates("gold", "sales", "CustomerOrders", "1.0.0")


def _entity(**elements: str) -> dict:
    return {"kind": "entity", "elements": {name: {"type": f"cds.{kind}"} for name, kind in elements.items()}}


def _one_launch(tenants: DataFrame, contract_folder: str, products: dict) -> DataFrame:
    """A launch document with the rows of ``tenants`` (a fixed list of nations) and these products."""
    root, _, file = contract_folder.rpartition("/")
    data = {
        name: {
            "coordinates": vars(coords),
            "metadata": {"contractFile": file},
            "transformers": [{"transformerName": "job", "parameters": [f"build={name}", *parameters]}],
            "inputPorts": [{"shareIds": shares}],
        }
        for name, (coords, parameters, shares) in products.items()
    }
    ids = F.map_from_entries(F.transform(F.collect_list("tenant_id"), lambda t: F.struct(t, F.create_map())))
    rest = {"transformer": {"transformerId": "job"}, "storage": {"contractRoot": root}, "dataProducts": data}
    document = F.concat(F.lit(json.dumps(rest)[:-1] + ', "tenants": '), F.to_json(ids.cast("map<string,map<string,string>>")), F.lit("}"))
    return tenants.agg(document.alias("document")).select(F.lit("launch").alias("launch_id"), "document")


def _listing(tenant, share: str, key: str, ord: int, location, fmt) -> F.Column:
    return F.struct(
        tenant.alias("tenant_id"),
        F.lit(share).alias("share_id"),
        F.lit(key).alias("table_key"),
        F.lit(True).alias("is_list"),
        F.lit(ord).cast("bigint").alias("ord"),
        location.alias("location"),
        fmt.alias("format"),
    )


def run_listed(spark: SparkSession, sf_dir: str) -> Store:
    """Inputs written by others: each tenant's own folder, some Parquet by status and some ORC, and a folder all tenants share."""
    store, outside = Store(spark, new_folder(spark, "fleet")), new_folder(spark, "outside")
    silver = _silver(spark, sf_dir).withColumnRenamed("tenant_id", "home")
    even = F.substring("home", 2, 9).cast("int") % 2 == 0
    silver.where(even).write.partitionBy("home", "o_orderstatus").parquet(f"{outside}/by status")
    silver.where(~even).write.partitionBy("home").orc(f"{outside}/plain")
    table(spark, sf_dir, "customer").write.parquet(f"{outside}/customers")

    tenant, even = F.col("tenant_id"), F.substring("tenant_id", 2, 9).cast("int") % 2 == 0
    folder = F.concat(F.when(even, F.lit(f"{outside}/by status/home=")).otherwise(F.lit(f"{outside}/plain/home=")), tenant)
    entries = F.array(
        _listing(tenant, "outside", ORDERS_KEY, 0, folder, F.when(even, F.lit("parquet")).otherwise(F.lit("orc"))),
        _listing(tenant, "outside", ORDERS_KEY, 1, F.lit(f"{outside}/not there"), F.lit("parquet")),
        _listing(tenant, "outside", CUSTOMERS_KEY, 0, F.lit(f"{outside}/customers/"), F.lit("parquet")),
    )
    tenants = silver.select(F.col("home").alias("tenant_id")).distinct()
    listings = tenants.select(F.inline(entries))
    contract = {"definitions": {"svc.CustomerOrders": _entity(o_orderkey="Integer64", o_custkey="Integer64", o_orderstatus="String", o_totalprice="Double", c_name="String")}}
    docs = _one_launch(
        tenants,
        write_text(spark, json.dumps(contract), "contract"),
        {"joined": (JOINED, [f"input_tables={ORDERS_KEY},{CUSTOMERS_KEY}"], ["outside"])},
    )

    def joined(inputs, params):
        customers = inputs[CUSTOMERS_KEY].select("tenant_id", F.col("c_custkey").alias("o_custkey"), "c_name")
        return inputs[ORDERS_KEY].join(customers, ["tenant_id", "o_custkey"])

    run_fleet(store, docs, listings, joined)
    return store


BOOK, TOTALS, TOP = (Coordinates("gold", "sales", n, "1.0.0") for n in ("Book", "Totals", "Top"))


def _key(coords: Coordinates) -> str:
    return ":".join(vars(coords).values())


def run_levels(spark: SparkSession, sf_dir: str) -> Store:
    """Products that read each other's tables, named against their order; two in a cycle, one behind a skipped one."""
    store, outside = Store(spark, new_folder(spark, "fleet")), new_folder(spark, "outside")
    _silver(spark, sf_dir).write.partitionBy("tenant_id").parquet(outside)
    tenants = spark.read.parquet(outside).select(F.col("tenant_id").cast("string").alias("tenant_id")).distinct()
    location = F.concat(F.lit(f"{outside}/tenant_id="), "tenant_id")
    listings = tenants.select(F.inline(F.array(_listing(F.col("tenant_id"), "s", SILVER_KEY, 0, location, F.lit("parquet")))))

    def other(name: str) -> Coordinates:
        return Coordinates("gold", "sales", name, "1.0.0")

    def needs(*keys: str) -> list[str]:
        return ["input_tables=" + ",".join(keys)]

    contract = {"definitions": {
        "svc.Book": _entity(o_orderkey="Integer64", o_custkey="Integer64", o_totalprice="Double"),
        "svc.Totals": _entity(o_custkey="Integer64", n="Integer64", most="Double"),
        "svc.Top": _entity(o_orderkey="Integer64", o_custkey="Integer64", n="Integer64"),
    }}
    products = {
        "a_top": (TOP, needs(_key(BOOK), _key(TOTALS)), []),
        "b_totals": (TOTALS, needs(_key(BOOK)), []),
        "c_book": (BOOK, needs(SILVER_KEY), ["s"]),
        "x": (other("X"), needs(_key(other("Y"))), []),
        "y": (other("Y"), needs(_key(other("X")), SILVER_KEY), ["s"]),
        "v": (other("V"), needs(_key(other("W"))), []),
        "w": (other("W"), needs("silver:sales:Nowhere:1.0.0"), ["s"]),
    }
    docs = _one_launch(tenants, write_text(spark, json.dumps(contract), "contract"), products)

    def build(inputs, params):
        if params["build"] == "c_book":
            return inputs[SILVER_KEY]
        book = inputs[_key(BOOK)]
        if params["build"] == "b_totals":
            return book.groupBy("tenant_id", "o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))
        both = book.join(inputs[_key(TOTALS)], ["tenant_id", "o_custkey"])
        return both.where(F.col("o_totalprice") == F.col("most"))

    run_fleet(store, docs, listings, build, parallel=2)
    return store
