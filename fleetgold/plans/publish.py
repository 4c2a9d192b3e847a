"""Run a product for all its ready tenants, publish the result, record the status."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import reduce
from graphlib import TopologicalSorter
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetgold.functions.address import clean_version, layer_or_default
from fleetgold.functions.params import as_map, change_feed_flag, good_entries, last_value
from fleetgold.operators.compatibility import contract_diff
from fleetgold.operators.conform import conform, conform_marked
from fleetgold.operators.shares import READABLE_FORMATS, RUN_KEYS, visible_tables
from fleetgold.operators.skew import broadcast_checked
from fleetgold.plans.runplan import FAULTY, RUNNABLE, run_plan
from fleetgold.plans.status import ACTIVE, ERROR, FAILED, INFO, NOT_STARTED, SUCCESS, status_rows
from fleetgold.plans.store import Coordinates, Snapshot, Store
from fleetgold.sources.contracts import find_entity, read_contracts
from fleetgold.sources.launch import linked_products
from fleetgold.sources.listed import listed_table

Inputs = Mapping[str, DataFrame]
Transform = Callable[[Inputs, Mapping[str, str]], DataFrame]


@dataclass(frozen=True, eq=False)
class Product:
    """What one product job needs to know. Holds names and settings, no data."""

    launch_id: str
    product_id: str
    coordinates: Coordinates
    contract_file: str
    change_feed: bool
    params: Mapping[str, str] = field(default_factory=dict)
    producers: tuple[str, ...] = ()
    made_inside: tuple[str, ...] = ()

    @property
    def input_tables(self) -> list[str]:
        return [t for t in self.params.get("input_tables", "").split(",") if t]


def project_contract(df: DataFrame, schema: StructType) -> DataFrame:
    """The contract's columns in order; Parquet scans read only these."""
    return df.select(*[F.col(f"`{f.name}`") for f in schema.fields])


def published_table(store: Store, key: str, ready: DataFrame) -> DataFrame:
    """Current rows of a table of this store, for ready tenants only."""
    tenants = broadcast_checked(ready.select("tenant_id"))
    return store.read(Coordinates.of_key(key)).join(tenants, "tenant_id", "left_semi")


def load_published(store: Store, product: Product, ready: DataFrame) -> Inputs:
    """The product's input tables as this store published them, wherever the shares point."""
    return {key: published_table(store, key, ready) for key in product.input_tables}


class ListedInputs(Mapping):
    """All tables that the ready tenants' shares bring, by table key; a table is scanned when it is asked for.

    ``tables`` has ``tenant_id``, ``table_key``, ``location`` and ``format``, one row for each table a
    tenant sees. A table that another product of the launch makes is read from the store.
    """

    def __init__(self, store: Store, product: Product, ready: DataFrame, tables: DataFrame):
        self._store, self._product, self._ready, self._tables = store, product, ready, tables
        self._names: list[str] | None = None

    def _keys(self) -> list[str]:
        if self._names is None:
            listed = self._tables.select("table_key").distinct().collect()  # names of one product's tables
            self._names = sorted({r[0] for r in listed}.union(self._product.made_inside))
        return self._names

    def __iter__(self) -> Iterator[str]:
        return iter(self._keys())

    def __len__(self) -> int:
        return len(self._keys())

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self._keys():
            raise KeyError(f"no share of {self._product.product_id} brings {key!r}")
        if key in self._product.made_inside:
            return published_table(self._store, key, self._ready)
        return listed_table(self._store.spark, self._tables.where(F.col("table_key") == key))


def breaking_changes(store: Store, product: Product, contract: str, entity: str) -> list[tuple[str, str]]:
    """(column, change) where this contract breaks the one that the product's table is registered with."""
    before = store.contract_of(product.coordinates)
    if before in ("", contract):
        return []
    old, new = (store.spark.range(1).select(F.lit(text).alias("contract")) for text in (before, contract))
    found = contract_diff(old, new).where("breaking").where(F.col("entity") == entity)
    return sorted((r["column_name"], r["change"]) for r in found.collect())  # columns of one entity


def publish_standard(
    store: Store,
    product: Product,
    result: DataFrame,
    ready: DataFrame,
    keep_rejects: bool = False,
    allow_breaking: bool = False,
) -> Snapshot:
    """Fit to the contract, write one snapshot for all ready tenants, register it.

    A contract that breaks the one registered before (narrower types, columns that are now required) is refused, as other
    tenants' rows are read by the newest contract and might not fit it; ``allow_breaking`` lets it pass.

    A ready tenant without rows is registered too: its table is now empty. With
    ``keep_rejects`` rows that do not fit go to the snapshot's reject side in
    the same write; otherwise the first such row fails the job.
    """
    entity = find_entity(read_contracts(store.spark, product.contract_file), product.coordinates.name)
    broken = [] if allow_breaking else breaking_changes(store, product, entity.contract, entity.name)
    if broken:
        raise ValueError(f"the contract of {product.product_id} breaks the registered one: {broken}")
    fit = conform_marked if keep_rejects else conform
    snapshot = store.write_snapshot(
        fit(result, entity.schema, carry=["tenant_id"]), product.coordinates, marked=keep_rejects
    )
    store.register(ready, product.coordinates, snapshot, entity.contract, product.change_feed)
    return snapshot


def run_product(
    store: Store,
    product: Product,
    ready: DataFrame,
    transform: Transform,
    load: Callable[[Store, Product, DataFrame], Inputs] = load_published,
    publish: Callable[[Store, Product, DataFrame, DataFrame], Any] = publish_standard,
) -> Any:
    """One Spark job for one product and all its ready tenants.

    ``ready`` holds run rows: "active" from now on. Any error is recorded for each of them and raised.
    """
    store.append_statuses(status_rows(ready, ACTIVE, INFO, store.next_status()))
    try:
        done = publish(store, product, transform(load(store, product, ready), product.params), ready)
    except Exception:
        store.append_statuses(status_rows(ready, FAILED, ERROR, store.next_status()))
        raise
    store.append_statuses(status_rows(ready, SUCCESS, INFO, store.next_status()))
    return done


def product_headers(products: DataFrame, plan: DataFrame) -> list[Product]:
    """Products with at least one ready tenant: one small row each, no table data."""
    ready = plan.where(F.col("state").isin(*RUNNABLE)).select("launch_id", "product_id")
    rows = products.join(ready, ["launch_id", "product_id"], "left_semi").select(
        "launch_id",
        "product_id",
        F.col("coordinates")
        .withField("layer", layer_or_default(F.col("coordinates.layer")))
        .withField("version", clean_version(F.col("coordinates.version")))
        .alias("coordinates"),
        "contract_file",
        change_feed_flag(last_value(F.col("params"), "enable_cdf")).alias("change_feed"),
        as_map(good_entries(F.col("params"))).alias("params"),
        "producers",
        "made_inside",
    )
    return sorted(
        (
            Product(
                r["launch_id"],
                r["product_id"],
                Coordinates(**r["coordinates"].asDict()),
                r["contract_file"],
                r["change_feed"],
                r["params"],
                tuple(r["producers"]),
                tuple(r["made_inside"]),
            )
            for r in rows.collect()
        ),
        key=lambda p: (p.launch_id, p.product_id),
    )


def product_order(headers: Sequence[Product]) -> dict[Product, set[Product]]:
    """What has to be done before each product: its producers, and earlier products that publish the same table."""
    by_id = {(p.launch_id, p.product_id): p for p in headers}
    before: dict[Product, set[Product]] = {}
    last: dict[Coordinates, Product] = {}
    makers = {
        p: {by_id[p.launch_id, m] for m in p.producers if (p.launch_id, m) in by_id} for p in headers
    }
    for p in TopologicalSorter(makers).static_order():
        before[p] = set(makers[p])
        if p.coordinates in last:
            before[p].add(last[p.coordinates])
        last[p.coordinates] = p
    return before


def in_order(
    before: Mapping[Product, set[Product]], job: Callable[[Product], Any], parallel: int
) -> tuple[dict[Product, Any], list[Product], BaseException | None]:
    """Run ``job`` for all products, at most ``parallel`` at once, each after what is ``before`` it.

    After a failure nothing new starts. Gives results, products not started, and the first error.
    """
    todo = TopologicalSorter(before)
    todo.prepare()
    waiting: list[Product] = []
    running: dict[Future, Product] = {}
    done: dict[Product, Any] = {}
    started: set[Product] = set()
    error: BaseException | None = None
    with ThreadPoolExecutor(parallel) as pool:
        while todo.is_active():
            waiting = sorted([*waiting, *todo.get_ready()], key=lambda p: (p.launch_id, p.product_id))
            while waiting and len(running) < parallel and error is None:
                product = waiting.pop(0)
                started.add(product)
                running[pool.submit(job, product)] = product
            if not running:
                break
            for future in wait(running, return_when=FIRST_COMPLETED).done:
                product = running.pop(future)
                if future.exception() is None:
                    done[product] = future.result()
                    todo.done(product)
                else:
                    error = error or future.exception()
    return done, [p for p in before if p not in started], error


def run_fleet(
    store: Store,
    docs: DataFrame,
    listings: DataFrame,
    transform: Transform,
    strict: bool = False,
    readable: Sequence[str] = READABLE_FORMATS,
    load: Callable[[Store, Product, DataFrame], Inputs] | None = None,
    publish: Callable[[Store, Product, DataFrame, DataFrame], Any] = publish_standard,
    parallel: int = 4,
) -> dict[tuple[str, str], Any]:
    """Plan all tenants and products of the launch documents, then run each product.

    The plan is computed once and written, so later jobs read it instead of
    computing it again and a lost executor costs nothing but a re-read. Runs that
    are not ready get their state as status. ``strict`` fails on faulty products.

    A product's inputs are the tables at the first location of each merged list of its
    tenants' shares (``ListedInputs``), unless ``load`` says otherwise. A product whose inputs other products of the launch
    make runs after them; up to ``parallel`` products run at once, each in a scheduler pool of its own, so with the
    fair scheduler (``spark.scheduler.mode``) none starves. When one fails, those running end,
    the ready runs of all others get ``NOT_STARTED``, and the error is raised.
    """
    spark = store.spark
    products = linked_products(docs)
    path = f"{store.root}/plans/{time.time_ns():020d}"
    planned = run_plan(products, listings, readable, ["share_ids"])
    # Sorted by product, so that each product's job opens only the files with its runs.
    by_product = ["launch_id", "product_id", "tenant_id"]

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.repartitionByRange(*by_product).sortWithinPartitions(*by_product).write.parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    plan = kept(planned, "runs")
    faulty = F.col("state").isin(*FAULTY)
    runnable = F.col("state").isin(*RUNNABLE)
    now = store.next_status()
    store.append_statuses(
        status_rows(plan.where(~runnable & ~faulty), F.col("state"), INFO, now).unionByName(
            status_rows(plan.where(faulty), F.col("state"), ERROR, now)
        )
    )
    if strict and not plan.where(faulty).isEmpty():
        raise ValueError(f"faulty products in the plan at {path}")

    def of(product: Product) -> Any:
        return (F.col("launch_id") == product.launch_id) & (F.col("product_id") == product.product_id)

    def ready_runs(product: Product) -> DataFrame:
        return plan.where(of(product) & runnable).select(*RUN_KEYS, "correlation_id")

    if load is None:
        tables = kept(visible_tables(plan.where(runnable), listings), "tables")

        def load(store: Store, product: Product, ready: DataFrame) -> Inputs:
            return ListedInputs(store, product, ready, tables.where(of(product)))

    @inheritable_thread_target(spark)
    def job(product: Product) -> Any:
        context = spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", f"{product.launch_id}/{product.product_id}")
        context.setJobGroup(f"{product.launch_id}/{product.product_id}", "fleet product", False)
        return run_product(store, product, ready_runs(product), transform, load, publish)

    before = product_order(product_headers(products, plan))
    done, left, error = in_order(before, job, parallel)
    if error is not None:
        if left:
            rows = reduce(DataFrame.unionByName, map(ready_runs, left))
            store.append_statuses(status_rows(rows, NOT_STARTED, INFO, store.next_status()))
        raise error
    return {(p.launch_id, p.product_id): result for p, result in done.items()}
