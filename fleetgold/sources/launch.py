"""Launch documents: which products run for which tenants, and with what.

One JSON document per launch row. Sections nobody reads later (datasets, data
sources, shares) are not in the schema, so they are skipped while parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgold.functions.address import clean_version, layer_or_default, table_key
from fleetgold.functions.params import bad_entries, expected_tables, last_value, matching_params
from fleetgold.functions.rows import each

LAUNCH_SCHEMA = (
    "transformer struct<transformerId: string>, "
    "tenants map<string, map<string, string>>, "
    "storage struct<contractRoot: string>, "
    "dataProducts map<string, struct<"
    "coordinates: struct<layer: string, namespace: string, version: string, name: string>, "
    "metadata: struct<contractFile: string>, "
    "transformers: array<struct<transformerName: string, parameters: array<string>>>, "
    "inputPorts: array<struct<name: string, shareIds: array<string>>>>>, "
    "lifecycle map<string, struct<correlationId: string>>"
)


def _made_and_needed(products: Column, transformer_id: Column) -> Column:
    """Per product of a launch: its id, the key of the table it makes, the keys it needs."""

    def one(entry: Column) -> Column:
        p = entry["value"]
        c = p["coordinates"]
        made = table_key(layer_or_default(c["layer"]), c["namespace"], c["name"], clean_version(c["version"]))
        needed = expected_tables(last_value(matching_params(p["transformers"], transformer_id), "input_tables"))
        return F.struct(entry["key"].alias("product_id"), made.alias("made"), needed.alias("needed"))

    return F.transform(F.map_entries(products), one)


def _links(nodes: Column) -> Column:
    """Per product, the products that make what it needs: ids, keys, and places in the list.

    A product that needs its own table reads the one that is there, so that is no link.
    """

    def one(node: Column) -> Column:
        makers = F.filter(
            F.transform(nodes, lambda other, at: F.struct(other["product_id"].alias("id"), other["made"].alias("key"), at.alias("at"))),
            lambda m: (m["id"] != node["product_id"])
            & F.coalesce(F.array_contains(node["needed"], m["key"]), F.lit(False)),
        )
        own = F.coalesce(F.array_contains(node["needed"], node["made"]), F.lit(False))
        return F.struct(
            node["product_id"].alias("product_id"),
            F.transform(makers, lambda m: m["id"]).alias("producers"),
            F.filter(F.transform(makers, lambda m: m["key"]), lambda k: ~(own & (k == node["made"]))).alias("made_inside"),
            F.transform(makers, lambda m: m["at"]).alias("places"),
        )

    return F.transform(nodes, one)


def _levels(links: Column) -> Column:
    """Longest chain of producers before each product; a product in or behind a cycle reaches the number of products."""
    start = F.transform(links, lambda n: F.lit(0))

    def step(levels: Column, _: Column) -> Column:
        return F.transform(
            links,
            lambda n: F.coalesce(
                F.array_max(F.transform(n["places"], lambda at: F.element_at(levels, at + 1))) + 1, F.lit(0)
            ),
        )

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(links), F.lit(1))), start, step)


def _sections(docs: DataFrame, document: str) -> DataFrame:
    """The launch documents, parsed once; their products still a map."""
    parsed = docs.withColumn("d", F.from_json(document, LAUNCH_SCHEMA, {"mode": "FAILFAST"})).drop(document)
    return parsed.select(
        *[c for c in docs.columns if c != document],
        F.col("d.transformer.transformerId").alias("transformer_id"),
        F.col("d.storage.contractRoot").alias("contract_root"),
        F.map_keys("d.tenants").alias("tenants"),
        F.col("d.lifecycle").alias("lifecycle"),
        F.col("d.dataProducts").alias("data_products"),
    )


def _product_columns(products: DataFrame, keep: list[str], *more: Column | str) -> DataFrame:
    """Columns of a product from its id and its part ``p`` of the document."""
    ports = F.coalesce(
        F.col("p.inputPorts"), F.array().cast("array<struct<name:string,shareIds:array<string>>>")
    )
    return products.select(
        *keep,
        "product_id",
        "transformer_id",
        F.try_element_at("lifecycle", F.col("product_id"))["correlationId"].alias("correlation_id"),
        F.col("p.coordinates").alias("coordinates"),
        F.concat_ws("/", "contract_root", "p.metadata.contractFile").alias("contract_file"),
        matching_params(F.col("p.transformers"), F.col("transformer_id")).alias("params"),
        F.flatten(
            F.transform(ports, lambda i: F.coalesce(i["shareIds"], F.array().cast("array<string>")))
        ).alias("share_ids"),
        "tenants",
        *more,
    ).withColumn("bad_params", bad_entries(F.col("params")))


def launch_products(docs: DataFrame, document: str = "document") -> DataFrame:
    """One row per launch and product, still with the launch's tenants as an array.

    Parameters are matched and checked here, once per product, before tenants
    multiply the rows.
    """
    sections = _sections(docs, document)
    others = [c for c in sections.columns if c != "data_products"]
    products = each(sections, others, "data_products", ["product_id", "p"])
    return _product_columns(products, [c for c in docs.columns if c != document])


def linked_products(docs: DataFrame, document: str = "document") -> DataFrame:
    """``launch_products`` with the order that the tables they make for each other ask for.

    Further columns: ``level`` (longest chain of products before it), ``in_cycle`` (in a cycle or behind
    one; ``level`` is null then), ``producers`` (ids), ``made_inside`` (keys of needed tables that they make) and
    ``launch_linked`` (some product of the launch needs another). The products of a launch are one
    document row, so the order is worked out inside that row.
    """
    sections = _sections(docs, document)
    others = [c for c in sections.columns if c != "data_products"]
    nodes = sections.withColumn("_nodes", _made_and_needed(F.col("data_products"), F.col("transformer_id")))
    links = nodes.withColumn("_links", _links(F.col("_nodes")))
    ordered = links.withColumn("_levels", _levels(F.col("_links")))
    level = lambda at: F.element_at("_levels", at + 1)
    entry = F.transform(
        F.map_entries("data_products"),
        lambda e, at: F.struct(
            e["key"].alias("product_id"),
            e["value"].alias("p"),
            F.element_at("_links", at + 1).alias("link"),
            F.when(level(at) < F.size("_levels"), level(at)).alias("level"),
        ),
    )
    linked = F.exists("_links", lambda n: F.size(n["producers"]) > 0)
    rows = each(ordered.withColumn("launch_linked", linked), [*others, "launch_linked"], entry, ["_e"])
    products = rows.select(*others, "launch_linked", "_e.product_id", "_e.p", "_e.link", "_e.level")
    return _product_columns(
        products,
        [c for c in docs.columns if c != document],
        "level",
        F.col("level").isNull().alias("in_cycle"),
        F.col("link.producers").alias("producers"),
        F.col("link.made_inside").alias("made_inside"),
        "launch_linked",
    )


def product_shares(products: DataFrame) -> DataFrame:
    """One row per share id of all input ports; ``port_ord`` counts from 1."""
    keep = [c for c in ("launch_id", "product_id") if c in products.columns]
    return each(products, keep, "share_ids", ["share_id"], pos="_at").select(
        *keep, (F.col("_at") + 1).alias("port_ord"), "share_id"
    )


def launch_runs(products: DataFrame) -> DataFrame:
    """One row per tenant and product of each launch.

    Tenants are listed in the launch document, so this is an explode inside
    the row and not a join. One document can name many products and tenants, so
    its products are spread over tasks before tenants multiply them.
    """
    rest = [c for c in products.columns if c != "tenants"]
    return each(products.repartition("launch_id", "product_id"), rest, "tenants", ["tenant_id"])
