"""Contract documents: JSON text with ``definitions`` (entities) and ``meta``.

Documents are rows, so any number of them is parsed in one job. All steps are
narrow; a document's entities and elements stay inside its row until exploded.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from fleetgold.functions.rows import each
from fleetgold.functions.types import spark_type

# A map-typed schema: entity and element names are data, not columns.
CONTRACT_SCHEMA = (
    "definitions map<string, struct<kind: string, elements: map<string, "
    "struct<type: string, length: int, precision: int, scale: int, notNull: boolean>>>>"
)
# The same documents once more, with every value of an entity left as text.
ANNOTATION_SCHEMA = "definitions map<string, map<string, string>>, meta map<string, string>"
STRUCTURAL_KEYS = ["kind", "elements"]


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Files to rows ``(contract_file, contract)``, one whole document per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("contract_file"), F.col("value").alias("contract")
    )


def _parsed(contract: Column) -> Column:
    return F.from_json(contract, CONTRACT_SCHEMA, {"mode": "FAILFAST"})


def contract_columns(docs: DataFrame, contract: str = "contract") -> DataFrame:
    """One row per document, entity and element, in document order."""
    keep = [c for c in docs.columns if c != contract]
    entities = each(docs, keep, _parsed(F.col(contract))["definitions"], ["entity", "definition"])
    elements = each(
        entities, [*keep, "entity"], "definition.elements", ["column_name", "element"], pos="pos"
    )
    return elements.select(
        *keep,
        "entity",
        "pos",
        "column_name",
        spark_type(
            F.col("element.type"), F.col("element.precision"), F.col("element.scale")
        ).alias("type"),
        (~F.coalesce(F.col("element.notNull"), F.lit(False))).alias("nullable"),
    )


def _annotation_groups(contract: Column) -> Column:
    """Per entity the entries that are not structure; document meta under a null entity."""
    parsed = F.from_json(contract, ANNOTATION_SCHEMA, {"mode": "FAILFAST"})
    no_entities = F.create_map().cast("map<string, map<string, string>>")
    no_entries = F.create_map().cast("map<string, string>")
    of_entities = F.transform(
        F.map_entries(F.coalesce(parsed["definitions"], no_entities)),
        lambda e: F.struct(
            e["key"].alias("entity"),
            F.map_filter(e["value"], lambda k, v: ~k.isin(STRUCTURAL_KEYS)).alias("entries"),
        ),
    )
    of_document = F.struct(
        F.lit(None).cast("string").alias("entity"), F.coalesce(parsed["meta"], no_entries).alias("entries")
    )
    return F.concat(of_entities, F.array(of_document))


def contract_annotations(docs: DataFrame, contract: str = "contract") -> DataFrame:
    """Entity annotations, and document meta under a null entity, as name and value."""
    keep = [c for c in docs.columns if c != contract]
    by_entity = each(docs, keep, _annotation_groups(F.col(contract)), ["g"])
    return each(by_entity, [*keep, "g.entity"], "g.entries", ["name", "value"])


def match_entity(docs: DataFrame, name: str = "name", contract: str = "contract") -> DataFrame:
    """Add the entity a product name selects: ``entity`` and ``entity_match``.

    An exact name wins; otherwise the last dotted part must equal the name for
    exactly one entity. ``entity_match`` is ``ONE``, ``NONE`` or ``SEVERAL``.
    """
    names = F.map_keys(_parsed(F.col(contract))["definitions"])
    wanted = F.col(name)
    return (
        docs.withColumn("_names", F.coalesce(names, F.array().cast("array<string>")))
        .withColumn("_exact", F.filter("_names", lambda n: n == wanted))
        .withColumn("_last", F.filter("_names", lambda n: F.substring_index(n, ".", -1) == wanted))
        .withColumn(
            "entity",
            F.when(F.size("_exact") > 0, F.col("_exact")[0]).when(
                F.size("_last") == 1, F.col("_last")[0]
            ),
        )
        .withColumn(
            "entity_match",
            F.when(F.col("entity").isNotNull(), F.lit("ONE"))
            .when(F.size("_last") == 0, F.lit("NONE"))
            .otherwise(F.lit("SEVERAL")),
        )
        .drop("_names", "_exact", "_last")
    )


@dataclass(frozen=True)
class Entity:
    """A contract's matched entity; plan metadata, no table data."""

    name: str
    schema: StructType
    contract: str


def find_entity(docs: DataFrame, name: str, contract: str = "contract") -> Entity:
    """The entity ``name`` selects in the one document in ``docs``, with its schema.

    One small job: what comes to the driver is the document and the column list
    of one entity. Entity annotations and document meta go to the field metadata.
    """
    one = docs.select(F.col(contract).alias("contract"), F.lit(name).alias("name"))
    matched = match_entity(one.where(F.col("contract") != ""))
    element = _parsed(F.col("contract"))["definitions"][F.col("entity")]["elements"]
    columns = F.transform(
        F.map_entries(element),
        lambda e: F.struct(
            e["key"].alias("name"),
            spark_type(e["value"]["type"], e["value"]["precision"], e["value"]["scale"]).alias("type"),
            F.coalesce(e["value"]["notNull"], F.lit(False)).alias("required"),
        ),
    )
    notes = F.filter(
        _annotation_groups(F.col("contract")),
        lambda g: g["entity"].isNull() | (g["entity"] == F.col("entity")),
    )
    rows = matched.select(
        "contract",
        "entity",
        "entity_match",
        F.when(F.col("entity").isNotNull(), columns).alias("columns"),
        notes.alias("notes"),
    ).head(2)
    if len(rows) != 1:
        raise KeyError(f"one contract document is needed for {name!r}, found {len(rows)}")
    row = rows[0]
    if row["entity_match"] != "ONE":
        raise KeyError(f"{row['entity_match']} entity for {name!r} in the contract")
    metadata = {"entity": row["entity"]}
    for group in row["notes"]:
        part = "meta" if group["entity"] is None else "annotations"
        metadata[part] = json.dumps(group["entries"], sort_keys=True)
    types = StructType.fromDDL(", ".join(f"c{i} {c['type']}" for i, c in enumerate(row["columns"])))
    schema = StructType(
        [
            StructField(c["name"], f.dataType, not c["required"], metadata)
            for c, f in zip(row["columns"], types.fields)
        ]
    )
    return Entity(row["entity"], schema, row["contract"])
