import json

import pytest
from helpers import rows
from fleetgold.sources import contracts
from pyspark.sql import functions as F

DOC = {
    "definitions": {
        "svc.Order": {
            "kind": "entity",
            "@title": "Orders",
            "elements": {
                "id": {"type": "cds.Integer64", "notNull": True},
                "price": {"type": "cds.Decimal", "precision": 9, "scale": 3},
                "day": {"type": "cds.Date"},
            },
        },
        "svc.Part": {"kind": "entity", "elements": {"id": {"type": "cds.UUID"}}},
        "old.Part": {"kind": "entity", "elements": {"id": {"type": "cds.UUID"}}},
        "Part.Extra": {"kind": "entity", "elements": {}},
    },
    "meta": {"creator": "me", "flavour": {"nested": 1}},
}


def docs(spark, *contents):
    return spark.createDataFrame([(json.dumps(c),) for c in contents], "contract string")


def test_entity_with_annotations(spark):
    found = contracts.find_entity(docs(spark, DOC), "Order")
    assert found.name == "svc.Order"
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in found.schema] == [
        ("id", "bigint", False),
        ("price", "decimal(9,3)", True),
        ("day", "date", True),
    ]
    metadata = found.schema["id"].metadata
    assert json.loads(metadata["annotations"]) == {"@title": "Orders"}
    assert json.loads(metadata["meta"]) == {"creator": "me", "flavour": '{"nested":1}'}


@pytest.mark.parametrize("name, entity", [("svc.Part", "svc.Part"), ("Extra", "Part.Extra")])
def test_exact_name_or_last_part(spark, name, entity):
    assert contracts.find_entity(docs(spark, DOC), name).name == entity


@pytest.mark.parametrize("name, reason", [("Part", "SEVERAL"), ("Orders", "NONE"), ("order", "NONE")])
def test_no_single_entity(spark, name, reason):
    with pytest.raises(KeyError, match=reason):
        contracts.find_entity(docs(spark, DOC), name)


def test_needs_one_document(spark):
    with pytest.raises(KeyError):
        contracts.find_entity(docs(spark, DOC, DOC), "Order")
    with pytest.raises(KeyError):
        contracts.find_entity(docs(spark), "Order")


def test_malformed_document_fails(spark):
    bad = spark.createDataFrame([("{not json",)], "contract string")
    with pytest.raises(Exception, match="(?i)malformed"):
        contracts.contract_columns(bad).collect()


def test_many_files_in_one_read(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"c{i}.json").write_text(json.dumps(DOC, indent=2))
    read = contracts.read_contracts(spark, str(tmp_path))
    columns = contracts.contract_columns(read)
    assert columns.where(F.col("entity") == "svc.Order").count() == 9
    assert rows(columns.where(F.col("contract_file") == "c1.json"), "entity", "pos", "column_name")[-1] == (
        "svc.Part",
        0,
        "id",
    )
