import duckdb
import pytest
from cases import AWKWARD, CLASHES, SMALL
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def embeddings(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet")


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, source string")
    df = df.withColumns({"lang": F.lit(None).cast("string"), "n_chars": F.length("text")})
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        con.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con
