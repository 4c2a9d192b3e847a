"""Reading tables by location, with the row count taken on the way."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DEFAULT_FORMAT = "parquet"


def load_table(
    spark: SparkSession,
    locations: str | Iterable[str],
    fmt: str = DEFAULT_FORMAT,
    schema: StructType | None = None,
) -> DataFrame:
    """Lazy scan of one location, or of many in one scan."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(locations if isinstance(locations, str) else list(locations))


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """Attach a row count that is filled by whatever action runs ``df`` anyway.

    ``observation.get["n"]`` holds it after that action; no separate count job.
    """
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("n")), observation
