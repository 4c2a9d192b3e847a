"""Tables at listed locations, read for all tenants in one scan a format.

A listing gives a folder to a tenant. The folders of all tenants are read together, and each file is
given to its tenants by a join on its folder: the folder that was listed, or one below it
that is named as a partition (``name=value``). So several tenants may be listed with
the same folder, and each gets all its rows; a folder that is itself partitioned by ``tenant_id``, as a
``Store`` writes it, gives each tenant its own partition and keeps its reject side out.

Spark keeps the files of a scan on the driver, so the distinct folders come there too; nothing else does.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetgold.operators.skew import BROADCAST_ROW_LIMIT, broadcast_checked, lookup_join
from fleetgold.sources.shared import checkpointed

#: Formats whose folders one scan can hold; any other format is read one folder at a time.
FOLDER_FORMATS = ("orc", "parquet")
FOLDER = "fg_folder"
TENANT = "tenant_id"
#: A run of partition folders at a path's end.
PARTITIONS = r"((?:/[^/=]+=[^/]*)*)$"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def default_root(spark: SparkSession) -> str:
    """Scheme and host that a path without them has."""
    conf = spark._jsc.hadoopConfiguration()
    uri = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf)
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}"


def normal_path(path: Column, default: str) -> Column:
    """One spelling of a path: with scheme and host, single slashes, none at the end."""
    path = F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), path).otherwise(F.concat(F.lit(default), path))
    root = F.regexp_replace(F.regexp_extract(path, "^([^:]+:(?://[^/]*)?)", 1), "//$", "")
    own = default.split("//")[0]
    root = F.when(root == own, F.lit(default.removesuffix("//"))).otherwise(root)
    rest = F.regexp_replace(F.regexp_extract(path, "^[^:]+:(?://[^/]*)?(.*)$", 1), "/{2,}", "/")
    return F.concat(root, F.regexp_replace(rest, "/$", ""))


def unescaped(path: Column) -> Column:
    """A scan's own spelling of a path, without percent signs for special characters."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _folder_of(frame: DataFrame) -> Column:
    """The folder of a row's file, in the scan's own spelling."""
    meta = frame.metadataColumn("_metadata")
    whole = meta["file_path"]
    return F.regexp_replace(whole, "/[^/]*$", "")


def _folders_of_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The distinct folders that hold files below ``paths``; files are listed, none is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return files.select(_folder_of(files).alias(FOLDER)).distinct()


def owners(folders: DataFrame, listed: DataFrame, root: str) -> DataFrame:
    """Which tenants each folder's files belong to: ``fg_folder``, ``tenant_id``, ``partitions`` (names below the listed folder).

    ``folders`` has ``fg_folder``; ``listed`` has ``tenant_id`` and ``location``.
    """
    path = normal_path(unescaped(F.col(FOLDER)), root)
    parts, depth = F.split(path, "/"), F.size(F.split(F.regexp_extract(path, PARTITIONS, 1), "/")) - 1
    above = F.transform(
        F.sequence(F.lit(0), depth),
        lambda k: F.struct(
            F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/").alias("location"),
            F.concat(F.lit("/"), F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "/")).alias("below"),
        ),
    )
    candidates = folders.select(FOLDER, F.explode(above).alias("at")).select(FOLDER, "at.location", "at.below")
    places = listed.select(TENANT, normal_path(F.col("location"), root).alias("location")).distinct()
    own = unescaped(F.nullif(F.regexp_extract("below", f"/{TENANT}=([^/]*)", 1), F.lit("")))
    names = F.regexp_extract_all("below", F.lit("/([^/=]+)="), F.lit(1))
    return (
        candidates.join(places, "location")
        .where(own.isNull() | (own == F.col(TENANT)))
        .where(~F.col("below").contains("/fg_rejected=true"))
        .select(FOLDER, TENANT, names.alias("partitions"))
    )


def _one_by_one(reader, fmt: str, listed: DataFrame, paths: Sequence[str]) -> DataFrame:
    place = listed.select(TENANT, F.col("location").alias(FOLDER)).distinct()
    scans = [reader.load(p).withColumn(FOLDER, F.lit(p)) for p in paths]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    return lookup_join(rows.drop(TENANT), broadcast_checked(place), [FOLDER], "inner").drop(FOLDER)


def _scan(
    spark: SparkSession, fmt: str, listed: DataFrame, paths: Sequence[str], schema: StructType | None
) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt not in FOLDER_FORMATS:
        return _one_by_one(reader, fmt, listed, paths)
    mine = checkpointed(owners(_folders_of_files(spark, paths), listed, default_root(spark)))
    # A folder can be listed twice over, as a partition of another one: the rows go to the tenant once.
    places = mine.select(FOLDER, TENANT).distinct()
    found = mine.agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_set("partitions"))).alias("names")).first()
    names = sorted(n for n in found["names"] if n != TENANT and not n.startswith("fg_"))
    if found["n"] <= BROADCAST_ROW_LIMIT:
        places = F.broadcast(places)
    if schema is None:
        reader = reader.option("mergeSchema", "true")
    rows = reader.option("recursiveFileLookup", "true").load(list(paths))
    own = [c for c in rows.columns if c != TENANT]
    rows = rows.select(*[F.col(f"`{c}`") for c in own], _folder_of(rows).alias(FOLDER))
    types = {f.name: f.dataType for f in schema.fields} if schema is not None else {}
    for name in names:
        text = F.regexp_extract(FOLDER, f"/{re.escape(name)}=([^/]*)(?:/|$)", 1)
        # The scan's spelling escapes what the folder's name had escaped already.
        value = F.nullif(F.nullif(unescaped(unescaped(text)), F.lit(NO_VALUE)), F.lit(""))
        rows = rows.withColumn(name, value.cast(types.get(name, "string")))
    return lookup_join(rows, places, [FOLDER], "inner").drop(FOLDER)


def listed_table(spark: SparkSession, listed: DataFrame, schema: StructType | None = None) -> DataFrame:
    """The rows behind ``listed`` (``tenant_id``, ``location``, ``format``), each with its ``tenant_id``.

    A ``tenant_id`` column of the files gives way to the listing's. Partition folders become
    columns: of the schema's type if a schema is given, else texts. Without a schema the files' columns are merged.
    A listed folder that does not exist fails the read, and so does an empty listing without a schema.
    """
    listed = listed.select(TENANT, "location", "format").distinct()
    paths: dict[str, list[str]] = {}
    for fmt, location in listed.select(F.coalesce("format", F.lit("")), "location").distinct().collect():
        paths.setdefault(fmt, []).append(location)
    if not paths:
        if schema is None:
            raise KeyError("no location is listed")
        fields = [f for f in schema.fields if f.name != TENANT]
        return spark.createDataFrame([], StructType(fields).add(TENANT, "string"))
    scans = [
        _scan(spark, f, listed.where(F.coalesce("format", F.lit("")) == f), sorted(paths[f]), schema) for f in sorted(paths)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
