"""Published tables: snapshot folders, and a registry that says which one counts.

A table's files are below ``root/tables/<layer>/<version>/<namespace>/<name>/``
as ``fg_snapshot=<id>/fg_rejected=<bool>/tenant_id=<id>``. Writing a snapshot changes
nothing for readers; appending its registry rows does. So a table can be
rewritten from its own current state, and a failed job leaves the old state.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, MapType, StringType, StructField, StructType

from fleetgold.functions.address import cleaned
from fleetgold.operators.changes import changes_by_side
from fleetgold.operators.conform import REJECT_COLUMN, VALUES_COLUMN
from fleetgold.operators.lookup import COORDINATES, current_registrations
from fleetgold.operators.skew import broadcast_checked
from fleetgold.plans.status import STATUS_SCHEMA
from fleetgold.sources.commits import claim, numbers
from fleetgold.sources.contracts import find_entity
from fleetgold.sources.listed import normal_path, unescaped, default_root
from fleetgold.sources.shared import checkpointed
from fleetgold.sources.tables import counted

REGISTRY_SCHEMA = (
    "tenant_id string, layer string, namespace string, name string, version string, "
    "contract_hash string, location string, snapshot string, change_feed boolean, seq bigint"
)
REGISTRY_ORDER = ["seq", "snapshot"]
BASE_SCHEMA = "append string"
CONTRACT_SCHEMA = "contract_hash string, contract string"
FORMATS = ("parquet", "orc")
#: The store's own columns; a table that has one of these names is refused.
SNAPSHOT, REJECTED = "fg_snapshot", "fg_rejected"
RESERVED = (SNAPSHOT, REJECTED, REJECT_COLUMN, VALUES_COLUMN)


@dataclass(frozen=True)
class Coordinates:
    layer: str
    namespace: str
    name: str
    version: str

    @classmethod
    def of_key(cls, key: str) -> Coordinates:
        parts = key.split(":")
        if len(parts) != 4 or not all(parts):
            raise KeyError(f"not a table key: {key!r}")
        return cls(*parts[:3], cleaned(parts[3]))


@dataclass(frozen=True)
class Snapshot:
    snapshot: str
    location: str
    rows: int


def _cast_to(df: DataFrame, schema: StructType, strict: bool) -> DataFrame:
    """``df`` with the columns of ``schema`` in its types; what it lacks is null, other columns stay.

    A value that does not fit its new type is null, or with ``strict`` an error.
    """
    have = set(df.columns)

    def fitted(field: StructField):
        if field.name not in have:
            return F.lit(None).cast(field.dataType)
        value = F.col(f"`{field.name}`")
        fit = value.try_cast(field.dataType)
        wrong = F.raise_error(F.lit(f"{field.name}: value does not fit {field.dataType.simpleString()}")).cast(field.dataType)
        return F.when(value.isNotNull() & fit.isNull(), wrong).otherwise(fit) if strict else fit

    cast = {
        f.name: fitted(f)
        for f in schema.fields
        if f.name != "tenant_id"
    }
    own = [c for c in df.columns if c not in cast and (c == "tenant_id" or c.startswith("fg_"))]
    return df.select(*own, *[v.alias(k) for k, v in cast.items()])


def _as_columns(coords: Coordinates):
    return [F.lit(getattr(coords, c)).alias(c) for c in COORDINATES]


class Store:
    """Registry, contracts, status log and tables below one shared folder.

    A log is a folder of appends, each in a folder of its own that counts once its
    ``_SUCCESS`` marker is there: appends of two drivers do not touch each other, and one
    that dies is never seen in part. ``compact`` puts a log's appends into one.
    """

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet"):
        if fmt not in FORMATS:
            raise ValueError(f"tables are written as one of {FORMATS}, not {fmt!r}")
        self.spark = spark
        self.root = root.rstrip("/")
        self.fmt = fmt

    # logs

    def _files_of(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getParent().toString() for s in fs.globStatus(path) or [])

    def _log(self, folder: str, schema: str) -> DataFrame:
        appends = self._files_of(f"{folder}/append-*/_SUCCESS")
        if not appends:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*appends)

    def _append(self, rows: DataFrame, folder: str) -> None:
        name = f"append-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        rows.write.mode("errorifexists").parquet(f"{self.root}/{folder}/{name}")

    def compact(self, folder: str) -> None:
        """One append instead of many. Rows seen twice by a reader meanwhile are harmless: logs are read by latest."""
        schemas = {"registry": REGISTRY_SCHEMA, "statuses": STATUS_SCHEMA, "contracts": CONTRACT_SCHEMA}
        old = self._files_of(f"{folder}/append-*/_SUCCESS")
        if len(old) < 2:
            return
        rows = self.spark.read.schema(schemas[folder]).parquet(*old)
        self._append(rows.distinct().hint("rebalance"), folder)
        for path in map(self.spark._jvm.org.apache.hadoop.fs.Path, old):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def registrations(self) -> DataFrame:
        """All registrations ever, for histories; ``current`` reads less."""
        return self._log("registry", REGISTRY_SCHEMA)

    def version(self) -> int:
        """The number of the last registration, which may still be on its way."""
        taken = numbers(self.spark, f"{self.root}/registry-commits")
        return taken[-1] if taken else 0

    def rebase(self) -> None:
        """Put the current registration of every table into a base, so that reads need only what comes after it.

        The base names the appends that it holds, so one that ends late, whatever its number, is still read
        beside it. A base counts once it is whole; the log stays as it is.
        """
        appends = self._files_of("registry/append-*/_SUCCESS")
        folder = f"{self.root}/registry-base/base-{claim(self.spark, f'{self.root}/base-commits'):020d}"
        self.current().hint("rebalance").write.parquet(f"{folder}/rows")
        names = [(a.rpartition("/")[2],) for a in appends]
        self.spark.createDataFrame(names, BASE_SCHEMA).coalesce(1).write.parquet(f"{folder}/appends")

    def _latest_registrations(self) -> DataFrame:
        """The newest base and the appends that it does not hold: every table's current registration is among them."""
        bases = self._files_of("registry-base/base-*/appends/_SUCCESS")
        if not bases:
            return self.registrations()
        base = bases[-1].removesuffix("/appends")
        held = {r[0] for r in self.spark.read.schema(BASE_SCHEMA).parquet(f"{base}/appends").collect()}
        appends = self._files_of("registry/append-*/_SUCCESS")
        later = [a for a in appends if a.rpartition("/")[2] not in held]
        return self.spark.read.schema(REGISTRY_SCHEMA).parquet(f"{base}/rows", *later)

    def next_status(self) -> int:
        """A number for status rows: above all that were given before, whatever the clocks say."""
        return claim(self.spark, f"{self.root}/status-commits")

    def contracts(self) -> DataFrame:
        return self._log("contracts", CONTRACT_SCHEMA)

    def statuses(self) -> DataFrame:
        return self._log("statuses", STATUS_SCHEMA)

    def append_statuses(self, rows: DataFrame) -> None:
        self._append(rows.hint("rebalance"), "statuses")

    def _contract_hash(self, contract: str) -> str:
        """The contract's hash; its text is stored once, however many registrations name it."""
        if not contract:
            return ""
        name = hashlib.sha256(contract.encode()).hexdigest()
        if self.contracts().where(F.col("contract_hash") == name).isEmpty():
            self._append(self.spark.createDataFrame([(name, contract)], CONTRACT_SCHEMA).coalesce(1), "contracts")
        return name

    def register(
        self,
        tenants: DataFrame,
        coords: Coordinates,
        snapshot: Snapshot,
        contract: str = "",
        change_feed: bool = True,
        based_on: int | None = None,
    ) -> int:
        """Point these tenants at a snapshot, whether or not it has rows for them. The latest registration wins.

        Latest is the highest commit number, which is claimed before the rows are written and returned. ``based_on``
        is the ``version`` from which the snapshot was made: if the table was registered since, by anybody, this
        raises ``CommitConflict`` and registers nothing.
        """
        key = ":".join(getattr(coords, c) for c in COORDINATES)
        number = claim(self.spark, f"{self.root}/registry-commits", key, based_on)
        self._append(
            tenants.select(
                F.col("tenant_id").cast("string").alias("tenant_id"),
                *_as_columns(coords),
                F.lit(self._contract_hash(contract)).alias("contract_hash"),
                F.lit(snapshot.location).alias("location"),
                F.lit(snapshot.snapshot).alias("snapshot"),
                F.lit(change_feed).alias("change_feed"),
                F.lit(number).cast("bigint").alias("seq"),
            ).hint("rebalance"),
            "registry",
        )
        return number

    def _of(self, coords: Coordinates, latest: bool = False) -> DataFrame:
        log = self._latest_registrations() if latest else self.registrations()
        for c in COORDINATES:
            log = log.where(F.col(c) == getattr(coords, c))
        return log

    def current(self, coords: Coordinates | None = None) -> DataFrame:
        """Current registration per tenant, of one table or of all."""
        return current_registrations(
            self._latest_registrations() if coords is None else self._of(coords, latest=True), REGISTRY_ORDER
        )

    def with_contracts(self, registrations: DataFrame) -> DataFrame:
        """``registrations`` with the text ``contract`` behind their ``contract_hash``; empty if there is none."""
        texts = self.contracts().dropDuplicates(["contract_hash"])
        joined = registrations.join(texts, "contract_hash", "left")
        return joined.withColumn("contract", F.coalesce("contract", F.lit("")))

    # tables

    def table_folder(self, coords: Coordinates) -> str:
        c = coords
        return f"{self.root}/tables/{c.layer}/{c.version}/{c.namespace}/{c.name}"

    def write_snapshot(self, df: DataFrame, coords: Coordinates, marked: bool = False) -> Snapshot:
        """Write ``df`` (with ``tenant_id``) as a new snapshot; count it on the way.

        ``marked``: ``df`` comes from ``conform_marked``, and rows with a reason go to the
        reject side. The rebalance hint gathers a tenant's rows into few files and lets
        adaptive execution split a large tenant over several writers.
        """
        allowed = {REJECT_COLUMN, VALUES_COLUMN} if marked else set()
        clash = sorted(c for c in df.columns if c.lower() in RESERVED and c not in allowed)
        if clash:
            raise ValueError(f"columns {clash} have names that the store reserves")
        rejected = F.col(REJECT_COLUMN).isNotNull() if marked else F.lit(False)
        df = df.withColumn(REJECTED, rejected)
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        location = f"{self.table_folder(coords)}/{SNAPSHOT}={name}"
        # Counted above the rebalance: below it, adaptive execution would drop the
        # counter together with an empty stage.
        counting, observed = counted(df.hint("rebalance", REJECTED, "tenant_id"), name)
        counting.write.partitionBy(REJECTED, "tenant_id").mode("errorifexists").format(self.fmt).save(location)
        return Snapshot(name, location, observed.get["n"])

    def _files(self, coords: Coordinates, schema: StructType, snapshots: Sequence[str], rejected: bool) -> DataFrame:
        """Files of these snapshots, with partition columns."""
        partitions = [
            StructField(SNAPSHOT, StringType()),
            StructField(REJECTED, BooleanType()),
            StructField("tenant_id", StringType()),
        ]
        own = [StructField(REJECT_COLUMN, StringType()), StructField(VALUES_COLUMN, MapType(StringType(), StringType()))]
        names = {f.name for f in partitions}
        fields = [f for f in schema.fields if f.name not in names]
        whole = StructType(fields + (own if rejected else []) + partitions)
        folder = self.table_folder(coords)
        reader = self.spark.read.schema(whole).option("basePath", folder).format(self.fmt)
        found = reader.load([f"{folder}/{SNAPSHOT}={s}" for s in sorted(snapshots)])
        return found.where(F.col(REJECTED) == rejected)

    def _pointed(
        self, coords: Coordinates, pointers: DataFrame, schema: StructType | None, rejected: bool = False, strict: bool = False
    ) -> DataFrame:
        """Rows that ``pointers`` (snapshot, tenant_id, contract_hash, more columns) name, with the more columns.

        Snapshots are read by the contract they were registered with and cast to the
        newest one, so a tenant on an older contract stays readable. Spark lists input
        folders on the driver, so the names of the snapshots named come here.
        """
        pointers = checkpointed(pointers)
        listed = pointers.select("contract_hash", "snapshot").distinct().collect()
        by_contract: dict[str, list[str]] = {}
        for r in listed:
            by_contract.setdefault("" if schema is not None else r["contract_hash"], []).append(r["snapshot"])
        newest = schema or self.schema_of(coords)
        parts = []
        for name in sorted(by_contract):
            own = newest if schema is not None or not name else self._schema_by_hash(coords, name)
            rows = self._files(coords, own, by_contract[name], rejected)
            # Says what the join would find anyway, so that Spark sees that pruning pays.
            mine = pointers.where(F.col("snapshot").isin(by_contract[name]))
            if schema is None:
                mine = mine.where(F.col("contract_hash") == name)
            joined = rows.join(
                broadcast_checked(mine.drop("contract_hash").withColumnRenamed("snapshot", SNAPSHOT)), [SNAPSHOT, "tenant_id"]
            ).drop(SNAPSHOT, REJECTED)
            parts.append(joined if own == newest else _cast_to(joined, newest, strict))
        if not parts:
            more = [f for f in pointers.schema.fields if f.name not in ("snapshot", "contract_hash", "tenant_id")]
            fields = [f for f in newest.fields if f.name != "tenant_id"]
            return self.spark.createDataFrame([], StructType([StructField("tenant_id", StringType()), *fields, *more]))
        return reduce(DataFrame.unionByName, parts)

    def _schema_by_hash(self, coords: Coordinates, name: str) -> StructType:
        found = self.contracts().where(F.col("contract_hash") == name).select("contract").limit(1)
        return find_entity(found, coords.name).schema

    def schema_of(self, coords: Coordinates) -> StructType:
        """Schema by the newest registered contract."""
        order = F.when(F.col("contract_hash") != "", F.struct(*REGISTRY_ORDER))
        name = self._of(coords, latest=True).agg(F.max_by("contract_hash", order)).first()[0]
        if not name:
            raise KeyError(f"no contract of {coords} is registered")
        return self._schema_by_hash(coords, name)

    def contract_of(self, coords: Coordinates) -> str:
        """Text of the newest registered contract; empty if there is none."""
        order = F.when(F.col("contract_hash") != "", F.struct(*REGISTRY_ORDER))
        newest = self._of(coords, latest=True).agg(F.max_by("contract_hash", order).alias("contract_hash"))
        found = newest.join(self.contracts(), "contract_hash").select("contract").first()
        return found[0] if found else ""

    def read(
        self, coords: Coordinates, schema: StructType | None = None, rejected: bool = False, strict: bool = False
    ) -> DataFrame:
        """Current rows of a table for all its tenants.

        Only folders of current snapshots are listed. Each tenant's pointer is
        joined on the partition columns, so a tenant that has moved on to a newer
        snapshot is pruned from the older one before any file is opened. The reject
        side has ``fg_reason`` and ``fg_values`` as well. Rows of an older contract whose values do not fit the newest one
        are null there, or fail the read if it is ``strict``.
        """
        pointers = self.current(coords).select("snapshot", "tenant_id", "contract_hash")
        return self._pointed(coords, pointers, schema, rejected, strict)

    def changes(
        self, coords: Coordinates, keys: Sequence[str], schema: StructType | None = None
    ) -> DataFrame:
        """Row changes each tenant's latest publish made; a first publish is all inserts.

        Fails if a tenant's current registration has its change feed switched off.
        """
        if not self.current(coords).where(~F.col("change_feed")).isEmpty():
            raise ValueError(f"the change feed of {coords} is switched off")
        publishes = Window.partitionBy("tenant_id").orderBy(*[F.desc(c) for c in REGISTRY_ORDER])
        # The rank limit is applied before the shuffle, so a tenant's long history stays behind.
        sides = (
            self._of(coords)
            .select("tenant_id", "contract_hash", *REGISTRY_ORDER)
            .withColumn("_back", F.dense_rank().over(publishes))
            .where(F.col("_back") <= 2)
            .select("snapshot", "tenant_id", "contract_hash", (F.col("_back") == 1).alias("fg_new"))
            .distinct()
        )
        rows = self._pointed(coords, sides, schema)
        return changes_by_side(rows, ["tenant_id", *keys], "fg_new")

    def changes_between(
        self, coords: Coordinates, keys: Sequence[str], after: int, upto: int | None = None, schema: StructType | None = None
    ) -> DataFrame:
        """Net row changes of each tenant from commit ``after`` to commit ``upto`` (the latest): what many publishes add up to.

        Only the two snapshots at the ends are read, however many lie between. A tenant that was not registered at the start
        has inserts only; one that was not registered in between has no rows here. All snapshots have to be there still.
        """
        log = self._of(coords).select("tenant_id", "contract_hash", *REGISTRY_ORDER)
        if upto is not None:
            log = log.where(F.col("seq") <= upto)
        order = F.struct(*REGISTRY_ORDER)
        pointer = F.struct("snapshot", "contract_hash")
        ends = log.groupBy("tenant_id").agg(
            F.max_by(F.when(F.col("seq") <= after, pointer), F.when(F.col("seq") <= after, order)).alias("old"),
            F.max_by(pointer, order).alias("new"),
        )
        ends = ends.where(~F.col("old.snapshot").eqNullSafe(F.col("new.snapshot")))
        side = F.array(
            F.struct(F.col("old.*"), F.lit(False).alias("fg_new")), F.struct(F.col("new.*"), F.lit(True).alias("fg_new"))
        )
        sides = ends.select("tenant_id", F.inline(side)).where(F.col("snapshot").isNotNull())
        rows = self._pointed(coords, sides.select("snapshot", "tenant_id", "contract_hash", "fg_new"), schema)
        return changes_by_side(rows, ["tenant_id", *keys], "fg_new")

    # retention

    def unreferenced(self, publishes: int = 2, grace_seconds: int = 86_400) -> DataFrame:
        """Snapshot folders that nobody needs any more: ``location``, ``files``, ``bytes``, ``modified``.

        Needed are the snapshots of each tenant's last ``publishes`` registrations of every table (two, as ``changes`` reads).
        A folder whose newest file is younger than the grace time may belong to a job that has not registered yet, and stays.
        Files are listed by Spark and meet the registry in one anti join.
        """
        folder = f"{self.root}/tables"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "location string, files bigint, bytes bigint, modified timestamp")
        root = default_root(self.spark)
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        meta = files.metadataColumn("_metadata")
        place = F.regexp_extract(unescaped(meta["file_path"]), f"^(.*/{SNAPSHOT}=[^/]+)/", 1)
        found = files.select(normal_path(place, root).alias("location"), "length", "modificationTime")
        folders = found.groupBy("location").agg(
            F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified")
        )
        publish = Window.partitionBy("tenant_id", *COORDINATES).orderBy(*[F.desc(c) for c in REGISTRY_ORDER])
        needed = (
            self.registrations()
            .withColumn("_back", F.dense_rank().over(publish))
            .where(F.col("_back") <= publishes)
            .select(normal_path(F.col("location"), root).alias("location"))
            .distinct()
        )
        old = F.col("modified") < F.current_timestamp() - F.make_dt_interval(secs=F.lit(grace_seconds).cast("decimal(18,6)"))
        return folders.join(needed, "location", "left_anti").where(old)

    def remove_unreferenced(self, publishes: int = 2, grace_seconds: int = 86_400) -> list[str]:
        """Delete what ``unreferenced`` names; gives the folders."""
        gone = sorted(r[0] for r in self.unreferenced(publishes, grace_seconds).select("location").collect())
        for path in map(self.spark._jvm.org.apache.hadoop.fs.Path, gone):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone
