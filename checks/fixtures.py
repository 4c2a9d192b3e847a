"""Control tables as Spark queries over the whole test tables.

Each one grows with the table it comes from; the modulo terms only vary the
values so that every case of an operator occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgold.sources.shared import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PAIR = """
  select p_partkey doc_key, to_json(struct(map('svc.Part', struct('entity' as kind, map_filter(map(
      'id', struct(case when (p_size + {n}) % 3 = 0 then 'cds.Integer' else 'cds.Integer64' end as type,
        cast(null as int) as precision, cast(null as int) as scale, p_size % 2 = {n} as notNull),
      'price', struct('cds.Decimal' as type, 10 + (p_size * (2 + {n})) % 7 as precision, (p_size + {n}) % 3 as scale, null as notNull),
      'made', struct(case when {n} = 1 and p_size % 5 < 3 then 'cds.Timestamp' when p_size % 5 = 4 then 'cds.String' else 'cds.Date' end as type,
        null as precision, null as scale, null as notNull),
      'k' || {n}, struct('cds.Boolean' as type, null as precision, null as scale, p_size % 4 = 0 as notNull)),
      (k, v) -> not (k = 'price' and p_size % 11 = {n})) as elements)) as definitions)) contract
  from {part}"""


def contract_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An old and a new contract per part."""
    part = spread(table(spark, sf_dir, "part"))
    return tuple(spark.sql(_PAIR.replace("{n}", str(n)), part=part) for n in (0, 1))


_LINKED = """
  select 'L' || p_partkey launch_id, to_json(struct(
    struct('job' as transformerId) as transformer,
    map_from_entries(transform(sequence(0, 5), k -> struct('p' || k, struct(
      struct(cast(null as string) as layer, 'n' as namespace, 'v1.0.0' as version, 'T' || k as name) as coordinates,
      array(struct('job' as transformerName, array('input_tables=gold:n:X:1.0.0,' || array_join(transform(
        filter(sequence(0, 5), j -> (j < k and (p_size * (j + 2) + k * 5 + p_partkey) % 4 = 0)
          or (k = 0 and j = 5 and p_size % 7 = 0) or (j = k and p_size % 5 = 0)),
        j -> 'gold:n:T' || j || ':1.0.0'), ',')) as parameters)) as transformers)))) as dataProducts)) document
  from {part}"""


def linked_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One launch per part, whose six products need some of each other's tables; some in a cycle, some their own."""
    return spark.sql(_LINKED, part=spread(table(spark, sf_dir, "part")))


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all tasks before each grows to a document many times its size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def named(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"))


_LAUNCH = """
  with sized as (
    select *, 'silver:sales:T' || (p_partkey % 5 + 1) || ':1.0.0' first,
      'silver:sales:T' || (p_size % 5 + 1) || ':1.0.0' second
    from {part}
  ),
  settings as (
    select *, array_compact(array(
        'tier=' || p_type,
        case when p_size % 13 = 0 then 'tier' when p_size % 17 = 0 then 'tier=a=b' end,
        case p_size % 3 when 0 then 'enable_cdf=FALSE' when 1 then 'enable_cdf=True' end,
        case when p_size % 10 = 0 then null
             when p_size % 10 = 5 then 'input_tables='
             when p_size % 4 = 0 then 'input_tables=' || first || ',' || second
             when p_size % 7 = 0 then 'input_tables=' || first || ', ' || second
             when p_size % 11 = 0 then 'input_tables=' || first || ','
             else 'input_tables=' || first end)) parameters
    from sized
  )
  select 'L' || p_partkey launch_id, to_json(struct(
    struct('gold-builder' as transformerId) as transformer,
    map_from_entries(transform(sequence(0, 4),
      i -> struct('t' || (p_partkey % 2 + i * 2), map('zone', p_type)))) as tenants,
    struct('contracts' as contractRoot) as storage,
    map(
      'p' || p_partkey, struct(
        struct(case when p_size % 3 <> 0 then 'gold' end as layer, p_brand as namespace, 'v1.0.0' as version,
          case when p_size % 19 = 0 then '' else p_name end as name) as coordinates,
        struct(p_brand || '.json' as contractFile) as metadata,
        array(
          struct('gold-builder' as transformerName, parameters),
          struct('other' as transformerName, array('x=y=z', 'tier=ignored') as parameters),
          struct('gold-builder' as transformerName,
            case when p_size % 2 = 0 then array('tier=' || p_brand) end as parameters)) as transformers,
        array(
          struct('in1' as name, array('s' || p_partkey) as shareIds),
          struct('in2' as name, array_compact(array('s' || (p_partkey - p_size),
            case when p_size % 6 = 0 then 's' || p_partkey end)) as shareIds),
          struct('in3' as name, cast(null as array<string>) as shareIds)) as inputPorts),
      'q' || p_partkey, struct(
        struct('gold' as layer, p_brand as namespace, '1.0.0' as version, p_name || ' plain' as name) as coordinates,
        struct('plain.json' as contractFile) as metadata,
        array(struct('gold-builder' as transformerName, cast(null as array<string>) as parameters)) as transformers,
        cast(null as array<struct<name: string, shareIds: array<string>>>) as inputPorts)) as dataProducts,
    case when p_partkey % 3 <> 0
      then map('p' || p_partkey, struct('corr-' || p_partkey as correlationId)) end as lifecycle,
    array(struct(p_name as unused)) as datasets)) document
  from settings"""


def launch_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One launch per part: product p<key> with settings, product q<key> with none."""
    return spark.sql(_LAUNCH, part=spread(table(spark, sf_dir, "part")))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share registry: one listing per order, shares by customer, tables by priority."""
    return table(spark, sf_dir, "orders").select(
        named("t", F.col("o_orderkey") % 10).alias("tenant_id"),
        named("s", F.col("o_custkey")).alias("share_id"),
        F.concat(F.lit("silver:sales:T"), F.substring("o_orderpriority", 1, 1), F.lit(":1.0.0")).alias("table_key"),
        (F.col("o_custkey") % 11 != 0).alias("is_list"),
        F.col("o_orderkey").alias("ord"),
        named("/lake/", F.col("o_orderkey")).alias("location"),
        F.when(F.col("o_orderstatus") == "P", F.lit("csv")).otherwise(F.lit("parquet")).alias("format"),
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table registry log: one registration per line item, many per table."""
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        named("t", F.col("l_suppkey") % 5).alias("tenant_id"),
        F.when(F.col("l_linestatus") == "O", F.lit("silver")).otherwise(F.lit("gold")).alias("layer"),
        F.lit("sales").alias("namespace"),
        named("T", F.col("l_partkey")).alias("name"),
        F.when(line % 3 == 0, F.lit("1.0.0")).when(line % 3 == 1, F.lit("2.0.0")).otherwise(F.lit("1.0.0-rc")).alias("version"),
        F.when(F.col("l_returnflag") == "R", F.lit(""))
        .otherwise(F.concat(F.lit('{"definitions":{"svc.T'), F.col("l_partkey").cast("string"), F.lit('":{}}}')))
        .alias("contract"),
        F.concat_ws("-", F.concat(F.lit("/lake/"), F.col("l_orderkey").cast("string")), line, "l_suppkey").alias("location"),
        F.col("l_shipdate").alias("registered_at"),
    )


REGISTRATION_ORDER = ["registered_at", "location"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two table requests per part, by tenant and coordinates."""
    key, size = F.col("p_partkey"), F.col("p_size")

    def request(order: int, name, version) -> F.Column:
        return F.struct(F.lit(order).alias("req_ord"), name.alias("name"), version.alias("version"))

    first = F.when(size % 3 == 0, F.lit("v1.0.0")).when(size % 3 == 1, F.lit("v1.0.0-rc")).otherwise(F.lit("v2.0.0"))
    second = F.when(size % 3 == 0, F.lit("1.0.0")).when(size % 3 == 1, F.lit("2.0.0")).otherwise(F.lit("1.0.0-rc"))
    return (
        table(spark, sf_dir, "part")
        .select(
            named("p", key).alias("product_id"),
            named("t", key % 5).alias("tenant_id"),
            F.when(size % 2 == 0, F.lit("silver")).otherwise(F.lit("gold")).alias("layer"),
            F.lit("sales").alias("namespace"),
            F.explode(
                F.array(request(1, named("T", key), first), request(2, named("T", key - size % 3), second))
            ).alias("r"),
        )
        .select("product_id", "tenant_id", "layer", "namespace", "r.req_ord", "r.name", "r.version")
    )


_CONTRACTS = """
  select p_partkey doc_key,
    case p_size % 4 when 0 then 'svc.Part' || p_partkey when 1 then 'Part' || p_partkey when 2 then p_type
      else 'Nope' end name,
    to_json(struct(
      map_filter(map(
        'svc.Part' || p_partkey, struct('entity' as kind, p_name as `@title`, cast(null as string) as `@tier`, map(
          'id', struct('cds.Integer64' as type, cast(null as int) as length, cast(null as int) as precision,
            cast(null as int) as scale, true as notNull),
          'name', struct('cds.String' as type, p_size as length, null as precision, null as scale, null as notNull),
          'price', struct('cds.Decimal' as type, null as length, 12 as precision, p_size % 5 as scale, null as notNull),
          'made', struct(case when p_size % 2 = 0 then 'cds.Date' else 'cds.Timestamp' end as type, null as length,
            null as precision, null as scale, null as notNull)) as elements),
        'aux.' || p_type, struct('entity' as kind, null as `@title`, p_brand as `@tier`, map(
          'k', struct('cds.Int32' as type, cast(null as int) as length, cast(null as int) as precision,
            cast(null as int) as scale, cast(null as boolean) as notNull)) as elements),
        'old.' || p_type, struct('entity' as kind, null as `@title`, null as `@tier`, map(
          'k', struct('cds.Boolean' as type, cast(null as int) as length, cast(null as int) as precision,
            cast(null as int) as scale, false as notNull)) as elements)),
        (k, v) -> p_size % 5 = 0 or k not like 'old.%') as definitions,
      struct(p_brand as creator, cast(p_size as string) as size) as meta)) contract
  from {part}"""


def contract_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract document per part, with the product name to look for."""
    return spark.sql(_CONTRACTS, part=spread(table(spark, sf_dir, "part")))


def edited_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders again, with some keys moved (delete and insert) and some values changed."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    changed = {
        "o_orderkey": F.when(key % 11 == 0, key + 1_000_000_000_000).otherwise(key),
        "o_totalprice": F.when(key % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
        "o_orderstatus": F.when(key % 13 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")),
    }
    return orders.select(*[changed.get(c, F.col(c)).alias(c) for c in orders.columns])


def by_tenant(orders: DataFrame) -> DataFrame:
    return orders.withColumn("tenant_id", named("t", F.col("o_custkey") % 7))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run statuses: one per event; few tenants and products, so keys are hot."""
    value = F.col("value")
    return table(spark, sf_dir, "events").select(
        named("t", F.col("user_id") % 5).alias("tenant_id"),
        F.col("event_type").alias("product_id"),
        F.when(F.col("event_type") == "error", F.lit("ERROR")).otherwise(F.lit("INFO")).alias("severity"),
        F.when(value < 10, F.lit("active")).when(value < 50, F.lit("success")).otherwise(F.lit("error")).alias("text"),
        "ts",
        "event_id",
    )


def write_text(spark: SparkSession, text: str, purpose: str) -> str:
    """Write one small document to a new shared folder; gives the folder."""
    folder = new_folder(spark, purpose)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(folder)
    return folder
