"""Connected components as Spark aggregates and joins: a distributed union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgold.llm.common import saved
from fleetgold.operators.skew import lookup_join


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % 1_000_003)).first())


def components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node it is connected to.

    Large-star and small-star steps in turn: every node hooks its larger
    neighbours, then its smaller ones, onto the smallest of them. Both steps are
    a minimum (combined before the shuffle) and a join that can split hot nodes;
    no neighbour list is gathered. The number of rounds grows with the logarithm
    of the longest path. Links that are null or loops are ignored; no links give
    an empty result.
    """
    a, b = F.col(src), F.col(dst)
    edges = saved(links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = _state(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        ends = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        low = ends.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = (
            lookup_join(edges.withColumn("u", F.col("lo")), low, ["u"], "inner")
            .select("hi", F.col("m").alias("lo"))
            .distinct()
        )
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hooked = lookup_join(large, low, ["hi"], "inner")
        small = hooked.select(
            F.explode(
                F.array(
                    F.struct(F.col("hi"), F.col("m").alias("lo")),
                    F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
                )
            ).alias("e")
        ).select("e.*")
        edges = saved(small.where("hi != lo").distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"not settled after {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )


def class_results(rows: DataFrame, name: str, classes: DataFrame, compared: DataFrame) -> DataFrame:
    """(``name``, class_id, n_links) for every row of ``rows`` (``name``, key), also where the key is null.

    ``classes`` has key, node, first_id (the smallest ``name``) and copies, one row per
    set of equal things. ``compared`` has node, links and reached, any number of rows per
    node. class_id is the smallest ``name`` of all connected classes; a class's copies
    are links too. A row with a null key is alone.
    """
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(compared.where("links > 0"), "node", "reached")
    smallest = classes.join(roots, "node").groupBy("root").agg(F.min("first_id").alias("class_id"))
    joined = lookup_join(roots, smallest, ["root"], "inner").select("node", "class_id")
    index = (
        classes.select("key", "node", "first_id", "copies")
        .join(joined, "node", "left")
        .join(links, "node", "left")
        .select(
            "key",
            F.coalesce("class_id", "first_id").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    return lookup_join(rows, index, ["key"], "left").select(
        name,
        F.when(F.col("key").isNull(), F.col(name)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
