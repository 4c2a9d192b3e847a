"""Embedding near-dedup: PCA-ordered, tiled comparison with an early stop.

All usable vectors are compared by cosine. Equal vectors are one class first. The
classes are cut into blocks by a hash, and every pair of blocks is one tile of bounded
size. In a tile the unit vectors are turned into the principal axes of the whole
table, by falling variance. The products of the leading axes come from one matrix
product; what the other axes can add is at most the product of the two suffix norms,
so a pair stops as soon as that bound is below the threshold. What is left goes
through further axes the same way, and the survivors get the exact cosine of the
original vectors in double precision. A tile hands on one row per vector.

Defined results: vectors that are null, zero or hold null or non-finite components
link with nothing and are kept; shorter vectors are padded with zeros; rows with
equal ids are each compared; a null id takes part and is in no ``component_id`` unless
its component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgold.llm.common import python_tasks, saved
from fleetgold.llm.graph import class_results
from fleetgold.llm.tiles import smallest_reached
from fleetgold.llm.vectors import matrix, second_moments, usable, width_of

THRESHOLD = 0.9
BLOCK = 4_096
#: Rows of a tile's matrix product, pairs of one later step, axes added at a time.
ROWS, PAIRS, AXES = 512, 100_000, 16
SLACK = 1e-9


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Columns: the axes of unit vectors by falling second moment (not centred: cosines are not)."""
    _, _, products, _ = second_moments(vectors, width, unit=True)
    _, axes = np.linalg.eigh(products)
    return axes[:, ::-1]


def linked_pairs(left: np.ndarray, right: np.ndarray, axes: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a cosine of at least ``threshold``."""
    units = [m / np.linalg.norm(m, axis=1, keepdims=True) for m in (left, right)]
    turned = [u @ axes for u in units]
    steps = [*range(AXES, axes.shape[1], AXES), axes.shape[1]]
    rest = [np.sqrt(np.maximum(np.cumsum(t[:, ::-1] ** 2, axis=1)[:, ::-1], 0)) for t in turned]
    rest = [np.hstack([r, np.zeros((len(r), 1))]) for r in rest]  # rest[:, k]: norm of the axes from k on
    linked = np.zeros((len(left), len(right)), bool)
    for a in range(0, len(left), ROWS):
        part = slice(a, a + ROWS)
        known = turned[0][part, : steps[0]] @ turned[1][:, : steps[0]].T
        bound = known + rest[0][part, steps[0]][:, None] * rest[1][:, steps[0]][None, :]
        hits = np.flatnonzero(bound.ravel() >= threshold - SLACK)
        for b in range(0, len(hits), PAIRS):
            i, j = np.divmod(hits[b : b + PAIRS], len(right))
            so_far = known[i, j]
            i = i + a
            for begin, end in zip(steps, steps[1:], strict=False):
                so_far = so_far + np.einsum("ij,ij->i", turned[0][i, begin:end], turned[1][j, begin:end])
                stay = so_far + rest[0][i, end] * rest[1][j, end] >= threshold - SLACK
                i, j, so_far = i[stay], j[stay], so_far[stay]
            exact = np.einsum("ij,ij->i", units[0][i], units[1][j]) >= threshold
            linked[i[exact], j[exact]] = True
    return linked


def near_vectors(
    rows: DataFrame, name: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """One row per row: ``name``, n_links, component_id (smallest id reachable by links), kept."""
    python_tasks(rows.sparkSession)
    raw = rows.select(F.col(f"`{name}`").alias("id"), F.col(f"`{vector}`").alias("vec"))
    width = width_of(raw, "vec")
    vectors = saved(usable(raw, "vec", width))
    classes = saved(
        vectors.where("key is not null")
        .groupBy("key")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    axes = principal_axes(classes, width)
    blocks = -(-classes.count() // block) or 1
    tiled = (
        classes.select("node", "copies", "vec")
        .withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "node", "copies", "vec")
    )

    def tile(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        same = frame["a"].iat[0] == frame["b"].iat[0]
        left = (frame["block"] == frame["a"]).to_numpy()
        places = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
        points = matrix(frame["vec"])
        linked = linked_pairs(points[places[0]], points[places[1]], axes, threshold)
        if same:
            np.fill_diagonal(linked, False)
        weight, node = frame["copies"].to_numpy(np.float64), frame["node"].to_numpy()
        links = np.zeros(len(frame))
        links[places[0]] += linked @ weight[places[1]]
        if not same:
            links[places[1]] += weight[places[0]] @ linked
        found = pd.DataFrame(
            {"node": node, "links": links.astype(np.int64), "reached": node[smallest_reached(linked, *places)]}
        )
        return found[found["links"] > 0]

    compared = saved(tiled.groupBy("a", "b").applyInPandas(tile, "node long, links long, reached long"))
    found = class_results(vectors.select("id", "key"), "id", classes, compared)
    return found.select(
        F.col("id").alias(name),
        "n_links",
        F.col("class_id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("class_id")).alias("kept"),
    )
