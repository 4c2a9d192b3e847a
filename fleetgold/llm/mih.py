"""Nearest neighbours by multi-index hashing over learned binary codes.

Inner products become angles by one more component: a vector gets the length that it
lacks to the longest one, a query gets 0. The codes are signs after learned rotations:
principal axes, then iterative quantisation, from several starts. A code is cut into
substrings of 8 bits, each with its own index from value to rows. Within a Hamming
radius r of a query, by the pigeonhole principle, some substring is within r // m (or
one less from a certain place on), so probing these substrings' values finds every
code in the radius; the exact Hamming distance then sorts out the rest. What is found
is ranked by the inner product of the original vectors.

Rotations and radius are learned from samples of ``SAMPLE`` rows and ``TUNING`` queries,
chosen by a hash; every row is indexed. The index is cut into blocks of rows; a task
holds one block of it and one block of queries, and hands on the best ``k`` of each. A
query that finds fewer than ``k`` rows in a block widens its radius there.

Defined results: vectors that are null, zero or hold null or non-finite components
take no part; shorter vectors are padded with zeros; rows equal in id and vector
count once; rows of one id with different vectors are different rows: each is a query of its
own, with ranks of its own, and a candidate for the others; rows with a null id are neither query nor candidate; with fewer than ``k``
candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetgold.llm.common import python_tasks, saved
from fleetgold.llm.vectors import matrix, second_moments, usable, width_of

K = 20
SUBSTRING_BITS = 8
STARTS = 2
SAMPLE = 8_192
TUNING = 512
RECALL = 0.97
ROUNDS = 20
BLOCK = 8_192
QUERY_BLOCK = 1_024
POPCOUNT = np.bitwise_count(np.arange(256, dtype=np.uint8))


class Coder:
    """Turns vectors into codes of bytes."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 5):
        self.longest = longest
        points = self.lengthened(sample)
        self.centre = points.mean(0)
        _, axes = np.linalg.eigh(np.cov((points - self.centre).T) if len(points) > 1 else np.eye(points.shape[1]))
        bits = -(-(points.shape[1] - 1) // SUBSTRING_BITS) * SUBSTRING_BITS
        axes = axes[:, ::-1]
        rng = np.random.default_rng(seed)
        self.turns = []
        for _ in range(STARTS):
            start = np.linalg.qr(rng.normal(size=(max(bits, axes.shape[1]),) * 2))[0][: axes.shape[1], :bits]
            turn = axes @ start
            flat = points - self.centre
            for _ in range(ROUNDS if len(points) > bits else 0):
                u, _, v = np.linalg.svd(flat.T @ np.where(flat @ turn >= 0, 1.0, -1.0), full_matrices=False)
                turn = u @ v
            self.turns.append(turn)
        self.turn = np.hstack(self.turns)

    def lengthened(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        if query:
            return np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))])
        x = x / self.longest
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        return np.packbits((self.lengthened(x, query) - self.centre) @ self.turn >= 0, axis=1)


def radii(radius: int, substrings: int) -> np.ndarray:
    """How far each substring must be probed to find every code within ``radius``."""
    share, more = divmod(radius, substrings)
    return np.where(np.arange(substrings) <= more, share, share - 1)


class Index:
    """Rows of one block by the value of every substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.sizes = [np.bincount(c, minlength=256) for c in codes.T]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows within a Hamming radius."""
        seen = np.zeros(len(self.codes), bool)
        for s, far in enumerate(radii(radius, self.codes.shape[1])):
            if far >= 0:
                probed = POPCOUNT[np.arange(256, dtype=np.uint8) ^ code[s]] <= far
                seen[self.order[s][np.repeat(probed, self.sizes[s])]] = True
        rows = np.flatnonzero(seen)
        return rows[POPCOUNT[self.codes[rows] ^ code].sum(1, dtype=np.int64) <= radius]


def tuned_radius(coder: Coder, sample: np.ndarray, rows: int, k: int, recall: float) -> int:
    """The radius that holds ``recall`` of the nearest neighbours, as far as the sample shows."""
    queries = sample[:TUNING]
    near = max(1, min(math.ceil(k * len(sample) / max(rows, 1)), len(sample) - 1))
    score = queries @ sample.T
    score[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    best = np.argpartition(-score, near - 1, axis=1)[:, :near]
    codes, asked = coder.codes(sample), coder.codes(queries, query=True)
    distance = POPCOUNT[codes[best] ^ asked[:, None, :]].sum(2, dtype=np.int64)
    return int(np.quantile(distance, recall, method="higher"))


def nearest(
    rows: DataFrame, is_query: Column, name: str = "vec_id", vector: str = "embedding", k: int = K,
    recall: float = RECALL, block: int = BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """For every row where ``is_query`` holds of ``id``: query_id, rank, ``name``, score."""
    python_tasks(rows.sparkSession)
    raw = rows.select(F.col(f"`{name}`").alias("id"), F.col(f"`{vector}`").alias("vec"))
    width = width_of(raw, "vec")
    good = usable(raw, "vec", width).where("key is not null and id is not null")
    distinct = good.groupBy("id", "key").agg(F.first("vec").alias("vec")).drop("key")
    points = saved(distinct.withColumn("row", F.monotonically_increasing_id()))
    total, _, _, longest = second_moments(points, width, unit=False)
    total = int(total)
    shape = "query_row long, query_id long, vec_id long, score double"
    # A bounded sample, the same on every run: the rows with the smallest hashes.
    sample = matrix([r.vec for r in points.orderBy(F.xxhash64("id", "vec")).limit(SAMPLE).select("vec").collect()])
    if total == 0:
        empty = points.limit(0)
        return empty.select(
            F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(name), F.lit(0.0).alias("score")
        )
    coder = Coder(sample, longest)
    radius = tuned_radius(coder, sample, total, k, recall) if total > 1 else 0
    blocks = -(-total // block)
    asked = points.where(is_query)
    query_blocks = -(-asked.count() // query_block) or 1
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    base = points.select(
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), place(blocks).alias("b"),
        F.lit(False).alias("asks"), "row", "id", "vec",
    )
    queries = asked.select(
        place(query_blocks).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"),
        F.lit(True).alias("asks"), "row", "id", "vec",
    )

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        asks = frame["asks"].to_numpy()
        ids, rows_, vecs = frame["id"].to_numpy(), frame["row"].to_numpy(), matrix(frame["vec"])
        own, x, wanted, q = ids[~asks], vecs[~asks], ids[asks], vecs[asks]
        own_row, wanted_row = rows_[~asks], rows_[asks]
        if not len(own) or not len(wanted):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []})
        index, out = Index(coder.codes(x)), []
        most = index.codes.shape[1] * 8
        for name_, row, vec, code in zip(wanted, wanted_row, q, coder.codes(q, query=True), strict=True):
            reach = radius
            while True:
                hits = index.within(code, reach)
                hits = hits[own_row[hits] != row]
                if len(hits) >= k or reach >= most:
                    break
                reach = min(most, reach + index.codes.shape[1])
            score = np.einsum("ij,j->i", x[hits], vec)
            best = np.lexsort((own[hits], -score))[:k]
            out.append(pd.DataFrame({"query_row": row, "query_id": name_, "vec_id": own[hits][best], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    found = base.unionByName(queries).groupBy("q", "b").applyInPandas(search, shape)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(name), "score")
