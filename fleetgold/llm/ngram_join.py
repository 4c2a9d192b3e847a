"""N-gram Jaccard join of documents: a MinHash LSH forest, then exact verification.

Texts with the same words in the same bytes are one class. Every class gets a forest
of labels: in each of ``TREES`` trees a string of ``DEPTH`` MinHash values of its
five-word shingles. Texts whose labels share a prefix in some tree are candidates.
The join starts with whole labels and shortens the prefix by one value at a time,
until the recall estimated from the verified links (each link weighed by the chance
that a pair of its similarity shares such a prefix) reaches the target; with no link
to judge by, the recall at the threshold itself is taken.

Candidates are connected over the smallest class under each prefix (rows in
proportion to the texts, not to pairs), and the components are compared exactly in
tiles (``tiles``). All pairs in a component are compared, so links can only gain.

Defined results: null and empty texts (no word) have no link and are classes of their
own; a text under five words is one shingle; classes with equal texts are joined
before anything is compared, and every copy counts as a link; rows with a null id
take part, and a class of null ids only has a null class id; an empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgold.llm import tiles
from fleetgold.llm.batches import by_bytes
from fleetgold.llm.common import WORD, python_tasks, release, saved, text_of
from fleetgold.llm.graph import class_results, components
from fleetgold.llm.shingles import signatures, word_shingles
from fleetgold.operators.skew import broadcast_checked, lookup_join

WORDS = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
SHORTEST = 4
RECALL = 0.999
VALUE_BYTES = 2
#: Bytes of texts that are signed at once: each is some 60 bytes of arrays.
TEXT_BYTES = 1 << 18


def chance(similarity, depth: int, trees: int = TREES):
    """The chance that two texts share a prefix of ``depth`` values in at least one tree."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** trees


def _labels(words: int, trees: int, depth: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("labels", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", TEXT_BYTES):
            texts = batch.column("text").to_pylist()
            hashes, counts = word_shingles(texts, words)
            values = signatures(hashes, counts, trees * depth) * np.uint32(0x9E3779B1)
            short = (values >> np.uint32(16)).astype(">u2")
            labels = iter([v.tobytes() for v in short])
            full = counts > 0
            keys = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() if f else None for t, f in zip(texts, full, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(keys, pa.binary()),
                    pa.array([next(labels) if f else None for f in full], pa.binary()),
                ],
                schema=schema,
            )

    return run


def _candidates(classes: DataFrame, depth: int, trees: int, whole: int) -> DataFrame:
    """(node, root) of the components under equal prefixes of ``depth`` values."""
    width = VALUE_BYTES * whole
    prefixes = F.array(
        *[F.xxhash64(F.lit(t), F.expr(f"substring(labels, {1 + t * width}, {VALUE_BYTES * depth})")) for t in range(trees)]
    )
    members = classes.select("node", F.explode(prefixes).alias("prefix"))
    shared = members.groupBy("prefix").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    links = lookup_join(members, shared.select("prefix", "low"), ["prefix"], "inner")
    return components(links.where("node != low").distinct(), "node", "low")


def _compared(
    docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES,
    depth: int = DEPTH, shortest: int = SHORTEST, recall: float = RECALL,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows (doc_id, key), the classes of equal texts and the links between them (``tiles.compare``)."""
    spark = docs.sparkSession
    python_tasks(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = saved(texts.mapInArrow(_labels(words, trees, depth), "doc_id long, key binary, labels binary"))
    classes = saved(
        rows.where("key is not null")
        .groupBy("key")
        .agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("labels").alias("labels"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    shingles = lambda t: word_shingles(t, words)
    at = depth
    while True:
        found = _candidates(classes, at, trees, depth)
        chosen = saved(found.join(classes.drop("labels"), "node"))
        # The text of each class comes from its row with the smallest id; equal rows give it twice.
        wanted = chosen.select("node", "root", "copies", "first_id", "key")
        fetched = texts.withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary")))).join(
            broadcast_checked(wanted), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("key"))
        )
        members = saved(fetched.select("node", "root", "copies", "text").dropDuplicates(["node"]))
        chances = lambda s, d=at: chance(s, d, trees)
        compared = saved(tiles.compare(members, shingles, threshold, chances))
        got, expected = compared.agg(F.sum("found"), F.sum("expected")).first()
        estimate = got / expected if expected else float(chance(threshold, at, trees))
        if estimate >= recall or at <= shortest:
            break
        at -= 1
    release(spark)
    return rows, classes, compared


def similar_documents(docs: DataFrame, **settings) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id it is connected to), n_links."""
    rows, classes, compared = _compared(docs, **settings)
    return class_results(rows.select("doc_id", "key"), "doc_id", classes, compared)


def without_similar(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each group of connected texts: its smallest doc_id, null ids last.

    Rows are told apart by doc_id and the text's key; of rows that repeat both (or of null
    ids, the text) one stays. Texts without words are in no group and all stay.
    """
    rows, classes, compared = _compared(docs, **settings)
    roots = components(compared.where("links > 0"), "node", "reached")
    placed = saved(classes.select("node", "key", "first_id").join(roots, "node").select("root", "key", "first_id"))
    # Ties of ids (null ones, or one id for several texts) go to the smaller key.
    order = F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key")
    best = placed.groupBy("root").agg(F.min(order).alias("best"))
    gone = lookup_join(placed.select("root", "key"), best, ["root"], "inner").where("key != best.key").select("key")
    # Of a class of equal texts that stays, the rows with another id go, and of equal rows all but one.
    copied = classes.where("copies > 1").join(gone, "key", "left_anti").select("key", "first_id")
    times = (
        lookup_join(rows, copied, ["key"], "inner")
        .where(F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("key", "first_id")
        .agg(F.count("*").alias("times"))
    )
    marks = saved(
        gone.select("key", F.lit(None).cast("long").alias("_first"), F.lit(0).cast("long").alias("_times")).union(times)
    ).withColumnRenamed("key", "_key")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    words = text_of().rlike(WORD)
    keyed = docs.select(row, F.when(words, F.unhex(F.md5(text_of().cast("binary")))).alias("_key"))
    first = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_first"))
    marked = lookup_join(keyed, broadcast_checked(marks), ["_key"], "left")
    kept = marked.where(F.col("_times").isNull() | ((F.col("_times") == 1) & first)).select("_row")
    repeated = marks.where("_times > 1")
    if not repeated.isEmpty():
        again = lookup_join(keyed, broadcast_checked(repeated), ["_key"], "inner").where(first)
        kept = kept.union(again.groupBy("_key").agg(F.first("_row").alias("_row")).select("_row"))
    return kept.select("_row.*")
