"""Importance resampling to a target distribution, over hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks separators in UTF-8, ``bytes.split`` gives
the words, and n-grams extend by chained ``zlib.crc32`` seeds: the hash of a run of
words is the seed for the run one word longer, so nothing is joined or hashed twice. Counters
reduce: each task counts its buckets, Spark adds them up.

A bucket's gain is the logarithm of its smoothed share in the target over that in the
documents, in thousandths, rounded down. A document's weight is the sum of the gains of all its features;
adding a Gumbel variate drawn from its id turns the highest scores into a draw without
replacement in proportion to the weights. ``percent`` of the documents with at least
``least_words`` words are drawn.

Two passes over the texts (counts, then weights); what is kept between steps is one short row
per document. Only the documents above an approximate quantile of the scores, a little more than are drawn,
are sorted; their ranks come from a range shuffle and the
partitions' sizes, so no task sees them all. The driver holds one count per bucket (``buckets`` is a
parameter) and one size per partition. A worker counts slices of 1 MB, however long a text is.

Defined results: a null text has no features and weight 0; a null id is drawn as empty text; of
equal scores the smaller id comes first, null ids last; repeated rows count each; an empty
table or an empty target works; only id and text are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetgold.llm.batches import as_bytes, by_bytes, long_id
from fleetgold.llm.common import ship, written

#: Digits, small letters and all bytes of other characters stay, capitals become small, the rest is blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LONGEST = 3
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SLICE = 1 << 20
#: Share of the documents by which more are sorted than are drawn, and the quantile's accuracy (a tenth of that).
SLACK, ACCURACY = 0.002, 5_000


def slices(text: bytes, size: int = SLICE) -> Iterator[list[bytes]]:
    """The words of a text, in slices of about ``size`` bytes that end between words."""
    folded = text.translate(TABLE)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def features(text: bytes, longest: int = LONGEST, size: int = SLICE) -> Iterator[tuple[int, list[int]]]:
    """Per slice of a text: its words, and the crc32 of every run of 1 to ``longest`` words that ends in it."""
    last: list[bytes] = []
    for words in slices(text, size):
        own = last + words
        hashes = list(map(zlib.crc32, own))
        found = hashes[len(last) :]
        spaced = [b" " + w for w in own]
        for n in range(2, longest + 1):
            hashes = list(map(zlib.crc32, spaced[n - 1 :], hashes))
            found += hashes[max(0, len(last) - n + 1) :]
        yield len(words), found
        last = own[len(own) - longest + 1 :] if longest > 1 else []


def bucket_counts(docs: DataFrame, buckets: int, longest: int, text: str = "text") -> list[int]:
    """Features of all texts by bucket: as many numbers as there are buckets."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in by_bytes(batches, "text"):
            for one in as_bytes(batch.column("text")):
                for _, hashes in features(one, longest):
                    counts.update((np.array(hashes, np.int64) % buckets).tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts.keys()), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["bucket", "n"]
        )

    rows = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    summed = rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = [0] * buckets
    for bucket, n in summed.collect():
        counts[bucket] = n
    return counts


def gains(target: list[int], raw: list[int]) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share in the target over that in the raw texts."""
    in_target, in_raw = float(sum(target) + len(target)), float(sum(raw) + len(raw))
    return np.array(
        [math.floor(1000.0 * math.log((t + 1.0) * in_raw / ((s + 1.0) * in_target))) for t, s in zip(target, raw, strict=True)],
        np.int64,
    )


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_features``, ``weight``."""
    ship(docs.sparkSession)
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sums = []
            for one in as_bytes(batch.column("text")):
                n_words = n_features = weight = 0
                for words, hashes in features(one, longest):
                    n_words += words
                    n_features += len(hashes)
                    weight += int(gain[np.array(hashes, np.int64) % buckets].sum())
                sums.append((n_words, n_features, weight))
            columns = [pa.array([s[i] for s in sums], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight"]
            )

    rows = docs.select(long_id(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: str, key: str = "doc_id"):
    """A Gumbel variate in thousandths, drawn from sha256 of seed, colon and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order) -> DataFrame:
    """``rows`` with ``rank`` from 1 in this order, by a range shuffle and the sizes of its partitions."""
    at = F.col("_at")
    dealt = written(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "ranked",
    ).withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition of the shuffle.
    ahead = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sizes.select("_part", F.coalesce(ahead, F.lit(0)).alias("_ahead")))
    return dealt.join(offsets, "_part").withColumn("rank", F.col("_ahead") + F.col("_at") + 1).drop("_part", "_at", "_ahead")


def resample(
    docs: DataFrame,
    target: DataFrame,
    seed: str = "42",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_features``, ``weight``, ``score``, ``rank`` (null if not drawn), ``n_words``."""
    gain = gains(bucket_counts(target, buckets, longest, text), bucket_counts(docs, buckets, longest, text))
    rows = weighted(docs, gain, longest, key, text).withColumn("score", F.col("weight") + gumbel(seed))
    rows = written(rows, "weighted")
    long_enough = F.col("n_words") >= least_words
    share = max(0.0, 1 - percent / 100 - SLACK)
    all_of = rows.where(long_enough).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("score", share, ACCURACY).alias("least")
    ).first()
    drawn = percent * all_of["n"] // 100
    wanted = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    none = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return rows.withColumn("rank", none).select(*wanted)
    near = long_enough & (F.col("score") >= all_of["least"])
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]
    rank = F.col("rank")
    top = ranked(rows.where(near), order).withColumn("rank", F.when(rank <= drawn, rank))
    return top.select(*wanted).unionByName(rows.where(~near).withColumn("rank", none).select(*wanted))
