"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text becomes a few statistics (shares of upper case, digits and
symbols, repetition of words, pairs and lines, word lengths), each transformed
towards a bell shape. Each class gets a mean and a covariance, shrunk towards the
covariance of both classes and towards a round one. The score is the probability
from the difference of the two log-densities: Mahalanobis distances by cached
Cholesky factors, log-determinants and the class shares.

Learning needs only counts, sums and sums of products per class, which Spark adds
up over all labelled rows given, so there is no sample and no row limit. The
driver sees one small matrix per class.

Defined results: null and empty texts have the statistics of an empty text and get
a score like any other; labels that are null or have no document are left out;
repeated rows are scored each and repeated labels count each; with labels of one
class only every score is that class, with none it is 0.5; an empty table gives an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgold.llm.common import saved, python_tasks, text_of
from fleetgold.operators.skew import broadcast_checked

NAMES = (
    "upper", "digits", "symbols", "bare", "tails", "word_length", "word_spread", "word_types", "pair_types",
    "commonest", "line_types", "longest_word", "byte_entropy", "stops",
)
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
SPACE = np.zeros(256, bool)
SPACE[9:14] = SPACE[32] = True
STOPS = frozenset(b".,;:")
#: How many labels of each class a document has.
TIMES = ("bad", "good")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, visible = int(counts[LETTER].sum()), int(counts[~SPACE].sum())
    upper, digits = int(counts[UPPER].sum()), int(counts[DIGIT].sum())
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    shares = counts[counts > 0] / len(raw)
    tally = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    ends = [w[-1] for w in words]
    bare = sum(1 for w in words if not LETTER[w[0]] and not DIGIT[w[0]] and len(w) < 4)
    tails = sum(1 for e in ends if e < 128 and not LETTER[e] and not DIGIT[e] and e not in STOPS)
    root = lambda part, whole: math.sqrt(part / whole) if whole else 0.0
    return [
        root(upper, letters),
        root(digits, visible),
        root(visible - letters - digits, visible),
        root(bare, n),
        root(tails, n),
        math.log(visible / n),
        math.log1p(float(lengths.std())),
        math.log(len(tally) / n) / math.log(n + 2),
        math.log((pairs + 1) / n) / math.log(n + 2),
        root(tally.most_common(1)[0][1] - 1, n + 5),
        root(len(lines) - len(set(lines)), len(lines) + 3),
        math.log1p(math.log1p(float(lengths.max()))),
        float(-(shares * np.log2(shares)).sum()) / 8,
        root(sum(1 for e in ends if e in STOPS), n),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) for every row of ``docs``."""
    python_tasks(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t) for t in batch.column("text").to_pylist()], schema.field("stats").type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, stats array<double>"
    )


@dataclass(frozen=True)
class Discriminant:
    """Class shares, means and inverse Cholesky factors; ``score`` needs nothing else."""

    share: tuple[float, float]
    means: np.ndarray | None = None
    inverse: np.ndarray | None = None
    log_det: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share[1])
        logs = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.inverse[k].T
            logs.append(math.log(self.share[k]) - 0.5 * (z * z).sum(1) - 0.5 * self.log_det[k])
        return 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of ``stats`` by ``label`` (0 or 1), added up by Spark.

    ``labelled`` may have ``text`` instead of ``stats``, which are then made in the same task, and instead of ``label`` the
    number of labels of each class, ``TIMES``. Each task hands on one row of sums per class; the driver gets one entry per
    class and matrix cell.
    """
    d = len(NAMES)
    given = "stats" if "stats" in labelled.columns else "text"
    if "label" in labelled.columns:
        labelled = labelled.withColumns({c: (F.col("label") == k).cast("long") for k, c in enumerate(TIMES)})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            stats = batch.column(given).to_pylist()
            x = np.array(stats if given == "stats" else [statistics(t) for t in stats], float).reshape(-1, d)
            x = np.hstack([np.ones((len(x), 1)), x])
            for k, name in enumerate(TIMES):
                times = np.array(batch.column(name).to_pylist(), np.int64)
                own, times = x[times > 0], times[times > 0]
                sums[k] += (own * times[:, None]).T @ own
        yield pa.RecordBatch.from_pydict(
            {
                "cell": pa.array(np.arange(sums.size), pa.int32()),
                "value": pa.array(sums.ravel(), pa.float64()),
            }
        )

    cells = labelled.select(given, *TIMES).mapInArrow(partial, "cell int, value double")
    sums = np.zeros(2 * (d + 1) * (d + 1))
    for cell, value in cells.groupBy("cell").agg(F.sum("value")).collect():
        sums[cell] = value
    found = {}
    for k, m in enumerate(sums.reshape(2, d + 1, d + 1)):
        if m[0, 0] > 0:
            mean = m[0, 1:] / m[0, 0]
            found[k] = (float(m[0, 0]), mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    return found


def fit(labelled: DataFrame, pooled: float = 0.3, round_: float = 0.05, floor: float = 1e-3) -> Discriminant:
    """Learn from ``labelled`` (label 0 or 1, stats; see ``moments``).

    ``pooled`` is the part of each covariance taken from both classes together,
    ``round_`` the part taken from a diagonal of the pooled variances; ``floor`` is the
    least standard deviation of a statistic.
    """
    found = moments(labelled)
    if len(found) < 2:
        share = 0.5 if not found else float(next(iter(found)))
        return Discriminant((1 - share, share))
    total = sum(n for n, _, _ in found.values())
    both = sum(n * c for n, _, c in found.values()) / total
    diagonal = np.diag(np.diag(both))
    means, inverse, log_det = [], [], []
    for k in (0, 1):
        n, mean, own = found[k]
        mixed = (1 - pooled) * own + pooled * both
        mixed = (1 - round_) * mixed + round_ * diagonal + floor**2 * np.eye(len(NAMES))
        factor = np.linalg.cholesky(mixed)
        means.append(mean)
        inverse.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    share = found[1][0] / total
    return Discriminant((1 - share, share), np.array(means), np.array(inverse), np.array(log_det))


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) for every row of ``stats``."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("stats").to_pylist(), float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], schema=schema)

    return stats.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """(doc_id, score) of all ``docs``, learned from ``labels`` (doc_id, quality) where ``learn`` holds of doc_id."""
    stats = saved(with_statistics(docs))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    usable = usable.where("label in (0, 1)")
    if learn is not None:
        usable = usable.where(learn)
    return scored(stats, fit(stats.join(usable, "doc_id")))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> Discriminant:
    """Learn from all documents that ``labels`` (doc_id, quality) has, where ``learn`` holds of doc_id.

    The texts meet their labels before Python, which takes one step: each further one in a stage is one more worker a
    core, and workers stay.
    """
    python_tasks(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
    usable = usable.where("label in (0, 1)")
    if learn is not None:
        usable = usable.withColumnRenamed("id", "doc_id").where(learn).withColumnRenamed("doc_id", "id")
    times = usable.groupBy("id").agg(*[F.count(F.when(F.col("label") == k, 1)).alias(c) for k, c in enumerate(TIMES)])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return fit(texts.join(broadcast_checked(times), F.col("doc_id") == F.col("id")))


def keep_good(docs: DataFrame, model: Discriminant, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``; no join, one pass."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            x = np.array([statistics(t) for t in batch.column(at).to_pylist()], float).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
