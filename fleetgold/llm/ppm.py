"""Language-model scoring by prediction by partial matching over bytes, trained on the corpus.

A text is its words in lower case (A to Z), joined by single spaces, and an end byte. The
model is the trie of all contexts of up to ``ORDER`` bytes in the training texts, with
counts of the bytes that follow; a shorter context counts a byte once for every longer
one in which it follows (update exclusion). A byte is predicted by the longest context
seen, with the chance (2n - 1) / 2T; when it did not follow there, the model escapes to
the next shorter one, with the chance D / 2T for D different bytes among T (escape method
D), and bytes that the longer context has seen are excluded from the shorter one. Below the empty context all bytes
not yet excluded are equal. As every byte seen after a context was seen after its
suffixes, what an escape excludes depends on the longer context alone, so the trie
holds, per context, the sums that are left after exclusion, and a text is scored with
sorted lookups instead of a walk.

Counting: each task counts the runs of ``ORDER + 1`` bytes of its texts, and the words, and
hands on one sorted block per part; the parts (by the last two bytes of a context, and
by word hash) are added up in Spark. All shorter contexts of two bytes or more are in
the same part as the longer ones; the shorter ones are a table of at most 256 x 256.

Scoring: the parts are put together to shards of at most ``SHARD_BYTES``, and the texts
are scanned once per shard; each scan adds the positions and words whose part the
shard has. So a task holds one shard, however large the model is, and the driver
passes on one shard at a time. Words are told apart by 64-bit hashes.

Defined results: a null or empty text is its end alone; repeated rows are scored each;
no training text gives equal chances to all bytes and a base score of 0; an empty
table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgold.llm.common import python_tasks, saved, text_of
from fleetgold.llm.shingles import word_shingles

ORDER = 5
SHARD_BYTES = 96_000_000
#: Positions counted at a time.
CHUNK = 4_000_000
END = 10
BASE_ADDED = 0.1
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
U8 = np.uint64(8)


def stream(text: str | None) -> bytes:
    """The bytes that the model predicts."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()) + bytes([END])


def grams(streams: list[bytes], order: int) -> np.ndarray:
    """For every byte of the streams: the ``order`` bytes before it and itself, as one number."""
    pad = bytes([END]) * order
    data = np.frombuffer(b"".join(pad + s for s in streams), np.uint8).astype(np.uint64)
    out = data.copy()
    for k in range(1, order + 1):
        out[k:] |= data[:-k] << np.uint64(8 * k)
    lengths = np.array([len(s) for s in streams], np.int64)
    firsts = np.cumsum(lengths + order) - lengths
    keep = np.ones(len(data), bool)
    for k in range(1, order + 1):
        keep[firsts - k] = False
    return out[keep]


def parts_of_contexts(parts: int) -> np.ndarray:
    """The part of every pair of bytes."""
    pairs = np.arange(1 << 16, dtype=np.uint64)
    return (((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)


def words_of(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_shingles([s[:-1].decode("utf-8", "surrogatepass") for s in streams], 1)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


BLOCKS = pa.schema([("part", pa.int64()), ("words", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])
BLOCKS_SQL = "part long, words boolean, keys binary, counts binary"


def _count(order: int, parts: int):
    part_of = parts_of_contexts(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {False: (np.zeros(0, np.uint64), np.zeros(0, np.int64)), True: (np.zeros(0, np.uint64), np.zeros(0, np.int64))}
        waiting: list[bytes] = []

        def take() -> None:
            for words, keys in ((False, grams(waiting, order)), (True, words_of(waiting)[0])):
                new, counts = np.unique(keys, return_counts=True)
                old = held[words]
                held[words] = added(np.concatenate([old[0], new]), np.concatenate([old[1], counts]))
            waiting.clear()

        docs = size = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                waiting.append(stream(text))
                size += len(waiting[-1])
                docs += 1
                if size >= CHUNK:
                    take()
                    size = 0
        if waiting:
            take()
        for words, (keys, counts) in held.items():
            owner = keys % np.uint64(parts) if words else part_of[(keys >> U8) & np.uint64(0xFFFF)]
            order_ = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order_], np.arange(1, parts))
            rows = [
                (p, words, k.tobytes(), c.tobytes())
                for p, (k, c) in enumerate(zip(np.split(keys[order_], cuts), np.split(counts[order_], cuts), strict=True))
                if len(k)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(BLOCKS.types)], schema=BLOCKS
            )
        # The texts' number travels as a block of its own: the count of ends.
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip((-1, True, b"", np.int64(docs).tobytes()), BLOCKS.types, strict=True)],
            schema=BLOCKS,
        )

    return run


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    keys = np.frombuffer(b"".join(frame["keys"]), np.uint64)
    counts = np.frombuffer(b"".join(frame["counts"]), np.int64)
    if frame["part"].iat[0] < 0:
        keys, counts = np.zeros(0, np.uint64), np.array([counts.sum()])
    else:
        keys, counts = added(keys, counts)
    row = {"part": frame["part"].iat[0], "words": frame["words"].iat[0], "keys": keys.tobytes(), "counts": counts.tobytes()}
    return pd.DataFrame([row | {"n": len(keys), "total": int(counts.sum())}])


def tagged(keys: np.ndarray, order: int) -> np.ndarray:
    """Keys of one order, apart from those of all other orders."""
    return keys | np.uint64(order << 56)


class Level:
    """All contexts of one length: what followed them, in half counts (2n - 1, and 1 for the escape)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, 2.0 * counts - 1
        contexts = keys >> U8
        self.starts = np.flatnonzero(np.concatenate([[True], contexts[1:] != contexts[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = contexts[self.starts]
        self.different = np.diff(np.append(self.starts, len(keys))).astype(np.float64)
        self.total = np.add.reduceat(self.counts, self.starts) if len(keys) else np.zeros(0)
        self.owner = np.repeat(np.arange(len(self.starts)), self.different.astype(np.int64))

    def shorter(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The next shorter runs; each counts once for every longer run that ends in it."""
        return added(self.keys & np.uint64((1 << 8 * order) - 1), np.ones(len(self.keys), np.int64))


def tables(top: Level, order: int, lowest: int, below: Level | None) -> tuple[np.ndarray, ...]:
    """Lookup tables for contexts of ``lowest`` to ``order`` bytes; ``below`` is the level under the lowest."""
    gram_keys, gram_logs, context_keys, context_logs = [], [], [], []
    level = top
    for k in range(order, lowest - 1, -1):
        lower = Level(*level.shorter(k)) if k > lowest else below
        gram_keys.append(tagged(level.keys, k))
        gram_logs.append(np.log10(level.counts))
        whole = level.total + level.different
        escape = np.log10(level.different / whole)
        left, after = np.zeros(len(whole)), np.zeros(len(whole))
        if lower is not None and len(whole):
            # What the next shorter context has left when the bytes seen here are excluded.
            at = np.searchsorted(lower.keys, level.keys & np.uint64((1 << 8 * k) - 1))
            excluded = np.bincount(level.owner, lower.counts[at], len(whole))
            parent = lower.owner[at[level.starts]]
            different = lower.different[parent] - level.different
            rest = lower.total[parent] - excluded + different
            left = np.log10(np.maximum(rest, 1))
            after = np.where(different > 0, np.log10(np.maximum(different, 1)) - left, 0.0)
        context_keys.append(tagged(level.contexts, k))
        context_logs.append(np.stack([np.log10(whole), escape, left, after], 1))
        level = lower
    joined = [np.concatenate(x) for x in (gram_keys, gram_logs, context_keys, context_logs)]
    by_gram, by_context = np.argsort(joined[0]), np.argsort(joined[2])
    return joined[0][by_gram], joined[1][by_gram], joined[2][by_context], joined[3][by_context]


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log_chances(runs: np.ndarray, order: int, shard: tuple[np.ndarray, ...], base: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 of the chance of the last byte of each run (``order`` bytes and itself)."""
    out = np.zeros(len(runs))
    above = np.zeros(len(runs), bool)  # a longer context was seen; then, after exclusion:
    left = np.zeros(len(runs))  # log10 of what this level has left,
    leave = np.zeros(len(runs))  # log10 of the chance to escape from it
    still = np.arange(len(runs))
    for k in range(order, -1, -1):
        gram_keys, gram_logs, context_keys, context_logs = shard if k >= 2 else base
        run = runs[still] & np.uint64((1 << 8 * (k + 1)) - 1)
        at, hit = find(gram_keys, tagged(run, k))
        where, known = find(context_keys, tagged(run >> U8, k))
        logs = context_logs[where] if len(context_logs) else np.zeros((len(run), 4))
        whole = np.where(above, left, logs[:, 0])
        if hit.any():
            out[still[hit]] += gram_logs[at[hit]] - whole[hit]
        escape = np.where(above, leave, np.where(known, logs[:, 1], 0.0))
        miss = ~hit
        out[still[miss]] += escape[miss]
        left, leave = np.where(known, logs[:, 2], left)[miss], np.where(known, logs[:, 3], leave)[miss]
        above, still = (above | known)[miss], still[miss]
        if not len(still):
            return out
    # Below the empty context: all bytes that never occurred are equal.
    never = 256 - int(np.searchsorted(base[0], np.uint64(1 << 56)))
    out[still] -= math.log10(max(never, 1))
    return out


class Model:
    """Counted blocks of the parts (a saved DataFrame), the short contexts, and the word totals."""

    def __init__(self, blocks: DataFrame, order: int, parts: int, shard_bytes: int):
        self.blocks, self.order, self.parts = blocks, order, parts
        sizes = blocks.select("part", "words", "n", "total").where("part >= 0").collect()  # one short row per part
        ends = sum(int(r.total) for r in blocks.where("part < 0").select("total").collect())
        self.tokens = sum(int(r.total) for r in sizes if r.words) + ends
        self.different = sum(int(r.n) for r in sizes if r.words) + (ends > 0)
        self.ends = ends
        self.short = self._short_counts()
        self.base = tables(Level(*self.short), 1, 0, None)
        weight = {p: 0 for p in range(parts)}
        for r in sizes:
            weight[r.part] += int(r.n) * (16 if r.words else 48)
        self.shards: list[list[int]] = [[]]
        held = 0
        for p in range(parts):
            if self.shards[-1] and held + weight[p] > shard_bytes:
                self.shards.append([])
                held = 0
            self.shards[-1].append(p)
            held += weight[p]

    def _short_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of (byte, next byte): at most 65536 rows, added up by Spark."""
        order = self.order

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                    k, c = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                    for shorter in range(order, 1, -1):
                        k, c = Level(k, c).shorter(shorter)
                    yield pa.RecordBatch.from_pydict({"pair": pa.array(k.astype(np.int64)), "n": pa.array(c, pa.int64())})

        found = self.blocks.where("part >= 0 and not words").select("keys", "counts")
        rows = found.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
        rows.sort()
        return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)

    def shard(self, parts: list[int]) -> tuple:
        """The lookup tables of some parts: built on the executors, at most a shard of them here."""
        order, short = self.order, self.short

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for words, keys, counts in zip(*(batch.column(n).to_pylist() for n in ("words", "keys", "counts")), strict=True):
                    keys, counts = np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)
                    if words:
                        made = [keys, counts, keys[:0], keys[:0]]
                    else:
                        made = list(tables(Level(keys, counts), order, 2, Level(*short)))
                        made[1], made[3] = made[1].astype(np.float32), made[3].astype(np.float32)
                    yield pa.RecordBatch.from_pydict(
                        {"words": pa.array([words])} | {f"t{i}": pa.array([m.tobytes()], pa.binary()) for i, m in enumerate(made)}
                    )

        wanted = self.blocks.where(F.col("part").isin(parts)).select("words", "keys", "counts")
        built = wanted.mapInArrow(build, "words boolean, t0 binary, t1 binary, t2 binary, t3 binary")
        text, words = ([], [], [], []), ([], [])
        for row in built.collect():
            for i, kind in enumerate((np.uint64, np.int64) if row.words else (np.uint64, np.float32, np.uint64, np.float32)):
                (words if row.words else text)[i].append(np.frombuffer(row[i + 1], kind))
        joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip((*text, *words), (np.uint64, np.float32, np.uint64, np.float32, np.uint64, np.int64), strict=True)]
        joined[3] = joined[3].reshape(-1, 4)
        for keys, values in ((0, 1), (2, 3), (4, 5)):
            by = np.argsort(joined[keys])
            joined[keys], joined[values] = joined[keys][by], joined[values][by]
        return tuple(joined[:4]), tuple(joined[4:])


def train(docs: DataFrame, order: int = ORDER, shard_bytes: int = SHARD_BYTES, parts: int | None = None) -> Model:
    """Count all of ``docs``."""
    python_tasks(docs.sparkSession)
    parts = parts or max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counted = docs.select(text_of().alias("text")).mapInArrow(_count(order, parts), BLOCKS_SQL)
    added_up = counted.groupBy("part", "words").applyInPandas(_add_up, f"{BLOCKS_SQL}, n long, total long")
    return Model(saved(added_up), order, parts, shard_bytes)


def _score(model: Model, parts: list[int], tables_, first: bool):
    order, base, tokens = model.order, model.base, model.tokens
    here = np.zeros(model.parts, bool)
    here[parts] = True
    part_of, n_parts, ends = parts_of_contexts(model.parts), model.parts, model.ends
    bottom = math.log10(tokens + BASE_ADDED * (model.different + 1)) if tokens else math.log10(BASE_ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, (word_keys, word_counts) = tables_.value
        for batch in batches:
            streams = [stream(t) for t in batch.column("text").to_pylist()]
            lengths = np.array([len(s) for s in streams], np.int64)
            doc = np.repeat(np.arange(len(streams)), lengths)
            runs = grams(streams, order)
            mine = here[part_of[(runs >> U8) & np.uint64(0xFFFF)]]
            different, place = np.unique(runs[mine], return_inverse=True)
            score = np.bincount(doc[mine], log_chances(different, order, shard, base)[place], len(streams)).astype(float)
            words, n_words = words_of(streams)
            owner = np.repeat(np.arange(len(streams)), n_words)
            held = here[(words % np.uint64(n_parts)).astype(np.int64)]
            at, known = find(word_keys, words[held])
            count = np.where(known, word_counts[at] if len(word_counts) else 0, 0)
            logs = np.log10(count + BASE_ADDED) - bottom
            base_score = np.bincount(owner[held], logs, len(streams)).astype(float)
            n_known = np.bincount(owner[held], known, len(streams)).astype(np.int64)
            if first:  # every text's end token, once
                base_score += math.log10(ends + BASE_ADDED) - bottom
                n_known += ends > 0
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "key": batch.column("key"),
                    "n_tokens": pa.array(n_words.astype(np.int64) + 1),
                    "n_known": pa.array(n_known),
                    "base_score": pa.array(base_score, pa.float64()),
                    "score": pa.array(score, pa.float64()),
                }
            )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    python_tasks(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    several = len(model.shards) > 1
    key = F.md5(text_of().cast("binary")) if several else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text_of().alias("text"))
    schema = "doc_id long, key string, n_tokens long, n_known long, base_score double, score double"
    scans = []
    for i, parts in enumerate(model.shards):
        scans.append(texts.mapInArrow(_score(model, parts, context.broadcast(model.shard(parts)), i == 0), schema))
        if several:
            scans[-1] = saved(scans[-1])
    if several:
        # Equal rows have equal sums in every scan; the number of them is how often each scan saw them.
        rows = F.count("*") / len(scans)
        sums = [(F.sum(c) / rows).alias(c) for c in ("n_known", "base_score", "score")]
        summed = reduce(DataFrame.unionByName, scans).groupBy("doc_id", "key").agg(
            F.first("n_tokens").alias("n_tokens"), rows.cast("long").alias("rows"), *sums
        )
        result = summed.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    else:
        result = scans[0]
    return result.select(
        "doc_id", "n_tokens", F.col("n_known").cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def trained_scores(docs: DataFrame, learn: Column, **settings) -> DataFrame:
    """Scores of all ``docs`` by a model of those where ``learn`` holds."""
    return score(docs, train(docs.where(learn), **settings))
