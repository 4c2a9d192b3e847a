"""Token ids in a binary file format: canonical, length-limited Huffman codes of global counts.

Documents are sorted by ``doc_id`` in Spark's range partitions, tokenized once, and
kept as blocks of whole documents.
The ids of all blocks are counted, the counts give one code length per id (at most
``LONGEST`` bits, by package-merge), and the lengths give the canonical codes. A
block is coded on its own: its bits, and the bit offset of every ``CHECKPOINT``-th
id. Decoding looks 16 bits up in one table, for all checkpoints of a block at the
same time, so it is vectorised and can start at any checkpoint.

The file format is a folder with Parquet tables: ``codes`` (symbol, bits) and
``blocks`` (block, doc_ids, doc_tokens, n_tokens, bits, checkpoints).
Blocks ascend: the upper half of ``block`` is the place of the range partition, the
lower half the place in it, and ``doc_ids`` ascend within and across blocks.

Defined results: a null or empty text is its end id; rows with equal or null ids
are each coded (null first, equal ones in order of their texts); an empty table
gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetgold.llm.common import release, python_tasks, text_of, written
from fleetgold.llm.tokens import default_vocabulary, encoder

LONGEST = 16
CHECKPOINT = 128
BLOCK_TOKENS = 1 << 19
PART_BITS = 32


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits per symbol of an optimal prefix code with no code above ``longest`` (package-merge); 0 for unused ones."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols need codes above {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    # Level by level, the weights of packages merged with the leaves; remembered is where leaves stand.
    levels: list[np.ndarray] = []
    packages = np.zeros(0)
    for _ in range(longest):
        both = np.concatenate([leaf, packages])
        sort = np.argsort(both, kind="stable")
        levels.append(sort < len(leaf))
        merged = both[sort]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    # From the last level down: the first n items; their packages each stand for two items below.
    take = 2 * len(leaf) - 2
    ranks = np.zeros(len(leaf), np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        ranks[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = ranks
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of every symbol: by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        bits = int(lengths[symbol])
        if bits:
            code <<= bits - before
            codes[symbol], before = code, bits
            code += 1
    return codes


def decode_table(lengths: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """For every value of the next ``longest`` bits: the symbol, and in the lowest byte its bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    runs = (1 << (longest - lengths[order].astype(np.int64))).astype(np.int64)
    table = np.zeros(1 << longest, np.uint32)
    table[: int(runs.sum())] = np.repeat(order.astype(np.uint32) << np.uint32(8) | lengths[order], runs)
    return table


def encode_ids(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, step: int = CHECKPOINT) -> tuple[bytes, np.ndarray]:
    """The bits of ``ids``, most significant first, and the bit offset of every ``step``-th id."""
    if len(ids) % 2:
        last = ids[-1:]
        data, marks = encode_ids(np.append(ids, last), lengths, codes, step)  # cut off again by the number of ids
        return data, marks[: -(-len(ids) // step)]
    wide = lengths[ids].astype(np.uint64).reshape(-1, 2)
    pair = codes[ids].reshape(-1, 2)
    value, width = (pair[:, 0] << wide[:, 1]) | pair[:, 1], wide.sum(1)  # at most 32 bits
    ends = np.cumsum(width).astype(np.int64)
    starts = ends - width.astype(np.int64)
    total = int(ends[-1]) if len(ends) else 0
    word = starts >> 5
    value <<= np.uint64(64) - (starts & 31).astype(np.uint64) - width
    words = np.zeros(total // 32 + 4, np.float64)  # sums of disjoint bits below 2**32: exact
    words += np.bincount(word, (value >> np.uint64(32)).astype(np.float64), len(words))
    words += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))
    return words.astype(np.uint32).astype(">u4").tobytes(), starts[:: step // 2].astype(np.int64)


def decode_ids(
    data: bytes, n: int, checkpoints: np.ndarray, table: np.ndarray,
    step: int = CHECKPOINT, longest: int = LONGEST,
) -> np.ndarray:
    """All ids of a block, one id of every checkpoint's run at a time."""
    words = np.frombuffer(data, ">u4").astype(np.uint64)
    pairs = (words[:-1] << np.uint64(32)) | words[1:]
    pairs = np.append(pairs, np.zeros(1 + step * longest // 32, np.uint64))  # the last run may be shorter than its turns
    out = np.zeros((step, len(checkpoints)), np.uint32)
    at = checkpoints.astype(np.int64)
    unused = np.uint64(64 - longest)
    for i in range(min(step, n)):
        window = pairs.take(at >> 5)
        window <<= (at & 31).view(np.uint64)
        window >>= unused
        found = table.take(window.view(np.int64))
        out[i] = found
        at += found & np.uint32(0xFF)
    return (out >> np.uint32(8)).T.ravel()[:n]


FIELDS = {
    "block": pa.int64(),
    "doc_ids": pa.list_(pa.int64()),
    "doc_tokens": pa.list_(pa.int64()),
    "n_tokens": pa.int64(),
}
RAW = pa.schema([*FIELDS.items(), ("ids", pa.binary())])
RAW_SQL = "block long, doc_ids array<long>, doc_tokens array<long>, n_tokens long, ids binary"


def _batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _blocks(vocabulary: str, end_id: int, block_tokens: int, narrow: str):
    """Tokenize one range partition into blocks of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << PART_BITS
        end = int(end_id).to_bytes(4, "little")
        docs: list[int | None] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return _batch([[block], [docs], [[len(p) for p in parts]], [held], [np.concatenate(parts).tobytes()]], RAW)

        for batch in batches:
            texts = encoder(vocabulary).encode(batch.column("text").to_pylist())
            for doc, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                docs.append(doc)
                parts.append(np.frombuffer(ids + end, "<u4").astype(narrow))
                held += len(parts[-1])
                if held >= block_tokens:
                    yield flush()
                    block, docs, parts, held = block + 1, [], [], 0
        if docs:
            yield flush()

    return run


def _counts(size: int, narrow: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), narrow), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"symbol": pa.array(used, pa.int32()), "n": pa.array(total[used], pa.int64())})

    return run


def write_ids(
    docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 2,
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Encode all ``docs`` into ``folder``, in ascending order of ``doc_id``."""
    spark = docs.sparkSession
    python_tasks(spark)
    vocabulary = vocabulary or default_vocabulary()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    size = max(encoder(vocabulary).size, end_id + 1)
    narrow = "<u2" if size <= 1 << 16 else "<u4"  # of the ids between tokenizing and coding
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    raw = written(ordered.mapInArrow(_blocks(vocabulary, end_id, block_tokens, narrow), RAW_SQL), "token-blocks")
    del ordered
    release(spark)
    python_tasks(spark, 16)  # rows are whole blocks from here on
    # One row per id that occurs: the vocabulary bounds it.
    counts = np.zeros(size, np.int64)
    tallies = raw.select("ids").mapInArrow(_counts(size, narrow), "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    for symbol, n in tallies.toLocalIterator():
        counts[symbol] = n
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    used = [(int(s), int(lengths[s])) for s in np.flatnonzero(lengths)]
    spark.createDataFrame(used, "symbol int, bits int").coalesce(1).write.parquet(f"{folder}/codes")
    coded = pa.schema([*FIELDS.items(), ("bits", pa.binary()), ("checkpoints", pa.list_(pa.int64()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode_ids(np.frombuffer(ids.as_buffer(), narrow), lengths, codes) for ids in batch.column("ids")]
            yield _batch([*(batch.column(n) for n in FIELDS), *zip(*made, strict=True)], coded)

    blocks = raw.mapInArrow(encode, RAW_SQL.replace("ids binary", "bits binary, checkpoints array<long>"))
    blocks.write.parquet(f"{folder}/blocks")


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The decoded blocks of ``folder``: block, doc_ids, doc_tokens, goes_on, n_tokens, ids."""
    lengths_by_symbol = spark.read.parquet(f"{folder}/codes").collect()  # bounded by the vocabulary
    lengths = np.zeros(max((r.symbol for r in lengths_by_symbol), default=0) + 1, np.uint8)
    for r in lengths_by_symbol:
        lengths[r.symbol] = r.bits
    table = decode_table(lengths)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [
                decode_ids(bits.as_py(), n.as_py(), np.array(marks.as_py(), np.int64), table).astype("<u4").tobytes()
                for bits, n, marks in zip(
                    batch.column("bits"), batch.column("n_tokens"), batch.column("checkpoints"), strict=True
                )
            ]
            yield _batch([*(batch.column(n) for n in FIELDS), ids], RAW)

    python_tasks(spark, 16)
    return spark.read.parquet(f"{folder}/blocks").mapInArrow(decode, RAW_SQL)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, decoded: block, doc_id, at (ids before it in its block), n_tokens, ids."""
    schema = pa.schema(
        [("block", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, docs, sizes, _, ids = (batch.column(n)[row].as_py() for n in RAW.names)
                ends = np.cumsum(sizes).tolist()
                begins = [0, *ends[:-1]]
                cut = [ids[4 * a : 4 * b] for a, b in zip(begins, ends, strict=True)]
                yield _batch([[block] * len(docs), docs, begins, sizes, cut], schema)

    return read_blocks(spark, folder).mapInArrow(split, "block long, doc_id long, at long, n_tokens long, ids binary")


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(block, block_start): the ids of all blocks before.

    Running sums in two levels: one row per range partition, then the blocks of one partition.
    """
    sizes = spark.read.parquet(f"{folder}/blocks").select(
        "block", "n_tokens", F.shiftright("block", PART_BITS).alias("part")
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        sizes.groupBy("part")
        .agg(F.sum("n_tokens").alias("part_tokens"))
        .select("part", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)).alias("part_start"))
    )
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("block", (F.col("part_start") + F.col("inside")).alias("block_start"))
    )


def digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. Only short rows are joined."""
    read = read_documents(spark, folder).select("block", "doc_id", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return read.join(block_starts(spark, folder), "block").select(
        "doc_id", (F.col("block_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )
