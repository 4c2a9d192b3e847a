"""Fuzzy line dedup: MinHash of character shingles, banding, exact check, union-find.

The lines of all documents are one collection. Equal lines (white space at the ends
aside) are one class. Every class gets MinHash values of its character shingles;
classes that agree in all values of some band are candidates. With 20 bands of 5 a pair
at the threshold of 0.8 is missed with a chance of 0.04%, at 0.82 of 0.01% and above
0.85 of under 0.001% (``missed``); there is no other search for such pairs. Candidates
are compared exactly, in tiles, and the links between them go to a distributed
union-find. Of each component the line that comes first (smallest doc_id, then line
number) stays; the others go.

Defined results: lines of white space only are neither compared nor dropped; a line
shorter than a shingle is one shingle; null and empty texts have no lines and stay
as they are; null ids come first; different texts under one id (null ids above all) are
different documents, told apart by a hash of the text, and rows that repeat a doc_id and
a text are one place, so both keep the same lines; an empty table gives an empty result. Only ``doc_id``
and ``text`` are read by the comparison, and ``without_repeats`` carries the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgold.llm import tiles
from fleetgold.llm.batches import by_bytes
from fleetgold.llm.common import discard, mix, python_tasks, release, saved, seeds, text_of, written
from fleetgold.llm.graph import components
from fleetgold.llm.shingles import banded, char_shingles, signatures
from fleetgold.operators.skew import BROADCAST_ROW_LIMIT, lookup_join

CHARS = 8
THRESHOLD = 0.8
BANDS = 20
ROWS = 5
#: Bands whose rows are shuffled at the same time; all take their turn, so this bounds disk only.
BANDS_AT_ONCE = 10
#: Bytes of texts whose lines a task holds, characters that are signed at once (their arrays stay in cache), and
#: characters and lines of one block of a tile.
TEXT_BYTES, SIGNED_CHARS, BLOCK_CHARS, BLOCK_TEXTS = 1 << 20, 1 << 16, 3_000_000, 8_192
#: Band values that a task sorts at once.
CHUNK = 1 << 19
#: Lines whose band values are one row.
PACK = 256
#: ASCII white space, which is cut off a line's ends.
ENDS = " \t\n\x0b\x0c\r"
#: Where a line is, in the order by which the first one stays; the text's hash tells texts of one id apart.
PLACE = ("doc_id", "line_no", "text_key")


def text_key(column: str = "text") -> Column:
    """A 64-bit hash of the text: with the doc_id it names a document."""
    return F.xxhash64(text_of(column))


def missed(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The chance that two lines of this Jaccard similarity agree in no band."""
    return (1 - similarity**rows) ** bands


def _signed(lines: list[str], chars: int, bands: int, rows: int) -> np.ndarray:
    """Band values of each line; so many characters at once that the arrays of their shingles stay small."""
    ends = np.cumsum([len(line) for line in lines])
    at, signed = 0, [np.zeros((0, bands), np.uint64)]
    while at < len(lines):
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + SIGNED_CHARS, "right")))
        values = signatures(*char_shingles(lines[at:end], chars), bands * rows)
        signed.append(banded(values, bands))
        at = end
    return np.concatenate(signed)


def _turns(bands: int) -> list[str]:
    """The columns of band values, one for each turn."""
    return [f"bands_{t}" for t in range(len(range(0, bands, BANDS_AT_ONCE)))]


def _lines(chars: int, bands: int, rows: int):
    """One row per line with text; the first of a text (a text without has one, without key) has their number, ``lines``.

    ``node`` and ``rest`` are the halves of the line's MD5. The different lines of a batch have their band values
    in packs, one on the row of its first line: ``nodes`` and a column a turn hold the numbers of all its lines.
    """
    places = [("doc_id", pa.int64()), ("line_no", pa.int32()), ("text_key", pa.int64()), ("lines", pa.int32())]
    halves = [("node", pa.int64()), ("rest", pa.int64())]
    schema = pa.schema([*places, *halves, *((c, pa.binary()) for c in ("nodes", *_turns(bands)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", TEXT_BYTES):
            at, counts, firsts, numbers, keys, found = [], [], [], [], [], {}
            for text in batch.column("text").to_pylist():
                begin = len(keys)
                for number, line in enumerate(text.split("\n")):
                    line = line.strip(ENDS)
                    if line:
                        key = hashlib.md5(line.encode("utf-8", "surrogatepass")).digest()
                        if key not in found:
                            found[key] = line
                            at.append(len(keys))
                        numbers.append(number)
                        keys.append(key)
                firsts.append(begin)
                counts.append(len(keys) - begin)
                if not counts[-1]:
                    numbers.append(None)
                    keys.append(bytes(16))
            numbers = pa.array(numbers, pa.int32())
            empty = numbers.is_null().to_numpy(zero_copy_only=False)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), np.maximum(counts, 1)))
            lines = np.zeros(len(keys), np.int32)
            lines[firsts] = counts
            others = np.ones(len(keys), bool)
            others[firsts] = False
            node, rest = np.frombuffer(b"".join(keys), ">i8").reshape(-1, 2).T.astype(np.int64)
            columns = [batch.column("doc_id").take(owner), numbers, batch.column("text_key").take(owner)]
            columns += [pa.array(lines, mask=others), pa.array(node, mask=empty), pa.array(rest, mask=empty)]
            signed = _signed(list(found.values()), chars, bands, rows).astype(">u8")
            parts = [node[at], *(signed[:, b : b + BANDS_AT_ONCE] for b in range(0, bands, BANDS_AT_ONCE))]
            for part in parts:
                packs: list[bytes | None] = [None] * len(keys)
                for begin in range(0, len(at), PACK):
                    packs[at[begin]] = part[begin : begin + PACK].tobytes()
                columns.append(pa.array(packs, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each text, if they are what their key says."""
    for batch in by_bytes(batches, "text", TEXT_BYTES):
        nodes, roots, found = [], [], []
        for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            lines = text.split("\n")
            for w in wanted:
                line = lines[w["line_no"]].strip(ENDS) if w["line_no"] < len(lines) else ""
                if hashlib.md5(line.encode("utf-8", "surrogatepass")).digest() == w["key"]:
                    nodes.append(w["node"])
                    roots.append(w["root"])
                    found.append(line)
        columns = [pa.array(nodes, pa.int64()), pa.array(roots, pa.int64()), pa.array(found, pa.string())]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.ones(len(nodes), np.int32))], names=["node", "root", "text", "copies"]
        )


def _place_hash(doc_id: np.ndarray, text_key: np.ndarray, line_no: np.ndarray) -> np.ndarray:
    """A 64-bit hash of places (null ids as 0)."""
    return mix(mix(mix(doc_id.view(np.uint64)) ^ text_key.view(np.uint64)) + line_no.astype(np.uint64))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy()


def _bits(power: int):
    """(word, bits) of a map of 2**power bits, with the bit of each place set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _place_hash(*map(_ids, batch.columns)) >> np.uint64(64 - power)
            word, bits = (at >> np.uint64(6)).view(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits)], names=["word", "bits"])

    return run


def _place_map(places: DataFrame) -> tuple[Broadcast, int]:
    """A map of bits with those of the ``places`` (doc_id, text_key, line_no) set, and the power of its size: 16 to 32 bits a place."""
    power = max(10, (16 * places.count()).bit_length())
    found = places.mapInArrow(_bits(power), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (power - 6), np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return places.sparkSession.sparkContext.broadcast(words), power


def _placed(places: Broadcast, power: int):
    """The lines of each text whose place has its bit set, with their keys: those that are wanted, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", TEXT_BYTES):
            texts = batch.column("text").to_pylist()
            counts = np.array([text.count("\n") + 1 for text in texts])
            owner = np.repeat(np.arange(len(texts)), counts)
            number = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
            at = _place_hash(_ids(batch.column("doc_id"))[owner], _ids(batch.column("text_key"))[owner], number) >> np.uint64(64 - power)
            hits = np.flatnonzero((places.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
            found, split = [], (-1, [])
            for text, line in zip(owner[hits].tolist(), number[hits].tolist(), strict=True):
                if text != split[0]:
                    split = text, texts[text].split("\n")
                found.append(split[1][line].strip(ENDS))
            keys = b"".join(hashlib.md5(line.encode("utf-8", "surrogatepass")).digest() for line in found)
            node, rest = np.frombuffer(keys, ">i8").reshape(-1, 2).T.astype(np.int64)
            columns = [pa.array(node), pa.array(rest), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "rest", "text"])

    return run


def _texts_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The text of each class of ``wanted``, once: (node, root, text, copies).

    A few classes go to the texts. Many don't, nor do the texts go to them, which would be a shuffle of the whole
    input: a map of bits does, and what it lets through is joined by the line's key.
    """
    if wanted.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT:
        key = F.unhex(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("half", "rest")])).alias("key")
        of_text = wanted.groupBy("first_doc_id", "first_text_key").agg(  # one document's lines
            F.collect_list(F.struct(F.col("first_line_no").alias("line_no"), key, "node", "root")).alias("wanted")
        )
        own = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("text_key") == F.col("first_text_key"))
        holders = texts.join(F.broadcast(of_text), own).select("text", "wanted")
        fetched = holders.mapInArrow(_picked, "node long, root long, text string, copies int")
    else:
        places = wanted.select("first_doc_id", "first_text_key", "first_line_no")
        found = texts.mapInArrow(_placed(*_place_map(places)), "half long, rest long, text string")
        fetched = lookup_join(found, wanted.select("half", "rest", "node", "root"), ["half", "rest"], "inner")
        fetched = fetched.select("node", "root", "text", F.lit(1).alias("copies"))
    return fetched.dropDuplicates(["node"])


def _runs(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the smallest node of each; and every other node with the smallest one of its key."""
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(nodes, begins) if len(keys) else nodes
    mine = np.repeat(low, np.diff(np.append(begins, len(keys))))
    other = nodes != mine
    return keys[begins], low, nodes[other], mine[other]


def _batch(node: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(low, pa.int64())], names=["node", "low"])


def _deal(first_band: int, buckets: int):
    """Band values of classes with their nodes, in parcels by ranges of values; equal ones of a chunk are linked at once.

    A row has one class, or a pack of classes: their nodes and band values one after the other.
    A parcel is (bucket, linked, pairs of 64-bit numbers): value and smallest node, or, if ``linked``, node and smallest node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)
        raws, nodes, held = [], [], 0

        def out() -> pa.RecordBatch:
            classes = np.concatenate(nodes)
            values = np.frombuffer(b"".join(raws), ">u8").reshape(len(classes), -1).T.astype(np.uint64)
            keys = [mix(v ^ seeds(1, 100 + first_band + k)[0]) for k, v in enumerate(values)]
            value, low, node, mine = _runs(np.concatenate(keys), np.tile(classes, len(keys)))
            cuts = np.concatenate([[0], np.searchsorted(value, edges.astype(np.uint64)), [len(value)]])
            raw = np.column_stack([value.view(np.int64), low]).tobytes()
            parcels = [(b, False, raw[16 * c : 16 * d]) for b, (c, d) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if d > c]
            if len(node):
                parcels.append((int(node[0]) % buckets, True, np.column_stack([node, mine]).tobytes()))
            columns = zip(*parcels, strict=True)
            types = (pa.int32(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "linked", "pairs"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node")
            packed = pa.types.is_binary(node.type)
            nodes.append(np.frombuffer(b"".join(node.to_pylist()), np.int64) if packed else node.to_numpy())
            raws.append(b"".join(batch.column("bands").to_pylist()))
            held += len(raws[-1]) // 8
            if held >= CHUNK:
                yield out()
                raws, nodes, held = [], [], 0
        if held:
            yield out()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, low) for the nodes of some buckets that have a band value in common, and the links that came along."""
    met: list[np.ndarray] = []
    for batch in batches:
        for linked, raw in zip(batch.column("linked").to_pylist(), batch.column("pairs"), strict=True):
            pairs = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, 2)
            if linked:
                yield _batch(pairs[:, 0], pairs[:, 1])
            else:
                met.append(pairs)
    if met:
        both = np.concatenate(met)
        _, _, node, low = _runs(both[:, 0], both[:, 1])
        yield _batch(node, low)


def _links(classes: DataFrame, turn: int, first_band: int, node: str = "node") -> DataFrame:
    """(node, low) of classes that agree in one of a turn's bands with another; low is the smallest of those that met.

    One shuffle of two numbers a band and class, in parcels. A value that very many classes have is one pair for each
    chunk of classes by then, not one for each class.
    """
    buckets = 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parcels = classes.select(F.col(node).alias("node"), F.col(f"bands_{turn}").alias("bands")).mapInArrow(
        _deal(first_band, buckets), "bucket int, linked boolean, pairs binary"
    )
    return parcels.repartition("bucket").mapInArrow(_meet, "node long, low long")


def _judged(
    docs: DataFrame, chars: int = CHARS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines of ``docs`` (``written``: to be discarded); the nodes of those that have a copy or a candidate; these, with what stays for them.

    Until the lines with a copy or a candidate are known, a class goes by half of its key, ``node``: two that share it
    are candidates of each other at worst, and are compared.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), text_of().alias("text"))
    made = "doc_id long, line_no int, text_key long, lines int, node long, rest long"
    lines = written(
        texts.mapInArrow(_lines(chars, bands, rows), ", ".join([made, *(f"{c} binary" for c in ("nodes", *_turns(bands)))])), "lines"
    )
    links = []
    for turn, column in enumerate(_turns(bands)):
        links.append(saved(_links(lines.where(F.col(column).isNotNull()), turn, turn * BANDS_AT_ONCE, "nodes")))
        release(spark)
    found = components(reduce(DataFrame.union, links), "node", "low")
    del links
    with_text = lines.where("node is not null").select(*PLACE, "node", "rest")
    copied = with_text.groupBy("node", "rest").agg(F.count("*").alias("copies")).where("copies > 1")
    none = F.lit(None).cast("long").alias("root")
    nodes = saved(copied.select("node", none).union(found.select("node", "root")).groupBy("node").agg(F.max("root").alias("root")))
    release(spark)
    some = saved(lookup_join(with_text, nodes, ["node"], "inner"))
    release(spark)
    classes = saved(
        some.groupBy("node", "rest")
        .agg(F.min(F.struct(*PLACE)).alias("first"), F.max("root").alias("root"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    release(spark)
    first = [F.col(f"first.{c}").alias(f"first_{c}") for c in PLACE]
    wanted = classes.where("root is not null").select(F.col("class").alias("node"), "root", F.col("node").alias("half"), "rest", *first)
    chosen = saved(_texts_of(wanted, texts))
    release(spark)
    shingles = lambda t: char_shingles(t, chars)
    compared = tiles.compare(chosen, shingles, threshold, block_chars=BLOCK_CHARS, block_texts=BLOCK_TEXTS, connect=True)
    compared = compared.where("links > 0").select("node", "reached")
    roots = components(compared, "node", "reached").withColumnRenamed("node", "class")
    placed = classes.drop("root").join(roots, "class", "left")
    stays = placed.where("root is not null").groupBy("root").agg(F.min("first").alias("stays"))
    index = lookup_join(placed, stays, ["root"], "left").select("node", "rest", F.coalesce("stays", "first").alias("stays"))
    return lines, nodes, lookup_join(some.select(*PLACE, "node", "rest"), index, ["node", "rest"], "inner")


def _marks(stays: Column) -> list[Column]:
    return [stays["doc_id"].alias("class_doc"), stays["line_no"].alias("class_line"), F.struct(*PLACE).eqNullSafe(stays).alias("kept")]


def marked_lines(docs: DataFrame, **settings) -> DataFrame:
    """One row per line with text: doc_id, line_no (from 0), text_key, class_doc, class_line (the line that stays for it), kept."""
    lines, nodes, judged = _judged(docs, **settings)
    alone = lookup_join(lines.where("node is not null").select(*PLACE, "node"), nodes, ["node"], "left_anti")
    return judged.select(*PLACE, *_marks(F.col("stays"))).union(alone.select(*PLACE, *_marks(F.struct(*PLACE))))


def _listed(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_key, n_lines; one per document) with the lines that go (doc_id, text_key, line_no, class_doc, class_line)."""
    lines = gone.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.array_sort(F.collect_set(F.struct("line_no", "class_doc", "class_line"))).alias("_gone")  # one document's lines
    )
    own = rows.doc_id.eqNullSafe(F.col("_id")) & (rows.text_key == F.col("_key"))
    none = F.array().cast("array<struct<line_no:int,class_doc:long,class_line:int>>")
    placed = rows.join(lines, own, "left").withColumn("_gone", F.coalesce("_gone", none))
    return placed.select(
        "doc_id",
        "n_lines",
        (F.col("n_lines") - F.size("_gone")).alias("n_kept"),
        F.transform("_gone", lambda x: x["line_no"]).alias("dropped_lines"),
        F.transform("_gone", lambda x: x["class_doc"]).alias("class_docs"),
        F.transform("_gone", lambda x: x["class_line"]).alias("class_lines"),
        "text_key",
    )


def per_document(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """One row per document (doc_id and text): n_lines with text, n_kept, the numbers of the lines that go, what stays for them.

    ``class_docs`` and ``class_lines`` name the line that stays for each of ``dropped_lines``, in the same order, so
    all lines of a component can be told by where they point. Rows that repeat a doc_id and a text are one document.
    """
    places = marked.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.count("*").alias("_n"))
    rows = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key")).agg(F.count("*").alias("_rows"))
    own = rows.doc_id.eqNullSafe(F.col("_id")) & (rows.text_key == F.col("_key"))
    n_lines = F.coalesce(F.expr("_n div _rows"), F.lit(0).cast("long")).alias("n_lines")
    return _listed(rows.join(places, own, "left").select("doc_id", "text_key", n_lines), marked.where("not kept"))


def _gone(judged: DataFrame) -> DataFrame:
    return judged.select(*PLACE, *_marks(F.col("stays"))).where("not kept").drop("kept")


def dedup_documents(docs: DataFrame, **settings) -> DataFrame:
    """``per_document`` of ``marked_lines``; lines that stay are only counted."""
    lines, _, judged = _judged(docs, **settings)
    gone = saved(_gone(judged))
    n_lines = F.max("lines").cast("long").alias("n_lines")
    rows = saved(lines.where("lines is not null").groupBy("doc_id", "text_key").agg(n_lines))
    discard(lines)
    release(docs.sparkSession)
    return _listed(rows, gone)


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with only the kept lines in ``text``, and without the documents that lost all their lines."""
    lines, _, judged = _judged(docs, **settings)
    gone = saved(_gone(judged))
    discard(lines)
    release(docs.sparkSession)
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_set("line_no").alias("_gone")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    own = F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (text_key("_row.text") == F.col("_key"))
    joined = rows.join(gone, own, "left")
    kept_text = F.array_join(
        F.filter(F.split("_row.text", "\n", -1), lambda line, i: ~F.array_contains("_gone", i)), "\n"
    )
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(kept_text)
    some = F.col("_gone").isNull() | (F.trim(kept_text, F.lit(ENDS)) != "")  # a line with text
    return joined.where(some).select(
        *[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    )
