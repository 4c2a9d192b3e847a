"""Fill-in-middle: cut texts at unit ends found by arithmetic on 64-bit words, and reorder the parts.

A unit is a run of ASCII letters or one other character. The UTF-8 bytes of a batch
are seen as little-endian 64-bit words. Arithmetic on whole words sets the high bit
of every byte that is a letter and of every continuation byte; shifted by one byte
they tell where a unit ends: at a byte whose successor is no continuation byte, unless both are
letters. ``bitwise_count`` per word and a running sum give the rank of every
place. The byte behind a text's k-th unit is found by a binary search for its word,
and inside the word by prefix sums of the marks, which one multiplication makes.

A text of n units becomes prefix, middle and suffix by two seeded cuts from 0 to n. Form
``psm`` is ``<P>prefix<S>suffix<M>middle``, ``spm`` is ``<S>suffix<P>prefix<M>middle``,
``plain`` is the text as it is: for empty texts, those that contain a marker, and a
seeded share. ``restored`` gives the text back from output and form.

One pass in Arrow batches, no shuffle; a worker holds about 4 MB of texts, or one longer text,
at a time. Defined results: a null text is empty; a null id is drawn as empty text; repeated rows
give equal rows; an empty table gives an empty result; only id and text are read, so other columns
may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgold.llm.batches import by_bytes, long_id
from fleetgold.llm.common import ship, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
#: Words whose marks are made at once.
BLOCK = 1 << 16


def _each(byte: int) -> np.uint64:
    return np.uint64(byte) * ONES


def _letters(words: np.ndarray) -> np.ndarray:
    """High bit of every byte that is A-Z or a-z."""
    low = (words | _each(0x20)) & ~HIGH
    return (low + _each(0x80 - ord("a"))) & ~(low + _each(0x7F - ord("z"))) & ~words & HIGH


def _continuing(words: np.ndarray) -> np.ndarray:
    """High bit of every byte that continues a character: 10xxxxxx."""
    return words & ~(words << np.uint64(1)) & HIGH


def _next(marks: np.ndarray) -> np.ndarray:
    """Each byte's successor's mark; the last word only lends its first byte."""
    return (marks[:-1] >> np.uint64(8)) | (marks[1:] << np.uint64(56))


class Units:
    """Ends of units in joined texts; ``bounds`` are the texts' begins and the last one's end."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n = len(data) // 8 + 1
        padded = np.zeros((n + 1) * 8, np.uint8)
        padded[: len(data)] = data
        words = padded.view("<u8")
        self.marks = np.empty(n, "<u8")
        for at in range(0, n, BLOCK):
            part = words[at : min(at + BLOCK, n) + 1]
            letters, continuing = _letters(part), _continuing(part)
            inside = _next(continuing) | (letters[:-1] & _next(letters))
            self.marks[at : at + BLOCK] = ~inside & HIGH
        places = self.marks.view(np.uint8)
        places[len(data) :] = 0
        places[bounds[1:][np.diff(bounds) > 0] - 1] = 0x80  # a text's end ends its last unit
        self.before = np.zeros(n + 1, np.int64)
        np.cumsum(np.bitwise_count(self.marks), out=self.before[1:])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Units that end before each byte place."""
        word, byte = places >> 3, (places & 7).astype(np.uint64)
        below = (np.uint64(1) << (byte * np.uint64(8))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def behind(self, k: np.ndarray) -> np.ndarray:
        """Byte place behind the k-th unit, k from 1."""
        word = np.searchsorted(self.before, k, "left") - 1
        within = (k - self.before[word]).astype(np.uint64)
        sums = (self.marks[word] >> np.uint64(7)) * ONES  # byte j: marks in bytes 0 to j
        reached = ((sums | HIGH) - within * ONES) & HIGH
        return word * 8 + 9 - np.bitwise_count(reached)


def cut(data: np.ndarray, bounds: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the byte places of its two cuts; ``draws`` has two columns."""
    units = Units(data, bounds)
    rank = units.rank(bounds)
    n = np.diff(rank)
    turns = np.sort(draws.astype(np.int64) % (n + 1)[:, None], axis=1)
    places = np.repeat(bounds[:-1, None], 2, axis=1)
    moved = turns > 0
    places[moved] = units.behind((rank[:-1, None] + turns)[moved])
    return n, places[:, 0], places[:, 1]


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, without a copy, and the texts' bounds in them."""
    wide = texts.cast(pa.large_binary())
    _, bounds, data = wide.buffers()
    bounds = np.frombuffer(bounds, np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _chars(part: bytes) -> int:
    return len(part.decode("utf-8", "replace"))


OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"


def infill(
    docs: DataFrame,
    seed: str = "1",
    plain_percent: int = 10,
    spm_percent: int = 20,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: its units ``n``, ``form``, the parts' code points and the ``output`` text.

    The draws are the first four 32-bit numbers of sha256 of seed, colon and id.
    """
    ship(docs.sparkSession)
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def reorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            draws = np.stack([batch.column(f"h{i}").to_numpy() for i in range(1, 5)], axis=1)
            data, bounds = joined(batch.column("text"))
            n, first, second = cut(data, bounds, draws[:, :2])
            whole = data.tobytes()
            p, s, m = markers
            forms, chars, outputs = [], [], []
            for begin, a, b, end, h3, h4 in zip(
                bounds[:-1].tolist(), first.tolist(), second.tolist(), bounds[1:].tolist(), *draws[:, 2:].T.tolist(), strict=True
            ):
                own = whole[begin:end]
                if not own or h3 % 100 >= 100 - plain_percent or any(x in own for x in markers):
                    forms.append(PLAIN)
                    chars.append((None, None))
                    outputs.append(own)
                    continue
                prefix, middle, suffix = whole[begin:a], whole[a:b], whole[b:end]
                spm = h4 % 100 < spm_percent
                forms.append(SPM if spm else PSM)
                chars.append((_chars(prefix), _chars(middle)))
                outputs.append(b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(forms, pa.string()),
                    pa.array([c[0] for c in chars], pa.int64()),
                    pa.array([c[1] for c in chars], pa.int64()),
                    pa.array(outputs, pa.binary()),
                ],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    read = docs.select(long_id(key).alias("doc_id"), text_of(text).alias("text"), *drawn)
    return read.mapInArrow(reorder, OUTPUT).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output and its form."""

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(one) + 1))
        a = F.substring_index(body, two, 1)
        rest = F.substr(body, F.length(a) + len(two) + 1)
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substr(rest, F.length(b) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_first, prefix_second, middle_last = parts(SUFFIX, PREFIX)
    return (
        F.when(form == PSM, F.concat(prefix, middle, suffix))
        .when(form == SPM, F.concat(prefix_second, middle_last, suffix_first))
        .otherwise(output)
    )
