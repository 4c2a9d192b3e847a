"""Packing: bounded-space online best-fit of token runs into windows.

Each task tokenizes its documents and keeps a fixed number of open windows. A
document is cut into whole windows and one remainder. The remainder goes to the
open window that it fills best; when it fits none, the fullest is topped up from
the remainder's front if the gap is worth a cut, and emitted. What is open when a
task ends is merged in rounds: the windows of ``fan_in`` tasks meet in one and are
packed the same way as unbreakable units, until one task is left. A task holds
``open_windows`` windows and one batch of texts, whatever the input's size.

Defined results: a null or empty text has its end id only; repeated rows are
packed each; an empty table gives an empty result. Only ``doc_id`` and ``text`` are
read, so other columns may have any name. A sequence is padded to ``window`` unless
its filled length is a power of two.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgold.llm.common import saved, python_tasks, text_of, written
from fleetgold.llm.tokens import default_vocabulary, encoder

WINDOW = 2048
OPEN_WINDOWS = 64
#: Shortest run of ids that is cut off a document to fill a gap.
SHORTEST_CUT = 16
FAN_IN = 32
TASK_BITS = 33


class Windows:
    """The open windows of one task, ordered by the room left in them."""

    def __init__(self, window: int, limit: int, shortest_cut: int = 0):
        self.window, self.limit, self.shortest_cut = window, limit, shortest_cut
        self.open: list[tuple[int, int]] = []  # (room, name), ascending
        self.made = 0

    def _fill(self, at: int, length: int) -> tuple[int, int, int]:
        room, name = self.open.pop(at)
        if room > length:
            bisect.insort(self.open, (room - length, name))
        return name, self.window - room, length

    def _new(self) -> int:
        bisect.insort(self.open, (self.window, self.made))
        self.made += 1
        return len(self.open) - 1

    def place(self, length: int) -> Iterator[tuple[int, int, int]]:
        """Pieces (window, offset, length) for a run of ids.

        A length of 0 tells that a window was closed with room left.
        """
        while length >= self.window:
            yield self._fill(self._new(), self.window)
            length -= self.window
        if not length:
            return
        at = bisect.bisect_left(self.open, (length, -1))
        if at == len(self.open) and at >= self.limit:
            room, fullest = self.open[0]
            if self.shortest_cut and min(room, length - room) >= self.shortest_cut:
                yield self._fill(0, room)
                length -= room
            else:
                self.open.pop(0)
                yield fullest, self.window - room, 0
            at = bisect.bisect_left(self.open, (length, -1))
        yield self._fill(at if at < len(self.open) else self._new(), length)


PIECES = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "window_id", "offset")]
    + [("closed", pa.bool_()), ("ids", pa.binary())]
)
PIECES_SQL = ", ".join(f"{n} long" for n in PIECES.names[:6]) + ", closed boolean, ids binary"


def _pieces(vocabulary: str, end_id: int, window: int, open_windows: int, shortest_cut: int):
    """Tokenize and pack one task's documents; a window's pieces leave when it closes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << TASK_BITS
        end = int(end_id).to_bytes(4, "little")
        windows = Windows(window, open_windows, shortest_cut)
        held: dict[int, list[tuple]] = {}

        def rows(names, closed: bool) -> pa.RecordBatch:
            found = [(*piece[:4], base + name, piece[4], closed, piece[5]) for name in names for piece in held.pop(name)]
            columns = zip(*found, strict=True) if found else [[]] * len(PIECES)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, PIECES.types, strict=True)], schema=PIECES
            )

        for batch in batches:
            full = []
            texts = encoder(vocabulary).encode(batch.column("text").to_pylist())
            for doc, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids += end
                total, start = len(ids) // 4, 0
                for name, offset, length in windows.place(total):
                    if length:
                        piece = (doc, start, length, total, offset, ids[4 * start : 4 * (start + length)])
                        held.setdefault(name, []).append(piece)
                        start += length
                    if not length or offset + length == window:
                        full.append(name)
            yield rows(full, True)
        yield rows(list(held), False)

    return run


def _merge(window: int, open_windows: int):
    """Pack the open windows of ``fan_in`` tasks: at most ``fan_in * open_windows`` rows, by construction."""

    def run(units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["filled", "unit"], ascending=[False, True])
        windows, named, out = Windows(window, open_windows), {}, []
        for unit, filled in zip(units["unit"].tolist(), units["filled"].tolist(), strict=True):
            for name, offset, length in windows.place(filled):
                if length:
                    out.append((unit, named.setdefault(name, unit), offset))
        moved = pd.DataFrame(out, columns=["unit", "into", "more"])
        still = {named[name]: window - room for room, name in windows.open}
        moved["open"] = moved["into"].isin(still)
        moved["filled"] = moved["into"].map(still).fillna(0).astype("int64")
        return moved.assign(task=units["task"].iloc[0])

    return run


def merge_windows(
    left: DataFrame, tasks: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN
) -> DataFrame:
    """(window_id, sequence_id, shift) for ``left`` (window_id, task, filled), merged ``fan_in`` tasks at a time."""
    schema = "unit long, into long, more long, open boolean, filled long, task long"
    where = left.select("window_id", F.col("window_id").alias("sequence_id"), F.lit(0).cast("long").alias("shift"))
    units = left.select(F.col("window_id").alias("unit"), "filled", "task")
    while True:
        tasks = -(-tasks // fan_in)
        moved = saved(
            units.withColumn("task", F.floor(F.col("task") / fan_in).cast("long"))
            .groupBy("task")
            .applyInPandas(_merge(window, open_windows), schema)
        )
        steps = moved.select(F.col("unit").alias("sequence_id"), "into", "more")
        where = saved(
            where.join(steps, "sequence_id", "left").select(
                "window_id",
                F.coalesce("into", "sequence_id").alias("sequence_id"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"),
            )
        )
        if tasks <= 1:
            return where
        units = moved.where("open").groupBy(F.col("into").alias("unit")).agg(
            F.max("filled").alias("filled"), F.max("task").alias("task")
        )


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    end_id: int = 1,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    shortest_cut: int = SHORTEST_CUT,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit, little-endian)."""
    python_tasks(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    pieces = written(
        texts.mapInArrow(
            _pieces(vocabulary or default_vocabulary(), end_id, window, open_windows, shortest_cut), PIECES_SQL
        ),
        "pieces",
    )
    left = (
        pieces.where("not closed")
        .groupBy("window_id")
        .agg(F.sum("length").alias("filled"))
        .withColumn("task", F.shiftright("window_id", TASK_BITS))
    )
    tasks = (left.agg(F.max("task")).first()[0] or 0) + 1
    where = merge_windows(left, tasks, window, open_windows, fan_in)
    final = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    whole = pieces.where("closed").withColumn("sequence_id", F.col("window_id"))
    merged = pieces.where("not closed").join(where, "window_id").withColumn("offset", F.col("offset") + F.col("shift"))
    return whole.select(final).unionByName(merged.select(final))
