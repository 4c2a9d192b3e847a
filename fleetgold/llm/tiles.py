"""Exact comparison of texts inside candidate components, in tiles of bounded size.

Candidates come as (node, root): texts under one root may be similar. A component
is cut into blocks by a hash, of so much text that two blocks fit a task, and every
pair of blocks is one tile; small components share a task. A tile compares all its
pairs by counting common shingles, exactly (with a matrix product; components of up to
``FEW_TEXTS`` texts all of a task at once, by the texts that each shingle has), and hands on one
row per text: how many texts it is linked with there, and the smallest text it is
connected to there. No pair leaves a task, so a group of g similar texts gives g
rows per tile, however many pairs it has.

Where only the connected texts are asked for (``connect``), the pairs of a component of more than ``BLOCK_TEXTS`` texts
(or of several blocks) are told apart by sketches of ``SKETCH`` bits first, made once a text: a bit agrees with a chance of
(1 + similarity) / 2, so a pair whose bits agree ``SPREAD`` standard deviations less often than at the threshold is not
linked (a linked one is taken for such with a chance of some 1e-10). The other pairs are compared exactly, unless their
texts are connected already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgold.llm.batches import by_bytes
from fleetgold.llm.common import mix
from fleetgold.llm.shingles import sets, signatures
from fleetgold.operators.skew import lookup_join

#: Characters and texts of one block.
BLOCK_CHARS = 6_000_000
BLOCK_TEXTS = 2_048
#: Columns and rows of a matrix at once, as few as keep a task's memory small.
COLUMNS = 1_024
ROWS = 256
#: Texts of a component that is compared together with others, and pairs with a common shingle counted at once.
FEW_TEXTS = 64
COUNTED = 1 << 18
#: Characters of small components that are compared at once, and of texts whose shingles are made at once (each takes some
#: 60 bytes of arrays, which stay in cache).
FEW_CHARS = 1 << 18
#: Bits of a sketch, those of them that are counted for all pairs, and how far below the mean at the threshold a pair may be.
SKETCH, FIRST_BITS, SPREAD = 512, 128, 7
#: Times that a text is compared with the one likeliest to be linked before it is with all that may be, and pairs of these at once.
LIKELIEST, PAIRS = 4, 1 << 12


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of common hashes of each pair, from distinct hashes per text; ``left`` and ``right`` may be one list."""
    same = left is right
    both = left if same else left + right
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    values = np.concatenate(both) if both else np.zeros(0, np.uint64)
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    column = np.cumsum(fresh) - 1
    sizes = np.bincount(column) if len(column) else np.zeros(0, np.int64)
    keep = sizes[column] > 1 if len(column) else np.zeros(0, bool)  # a hash of one text is in no pair
    owner, column = owner[keep], column[keep]
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
    out = np.zeros((len(left), len(right)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, total, COLUMNS):
        begin, end = np.searchsorted(column, [a, a + COLUMNS])
        matrix = np.zeros((len(both), min(COLUMNS, total - a)), np.float32)
        matrix[owner[begin:end], column[begin:end] - a] = 1
        out += matrix @ matrix.T if same else matrix[: len(left)] @ matrix[len(left) :].T
    if same:
        np.fill_diagonal(out, [len(s) for s in left])
    return out


def smallest_reached(linked: np.ndarray, left: np.ndarray, right: np.ndarray, piece: int = 512) -> np.ndarray:
    """For every item: the smallest item it is connected to, from a matrix of links.

    ``left`` and ``right`` are the items behind the matrix's rows and columns.
    """
    label = np.arange(int(max(left.max(initial=-1), right.max(initial=-1))) + 1, dtype=np.int32)
    top = np.int32(len(label))
    while True:
        new = label.copy()
        for a in range(0, len(left), piece):
            part, rows = linked[a : a + piece], left[a : a + piece]
            new[rows] = np.minimum(new[rows], np.where(part, new[right][None, :], top).min(1, initial=top))
            new[right] = np.minimum(new[right], np.where(part, new[rows][:, None], top).min(0, initial=top))
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def _hashed(texts: list[str], shingles) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingles of some texts after the other, of about ``FEW_CHARS`` characters at once."""
    turn = np.cumsum([len(t) for t in texts]) // FEW_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield shingles(texts[a:b])


def _tile(frame: pd.DataFrame, shingles, threshold: float, found_by: Callable | None) -> pd.DataFrame:
    """One tile: blocks a and b of a component (the same, or two)."""
    frame = frame.sort_values("node")
    same = bool((frame["a"] == frame["b"]).all())
    own = [s for part in _hashed(frame["text"].tolist(), shingles) for s in sets(*part)]
    is_left = np.ones(len(frame), bool) if same else (frame["block"] == frame["a"]).to_numpy()
    places = np.flatnonzero(is_left), np.flatnonzero(np.ones(len(frame), bool) if same else ~is_left)
    left = [own[i] for i in places[0]]
    right = left if same else [own[i] for i in places[1]]
    size = np.array([len(s) for s in own], np.float64)
    counts = common_counts(left, right)
    linked = np.zeros(counts.shape, bool)
    weight = frame["copies"].to_numpy(np.float64)
    links = np.zeros(len(frame))
    found = expected = 0.0
    for at in range(0, len(left), ROWS):
        rows = places[0][at : at + ROWS]
        common = counts[at : at + ROWS].astype(np.float64)
        union = size[rows][:, None] + size[places[1]][None, :] - common
        share = np.divide(common, union, out=np.zeros_like(common), where=union > 0)
        part = linked[at : at + ROWS]
        np.greater_equal(share, threshold, out=part)
        if same:
            part[np.arange(len(rows)), rows] = False
        links[rows] += part @ weight[places[1]]
        if not same:
            links[places[1]] += weight[rows] @ part
        pairs = np.triu(part, at + 1) if same else part
        chances = found_by(share[pairs]) if found_by else np.ones(int(pairs.sum()))
        found += len(chances)
        expected += (1 / chances).sum()
    node = frame["node"].to_numpy()
    return pd.DataFrame(
        {
            "node": node,
            "links": links.astype(np.int64),
            "reached": node[smallest_reached(linked, *places)],
            "found": np.where(np.arange(len(node)) == 0, found, 0.0),
            "expected": np.where(np.arange(len(node)) == 0, expected, 0.0),
        }
    )


def _sketches(texts: list[str], shingles) -> list[bytes]:
    """``SKETCH`` bits for each text: one for each MinHash value; zeros for a text without shingles."""
    out: list[bytes] = []
    column = np.arange(SKETCH, dtype=np.uint64) << np.uint64(32)
    for hashes, counts in _hashed(texts, shingles):
        bits = (mix(signatures(hashes, counts, SKETCH) + column) & np.uint64(1)).astype(np.uint8)
        packed = iter(np.packbits(bits, axis=1))
        out += [next(packed).tobytes() if n else bytes(SKETCH // 8) for n in counts.tolist()]
    return out


def _with_sketches(shingles):
    """The rows with a sketch of each text that ``sketched`` asks one for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", FEW_CHARS):
            asked = batch.column("sketched").to_pylist()
            made = iter(_sketches(batch.column("text").filter(batch.column("sketched")).to_pylist(), shingles) if any(asked) else [])
            sketches = pa.array([next(made) if a else None for a in asked], pa.binary())
            columns = [batch.column(c) for c in ("root", "node", "copies", "blocks", "text")]
            yield pa.RecordBatch.from_arrays([*columns, sketches], names=["root", "node", "copies", "blocks", "text", "sketch"])

    return run


def _least(bits: int, threshold: float) -> float:
    """Fewer of ``bits`` agree in next to no pair at the threshold."""
    chance = (1 + threshold) / 2
    return bits * chance - SPREAD * (bits * chance * (1 - chance)) ** 0.5


def _near(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of bits in which the sketches of pairs agree."""
    out = np.zeros(len(i), np.int32)
    for at in range(0, len(i), COUNTED):
        part = slice(at, at + COUNTED)
        out[part] = 64 * words.shape[1] - np.bitwise_count(words[i[part]] ^ words[j[part]]).sum(1, dtype=np.int32)
    return out


class _Sets:
    """The distinct shingles of some of a tile's texts, as small numbers; those of one text only are just counted."""

    def __init__(self, texts: list[str], some: np.ndarray, shingles):
        own = [s for part in _hashed([texts[x] for x in some], shingles) for s in sets(*part)]
        self.size = np.zeros(len(texts), np.int64)
        self.size[some] = [len(s) for s in own]
        shingle, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)[1:]
        kept = times[shingle] > 1
        cuts = np.cumsum(np.bincount(np.repeat(np.arange(len(own)), self.size[some])[kept], minlength=len(own)))[:-1]
        self.own = dict(zip(some.tolist(), np.split(shingle[kept].astype(np.int32), cuts), strict=True))
        self.mark = np.zeros(len(times), bool)

    def linked(self, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs, sorted by ``i``, are linked."""
        common = np.zeros(len(i), np.int64)
        begins = np.flatnonzero(np.diff(i, prepend=-1)).tolist()
        for a, end in zip(begins, [*begins[1:], len(i)], strict=True):
            mine = self.own[int(i[a])]
            self.mark[mine] = True
            for at in range(a, end, ROWS):
                others = [self.own[x] for x in j[at : min(at + ROWS, end)].tolist()]
                found = np.cumsum(self.mark[np.concatenate(others)], dtype=np.int64)
                so_far = np.concatenate([[0], found])[np.cumsum([0, *(len(o) for o in others)])]
                common[at : at + len(others)] = np.diff(so_far)
            self.mark[mine] = False
        return common / (self.size[i] + self.size[j] - common) >= threshold


def _connected(frame: pd.DataFrame, shingles, threshold: float) -> pd.DataFrame:
    """One tile, if only what is connected counts: links is 1 for a text that has any."""
    frame = frame.sort_values("node")
    n = len(frame)
    same = bool((frame["a"] == frame["b"]).all())
    is_left = np.ones(n, bool) if same else (frame["block"] == frame["a"]).to_numpy()
    is_right = is_left if same else ~is_left
    sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint8).reshape(n, -1)
    words = sketch.view(np.uint64)
    signs = np.unpackbits(sketch[:, : FIRST_BITS // 8], axis=1).astype(np.float32) * 2 - 1
    least = 2 * _least(FIRST_BITS, threshold) - FIRST_BITS, _least(SKETCH, threshold)
    label = np.arange(n)

    def strips(some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows and columns with their first bits' agreement."""
        left, right = np.flatnonzero(is_left & some), np.flatnonzero(is_right & some)
        for at in range(0, len(left), ROWS):
            yield left[at : at + ROWS], right, signs[left[at : at + ROWS]] @ signs[right].T

    def likely(rows: np.ndarray, right: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that may be linked and whose texts are not connected yet."""
        i, j = np.nonzero(agree >= least[0])
        i, j = rows[i], right[j]
        some = (label[i] != label[j]) & ((j > i) | (not same))
        i, j = i[some], j[some]
        some = _near(words, i, j) >= least[1]
        return i[some], j[some]

    some = np.zeros(n, bool)
    for strip in strips(words.any(1)):  # a text without shingles has no bits
        for ends in likely(*strip):
            some[ends] = True
    own = _Sets(frame["text"].tolist(), np.flatnonzero(some), shingles) if some.any() else None

    def link(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        if not len(i):
            return
        linked = own.linked(i, j, threshold)
        label = _labels(n, label[i[linked]], label[j[linked]])[label]

    for rows, right, agree in strips(some):
        for _ in range(LIKELIEST):
            agree[label[rows][:, None] == label[right]] = -np.inf  # itself, too
            best = agree.argmax(1)
            i, j = rows, right[best]
            near = (agree[np.arange(len(rows)), best] >= least[0]) & (_near(words, i, j) >= least[1])
            agree[np.arange(len(rows)), best] = -np.inf
            link(i[near], j[near])
        i, j = likely(rows, right, agree)
        while len(i):
            link(i[:PAIRS], j[:PAIRS])
            i, j = i[PAIRS:], j[PAIRS:]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
    node = frame["node"].to_numpy()
    links = np.bincount(label, minlength=n)[label] > 1
    return pd.DataFrame({"node": node, "links": links.astype(np.int64), "reached": node[label], "found": 0.0, "expected": 0.0})


def _pairs(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of places within each run of places, run by run, and where each run's pairs begin."""
    made = sizes * (sizes - 1) // 2
    bases = np.cumsum(made) - made
    left, right = np.zeros(int(made.sum()), np.int64), np.zeros(int(made.sum()), np.int64)
    for n in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(n, 1)
        some = sizes == n
        at = (bases[some][:, None] + np.arange(len(i))).ravel()
        left[at], right[at] = (begins[some][:, None] + i).ravel(), (begins[some][:, None] + j).ravel()
    return left, right, bases


def _shares(
    hashes: np.ndarray, counts: np.ndarray, begins: np.ndarray, sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, Jaccard similarity) of all pairs of texts within each run of texts.

    Sorted by component and shingle, the texts that have a shingle stand together, and every pair of them is one
    more common shingle.
    """
    left, right, bases = _pairs(begins, sizes)
    owner = np.repeat(np.arange(len(counts)), counts)
    run = np.repeat(np.arange(len(begins)), sizes)
    local = np.arange(len(counts)) - begins[run]
    key = hashes + mix(run.astype(np.uint64) + np.uint64(1))[owner]
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    bits = len(counts).bit_length()
    place = np.zeros(len(key), np.int64)
    np.cumsum(key[1:] != key[:-1], out=place[1:])
    both = np.sort((place << bits) | owner)  # a shingle's texts in order
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both  # each text once
    owner, shingle = both & ((1 << bits) - 1), both >> bits
    size = np.bincount(owner, minlength=len(counts))
    first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(both) else np.zeros(0, np.int64)
    holders = np.diff(np.append(first, len(both)))
    common = np.zeros(len(left))
    for n in np.unique(holders[holders > 1]):
        i, j = np.triu_indices(n, 1)
        some = first[holders == n]
        step = max(1, COUNTED // len(i))
        for at in range(0, len(some), step):
            texts = owner[some[at : at + step][:, None] + np.arange(n)]
            c, total = local[texts], sizes[run[texts[:, 0]]][:, None]
            code = bases[run[texts[:, 0]]][:, None] + c[:, i] * total - c[:, i] * (c[:, i] + 1) // 2 + c[:, j] - c[:, i] - 1
            common += np.bincount(code.ravel(), minlength=len(common))
    union = size[left] + size[right] - common
    return left, right, np.divide(common, union, out=np.zeros(len(common)), where=union > 0)


def _labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For every item the smallest one that the links connect it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def _many(frame: pd.DataFrame, shingles, threshold: float, found_by: Callable | None) -> pd.DataFrame:
    """Many small components, each whole; sorted by root and node."""
    n = len(frame)
    root = frame["root"].to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
    hashes, counts = map(np.concatenate, zip(*_hashed(frame["text"].tolist(), shingles), strict=True))
    left, right, share = _shares(hashes, counts, begins, np.diff(np.append(begins, n)))
    linked = share >= threshold
    left, right, share = left[linked], right[linked], share[linked]
    weight = frame["copies"].to_numpy(np.int64)
    links = np.zeros(n, np.int64)
    np.add.at(links, left, weight[right])
    np.add.at(links, right, weight[left])
    expected = found_by(share) if found_by else np.ones(len(share))
    node = frame["node"].to_numpy()
    return pd.DataFrame(
        {
            "node": node,
            "links": links,
            "reached": node[_labels(n, left, right)],
            "found": np.where(np.arange(n) == 0, float(len(share)), 0.0),
            "expected": np.where(np.arange(n) == 0, float((1 / expected).sum()), 0.0),
        }
    )


def _slices(frame: pd.DataFrame) -> list[pd.DataFrame]:
    """Whole components, so many that they have about ``FEW_CHARS`` characters; sorted by root."""
    root = frame["root"].to_numpy()
    begins = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
    before = np.cumsum([0, *(len(t) for t in frame["text"])])[begins]
    cuts = [*begins[np.flatnonzero(np.diff(before // FEW_CHARS, prepend=-1))], len(frame)]
    return [frame.iloc[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _task(frame: pd.DataFrame, shingles, threshold: float, found_by: Callable | None) -> pd.DataFrame:
    """The tiles of a task, one after the other."""
    frame = frame.sort_values(["root", "a", "b", "node"], ignore_index=True)
    texts = frame.groupby(["root", "a", "b"], sort=False)["node"].transform("size")
    few = (frame["a"] == frame["b"]) & (texts <= FEW_TEXTS)
    sketched = frame["sketch"].notna() if "sketch" in frame else few & ~few
    tiles = [_tile(t, shingles, threshold, found_by) for _, t in frame[~few & ~sketched].groupby(["root", "a", "b"], sort=False)]
    tiles += [_connected(t, shingles, threshold) for _, t in frame[~few & sketched].groupby(["root", "a", "b"], sort=False)]
    if few.any():
        tiles += [_many(f, shingles, threshold, found_by) for f in _slices(frame[few])]
    return pd.concat(tiles, ignore_index=True)


def compare(
    members: DataFrame,
    shingles: Callable,
    threshold: float,
    found_by: Callable | None = None,
    block_chars: int = BLOCK_CHARS,
    block_texts: int = BLOCK_TEXTS,
    *,
    connect: bool = False,
) -> DataFrame:
    """Compare the texts of each component; ``members`` has node, root, text and copies.

    One row per text and tile: node, links (copies counted), reached (a node), and in
    one row of each tile found and expected pairs. ``found_by`` gives the chance that a
    pair of a similarity became a candidate. With ``connect`` links only tells whether there are any,
    and pairs are not counted.
    """
    sizes = members.groupBy("root").agg(
        F.sum(F.length("text")).alias("chars"), F.count("*").alias("texts")
    )
    blocks = F.ceil(F.greatest(F.col("chars") / block_chars, F.col("texts") / block_texts)).cast("int")
    sizes = sizes.withColumn("blocks", F.greatest(blocks, F.lit(1)))
    small = sizes.where("blocks = 1").agg(F.sum("chars"), F.sum("texts")).first()
    bins = 1 + int((1 + connect) * max((small[0] or 0) / block_chars, (small[1] or 0) / block_texts))
    placed = lookup_join(members, sizes.select("root", "blocks", "texts"), ["root"], "inner")
    if connect:
        made = ", ".join(f"{c} {dict(placed.dtypes)[c]}" for c in ("root", "node", "copies", "blocks", "text"))
        placed = placed.withColumn("sketched", (F.col("blocks") > 1) | (F.col("texts") > BLOCK_TEXTS)).mapInArrow(_with_sketches(shingles), f"{made}, sketch binary")
    rows = (
        placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("a", F.least("block", "other"))
        .withColumn("b", F.greatest("block", "other"))
        .withColumn(
            "task",
            F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root", "a", "b")),
        )
        .select("task", "root", "a", "b", "block", "node", "copies", "text", *["sketch"] * connect)
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _task(frame, shingles, threshold, found_by)

    return rows.groupBy("task").applyInPandas(run, "node long, links long, reached long, found double, expected double")
