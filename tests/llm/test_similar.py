"""Operators 3, 7, 8, 9, the union-find and the pipeline."""

import hashlib
import tracemalloc
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from fleetgold.llm import embed_dedup, line_dedup, mih, ngram_join, shingles, tiles
from fleetgold.llm.graph import components
from fleetgold.sources.shared import new_folder
from pyspark.sql import functions as F

from cases import AWKWARD, LONG, SAME, SMALL


def near_copies(n, changed=3, words=120):
    rng = np.random.default_rng(n)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for at in rng.choice(words, rng.integers(0, changed + 1), replace=False):
            text[at] = f"c{i}_{at}"
        out.append(" ".join(text))
    return out


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (500, 501)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 500: 500, 501: 500}
    assert components(df.limit(0)).collect() == []


def test_shingles_agree_with_sets():
    texts = [SAME, None, "", "a b", " \t", LONG[:5000], SAME + " x", "é ß c d e f"]
    hashes, counts = shingles.word_shingles(texts, 5)
    plain = brute.word_sets(dict(enumerate(texts)))
    assert [len(s) for s in shingles.sets(hashes, counts)] == [len(plain.get(i, ())) for i in range(len(texts))]
    own = shingles.sets(hashes, counts)
    common = tiles.common_counts(own, own)
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert common[i, j] == len(plain.get(i, set()) & plain.get(j, set()))


def test_signatures_span_pieces():
    hashes, counts = shingles.word_shingles([LONG, SAME, "", LONG], 5)
    assert np.array_equal(shingles.signatures(hashes, counts, 8), shingles.signatures(hashes, counts, 8, piece=1000))


# 9: documents


def test_documents_equal_brute_force(documents, texts):
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_documents(documents).collect()}
    assert got == brute.documents(texts)


@pytest.mark.parametrize("block_texts", [tiles.BLOCK_TEXTS, 7])
def test_large_group_over_several_tiles(spark, monkeypatch, block_texts):
    monkeypatch.setattr(tiles.compare, "__defaults__", (None, tiles.BLOCK_CHARS, block_texts))
    texts = dict(enumerate(near_copies(60) + near_copies(9, 40)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_documents(docs).collect()}
    assert got == brute.documents(texts)
    assert max(n for _, n in got.values()) > 20


def test_prefixes_shorten_until_the_recall():
    assert ngram_join.chance(0.8, 8) < ngram_join.RECALL <= ngram_join.chance(0.8, 7)


def test_documents_awkward(awkward, empty):
    rows = [(r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_documents(awkward).collect()]
    expected = Counter(
        {(1, 1, 3): 1, (2, 1, 3): 2, (None, 1, 3): 1, (None, None, 0): 1, (6, 6, 1): 1, (7, 6, 1): 1}
        | {(i, i, 0): 1 for i in (3, 4, 5, 8, 9, 10)}
    )
    assert Counter(rows) == expected
    assert ngram_join.similar_documents(empty).collect() == []


# 3: lines


def test_lines_equal_brute_force(documents, texts):
    rows = line_dedup.per_document(documents, line_dedup.marked_lines(documents)).collect()
    assert {r.doc_id: r.dropped_lines for r in rows} == brute.lines(texts)


def test_bands_miss_few_lines_at_the_threshold():
    assert line_dedup.missed(line_dedup.THRESHOLD) < 0.0005
    letters = np.random.default_rng(8).integers(ord("a"), ord("z"), (4000, 107))
    pairs = [(r.tobytes().decode(), (r[:96].tobytes() + bytes([ord("z")] * 11)).decode()) for r in letters.astype(np.uint8)]
    values = shingles.signatures(*shingles.char_shingles([t for p in pairs for t in p], 8), line_dedup.BANDS * line_dedup.ROWS)
    bands = shingles.banded(values, line_dedup.BANDS)
    lost = (bands[::2] != bands[1::2]).all(1).mean()
    assert lost < 0.002, lost  # all pairs are at or little above the threshold


def test_few_texts_are_compared_as_in_tiles(monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for root in range(60):
        base = rng.choice(list("abcdefgh "), size=rng.integers(1, 120))
        for _ in range(rng.integers(1, 30)):
            text = base.copy()
            text[rng.integers(0, len(text), rng.integers(0, 4))] = "z"
            rows.append((root, 0, 0, 0, len(rows), int(rng.integers(1, 4)), "".join(text)))
    frame = pd.DataFrame(rows, columns=["root", "a", "b", "block", "node", "copies", "text"])
    chars = lambda t: shingles.char_shingles(t, 8)
    chance = lambda s: 1 - (1 - s**5) ** 20
    each = pd.concat([tiles._tile(f, chars, 0.8, chance) for _, f in frame.groupby("root")])
    for counted in (50, 1 << 20):
        monkeypatch.setattr(tiles, "COUNTED", counted)
        many = tiles._many(frame, chars, 0.8, chance)
        assert many[["node", "links", "reached"]].equals(each[["node", "links", "reached"]].reset_index(drop=True))
        assert many["found"].sum() == each["found"].sum() > 500
        assert np.isclose(many["expected"].sum(), each["expected"].sum())


def test_a_task_of_tiles_needs_little_memory():
    """Small components a slice at a time, large ones a few rows of the matrix at a time, with the same results."""
    rng = np.random.default_rng(6)
    chars = lambda t: shingles.char_shingles(t, 8)

    def frame(components, copies, length):
        texts = []
        for _ in range(components):
            base = rng.integers(97, 123, length).astype(np.uint8)
            for _ in range(copies):
                base[rng.integers(0, length, 2)] = 48
                texts.append(base.tobytes().decode())
        roots = np.repeat(np.arange(components), copies)
        return pd.DataFrame({"root": roots, "a": 0, "b": 0, "block": 0, "node": np.arange(len(texts)), "copies": 1, "text": texts})

    for rows, limit in ((frame(1200, 3, 400), 100e6), (frame(1, 1800, 300), 120e6)):
        tracemalloc.start()
        got = tiles._task(rows, chars, 0.8, None)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < limit, peak
        each = pd.concat([tiles._tile(f, chars, 0.8, None) for _, f in rows.groupby("root")], ignore_index=True)
        columns = ["node", "links", "reached"]
        assert got[columns].equals(each[columns])
        assert got["links"].sum() > 0


@pytest.mark.parametrize("texts", [tiles.FEW_TEXTS, tiles.FEW_TEXTS + 40])
def test_long_texts_of_a_tile_need_little_memory(monkeypatch, texts):
    """Shingles of a large component, whichever way it is compared, are made for some of its texts at a time."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 99_999, (texts // 4, 6_000)).astype(str).tolist()
    rows = [" ".join(base[i // 4 % len(base)][:-1] + [f"end{i % 4}"]) for i in range(texts)]
    frame = pd.DataFrame({"root": 1, "a": 0, "b": 0, "block": 0, "node": np.arange(texts), "copies": 1, "text": rows})
    asked = []

    def words(some):
        asked.append(sum(map(len, some)))
        return shingles.word_shingles(some, 5)

    tracemalloc.start()
    got = tiles._task(frame, words, 0.8, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(asked) > 2_000_000 and max(asked) <= tiles.FEW_CHARS + 40_000, asked
    assert peak < 80e6, peak
    monkeypatch.setattr(tiles, "FEW_CHARS", 1 << 30)
    assert got.equals(tiles._task(frame, words, 0.8, None))
    assert (got["links"] >= 3).all() and max(asked) > 2_000_000


def test_many_texts_are_signed_in_little_memory():
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 9999, 700))) for _ in range(512)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(512)), pa.array(texts)], names=["doc_id", "text"])
    run = ngram_join._labels(5, 32, 8)
    tracemalloc.start()
    got = [r for b in run(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, peak
    assert got == [r for i in range(512) for b in run(iter([batch.slice(i, 1)])) for r in b.to_pylist()]


def test_band_values_come_in_packs(monkeypatch):
    """A few lines' band values are one row, each line of a batch once; a text without lines is a row without a key."""
    monkeypatch.setattr(line_dedup, "PACK", 3)
    texts = ["one line\n\n two lines\none line", "", "two lines\nthree\nfour", "five"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array([5, 6, 7, 8]), pa.array(texts)], names=["doc_id", "text_key", "text"])
    rows = [r for b in line_dedup._lines(8, 20, 5)(iter([batch])) for r in b.to_pylist()]
    assert [(r["doc_id"], r["text_key"], r["line_no"], r["lines"]) for r in rows] == [
        (0, 5, 0, 3), (0, 5, 2, None), (0, 5, 3, None), (1, 6, None, 0), (2, 7, 0, 3), (2, 7, 1, None), (2, 7, 2, None), (3, 8, 0, 1)
    ]
    lines = ["one line", "two lines", "three", "four", "five"]
    keys = [np.frombuffer(hashlib.md5(t.encode()).digest(), ">i8").tolist() for t in lines]
    assert [[r["node"], r["rest"]] for r in rows if r["line_no"] is not None] == [keys[i] for i in (0, 1, 0, 1, 2, 3, 4)]
    packs = [r for r in rows if r["nodes"] is not None]
    assert [len(r["nodes"]) for r in packs] == [24, 16]
    assert np.frombuffer(b"".join(r["nodes"] for r in packs), np.int64).tolist() == [k[0] for k in keys]
    values = shingles.banded(shingles.signatures(*shingles.char_shingles(lines, 8), 100), 20)
    turns = [np.frombuffer(b"".join(r[c] for r in packs), ">u8").reshape(5, -1) for c in line_dedup._turns(20)]
    assert (np.concatenate(turns, axis=1) == values).all()


def test_documents_agree_with_marked_lines(spark):
    lines = near_copies(20, 4) + ["tiny", "tiny ", "tinz"]
    rows = [(i % 5, "\n".join(lines[i::7])) for i in range(7)] + [(None, "tiny\nown"), (9, None), (9, " \n"), (3, "tinz"), (3, "tinz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_documents(docs).collect()
    assert Counter(map(repr, got)) == Counter(map(repr, line_dedup.per_document(docs, line_dedup.marked_lines(docs)).collect()))
    assert sum(len(r.dropped_lines) for r in got) > 20


def test_bands_meet_across_tasks_and_chunks(spark, monkeypatch):
    """Links by band values are those of all pairs that share one, whatever is linked before the shuffle."""
    rng = np.random.default_rng(2)
    values = rng.integers(0, 40, (300, 4)).astype(">u8")
    values[:100, 1] = 7  # a value that a third of all classes have
    classes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(values)], "node long, bands_0 binary")
    holders = defaultdict(list)
    for i, v in enumerate(values):
        for k, x in enumerate(v):
            holders[k, int(x)].append(i)
    pairs = [(a, b) for nodes in holders.values() for a, b in zip(nodes, nodes[1:], strict=False)]
    for chunk in (1, 1 << 20):
        monkeypatch.setattr(line_dedup, "CHUNK", chunk)
        got = [tuple(r) for r in line_dedup._links(classes.repartition(5), 0, 0).collect()]
        assert all(low < node for node, low in got)
        assert brute.union(got, range(300)) == brute.union(pairs, range(300))


def test_wanted_lines_come_from_their_text():
    def wanted(line_no, line, node):
        return {"line_no": line_no, "key": hashlib.md5(line.encode()).digest(), "node": node, "root": 1}

    kind = pa.list_(pa.struct([("line_no", pa.int32()), ("key", pa.binary()), ("node", pa.int64()), ("root", pa.int64())]))
    asked = [[wanted(2, "c d", 5), wanted(0, "a", 1)], [], [wanted(0, "other", 7), wanted(9, "x", 8)]]
    batch = pa.RecordBatch.from_arrays([pa.array(["a\nb\n\tc d \r\n", "z", "x"]), pa.array(asked, kind)], names=["text", "wanted"])
    got = [r for b in line_dedup._picked(iter([batch])) for r in b.to_pylist()]
    assert got == [{"node": 5, "root": 1, "text": "c d", "copies": 1}, {"node": 1, "root": 1, "text": "a", "copies": 1}]


def test_a_large_component_is_compared_by_sketches(monkeypatch):
    """The connected texts are those of a full comparison; next to no pair of two families is compared exactly."""
    texts = [f"{f}{t}" for f in range(6) for t in near_copies(150 + f, 40, 100 + f)] + [f"{i} alone in it all" * 9 for i in range(30)]
    texts = [t.replace("b", "xyzuvw"[int(t[0]) % 6] * 3) for t in texts] + [""]
    order = np.random.default_rng(1).permutation(len(texts))
    frame = pd.DataFrame({"root": 1, "a": 0, "b": 0, "block": 0, "node": order, "copies": 1, "text": [texts[i] for i in order]})
    chars = lambda t: shingles.char_shingles(t, 8)
    frame["sketch"] = tiles._sketches(frame["text"].tolist(), chars)
    asked, linked = [], tiles._Sets.linked
    monkeypatch.setattr(tiles._Sets, "linked", lambda own, i, j, t: asked.append(len(i)) or linked(own, i, j, t))
    for b in (0, 1):
        frame["b"], frame["block"] = b, np.arange(len(frame)) % 2 * b
        got, full = tiles._connected(frame, chars, 0.8), tiles._tile(frame, chars, 0.8, None)
        assert got["node"].equals(full["node"]) and got["reached"].equals(full["reached"])
        assert ((got["links"] > 0) == (full["links"] > 0)).all() and 100 < (got["links"] > 0).sum() < len(frame)
    assert sum(asked) < len(frame) ** 2 // 10, sum(asked)  # some 11 % of the pairs are of one family, many of them connected early


def test_a_large_component_of_lines_in_several_blocks(spark, monkeypatch):
    sketched = []
    monkeypatch.setattr(tiles, "_with_sketches", lambda s, made=tiles._with_sketches: sketched.append(1) or made(s))
    lines = near_copies(40, 4) + near_copies(30, 9, 60) + near_copies(5, 60, 130) + ["tiny", "tiny ", "tinz"]
    texts = {i: "\n".join(lines[i::6]) for i in range(6)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block_texts in (line_dedup.BLOCK_TEXTS, 9):
        monkeypatch.setattr(line_dedup, "BLOCK_TEXTS", block_texts)
        rows = line_dedup.dedup_documents(docs).collect()
        assert {r.doc_id: r.dropped_lines for r in rows} == brute.lines(texts)
    assert len(sketched) == 2


def test_only_wanted_lines_leave_their_texts(spark, monkeypatch):
    """Very many wanted lines are fetched by a map of their places, with no shuffle of the texts."""
    rows = [(i, i * 7, "\n".join(f"line {i} {n}" for n in range(200))) for i in range(20)] + [(None, 3, "a\n\n none "), (None, 4, "")]
    wanted = [(i, i * 7, n) for i in range(20) for n in (3, 199)] + [(None, 3, 2)]
    places = spark.createDataFrame(wanted, "first_doc_id long, first_text_key long, first_line_no int")
    texts = spark.createDataFrame(rows, "doc_id long, text_key long, text string")
    found = texts.mapInArrow(line_dedup._placed(*line_dedup._place_map(places)), "half long, rest long, text string").collect()
    expected = {f"line {i} {n}" for i, _, n in wanted[:-1]} | {"none"}
    assert expected <= {r.text for r in found} and len(found) < len(expected) + 600  # of 4,003 lines
    assert all(np.frombuffer(hashlib.md5(r.text.encode()).digest(), ">i8").tolist() == [r.half, r.rest] for r in found)

    lines = near_copies(40, 4) + near_copies(5, 60, 130) + ["tiny", "tiny ", "tinz"]
    texts = [(i if i else None, "\n".join(lines[i::6])) for i in range(6)] * 2 + [(3, "tiny\n" + lines[0])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    few = Counter(map(repr, line_dedup.dedup_documents(docs).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROW_LIMIT", 1)
    monkeypatch.setattr(line_dedup, "_picked", None)
    assert Counter(map(repr, line_dedup.dedup_documents(docs).collect())) == few


def test_fuzzy_lines(spark):
    lines = near_copies(40, 4) + near_copies(5, 60, 130) + ["tiny", "tiny ", "tinz"]
    texts = {i: "\n".join(lines[i::6]) for i in range(6)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = line_dedup.per_document(docs, line_dedup.marked_lines(docs)).collect()
    assert {r.doc_id: r.dropped_lines for r in rows} == brute.lines(texts)
    assert sum(len(r.dropped_lines) for r in rows) > 35


def test_cleaned_texts_keep_the_rest(documents, texts):
    gone = brute.lines(texts)
    expected = {}
    for i, text in texts.items():
        lines = text.split("\n")
        kept = [line for n, line in enumerate(lines) if n not in gone[i]]
        if not gone[i] or any(line.strip() for line in kept):
            expected[i] = "\n".join(kept)
    got = line_dedup.without_repeats(documents)
    assert got.columns == documents.columns
    assert {r.doc_id: r.text for r in got.collect()} == expected


def test_lines_awkward(awkward, empty):
    cleaned = line_dedup.without_repeats(awkward)
    assert cleaned.columns == awkward.columns
    texts = [(r.doc_id, r.text) for r in cleaned.collect()]
    kept = [r[:2] for r in AWKWARD if r[0] not in (2, 7, 9) and r[1] != SAME + " eleven"]
    # SAME is similar to the text with one word more, whose id is null and so comes first.
    kept = [k for k in kept if k != (1, SAME)] + [(None, SAME + " eleven"), (9, "Released under the MIT License.\n")]
    assert sorted(texts, key=repr) == sorted(kept, key=repr)
    assert line_dedup.without_repeats(empty).collect() == []
    assert line_dedup.per_document(empty, line_dedup.marked_lines(empty)).collect() == []


def test_dropped_lines_name_the_line_that_stays(spark):
    long = "a line of some length that is told apart by its end "
    rows = [(1, f"own\n{long}x"), (2, f"{long}y\n\n{long}z\nlast"), (None, "own"), (3, "last\nown"), (3, "own"), (3, "own"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.per_document(docs, line_dedup.marked_lines(docs))
    columns = ["doc_id", "n_lines", "n_kept", "dropped_lines", "class_docs", "class_lines"]
    got = sorted((tuple(r) for r in found.select(columns).collect()), key=repr)
    assert got == sorted(
        [
            (None, 1, 1, [], [], []),  # null ids come first, so this one stays for all others
            (1, 2, 1, [0], [None], [0]),
            (2, 3, 1, [0, 2], [1, 1], [1, 1]),
            (3, 2, 0, [0, 1], [2, None], [3, 0]),
            (3, 1, 0, [0], [None], [0]),
            (4, 0, 0, [], [], []),
        ],
        key=repr,
    )


def test_texts_under_one_id_keep_their_own_lines(spark):
    rows = [(None, "shared line\nsecond one"), (None, "first words\nshared line"), (4, "shared line\nfour"), (4, "4th\nshared line")]
    rows += [(5, "twice\nshared line")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in line_dedup.without_repeats(docs).collect()]
    kept = [(None, "shared line\nsecond one"), (None, "first words"), (4, "four"), (4, "4th"), (5, "twice"), (5, "twice")]
    assert Counter(got) == Counter(kept)


def test_one_of_each_group_of_documents_stays(spark):
    alone, other, empty_text = "quite another text of its own here", "and one more of other words again", " "
    rows = [(7, SAME)] * 3 + [(9, SAME), (None, SAME), (9, alone), (None, other), (None, other)] + [(3, empty_text)] * 2
    near = near_copies(3, 1)
    rows += [(None, near[0]), (None, near[1]), (12, near[2]), (12, near[2]), (13, near[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    got = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert got.columns == docs.columns
    kept = [(7, SAME), (9, alone), (None, other), (3, empty_text), (3, empty_text), (12, near[2])]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(kept)


# 7 and 8: vectors


def clustered(n=400, width=24, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    points = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, width)) * rng.choice([0.2, 0.4, 1.5], (n, 1))
    points[50:60] = points[49]
    return points * rng.uniform(0.2, 3, (n, 1))


BAD = [None, [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, []]


@pytest.fixture(scope="module")
def points(spark):
    x = clustered()
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)]
    rows += [(1000 + i, v) for i, v in enumerate(BAD)] + [rows[3], (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return x, df.withColumns({c: F.lit(1) for c in ("id", "vec", "key", "node", "a", "b", "q", "label")})


@pytest.mark.parametrize("block", [embed_dedup.BLOCK, 90])
def test_vectors_equal_brute_force(points, block):
    x, df = points
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = units @ units.T >= 0.9
    pairs = [(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j]
    root = brute.union(pairs, range(len(x)))
    # Vector 3 is there three times: under its id twice, and under no id.
    times = np.ones(len(x), int)
    times[3] = 3
    links = near @ times - 1
    expected = Counter({(i, int(links[i]), root[i], root[i] == i): 1 for i in range(len(x))})
    expected[3, int(links[3]), root[3], root[3] == 3] += 1
    expected[None, int(links[3]), root[3], False] += 1
    expected.update({(1000 + i, 0, 1000 + i, True): 1 for i in range(len(BAD))})
    got = embed_dedup.near_vectors(df, block=block).select("vec_id", "n_links", "component_id", "kept").collect()
    assert Counter(map(tuple, got)) == expected
    assert embed_dedup.near_vectors(df.limit(0)).collect() == []


def test_early_stop_loses_no_pair():
    x = clustered(300, 70, 5)
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    axes = np.linalg.eigh(units.T @ units)[1][:, ::-1]
    for threshold in (0.3, 0.9):
        linked = embed_dedup.linked_pairs(x[:200], x[100:], axes, threshold)
        assert np.array_equal(linked, units[:200] @ units[100:].T >= threshold)


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 256, (3000, 4)).astype(np.uint8)
    index = mih.Index(codes)
    for radius in (0, 3, 7, 9, 12, 32):
        for code in codes[:20]:
            expected = np.flatnonzero(np.bitwise_count(codes ^ code).sum(1) <= radius)
            assert np.array_equal(index.within(code, radius), expected)


def recall(rows, ids, x, k):
    found = {}
    for r in rows:
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for query in [i for i in ids if i % 20 == 0]:
        got = sorted(found.pop(query), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, len(got) + 1))
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        score = {i: float(v) for i, v in zip(ids, x @ x[ids.index(query)], strict=True) if i != query}
        assert all(r.score == pytest.approx(score[r.vec_id], abs=1e-12) for r in got)
        best = sorted(score, key=lambda i: (-score[i], i))[:k]
        assert len(got) == len(best)
        hits, total = hits + len(set(best) & {r.vec_id for r in got}), total + len(best)
    assert not found
    return hits / total


@pytest.mark.parametrize("block", [mih.BLOCK, 100])
def test_nearest_against_brute_force(points, block):
    x, df = points
    rows = mih.nearest(df, F.col("id") % 20 == 0, block=block, query_block=block // 4).collect()
    assert recall(rows, list(range(len(x))), x, 20) >= 0.9


def test_nearest_on_the_table(embeddings):
    rows = embeddings.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    assert recall(mih.nearest(embeddings, F.col("id") % 20 == 0).collect(), [r.vec_id for r in rows], x, 20) >= 0.9


def test_nearest_of_few_and_none(points):
    _, df = points
    few = df.where("vec_id in (0, 1, 2, 3, 1000)")
    assert sorted((r.query_id, r.vec_id) for r in mih.nearest(few, F.col("id") % 20 == 0).collect()) == [(0, 1), (0, 2), (0, 3)]
    assert mih.nearest(df.where("vec_id >= 1000"), F.col("id") % 20 == 0).collect() == []
    assert mih.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_rows_of_one_id_with_different_vectors(spark):
    """Each is a query with ranks of its own, and a candidate for the other."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.2, 0.8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in mih.nearest(df, F.col("id") % 20 == 0).collect()]
    assert sorted((q, rank, i, round(s, 3)) for q, rank, i, s in found) == [
        (20, 1, 3, 0.9), (20, 1, 4, 0.8), (20, 2, 3, 0.1), (20, 2, 4, 0.2), (20, 3, 20, 0.0), (20, 3, 20, 0.0),
    ]


def test_intermediate_files_go_when_asked_or_at_the_end(spark):
    import os

    from fleetgold.llm import common

    one, two = (common.written(spark.range(3), "kept") for _ in range(2))
    common.discard(one)
    assert not os.path.exists(one._folder) and two.count() == 3
    mine = {two._folder: common._folders.pop(two._folder)}
    others, common._folders = common._folders, mine
    common._remove_folders()
    common._folders = others
    assert not os.path.exists(two._folder)


# the pipeline


def written(df, purpose):
    folder = new_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def test_pipeline_stages(spark, documents, texts):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
        kept[name] = docs
        if name != "pack":
            assert docs.columns == documents.columns
    quality = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept["quality"].collect()}
    assert np.mean([(i in ids) == (r.quality == 1) for i, r in quality.items()]) > 0.97
    lines = {r.doc_id: r.text for r in kept["line_dedup"].collect()}
    gone = brute.lines({i: texts[i] for i in ids})
    assert all(len(lines[i].split("\n")) == len(texts[i].split("\n")) - len(gone[i]) for i in lines)
    classes = brute.documents(lines)
    assert {r.doc_id for r in kept["near_duplicates"].collect()} == {i for i, (c, _) in classes.items() if c == i}
    assert max(Counter(r.doc_id for r in kept["mix"].collect()).values()) <= 2
    mixed = Counter(r.doc_id for r in kept["mix"].collect())
    assert {r.doc_id for r in kept["pack"].collect()} == set(mixed)


@pytest.mark.parametrize("name", ["awkward", "empty"])
def test_pipeline_stages_take_awkward_tables(spark, request, name):
    docs = request.getfixturevalue(name)
    for stage, function in corpus_pipeline.STAGES:
        got = written(function(spark, docs, SMALL), stage)
        if stage != "pack":
            assert got.columns == docs.columns
        assert (got.count() == 0) == (name == "empty")
