"""Operators 11, 12 and 13, each against a plain Python version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from checks.compare import differences, duck
from fleetgold.llm import infill, queries, resample, url_filter
from fleetgold.llm.batches import as_bytes, by_bytes
from fleetgold.llm.oracle import ORACLE
from pyspark.sql import functions as F

from cases import AWKWARD, SMALL


@pytest.mark.parametrize("name", ["op7_embedding_dedup", "op9_ngram_join", "op12_url_filter", "op13_infill"])
def test_query_equals_sql(spark, name):
    assert differences(spark, duck(SMALL), queries.QUERIES[name], ORACLE[name], SMALL) == []


def draws(seed, doc_id, n):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(n)]


# 11: importance resampling


def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def word_runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, percent=5, least=20, buckets=10_000):
    bucket = lambda run: zlib.crc32(run.encode()) % buckets
    raw = Counter(bucket(r) for _, t in docs for r in word_runs(t)[1])
    wanted = Counter(bucket(r) for t in target for r in word_runs(t)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = [
        math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)
    ]
    out = []
    for doc_id, text in docs:
        words, runs = word_runs(text)
        weight = sum(gain[bucket(r)] for r in runs)
        h = draws(42, doc_id, 1)[0]
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(runs), weight, score, None, len(words)])
    long_enough = [r for r in out if r[5] >= least]
    order = sorted(long_enough, key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(order[: percent * len(long_enough) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, out), key=repr)


def resampled(df):
    columns = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_resampling_equals_brute_force(spark, texts):
    found = resampled(queries.op11_resampling(spark, SMALL))
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert found == brute_resample(list(texts.items()), target)
    assert sum(r[4] is not None for r in found) == 5 * sum(r[5] >= 20 for r in found) // 100


def test_features_do_not_depend_on_slices():
    text = ("Ähm, One2 two-THREE\x00four \U0001f600 x\xa0y " * 40 + "a" * 100).encode()
    whole = [h for _, hashes in resample.features(text, size=1 << 20) for h in hashes]
    words, runs = word_runs(text.decode())
    assert Counter(whole) == Counter(zlib.crc32(r.encode()) for r in runs)
    for size in (1, 2, 3, 17, 64):
        parts = list(resample.features(text, size=size))
        assert len(parts) > 3
        assert Counter(h for _, hashes in parts for h in hashes) == Counter(whole)
        assert sum(n for n, _ in parts) == len(words)
    assert list(resample.features(b"")) == []


def test_resampling_awkward(spark, awkward, empty):
    target = spark.createDataFrame([("one two three",), (None,), ("",)], "text string")
    few = dict(percent=50, least_words=2)
    expected = brute_resample([(i, t) for i, t, _ in AWKWARD], ["one two three"], 50, 2)
    assert resampled(resample.resample(awkward, target, **few)) == expected
    assert resampled(resample.resample(awkward, target.limit(0), **few)) == brute_resample(
        [(i, t) for i, t, _ in AWKWARD], [], 50, 2
    )
    assert resampled(resample.resample(empty, target)) == []


def test_resampling_draws_all_and_breaks_ties_by_id(spark):
    same = spark.range(60).select(F.lit(None).cast("long").alias("doc_id"), F.lit("b c d").alias("text"))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text")).unionByName(same)
    target = spark.createDataFrame([("a b c",)], "text string")
    found = resampled(resample.resample(docs, target, percent=100, least_words=3))
    expected = brute_resample([tuple(r) for r in docs.collect()], ["a b c"], 100, 3)
    assert found == expected
    assert sorted(r[4] for r in found) == list(range(1, 101))


# 12: URL filter

URLS = [
    None, "", "no scheme", "http://", "https://NET/", "http://net", "http://a.net", "http://a.net/", "x://A.Example.NET/en/1?q#f",
    "http://example.net/en", "http://example.net/en/", "http://notexample.net/en/", "http://example.com/de/x", "http://ÄB.org/fr/",
    "http://a.b.c.d.e.f.example.com/de/", "http://net./x", "http://.net/x", "http://a..net//x", "q://x://y.net/z", "http://org?/fr/",
    "http://user@example.org:80/fr/", "http://org/fr/" + "deep/" * 3000, "http://" + "l." * 3000 + "net/a b\nc", "http://x/en\n/://y",
]


def brute_verdict(url, rules, default="allow"):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (lower_ascii(found[1]), found[2]) if found else ("", "")
    best = None
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        name = lower_ascii(name)
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            best = max(best or (0, 0, False, "", ""), (len(rule), len(name), verdict == "block", rule, verdict))
    return host, path, best[3] if best else None, best[4] if best else default


def judged(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)


def pages(spark, urls):
    rows = [(None if i % 9 == 0 else i % 20, u, "x", "y") for i, u in enumerate(urls)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, prefix string, rule string")


@pytest.mark.parametrize("few", [True, False])
def test_url_filter_equals_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(url_filter, "broadcast_checked", lambda df: df)
    rng = random.Random(5)
    labels, steps = ["a", "b", "net", "org", ""], ["", "en", "de", "x"]
    some = lambda names, n, by: by.join(rng.choice(names) for _ in range(rng.randint(1, n)))
    urls = URLS + [f"http://{some(labels, 4, '.')}/{some(steps, 4, '/')}?{some(steps, 2, '/')}" for _ in range(300)]
    rules = [*queries.URL_RULES, ("a", "block"), ("A.net/e", "block"), ("b/en", "allow"), ("b/en", "block"), ("b.net//", "allow"), ("/", "block")]
    rules += [(f"{some(labels, 2, '.')}/{some(steps, 2, '/')}", rng.choice(["allow", "block"])) for _ in range(30)]
    rows, df = pages(spark, urls)
    index = spark.createDataFrame([*rules, *rules, (None, "block")], "rule string, verdict string")
    assert judged(url_filter.judge(df, index)) == sorted(
        ((i, *brute_verdict(u, rules)) for i, u, *_ in rows), key=repr
    )


def test_url_filter_without_pages_or_rules(spark):
    rows, df = pages(spark, URLS)
    none = spark.createDataFrame([], "rule string, verdict string")
    assert judged(url_filter.judge(df, none, default="block")) == sorted(
        ((i, *brute_verdict(u, [], "block")) for i, u, *_ in rows), key=repr
    )
    some = spark.createDataFrame(queries.URL_RULES, "rule string, verdict string")
    assert judged(url_filter.judge(df.limit(0), some)) == []


def test_few_rules_are_broadcast(spark):
    _, df = pages(spark, URLS)
    some = spark.createDataFrame(queries.URL_RULES, "rule string, verdict string")
    plan = url_filter.judge(df, some)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "EvalPython" not in plan and "CartesianProduct" not in plan


# 13: fill in the middle


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = draws(1, doc_id, 4)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    spm = h[3] % 100 < 20
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), "spm" if spm else "psm", len(prefix), len(middle), output


def test_units_of_any_text():
    rng = random.Random(3)
    alphabet = "ab YZ@[`{az\n0\x00\x7f" + "éßÀ\u07ff\u0800€\uffff\U00010000😀"
    for _ in range(200):
        some = ["".join(rng.choices(alphabet, k=rng.choice([0, 0, 1, 3, 9, 40]))) for _ in range(rng.randint(1, 12))]
        raw = [t.encode() for t in some]
        bounds = np.cumsum([0, *map(len, raw)])
        units = infill.Units(np.frombuffer(b"".join(raw), np.uint8), bounds)
        expected, at = [], 0
        for t in some:
            for u in re.findall(r"[A-Za-z]+|[^A-Za-z]", t):
                at += len(u.encode())
                expected.append(at)
        k = np.arange(1, len(expected) + 1)
        assert units.behind(k).tolist() == expected
        places = np.arange(bounds[-1] + 1)
        assert units.rank(places).tolist() == [sum(e <= p for e in expected) for p in places]


def test_marks_do_not_depend_on_blocks(monkeypatch):
    text = ("word é😀 " * 500).encode()
    bounds = np.array([0, 1000, 1000, len(text)])
    whole = infill.Units(np.frombuffer(text, np.uint8), bounds)
    monkeypatch.setattr(infill, "BLOCK", 3)
    assert np.array_equal(infill.Units(np.frombuffer(text, np.uint8), bounds).marks, whole.marks)


def infilled(df):
    text = infill.restored(F.col("output"), F.col("form")).alias("text")
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    return sorted((tuple(r) for r in df.select(*columns, text).collect()), key=repr)


def test_infill_equals_brute_force_and_restores(documents, awkward, empty, texts, spark):
    both = lambda i, t: (*brute_infill(i, t), t or "")
    assert infilled(infill.infill(documents)) == sorted((both(i, t) for i, t in texts.items()), key=repr)
    assert infilled(infill.infill(awkward)) == sorted((both(i, t) for i, t, _ in AWKWARD), key=repr)
    assert infilled(infill.infill(empty)) == []
    tricky = ["<", "<P", "<P<S", "a<P>b", "<M>", "<S> ", "x<M", "<P<P<S<S<M<M", ">S>P>", "é<😀>P", "\x00", "<P><S><M>"]
    rows = [(i, tricky[i % len(tricky)]) for i in range(600)]
    found = infilled(infill.infill(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == sorted((both(i, t) for i, t in rows), key=repr)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_batches_are_cut_by_bytes():
    texts = pa.array([None, "a" * 10, "", "b" * 300, "c", "é" * 60, None, "d"])
    batch = pa.RecordBatch.from_arrays([texts, pa.array(range(8))], names=["text", "n"])
    for size in (1, 50, 100, 10_000):
        parts = list(by_bytes([batch.slice(0, 0), batch.slice(1), batch], "text", size))
        assert [n for p in parts for n in p.column("n").to_pylist()] == [*range(1, 8), *range(8)]
        assert all(p.num_rows == 1 or sum(map(len, as_bytes(p.column("text")))) < 2 * size + 300 for p in parts)
        for p in parts:
            data, bounds = infill.joined(p.column("text").fill_null(""))
            assert [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)] == as_bytes(p.column("text"))
