"""Share merging and checks against a plain loop over small random data."""

import random

import pytest
from helpers import rows
from fleetgold.operators import shares
from fleetgold.plans.runplan import run_plan
from pyspark.sql import functions as F

LISTING = "tenant_id string, share_id string, table_key string, is_list boolean, ord bigint, location string, format string"
RUN = "launch_id string, tenant_id string, product_id string, share_ids array<string>, wants array<string>"


def random_case(seed):
    r = random.Random(seed)
    tenants, known, tables = ["t1", "t2"], [f"s{i}" for i in range(6)], ["A", "B", "C"]
    listings = []
    for tenant in tenants:
        for share in known:
            if r.random() < 0.25:
                continue
            for key in tables:
                n = r.choice([0, 0, 1, 2, 3])
                is_list = r.random() < 0.7
                for at in range(n):
                    listings.append(
                        (tenant, share, key, is_list, at, f"/{tenant}/{share}/{key}/{at}", r.choice(["delta", "delta", "csv"]))
                    )
    runs = []
    for p in range(25):
        ports = [r.choice(known) for _ in range(r.randint(0, 4))]
        wants = [r.choice([*tables, " A", ""]) for _ in range(r.choice([0, 0, 1, 2, 3]))]
        runs += [("L", tenant, f"p{p}", ports, wants) for tenant in tenants]
    return listings, runs


def by_loop(listings, runs):
    """Merged lists, readiness and gaps, one run after the other."""
    merged, ready, gaps = {}, {}, {}
    for _, tenant, product, ports, wants in runs:
        tables, complete = {}, True
        for port, share in enumerate(ports, 1):
            mine = [x for x in listings if x[0] == tenant and x[1] == share]
            complete = complete and bool(mine)
            for key in {x[2] for x in mine}:
                entry = [(port, x) for x in mine if x[2] == key]
                both_lists = key in tables and tables[key][-1][1][3] and entry[0][1][3]
                tables[key] = tables[key] + entry if both_lists else entry
        ready[(tenant, product)] = complete
        for key, entries in tables.items():
            merged[(tenant, product, key)] = entries
        bad = [w for w in wants if w not in tables or tables[w][0][1][6] != "delta"]
        if bad:
            gaps[(tenant, product)] = (len(bad), bad[0])
    return merged, ready, gaps


@pytest.mark.parametrize("seed", range(4))
def test_against_a_loop(spark, seed):
    listings, runs = random_case(seed)
    merged, ready, gaps = by_loop(listings, runs)
    l, r = spark.createDataFrame(listings, LISTING), spark.createDataFrame(runs, RUN)

    got = {tuple(x[:3]): (x[3], x[4]) for x in rows(shares.share_merge(r, l).drop("launch_id"))}
    assert got == {k: (len(v), v[0][1][5]) for k, v in merged.items()}

    lists = {}
    for x in shares.share_locations(r, l).orderBy("port_ord", "ord").collect():
        lists.setdefault((x.tenant_id, x.product_id, x.table_key), []).append((x.port_ord, x.location))
    assert lists == {k: [(p, x[5]) for p, x in v] for k, v in merged.items()}

    assert {(x.tenant_id, x.product_id): x.ready for x in shares.share_readiness(r, l).collect()} == ready
    found = shares.dependency_gaps(r, l).collect()
    assert {(x.tenant_id, x.product_id): (x.n_missing, x.first_missing) for x in found} == gaps


def test_states_rank_product_faults_first(spark):
    listings = spark.createDataFrame([("t1", "s1", "A", True, 0, "/a", "delta")], LISTING)
    coords = "struct<layer string, namespace string, version string, name string>"
    products = spark.createDataFrame(
        [
            ("L", "no name", None, ("gold", "ns", "1", ""), ["x"], ["s9"], ["t1"], ["x"]),
            ("L", "no version", None, ("gold", "ns", None, "N"), [], [], ["t1"], []),
            ("L", "no coordinates", None, None, [], [], ["t1"], []),
            ("L", "bad", "c", ("gold", "ns", "1", "N"), ["x", "input_tables=A"], ["s9"], ["t1"], ["x"]),
            ("L", "no share", "c", ("gold", "ns", "1", "N"), ["input_tables=B"], ["s9"], ["t1"], []),
            ("L", "unchecked", "c", ("gold", "ns", "1", "N"), ["input_tables="], ["s1"], ["t1"], []),
            ("L", "no ports", "c", ("gold", "ns", "1", "N"), [], [], ["t1"], []),
            ("L", "no ports, wants", "c", ("gold", "ns", "1", "N"), ["input_tables=A"], [], ["t1"], []),
            ("L", "gap", "c", ("gold", "ns", "1", "N"), ["input_tables=A,B"], ["s1"], ["t1"], []),
            ("L", "ready", "c", ("gold", "ns", "1", "N"), ["input_tables=B", "input_tables=A"], ["s1"], ["t1", "t2"], []),
            ("L", "no tenants", "c", ("gold", "ns", "1", "N"), [], [], [], []),
        ],
        f"launch_id string, product_id string, correlation_id string, coordinates {coords.replace(' string', ': string')}, "
        "params array<string>, share_ids array<string>, tenants array<string>, bad_params array<string>",
    )
    got = {(r.product_id, r.tenant_id): r.state for r in run_plan(products, listings).collect()}
    assert got == {
        ("no name", "t1"): "BAD_COORDINATES",
        ("no version", "t1"): "BAD_COORDINATES",
        ("no coordinates", "t1"): "BAD_COORDINATES",
        ("bad", "t1"): "BAD_PARAMS",
        ("no share", "t1"): "SKIP_SHARES",
        ("unchecked", "t1"): "READY_UNCHECKED",
        ("no ports", "t1"): "READY_UNCHECKED",
        ("no ports, wants", "t1"): "SKIP_TABLES",
        ("gap", "t1"): "SKIP_TABLES",
        ("ready", "t1"): "READY",
        ("ready", "t2"): "SKIP_SHARES",
    }


def test_unreadable_first_location_is_a_gap(spark):
    listings = spark.createDataFrame(
        [("t", "s", "A", True, 0, "/csv", "csv"), ("t", "s", "A", True, 1, "/ok", "delta")], LISTING
    )
    runs = spark.createDataFrame([("L", "t", "p", ["s"], ["A"])], RUN)
    assert rows(shares.dependency_gaps(runs, listings), "n_missing", "first_missing") == [(1, "A")]
    assert shares.dependency_gaps(runs, listings, readable=["csv"]).isEmpty()
    assert shares.dependency_gaps(runs.withColumn("wants", F.array().cast("array<string>")), listings).isEmpty()


def test_readiness_of_odd_runs(spark):
    listings = spark.createDataFrame([("t", "s", "A", True, 0, "/a", "delta"), (None, "s", "A", True, 0, "/a", "delta")], LISTING)
    ports = {"known": ["s"], "first unknown": ["x", "s"], "last unknown": ["s", "s", "x"], "null share": ["s", None],
             "only null": [None], "none": [], "null": None}
    runs = [("L", "t", p, shares, []) for p, shares in ports.items()]
    runs += [("L", "t", "twice", ["s"], []), ("L", "t", "twice", ["s", "x"], []), ("L", "t", "twice, none", [], []), ("L", "t", "twice, none", ["x"], [])]
    runs += [(None, None, None, ["s"], []), ("L", None, "no tenant", [], []), ("L", None, None, None, [])]
    got = {tuple(r[:3]): r.ready for r in shares.share_readiness(spark.createDataFrame(runs, RUN), listings).collect()}
    ready = {("L", "t", p): p in ("known", "none", "null") for p in [*ports, "twice", "twice, none"]}
    assert got == ready | {(None, None, None): False, ("L", None, "no tenant"): True, ("L", None, None): True}


def test_input_types(spark):
    listings = spark.createDataFrame([], LISTING)
    runs = spark.createDataFrame([], RUN)
    with pytest.raises(TypeError, match="wants"):
        shares.dependency_gaps(runs.withColumn("wants", F.array(F.lit(1))), listings)
    with pytest.raises(TypeError, match="format"):
        shares.share_readiness(runs, listings.drop("format"))
    with pytest.raises(TypeError, match="share_ids"):
        shares.share_merge(runs.withColumn("share_ids", F.lit("s1")), listings)
