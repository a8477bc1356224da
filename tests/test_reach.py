"""Reach over several parts against a plain fixpoint; components and places by brute force."""

import random

import pytest

from codeloom.operators import graph
from codeloom.operators import reach as reach_module
from codeloom.operators.reach import GROUP, PART, components, numbered


def plain(edges):
    nodes = sorted({n for e in edges for n in e})
    bit = {n: 1 << k for k, n in enumerate(nodes)}
    seen = dict.fromkeys(nodes, 0)
    follow = {}
    for s, d in edges:
        follow.setdefault(s, []).append(d)
    moved = True
    while moved:
        moved = False
        for n in reversed(nodes):
            now = seen[n]
            for d in follow.get(n, ()):
                now |= bit[d] | seen[d]
            moved |= now != seen[n]
            seen[n] = now
    return {n: (seen[n] & ~bit[n]).bit_count() for n in nodes}


@pytest.mark.parametrize("seed", [0, 1])
def test_reach_over_parts_equals_a_plain_fixpoint(spark, seed):
    rng = random.Random(seed)
    n = 3 * PART + 100  # four parts: chains along a part, jumps both ways, a circle through all parts, lone loops
    big = [(k, k + 1) for k in range(0, n, 7)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(n if seed else n // 3)]
    big += [(10, PART + 10), (PART + 10, 3 * PART + 5), (3 * PART + 5, 2 * PART), (2 * PART, 10), (5, 5)]
    small = [(1, 2), (2, 1), (2, 3)]
    rows = [("big", f"n{s:06}", f"n{d:06}") for s, d in big] + [("small", f"n{s}", f"n{d}") for s, d in small]
    found = {(r["project"], r["node"]): r["reach"] for r in graph.reach(spark.createDataFrame(rows, "project string, src string, dst string")).collect()}
    want = {("big", f"n{k:06}"): r for k, r in plain(big).items()} | {("small", "n1"): 2, ("small", "n2"): 2, ("small", "n3"): 0}
    assert found == want


def test_more_targets_than_a_group(spark):
    # a chain of nodes that each lead to a fan of their own, so that places go beyond one group of targets
    assert GROUP * PART == 131_072
    n = GROUP * PART + 50
    from pyspark.sql import functions as F

    k = F.col("id")
    edges = spark.range(n).select(F.lit("p").alias("project"), F.when(k < n - 10, F.lit(n - 10)).otherwise(k).alias("src"), k.alias("dst"))
    found = {r["node"]: r["reach"] for r in graph.reach(edges).where(F.col("node") >= n - 10).collect()}
    assert found == {n - 10: n - 10, **{n - j: 0 for j in range(1, 10)}}


def test_components():
    rng = random.Random(4)
    for _ in range(30):
        n = rng.randrange(1, 25)
        follow = [[rng.randrange(n) for _ in range(rng.randrange(3))] for _ in range(n)]
        reach = {k: set() for k in range(n)}
        for _ in range(n):
            for k in range(n):
                for d in follow[k]:
                    reach[k] |= {d} | reach[d]
        found = components(follow)
        assert sorted(x for one in found for x in one) == list(range(n))
        for one in found:
            assert set(one) == {k for k in range(n) if k == one[0] or (k in reach[one[0]] and one[0] in reach[k])}
        place = {x: at for at, one in enumerate(found) for x in one}
        assert all(place[d] <= place[k] for k in range(n) for d in follow[k])


def test_places(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(1000), k) for k in range(3000)]
    found = numbered(spark.createDataFrame(rows, "g string, v int, k int").repartition(7), "g", "v", "k").collect()
    for g in ("a", "b", None):
        want = [k for _, _, k in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])]
        assert [r["k"] for r in sorted((r for r in found if r["g"] == g), key=lambda r: r["place"])] == want
        assert sorted(r["place"] for r in found if r["g"] == g) == list(range(len(want)))


def check(spark, rows):
    found = {(r["project"], r["node"]): r["reach"] for r in graph.reach(spark.createDataFrame(rows, "project string, src long, dst long")).collect()}
    want = {}
    for p in {p for p, _, _ in rows}:
        want |= {(p, k): r for k, r in plain([(s, d) for q, s, d in rows if q == p]).items()}
    assert found == want


@pytest.mark.parametrize("seed", [0, 1])
def test_chains_circles_and_hubs(spark, monkeypatch, seed):
    monkeypatch.setattr(reach_module, "_large", lambda nodes: nodes.select("project").distinct())
    rng, rows = random.Random(seed), []
    for p in range(25):
        n, fan = rng.randrange(2, 60), rng.choice([0.5, 0.9, 1, 1.3, 2, 4])
        rows += [(f"any{p}", rng.randrange(n), rng.randrange(n)) for _ in range(int(n * fan) + 1)]
        rows += [(f"one{p}", k, rng.randrange(n)) for k in range(n)]  # trees that lead to circles
        rows += [(f"down{p}", k, rng.randrange(k)) for k in range(1, n) for _ in range(rng.choice([1, 1, 2]))]  # without circles
    check(spark, rows)


def test_a_hub_that_is_far_away_is_given_up(spark, monkeypatch):
    monkeypatch.setattr(reach_module, "_large", lambda nodes: nodes.select("project").distinct())
    monkeypatch.setattr(reach_module, "WAVES", 3)
    check(spark, [("ladder", k, k + j) for k in range(40) for j in (1, 2)])


def test_a_long_chain_takes_few_rounds(spark):
    names = list(range(PART + 1000))
    random.Random(3).shuffle(names)  # so that each step comes to another part
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    edges = spark.createDataFrame([("chain", a, b) for a, b in zip(names, names[1:])], "project string, src long, dst long")
    found = {r["node"]: r["reach"] for r in graph.reach(edges).collect()}
    assert found == {name: len(names) - 1 - k for k, name in enumerate(names)}
    assert store.executionsCount() - before < 100


def test_most_of_a_large_net_reach_each_other(spark):
    rng = random.Random(7)
    n = PART + 2000
    check(spark, [("net", k, rng.randrange(n)) for k in range(n) for _ in range(2)] + [("small", 1, 2), ("small", 2, 2)])
