import random

from orbitlake.operators.components import components
from orbitlake.operators.skew import hot_keys, lookup, numbered
from orbitlake.runtime import Scratch

EDGES = "scope long, u long, v long"


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, u, v in edges:
        if None not in (s, u, v):
            a, b = find((s, u)), find((s, v))
            root[max(a, b)] = min(a, b)
    return sorted((s, n, find((s, n))[1]) for s, n in root if find((s, n)) != (s, n))


def check(spark, edges):
    got = components(spark.createDataFrame(edges, EDGES), Scratch(spark, "test"))
    assert sorted(tuple(r) for r in got.collect()) == brute(edges)


def test_random(spark):
    rnd = random.Random(5)
    check(spark, [(s, rnd.randrange(90), rnd.randrange(90)) for s in (1, 2) for _ in range(60)] + [(1, None, 3), (None, 1, 2), (1, 4, 4), (3, 8, 9), (3, 9, 8)])


def test_chain_star_empty(spark):
    check(spark, [(1, k, k + 1) for k in range(40)] + [(2, 7, k) for k in range(100, 140)])
    check(spark, [])


def test_contracted_in_bounds(spark, monkeypatch):
    rnd = random.Random(7)
    edges = [(s, rnd.randrange(60), rnd.randrange(60)) for s in (1, 2) for _ in range(50)] + [(3, k, k + 1) for k in range(200)]
    for held in (100_000, 6):
        monkeypatch.setattr("orbitlake.operators.components.LOCAL", held)
        check(spark, edges)


def test_chains_take_few_rounds(spark):
    # Links that lie together are contracted beforehand, so that two rounds do.
    edges = spark.range(2000).selectExpr("id div 500 scope", "id u", "id + 1 v").where("u % 500 < 499")
    assert components(edges, Scratch(spark, "test"), max_rounds=3).where("root != scope * 500").count() == 0


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr("orbitlake.operators.skew.TASK_ROWS", 10)
    scratch = Scratch(spark, "test")
    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 else id end k", "id v")
    hot, n = hot_keys(rows, ["k"], scratch)
    assert n == 3000 and [r.k for r in hot.collect()] == [7]
    least = rows.groupBy("k").agg({"v": "min"}).withColumnRenamed("min(v)", "low")
    assert lookup(rows, least, ["k"], hot).where("low is null or k != 7 and low != v or k = 7 and low != 0").count() == 0
    assert hot_keys(rows.limit(0), ["k"], scratch) == (None, 0)


def test_numbered(spark):
    rows = spark.range(500).selectExpr("id % 3 g", "1000 - id o")
    got = {(r.g, r.o): r.n for r in numbered(rows, "g", ["o"], "n", Scratch(spark, "test")).collect()}
    for g in range(3):
        at = sorted(o for h, o in got if h == g)
        assert [got[g, o] for o in at] == list(range(len(at)))
