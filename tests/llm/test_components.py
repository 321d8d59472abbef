import random

from attestra.llm import components
from attestra.llm.components import connected_groups


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None:
            for x in (a, b):
                if x is not None:
                    find(x)
            continue
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def run(spark, pairs):
    df = spark.createDataFrame([(a, b, "x", 0) for a, b in pairs], "l long, r long, group_id string, n int")
    return {r["vertex"]: r["group_id"] for r in connected_groups(df, "l", "r").collect()}


def test_chains_stars_nulls_and_repeats(spark):
    rng = random.Random(5)
    ids = list(range(1000, 1060))
    rng.shuffle(ids)
    pairs = list(zip(ids, ids[1:])) + [(7, i) for i in range(20, 50)] + [(99, i) for i in range(200, 230)]
    pairs += [(5, 5), (None, 3), (2, None), (None, None), (20, 7), (20, 7)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    assert run(spark, pairs) == brute(pairs)


def test_hot_vertices_go_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_DEGREE", 5)
    pairs = [(500, i) for i in range(1, 60)] + [(i, i + 100) for i in range(1, 30)]
    assert run(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [(4, 4)]) == {4: 4}
