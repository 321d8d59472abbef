import math
import random

from attestra.llm.ranking import best_item, net_flow_ranking


def brute(rows, scores, q=0.05, p=0.95):
    groups = {}
    for g, i, *v in rows:
        if g is not None and i is not None:
            cell = groups.setdefault(g, {}).setdefault(i, [None] * scores)
            for k, x in enumerate(v):
                if x is not None and not math.isnan(x):
                    cell[k] = x if cell[k] is None else max(x, cell[k])
    out = {}
    for g, items in groups.items():
        for i, v in items.items():
            net = 0.0
            for k in range(scores):
                known = [x[k] for x in items.values() if x[k] is not None]
                if v[k] is None or len(known) < 2:
                    continue
                place = lambda x: (sum(y < x for y in known) + 0.5 * sum(y == x for y in known)) / len(known)  # noqa: B023, E731
                diff = [place(v[k]) - place(y) for y in known]
                prefer = lambda d: min(1.0, max(0.0, (d - q) / (p - q)))
                net += sum(prefer(d) - prefer(-d) for d in diff) / (len(known) - 1)
            out[g, i] = net / scores
    return out


def test_against_all_pairs_and_in_pieces(spark):
    rng = random.Random(1)
    rows = []
    for g in range(6):
        for i in range(rng.choice([1, 2, 5, 40])):
            rows.append((g, i, *[rng.choice([None, float("nan"), rng.random() * s, float(rng.randrange(4))]) for s in (1.0, 900.0, 3.0)]))
    rows += rows[:3] + [(None, 1, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc long, seg int, a double, b double, c double, k string")
    for q, p in ((0.05, 0.95), (0.0, 0.3), (0.1, 0.11)):
        expected = brute(rows, 3, q, p)
        for piece in (10, 200_000):
            got = {(r["doc"], r["seg"]): r["net_flow"] for r in net_flow_ranking(df, "doc", "seg", ["a", "b", "c"], piece=piece, indifference=q, preference=p).collect()}
            assert got.keys() == expected.keys()
            assert all(abs(got[k] - expected[k]) < 2e-9 for k in got)


def test_no_score_dominates(spark):
    rows = [(1, 0, 0.9, 10.0), (1, 1, 0.8, 20.0), (1, 2, 0.1, 5000.0), (2, 0, 0.5, None), (2, 1, 0.5, None)]
    df = spark.createDataFrame(rows, "doc long, seg int, a double, b double")
    ranked = net_flow_ranking(df, "doc", "seg", ["a", "b"])
    first = {r["doc"]: r["seg"] for r in best_item(ranked, "doc", "seg").collect()}
    assert first == {1: 0, 2: 0}
    assert best_item(ranked, "doc", "seg", 3).count() == 1
    assert net_flow_ranking(df.where("doc = 9"), "doc", "seg", ["a", "b"]).count() == 0
