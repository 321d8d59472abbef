import json

import numpy as np
import pyarrow as pa

from attestra.llm import neighbours
from attestra.llm.neighbours import Quantiser, _nearest, similar_pairs, vector_classes


def brute(vectors, k=5):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for r, row in enumerate(s):
        cut = np.sort(row)[::-1][min(k, len(row) - 1) - 1]
        out |= {(min(ids[r], ids[j]), max(ids[r], ids[j])) for j in np.flatnonzero(row >= cut - 1e-6) if j != r}
    return out


def make(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d))
    return {i * 3: (centres[rng.integers(40)] + rng.normal(size=d)).round(4) * rng.uniform(0.2, 5) for i in range(n)}


def run(spark, rows, d):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, embedding_json string, vec string")
    got = [(r["a"], r["b"]) for r in similar_pairs(df, "id", "embedding_json", d).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def test_small_sets_are_exact_and_bad_vectors_left_out(spark):
    v = make(150, 8, 1)
    v[9] = v[12] = v[15] = v[0]
    v[21] = v[0] * 2
    rows = [(i, json.dumps(list(map(float, x)))) for i, x in v.items()]
    rows += [(1, None), (2, ""), (4, "[]"), (5, "[1,2"), (7, json.dumps([0.0] * 8)), (8, "[1,2,3,4,5,6,7,NaN]"), (10, '["1",2,3,4,5,6,7,8]'), (11, json.dumps([1] * 9)), (13, "{}"), (14, "[true,2,3,4,5,6,7,8]"), (16, "[1e999,2,3,4,5,6,7,8]")]
    assert run(spark, rows, 8) == brute(v)
    assert run(spark, rows[150:], 8) == set() == run(spark, [], 8)
    assert run(spark, rows[:1], 8) == set() and run(spark, [rows[0], rows[1]], 8) == {(0, 3)}


def test_recall_over_many_cells_and_blocks(spark, monkeypatch):
    v = make(4000, 16, 2)
    true = brute(v)
    for block in (32_768, 100):  # 12 blocks, and 40, of which a vector visits 8
        monkeypatch.setattr(neighbours, "BLOCK", block)
        got = run(spark, [(i, json.dumps(list(map(float, x)))) for i, x in v.items()], 16)
        assert len(got & true) / len(true) > 0.95 and len(got & true) / len(got) > 0.95


def test_a_dense_region_is_dealt_and_nothing_in_it_is_lost(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 60)
    monkeypatch.setattr(neighbours, "LANDMARKS", 1)
    monkeypatch.setattr(neighbours, "PROBED", 0.7)
    rng = np.random.default_rng(5)
    v = {i: rng.normal(size=8) + (40 if i < 4000 else 0) for i in range(5000)}
    x = np.array(list(v.values()), np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    fitted = Quantiser.fit(x, len(x))
    assert fitted.dealt.max() > 1 and len(fitted.block) == len(fitted.cells)
    got = run(spark, [(i, json.dumps(list(map(float, y)))) for i, y in v.items()], 8)
    true = brute(v)
    assert len(got & true) / len(true) > 0.95


def test_what_is_sent_does_not_grow_with_the_blocks():
    class model:
        value = Quantiser.fit(np.random.default_rng(1).normal(size=(26_000, 16)).astype(np.float32), 2_000_000)

    assert model.value.dealt.max() == 1 and len(model.value.dealt) == 62
    x = np.random.default_rng(2).normal(size=(3000, 16)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array([r.tobytes() for r in x]), pa.array([1] * 3000, pa.int64())], ["id", "vec", "copies"])
    sent = pa.Table.from_batches(list(neighbours._route(model, 16)(iter([batch]))))
    visits = np.bincount(sent.column("id").to_numpy())
    assert 1 <= visits.min() and visits.max() == neighbours.VISITS
    home = sent.column("id").to_numpy()[~sent.column("away").to_numpy()]
    assert sorted(home.tolist()) == list(range(3000))


def test_classes(spark):
    rows = [(3, "[1,0]"), (5, "[2,0]"), (7, "[0,1]"), (9, None), (11, "[0,0]")]
    df = spark.createDataFrame(rows, "id long, embedding_json string")
    assert sorted(tuple(r) for r in vector_classes(df, "id", "embedding_json", 2).collect()) == [(3, 3), (5, 3), (7, 7)]


def test_beam_search_encodes_closely():
    x = np.random.default_rng(3).normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = Quantiser.fit(x, len(x))
    near = q.cells[_nearest(x, q.cells, 1)[:, 0]]
    codes, half = q.encode(x, near)
    stands_for = near + sum(q.books[m][codes[:, m]] for m in range(len(q.books)))
    assert np.allclose(half, (stands_for**2).sum(1) / 2, atol=1e-4)
    assert ((x - stands_for) ** 2).sum(1).mean() < 0.05
