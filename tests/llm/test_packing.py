import numpy as np

from attestra.llm.packing import harmonic_packing, pack


def test_no_container_overflows_and_little_is_left():
    rng = np.random.default_rng(1)
    for capacity in (1, 7, 256, 1000):
        for sizes in (rng.integers(1, capacity + 1, 500), np.full(30, capacity), np.full(31, 1), np.minimum(capacity, rng.zipf(1.5, 2000)), np.empty(0, np.int64)):
            bins = pack(sizes, capacity)
            if len(sizes):
                load = np.bincount(bins, weights=sizes)
                assert load.max() <= capacity and load.min() > 0 and bins.min() == 0
    sizes = rng.integers(1, 257, 5000)
    assert len(np.unique(pack(sizes, 256))) * 256 <= 1.2 * sizes.sum()


def test_pieces_are_whole_and_split_only_if_longer(spark):
    rows = [(1, 10), (2, 25), (3, 5), (4, 0), (5, None), (6, 3), (6, 3), (7, 20), (8, -2)]
    df = spark.createDataFrame([(i, n, "x") for i, n in rows], "doc_id long, n_tokens long, container string")
    caps = spark.createDataFrame([(1, 10), (2, 100), (3, 0)], "capacity_id int, max_tokens int")
    for shard in (2, 1000):
        out = harmonic_packing(df, "doc_id", "n_tokens", caps, shard).collect()
        for cap, limit in ((1, 10), (2, 100)):
            mine = [r for r in out if r["capacity_id"] == cap]
            total = {}
            for r in mine:
                total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
            assert total == {1: 10, 2: 25, 3: 5, 6: 6, 7: 20}
            assert all(r["piece"] == 0 for r in mine if dict(rows)[r["doc_id"]] <= limit)
            load = {}
            for r in mine:
                load[r["container"]] = load.get(r["container"], 0) + r["n_tokens"]
            assert all(load[r["container"]] + r["unused"] == limit for r in mine)
        assert {r["capacity_id"] for r in out} == {1, 2}
    assert harmonic_packing(df.where("doc_id = 99"), "doc_id", "n_tokens", caps).count() == 0
