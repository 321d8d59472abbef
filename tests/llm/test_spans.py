import random
import zlib

import numpy as np
import pyarrow as pa

from attestra.llm import spans
from attestra.llm.spans import SharedSpans

LETTERS = "abcdefghij klmnop"


def brute(rows, length):
    grams = {r: {t[i : i + length] for i in range(len(t) - length + 1)} for r, t in rows if t}
    names = sorted(grams)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if grams[a] & grams[b]}


def covered(rows, length):
    grams = {r: [t[i : i + length] for i in range(len(t) - length + 1)] for r, t in rows if t}
    out = {}
    for r, t in rows:
        hit = set()
        for i, g in enumerate(grams.get(r, [])):
            if any(g in set(x) for o, x in grams.items() if o != r):
                hit |= set(range(i, i + length))
        out[r] = len(hit)
    return out


def make(seed, length):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    rows = [(f"d{i}", text(rng.randrange(0, 4 * length))) for i in range(25)]
    for i in range(12):
        shared = text(rng.choice([length - 1, length, length + 1, length + 40]))
        for j in rng.sample(range(25), 2):
            t = rows[j][1]
            at = rng.randrange(len(t) + 1)
            rows[j] = (rows[j][0], t[:at] + shared + t[at:])
    rows += [("c1", rows[0][1] + "x" * length), ("c2", "x" * (length + 30)), ("c3", None), ("c4", ""), ("c5", rows[3][1]), ("c6", rows[3][1])]
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = make(seed, 60)
        df = spark.createDataFrame([(r, t, 1) for r, t in rows], "rec string, text string, cls int")
        shared = SharedSpans(df, 60)
        got = [tuple(r) for r in shared.pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 60)
        assert {r["rec"]: r["shared_chars"] for r in shared.coverage().collect()} == covered(rows, 60)


def test_hot_windows(spark):
    """A window that many texts hold is grouped by whole stretches: short boilerplate makes no pairs, real ones do."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    short, long = text(50), text(70)
    rows = [(f"d{i:03}", text(80) + short + text(80)) for i in range(90)] + [(f"c{i}", text(30) + long + text(20)) for i in range(70)]
    df = spark.createDataFrame(rows, "rec string, text string")
    assert {tuple(r) for r in SharedSpans(df, 60).pairs().collect()} == brute(rows, 60)


def test_hot_passage_makes_no_pairs_of_places(spark):
    """A passage of 150 characters in 80 texts: coverage needs no pairs, and pairs come once."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    long = text(150)
    rows = [(f"c{i}", text(30) + long + text(20)) for i in range(80)]
    shared = SharedSpans(spark.createDataFrame(rows, "rec string, text string"), 60)
    assert shared.matches.count() < 80 * 79 // 2 and shared.hot_pairs().count() == shared.pairs().count() == 80 * 79 // 2
    assert {r["rec"]: r["shared_chars"] for r in shared.coverage().collect()} == covered(rows, 60)


def test_empty(spark):
    shared = SharedSpans(spark.createDataFrame([], "rec string, text string"))
    assert shared.pairs().count() == shared.spans().count() == shared.coverage().count() == 0


def test_shared_passages_say_what_pairs_say(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    long = text(90)
    rows = make(3, 60) + [(f"h{i:03}", text(30) + long + text(20)) for i in range(70)] + [(f"e{i}", long) for i in range(5)]
    shared = SharedSpans(spark.createDataFrame(rows, "rec string, text string"), 60)
    got = [tuple(r) for r in shared.shared().collect()]
    assert len(got) == len(set(got)) and len(got) < 1500
    holders: dict[str, list[str]] = {}
    for p, r in got:
        holders.setdefault(p, []).append(r)
    same: dict[str, list[str]] = {}
    for r, t in rows:
        same.setdefault(t or r, []).append(r)
    alike = {min(rs): rs for rs in same.values()}
    pairs = set()
    for p, rs in holders.items():
        full = [x for r in rs for x in (alike[r] if "-" in p else [r])]
        pairs |= {(a, b) for a in full for b in full if a < b}
    assert pairs == brute(rows, 60)


def test_sketches_of_parts_add_up():
    bits = 16
    rng = np.random.default_rng(1)
    size = (1 << bits) // spans.BLOCKS
    lists = [np.sort(rng.choice(size, 30)).astype(np.uint32) for _ in range(6)]
    pack = lambda x: zlib.compress(np.diff(x, prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
    table = lambda rows: pa.table({"block": pa.array([3] * len(rows), pa.int32()), "cells": pa.array(rows, pa.binary())})
    parts = [spans._merge_lists(bits)(table([pack(x) for x in some])).column("cells")[0].as_py() for some in (lists[:2], lists[2:3], lists[3:])]
    merged = spans._merge_bits(bits)(table(parts)).column("cells")[0].as_py()
    got = np.unpackbits(np.frombuffer(zlib.decompress(merged), np.uint8))[:size]
    assert (got == (np.bincount(np.concatenate(lists), minlength=size) > 1)).all()
