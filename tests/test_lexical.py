import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from attestra.operators import lexical, lexical_index
from attestra.operators.lexical import best_matches, compare, hybrid_scores, originality

TEXT = ["Искусственный интеллект меняет подход к анализу текстов.", "Современные системы проверяют оригинальность на нескольких уровнях.", "Лексический анализ выявляет прямое копирование фрагментов."]
SOURCES = [
    "Искусственный интеллект меняет подход к анализу текстов в образовании.", "Современные системы проверяют оригинальность работ студентов.",
    "Машинное обучение применяется в медицине и финансах для прогнозирования."]


def frames(spark, queries, corpus):
    q = spark.createDataFrame([(s, i, t) for s, i, t in queries], "scope int, q long, text string")
    return q, spark.createDataFrame([(s, i, t) for s, i, t in corpus], "scope int, c long, text string")


def test_known_scores(spark):
    q, c = frames(spark, [(0, 0, " ".join(TEXT[:2])), (1, 0, " ".join(TEXT))], [(0, 0, SOURCES[0]), (0, 1, "Машинное обучение применяется в медицине и финансах."), *((1, i, t) for i, t in enumerate(SOURCES))])
    got = {(r["scope"], r["c"]): r for r in hybrid_scores(q, c).collect()}
    for key, tfidf, bm25, combined in (((0, 0), 0.5135, 0.0, 0.3081), ((1, 0), 0.4474, 1.0, 0.6684), ((1, 1), 0.2950, 0.6801, 0.4490)):
        assert [got[key][k] for k in ("tfidf", "bm25", "combined")] == pytest.approx([tfidf, bm25, combined], abs=6e-5)
    best = {r["scope"]: r for r in best_matches(q, c).collect()}
    assert (best[0]["c"], best[0]["combined_score"], best[0]["risk_level"], best[0]["is_borrowing"]) == (0, 0.3081, "none", False)
    assert (best[1]["c"], best[1]["combined_score"], best[1]["risk_level"], best[1]["is_borrowing"]) == (0, 0.6684, "medium", True)
    assert {r["scope"]: r["originality_percent"] for r in originality(best_matches(q, c), "scope").collect()} == {0: 100.0, 1: 16.6}


def test_compare_known(spark):
    q, c = frames(spark, [(0, i, t) for i, t in enumerate(TEXT)], [(0, i, t) for i, t in enumerate(SOURCES[:2])])
    r = compare(q, c).first()
    assert (r["similarity_percent"], r["tfidf_percent"], r["bm25_percent"], r["originality_percent"]) == (26.9, 44.9, 0.0, 73.1)


def dense(queries, corpus):
    """All pairs by the formulas."""
    tok = lambda t: re.findall(r"\w+", (t or "").lower())
    q, c = [tok(t) for t in queries], [tok(t) for t in corpus]
    n, df = len(q) + len(c), Counter(w for d in q + c for w in set(d))

    def vec(d):
        v = {w: (1 + math.log(f)) * (math.log((1 + n) / (1 + df[w])) + 1) for w, f in Counter(d).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    cdf = Counter(w for d in c for w in set(d))
    idf = {w: math.log(len(c) - k + 0.5) - math.log(k + 0.5) for w, k in cdf.items()}
    mean = sum(idf.values()) / max(1, len(idf))
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    avg = sum(map(len, c)) / max(1, len(c))
    out = []
    for a in q:
        va = vec(a)
        bm = [sum(idf.get(w, 0) * (f := Counter(b)[w]) * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(b) / avg)) for w in a) for b in c]
        top = max(bm)
        row = [max(0, min(1, 0.6 * sum(x * vec(b).get(w, 0) for w, x in va.items()) + 0.4 * (s / top if top > 0 else s))) for b, s in zip(c, bm)]
        out.append((max(range(len(c)), key=lambda j: (round(row[j], 9), -j)), max(row)))
    return out


def test_against_dense_scores_with_nulls_ties_and_no_terms(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 15)))
    queries = [text() for _ in range(20)] + ["zzz unseen", "...", None, ""]
    corpus = [text() for _ in range(15)]
    corpus += corpus[:3] + [None, "—"]
    q, c = frames(spark, [(0, i, t) for i, t in enumerate(queries)], [(0, i, t) for i, t in enumerate(corpus)])
    got = {r["q"]: (r["c"], r["combined_score"]) for r in best_matches(q, c).collect()}
    assert {r["q"]: (r["c"], r["combined_score"]) for r in best_matches(q, c, prune=False).collect()} == got
    for i, (j, s) in enumerate(dense(queries, corpus)):
        assert got[i] == (j, pytest.approx(s, abs=6e-5)), i
    none = best_matches(q, c.where("c < 0")).collect()
    assert len(none) == len(queries) and all(r["c"] is None and r["combined_score"] == 0 for r in none)
    assert best_matches(q.where("q < 0"), c).count() == 0


def test_one_comparison_writes_no_pairs_in_any_number_of_passes(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{min(i, rng.randrange(300))}" for i in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))
    queries, corpus = [text() for _ in range(60)] + ["", None], [text() for _ in range(90)]
    corpus += corpus[:9]
    q, c = frames(spark, [(0, i, t) for i, t in enumerate(queries)], [(0, i, t) for i, t in enumerate(corpus)])
    whole = {r["q"]: tuple(r) for r in best_matches(q, c, prune=False).collect()}

    def joined(*_):
        raise AssertionError("pairs are joined")

    monkeypatch.setattr(lexical, "_meet", joined)
    for terms in (lexical.PASS_TERMS, 100):
        monkeypatch.setattr(lexical, "PASS_TERMS", terms)
        assert {r["q"]: tuple(r) for r in best_matches(q, c).collect()} == whole


def test_the_side_with_fewer_terms_is_sent(spark, monkeypatch):
    rng = random.Random(7)
    text = lambda: " ".join(f"w{rng.randrange(40)}" for _ in range(6))
    q, c = frames(spark, [(0, i, text()) for i in range(80)], [(0, i, text()) for i in range(9)])
    whole = {r["q"]: tuple(r) for r in best_matches(q, c, prune=False).collect()}
    searched = []
    write = lexical.materialize
    monkeypatch.setattr(lexical, "materialize", lambda df: (searched.append(df.columns), write(df))[1])
    monkeypatch.setattr(lexical, "PASS_TERMS", 60)  # the corpus' 9 units fit in one pass, the queries wouldn't
    assert {r["q"]: tuple(r) for r in best_matches(q, c).collect()} == whole
    assert searched.count(["q", "c", "tfidf", "raw"]) == 1


@pytest.mark.parametrize("longest", [12, 4000])
def test_rounded_sums_lose_no_best_unit(longest):
    rng = np.random.default_rng(longest)
    words, n = 300, 250

    def counts(rows, most):
        return [np.unique(rng.integers(0, words, rng.integers(1, most)) ** 2 // words, return_counts=True) for _ in range(rows)]

    def units(held, terms):
        return lexical_index.Units(np.arange(len(held)), np.array([len(t) for t, _ in held]), np.concatenate([t for t, _ in held]), np.concatenate([f for _, f in held]), terms)

    cs, qs = counts(n, 30), counts(40, longest)
    df = np.bincount(np.concatenate([t for t, _ in cs]), minlength=words)
    terms = lexical_index.Terms(np.arange(words), np.log((1 + n) / (1 + df)) + 1, np.where(df > 0, np.maximum(np.log(n - df + 0.5) - np.log(df + 0.5), 0.2), 0), 15.0)
    corpus, asked = units(cs, terms), units(qs, terms)
    cosine, sums, gain = np.zeros((40, n)), np.zeros((40, n)), corpus.gains(terms)
    for i in range(40):
        w, f = np.zeros((2, words))
        at = slice(asked.at[i], asked.at[i + 1])
        w[asked.term[at]], f[asked.term[at]] = asked.w[at], asked.f[at]
        cosine[i], sums[i] = np.bincount(corpus.row, w[corpus.term] * corpus.w, n), np.bincount(corpus.row, f[corpus.term] * gain, n)
    got = {int(q): (c, x, y) for q, c, x, y in lexical_index.search(lexical_index.Block(corpus, terms), asked, words, (0.6, 0.4))}
    for i in np.flatnonzero(sums.max(1) > 0).tolist():
        c, x, y = got[i]
        assert y.max() == pytest.approx(sums[i].max())
        for top in (sums[i].max(), 3 * sums[i].max()):  # with the largest sum here, and a larger one elsewhere
            assert (0.6 * x + 0.4 * y / top).max() == pytest.approx((0.6 * cosine[i] + 0.4 * sums[i] / top).max())


def test_what_a_query_has_several_times_is_rounded_once(monkeypatch):
    terms = lexical_index.Terms(np.arange(3), np.array([1.0, 2.0, 3.0]), np.array([0.5, 1.0, 1.5]), 2.0)
    held = [([0, 1], [1, 2]), ([1, 2], [1, 1]), ([2], [4])]
    make = lambda rows: lexical_index.Units(np.arange(len(rows)), np.array([len(t) for t, _ in rows]), np.concatenate([t for t, _ in rows]), np.concatenate([f for _, f in rows]), terms)
    block = lexical_index.Block(make(held), terms)
    asked = make([([0, 1], [1, 3]), ([1, 2], [3, 9]), ([1], [3])])
    first = [[x.tolist() for x in found[1:]] for found in lexical_index.search(block, asked, 3, (0.6, 0.4))]
    assert set(block.kept) == {(1, 3)}  # nine times is not kept
    rint = np.rint
    monkeypatch.setattr(np, "rint", lambda x: (_ for _ in ()).throw(AssertionError("rounded again")) if len(x) == 2 else rint(x))
    again = make([([0, 1], [1, 3]), ([1], [3])])
    assert [[x.tolist() for x in found[1:]] for found in lexical_index.search(block, again, 3, (0.6, 0.4))] == [first[0], first[2]]


def test_units_that_lie_evenly_are_not_dealt_again(spark, monkeypatch):
    text = lambda i: " ".join(f"w{(i * k) % 37}" for k in range(1, 9))
    plans, write = [], lexical.materialize
    monkeypatch.setattr(lexical, "materialize", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if "terms" in df.columns else None, write(df))[1])
    rows = [(0, i, text(i)) for i in range(120)]
    q, c = frames(spark, rows[:40], rows)
    got = {r["q"]: tuple(r) for r in best_matches(q, c).collect()}
    assert len(plans) == 2 and not any("Repartition" in p for p in plans)
    plans.clear()
    assert {r["q"]: tuple(r) for r in best_matches(q.coalesce(1), c.coalesce(1)).collect()} == got
    assert all("Repartition" in p for p in plans)  # one task had them all


def test_blocks_hold_so_many_units():
    batches = pa.table({"c": list(range(25))}).to_batches(max_chunksize=7)
    assert [b.column(0).to_pylist() for b in lexical._blocks(iter(batches), 10)] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
