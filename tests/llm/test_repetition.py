import random
import re

from attestra.llm.repetition import most_deficit, repetition, repetitive
from attestra.llm.tokens import VOCABULARY, counter, encoding, token_counts


def brute(text):
    words = [re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in (text or "").split()]
    words = [w for w in words if w]
    seen, marked = set(), set()
    for i in range(len(words) - 4):
        run = tuple(words[i : i + 5])
        if run in seen:
            marked |= set(range(i, i + 5))
        seen.add(run)
    return len(words), len(marked)


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "...", "one two three four", "a " * 30, "слово " * 4]
    for _ in range(60):
        vocabulary = [f"w{k}" for k in range(rng.choice([3, 20, 2000]))]
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 200))]
        a = rng.randrange(len(words))
        words += words[a : a + rng.randrange(1, 120)]
        out.append(" ".join(rng.choice([w, w.upper() + ",", f"«{w}»", "— " + w]) for w in words))
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, byte_share double")
    got = {r["doc_id"]: (r["n_words"], r["repeated_words"]) for r in repetition(df, "doc_id", "text").collect()}
    assert got == {i: brute(t) for i, t in rows}
    found = {r["doc_id"] for r in repetitive(df, "doc_id", "text").collect()}
    assert found == {i for i, t in rows if brute(t)[0] and brute(t)[1] >= 0.3 * brute(t)[0]}
    assert repetition(df.where("doc_id < 0"), "doc_id", "text").count() == 0


def test_fertility_bands(spark):
    rows = [(1, "The results of the study show that the general approach is useful when the sample is large."), (2, "𒀀𒀁𒀂 𒀃𒀄𒀅 𒀆𒀇𒀈"), (3, None)]
    got = {r["doc_id"]: r for r in repetition(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert not got[1]["rejected"] and got[1]["script"] == "latin" and got[1]["byte_share"] == 0
    assert got[2]["rejected"] and got[2]["byte_share"] > 0.6 and not got[3]["rejected"]


def test_piecewise_token_counts_are_exact(spark):
    rng = random.Random(2)
    rows = ["", "x", " a", "a ", "a\n b", "a \n b", "\xa0 b\xa0", "it's  two", "\n\n x \ty"]
    rows += ["".join(rng.choice(["слово", "word", " ", "\n", ", ", "12", "'s", "\t", "\xa0", "—"]) for _ in range(30)) for _ in range(200)]
    enc, count = encoding(VOCABULARY), counter(VOCABULARY)
    assert [count(t) for t in rows] == [len(enc.encode_ordinary(t)) for t in rows]
    df = spark.createDataFrame([(1, "word", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in token_counts(df, "doc_id", "text", ["source"]).collect()) == [(1, "s", 1), (2, None, 0)]


def test_the_band_of_runs_loses_nothing_and_leaves_prose_alone(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (0.1, 0.3, 0.6):
        beyond = {r["doc_id"] for r in repetition(df, "doc_id", "text", share=share).collect() if "runs" in r["rejected"].split(",")}
        assert beyond >= {i for i, t in rows if brute(t)[0] and brute(t)[1] >= share * brute(t)[0]}
    prose = " ".join(f"word{i} the of {i * 7 % 101} and" for i in range(200))
    got = repetition(spark.createDataFrame([(1, prose)], "doc_id long, text string"), "doc_id", "text").first()
    assert got["run_deficit"] == 0 and "runs" not in got["rejected"] and got["repeated_words"] == 0
    assert most_deficit(0.3) > 0.089
