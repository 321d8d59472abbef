import random
import re

from pyspark.sql import functions as F

from attestra.functions import text as T
from attestra.operators.chunking import chunk_texts, split_text, thin_evenly


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_tokens_and_words(spark):
    assert one(spark, T.tokens, "Привет, мир_1 éa-b") == ["привет", "мир_1", "éa", "b"]
    assert one(spark, T.tokens, None) is None
    assert [one(spark, T.word_count, v) for v in ("a b\n c d ", " \t", "", None)] == [4, 0, 0, 0]
    assert one(spark, T.strip, "  \n x y \t") == "x y"


def test_segments(spark):
    assert one(spark, T.segments, "Ok.") == ["Ok."]
    assert one(spark, T.segments, "Short one\n\nShort two") == []
    long = "This paragraph is long enough."
    assert one(spark, T.segments, f"{long}\n \nno\n\n{long} And more.") == [long, f"{long} And more."]
    assert one(spark, lambda c: T.segments(c, 1), "Aaa. Bbb! Ccc… Ddd") == ["Aaa.", "Bbb!", "Ccc…", "Ddd"]
    assert one(spark, T.segments, "  \n") == [] == one(spark, T.segments, None)


def test_bands_and_files(spark):
    rows = [(0.75, "high"), (0.7499, "medium"), (0.55, "medium"), (0.35, "low"), (0.3499, "none"), (None, "none")]
    got = spark.createDataFrame(rows, "x double, y string").select(T.band(F.col("x")).alias("b"), "y").collect()
    assert all(r["b"] == r["y"] for r in got)
    rows = [(60.0, "high"), (35.0, "medium"), (15.0, "low"), (14.99, "none")]
    got = spark.createDataFrame(rows, "x double, y string").select(T.band(F.col("x"), T.PERCENT_BANDS).alias("b"), "y").collect()
    assert all(r["b"] == r["y"] for r in got)
    assert [one(spark, T.extension, v) for v in ("A.DOCX", "x/y.tar.gz", "none", ".hidden", None)] == [".docx", ".gz", "", "", ""]
    assert [one(spark, T.source_ids, v) for v in ("[1,2]", "3, x,4", "", None)] == [[1, 2], [3, 4], [], []]
    assert one(spark, T.risk_label, "?") == "Не определено"


def test_pasted_blocks(spark):
    raw = "First\nText one\n---\nSecond\nText two\nmore\n---\nonly text\n---\n" + "x" * 80 + "\nrest\n------"
    got = [(r["label"], r["text"]) for r in one(spark, T.pasted_blocks, raw)]
    assert got == [("First", "Text one"), ("Second", "Text two\nmore"), ("Источник 3", "only text"), ("Источник 4", "x" * 80 + "\nrest")]


def test_thinning(spark):
    for n, m, kept in ((6, 3, [0, 2, 5]), (8, 3, [0, 4, 7]), (10, 4, [0, 3, 6, 9]), (5, 1, [0]), (3, 5, [0, 1, 2]), (4, 0, [0, 1, 2, 3])):
        df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("i"))
        assert sorted(r["i"] for r in thin_evenly(df, "g", "i", m).collect()) == kept


def test_chunks(spark):
    rng = random.Random(1)
    assert split_text(None) == [] == split_text(" \n ")
    assert split_text("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]
    for _ in range(50):
        word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 60)))
        t = "".join(rng.choice([word(), " ", "\n", "\n\n"]) for _ in range(rng.randrange(1, 80)))
        chunks = split_text(t, 40, 10)
        assert all(0 < len(c) <= 40 and c == c.strip() for c in chunks)
        squeeze = lambda s: re.sub(r"\s", "", s)
        at = 0
        for c in chunks:  # nothing is lost, order is kept
            assert squeeze(t).find(squeeze(c), max(0, at - 12)) >= 0
            at = squeeze(t).find(squeeze(c), max(0, at - 12)) + len(squeeze(c))
        assert at == len(squeeze(t))
    df = spark.createDataFrame([(1, "a b", 0), (2, None, 0)], "id long, t string, chunk_index int")
    assert [tuple(r) for r in chunk_texts(df, "id", "t").collect()] == [(1, 0, "a b")]
