from attestra.llm.mixing import Curriculum


def make(spark, piece=100_000, **options):
    docs = [(i, "big", 50 + i % 7) for i in range(2000)] + [(5000 + i, "small", 40) for i in range(20)] + [(6000 + i, "mid", 90) for i in range(300)]
    docs += [(9000, "other", 5), (9001, None, 5), (9002, "big", 0), (9003, "big", None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, source string, n_tokens long, weight string")
    targets = spark.createDataFrame([("big", 0.7, 2), ("small", 0.02, 5), ("mid", 0.18, 4), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    return Curriculum(df, targets, "doc_id", piece=piece, **options)


def test_shares_caps_and_order(spark):
    for piece in (100_000, 300):
        mix = make(spark, piece)
        shares = {r["source"]: r for r in mix.shares().collect()}
        for source, share, cap in (("big", 0.7, 2), ("small", 0.02, 5), ("mid", 0.18, 4)):
            assert abs(shares[source]["actual_share"] - share / 0.9) < 0.004
            assert 0 < shares[source]["most_uses"] <= cap
        assert shares["absent"]["actual_share"] == 0 and "other" not in shares
        usage = mix.usage().collect()
        assert len(usage) == 2320 and sum(r["uses"] * r["n_tokens"] for r in usage) == sum(r["used_tokens"] for r in shares.values())
        order = mix.order().collect()
        assert len(order) == sum(r["uses"] for r in usage)
        at = [r["position"] for r in order]
        assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
        # each source has its weight at each time: the cumulative share follows the integrated schedule
        plan = {r["source"]: r for r in mix.plan.collect()}
        for s in ("big", "mid"):
            half = sum(r["n_tokens"] for r in order if r["source"] == s and r["position"] <= 0.5)
            expected = plan[s]["total"] * plan[s]["weight"] * (0.5 + plan[s]["tilt"] * 0.25)
            assert abs(half - expected) < 0.02 * expected + 100
        assert plan["small"]["tilt"] < 0 < plan["big"]["tilt"]


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix = Curriculum(spark.createDataFrame([], "doc_id long, source string, n_tokens long"), targets, "doc_id")
    assert mix.usage().count() == mix.order().count() == 0
    assert [tuple(r) for r in mix.shares().collect()] == [("a", 1.0, 0.0, 0, 0, 0, 1.0)]


def test_a_larger_total_and_other_schedules(spark):
    for tilt in (0.0, 0.9):
        mix = make(spark, total=300_000, tilt=tilt)
        shares = {r["source"]: r for r in mix.shares().collect()}
        # big and small give all they may, mid as much as is asked of it
        assert shares["big"]["used_tokens"] == 2 * shares["big"]["available_tokens"] and shares["small"]["used_tokens"] == 5 * 800
        assert abs(shares["mid"]["used_tokens"] - 300_000 * 0.2) < 100
        assert shares["small"]["unmet_share"] > 0 and abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
        assert {r["uses"] for r in mix.usage().where("source = 'big'").collect()} == {2}
        assert mix.order().where("position < 0 or position > 1").count() == 0
    even = make(spark, tilt=0.0).order().where("source = 'mid' and position <= 0.5").count()
    assert abs(even - make(spark, tilt=0.0).order().where("source = 'mid'").count() / 2) <= 1
