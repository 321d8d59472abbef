"""One ranking from several differently-scaled scores (problem 3): outranking net flow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.plans.runtime import materialize

#: Differences of percentiles up to INDIFFERENCE are no preference, from PREFERENCE on a full one; between, preference grows evenly.
INDIFFERENCE, PREFERENCE = 0.05, 0.95
#: Scores of a group that one task ranks by itself; larger groups are ranked in pieces, by value, at most MOST_PIECES of them (pieces
#: of still larger groups grow; windows spill).
PIECE, MOST_PIECES = 200_000, 1000


def _percentile(place: Column, n: Column) -> Column:
    """Middle of an item's places among n, from 0 to 1; place is twice the middle place, counted from 0."""
    return place / (2 * n)


def _whole(long: DataFrame, keys: list[str], q: float, p: float) -> DataFrame:
    """Flows of groups that a task can rank by itself: the scores are sorted twice, and all sums are frames over them."""
    group, by = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("value")
    upto = F.count("*").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.count("*").over(Window.partitionBy(*keys, "value"))
    held = long.withColumn("n", F.count("*").over(group)).withColumn("x", _percentile(2 * upto - same, F.col("n")))
    part = ", ".join(f"`{k}`" for k in keys)
    # frames from the first row on, which only grow: what lies above is the rest
    frames = {"lq": f"{q}D preceding", "lp": f"{p}D preceding", "uq": f"{q}D following", "up": f"{p}D following"}
    over = lambda what, end: F.expr(f"{what} over (partition by {part} order by x range between unbounded preceding and {end})")
    held = held.withColumns({f"c{f}": over("count(x)", w) for f, w in frames.items()} | {f"s{f}": F.coalesce(over("sum(x)", w), F.lit(0.0)) for f, w in frames.items()})
    return _flows(held.withColumn("all", F.sum("x").over(group)), q, p)


def _flows(held: DataFrame, q: float, p: float) -> DataFrame:
    """Positive minus negative flow from n, all (the sum of x) and the counts (c) and sums (s) of the percentiles up to x - q (lq), x - p (lp), x + q
    (uq) and x + p (up). Those at such a place have no excess over it, so they may be counted on either side."""
    x, n, every = F.col("x"), F.col("n"), F.col("all")
    plus = F.col("clq") * (x - q) - F.col("slq") - (F.col("clp") * (x - p) - F.col("slp"))
    minus = every - F.col("suq") - (n - F.col("cuq")) * (x + q) - (every - F.col("sup") - (n - F.col("cup")) * (x + p))
    return held.withColumn("flow", F.when(n < 2, 0.0).otherwise((plus - minus) / ((p - q) * (n - 1))))


def _before(df: DataFrame, keys: list[str], order: str, what: dict[str, Column]) -> DataFrame:
    """Sums of `what` over the rows of the group whose `order` is smaller or equal, piece by piece."""
    own = [*keys, "piece"]
    upto = Window.partitionBy(*own).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    totals = df.groupBy(*own).agg(*[F.sum(c).alias(f"_{k}") for k, c in what.items()])
    lower = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a piece
    offsets = totals.select(*own, *[F.coalesce(F.sum(f"_{k}").over(lower), F.lit(0)).alias(f"_o{k}") for k in what])
    df = df.join(offsets, own)
    return df.withColumns({k: F.sum(c).over(upto) + F.col(f"_o{k}") for k, c in what.items()}).drop(*[f"_o{k}" for k in what])


def _in_pieces(long: DataFrame, sizes: DataFrame, keys: list[str], q: float, p: float, parts: int) -> DataFrame:
    """The same flows for groups of any size: pieces by quantiles of the value, then by percentile, with what lies in lower pieces added."""
    at = F.lit([(i + 1) / parts for i in range(parts - 1)])
    edges = long.groupBy(*keys).agg(F.percentile_approx("value", at, 10_000).alias("edges"))
    held = long.join(sizes, keys).join(edges, keys).withColumn("piece", F.size(F.filter("edges", lambda e: e <= F.col("value")))).drop("edges")
    held = _before(held, keys, "value", {"upto": F.lit(1)})
    same = F.count("*").over(Window.partitionBy(*keys, "piece", "value"))
    held = materialize(held.withColumn("x", _percentile(2 * F.col("upto") - same, F.col("n"))).select(*keys, "i", "value", "n", "x"))
    # every score asks for the sums up to four places; places and scores are sorted together, and a score at a place counts nothing there
    asked = F.array(*[F.struct(F.lit(name).alias("name"), (F.col("x") + d).alias("at")) for name, d in (("", 0.0), ("lq", -q), ("lp", -p), ("uq", q), ("up", p))])
    spots = held.select(*keys, "i", "x", F.explode(asked).alias("a")).select(*keys, "i", "x", "a.*")
    spots = spots.withColumn("piece", F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(F.col("at") * parts).cast("int"))))
    own = F.col("name") == ""
    spots = _before(spots, keys, "at", {"c": F.when(own, 1).otherwise(0), "s": F.when(own, F.col("x")).otherwise(0.0)})
    sums = spots.where(~own).groupBy(*keys, "i").agg(*[F.max(F.when(F.col("name") == f, F.col(c))).alias(f"{c}{f}") for f in ("lq", "lp", "uq", "up") for c in "cs"])
    total = held.groupBy(*keys).agg(F.sum("x").alias("all"))
    return _flows(held.join(sums, [*keys, "i"]).join(total, keys), q, p)


def net_flow_ranking(
    items: DataFrame, group: str, item: str, scores: list[str], weights: list[float] | None = None, piece: int = PIECE, indifference: float = INDIFFERENCE,
    preference: float = PREFERENCE,
) -> DataFrame:
    """One row per (group, item): net_flow in [-1, 1], and the number of scores it had.

    A score becomes its percentile among the group's items with that score (ties share the middle of their places), so its scale and
    distribution don't count. An item is preferred to another by 0 if its percentile is higher by `indifference` or less, by 1 from `preference` on,
    and evenly between. The positive flow is the mean preference over all others, the negative flow the mean of theirs over it. Both come
    from sorted prefix sums: the preference over all lower items is a difference of two sums of excesses, over those lower by
    more than either threshold. The net flow is the weighted mean of positive minus negative over the scores. Every score weighs alike unless weights are given.

    Defined cases: a null, NaN or missing score counts as a flow of 0, neither for nor against; a group with one item gets
    flow 0; equal net flows are ordered by item; rows with a null group or item are left out; if (group, item)
    repeats with other scores, the largest of each score counts. Extra columns are ignored.
    """
    if not 0 <= indifference < preference:
        raise ValueError("indifference must be at least 0 and under preference")
    weights = weights or [1.0] * len(scores)
    base = items.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(group).alias("g"), F.col(item).alias("i"))
    clean = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")) for s in scores]
    base = materialize(base.agg(*[F.max(c).alias(f"s{k}") for k, c in enumerate(clean)]))
    long = base.select("g", "i", F.posexplode(F.array(*[F.col(f"s{k}") for k in range(len(scores))])).alias("k", "value")).where("value is not null")
    keys, q, p = ["g", "k"], float(indifference), float(preference)
    # groups over a piece: at most items / piece of them
    large = materialize(base.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > piece))
    most = large.agg(F.max("n")).first()[0]
    if most is None:
        flows = _whole(long, keys, q, p)
    else:
        names = large.select("g")
        small, big = long.join(names, "g", "left_anti"), long.join(names, "g", "left_semi")
        sizes = big.groupBy(*keys).agg(F.count("*").alias("n"))
        parts = max(2, min(MOST_PIECES, -(-most // piece)))
        flows = _whole(small, keys, q, p).select(*keys, "i", "flow").unionByName(_in_pieces(big, sizes, keys, q, p, parts).select(*keys, "i", "flow"))
    weigh = reduce(lambda a, k: F.when(F.col("k") == k, float(weights[k])).otherwise(a), range(len(scores)), F.lit(0.0))
    # a row for every item, also for those without a score; in the sum, items of a group stay where they were ranked
    none = base.where(reduce(lambda a, b: a & b, [F.col(f"s{k}").isNull() for k in range(len(scores))])).select("g", "i", F.lit(None).cast("double").alias("f"))
    each = flows.select("g", "i", (F.col("flow") * weigh).alias("f")).unionByName(none)
    out = each.groupBy("g", "i").agg(F.sum("f").alias("f"), F.count("f").alias("n_scores"))
    net = F.round(F.coalesce("f", F.lit(0.0)) / float(sum(weights)), 9) + F.lit(0.0)
    return out.select(F.col("g").alias(group), F.col("i").alias(item), net.alias("net_flow"), "n_scores")


def best_item(ranked: DataFrame, group: str, item: str, least_items: int = 1) -> DataFrame:
    """The first item of each group with at least least_items items; an aggregate, so no group is gathered in a task."""
    first = F.max_by(F.col(item), F.struct(F.col("net_flow"), -F.col(item))).alias(item)
    return ranked.groupBy(group).agg(first, F.count("*").alias("_n")).where(F.col("_n") >= least_items).drop("_n")
