"""Mixing sources to target weights (problem 9): a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.plans.runtime import materialize

#: How much a source's weight changes over training, unless told otherwise: it starts at (1 + TILT) times its share and ends at (1 - TILT)
#: times, or the reverse; tilts are balanced so that the weights always sum to 1.
TILT = 0.5
#: Documents of a source in one run of the prefix sums.
PIECE = 100_000


def _plan(sized: DataFrame, targets: DataFrame, total: int | None, tilt: float) -> DataFrame:
    """Per source: what it has, what it must give, and the tilt of its weight; a row a source of the targets."""
    have = sized.groupBy("source").agg(F.sum("n").alias("available"), F.count("*").alias("documents"))
    plan = targets.join(have, "source", "left").fillna(0, ["available", "documents"])
    plan = plan.withColumn("usable", (F.col("available") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0))
    whole = Window.partitionBy(F.lit(0))  # a row a source: the targets table
    plan = plan.withColumn("weight", F.when(F.col("usable"), F.col("target_share")).otherwise(0.0))
    plan = plan.withColumn("weight", F.coalesce(F.try_divide(F.col("weight"), F.sum("weight").over(whole)), F.lit(0.0)))
    # the largest total at which no source is needed more often than it may be
    most = F.floor(F.min(F.when(F.col("usable"), F.col("available") * F.col("max_repeats") / F.col("weight"))).over(whole))
    plan = plan.withColumn("total", most if total is None else F.lit(total).cast("long"))
    plan = plan.withColumn("demand", F.coalesce(F.floor(F.col("total") * F.col("weight")), F.lit(0)))
    # small sources late, large ones early: tilts of both signs whose weighted sum is 0
    order = Window.partitionBy(F.lit(0)).orderBy("weight", "source")
    plan = plan.withColumn("up", F.sum("weight").over(order) <= 0.5)
    late = F.sum(F.when(F.col("up"), F.col("weight"))).over(whole)
    early = F.sum(F.when(~F.col("up"), F.col("weight"))).over(whole)
    less = F.least(late, early)
    slope = F.when(F.col("up"), F.try_divide(-tilt * less, late)).otherwise(F.try_divide(tilt * less, early))
    return plan.withColumn("tilt", F.coalesce(slope, F.lit(0.0)))


def _position(demand: Column, tilt: Column) -> Column:
    """The time in [0, 1] by which a source with this tilt has been asked for the share `demand` of its tokens: the inverse of
    t + tilt * (t - t * t). A demand over 1 comes after the end of training: null."""
    root = F.sqrt(F.greatest((1 + tilt) * (1 + tilt) - 4 * tilt * demand, F.lit(0.0)))
    return F.when(demand <= 1, F.when(F.abs(tilt) < 1e-9, demand).otherwise(F.least(2 * demand / (1 + tilt + root), F.lit(1.0))))


class Curriculum:
    """Documents of several sources in a training order in which each source has its share.

    documents: columns named by id, source and n_tokens. targets: source, target_share, max_repeats. The weight of
    source s at time t in [0, 1] is w(t) = share * (1 + tilt * (1 - 2 t)); its integral over all training is the share.
    Within a source, documents stand in order of a hash, and the source is gone through again and again, up to max_repeats times. The
    tokens up to the middle of a document, c, are the source's cumulative demand there; solving total * share * (t + tilt * (t - t^2)) = c
    for t gives the document its position in each round. It is used as often as it has a position within the training, and a range sort
    by position gives the order.

    total: tokens to draw. By default the largest total at which no source has to be used more than max_repeats times, so that all shares
    are met, to within a document; the scarcest source sets it. With a larger total, a source gives what it may, and shares() tells what is unmet.

    Defined cases: sources without targets, null sources and documents without tokens aren't used; a target without
    documents, share or repeats gets share 0, and the others keep their proportions; repeated ids are separate
    documents; if targets repeat a source, its shares add up and the least max_repeats holds. An empty table gives
    no usage and actual shares of 0.
    """

    def __init__(
        self, documents: DataFrame, targets: DataFrame, id: str, source: str = "source", size: str = "n_tokens", piece: int = PIECE, total: int | None = None,
        tilt: float = TILT,
    ):
        if not 0 <= tilt < 1:
            raise ValueError("tilt must be at least 0 and under 1")
        self.id = id
        targets = targets.where("source is not null").groupBy("source").agg(
            F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
        sized = documents.where((F.col(size) > 0) & F.col(source).isNotNull()).select(F.col(id).alias("id"), F.col(source).alias("source"), F.col(size).cast("long").alias("n"))
        sized = materialize(sized)
        self.plan = materialize(_plan(sized, targets, total, tilt))
        # targets have a row a source, a table of settings; its size is checked before it is broadcast
        self._wide = self.plan.limit(10_001).count() <= 10_000
        largest = self.plan.agg(F.max("documents")).first()[0] or 0
        pieces = max(1, -(-largest // piece))
        place = F.xxhash64("id")
        rows = sized.withColumn("place", place).withColumn("piece", F.shiftright(F.pmod(place, F.lit(1 << 30)) * F.lit(pieces), 30).cast("int"))
        order = Window.partitionBy("source", "piece").orderBy("place", "id", "n").rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy("source", "piece").agg(F.sum("n").alias("s"))
        lower = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        offset = sums.select("source", "piece", F.coalesce(F.sum("s").over(lower), F.lit(0)).alias("offset"))
        rows = rows.withColumn("own", F.coalesce(F.sum("n").over(order), F.lit(0))).join(offset, ["source", "piece"])
        plan = self.plan.where("usable").select("source", "available", "demand", "tilt", "max_repeats")
        rows = rows.join(F.broadcast(plan) if self._wide else plan, "source").withColumn("middle", F.col("own") + F.col("offset") + F.col("n") / 2)
        # the rounds that may still hold the document: at most max_repeats, and none that begins after the demand is met
        rounds = F.least(F.col("max_repeats").cast("long"), F.floor(F.col("demand") / F.col("available")) + 1)
        at = F.transform(F.sequence(F.lit(0).cast("long"), rounds - 1), lambda r: _position(F.try_divide(r * F.col("available") + F.col("middle"), F.col("demand")), F.col("tilt")))
        self.rows = rows.withColumn("positions", F.filter(at, lambda t: t.isNotNull()))

    def usage(self) -> DataFrame:
        """(id, source, n_tokens, uses) of every document of a source that is used; uses may be 0."""
        return self.rows.select(F.col("id").alias(self.id), "source", F.col("n").alias("n_tokens"), F.size("positions").cast("long").alias("uses"))

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, used_tokens, available_tokens, most_uses, unmet_share) of every source of the targets.
        unmet_share is what the source gives too little for its target, as a share of all tokens drawn."""
        uses = F.size("positions").cast("long")
        used = self.rows.groupBy("source").agg(F.sum(F.col("n") * uses).alias("used_tokens"), F.max(uses).alias("most_uses"))
        all_ = self.plan.select("source", "target_share", F.col("available").alias("available_tokens")).join(used, "source", "left").fillna(0, ["used_tokens", "most_uses"])
        whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
        share = F.when(whole > 0, F.col("used_tokens") / whole).otherwise(0.0)
        return all_.select(
            "source", "target_share", share.alias("actual_share"), "used_tokens", "available_tokens", "most_uses",
            F.greatest(F.col("target_share") - share, F.lit(0.0)).alias("unmet_share"))

    def order(self) -> DataFrame:
        """(id, source, round, n_tokens, position) in training order: a range sort by position, round from 0."""
        each = self.rows.select(F.col("id").alias(self.id), "source", F.col("n").alias("n_tokens"), F.posexplode("positions").alias("round", "position"))
        return each.select(self.id, "source", "round", "n_tokens", "position").orderBy("position", "source", self.id, "round")
