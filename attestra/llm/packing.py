"""Filling fixed-capacity containers with items (problem 8): harmonic packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestra.plans.runtime import materialize, ship

#: Pieces that one worker packs by itself; every shard leaves a few containers part full.
SHARD = 100_000
#: Capacities that one call packs for, at most; each is a packing of all items.
MOST_CAPACITIES = 1000


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (from 0) of each item; no container holds more than `capacity`. Sizes are 1 to capacity.

    Harmonic classes: items of more than capacity / (k + 1) and at most capacity / k are class k, and k of them always
    fit. Classes are packed from the largest items down, each bin with its class's fixed count. What a bin has left
    names the least class whose every item fits there, and it takes one item of that class or, if none is left, of the
    next; this is repeated until nothing fits.
    """
    kind = capacity // sizes
    order = np.lexsort((-sizes, kind))
    classes, start = np.unique(kind[order], return_index=True)
    edge = np.append(start, len(order))
    free = {int(c): (int(edge[i]), int(edge[i + 1])) for i, c in enumerate(classes)}  # what is left of order, by class
    bins = np.full(len(sizes), -1, np.int64)
    used = 0
    names = [int(c) for c in classes]
    for at, k in enumerate(names):
        a, z = free[k]
        free[k] = (z, z)
        items = order[a:z]
        if not len(items):
            continue
        bins[items] = used + np.arange(len(items)) // k
        count = -(-len(items) // k)
        left = capacity - np.bincount(bins[items] - used, weights=sizes[items], minlength=count).astype(np.int64)
        number = used + np.arange(count)
        used += count
        while True:
            open_ = np.flatnonzero(left > 0)
            need = -(-capacity // np.maximum(1, left[open_]))
            by = np.argsort(need, kind="stable")
            open_, need = open_[by], need[by]
            waiting = np.empty(0, np.int64)
            filled, done = False, 0
            for c in names[at + 1 :]:
                a, z = free[c]
                upto = int(np.searchsorted(need, c, side="right"))
                waiting = np.concatenate([waiting, open_[done:upto]])
                done = upto
                n = min(len(waiting), z - a)
                if n:
                    took, waiting = waiting[:n], waiting[n:]
                    items = order[a : a + n]
                    bins[items] = number[took]
                    left[took] -= sizes[items]
                    free[c] = (a + n, z)
                    filled = True
            if not filled:
                break
    return bins


def harmonic_packing(items: DataFrame, id: str, size: str, capacities: DataFrame, shard: int = SHARD) -> DataFrame:
    """(capacity_id, container, id, piece, n_tokens, unused): every piece's container and what that container has left.

    Shards are independent: each worker packs the classes of its own, and nothing passes between workers.
    An item longer than the capacity is cut into full pieces and a rest, numbered from 0; all others stay whole. Items
    are dealt by hash to shards of about `shard` pieces, which are packed on their own. Containers are named by shard
    and number. Items without size (null, 0 or less) and capacities under 1 have no rows; repeated ids are separate
    items; an empty table gives no rows; extra columns are ignored.
    """
    ship(items.sparkSession)
    caps = capacities.where("max_tokens >= 1").select("capacity_id", F.col("max_tokens").cast("long").alias("c")).distinct()
    sized = materialize(items.where(F.col(size) > 0).select(F.col(id).alias("id"), F.col(size).cast("long").alias("n")))
    count = F.floor((F.col("n") - 1) / F.col("c"))
    # a row for every capacity of an item is the result; capacities are a table of settings, and its size is checked
    sizes = [(r["capacity_id"], r["c"]) for r in caps.limit(MOST_CAPACITIES + 1).collect()]
    if len(sizes) > MOST_CAPACITIES:
        raise ValueError(f"more than {MOST_CAPACITIES} capacities")
    named = caps.schema["capacity_id"].dataType
    each = F.array(*[F.struct(F.lit(i).cast(named).alias("capacity_id"), F.lit(c).cast("long").alias("c")) for i, c in sizes]) if sizes else F.array().cast(f"array<struct<capacity_id:{named.simpleString()},c:bigint>>")
    pieces = sized.select("id", "n", F.inline(each))
    whole = pieces.agg(F.sum(count + 1).alias("n"), F.count_distinct("capacity_id").alias("k")).first()
    shards = max(1, round((whole["n"] or 0) / max(1, whole["k"]) / shard))
    pieces = pieces.select(
        "capacity_id", "c", "id", F.posexplode(F.transform(F.sequence(F.lit(0), count.cast("int")), lambda i: F.least(F.col("c"), F.col("n") - i * F.col("c")))).alias("piece", "n"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece"), F.lit(shards)).cast("int"))

    def run(rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_numpy()
        ids, piece = rows.column("id").to_numpy(zero_copy_only=False), rows.column("piece").to_numpy()
        order = np.lexsort((piece, ids))  # the same result whatever order the rows come in
        n, capacity = n[order], rows.column("c")[0].as_py()
        bins = pack(n, capacity)
        unused = capacity - np.bincount(bins, weights=n).astype(np.int64)
        rows = rows.take(pa.array(order))
        name = pa.array([f"{rows.column('shard')[0].as_py()}-{b}" for b in bins.tolist()])
        return pa.table([rows.column("capacity_id"), name, rows.column("id"), rows.column("piece"), pa.array(n), pa.array(unused[bins])],
                        ["capacity_id", "container", id, "piece", "n_tokens", "unused"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = f"capacity_id {kinds['capacity_id']}, container string, `{id}` {kinds['id']}, piece int, n_tokens long, unused long"
    return pieces.groupBy("capacity_id", "shard").applyInArrow(run, schema)
