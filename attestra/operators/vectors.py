"""Exact vector search: a query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.plans.runtime import ship

#: Queries whose vectors are sent to every task at once, at most (bytes); a larger query set takes several passes over the rows.
PASS_BYTES = 64 << 20
#: Rows that one matrix product takes, and queries beside them.
ROWS, QUERIES = 4096, 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is null, of another length, or zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def _matrix(ids: np.ndarray, lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit vectors by length, without those that are zero or not finite."""
    size = np.asarray(pa.compute.list_value_length(lists))
    flat = np.asarray(pa.compute.list_flatten(lists), np.float64)
    start = np.cumsum(size) - size
    out = {}
    for width in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == width)
        m = flat[start[rows, None] + np.arange(width)]
        norm = np.sqrt((m * m).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        out[width] = (ids[rows][good], m[good] / norm[good, None])
    return out


def _passes(queries: DataFrame, id: str, vector: str) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The query set in parts of at most PASS_BYTES."""
    rows = queries.where(F.col(vector).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))
    size = rows.agg(F.coalesce(F.sum(8 * F.size("v") + 8), F.lit(0))).first()[0]
    parts = max(1, -(-size // PASS_BYTES))
    for k in range(parts):
        got = (rows.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k) if parts > 1 else rows).toArrow()
        if len(got):
            yield _matrix(got.column("i").to_numpy(), got.column("v").combine_chunks())


def _scored(queries: DataFrame, data: DataFrame, id: str, vector: str, k: int | None, threshold: float | None, skip_self: bool) -> DataFrame:
    """(query_id, id, score): of each partition of data the k best rows of every query, or all at or over threshold."""
    spark = data.sparkSession
    ship(spark)
    schema = "query_id long, id long, score double"
    rows = data.where(F.col(vector).isNotNull() & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"))

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
            least: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for at in range(0, len(b), ROWS):
                    part = b.slice(at, ROWS)
                    ds = _matrix(part.column(0).to_numpy(), part.column(1))
                    for width, (qi, q) in sent.value.items():
                        if width not in ds:
                            continue
                        di, d = ds[width]
                        order = np.argsort(di)
                        di, d = di[order], d[order]
                        for a in range(0, len(qi), QUERIES):
                            score = q[a : a + QUERIES] @ d.T
                            if skip_self:
                                score[qi[a : a + QUERIES, None] == di[None, :]] = -2
                            if (width, a) in least:  # the partition has k rows of each query already: what is behind them is not wanted
                                hit = score >= np.maximum(least[width, a], -1.5)[:, None]
                            else:
                                hit = score > -2
                                if k is not None and k < len(di):
                                    hit &= score >= -np.partition(-score, k - 1, axis=1)[:, k - 1 : k] - 1e-9
                            if threshold is not None:
                                hit &= score >= threshold
                            w, c = np.divmod(np.flatnonzero(hit), len(di))
                            found = (qi[a : a + QUERIES][w], di[c], score[w, c])
                            if k is None:
                                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "id", "score"])
                                continue
                            # what the partition has so far is cut to k a query, ties included
                            old = best.get((width, a))
                            best[width, a] = held = _cut(tuple(map(np.concatenate, zip(old, found))) if old else found, k)
                            least[width, a] = _least(held, qi[a : a + QUERIES], k)
            for found in best.values():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "id", "score"])

        return run

    out = None
    for part in _passes(queries, id, vector):
        found = rows.mapInArrow(search(spark.sparkContext.broadcast(part)), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _least(found: tuple[np.ndarray, ...], asked: np.ndarray, k: int) -> np.ndarray:
    """What a further row of each query must score to be among its k best; no bound where it has fewer."""
    qi, _, score = found  # by query, best first
    order = np.argsort(asked, kind="stable")
    first = np.searchsorted(qi, asked[order])
    enough = np.searchsorted(qi, asked[order], "right") - first >= k
    out = np.full(len(asked), -np.inf)
    out[order[enough]] = score[first[enough] + k - 1] - 1e-9
    return out


def _cut(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    qi, di, score = found
    order = np.lexsort((-score, qi))
    qi, di, score = qi[order], di[order], score[order]
    first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(qi)))
    least = np.repeat(score[np.minimum(first + k, first + size) - 1], size)
    keep = score >= least - 1e-9
    return qi[keep], di[keep], score[keep]


def top_k(
    queries: DataFrame, data: DataFrame, id: str, vector: str, k: int, threshold: float | None = None, skip_self: bool = True, among: DataFrame | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): for each query the k rows of highest cosine, of those at or over threshold if there is one, and of
    those whose id is in among (a table with a column of that name) if it is given.

    The query set is sent in passes of a checked size, and rows stream past it in matrix products; of a partition only its k best leave the task.
    Work is queries times rows, so the query set is one that the caller states and bounds. Ties go to the lower id. Null, zero and unequally
    long vectors match nothing.
    """
    if among is not None:
        data = data.join(among.select(id).distinct(), id, "left_semi")
    found = _scored(queries, data, id, vector, k, threshold, skip_self)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")))
    return ranked.where(F.col("rank") <= k)


def at_least(queries: DataFrame, data: DataFrame, id: str, vector: str, threshold: float, skip_self: bool = True) -> DataFrame:
    """(query_id, id, score): all rows whose cosine with a query is at or over threshold. As long as the matches are."""
    return _scored(queries, data, id, vector, None, threshold, skip_self)


def exists_above(queries: DataFrame, data: DataFrame, id: str, vector: str, threshold: float, skip_self: bool = True) -> DataFrame:
    """(query_id, found): whether any row's cosine is at or over threshold. Of a partition only each query's best row leaves the task."""
    best = _scored(queries, data, id, vector, 1, threshold, skip_self).select("query_id").distinct().withColumn("found", F.lit(True))
    every = queries.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("query_id")).distinct()
    return every.join(best, "query_id", "left").select("query_id", F.coalesce("found", F.lit(False)).alias("found"))
