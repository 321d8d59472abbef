"""Most similar vectors for every vector (problem 2): additive quantisation over routed blocks, exact reranking."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from attestra.plans.runtime import materialize, ship

#: Vectors on which codebooks are fitted, at most (16 MB of 64 dimensions); every vector is indexed.
SAMPLE = 1 << 16
#: Residual codebooks of CODEWORDS full-dimensional codewords each; BEAM encodings are kept from book to book.
BOOKS, CODEWORDS, BEAM = 6, 256, 4
#: Space is cut into blocks, the unit of work: LEAST_BLOCKS (of 400 vectors or more), more from LEAST_BLOCKS * BLOCK vectors on, at most MOST_BLOCKS.
#: A block of more than twice BLOCK vectors, and more than twice its share, is dealt into several, which are all looked into where it is.
LEAST_BLOCKS, MOST_BLOCKS, BLOCK = 12, 1 << 12, 32_768
#: Blocks that a vector is sent to, at most (dealt ones apart): what is shuffled is in proportion to the vectors at any size.
VISITS = 8
#: First codebook: landmarks a block, which route vectors; a query looks into what lies as near as the nearest PROBED share of the landmarks.
LANDMARKS, PROBED = 64, 0.08
#: Within a block, vectors a cell, and vectors that a query looks at for the sake of PROBED, at most.
PER_CELL, LOOKS = 64, 2_000
#: Queries that are scored together.
GROUP = 24
TIE = 1e-6


def parse_vectors(raw: DataFrame, id: str, text: str, dimensions: int) -> DataFrame:
    """(id, vec): unit vectors (float32 bytes) of the rows whose text is a complete JSON array of `dimensions` finite
    numbers, not all zero. Rows with null, broken, short, long, non-numeric or zero vectors take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = [], []
            for i, t in zip(*(x.to_pylist() for x in b.columns)):
                try:
                    v = json.loads(t) if t else None
                except ValueError:
                    continue
                if type(v) is not list or len(v) != dimensions or i is None or not all(type(x) in (float, int) for x in v):
                    continue
                try:
                    a = np.array(v, np.float64)
                except (OverflowError, ValueError):
                    continue
                top = np.abs(a).max()
                if not np.isfinite(top) or top == 0 or np.isnan(a).any():
                    continue
                a /= top
                ids.append(i)
                vecs.append((a / np.sqrt(a @ a)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], ["id", "vec"])

    return raw.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, vec binary")


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means codewords."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = _nearest(x, c, 1)[:, 0]
        order = np.argsort(a, kind="stable")
        held, at = np.unique(a[order], return_index=True)
        sums = np.add.reduceat(x[order], at, axis=0)
        c[held] = sums / np.diff(np.append(at, len(a)))[:, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest codewords of each row, nearest first."""
    half = (c * c).sum(1) / 2
    out = np.empty((len(x), n), np.int32)
    for a in range(0, len(x), 4096):
        s = half - x[a : a + 4096] @ c.T
        if n == 1:
            out[a : a + 4096, 0] = s.argmin(1)
        else:
            near = np.argpartition(s, n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(s), 1))
            out[a : a + 4096] = np.take_along_axis(near, np.take_along_axis(s, near, 1).argsort(1), 1)
    return out


@dataclass
class Quantiser:
    cells: np.ndarray  # first codebook: landmarks
    books: np.ndarray  # BOOKS x CODEWORDS x dimensions, residual
    block: np.ndarray  # of each landmark
    dealt: np.ndarray  # into how many each block is dealt
    probes: int  # landmarks whose nearness a query looks into

    @classmethod
    def fit(cls, sample: np.ndarray, total: int, seed: int = 7) -> Quantiser:
        rng = np.random.default_rng(seed)
        blocks = int(max(1, min(max(LEAST_BLOCKS, -(-total // BLOCK)), MOST_BLOCKS, len(sample) // 400)))
        k = int(max(1, min(LANDMARKS * blocks, 1 << 14, len(sample) // 4)))
        cells = _means(sample, k, 8, rng)
        at = _nearest(sample, cells, 1)[:, 0]
        centres = _means(sample[rng.permutation(len(sample))[: 256 * blocks]], blocks, 8, rng)
        block = _nearest(cells, centres, 1)[:, 0]
        weight = np.bincount(block[at], minlength=blocks) / max(1, len(sample)) * total
        dealt = np.maximum(1, np.ceil(weight / (2 * max(BLOCK, total / blocks)))).astype(np.int32)
        # codebooks of what is left of a vector within cells of about PER_CELL vectors, as blocks have them
        fine = _means(sample, max(1, min(1 << 10, len(sample) // PER_CELL)), 4, rng)
        rest = sample - fine[_nearest(sample, fine, 1)[:, 0]]
        rest = rest[rng.permutation(len(rest))[: CODEWORDS * 64]]
        books = []
        for _ in range(BOOKS):
            books.append(_means(rest, CODEWORDS, 6, rng))
            rest = rest - books[-1][_nearest(rest, books[-1], 1)[:, 0]]
        return cls(cells, np.stack(books), block, dealt, int(np.ceil(PROBED * k)) if blocks > 1 else k)

    @property
    def first(self) -> np.ndarray:
        """Number of the first of the parts that a block is dealt into."""
        return np.cumsum(self.dealt) - self.dealt

    def encode(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of x beside a codeword near it, and half the squared norm of what both stand for, by beam search over the residual codebooks."""
        n, d = x.shape
        codes = np.zeros((n, 1, 0), np.uint8)
        rest = (x - near)[:, None, :]
        for book in self.books:
            half = (book * book).sum(1) / 2
            beam = rest.shape[1]
            # |r - c|^2 / 2 without the term all share
            s = (rest * rest).sum(2)[:, :, None] / 2 + half - (rest.reshape(-1, d) @ book.T).reshape(n, beam, -1)
            s = s.reshape(n, -1)
            keep = min(BEAM, s.shape[1])
            best = np.argpartition(s, keep - 1, axis=1)[:, :keep]
            best = np.take_along_axis(best, np.take_along_axis(s, best, 1).argsort(1), 1)
            frm, code = best // CODEWORDS, best % CODEWORDS
            rest = np.take_along_axis(rest, frm[:, :, None], 1) - book[code]
            codes = np.concatenate([np.take_along_axis(codes, frm[:, :, None], 1), code[:, :, None].astype(np.uint8)], 2)
        stands_for = x - rest[:, 0]
        return codes[:, 0], (stands_for * stands_for).sum(1) / 2


def _route(model, dimensions: int):
    """Each vector as data (home) to its own block, and as a query to the nearest VISITS blocks that it looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        first = q.first
        for b in batches:
            for a in range(0, len(b), 4096):
                part = b.slice(a, 4096)
                if not len(part):
                    continue
                ids, raw = part.column(0), part.column(1)
                x = np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(-1, dimensions)
                near = _nearest(x, q.cells, q.probes)
                blocks = q.block[near]
                reach = np.einsum("ij,ij->i", x, q.cells[near[:, -1]]) - (q.cells[near[:, -1]] ** 2).sum(1) / 2
                if q.probes == len(q.cells):  # few vectors: all are looked at
                    reach[:] = -np.inf
                # the first place of each block in a vector's list; the blocks of the nearest landmarks are visited
                order = np.argsort(blocks, axis=1, kind="stable")
                by = np.take_along_axis(blocks, order, 1)
                new = np.concatenate([np.ones((len(x), 1), bool), by[:, 1:] != by[:, :-1]], 1)
                place = np.where(new, order, len(q.cells))
                rank = place.argsort(1, kind="stable")[:, :VISITS]
                held = np.take_along_axis(place, rank, 1) < len(q.cells)
                rows, _ = np.nonzero(held)
                visited = np.take_along_axis(by, rank, 1)[held]
                home = visited == blocks[rows, 0]
                # a block that is dealt is looked into in all its parts; as data, a vector is in one
                times = q.dealt[visited]
                again = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                rows, visited, home = np.repeat(rows, times), np.repeat(visited, times), np.repeat(home, times)
                key = ids.to_numpy()[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                home &= again == key.astype(np.int64) % q.dealt[visited]
                index = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((first[visited] + again).astype(np.int32)), pa.array(~home), ids.take(index), raw.take(index), part.column(2).take(index), pa.array(reach[rows].astype(np.float32))],
                    ["block", "away", "id", "vec", "copies", "reach"])

    return run


class _Block:
    """The index of a block: its vectors in cells of its own, as codes."""

    def __init__(self, q: Quantiser, x: np.ndarray, ids: np.ndarray, copies: np.ndarray):
        rng = np.random.default_rng(len(ids))
        k = max(1, len(x) // PER_CELL)
        self.cells = _means(x[rng.permutation(len(x))[: 32 * k]], k, 4, rng)
        cell = _nearest(x, self.cells, 1)[:, 0]
        order = np.argsort(cell, kind="stable")
        self.x, self.ids, self.copies, cell = x[order], ids[order], copies[order], cell[order]
        parts = [q.encode(self.x[a : a + 2048], self.cells[cell[a : a + 2048]]) for a in range(0, len(x), 2048)]
        self.codes, self.half = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        self.books = q.books.reshape(-1, x.shape[1])
        self.single = len(q.dealt) == 1
        size = np.bincount(cell, minlength=k)
        self.edge = np.r_[0, np.cumsum(size)]
        self.norm = (self.cells * self.cells).sum(1) / 2

    def search(self, x: np.ndarray, ids: np.ndarray, reach: np.ndarray, k: int) -> Iterator[tuple]:
        size = np.diff(self.edge)
        near = x @ self.cells.T - self.norm
        asked = np.argsort(near.argmax(1), kind="stable")  # queries of a cell look into much the same cells
        for a in range(0, len(asked), GROUP):
            own = asked[a : a + GROUP]
            some, score = x[own], near[own]
            # cells as near as the query reaches, up to LOOKS vectors, and always the nearest ones that hold k
            order = (-score).argsort(1)
            before = np.cumsum(size[order], 1) - size[order]
            take = (np.take_along_axis(score, order, 1) >= reach[own][:, None]) & (before < LOOKS) | (before <= k)
            wanted = np.unique(order[take])
            yield from self._ranked(some, ids[own], wanted[size[wanted] > 0], k)

    def _ranked(self, some: np.ndarray, qids: np.ndarray, wanted: np.ndarray, k: int) -> Iterator[tuple]:
        if not len(wanted):
            return
        pick = np.concatenate([np.arange(self.edge[w], self.edge[w + 1]) for w in wanted])
        tables = (self.books @ some.T).reshape(BOOKS, CODEWORDS, -1)
        score = (self.cells[wanted] @ some.T).repeat(self.edge[wanted + 1] - self.edge[wanted], axis=0)
        score -= self.half[pick][:, None]
        own = self.codes[pick]
        for m in range(BOOKS):
            score += tables[m].take(own[:, m], axis=0)
        # the best few by codes are ranked by their true cosines, at least 8 k; where there is one block, of 800 vectors at most, all
        rank = len(pick) if self.single or len(pick) <= 40 else min(len(pick), max(40, 8 * k))
        score = np.ascontiguousarray(score.T)
        best = np.argpartition(score, len(pick) - rank, axis=1)[:, len(pick) - rank :]
        c, w = pick[best].ravel(), np.repeat(np.arange(len(some)), rank)
        cos = np.einsum("ij,ij->i", self.x[c], some[w], dtype=np.float64)
        keep = self.ids[c] != qids[w]
        c, w, cos = c[keep], w[keep], cos[keep]
        by = np.lexsort((-cos, w))
        c, w, cos = c[by], w[by], cos[by]
        first = np.searchsorted(w, np.arange(len(some)))
        last = np.minimum(first + k - 1, np.searchsorted(w, np.arange(len(some)), side="right") - 1)
        fifth = np.where(last >= first, cos[np.clip(last, 0, max(0, len(cos) - 1))] if len(cos) else 0, 2)
        keep = cos >= fifth[w] - TIE
        yield qids[w[keep]], self.ids[c[keep]], cos[keep], self.copies[c[keep]]


def _search(model, dimensions: int, k: int):
    """Over rows sorted by block, its data first: the index is built once, and queries stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = model.value
        at, held, index = None, [], None

        def asked(x, ids, reach):
            for o in index.search(x, ids, reach, k):
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in o], ["q", "c", "cos", "copies"])

        def build():
            nonlocal index
            if index is None and held:
                index = _Block(q, *(np.concatenate(z) for z in list(zip(*held))[:3]))
                for x, ids, _, reach in held:  # data are queries of their own block, too
                    yield from asked(x, ids, reach)
                held.clear()

        for b in batches:
            block, away = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (away[1:] != away[:-1])])
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(b)]):
                if not z - a:
                    continue
                if block[a] != at:
                    yield from build()
                    at, index = block[a], None
                part = b.slice(a, z - a)
                x = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float32).reshape(-1, dimensions)
                ids, copies, reach = part.column(2).to_numpy(), part.column(4).to_numpy(), part.column(5).to_numpy()
                if not away[a]:
                    held.append((x, ids, copies, reach))
                    continue
                yield from build()
                if index is not None:
                    yield from asked(x, ids, reach)
        yield from build()

    return run


def similar_pairs(raw: DataFrame, id: str, text: str, dimensions: int = 64, k: int = 5) -> DataFrame:
    """(a, b, cosine), a < b, each once: at least one of the two is among the k of the highest cosine with the other,
    cosines within 1e-6 of the k-th highest included.

    Equal vectors are one point of the index, however many rows have them, and are spread out again at the end (ties are part of the
    result; see vector_classes for a form in proportion to the rows). Landmarks, a first codebook, cut space into blocks. A vector is data
    of one block and a query of at most VISITS, so what is shuffled grows as the vectors do. A block's task puts its data into cells of its own and
    encodes them; lookup tables score the codes in the cells a query reaches, and the best 40 are ranked by their true cosines. Recall
    is measured in the tests and the README; it is a matter of VISITS, PROBED and LOOKS.

    Defined cases: unusable vectors take no part; with one usable vector or none there are no rows; rows with a null id take no part; ids are unique; extra
    columns are ignored.
    """
    spark = raw.sparkSession
    ship(spark)
    vectors = materialize(parse_vectors(raw, id, text, dimensions))
    points = materialize(vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    linked = materialize(point_pairs(points, dimensions, k))
    members = vectors.join(points.where("copies > 1").select("vec", F.col("id").alias("point")), "vec").select("point", "id")
    hop = lambda df, c: df.join(members.withColumnRenamed("point", c).withColumnRenamed("id", "m"), c, "left").withColumn(c, F.coalesce("m", c)).drop("m")
    # within a group of equal vectors, both ends run over its members
    out = hop(hop(linked.where("p <> r"), "p"), "r").unionByName(
        linked.where("p = r").join(members.select(F.col("point").alias("p"), F.col("id").alias("x")), "p")
        .join(members.select(F.col("point").alias("p"), F.col("id").alias("y")), "p").where("x < y").select(F.col("x").alias("p"), F.col("y").alias("r"), "cosine"))
    return out.select(F.least("p", "r").alias("a"), F.greatest("p", "r").alias("b"), "cosine")


def vector_classes(raw: DataFrame, id: str, text: str, dimensions: int = 64) -> DataFrame:
    """(id, point): for every row with a usable vector the least id that has an equal one. Pairs of points and this
    membership say the same as similar_pairs, in proportion to the rows however many are equal."""
    ship(raw.sparkSession)
    vectors = materialize(parse_vectors(raw, id, text, dimensions))
    points = vectors.groupBy("vec").agg(F.min("id").alias("point"), F.count("*").alias("copies"))
    many = vectors.join(points.where("copies > 1"), "vec").select("id", "point")
    one = points.where("copies = 1").select(F.col("point").alias("id"), "point")
    return one.unionByName(many)


def point_pairs(points: DataFrame, dimensions: int, k: int) -> DataFrame:
    """(p, r, cosine), p < r: pairs of different vectors of which one is among the k nearest of the other; p = r stands for the pairs within
    a group of equal vectors. points: vec, id, copies, as materialized rows."""
    spark = points.sparkSession
    ship(spark)
    total = points.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, total))
    spread = points.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    sample = [bytes(r["vec"]) for r in spread.select("id", "vec").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "p long, r long, cosine double")
    fitted = Quantiser.fit(np.frombuffer(b"".join(sample), np.float32).reshape(-1, dimensions), total)
    parts = int(fitted.dealt.sum())
    model = spark.sparkContext.broadcast(fitted)
    routed = points.select("id", "vec", "copies").mapInArrow(_route(model, dimensions), "block int, away boolean, id long, vec binary, copies long, reach float")
    # a task a block: the block's number is the partition's
    laid = routed.repartitionById(parts, F.col("block")).sortWithinPartitions("block", "away")
    near = laid.mapInArrow(_search(model, dimensions, k), "q long, c long, cos double, copies long")
    own = points.where("copies > 1").select(F.col("id").alias("q"), F.col("id").alias("c"), F.lit(1.0).alias("cos"), (F.col("copies") - 1).alias("copies"))
    near = near.unionByName(own)
    by = Window.partitionBy("q").orderBy(F.desc("cos"), "c").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("above", F.coalesce(F.sum("copies").over(by), F.lit(0)))
    least = F.min(F.when(F.col("above") < k, F.col("cos"))).over(Window.partitionBy("q"))
    near = near.withColumn("least", least).where(F.col("cos") >= F.col("least") - TIE)
    return near.groupBy(F.least("q", "c").alias("p"), F.greatest("q", "c").alias("r")).agg(F.max("cos").alias("cosine"))
