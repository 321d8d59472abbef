"""Best corpus units of one comparison without writing pairs: blocks of the corpus are scored in memory against all queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

K1, B = 1.5, 0.75
#: Units of a block, and terms at most whose weights are laid out for all units of it: the frequent ones, which this many units of a hundred have.
UNITS, DENSE, OFTEN = 131_072, 32, 15.0
#: Parts of one that rounded sums count in: cosines without the query's norm, and BM25 sums.
TF, RAW = 64, 16
#: Share of a sum within which two count as equal when units are looked for.
SLACK = 1e-9
#: Units of a block lie in so many rows, and the largest sums of each column tell where to look for the best.
LANES = 16
#: What terms add that a query has up to so many times is kept for the queries after it.
KEPT = 4


@dataclass
class Terms:
    """Terms of a comparison by the order of their hashes, and their inverse document frequencies; BM25's is 0 for terms of queries alone."""

    hashes: np.ndarray
    idf: np.ndarray
    bm25: np.ndarray
    mean_length: float


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of size[i] numbers, for all i one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def counted(lists: pa.Array, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, f) of rows of hashes, by row and term."""
    size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    flat = np.asarray(pa.compute.list_flatten(lists), np.int64)
    some, back = np.unique(flat, return_inverse=True)
    term = np.searchsorted(terms.hashes, some)[back]
    key, f = np.unique(np.repeat(np.arange(len(lists)), size) * len(terms.hashes) + term, return_counts=True)
    return *np.divmod(key, max(1, len(terms.hashes))), f


class Units:
    """Rows with their terms: at[i] to at[i + 1] are those of row i, with counts and the weights of the cosine."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, term: np.ndarray, f: np.ndarray, terms: Terms):
        self.ids, self.term, self.f = ids, term, f.astype(np.float64)
        self.at = np.r_[0, np.cumsum(size)]
        self.row = np.repeat(np.arange(len(ids), dtype=np.int32), size)
        w = (1 + np.log(self.f)) * terms.idf[term]
        self.norm = np.sqrt(np.bincount(self.row, w * w, len(ids)))
        self.w = w / self.norm[self.row]

    def gains(self, terms: Terms) -> np.ndarray:
        """What each term adds to BM25 each time a query has it."""
        length = np.bincount(self.row, self.f, len(self.ids))[self.row]
        return terms.bm25[self.term] * self.f * (K1 + 1) / (self.f + K1 * (1 - B + B * length / terms.mean_length))


class Block:
    """Units of the corpus that queries are scored against."""

    def __init__(self, units: Units, terms: Terms):
        self.units, self.gain = units, units.gains(terms)
        n = len(units.ids)
        by = np.argsort(units.term, kind="stable")
        self.held, start, df = np.unique(units.term[by], return_index=True, return_counts=True)
        self.span = np.r_[start, len(by)]
        self.unit = units.row[by].astype(np.intp)
        # what a term adds to a unit's cosine (but for the query's norm), and to its BM25 sum for each time a query has it
        w, g = (units.w * terms.idf[units.term])[by], self.gain[by]
        self.most = np.stack([np.maximum.reduceat(x, start) if len(by) else np.zeros(0) for x in (w, g)])
        # both in one number, rounded; no sum is rounded where gains are negative
        self.whole = bool(len(by)) and g.min() >= 0 and w.max() * TF < 65_535 and g.max() * RAW < 65_535
        self.adds = (np.rint(w * TF).astype(np.uint32) << 16 | np.rint(g * RAW).astype(np.uint32)) if self.whole else np.zeros(len(by), np.uint32)
        often = np.argsort(-df, kind="stable")[:DENSE]
        often = often[df[often] * 100 >= OFTEN * n]
        self.dense = np.full(len(self.held), -1)
        self.dense[often] = np.arange(len(often))
        self.width = max(1, -(-n // LANES))
        self.rows = np.zeros((len(often), LANES * self.width), np.uint32)
        for i, k in enumerate(often.tolist()):
            at = slice(self.span[k], self.span[k + 1])
            self.rows[i, self.unit[at]] = self.adds[at]
        self.sums, self.raw = np.zeros((2, LANES * self.width), np.uint32)
        self.kept: dict[tuple[int, int], np.ndarray] = {}
        del units.f, units.row  # not asked for any more

    def exact(self, rows: np.ndarray, qw: np.ndarray, qf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and BM25 sums of units, each of which has terms, with a query's weights by term."""
        u = self.units
        size = u.at[rows + 1] - u.at[rows]
        at, first = ranges(u.at[rows], size), np.cumsum(size) - size
        own = u.term[at]
        return np.add.reduceat(qw[own] * u.w[at], first), np.add.reduceat(qf[own] * self.gain[at], first)

    def times(self, k: int, n: int) -> np.ndarray:
        """What a term, by its place, adds where a query has it n times."""
        add = self.adds[self.span[k] : self.span[k + 1]]
        if n == 1:
            return add
        out = self.kept.get((k, n))
        if out is None:
            out = np.rint((add >> 16) * (1 + np.log(n))).astype(np.uint32) << 16 | (add & 65_535) * np.uint32(n)
            if n <= KEPT:
                self.kept[k, n] = out
        return out

    def having(self, places: list[int]) -> np.ndarray:
        """Units that have one of the terms."""
        return np.unique(np.concatenate([self.unit[self.span[k] : self.span[k + 1]] for k in places]))


def search(block: Block, q: Units, terms: int, weights: tuple[float, float]) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, unit, cosine, BM25 sum) of pairs: for each query those of which one has the best combined score, whatever larger BM25 sum the query has
    in another block, that one of the largest BM25 sum here, and all that tie with them except units of equal sums and higher number.

    Rounded sums of all units tell which may be among these, as they are within a known distance of the true ones; those are summed again.
    """
    a, b = weights
    qw, qf = np.zeros((2, terms))
    place = np.searchsorted(block.held, q.term)
    place[place == len(block.held)] = 0
    known = block.held[place] == q.term if len(block.held) else np.zeros(len(place), bool)
    place, row, f = place[known], q.row[known], q.f[known]
    log = 1 + np.log(f)
    at = np.searchsorted(row, np.arange(len(q.ids) + 1))
    for i in np.flatnonzero(np.diff(at)).tolist():
        part, own = slice(at[i], at[i + 1]), slice(q.at[i], q.at[i + 1])
        mine = place[part]
        qw[q.term[own]], qf[q.term[own]] = q.w[own], q.f[own]
        rows = _hopeful(block, mine, f[part], log[part], float(q.norm[i]), qw, qf, a, b) if block.whole else None
        if rows is None:
            rows = block.having(mine.tolist())
        tf, raw = block.exact(rows, qw, qf)
        qw[q.term[own]] = qf[q.term[own]] = 0
        keep = _ahead(tf, raw, block.units.ids[rows], a, b)
        yield q.ids[i], block.units.ids[rows[keep]], tf[keep], raw[keep]


def _hopeful(block: Block, places: np.ndarray, f: np.ndarray, log: np.ndarray, norm: float, qw: np.ndarray, qf: np.ndarray, a: float, b: float) -> np.ndarray | None:
    """Units, among them all those of which search tells; None where rounded sums can't say it. places: the query's terms in the block."""
    tf_off, raw_off = float(log.sum() + len(f)) / 2, float(f.sum()) / 2  # what rounding can make of the sums
    sums, raw = block.sums, block.raw
    packed = max(log @ block.most[0, places] * TF + tf_off, f @ block.most[1, places] * RAW + raw_off) < 65_535
    if packed:
        sums.fill(0)
        for k, d, n in zip(places.tolist(), block.dense[places].tolist(), f.astype(np.int64).tolist()):
            if n == 1 and d >= 0:
                np.add(sums, block.rows[d], out=sums)
            else:
                np.add.at(sums, block.unit[block.span[k] : block.span[k + 1]], block.times(k, n))
        np.bitwise_and(sums, 65_535, out=raw)
    else:  # the sums of a long query may be too large for that
        size = block.span[places + 1] - block.span[places]
        at = ranges(block.span[places], size)
        unit, add = block.unit[at], block.adds[at]
        sums, raw = (np.bincount(unit, np.repeat(x, size) * y, len(block.sums)) for x, y in ((log, add >> 16), (f, add & 65_535)))
    top_raw, top_sums = (np.maximum.reduce(x.reshape(LANES, block.width), axis=0) for x in (raw, sums))
    lane = np.arange(LANES) * block.width
    tops = [int(c + lane[x[c + lane].argmax()]) for x, c in ((raw, int(top_raw.argmax())), (sums, int(top_sums.argmax())))]
    high = float(raw[tops[0]])
    two = np.array(tops[: 1 + (tops[0] != tops[1])])
    if high == 0:
        return None
    x, y = block.exact(two[block.units.at[two + 1] > block.units.at[two]], qw, qf)
    reach = float(y.max())
    if reach <= 0:
        return None
    score = a * x + b * y / reach
    best = int(score.argmax())
    # a unit that is behind the best both with this BM25 sum as the largest and with an endless one is behind it with any between
    least, least_tf, least_raw = float(score[best]) * (1 - SLACK), float(x[best]) * (1 - SLACK), reach * (1 - SLACK)
    by_tf, by_raw = a / norm / TF, b / reach / RAW
    off = by_tf * tf_off + by_raw * raw_off
    tf_from = least_tf * norm * TF - tf_off
    raw_from = least_raw * RAW - raw_off
    low = max(0, int(min(tf_from, (least - off - by_raw * (high + raw_off)) / by_tf)))
    columns = np.flatnonzero((top_sums >= (low << 16 if packed else low)) | (top_raw >= max(0, int(raw_from))))
    rows = (lane[:, None] + columns).ravel()
    rows = rows[rows < len(block.units.ids)]
    t, r = (sums[rows] >> 16).astype(np.float64) if packed else sums[rows], raw[rows].astype(np.float64)
    rows = rows[(t * by_tf + r * by_raw >= least - off) | (t >= tf_from) | (r >= raw_from)]
    return rows[block.units.at[rows + 1] > block.units.at[rows]]


def _ahead(tf: np.ndarray, raw: np.ndarray, ids: np.ndarray, a: float, b: float) -> np.ndarray:
    """Places of the pairs that no other is ahead of in both sums, ties included; of equal pairs the one of the lowest number."""
    order = np.lexsort((ids, -raw, -tf))
    x, y = tf[order], raw[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    order, y = order[new], y[new]
    return order[y >= np.maximum.accumulate(y) - 1e-9 * max(1.0, float(np.abs(y).max()))]
