"""Long exact spans shared between records (problem 1): winnowed windows behind a count-min prefilter."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from attestra.plans.runtime import materialize, ship

#: Odd multiplier of the rolling polynomial and multipliers of the sketch's rows.
BASE = np.uint64(0x9E3779B97F4A7C15)
ROWS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
#: The sketch has CELLS_PER_WINDOW cells a row for each window expected, at most 2 ** MOST_BITS (one bit a cell once
#: merged: 64 MB a row). Beyond that more windows pass the filter, but none is lost.
CELLS_PER_WINDOW, LEAST_BITS, MOST_BITS, BLOCKS = 8, 20, 29, 256
#: Partitions whose lists of cells one task merges to a sketch of fixed size.
FAN = 64
PIECE = 1 << 19
#: A window held by more texts than this is compared by exact sub-windows rather than pair by pair.
HOT_WINDOW = 64

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, base in (("p", BASE), ("q", inverse)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a)
    return _powers["p"][:n], _powers["q"][:n]


def _sliding(a: np.ndarray, w: int, best: np.ufunc, worst: int) -> np.ndarray:
    """best(a[i : i + w]) for every i, as if `worst` followed the end."""
    n = len(a)
    padded = np.full(-(-(n + w) // w) * w, worst, a.dtype)
    padded[:n] = a
    blocks = padded.reshape(-1, w)
    ahead = best.accumulate(blocks, axis=1).reshape(-1)
    behind = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(behind[:n], ahead[w - 1 : w - 1 + n])


def window_hashes(texts: list[str], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of the windows chosen in each text.

    Of all grams of `gram` characters that lie in a stretch of `length` characters, those with the least hash are
    chosen, so two texts with a stretch in common choose the same window in it. Only texts of at least `length`
    characters choose any.
    """
    span = length - gram + 1
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    parts = []  # text number, offset, characters: long texts in overlapping pieces, short ones whole
    for k, c in enumerate(codes):
        for at in range(0, max(1, len(c) - length + 1), PIECE):
            if len(c) - at >= length:
                parts.append((k, at, c[at : at + PIECE + length - 1]))
    out = []
    while parts:
        room, take = PIECE * 2, 0
        while take < len(parts) and (not take or room >= len(parts[take][2])):
            room -= len(parts[take][2])
            take += 1
        out.append(_choose(parts[:take], length, gram, span))
        del parts[:take]
    if not out:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    number, position, value = (np.concatenate(x) for x in zip(*out))
    if any(len(c) > PIECE for c in codes):  # windows found in two pieces
        keep = np.unique(np.stack([number, position]), axis=1, return_index=True)[1]
        number, position, value = number[keep], position[keep], value[keep]
    return number, position, value


def _choose(parts: list, length: int, gram: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    chars = np.concatenate([p[2] for p in parts])
    sizes = np.array([len(p[2]) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = len(chars)
    p, q = _power(n + 1)
    x = chars.astype(np.uint64)
    x += np.uint64(0x632BE5AB)
    x *= np.uint64(ROWS[2])
    x ^= x >> np.uint64(29)
    x *= p[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    h = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    m = n - gram + 1
    v = (total[gram:] - total[:-gram]) * q[:m]
    v ^= v >> np.uint64(31)
    v *= np.uint64(ROWS[0])
    v ^= v >> np.uint64(29)
    h[:m] = v
    least = _sliding(h, span, np.minimum, np.iinfo(np.uint64).max)
    valid = np.zeros(n + 1, np.int8)  # where a whole stretch of one text begins
    np.add.at(valid, starts, 1)
    np.add.at(valid, starts + sizes - length + 1, -1)
    least[np.cumsum(valid[:n]) == 0] = 0
    # a window is chosen if a valid stretch that holds it has its hash as the least: look span - 1 places back
    padded = np.concatenate([np.zeros(span - 1, np.uint64), least])
    chosen = np.flatnonzero((_sliding(padded, span, np.maximum, 0)[:n] == h) & (h > 0))
    part = np.searchsorted(starts, chosen, side="right") - 1
    number = np.array([p[0] for p in parts])[part]
    return number, chosen - starts[part] + np.array([p[1] for p in parts])[part], h[chosen]


def _cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((values * np.uint64(ROWS[row])) >> np.uint64(64 - bits)).astype(np.uint32)


def _sketch(length: int, gram: int, bits: int):
    """Per partition and block of cells, which cells were hit once (listed once) or more often (listed twice)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() // FAN
        values = [window_hashes(b.column(0).to_pylist(), length, gram)[2] for b in batches]
        values = np.concatenate(values) if values else np.empty(0, np.uint64)
        if not len(values):
            return
        for row in range(len(ROWS)):
            cells, hits = np.unique(_cells(values, row, bits), return_counts=True)
            cells = np.repeat(cells, np.minimum(hits, 2))
            size = (1 << bits) // BLOCKS
            edges = np.searchsorted(cells, np.arange(BLOCKS + 1, dtype=np.uint64) * size)
            local = [cells[a:b] - np.uint32(k * size) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:]))]
            packed = [zlib.compress(np.diff(x, prepend=np.uint32(0)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1) for x in local]
            held = [k for k, x in enumerate(local) if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row * BLOCKS + k for k in held], pa.int32()), pa.array([group] * len(held), pa.int32()), pa.array([packed[k] for k in held], pa.binary())],
                ["block", "part", "cells"])

    return run


def _pack(block: int, some: np.ndarray, many: np.ndarray) -> pa.Table:
    bits = zlib.compress(np.packbits(np.concatenate([some, many])).tobytes(), 1)
    return pa.table([pa.array([block], pa.int32()), pa.array([bits], pa.binary())], ["block", "cells"])


def _merge_lists(bits: int):
    """The lists of at most FAN partitions, as two bits a cell: hit, and hit more than once."""

    def run(found: pa.Table) -> pa.Table:
        hits = np.zeros((1 << bits) // BLOCKS, np.uint8)
        for packed in found.column("cells").to_pylist():
            delta = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()
            cells = np.cumsum(delta, dtype=np.uint32)
            again = cells[1:][cells[1:] == cells[:-1]]
            one = np.unique(cells)
            hits[one] = np.minimum(hits[one] + 1, 2)
            hits[again] = 2
        return _pack(found.column("block")[0].as_py(), hits > 0, hits > 1)

    return run


def _merge_bits(bits: int):
    """Of one block, the bits of all groups of partitions together; sketches of a fixed size, read one after another."""

    def run(found: pa.Table) -> pa.Table:
        size = (1 << bits) // BLOCKS
        some, many = np.zeros(size, bool), np.zeros(size, bool)
        for packed in found.column("cells").to_pylist():
            both = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[: 2 * size].astype(bool)
            many |= both[size:] | (some & both[:size])
            some |= both[:size]
        return pa.table(
            [pa.array([found.column("block")[0].as_py()], pa.int32()), pa.array([zlib.compress(np.packbits(many).tobytes(), 1)], pa.binary())], ["block", "cells"])

    return run


def _candidates(length: int, gram: int, bits: int, sketch):
    """Second pass: windows whose cells were all hit more than once, with the characters around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rows, around = sketch.value, length - gram
        for b in batches:
            recs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            number, position, value = window_hashes(texts, length, gram)
            keep = np.ones(len(value), bool)
            for row in range(len(ROWS)):
                cell = _cells(value, row, bits)
                keep &= (rows[row][cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)
            number, position, value = number[keep], position[keep], value[keep]
            digest = {k: xxhash.xxh3_128_digest(texts[k].encode("utf-8", "surrogatepass")) for k in set(number.tolist())}
            at = list(zip(number.tolist(), position.tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([recs[k] for k, _ in at], pa.string()),
                    pa.array([digest[k] for k, _ in at], pa.binary()),
                    pa.array(value.view(np.int64)),
                    pa.array(position.astype(np.int32)),
                    pa.array([texts[k][max(0, i - around) : i] for k, i in at], pa.string()),
                    pa.array([texts[k][i + gram : i + gram + around] for k, i in at], pa.string()),
                ],
                ["rec", "cls", "hash", "pos", "ahead", "after"],
            )

    return run


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid)
    return low


def _verify(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c1, c2, p1, p2, a1, a2, z1, z2 in zip(*(x.to_pylist() for x in b.columns)):
                left, right = _common(a1[::-1], a2[::-1]), _common(z1, z2)
                if left + right + gram >= length:
                    out.append((c1, c2, p1 - left, p2 - left, left + right + gram))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["cls_a", "cls_b", "at_a", "at_b", "n"])

    return run


class SharedSpans:
    """Stretches of at least `length` characters that stand verbatim in more than one record.

    records: columns rec (unique string) and text. Null or shorter texts share nothing; an empty table gives empty
    results; extra columns are ignored. Blanks and case count. Records with the same text form a class: it is
    compared once, and every record of the class is reported. A stretch that only repeats within one record is not
    shared. Two passes over the texts; only windows that the sketch takes for repeated are shuffled.

    members (cls, rec), matches (cls_a, cls_b, at_a, at_b, n: classes in either order and equal wording around one
    chosen window that few texts hold), hot_places (cls, a, z: stretches shared around the others), pairs(), shared(), spans(), coverage().
    """

    def __init__(self, records: DataFrame, length: int = 300, gram: int | None = None):
        spark = records.sparkSession
        ship(spark)
        self.length, gram = length, gram or length // 2
        self.records = records.select("rec", "text")
        texts = self.records.where(F.length("text") >= length)
        chars = texts.select(F.sum(F.length("text"))).first()[0] or 0
        expected = 2 * chars / (length - gram + 2) + 1
        bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(expected * CELLS_PER_WINDOW)))))
        merged = (
            texts.select("text").mapInArrow(_sketch(length, gram, bits), "block int, part int, cells binary")
            .groupBy("block", "part").applyInArrow(_merge_lists(bits), "block int, cells binary")
            .groupBy("block").applyInArrow(_merge_bits(bits), "block int, cells binary"))
        rows = [np.zeros(1 << bits >> 3, np.uint8) for _ in ROWS]
        size = (1 << bits) // BLOCKS >> 3
        for r in merged.toLocalIterator():  # at most 3 rows of 2 ** MOST_BITS bits in all, whatever the input
            k = r["block"] % BLOCKS
            rows[r["block"] // BLOCKS][k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(r["cells"]), np.uint8)
        sketch = spark.sparkContext.broadcast(rows)
        schema = "rec string, cls binary, hash bigint, pos int, ahead string, after string"
        found = materialize(texts.mapInArrow(_candidates(length, gram, bits, sketch), schema))
        self.members = found.select("cls", "rec").distinct()
        windows = found.groupBy("hash", "cls", "pos").agg(F.first("ahead").alias("ahead"), F.first("after").alias("after"))
        holders = windows.groupBy("hash").agg(F.count_distinct("cls").alias("texts"), F.count("*").alias("n")).where("texts > 1")
        windows = materialize(windows.join(holders, "hash"))
        few = windows.where(F.col("n") <= HOT_WINDOW)
        stretches = materialize(self._stretches(windows.where(F.col("n") > HOT_WINDOW), gram))
        self.hot_places = stretches.select("cls", F.col("at").alias("a"), (F.col("at") + length).alias("z"))
        self.hot_keys = stretches.select("key", "key2", "cls").distinct()
        self.matches = materialize(self._pairwise(few, "hash", gram))

    def _kept_keys(self) -> DataFrame:
        """(key, key2, cls): stretches that many texts hold. Of those that the same classes hold, which a long passage has by the hundred, one is kept."""
        held = self.hot_keys.groupBy("key", "key2").agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "cls")).alias("y"))
        one = held.groupBy("n", "x", "y").agg(F.min(F.struct("key", "key2")).alias("k")).select("k.key", "k.key2")
        return self.hot_keys.join(one, ["key", "key2"])

    def hot_pairs(self) -> DataFrame:
        """(cls_a, cls_b), each once: classes that share a stretch around a window held by many texts."""
        kept = self._kept_keys()
        a, b = (kept.select("key", "key2", F.col("cls").alias(f"cls_{s}")) for s in "ab")
        return a.join(b, ["key", "key2"]).where("cls_a < cls_b").select("cls_a", "cls_b").distinct()

    def shared(self) -> DataFrame:
        """(passage, rec), each once: records with the same passage share a stretch. Says what pairs() says, in proportion to the text: equal texts
        are one passage, of whose records the smallest stands for all in the others; a stretch that many texts hold is one passage;
        of what few texts hold, each two are one."""
        spokesmen = self.members.groupBy("cls").agg(F.min("rec").alias("rec"), F.count("*").alias("n"))
        equal = self.members.join(spokesmen.where("n > 1").select("cls"), "cls").select(F.hex("cls").alias("passage"), "rec")
        few = self.matches.select(F.explode(F.array("cls_a", "cls_b")).alias("cls"), F.concat_ws("-", F.lit("few"), F.hex("cls_a"), F.hex("cls_b")).alias("passage")).distinct()
        many = self._kept_keys().select("cls", F.concat_ws("-", F.lit("many"), F.hex("key"), F.hex("key2")).alias("passage"))
        return equal.unionByName(few.unionByName(many).join(spokesmen, "cls").select("passage", "rec"))

    def _pairwise(self, windows: DataFrame, key: str, gram: int) -> DataFrame:
        side = lambda s: windows.select(key, *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "pos", "ahead", "after")])
        both = side("a").join(side("b"), key).where("cls_a < cls_b")
        both = both.select("cls_a", "cls_b", "pos_a", "pos_b", "ahead_a", "ahead_b", "after_a", "after_b")
        return both.mapInArrow(_verify(self.length, gram), "cls_a binary, cls_b binary, at_a int, at_b int, n int")

    def _stretches(self, windows: DataFrame, gram: int) -> DataFrame:
        """Windows held by many texts: every stretch of `length` characters around them becomes a key of its own (128
        bits), so only classes that do share a stretch meet, which are rows of the result; wording that many texts
        have in common over less than `length` characters makes no pairs."""
        around = self.length - gram
        stretch = F.transform(F.sequence(F.lit(0), F.lit(around)), lambda o: F.when(
            (F.length("ahead") >= o) & (F.length("after") >= around - o),
            F.struct(o.alias("o"), F.xxhash64("hash", o, F.substr("ahead", F.length("ahead") - o + 1, o), F.substr("after", F.lit(1), around - o)).alias("key"),
                     F.xxhash64(F.lit(7), F.substr("after", F.lit(1), around - o), F.substr("ahead", F.length("ahead") - o + 1, o), "hash").alias("key2"))))
        each = windows.select("cls", "pos", F.explode(F.filter(stretch, lambda s: s.isNotNull())).alias("s"))
        each = each.select(F.col("s.key").alias("key"), F.col("s.key2").alias("key2"), "cls", (F.col("pos") - F.col("s.o")).alias("at"))
        keys = ["key", "key2"]
        shared = each.groupBy(*keys).agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select(*keys)
        return each.distinct().join(shared, keys)

    def pairs(self) -> DataFrame:
        """(rec_a, rec_b), rec_a < rec_b, each once: records with a stretch in common."""
        linked = self.matches.select("cls_a", "cls_b").unionByName(self.hot_pairs()).distinct()
        a, b = (self.members.select(F.col("cls").alias(f"cls_{s}"), F.col("rec").alias(f"r{s}")) for s in "ab")
        across = linked.join(a, "cls_a").join(b, "cls_b").select("ra", "rb")
        within = self.members.select("cls", F.col("rec").alias("ra")).join(self.members.select("cls", F.col("rec").alias("rb")), "cls").where("ra < rb").select("ra", "rb")
        return across.unionByName(within).select(F.least("ra", "rb").alias("rec_a"), F.greatest("ra", "rb").alias("rec_b"))

    def spans(self) -> DataFrame:
        """(rec, start, n_chars): the maximal stretches of each record that stand in other records too; start from 0."""
        sides = [self.matches.select(F.col(f"cls_{s}").alias("cls"), F.col(f"at_{s}").alias("a"), (F.col(f"at_{s}") + F.col("n")).alias("z")) for s in "ab"]
        # the longest stretch from each place is enough, so a class keeps at most one row a place
        places = sides[0].unionByName(sides[1]).unionByName(self.hot_places).groupBy("cls", "a").agg(F.max("z").alias("z"))
        by = Window.partitionBy("cls").orderBy("a")
        reach = F.max("z").over(by.rowsBetween(Window.unboundedPreceding, -1))
        cut = places.withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("a")).cast("int"))
        cut = cut.withColumn("run", F.sum("new").over(by)).groupBy("cls", "run").agg(F.min("a").alias("start"), F.max("z").alias("z"))
        partial = cut.select("cls", "start", (F.col("z") - F.col("start")).alias("n_chars"))
        copied = self.members.groupBy("cls").agg(F.count("*").alias("copies"))
        members = self.members.join(copied, "cls")
        part = members.where("copies = 1").join(partial, "cls").select("rec", "start", "n_chars")
        whole = members.where("copies > 1").select("rec").join(self.records, "rec")
        return part.unionByName(whole.select("rec", F.lit(0).alias("start"), F.length("text").alias("n_chars")))

    def coverage(self) -> DataFrame:
        """(rec, n_chars, shared_chars, shared_share) for every record; null texts have 0 characters."""
        shared = self.spans().groupBy("rec").agg(F.sum("n_chars").alias("s"))
        size = F.coalesce(F.length("text"), F.lit(0))
        got = F.coalesce("s", F.lit(0)).cast("long")
        return self.records.select("rec", size.alias("n_chars")).join(shared, "rec", "left").select(
            "rec", "n_chars", got.alias("shared_chars"), F.when(F.col("n_chars") > 0, got / F.col("n_chars")).otherwise(0.0).alias("shared_share"))
