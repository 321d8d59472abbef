"""Recursive character splitting into overlapping chunks, and even thinning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from attestra.plans.runtime import ship

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before each separator, which stays at the front of its piece."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in [first, *(separator + x for x in rest)] if p]


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for piece in pieces:
        if held and total + len(piece) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(piece) > size):
                total -= len(held.pop(0))
        held.append(piece)
        total += len(piece)
    if held:
        out.append("".join(held).strip())
    return [x for x in out if x]


def split_text(text: str | None, size: int = 1000, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at the coarsest separator that serves; consecutive ones share up to
    `overlap` characters. Null and blank texts have none."""
    text = (text or "").strip()
    if not text:
        return []
    k = next(i for i, s in enumerate(separators) if not s or s in text)
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separators[k]):
        if len(piece) < size:
            short.append(piece)
            continue
        out += _merge(short, size, overlap)
        short = []
        out += split_text(piece, size, overlap, separators[k + 1 :]) if separators[k + 1 :] else [piece]
    return out + _merge(short, size, overlap)


def chunk_texts(df: DataFrame, id: str | list[str], text: str, size: int = 1000, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, chunk): the chunks of every text. id may be several columns."""
    ship(df.sparkSession)

    @F.pandas_udf("array<string>")
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: split_text(t, size, overlap))

    return df.select(*([id] if isinstance(id, str) else id), F.posexplode(chunks(F.col(text))).alias("chunk_index", "chunk"))


def thin_evenly(df: DataFrame, group: str, index: str, most: int) -> DataFrame:
    """At most `most` rows of each group, evenly spread over its index (0 to n - 1), first and last included. A group is a text's parts; one of very many
    rows is better counted apart and given to evenly_spread."""
    sized = df.withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    return sized.where(evenly_spread(F.col(index), F.col("_n"), most)).drop("_n")


def evenly_spread(index: Column, n: Column, most: int) -> Column:
    """Whether the index (0 to n - 1) is one of `most` that are evenly spread, first and last included; all are if most is 0 or less."""
    if most == 1:
        return index == 0
    if most <= 0:
        return F.lit(True)
    step = (n - 1) / F.lit(most - 1)
    # it is if some i of 0 .. most - 1 rounds (half to even) to the index: i is about index / step
    guess = F.floor(index / step)
    near = [F.bround(g * step) == index for g in (guess, guess + 1)]
    inside = [g <= most - 1 for g in (guess, guess + 1)]
    return (n <= most) | (near[0] & inside[0]) | (near[1] & inside[1])
