"""Token counts under a public tokenizer's vocabulary; its path is a parameter."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestra.plans.runtime import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how this kind of vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose counts a worker remembers, at most.
REMEMBERED = 200_000


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(path: str):
    """A function from text to its number of tokens. The cut never joins a single blank between two other characters
    to what is before it, so text is counted piece by piece, and a piece counted once is remembered."""
    enc, known = encoding(path), {}

    def count(text: str | None) -> int:
        if not text:
            return 0
        if "  " in text:  # runs of blanks are one cut: such texts are counted whole
            return len(enc.encode_ordinary(text))
        if len(known) > REMEMBERED:
            known.clear()
        first, *rest = text.split(" ")
        total = len(enc.encode_ordinary(first))
        for piece in rest:
            n = known.get(piece)
            if n is None:
                n = known[piece] = len(enc.encode_ordinary(" " + piece))
            total += n
        return total

    return count


def token_counts(texts: DataFrame, id: str, text: str, keep: list[str] | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, *keep, n_tokens): keep columns pass through; null and empty texts have 0 tokens."""
    ship(texts.sparkSession)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            n = [count(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(n, pa.int64())], [*b.schema.names[1:], "n_tokens"])

    rows = texts.select(F.col(text).alias("_text"), F.col(id), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, n_tokens long")
