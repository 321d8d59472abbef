"""Repetition inside a single document (problem 10): tokeniser fertility with rejection bands, then exact runs of words."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestra.llm.tokens import encoding
from attestra.plans.runtime import ship

#: Vocabularies that measure fertility: one with byte fallback, whose tokens are also the ones of the entropies, and a byte-level one.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Words in a run that counts as repeated, and the share of repeated words from which a document is reported.
RUN, LEAST_SHARE = 5, 0.30
#: Acceptance bands by script: characters per token (low, high) under either vocabulary, largest share of byte-fallback tokens, least token
#: entropy in bits for documents of at least 100 tokens. Outside of them the text isn't ordinary prose.
BANDS = {"latin": (1.8, 7.0, 0.10, 4.5), "cyrillic": (1.2, 5.5, 0.10, 4.5), "other": (0.4, 7.0, 0.60, 3.5)}
REMEMBERED = 200_000

_ENDS = re.compile(r"^[\W_]+|[\W_]+$")


def most_deficit(share: float) -> float:
    """The band of the entropy of runs of tokens: bits it may lack of its maximum while fewer than `share` of the words are repeated.

    If a share s of the words lies in repeated runs, at least s / RUN of the runs that begin in the document are repeats, as one covers
    RUN words; so the runs have at most 1 - s / RUN times as many kinds as places, and lack -log2(1 - s / RUN) bits or more. Runs of
    equal words have equal tokens in every script, so the band holds for all scripts and loses no document.
    """
    return -math.log2(1 - share / RUN) if share < RUN else math.inf


@functools.cache
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Words:
    """Words seen so far: token numbers, tokens under the byte-level vocabulary, and a number for the form without case and outer marks
    (-1: marks alone)."""

    def __init__(self, path: str, byte_level: str):
        self.sp = _processor(path)
        self.encoding = encoding(byte_level)
        self.bytes = np.array([self.sp.IsByte(i) for i in range(self.sp.GetPieceSize())])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.forms: dict[str, int] = {}
        self.tokens: list[list[int]] = []
        self.other: list[int] = []
        self.form: list[int] = []
        self.lead: list[int] = []  # a number for the tokens of the form

    def number(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            bare = [_ENDS.sub("", w).lower() for w in new]
            other = map(len, self.encoding.encode_ordinary_batch([" " + w for w in new], num_threads=1))
            for w, b, ids, n, form in zip(new, bare, self.sp.encode(new, num_threads=1), other, self.sp.encode(bare, num_threads=1)):
                known[w] = len(self.tokens)
                self.tokens.append(ids)
                self.other.append(n)
                self.form.append(self.forms.setdefault(b, len(self.forms)) if b else -1)
                self.lead.append(hash(tuple(form)))
        return np.fromiter((known[w] for w in words), np.int64, len(words))


def _entropy(doc: np.ndarray, item: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document, the entropy of its items in bits, and their number."""
    n = np.bincount(doc, minlength=docs)
    order = np.lexsort((item, doc))
    doc, item = doc[order], item[order]
    start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(doc) else np.empty(0, np.int64)
    share = np.diff(np.append(start, len(doc))) / n[doc[start]]
    return np.bincount(doc[start], weights=-share * np.log2(share), minlength=docs), n


def run_deficit(lead: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Of each document, by how many bits the entropy of its runs of RUN words' tokens lies under its maximum; 0 for fewer words."""
    n = len(lead) - RUN + 1
    if n <= 0:
        return np.zeros(docs)
    whole = doc[:n] == doc[RUN - 1 :]
    key = np.zeros(n, np.uint64)
    for k in range(RUN):
        key = (key ^ lead[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    entropy, places = _entropy(doc[:n][whole], key[whole], docs)
    return np.where(places > 0, np.log2(np.maximum(1, places)) - entropy, 0.0)


def measure(texts: list[str | None], words: Words, suspects: float | None = None) -> dict[str, np.ndarray]:
    """Fertility of each text, and its repeated words; with suspects, these are counted only where run_deficit reaches it (else 0)."""
    docs = len(texts)
    if len(words.known) > REMEMBERED:
        words.clear()
    split = [(t or "").split() for t in texts]
    at = np.repeat(np.arange(docs), [len(s) for s in split])
    number = words.number([w for s in split for w in s])
    size = np.array([len(t) for t in words.tokens] or [0])
    flat = np.fromiter((i for t in words.tokens for i in t), np.int64) if words.tokens else np.empty(0, np.int64)
    first = np.cumsum(size) - size
    per = size[number] if len(number) else np.empty(0, np.int64)
    within = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    tokens = flat[np.repeat(first[number], per) + within] if len(number) else flat[:0]
    doc = np.repeat(at, per)
    entropy, n_tokens = _entropy(doc, tokens, docs)
    fallback = np.bincount(doc, weights=words.bytes[tokens] if len(tokens) else None, minlength=docs)
    others = np.bincount(at, weights=np.array(words.other)[number] if len(number) else None, minlength=docs)
    form = np.array(words.form or [0])[number] if len(number) else number
    real = form >= 0
    form, at_form, lead = form[real], at[real], (np.array(words.lead, np.int64)[number] if len(number) else number)[real]
    n_words = np.bincount(at_form, minlength=docs)
    deficit = run_deficit(lead, at_form, docs)
    if suspects is not None:
        held = (deficit >= suspects - 1e-9)[at_form]
        form, at_form = form[held], at_form[held]
    repeated = repeated_words(form, at_form, docs)
    chars = np.array([sum(map(len, s)) for s in split])
    with np.errstate(divide="ignore", invalid="ignore"):
        return {
            "n_words": n_words, "n_tokens": n_tokens, "repeated_words": repeated,
            "repeated_share": np.where(n_words > 0, repeated / np.maximum(1, n_words), 0.0),
            "chars_per_token": np.where(n_tokens > 0, chars / np.maximum(1, n_tokens), 0.0),
            "chars_per_byte_token": np.where(others > 0, chars / np.maximum(1, others), 0.0),
            "byte_share": np.where(n_tokens > 0, fallback / np.maximum(1, n_tokens), 0.0),
            "token_entropy": np.maximum(entropy, 0.0), "run_deficit": np.maximum(deficit, 0.0)}


def repeated_words(form: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Of each document, the words in a run of RUN words that already began earlier in it (runs may overlap)."""
    n = len(form) - RUN + 1
    if n <= 0:
        return np.zeros(docs, np.int64)
    whole = doc[: n] == doc[RUN - 1 :]
    runs = np.stack([form[k : k + n] for k in range(RUN)] + [doc[:n]], 1)[whole]
    place = np.flatnonzero(whole)
    order = np.lexsort((place, *runs.T))
    same = np.concatenate([[False], (runs[order][1:] == runs[order][:-1]).all(1)])
    mark = np.zeros(len(form) + 1, np.int64)
    later = place[order][same]
    np.add.at(mark, later, 1)
    np.add.at(mark, later + RUN, -1)
    return np.bincount(doc, weights=np.cumsum(mark[:-1]) > 0, minlength=docs).astype(np.int64)


def _script(text: str | None) -> str:
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    small = codes | 0x20
    latin = ((small >= 0x61) & (small <= 0x7A)).sum() + ((codes >= 0xC0) & (codes <= 0x24F)).sum()
    cyrillic = ((codes >= 0x400) & (codes <= 0x4FF)).sum()
    return "latin" if latin > cyrillic else "cyrillic" if cyrillic else "other"


FIELDS = {
    "n_words": "long", "n_tokens": "long", "repeated_words": "long", "repeated_share": "double", "chars_per_token": "double", "chars_per_byte_token": "double",
    "byte_share": "double", "token_entropy": "double", "run_deficit": "double"}


def rejected(script: str, words: int, tokens: int, chars: float, byte_chars: float, byte_share: float, entropy: float, deficit: float, most: float) -> str:
    """Names of the bands that a text lies outside of, by commas: characters, bytes, entropy, runs. A text without tokens is in all bands."""
    low, high, most_bytes, least_entropy = BANDS[script]
    out = []
    if tokens and not (low <= chars <= high and low <= byte_chars <= high):
        out.append("characters")
    if byte_share > most_bytes:
        out.append("bytes")
    if tokens >= 100 and entropy < least_entropy:
        out.append("entropy")
    if words >= RUN and deficit >= most - 1e-9:
        out.append("runs")
    return ",".join(out)


def repetition(documents: DataFrame, id: str, text: str, vocabulary: str = VOCABULARY, byte_level: str = BYTE_LEVEL, share: float = LEAST_SHARE, everywhere: bool = True) -> DataFrame:
    """One row per document: words, tokens, repeated words and their share, fertility measures, script, and the bands that its
    fertility lies outside of (rejected).

    run_deficit is by how many bits the entropy of the runs of five words' tokens lies under its maximum: 0 where no run comes
    again, and beyond its band (most_deficit) wherever `share` of the words are repeated. Unless everywhere, words are
    only counted in documents beyond that band; elsewhere repeated_words is 0. Null, empty and blank texts have 0 words, share 0 and
    are in all bands; extra columns are ignored; repeated ids give a row each.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col(id), F.col(text).alias("_text"))
    most = most_deficit(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary, byte_level)
        for b in batches:
            for a in range(0, len(b), 512):
                part = b.slice(a, 512)
                texts = part.column(1).to_pylist()
                m = measure(texts, words, None if everywhere else most)
                script = [_script(t) for t in texts]
                bands = [rejected(s, *x, most) for s, *x in zip(script, *(m[k] for k in ("n_words", "n_tokens", "chars_per_token", "chars_per_byte_token", "byte_share", "token_entropy", "run_deficit")))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(m[k], pa.int64() if t == "long" else pa.float64()) for k, t in FIELDS.items()), pa.array(script), pa.array(bands, pa.string())],
                    [id, *FIELDS, "script", "rejected"])

    schema = f"`{id}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{k} {t}" for k, t in FIELDS.items()) + ", script string, rejected string"
    return rows.mapInArrow(run, schema)


def repetitive(documents: DataFrame, id: str, text: str, share: float = LEAST_SHARE, vocabulary: str = VOCABULARY, byte_level: str = BYTE_LEVEL) -> DataFrame:
    """(id) of documents with at least `share` of their words in repeated runs: those that the band of the entropy of runs of tokens
    rejects, confirmed by counting their words exactly. The band loses none (most_deficit); other documents are never counted."""
    found = repetition(documents, id, text, vocabulary, byte_level, share, everywhere=False)
    return found.where(F.array_contains(F.split("rejected", ","), "runs") & (F.col("n_words") > 0) & (F.col("repeated_words") >= share * F.col("n_words"))).select(id)
