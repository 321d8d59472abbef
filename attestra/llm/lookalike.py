"""Visually identical text with different characters (problem 7): a compiled character transducer."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from attestra.plans.runtime import materialize, ship

#: Letters that look the same, one set a line. The first stands for all; the second is the form used in
#: Latin words, if the set has a Latin letter.
LOOKALIKES = """
а a ɑ
е e
о o ο օ
р p ρ
с c ϲ
у y ү
х x χ
і i ι
ј j ϳ
ѕ s
һ h հ
ԁ d
ԛ q
ԝ w
ӏ l
к κ
v ν ѵ
g ɡ
n ո
u ս
А A Α
В B Β
Е E Ε
З Ʒ
К K Κ
М M Μ
Н H Η
О O Ο
Р P Ρ
С C Ϲ
Т T Τ
У Y Υ Ү
Х X Χ
І I Ι Ӏ
Ј J Ϳ
Ѕ S
Ԁ D
Ԛ Q
Ԝ W
N Ν
Z Ζ
Г Γ
П Π
Ф Φ
"""
#: Letters above whose shapes differ too much to count as the same look in running text.
NOT_ALIKE = set("ιЗƷ")
#: Cyrillic letters above that few languages use; in a word without a letter that is Cyrillic alone they are taken for the Latin ones.
SELDOM = "һԁԀӏ"
#: Characters that stand for several letters side by side: ligatures, Roman numerals, digraphs (first and last code point).
JOINED = ((0xFB00, 0xFB06), (0x2160, 0x217F), (0x0132, 0x0133), (0x01C7, 0x01CC))
#: Clusters of several code points that look like another letter: letter, mark, what it looks like.
CLUSTERS = """
ı \u0307 i
i \u0307 i
ȷ \u0307 j
j \u0307 j
o \u0337 ø
o \u0338 ø
O \u0337 Ø
O \u0338 Ø
d \u0335 đ
D \u0335 Đ
h \u0335 ħ
H \u0335 Ħ
t \u0335 ŧ
T \u0335 Ŧ
b \u0335 ƀ
l \u0335 ƚ
l \u0337 ł
l \u0338 ł
L \u0337 Ł
L \u0338 Ł
"""
#: A cluster of pictures that zero-width joiners make one picture; there, the joiner (JOINER while texts are compared) is no invisible character.
_PICTURES = regex.compile(r"\p{Extended_Pictographic}[\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]*(?:\u200d\p{Extended_Pictographic}[\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]*)+")
JOINER = "\ufdd0"
#: Hyphens that differ only in whether a line may break after them.
HYPHENS = {"\u2010": "-", "\u2011": "-"}


def look_sets() -> list[list[str]]:
    sets = [[c for c in line.split() if c not in NOT_ALIKE] for line in LOOKALIKES.split("\n")]
    return [s for s in sets if len(s) > 1]


@functools.cache
def compiled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point how many characters it becomes (0 to 4), which, and its combining class.

    Built from rules: width forms lose their width, blanks become a space, invisible characters go, letters with
    marks fall apart into letter and marks, look-alikes become the first of their set. Checked for conflicts: no letter in two
    sets, and every output is its own output, so one pass is enough.
    """
    top = sys.maxunicode + 1
    width = np.ones(top, np.uint8)
    into = np.zeros((4, top), np.uint32)
    into[0] = np.arange(top)
    marks = np.zeros(top, np.uint8)
    alike: dict[str, str] = {}
    for one, *others in look_sets():
        for c in others:
            if c in alike:
                raise ValueError(f"{c} is in two sets")
            alike[c] = one
    if set(alike) & set(alike.values()):
        raise ValueError("a letter that stands for a set is in another set")
    for code in range(0x80, top):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        marks[code] = unicodedata.combining(c)
        form = unicodedata.decomposition(c)
        if form.startswith(("<wide>", "<narrow>")) or any(a <= code <= z for a, z in JOINED):
            c = unicodedata.normalize("NFKC", c)
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or 0x180B <= code <= 0x180F or code == 0x34F:
            out = ""
        elif kind == "Zs":
            out = " "
        else:
            out = "".join(" " if unicodedata.category(x) == "Zs" else alike.get(x, HYPHENS.get(x, x)) for x in unicodedata.normalize("NFD", c))
        width[code] = len(out)
        for k, x in enumerate(out):
            into[k, code] = ord(x)
    for c, one in alike.items():
        into[0, ord(c)] = ord(one)
    used = np.unique(into[0][width > 0])
    # joined characters were taken apart by now, so their letters are outputs of their own
    if ((width[used] != 1) | (into[0][used] != used)).any():
        raise ValueError("an output would change again")
    return width, into, marks


@functools.cache
def clusters() -> dict[tuple[int, int], int]:
    """What pairs of outputs of the table become: CLUSTERS in terms of the letters that stand for their sets."""
    width, into, _ = compiled()
    one = lambda c: int(into[0][ord(c)])
    pairs = {(one(a), ord(m)): one(z) for a, m, z in (line.split() for line in CLUSTERS.strip().split("\n"))}
    if any(width[z] != 1 for z in pairs.values()) or any((z, m) in pairs and pairs[z, m] != z for (_, m), z in pairs.items()):
        raise ValueError("a cluster's output would change again")
    return pairs


def same_look(texts: list[str]) -> list[str]:
    """One form for each text: equal for texts that look the same, different for others.

    The text is read in grapheme clusters, the longest match first: joined pictures stay joined, a letter with a mark that CLUSTERS lists
    becomes the letter it looks like, and of every other cluster each code point goes through the table, with marks in one order.
    """
    width, into, marks = compiled()
    if any("\u200d" in t for t in texts):
        texts = [_PICTURES.sub(lambda m: m.group().replace("\u200d", JOINER), t) if "\u200d" in t else t for t in texts]
    codes = np.frombuffer("\x00".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    n = width[codes]
    end = np.cumsum(n, dtype=np.int64)
    start = end - n
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint32)
    for k in range(int(n.max()) if len(n) else 0):
        held = np.flatnonzero(n > k) if k or (n == 0).any() else slice(None)
        out[start[held] + k] = into[k][codes[held]]
    cc = marks[out]
    wrong = np.flatnonzero((cc[1:] > 0) & (cc[:-1] > cc[1:]))
    first = np.cumsum(sizes + 1) - sizes - 1
    cuts = np.append(start, len(out))[np.minimum(first, len(start))]
    stops = np.append(start, len(out))[np.minimum(first + sizes, len(start))]
    known = clusters()
    over = np.flatnonzero(cc)
    over = over[np.isin(out[over], sorted({m for _, m in known}))]
    odd = np.unique(np.searchsorted(cuts, np.concatenate([wrong, over]), side="right") - 1).tolist()
    raw = out.tobytes()
    forms = [raw[4 * a : 4 * z].decode("utf-32-le", "surrogatepass") for a, z in zip(cuts.tolist(), stops.tolist())]
    for k in odd:  # rare, only these texts
        forms[k] = _with_clusters(unicodedata.normalize("NFD", forms[k]), known)
    return forms


def _with_clusters(form: str, known: dict[tuple[int, int], int]) -> str:
    """The form with each listed letter and mark, with other marks between or not, replaced by the letter it looks like."""

    def cluster(m) -> str:
        letter, rest = m.group()[0], m.group()[1:]
        for x in rest:
            z = known.get((ord(letter), ord(x)))
            if z is not None:
                letter, rest = chr(z), rest.replace(x, "", 1)
        return letter + rest

    return _MARKED.sub(cluster, form)


_MARKED = regex.compile(r"\p{L}\p{M}+")
_WORD = regex.compile(r"[\p{L}\p{M}]+")


@functools.cache
def _scripts() -> tuple[regex.Pattern, regex.Pattern, dict]:
    sets = [s for s in look_sets() if len(s) > 1 and "LATIN" in unicodedata.name(s[1]) and "CYRILLIC" in unicodedata.name(s[0])]
    shared = "".join(c for s in sets for c in s)
    return (
        regex.compile(rf"[\p{{Script=Cyrillic}}--[{shared}]]", regex.V1),
        regex.compile(rf"[[\p{{Script=Latin}}--[{shared}]]{SELDOM}]", regex.V1),
        {ord(s[0]): s[1] for s in sets},
    )


def readable(form: str) -> str:
    """The same form with each word in one script. A word's script is that of its letters that no other script has;
    a word with none takes the script of the word before it (at the start, of the first word that has one)."""
    cyrillic, latin, to_latin = _scripts()
    first = regex.search(f"(?:{cyrillic.pattern})|(?:{latin.pattern})", form, regex.V1)
    last = [bool(first) and bool(latin.match(first.group()))]

    def word(m):
        w = m.group()
        is_cyrillic, is_latin = cyrillic.search(w), latin.search(w)
        if is_latin and not is_cyrillic:
            last[0] = True
        elif is_cyrillic:
            last[0] = False
        return w.translate(to_latin) if last[0] else w

    return unicodedata.normalize("NFC", _WORD.sub(word, form)).replace(JOINER, "\u200d")


def one_form(records: DataFrame) -> DataFrame:
    """(rec, form): each text in one readable form; texts that look the same get the same form. Null stays null, an
    empty text stays empty, texts of invisible characters alone become empty; other columns are dropped."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), 512):
                recs, texts = (x.to_pylist() for x in b.slice(a, 512).columns)
                forms = [readable(f) for f in same_look([t or "" for t in texts])]
                yield pa.RecordBatch.from_arrays([pa.array(recs, pa.string()), pa.array([None if t is None else f for t, f in zip(texts, forms)], pa.string())], ["rec", "form"])

    return records.select("rec", "text").mapInArrow(run, "rec string, form string")


def looks(records: DataFrame) -> DataFrame:
    """(rec, look, bytes): 128-bit digests of the text's one form and of its own characters. Null texts have no row."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = lambda t: xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
        for b in batches:
            for a in range(0, len(b), 512):
                recs, texts = (x.to_pylist() for x in b.slice(a, 512).columns)
                columns = [recs, [digest(f) for f in same_look(texts)], [digest(t) for t in texts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.binary()))], ["rec", "look", "bytes"])

    return records.where("text is not null").select("rec", "text").mapInArrow(run, "rec string, look binary, bytes binary")


def same_looking_pairs(records: DataFrame) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b, each once: records whose texts look the same but are not equal.

    Only digests are shuffled. Texts are compared as classes of equal texts; a look with one class, however many
    records it has, makes no pairs. Null and empty texts, and texts without a visible character, look like nothing.
    """
    blank = F.length(F.regexp_replace("text", r"[\p{Z}\p{C}\s]", "")) == 0
    seen = materialize(looks(records.where(~blank)))  # each text goes through the transducer once
    classes = seen.groupBy("look").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi")).where("lo <> hi").select("look")
    held = seen.join(classes, "look")
    kinds = held.groupBy("look", "bytes").agg(F.lit(1).alias("_")).drop("_")
    a, b = (kinds.select("look", F.col("bytes").alias(f"bytes_{s}")) for s in "ab")
    links = a.join(b, "look").where("bytes_a < bytes_b").select("bytes_a", "bytes_b")
    ra, rb = (held.select(F.col("bytes").alias(f"bytes_{s}"), F.col("rec").alias(f"r{s}")) for s in "ab")
    both = links.join(ra, "bytes_a").join(rb, "bytes_b")
    return both.select(F.least("ra", "rb").alias("rec_a"), F.greatest("ra", "rb").alias("rec_b"))


def look_classes(records: DataFrame) -> DataFrame:
    """(rec, look_class, records, forms): for every record the smallest record that looks the same, how many do, and in how many different
    texts. In proportion to the records, however many look the same. Null texts have no row; texts without a visible character look alike."""
    seen = materialize(looks(records))
    groups = seen.groupBy("look", "bytes").agg(F.min("rec").alias("rec"), F.count("*").alias("n"))
    groups = groups.groupBy("look").agg(F.min("rec").alias("look_class"), F.sum("n").alias("records"), F.count("*").alias("forms"))
    return seen.join(groups, "look").select("rec", "look_class", "records", "forms")
