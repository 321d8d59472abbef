"""Garbled text from wrong character encoding (problem 5): byte automata, and a letter model for single-byte mix-ups."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestra.plans.runtime import ship

#: Encodings that UTF-8 bytes may have been read as. cp1252 also stands for latin-1: bytes it leaves undefined are C1 controls.
READ_AS = ("cp1251", "cp1252", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5", "cp437", "mac_roman")
#: Of these, the ones in which Latin letters with marks come out of garbled text.
WESTERN = ("cp1251", "cp1252", "cp437", "mac_roman")
#: Of these, the ones in which the later bytes of a character are Cyrillic letters, too: there words of other garbled text look like
#: signs, so only Latin, Cyrillic, punctuation and a few signs are taken for garbled.
LETTER_TAILS = ("cp866", "mac_cyrillic", "iso8859_5")
#: Single-byte encodings of Cyrillic that were confused: (read as, was).
CONFUSED = (
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "cp866"),
    ("cp866", "cp1251"), ("koi8_r", "cp866"), ("cp866", "koi8_r"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"),
    ("iso8859_5", "koi8_r"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("cp1252", "iso8859_5"))
#: What a decoder puts where bytes made no sense: the text was garbled there, and is lost.
LOST = "\ufffd"
ROUNDS = 6
#: Nats by which a stretch must read better after decoding, and letters it must have.
LEAST_GAIN, LEAST_LETTERS = 14.0, 4

#: Plain sentences that keep the letter model sound where there are few texts.
SEED = """
В настоящей работе рассматривается развитие системы образования и её влияние на общество. Студент должен изучить основные понятия, провести исследование, описать метод и сделать выводы.
Если результаты подтверждают гипотезу, то можно предположить, что выбранный подход является наиболее эффективным. Кроме того, учитывается стоимость, надёжность, точность и доступность оборудования.
Таким образом, государственное управление определяет хозяйственную деятельность предприятия, а научный журнал публикует объяснения, ссылки и таблицы. Цена товара выше, чем была в прошлом году; это вызывает ряд вопросов.
Наші дослідження показують, що якісне навчання забезпечує розвиток суспільства, її значення зростає, а об'єднання знань є важливим завданням для кожної країни. Ґрунт, їжа та життя.
The results of the study show that the general approach is useful when the quality of the sample depends on the method, and the authors describe which measures were applied in the research.
Die Untersuchung zeigt, dass die Förderung der Ausbildung für die Entwicklung größer wird, während die Prüfung der Abhängigkeit möglich ist und natürlich überall gültig bleibt.
"""


@functools.cache
def to_bytes(encoding: str) -> dict[int, int]:
    """Character to byte, from 0x80 up."""
    table = {b: b for b in range(0x80, 0xA0)} if encoding in ("cp1252", "cp1251") else {}
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            table.setdefault(b, b)
    if encoding == "cp1252":  # latin-1
        for b in range(0xA0, 0x100):
            table.setdefault(b, b)
    return table


@functools.cache
def automaton(encoding: str) -> re.Pattern:
    """Matches maximal spans that are well-formed multibyte UTF-8 once mapped back to bytes; ASCII may stand between."""
    byte = to_bytes(encoding)
    some = lambda low, high: "[" + "".join(re.escape(chr(c)) for c, b in byte.items() if low <= b <= high) + "]"
    tail = some(0x80, 0xBF)
    one = "|".join((
        some(0xC2, 0xDF) + tail, some(0xE0, 0xE0) + some(0xA0, 0xBF) + tail, some(0xE1, 0xEC) + tail * 2, some(0xED, 0xED) + some(0x80, 0x9F) + tail,
        some(0xEE, 0xEF) + tail * 2, some(0xF0, 0xF0) + some(0x90, 0xBF) + tail * 2, some(0xF1, 0xF3) + tail * 3, some(0xF4, 0xF4) + some(0x80, 0x8F) + tail * 2))
    return re.compile(f"(?:{one})(?:[\\x00-\\x7f]{{0,3}}(?:{one}))*")


@functools.cache
def _screen(encoding: str) -> re.Pattern:
    """One multibyte character of a block that garbled text comes from: Latin with marks, Greek, Cyrillic, punctuation, arrows and
    mathematical signs, symbols, a byte order mark, emoji; see LETTER_TAILS."""
    byte = to_bytes(encoding)
    some = lambda *of: "[" + "".join(re.escape(chr(c)) for c, b in byte.items() if any(low <= b <= high for low, high in of)) + "]"
    tail = some((0x80, 0xBF))
    usual = some((0xC2, 0xC5), (0xCC, 0xCC), (0xD0, 0xD2)) + tail + "|" + some((0xE2, 0xE2)) + some((0x80, 0x84)) + tail
    if encoding in LETTER_TAILS:
        return re.compile(usual)
    return re.compile(
        usual + "|" + some((0xCE, 0xCF)) + tail + "|" + some((0xE2, 0xE2)) + some((0x86, 0x8B), (0x98, 0x9F)) + tail + "|" + some((0xEF, 0xEF)) + some((0xBB, 0xBB)) + some((0xBF, 0xBF))
        + "|" + some((0xF0, 0xF0)) + some((0x9F, 0x9F)) + tail * 2)


def _sign(o: int, encoding: str) -> bool:
    """Signs whose bytes don't come about by chance, even alone."""
    return 0x2010 <= o <= 0x203A or o in (0x20AC, 0x2116, 0x2122) or 0x2190 <= o <= 0x2193 or encoding not in LETTER_TAILS and (
        o == 0xFEFF or 0x2190 <= o <= 0x22FF or 0x2600 <= o <= 0x27BF or 0x1F000 <= o <= 0x1FAFF)


def _plausible(c: str, encoding: str) -> bool:
    o = ord(c)
    if _sign(o, encoding) or encoding not in LETTER_TAILS and (0x386 <= o <= 0x3CE or o == 0xFE0F):
        return True
    return 0x80 <= o <= 0x17F or 0x400 <= o <= 0x45F or o in (0x490, 0x491, 0x300, 0x301, 0x306, 0x308)


def decode_spans(text: str, encoding: str) -> tuple[str, int]:
    """Decode the spans that were UTF-8; returns the text and how many characters became readable."""
    byte, found = to_bytes(encoding), 0

    def span(m: re.Match) -> str:
        nonlocal found
        raw = bytes(byte.get(ord(c), ord(c)) for c in m.group())
        good = raw.decode("utf-8")
        wide = [c for c in good if ord(c) > 0x7F]
        likely = [c for c in wide if _plausible(c, encoding) and (ord(c) >= 0x370 or encoding in WESTERN)]
        if len(likely) < 0.8 * len(wide):
            return m.group()
        beside = any(ord(a) > 0x7F and ord(b) > 0x7F for a, b in zip(good, good[1:]))
        marks = any(_sign(ord(c), encoding) for c in likely)
        near = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        western = all(ord(c) < 0x180 for c in wide) and (encoding == "cp1252" or all(ord(c) >= 0xC0 for c in wide) and any(c.isascii() and c.isalpha() for c in near))
        if not (beside or marks or western or (len(wide) >= 3 and found)):
            # a single character: only within a text that has surer spans, and standing alone
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if not sure or before.isalpha() or after.isalpha():
                return m.group()
        found += len(wide)
        return good

    sure = False
    out = automaton(encoding).sub(span, text)
    if found:
        sure, found = True, 0
        out = automaton(encoding).sub(span, text)
    return out, found


# ---- single-byte mix-ups -------------------------------------------------------------------------------------------

_LETTERS = "абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґabcdefghijklmnopqrstuvwxyzäöüß"
#: Classes: 0 boundary, 1 other signs above ASCII, letters; capitals after a small letter cost extra.
_OTHER, _SIZE = 1, 2 + len(_LETTERS)


@functools.cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point under 0x3000, and its case: 1 small, 2 capital."""
    kind, case = np.zeros(0x3000, np.int16), np.zeros(0x3000, np.int8)
    kind[0x80:] = _OTHER
    for ordinary in "«»—–…№“”„‘’°§¬\xa0\xad\u2009\u202f\u200b\u200c\u200d\u200e\u2060":
        kind[ord(ordinary)] = 0
    for k, c in enumerate(_LETTERS):
        for x, s in ((c, 1), (c.upper(), 2)):
            if len(x) == 1:
                kind[ord(x)], case[ord(x)] = k + 2, s
    return kind, case


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pair_counts(texts: list[str]) -> np.ndarray:
    """How often a class follows a class in texts, each with a boundary at its ends; so counts of parts add up."""
    k = _classes()[0][np.minimum(_codes("\n".join(["", *texts, ""])), 0x2FFF)] if texts else np.zeros(0, np.int16)
    return np.bincount(k[:-1].astype(np.int64) * _SIZE + k[1:], minlength=_SIZE * _SIZE)


def count_pairs(rows: DataFrame) -> np.ndarray:
    """pair_counts of the column text of all rows, added up by partition before they are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE * _SIZE, np.int64)
        for b in batches:
            for a in range(0, len(b), 512):
                total += pair_counts(b.column(0).slice(a, 512).to_pylist())
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["pair", "n"])

    counts = np.zeros(_SIZE * _SIZE, np.int64)
    for r in rows.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] = r["n"]
    return counts


class LetterModel:
    """Log probabilities of a letter after a letter, fitted on texts or on their pair counts."""

    def __init__(self, texts: list[str], pairs: np.ndarray | None = None):
        pairs = pair_counts(texts) if pairs is None else pairs
        counts = 0.05 + (3.0 * pair_counts([SEED]) + pairs).reshape(_SIZE, _SIZE)
        # each letter weighs as in its own script, so that texts in one language don't make another unlikely
        rows = counts.sum(1, keepdims=True)
        self.log = np.log(counts / rows)
        self.log[0] = np.minimum(0, np.log((counts[0] + 1) / counts[0][2:].max() / 4))
        self.log[0, 0] = 0.0
        self.log[:, _OTHER] = np.minimum(self.log[:, _OTHER], -6.0)
        self.log[_OTHER] = np.minimum(self.log[_OTHER], -4.0)
        np.clip(self.log, -9.0, 0.0, out=self.log)

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Of each character, how well it follows the one before it."""
        kinds, cases = _classes()
        at = np.minimum(codes, 0x2FFF)
        k, c = kinds[at].astype(np.int64), cases[at]
        before = np.concatenate([[0], k[:-1]])
        s = self.log[before, k]
        s[1:] -= 5.0 * ((c[1:] == 2) & (c[:-1] == 1))
        return s


@functools.cache
def _swap(read_as: str, was: str) -> np.ndarray:
    """Code point to code point: what the character would have been."""
    table = np.arange(0x3000, dtype=np.uint32)
    for c, b in to_bytes(read_as).items():
        try:
            good = bytes([b]).decode(was)
        except UnicodeDecodeError:
            continue
        if c < 0x3000 and ord(good) < 0x3000:
            table[c] = ord(good)
    return table


_RARE = re.compile(r"[¢-¦¨-ª¬-¯±-¶¸-º¼-ÿ\u0080-\u009fЂЃЅЈ-Џђѓѕј-џ─-◿]{2}|[¬®¤Ґ═-■]")


def _suspects(texts: list[str], model: LetterModel) -> np.ndarray:
    """Which texts have letters that follow one another badly in a few places close together."""
    joined = _codes("\n".join(texts))
    s = model.score(joined)
    sizes = np.array([len(t) + 1 for t in texts])
    total = np.concatenate([[0.0], np.cumsum(s + 3.2)])  # good prose scores better than -3.2 a character
    n = LEAST_LETTERS * 2
    if len(s) <= n:
        return np.ones(len(texts), bool)
    bad = (total[n:] - total[:-n]) < -6.0
    first = np.cumsum(sizes) - sizes
    held = np.concatenate([[0], np.cumsum(bad)])
    return held[np.minimum(first + sizes, len(bad))] - held[np.minimum(first, len(bad))] > 0


def decode_single(text: str, model: LetterModel) -> tuple[str, int]:
    """Decode the stretches that read much better under another single-byte encoding."""
    codes = _codes(text)
    if len(codes) < LEAST_LETTERS:
        return text, 0
    own = model.score(codes)
    best: tuple[float, list, np.ndarray] = (0.0, [], codes)
    for pair in CONFUSED:
        other = _swap(*pair)[np.minimum(codes, 0x2FFF)]
        changed = other != codes
        if not changed.any():
            continue
        gain = np.where(changed | np.concatenate([[False], changed[:-1]]), model.score(other) - own, 0.0)
        gain[~changed & (codes > 0x7F)] -= 8.0  # the encoding read had no such character
        run = np.cumsum(gain)
        if (run - np.minimum.accumulate(np.minimum(run, 0.0))).max() < LEAST_GAIN:
            continue
        letters = changed & (other >= 0x400) & (other < 0x500)
        spans = [(*_edges(codes, other, letters, a, z), g) for a, z, g in _stretches(gain, letters) if _prose(codes[a:z], letters[a:z])]
        total = sum(g for _, _, g in spans)
        if total > best[0]:
            best = (total, spans, other)
    if not best[1]:
        return text, 0
    out = codes.copy()
    n = 0
    for a, z, _ in best[1]:
        out[a:z] = best[2][a:z]
        n += z - a
    return out.tobytes().decode("utf-32-le", "surrogatepass"), n


def _stretches(gain: np.ndarray, letters: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal stretches of positive total gain that pass the thresholds; a stretch ends where its sum falls by the threshold."""
    out, start, total, top, end = [], -1, 0.0, 0.0, -1
    for i in np.flatnonzero(gain):
        g = float(gain[i])
        if start < 0:
            if g > 0:
                start, total, top, end = i, g, g, i + 1
            continue
        total += g
        if total > top:
            top, end = total, i + 1
        elif total < 0 or total < top - LEAST_GAIN:
            _keep(out, start, end, top, letters)
            start = -1
    if start >= 0:
        _keep(out, start, end, top, letters)
    return out


def _keep(out: list, start: int, end: int, top: float, letters: np.ndarray) -> None:
    n = int(letters[start:end].sum())
    if top >= LEAST_GAIN and n >= LEAST_LETTERS and top / n >= 1.0:
        out.append((int(start), int(end), top))


def _prose(codes: np.ndarray, letters: np.ndarray) -> bool:
    """Garbled prose has letters of many kinds, side by side, and little else above ASCII: not just a hyphen or blank again
    and again, nor a word spaced out."""
    high = codes > 0x7F
    return 3 * (letters[1:] & letters[:-1]).sum() >= letters.sum() and letters.sum() >= 0.8 * high.sum() and len(np.unique(codes[letters])) >= 4


def _edges(codes: np.ndarray, other: np.ndarray, letters: np.ndarray, a: int, z: int) -> tuple[int, int]:
    """Move the ends to where words end, unless a change of case shows that the garble begins or ends within a word."""
    small, n = _classes()[1], len(codes)
    case = lambda i: small[min(int(codes[i]), 0x2FFF)]
    k = a
    while k < z and k - a < 3 and letters[k]:
        k += 1
    if a and case(a - 1) and k - a < 3 and k < z and not (case(a - 1) == 1 and case(a) == 2):
        a = k
    while a and letters[a - 1] and not (case(a - 1) == 1 and case(a) == 2 and case(max(0, a - 2)) == 1):
        a -= 1
    word = a - 1  # the word before, if it could be garbled whole
    while word > 0 and codes[word] == 32:
        word -= 1
    first = word
    while first >= 0 and codes[first] > 32:
        first -= 1
    held = slice(first + 1, word + 1)
    if 0 < word - first <= 4 and letters[held].any() and (letters[held] | (codes[held] < 0x80)).all() and not small[np.minimum(codes[held], 0x2FFF)].all():
        a = first + 1
    while z < n and letters[z] and not (case(z - 1) == 2 and case(z) == 1):
        z += 1
    return a, z


_ORPHAN = re.compile("[�\x80-\x9f]|[ÐÑРС](?=[ЂЃЉ-Ћђѓ°-·\u0080-¿†-•Š])")


def restore(texts: list[str], model: LetterModel) -> list[tuple[str, int] | None]:
    """For each text None, or its restored text and the number of characters decoded."""
    suspects = _suspects(texts, model)
    out: list[tuple[str, int] | None] = []
    for text, bad in zip(texts, suspects.tolist()):
        now, n = text, 0
        for _ in range(ROUNDS):
            tried = [decode_spans(now, encoding) for encoding in READ_AS if _screen(encoding).search(now)]
            better, found = max(tried, key=lambda x: x[1], default=(now, 0))
            if not found:
                break
            now, n = better, n + found
        if n and bad:
            bad = bool(_suspects([now], model)[0])
        if bad or _RARE.search(now):
            for _ in range(ROUNDS):
                now, found = decode_single(now, model)
                n += found
                if not found:
                    break
        n += text.count(LOST)
        out.append((now, n) if n else None)
    return out


def garbled(records: DataFrame) -> DataFrame:
    """(rec, restored, n_garbled, complete) of the records with a stretch decoded wrongly.

    UTF-8 read as a legacy encoding, once or several times over: characters are mapped back to bytes, and spans that the UTF-8
    automaton accepts are decoded, if they give Latin, Greek or Cyrillic letters, punctuation, arrows, mathematical signs,
    symbols, emoji or a byte order mark. Other blocks are left (three bytes of an East Asian letter are also a word of cp866), and where the encoding has Cyrillic letters among the later bytes
    (LETTER_TAILS) all but Latin, Cyrillic, punctuation and a few signs, as plain words would look like them. A single-byte encoding read as another leaves no byte structure;
    there a letter model decides which stretches read better decoded (see README). Replacement characters (U+FFFD)
    are garbled too. complete is false where characters were lost on the way, so that the text is only restored in
    part.

    Correct foreign letters and signs, all-capital texts, null, empty and short texts give no row; extra columns are
    ignored. Every text is examined whole.
    """
    spark = records.sparkSession
    ship(spark)
    rows = records.where("text is not null and text <> ''").select("rec", "text")
    model = spark.sparkContext.broadcast(LetterModel([], count_pairs(rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), 512):
                recs, texts = (x.to_pylist() for x in b.slice(a, 512).columns)
                hits = [(r, *x, not _ORPHAN.search(x[0])) for r, x in zip(recs, restore(texts, model.value)) if x]
                columns = list(zip(*hits)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.bool_()))], ["rec", "restored", "n_garbled", "complete"])

    return rows.mapInArrow(run, "rec string, restored string, n_garbled int, complete boolean")
