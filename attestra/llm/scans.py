"""Noise in text from scanned pages (problem 6): joint word decoding over de-lined text, paragraphs by dynamic programming."""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attestra.plans.runtime import materialize, ship

#: What a scanner reads, and what it may have been.
CONFUSIONS = """
0 о o
н и п
г т
8 в b
п л
с е
л д
4 ч
3 з
6 б b
ъ ь
щ ш
ш щ
9 g
l i
f t
5 s
1 l i
b h
c e
n u
rn m
cl d
vv w
x| ж
l| ы
| l
"""
#: A word is known if it stands in at least LEAST_DOCS texts, however many texts there are, unless it is a misreading itself: one that
#: stands in CHANGE_COST nats a change fewer texts than its reading. Up to MOST_WORDS are sent out; beyond, the rest is joined.
LEAST_DOCS, MOST_WORDS = 3, 500_000
#: In how many texts a word must stand before one that is a letter off counts as its misreading.
LEAST_COMMON = 15
CHANGE_COST = 3.5
#: A token whose word costs more nats than this may be a part of one that a blank was put in.
RARE_COST = 14.0
#: Nats by which a corrected or joined word must cost less than what stood there to make a text a scan.
LEAST_GAIN = 4.0
HYPHENS = "-¬­‐"
_EDGES = " \t.,;:!?…()[]{}«»„“”\"'‘’–—-¬­/|*•·"
_DIGIT = re.compile(r"[0-9|]")
_LETTERS = re.compile(r"[^\W\d_]")
_HYPHENED = re.compile(rf"[{HYPHENS}][ \t]*\n")
_HALVES = re.compile(rf"[^{HYPHENS}\s]*[^\W\d_][{HYPHENS}][ \t]*\n\s*[^\W\d_]\S*")
_INSIDE = re.compile(r"[^\W\d_][0-9|]+[^\W\d_]")

TABLE: dict[str, list[str]] = {}
for _line in CONFUSIONS.strip().split("\n"):
    _seen, *_was = _line.split()
    TABLE[_seen] = _was


def _skeletons() -> dict[int, str]:
    """For each character what stands for it and all it may be confused with; a misreading has the skeleton of the word it was."""
    one: dict[str, str] = {}

    def root(c: str) -> str:
        while one.get(c, c) != c:
            c = one[c]
        return c

    for seen, was in TABLE.items():
        for w in was if len(seen) == 1 else ():
            one[root(w)] = root(seen)
    table = {ord(c): root(c) for c in one}
    for seen, was in TABLE.items():
        for w in was if len(seen) > 1 else ():
            table[ord(w)] = "".join(root(c) for c in seen)
    return table


_SKELETON = _skeletons()


def skeleton(word: str) -> str:
    return word.translate(_SKELETON)


def _changes(word: str, was: str, limit: int) -> int | None:
    """The least number of confusions that turn `was` into `word`, up to limit; None if there are more, or other differences."""
    reach = {(0, 0)}  # places in both words that can be come to with so many changes
    for n in range(limit + 1):
        open_, after = list(reach), set()
        while open_:
            i, j = open_.pop()
            while i < len(word) and j < len(was) and word[i] == was[j]:
                for size in (1, 2):
                    if i + size <= len(word):
                        after |= {(i + size, j + len(w)) for w in TABLE.get(word[i : i + size], ()) if was.startswith(w, j)}
                i, j = i + 1, j + 1
            if i == len(word) and j == len(was):
                return n
            for size in (1, 2):
                if i + size <= len(word):
                    after |= {(i + size, j + len(w)) for w in TABLE.get(word[i : i + size], ()) if was.startswith(w, j)}
        reach = after
    return None


def core(token: str) -> str:
    """The word in a token: lower case, without marks around it."""
    return token.strip(_EDGES).lower()


def document_words(records: DataFrame) -> DataFrame:
    """(word, n): in how many texts each word stands; counted over all of them, added up before the shuffle."""
    ship(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        for b in batches:
            for t in b.column(0).to_pylist():
                t = _HALVES.sub(" ", t) if _HYPHENED.search(t) else t  # parts of a word broken at a line's end are no words
                counts.update({core(w) for w in set(t.split())})
            if len(counts) > 500_000:
                yield out()
                counts.clear()
        yield out()

    return records.where("text is not null").select("text").mapInArrow(run, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


class Speller:
    """Costs of words in nats, and what a misread word may have been."""

    def __init__(self, known: dict[str, int], total: int = 0):
        self.total = total or sum(known.values()) or 1
        alike: dict[str, list[str]] = {}
        for w in known:
            alike.setdefault(skeleton(w), []).append(w)
        self.alike = {k: tuple(ws) for k, ws in alike.items()}
        self.rare = self.total * math.exp(-RARE_COST)
        self.common = LEAST_COMMON
        self.known = known
        misread = {w for group in alike.values() if len(group) > 1 for w in group if len(w) >= 4 and self.outweighed(w)}
        if misread:
            self.known = {w: n for w, n in known.items() if w not in misread}
        self.remembered: dict[str, tuple[float, str]] = {}
        self.kept: dict[str, bool] = {}

    def outweighed(self, word: str) -> bool:
        """Whether a counted word is more likely a misreading of a far more common one."""
        n = math.log(self.known[word])
        return any(v != word and self.known[v] >= self.common and math.log(self.known[v]) - CHANGE_COST * k > n for v, k in self.variants(word))

    def grown(self, more: dict[str, int]) -> Speller:
        """A speller that knows further words besides, given with all words of their skeletons."""
        small = Speller(more, self.total)
        new = Speller.__new__(Speller)
        new.__dict__.update(self.__dict__)
        new.known = ChainMap({w: n for w, n in small.known.items() if w not in self.known}, self.known)
        new.alike = ChainMap({k: tuple(dict.fromkeys((*ws, *self.alike.get(k, ())))) for k, ws in small.alike.items()}, self.alike)
        new.remembered, new.kept = {}, {}
        return new

    def variants(self, word: str, changes: int = 2) -> list[tuple[str, int]]:
        """Words that `word` may be a misreading of, with the number of changes; every digit or sign in it is changed.

        A misreading has its word's skeleton, so the known words of that skeleton are all there are; each is aligned with `word`."""
        limit = max(changes, len(_DIGIT.findall(word)))
        found = ((v, _changes(word, v, limit)) for v in self.alike.get(skeleton(word), ()) if v != word and v in self.known and not _DIGIT.search(v))
        return [(v, n) for v, n in found if n is not None]

    def cost(self, word: str) -> tuple[float, str]:
        """Cost of the cheapest reading of a word (without marks, in lower case), and that reading."""
        if not word or not _LETTERS.search(word):
            return 3.0, word
        got = self.remembered.get(word)
        if got is None:
            if len(self.remembered) > 300_000:
                self.remembered.clear()
            n = self.known.get(word)
            if n:
                got = (math.log(self.total / n), word)
            else:
                got = (self.left(word), word)
                if len(word) >= 4 and skeleton(word) in self.alike:
                    for v, k in self.variants(word):
                        got = min(got, (math.log(self.total / self.known[v]) + CHANGE_COST * k, v))
            self.remembered[word] = got
        return got

    def left(self, token: str) -> float:
        """Cost of a token left as it is."""
        word = core(token)
        if not word or not _LETTERS.search(word):
            return 3.0
        n = self.known.get(word)
        return math.log(self.total / n) if n else 16.0 + 0.4 * len(word) + 8.0 * bool(_INSIDE.search(word))

    def plain(self, token: str) -> bool:
        """Whether a token without a hyphen at its end can only be kept: a known word, or marks alone."""
        got = self.kept.get(token)
        if got is None:
            if len(self.kept) > 300_000:
                self.kept.clear()
            word = core(token)
            got = self.kept[token] = (self.known.get(word, 0) > self.rare and not (len(word) == 1 and token.isalpha())) or (
                not _LETTERS.search(word) and not (word and token[-1:].isalnum()))
        return got

    def misread(self, token: str) -> int:
        """2 if a word with a digit or sign in it has a known reading, 1 if only letters changed, 0 if it is no misreading."""
        word = core(token)
        if len(word) < 4 or word in self.known or not word.replace("|", "").isalnum() or word.isdigit():
            return 0
        reading = self.cost(word)[1]
        if reading == word:
            return 0
        return 2 if _DIGIT.search(word) else int(self.known[reading] >= self.common)


class _Asked(dict):
    """A dictionary that notes which words it was asked for and did not hold."""

    def __init__(self, held: dict[str, int]):
        super().__init__(held)
        self.missed: set[str] = set()

    def __contains__(self, word) -> bool:
        return super().__contains__(word) or self.missed.add(word) is not None

    def get(self, word, default=None):
        return super().get(word) if word in self else default


class _Asker(Speller):
    """Decodes with a part of the words only, to note every further word that decoding may ask for: what is unknown here is
    joined, split and looked up at least as often as with all words. Readings are found by skeleton, so none is tried."""

    def __init__(self, speller: Speller):
        self.__dict__.update(speller.__dict__)
        self.known, self.remembered, self.kept, self.alike = _Asked(speller.known), {}, {}, ()

    def asked(self, text: str) -> set[str]:
        self.remembered.clear()
        self.kept.clear()
        self.known.missed = set()
        read(text, self)
        return {w for w in self.known.missed if 0 < len(w) <= 64 and _LETTERS.search(w)}


_NUMBER = re.compile(r"^[\[(\-–—.\s]*(\d{1,4})[\])\-–—.\s]*$")
_HEADED = re.compile(r"^\s*\d{1,4}\s*[|•·]\s*\S|\S\s*[|•·]\s*\d{1,4}\s*$")
#: A page word and a number alone in their line; the abbreviations may also be a citation that wrapped.
_LABELLED = re.compile(r"^(?![^\[(]*[\])])[\[(\-–—\s]*(страница|стр|с|сторінка|стор|page|p|pg|seite|s)\b\.?[ \t]*(\d{1,4})[\])\-–—.\s]*$", re.I)
_CITED = re.compile(r"[\[(,;][ \t]*$")
_END = re.compile(r"[.!?…:;][\"'»”’)\]]*\s*$")
_EXTRACTOR = re.compile(r"^\s*---\s*\S+\s+\d+\s*---\s*$")


def page_lines(lines: list[str]) -> tuple[set[int], int]:
    """The lines that are page numbers or running headers, and how many surely stand within the text.

    A number alone in its line, also after a page word, a header with a number, and the short line beside either are candidates. They
    surely stand within the text where the sentence goes on after them, where a page break is, where numbers are decorated or labelled,
    or where they count up. A short line that comes again, each time where a sentence goes on over it, is a header without a number.
    """
    number = {i: int(m.group(1)) for i, x in enumerate(lines) if (m := _NUMBER.match(x.replace("\f", "")))}
    headed = {i for i, x in enumerate(lines) if _HEADED.search(x.replace("\f", "")) and len(x) < 90}
    breaks = {i for i, x in enumerate(lines) if "\f" in x}
    labelled = {i: m for i, x in enumerate(lines) if len(x) < 40 and (m := _LABELLED.match(x.replace("\f", ""))) and not _EXTRACTOR.match(x)}
    labelled = {i: m for i, m in labelled.items() if len(m.group(1)) > 2 or not (i and _CITED.search(lines[i - 1]))}
    number.update((i, int(m.group(2))) for i, m in labelled.items())
    again = _repeated_headers(lines)
    if not (number or headed or breaks):
        return again, len(again)
    values = {*number.values(), *(int(re.search(r"\d+", lines[i]).group()) for i in headed)}
    repeats = Counter(x.strip().lower() for x in lines if 0 < len(x.strip()) <= 80)
    out: set[int] = set(again)
    sure = len(again)
    text = [i for i, x in enumerate(lines) if x.strip()]
    place = {i: k for k, i in enumerate(text)}
    for i in sorted(set(number) | headed | breaks):
        if i not in place:
            continue
        k = place[i]
        group = [i] if i in number or i in headed else []
        before = after = None

        def header(j: int) -> bool:
            x = lines[j].strip()
            return len(x) <= 80 and not _END.search(x) and x[:1].isupper() and len(x.split()) <= 8

        if i in headed:
            before, after = k - 1, k + 1
        else:
            # a header stands above or below its number, or after the page break
            before, after = k - 1, k + 1
            if i not in number:
                before = k - 1
                if header(i):
                    group = [i]
                elif after < len(text) and lines[i].strip() == "" and header(text[after]):
                    group.append(text[after])
            elif after < len(text) and header(text[after]) and text[after] not in number and _goes_on(lines, text, before, after + 1):
                group.append(text[after])
                after += 1
            elif before >= 0 and header(text[before]) and text[before] not in number and _goes_on(lines, text, before - 1, after):
                group.append(text[before])
                before -= 1
            elif after < len(text) and header(text[after]) and ("\f" in lines[i] or repeats[lines[text[after]].strip().lower()] > 1):
                group.append(text[after])
                after += 1
        inside = _goes_on(lines, text, before, after)
        decorated = i in number and lines[i].strip("\f \t")[:1] in "[(-–—"
        counts = i in number and number[i] < 1000 and (number[i] + 1 in values or number[i] - 1 in values)
        broken = "\f" in lines[i] or (i + 1 < len(lines) and "\f" in lines[i + 1])
        named = i in labelled and (len(labelled[i].group(1)) > 2 or labelled[i].group(1).isupper())
        listed = i in headed or counts or named
        if inside or broken or decorated or (listed and k > 0):
            sure += 1
            out |= set(group)
    return out, sure


def _repeated_headers(lines: list[str]) -> set[int]:
    """Short lines that come again in the text, each time between other lines whose sentence goes on over them."""
    text = [i for i, x in enumerate(lines) if x.strip()]
    places: dict[str, list[int]] = {}
    for k in range(1, len(text) - 1):
        x = lines[text[k]].strip()
        if len(x) <= 80 and x[0].isupper() and not _END.search(x) and x[-1] not in HYPHENS and len(x.split()) <= 8 and _goes_on(lines, text, k - 1, k + 1):
            places.setdefault(x.lower(), []).append(k)
    out: set[int] = set()
    for at in places.values():
        # a text that repeats its own wording has the same lines around them
        if len(at) > 1 and all(len({lines[text[k + d]].strip() for k in at}) == len(at) for d in (-1, 1)):
            out |= {text[k] for k in at}
    return out


def _goes_on(lines: list[str], text: list[int], before: int, after: int) -> bool:
    """Whether a sentence goes on from one line to another."""
    if before < 0 or after >= len(text):
        return False
    a, z = lines[text[before]].strip(), lines[text[after]].strip()
    return not _END.search(a) and z[:1].islower()


def _recase(token: str, reading: str) -> str:
    """The token with its word replaced, marks and capitals kept."""
    bare = token.strip(_EDGES)
    at = token.find(bare)
    if bare.lower() == reading or not bare:
        return token
    letters = [c for c in bare if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        reading = reading.upper()
    elif bare[0].isupper():
        reading = reading[:1].upper() + reading[1:]
    return token[:at] + reading + token[at + len(bare) :]


def decode_steps(tokens: list[str], hyphen: list[bool], speller: Speller) -> list[tuple[int, int, list[str], float]]:
    """The cheapest reading of a stream of tokens: (first token, token after the last, words, gain) each.

    A reading keeps a token, replaces misread characters in it, joins it with the next ones (across a hyphen at a line's end, or
    where a blank was put in), or splits it in two. hyphen tells which tokens ended a line with a hyphen. gain is what the step
    costs less than its tokens left as they are. A token that can only be kept, with no step over it, cuts the stream: only
    what lies between cuts is searched, with the same result.
    """
    n = len(tokens)
    out: list[tuple[int, int, list[str], float]] = []
    i = 0
    while i < n:
        if not hyphen[i] and speller.plain(tokens[i]):
            out.append((i, i + 1, [tokens[i]], 0.0))
            i += 1
            continue
        # best[k]: cheapest way to the token i + k; the stretch ends where no step leads further
        best: list[tuple[float, int, list[str], float]] = [(0.0, i, [], 0.0)]

        def offer(a: int, z: int, cost: float, words: list[str]) -> None:
            while len(best) <= z - i:
                best.append((math.inf, i, [], 0.0))
            if best[a - i][0] + cost < best[z - i][0]:
                left = 0.0 if words == tokens[a:z] else sum(speller.left(t) for t in tokens[a:z])
                best[z - i] = (best[a - i][0] + cost, a, words, left - cost if left else 0.0)

        at = i
        while at == i or at - i < len(best) - 1:
            _offers(tokens, hyphen, speller, at, offer)
            at += 1
        steps = []
        z = at
        while z > i:
            _, a, words, gain = best[z - i]
            steps.append((a, z, words, gain))
            z = a
        out += steps[::-1]
        i = at
    return out


def _offers(tokens: list[str], hyphen: list[bool], speller: Speller, i: int, offer) -> None:
    """Every step that begins with the i-th token."""
    n = len(tokens)
    token = tokens[i]
    word = core(token)
    cost, reading = speller.cost(word)
    offer(i, i + 1, cost, [_recase(token, reading)])
    if hyphen[i] and i + 1 < n:
        joined = token.rstrip(HYPHENS) + tokens[i + 1]
        c, r = speller.cost(core(joined))
        offer(i, i + 2, c + 0.5, [_recase(joined, r)])
        if i + 2 < n and hyphen[i + 1]:
            longer = joined.rstrip(HYPHENS) + tokens[i + 2]
            c, r = speller.cost(core(longer))
            offer(i, i + 3, c + 1.0, [_recase(longer, r)])
    elif i + 1 < n and word and speller.known.get(word, 0) <= speller.rare and token[-1:].isalnum() and tokens[i + 1][:1].isalnum():
        c, r = speller.cost(core(token + tokens[i + 1]))
        if r in speller.known:  # two unknown words are no more likely one
            offer(i, i + 2, c + 6.0, [_recase(token + tokens[i + 1], r)])
    if len(word) == 1 and token.isalpha():
        j, joined = i, ""
        while j < n and len(core(tokens[j])) == 1 and core(tokens[j]).isalpha():
            joined += tokens[j]
            j += 1
            if j - i >= 4:
                c, r = speller.cost(core(joined))
                if r in speller.known:
                    offer(i, j, c + 2.0, [_recase(joined, r)])
    if len(word) >= 8 and word not in speller.known and word.isalpha():
        for k in range(3, len(word) - 2):
            if (word[:k] in speller.known) & (word[k:] in speller.known):
                at = token.lower().find(word) + k
                offer(i, i + 1, speller.cost(word[:k])[0] + speller.cost(word[k:])[0] + 5.0, [token[:at], token[at:]])


def decode_words(tokens: list[str], hyphen: list[bool], speller: Speller) -> list[tuple[int, str]]:
    """The words of the cheapest reading: (number of the first token, word) each."""
    return [(a, w) for a, _, words, _ in decode_steps(tokens, hyphen, speller) for w in words]


def paragraph_breaks(lines: list[str], blank: list[bool]) -> list[bool]:
    """Of each line but the first, whether a paragraph begins with it. blank tells that an empty line stood before it.

    Chosen together, by dynamic programming over the lines: a break costs little after a sentence's end, before a capital, after a blank or a
    short line; a paragraph of a single short line costs extra on either side.
    """
    n = len(lines)
    width = sorted(len(x) for x in lines)[int(0.8 * (n - 1))] if n else 0
    inf = math.inf
    state = [0.0, inf]  # lines of the paragraph so far: one, more
    back: list[tuple[int, int]] = []
    for k in range(1, n):
        a, z = lines[k - 1].rstrip(), lines[k].lstrip()
        ends, capital = bool(_END.search(a)), not z[:1].islower()
        broken = a[-1:] in HYPHENS or not ends
        score = 2.0 - 4.0 * blank[k] - (1.5 if len(a) < 0.75 * width else 0.0) + (2.5 if broken else -0.5) + (0.0 if capital else 4.0)
        single = 0.6 if len(a) < 0.5 * width and not blank[k] else 0.0
        to_break = min((state[0] + score + single, 0), (state[1] + score, 1))
        to_join = min((state[0] - score * 0.5, 0), (state[1] - score * 0.5, 1))
        back.append((to_break[1], to_join[1]))
        state = [to_break[0], to_join[0]]
    out = [False] * n
    s = 0 if state[0] <= state[1] else 1
    for k in range(n - 1, 0, -1):
        out[k] = s == 0
        s = back[k - 1][s]
    return out


def read(text: str, speller: Speller) -> tuple[bool, str]:
    """Whether decoding took noise of scanning out of a text, and its continuous paragraphs of clean words.

    Noise is a page line surely within the text, or a word that was corrected or joined and costs at least LEAST_GAIN less than
    what stood there. Where the joined word is unknown, two words broken by hyphens at lines' ends are needed.
    """
    lines = text.split("\n")
    pages, sure = page_lines(lines)
    noise = pages | {i for i, x in enumerate(lines) if _EXTRACTOR.match(x)}
    kept: list[str] = []
    blank: list[bool] = []
    empty = False
    for i, x in enumerate(lines):
        if i in noise:
            continue
        if not x.strip():
            # a blank line beside a page's end isn't a paragraph's
            empty = empty or not ({i - 1, i + 1} & noise)
            continue
        kept.append(x.replace("\f", "").strip())
        blank.append(empty)
        empty = False
    if not kept:
        return sure > 0, ""
    starts = paragraph_breaks(kept, blank)
    tokens: list[str] = []
    hyphen: list[bool] = []
    first: set[int] = set()
    for k, x in enumerate(kept):
        if k and starts[k]:
            first.add(len(tokens))
        words = x.split()
        goes_on = k + 1 < len(kept) and not starts[k + 1]
        for m, w in enumerate(words):
            last = m == len(words) - 1 and goes_on
            tokens.append(w)
            hyphen.append(last and len(w) > 1 and w[-1] in HYPHENS and w[-2].isalnum())
    paragraphs: list[list[str]] = [[]]
    found, broken = sure > 0, 0
    for at, z, words, gain in decode_steps(tokens, hyphen, speller):
        if not found and gain >= LEAST_GAIN:
            broken += hyphen[at]
            found = broken > 1 or _is_noise(tokens[at:z], words, hyphen[at], speller)
        if at in first and paragraphs[-1]:
            paragraphs.append([])
        paragraphs[-1] += words
    return found, "\n\n".join(" ".join(p) for p in paragraphs)


def _is_noise(tokens: list[str], words: list[str], broken: bool, speller: Speller) -> bool:
    """Whether tokens read otherwise than they stand surely show noise. Words run together are split, but are no sign of a scan."""
    if len(words) > 1:
        return False
    if len(tokens) == 1:
        return speller.misread(tokens[0]) > 0
    bare = words[0].strip(_EDGES)
    plain = broken or bare.isalpha() and bare in (bare.lower(), bare.upper(), bare.capitalize())  # garbled text has blanks within words, too
    return plain and speller.known.get(bare.lower(), 0) >= (1 if broken else speller.common)


def is_scan(text: str, speller: Speller) -> bool:
    """Whether decoding takes words broken across lines, page numbers or running headers within it, or misread characters out of a text."""
    return read(text, speller)[0]


def repair(text: str, speller: Speller) -> str:
    """Continuous paragraphs of clean words."""
    return read(text, speller)[1]


def known_words(records: DataFrame) -> DataFrame:
    """(word, n) of every word in at least LEAST_DOCS texts."""
    return document_words(records).where(F.col("n") >= LEAST_DOCS).where("length(word) <= 64")


def _further(records: DataFrame, words: DataFrame, speller) -> DataFrame:
    """(rec, words, counts): for texts that ask for words that were not sent out, those words and all of their skeletons."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asker = _Asker(speller.value)
        for b in batches:
            for a in range(0, len(b), 512):
                part = [(r, skeleton(w)) for r, t in zip(*(x.to_pylist() for x in b.slice(a, 512).columns)) for w in asker.asked(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in part], pa.string()), pa.array([k for _, k in part], pa.string())], ["rec", "skeleton"])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([skeleton(w) for w in b.column(0).to_pylist()], pa.string())], ["word", "n", "skeleton"])

    asked = records.mapInArrow(ask, "rec string, skeleton string").distinct()
    got = asked.join(words.mapInArrow(key, "word string, n long, skeleton string"), "skeleton")
    return got.groupBy("rec").agg(F.collect_list(F.struct("word", "n")).alias("w")).select("rec", F.col("w.word").alias("words"), F.col("w.n").alias("counts"))


def scanned(records: DataFrame, repaired: bool = True, most_words: int = MOST_WORDS) -> DataFrame:
    """(rec, repaired) of the records that decoding takes noise of scanning out of; without repairs, repaired is null.

    Words are known by the number of texts they stand in, counted over all records. The most frequent most_words are sent
    out; if there are more, what texts ask for beyond them is joined to the texts. Null, empty and clean texts,
    plain line wrapping, contents and numbered lists and the extractor's page lines give no row; very long texts are
    decoded whole; extra columns are ignored. rec is unique.
    """
    spark = records.sparkSession
    ship(spark)
    counted = materialize(known_words(records))
    size, total = counted.agg(F.count("*"), F.sum("n")).first()
    rows = counted.orderBy(F.desc("n"), "word").limit(most_words).collect() if size > most_words else counted.collect()
    words = spark.sparkContext.broadcast(Speller({r["word"]: r["n"] for r in rows}, total or 0))
    texts = records.where("text is not null").select("rec", "text")
    schema = "rec string, repaired string"

    def out(part: list[tuple[str, bool, str]]) -> pa.RecordBatch:
        part = [(r, t) for r, found, t in part if found]
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in part], pa.string()), pa.array([t if repaired else None for _, t in part], pa.string())], ["rec", "repaired"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = words.value
        for b in batches:
            for a in range(0, len(b), 512):
                yield out([(r, *read(t, speller)) for r, t in zip(*(x.to_pylist() for x in b.slice(a, 512).columns))])

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = words.value
        for b in batches:
            for a in range(0, len(b), 512):
                yield out([(r, *read(t, speller.grown(dict(zip(more, n))) if more else speller)) for r, t, more, n in zip(*(x.to_pylist() for x in b.slice(a, 512).columns))])

    if size <= most_words:
        return texts.mapInArrow(run, schema)
    return texts.join(_further(texts, counted, words), "rec", "left").mapInArrow(run_joined, schema)
