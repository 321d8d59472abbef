"""Text expressions: all Catalyst built-ins, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Risk bands of one fragment's score and of a document's percent, highest first (fixed values).
SCORE_BANDS = (("high", 0.75), ("medium", 0.55), ("low", 0.35))
PERCENT_BANDS = (("high", 60.0), ("medium", 35.0), ("low", 15.0))
RISK_LABELS = {
    "high": "Высокий риск заимствования",
    "medium": "Средний риск заимствования",
    "low": "Низкий риск заимствования",
    "none": "Оригинальный фрагмент",
}
UNKNOWN_RISK = "Не определено"


def strip(c: Column | str) -> Column:
    """Without white space of any kind at both ends (trim() takes blanks alone)."""
    return F.regexp_replace(F.regexp_replace(c, r"^(?U:\s)+", ""), r"(?U:\s)+$", "")


def let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(c: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores, repeats kept; null gives null."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0)


def word_count(c: Column | str) -> Column:
    """Stretches between white space; null and blank texts have 0."""
    return F.coalesce(F.size(F.filter(F.split(c, r"(?U:\s)+"), lambda w: w != "")), F.lit(0))


def segments(c: Column | str, least: int = 20) -> Column:
    """Paragraphs of at least `least` characters, if there is more than one paragraph; otherwise sentences of that
    length, or the whole text if no sentence is. Blank and null texts have none."""
    long = lambda parts: F.filter(parts, lambda s: F.length(s) >= least)

    def sentences(whole: Column) -> Column:
        parts = long(F.transform(F.split(whole, r"(?<=[.!?…])(?U:\s)+"), strip))
        return let(parts, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(whole)))

    def cut(whole: Column) -> Column:
        paragraphs = F.filter(F.transform(F.split(whole, r"\n(?U:\s)*\n"), strip), lambda p: p != "")
        return let(paragraphs, lambda x: F.when(F.size(x) > 1, long(x)).otherwise(sentences(whole)))

    return let(strip(F.coalesce(c, F.lit(""))), lambda w: F.when(w == "", F.array().cast("array<string>")).otherwise(cut(w)))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def band(c: Column, bands=SCORE_BANDS) -> Column:
    """Name of the highest band the value reaches; 'none' below all and for null."""
    out = None
    for name, at in bands:
        out = F.when(c >= at, name) if out is None else out.when(c >= at, name)
    return out.otherwise("none")


def risk_label(c: Column) -> Column:
    out = None
    for level, text in RISK_LABELS.items():
        out = F.when(c == level, text) if out is None else out.when(c == level, text)
    return out.otherwise(UNKNOWN_RISK)


def extension(c: Column) -> Column:
    """Lower-case file extension with its point, or ''."""
    return F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"[^/\\]*[^/\\.](\.[^./\\]+)$", 1))


def stem(c: Column) -> Column:
    """File name without its folder and extension, or ''."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^.*[/\\]", ""), r"(?<=.)\.[^.]+$", "")


def falsy_or(*cs: Column) -> Column:
    """The first number that is neither null nor 0; else the last one as it is."""
    return F.coalesce(*[F.nullif(c, F.lit(0).cast("double")) for c in cs[:-1]], cs[-1])


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent, rounded half to even; 0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(F.bround(part / whole * 100, digits))


def source_ids(c: Column) -> Column:
    """Ids of a JSON list, or of a comma-separated list, of which only whole numbers count."""
    parts = F.transform(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), F.trim), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("long"))
    listed = F.from_json(c, "array<bigint>")
    return F.when(F.trim(c).startswith("[") & listed.isNotNull(), listed).otherwise(parts)


def pasted_blocks(c: Column) -> Column:
    """array<struct<label, text>> of a pasted collection: blocks between ---; a first line under 80 characters names
    its block, others are numbered from 1."""
    blocks = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "---"), strip), lambda b: b != "")

    def block(b: Column, i: Column) -> Column:
        first, at = F.substring_index(b, "\n", 1), F.instr(b, "\n")
        named = (at > 0) & (F.length(first) < 80)
        return F.struct(
            F.when(named, strip(first)).otherwise(F.concat(F.lit("Источник "), (i + 1).cast("string"))).alias("label"),
            F.when(named, strip(F.substr(b, at + 1))).otherwise(b).alias("text"))

    return F.transform(blocks, block)
