"""Reading uploaded files: plain text in several encodings, docx, and pasted collections."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from attestra.functions.text import extension, pasted_blocks
from attestra.plans.runtime import ship

TEXT, DOCX, PDF = (".txt", ".md"), ".docx", ".pdf"
MOST_BYTES = 10 * 1024 * 1024
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode_text(raw: bytes) -> str:
    """UTF-8, else Windows Cyrillic, else Latin-1; without white space around."""
    for encoding in ("utf-8", "cp1251", "latin-1"):
        try:
            return raw.decode(encoding).strip()
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes everything")


def table_text(rows: list[list[str]]) -> str:
    """A table as lines: cells without line breaks, empty ones left out, joined by ' | '."""
    cells = [[" ".join(c.split("\n")).strip() for c in r] for r in rows]
    return "\n".join(" | ".join(c for c in r if c) for r in cells if any(r))


#: An image reader (bytes to lines of text) and a PDF reader (bytes to pages of text, tables as rows of cells, and an image of the page or None) may be
#: given; none is installed here, and without them images add nothing and PDF files are errors.
Ocr = Callable[[bytes], list[str]]
Pdf = Callable[[bytes], list[tuple[str, list[list[list[str]]], bytes | None]]]
LEAST_SIDE = {"docx": 80, "pdf": 120}


@dataclass
class Extracted:
    text: str = ""
    paragraphs: int = 0
    tables: int = 0
    images_ocr: int = 0
    pages: int = 0
    error: str = ""


def image_size(raw: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF or JPEG image."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return struct.unpack(">II", raw[16:24])
    if raw[:4] == b"GIF8" and len(raw) >= 10:
        return struct.unpack("<HH", raw[6:10])
    if raw[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(raw) and raw[at] == 0xFF:
            kind, length = raw[at + 1], struct.unpack(">H", raw[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", raw[at + 5 : at + 9])
                return width, height
            at += 2 + length
    return None


def image_text(raw: bytes, ocr: Ocr | None, least: int) -> str:
    """Lines that the image reader finds; nothing in images with a side under `least`, without a reader, or where it fails."""
    size = image_size(raw)
    if ocr is None or (size and min(size) < least):
        return ""
    try:
        return "\n".join(x.strip() for x in ocr(raw) if x and x.strip())
    except Exception:  # a picture that can't be read is no reason to lose the text around it
        return ""


def docx_text(raw: bytes, ocr: Ocr | None = None) -> Extracted:
    """Text of a docx body, in order, with numbered tables; then what its images say."""
    out = Extracted()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        images = [z.read(n) for n in sorted(z.namelist()) if n.startswith("word/media/")] if ocr else []
    words = lambda e: "".join((n.text or "") if n.tag == f"{_W}t" else "\t" if n.tag == f"{_W}tab" else "\n" if n.tag == f"{_W}br" else "" for n in e.iter())
    parts = []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p" and (t := words(e).strip()):
            parts.append(t)
            out.paragraphs += 1
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(words(p) for p in c.iter(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            if t := table_text(rows):
                out.tables += 1
                parts.append(f"[Таблица {out.tables}]\n{t}")
    for image in images:
        if t := image_text(image, ocr, LEAST_SIDE["docx"]):
            out.images_ocr += 1
            parts.append(t)
    out.text = "\n\n".join(parts)
    return out


def pdf_text(raw: bytes, pdf: Pdf, ocr: Ocr | None = None) -> Extracted:
    """Pages under their marks: text and tables, numbered from 1 on each page; a page with neither is read as an image."""
    out, parts = Extracted(), []
    for number, (text, tables, picture) in enumerate(pdf(raw), 1):
        out.pages += 1
        held = [text.strip()] if text and text.strip() else []
        found = [t for t in map(table_text, tables) if t]
        held += [f"[Таблица {k}]\n{t}" for k, t in enumerate(found, 1)]
        out.tables += len(found)
        if not held and picture and (t := image_text(picture, ocr, LEAST_SIDE["pdf"])):
            out.images_ocr += 1
            held = [t]
        if held:
            parts.append(f"--- Страница {number} ---\n" + "\n\n".join(held))
    out.text = "\n\n".join(parts)
    return out


def read_file(name: str, raw: bytes, pdf: Pdf | None = None, ocr: Ocr | None = None) -> Extracted:
    """What is in a file; one that can't be read has an error and no text. Only plain text has a limit on its size."""
    kind = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    try:
        if kind in TEXT:
            if len(raw) > MOST_BYTES:
                return Extracted(error="too large")
            out = Extracted(text=decode_text(raw))
        elif kind == DOCX:
            out = docx_text(raw, ocr)
        elif kind == PDF:
            if pdf is None:
                return Extracted(error="no PDF reader installed")
            out = pdf_text(raw, pdf, ocr)
        else:
            return Extracted(error="unsupported format")
    except Exception as x:  # whatever is wrong with a file, the others are read
        return Extracted(error=f"unreadable: {type(x).__name__}")
    if not out.text:
        out.error = "empty text"
    return out


def read_uploads(spark: SparkSession, path: str, pdf: Pdf | None = None, ocr: Ocr | None = None) -> DataFrame:
    """(path, format, text, paragraphs, tables, images_ocr, pages, error, ocr_available) of the files under a folder; bad files are rows with an error,
    not failures. The readers given go to the workers with the plan."""
    ship(spark)
    columns = ["text", "paragraphs", "tables", "images_ocr", "pages", "error"]

    @F.pandas_udf("text string, paragraphs int, tables int, images_ocr int, pages int, error string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, raws in batches:
            yield pd.DataFrame([[getattr(x, c) for c in columns] for x in (read_file(n, bytes(r), pdf, ocr) for n, r in zip(names, raws))], columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", extension(F.col("path")).alias("format"), read("path", "content").alias("r")).select("path", "format", "r.*", F.lit(ocr is not None).alias("ocr_available"))


def parse_pasted(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, block, label, text): blocks of pasted collections, from 0."""
    return df.select(id, F.posexplode(pasted_blocks(F.col(text))).alias("block", "b")).select(id, "block", "b.label", "b.text")
