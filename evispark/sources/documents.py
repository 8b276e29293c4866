"""Document sources: dossiers of files to pages of text."""

from __future__ import annotations

import io
import json
import re
import tomllib
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions.text import bounded_lines, readable
from evispark.sources.shipping import ship

#: The supported formats.
SUFFIXES = ("txt", "md", "csv", "json", "docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: readers of formats that need a library of their own, as {"pdf": bytes -> page texts}
PLUG_INS: dict[str, Callable[[bytes], list[str]]] = {}


def dossier(spark: SparkSession, folder: str) -> DataFrame:
    """(path, format, content, sha256) of the supported files below a folder, hidden ones left out.

    PDF is known by its first bytes, the rest by its suffix.
    """
    ship(spark.sparkContext)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(F.substring("content", 1, 5) == F.lit(b"%PDF-"), "pdf").when(suffix.isin(*SUFFIXES), suffix)
    return files.select("path", kind.alias("format"), "content", F.sha2("content", 256).alias("sha256")).where(F.col("format").isNotNull() & ~F.col("path").rlike(r"/\.[^/]"))


def pages(files: DataFrame, plug_ins: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """(path, page, text, error): the pages of each file from 1; all formats but PDF have one.

    A file that cannot be read gives one row with an error instead of a text.
    """
    readers = READERS | PLUG_INS | (plug_ins or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, kind, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows += [(path, n, text, None) for n, text in enumerate(readers[kind](content), 1)]
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError, RecursionError) as error:
                    rows.append((path, 1, None, f"{type(error).__name__}: {error}"[:200]))
            columns = list(zip(*rows)) or [(), (), (), ()]
            types = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "page", "text", "error"])

    return files.select("path", "format", "content").mapInArrow(run, "path string, page int, text string, error string")


def _text(content: bytes) -> list[str]:
    return [bounded_lines(readable(content.decode("utf-8-sig")))]


def _json(content: bytes) -> list[str]:
    def refuse(token: str) -> None:
        raise ValueError(f"{token} is no JSON number")

    return [bounded_lines(readable(json_markdown(json.loads(content.decode("utf-8"), parse_constant=refuse))))]


def json_markdown(value: object, depth: int = 1) -> str:
    """A JSON value as Markdown: members as headings, lists as bullets, lists of flat records as tables."""
    out: list[str] = []
    if isinstance(value, dict):
        for key, inner in value.items():
            if isinstance(inner, (dict, list)) and inner:
                out += [f"{'#' * min(depth, 6)} {words(key)}", "", json_markdown(inner, depth + 1), ""]
            else:
                out.append(f"- {words(key)}: {_scalar(inner)}")
    elif isinstance(value, list) and value and all(isinstance(v, dict) and not any(isinstance(x, (dict, list)) for x in v.values()) for v in value):
        names = list(dict.fromkeys(k for v in value for k in v))
        out.append("| " + " | ".join(map(words, names)) + " |")
        out.append("| " + " | ".join("---" for _ in names) + " |")
        out += ["| " + " | ".join(_scalar(v.get(n)).replace("|", "\\|") for n in names) + " |" for v in value]
    elif isinstance(value, list):
        for inner in value:
            out.append(json_markdown(inner, depth + 1) if isinstance(inner, (dict, list)) else f"- {_scalar(inner)}")
    else:
        out.append(_scalar(value))
    return "\n".join(out).strip("\n")


def _scalar(value: object) -> str:
    return "" if value is None else json.dumps(value) if isinstance(value, bool) else str(value) if not isinstance(value, (dict, list)) else "none"


def words(key: str) -> str:
    """A camel-case key as a sentence of words, without a closing Struct."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", key.removesuffix("Struct")).split()
    return " ".join(spaced).lower().capitalize() if spaced else key


def _docx(content: bytes) -> list[str]:
    """Paragraphs, tables between their marks and footnotes at the end, as one page.

    A row is a header only if the table says so; a footnote's place in the text
    is marked with its id, and separators (ids below 0) are no notes.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        notes = ElementTree.fromstring(archive.read("word/footnotes.xml")) if "word/footnotes.xml" in archive.namelist() else ()
    if body is None:
        raise ValueError("the document has no body")
    lines: list[str] = []
    tables = 0
    for element in body:
        if element.tag == f"{_W}p":
            lines += _inline(element).splitlines()
        elif element.tag == f"{_W}tbl" and (rows := element.findall(f"{_W}tr")):
            tables += 1
            lines.append(f"[TABLE {tables} START]")
            for i, row in enumerate(rows, 1):
                mark = "HEADER" if row.find(f"{_W}trPr/{_W}tblHeader") is not None else f"ROW {i}"
                lines.append(f"{mark}: | " + " | ".join(map(_one_line, row.findall(f"{_W}tc"))) + " |")
            lines.append(f"[TABLE {tables} END]")
    listed = sorted((int(i), _one_line(note)) for note in notes if note.tag == f"{_W}footnote" and re.fullmatch(r"\d+", i := note.get(f"{_W}id", "")))
    held = [f"FOOTNOTE {i}: {said}" for i, said in listed if said]
    return [bounded_lines(readable("\n".join([*lines, *(["[FOOTNOTES]", *held] if held else [])])))]


def _inline(element: ElementTree.Element) -> str:
    out = []
    for e in element.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag == f"{_W}tab":
            out.append("\t")
        elif e.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
        elif e.tag == f"{_W}footnoteReference" and e.get(f"{_W}id") is not None:
            out.append(f"[FOOTNOTE {e.get(f'{_W}id')}]")
    return "".join(out)


def _one_line(element: ElementTree.Element) -> str:
    return " ".join(filter(None, map(str.strip, _inline(element).splitlines())))


READERS: dict[str, Callable[[bytes], list[str]]] = {"txt": _text, "md": _text, "csv": _text, "json": _json, "docx": _docx}


def replayed_record(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The text of a pinned file; it fails if the content's hash is another one."""
    row = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("h"))
    checked = F.when(F.col("h") == sha256, F.decode("content", "UTF-8")).otherwise(F.raise_error(F.lit("the record's hash differs from its pin")))
    return row.select(checked.alias("record"))


def manifest(path: str) -> dict:
    """A TOML manifest of roles, registry entry and omissions; small, so the driver reads it."""
    found = tomllib.loads(Path(path).read_text("utf-8"))
    unknown = set(found) - {"roles", "nct", "omissions", "registry"}
    if unknown:
        raise ValueError(f"unknown manifest fields: {sorted(unknown)}")
    return found


def transcript(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, ordinal, event) of JSON-lines files: a byte order mark and blank lines are allowed, a malformed line fails.

    The ordinal is the line's number in its file, from 1, blank lines counted,
    however the file is split: lines are numbered within a split, and the lines
    of the splits before it are added.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = raw.join(blocks.select("file", "block", (before - F.col("first") + 1).alias("shift")), ["file", "block"])
    clean = placed.withColumn("value", F.regexp_replace(F.trim(F.regexp_replace("value", "\r$", "")), "^\ufeff", "")).where("value <> ''")
    return clean.select("file", (F.col("id") + F.col("shift")).alias("ordinal"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("event"))
