"""Sources: files, pages and job states as tables."""

from __future__ import annotations

import csv
import io
import itertools
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.text import page_text, page_title

PLAIN = ("txt", "md", "csv", "log", "json", "xml", "html")
SHEETS, WORD, SLIDES = ("xlsx",), ("docx",), ("pptx",)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _spread(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def sheet_matrices(data: bytes) -> list[tuple[str, list[list[str]], list[tuple[int, int, int, int]]]]:
    """(name, rows, merged ranges) of the sheets of an XLSX file, read from its XML."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if _spread(t.tag) == "t"))
        names = [s.attrib.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _spread(s.tag) == "sheet"]
        files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        out = []
        for k, file in enumerate(files):
            root = ElementTree.fromstring(z.read(file))
            cells: dict[tuple[int, int], str] = {}
            for c in (e for e in root.iter() if _spread(e.tag) == "c"):
                at = place(c.attrib["r"])
                text = "".join(e.text or "" for e in c.iter() if _spread(e.tag) in ("v", "t"))
                cells[at] = shared[int(text)] if c.attrib.get("t") == "s" and text else text
            rows = max((r for r, _ in cells), default=-1) + 1
            columns = max((c for _, c in cells), default=-1) + 1
            merged = [(*place(a), *place(b)) for a, b in (e.attrib["ref"].split(":") for e in root.iter() if _spread(e.tag) == "mergeCell")]
            out.append((names[k] if k < len(names) else f"sheet{k + 1}", [[cells.get((r, c), "") for c in range(columns)] for r in range(rows)], merged))
        return out


def place(ref: str) -> tuple[int, int]:
    """(row, column) from 0 of a reference like B3."""
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    column = 0
    for ch in letters:
        column = column * 26 + ord(ch) - 64
    return int(digits) - 1, column - 1


def _paragraphs(xml: bytes) -> list[str]:
    """Paragraphs of an Office XML part; the cells of a table row with a bar between."""
    root, out = ElementTree.fromstring(xml), []

    def text(node) -> str:
        return "".join(t.text or "" for t in node.iter() if _spread(t.tag) == "t").strip()

    def walk(node) -> None:
        for child in node:
            tag = _spread(child.tag)
            if tag == "p":
                out.append(text(child))
            elif tag == "tr":
                out.append(" | ".join(text(c) for c in child if _spread(c.tag) == "tc"))
            else:
                walk(child)

    walk(root)
    return [t for t in out if t]


def office_tables(xml: bytes) -> list[list[list[str]]]:
    """Matrices of the tables of an Office XML part, in order. A cell over several columns stands in each of them, and a cell
    that goes on a vertical merge has the text of the one above."""
    out = []

    def text(node) -> str:
        return "\n".join(filter(None, ("".join(t.text or "" for t in p.iter() if _spread(t.tag) == "t").strip() for p in node.iter() if _spread(p.tag) == "p")))

    def attribute(node, name: str, otherwise: str | None = None) -> str | None:
        return next((v for k, v in node.attrib.items() if _spread(k) == name), otherwise)

    for table in (e for e in ElementTree.fromstring(xml).iter() if _spread(e.tag) == "tbl"):
        rows: list[list[str]] = []
        for tr in (c for c in table if _spread(c.tag) == "tr"):
            row: list[str] = []
            for tc in (c for c in tr if _spread(c.tag) == "tc"):
                marks = {_spread(e.tag): e for e in tc.iter() if _spread(e.tag) in ("gridSpan", "vMerge")}
                span = int(attribute(marks["gridSpan"], "val", "1")) if "gridSpan" in marks else 1
                goes_on = "vMerge" in marks and attribute(marks["vMerge"], "val", "continue") == "continue"
                above = rows[-1][len(row)] if goes_on and rows and len(row) < len(rows[-1]) else ""
                row += [above if goes_on else text(tc)] * span
            rows.append(row)
        if any(any(r) for r in rows):
            out.append(rows)
    return out


def _parts(kind: str, z: zipfile.ZipFile) -> list[str]:
    if kind in WORD:
        return ["word/document.xml"]
    return sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))


def file_tables(kind: str, data: bytes) -> list[tuple[str, list[list[str]], list[tuple[int, int, int, int]]]]:
    """(name, rows, merged ranges) of the tables of a file; none where its kind holds none or it can't be read."""
    try:
        if kind in SHEETS:
            return sheet_matrices(data)
        if kind in WORD + SLIDES:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return [(p.rsplit("/", 1)[-1].removesuffix(".xml"), rows, []) for p in _parts(kind, z) for rows in office_tables(z.read(p))]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
        return []
    return []


def marked_text(kind: str, data: bytes) -> str | None:
    """Text with marks of roles: ## before titles, - before items of lists, [表格] before tables. Other kinds, and files without
    such structure, have their plain text."""
    out: list[str] = []

    def line(p) -> str:
        return "".join(t.text or "" for t in p.iter() if _spread(t.tag) == "t").strip()

    def walk(node, title: bool) -> None:
        for child in node:
            tag = _spread(child.tag)
            if tag == "tbl":
                rows = [" | ".join(line(c) for c in tr if _spread(c.tag) == "tc") for tr in child if _spread(tr.tag) == "tr"]
                out.append("[表格]\n" + "\n".join(rows))
            elif tag == "p":
                marks = {_spread(e.tag): e for e in child.iter() if _spread(e.tag) in ("pStyle", "numPr")}
                style = next((v for k, v in marks["pStyle"].attrib.items() if _spread(k) == "val"), "") if "pStyle" in marks else ""
                said = line(child)
                if said:
                    out.append(f"## {said}" if title or style.startswith(("Heading", "Title")) else f"- {said}" if "numPr" in marks or style.startswith("List") else said)
            else:
                kinds = [e.attrib.get("type", "") for e in child.iter() if _spread(e.tag) == "ph"] if tag == "sp" else []
                walk(child, title or bool({"title", "ctrTitle"} & set(kinds)))

    try:
        if kind in WORD + SLIDES:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for p in _parts(kind, z):
                    walk(ElementTree.fromstring(z.read(p)), False)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
        out = []
    return "\n\n".join(out) if out else document_text(kind, data)


def document_text(kind: str, data: bytes) -> str | None:
    """Text of a file; None if its kind is not supported or it can't be read, empty if it holds none."""
    try:
        if kind in PLAIN:
            return data.decode("utf-8", errors="ignore")
        if kind in SHEETS:
            return "\n".join(" | ".join(v for v in row if v) for _, rows, _ in sheet_matrices(data) for row in rows if any(row))
        if kind in WORD + SLIDES:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return "\n".join(t for p in _parts(kind, z) for t in _paragraphs(z.read(p)))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError):
        return None
    return None


def read_files(spark: SparkSession, path: str, marked: bool = False) -> DataFrame:
    """(path, size, kind, text) of the files below a folder; hidden and lock files are skipped. marked: with marks of roles."""
    text_of = marked_text if marked else document_text
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.filter(~F.col("path").rlike(r"/(\.|~\$)[^/]*$")).select("path", F.col("length").alias("size"), suffix(F.col("path")).alias("kind"), "content")

    def texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["text"] = [text_of(k, c) for k, c in zip(f["kind"], f["content"])]
            yield f[["path", "size", "kind", "text"]]

    return files.mapInPandas(texts, "path string, size bigint, kind string, text string")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, table_id, rows, merged) of the sheets and tables of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xlsx,docx,pptx}").load(path).select("path", suffix(F.col("path")).alias("kind"), "content")

    def sheets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(p, name, f"{p}#{n}", rows, [list(m) for m in merged]) for p, k, c in zip(f["path"], f["kind"], f["content"]) for n, (name, rows, merged) in enumerate(file_tables(k, c))]
            yield pd.DataFrame(out, columns=["path", "sheet", "table_id", "rows", "merged"])

    return files.mapInPandas(sheets, "path string, sheet string, table_id string, rows array<array<string>>, merged array<array<int>>")


# Encodings that are tried for the text of attribute tables, in this order.
ENCODINGS = ("utf-8", "gbk", "gb18030", "latin-1")


def dbf_fields(data: bytes) -> tuple[int, int, int, list[tuple[str, str, int]]]:
    """(records, length of the header, length of a record, fields (name, type, width)) of a DBF file's header."""
    n, header, length = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at + 32 <= min(header, len(data)) and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16]))
        at += 32
    return n, header, length, fields


def dbf_rows(data: bytes) -> Iterator[list[str | None]]:
    """Records of a DBF file that are not deleted, as text; null where a cell is blank. The first encoding in which the whole
    table can be read is taken."""
    n, header, length, fields = dbf_fields(data)
    body = data[header : header + n * length]
    encoding = next(e for e in ENCODINGS if _decodes(body, e))
    for at in range(0, len(body) - length + 1, length):
        if body[at] == 0x2A:
            continue
        row, place = [], at + 1
        for _, _, width in fields:
            row.append(body[place : place + width].split(b"\0")[0].decode(encoding, errors="replace").strip() or None)
            place += width
        yield row


def _decodes(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def read_dbf(spark: SparkSession, path: str) -> DataFrame:
    """(path, record, values) of the attribute tables below a folder of any store that Spark reads: values is a map from field to
    text. A table (of up to 2 GB) is read by one task; attribute_tables.AttributeTables reads larger ones by ranges of records."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dbf").load(path).select("path", "content")

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"]):
                names = [name for name, _, _ in dbf_fields(data)[3]]
                rows = enumerate(dbf_rows(data))
                while part := list(itertools.islice(rows, 10_000)):
                    yield pd.DataFrame({"path": p, "record": [k for k, _ in part], "values": [dict(zip(names, r)) for _, r in part]})

    return files.mapInPandas(records, "path string, record bigint, values map<string,string>")


def dbf_table(spark: SparkSession, path: str) -> DataFrame:
    """The attribute tables below a folder as columns: path, record and each field; numbers as doubles. The headers say which
    fields there are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dbf").load(path).select("content")

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, name, kind) for data in f["content"] for k, (name, kind, _) in enumerate(dbf_fields(data)[3])]
            yield pd.DataFrame(rows, columns=["place", "name", "kind"])

    # A row for each different field only; a name that is text in one table is text in all.
    fields = files.mapInPandas(heads, "place int, name string, kind string").groupBy("name").agg(F.min("place").alias("place"), F.bool_and(F.col("kind").isin("N", "F")).alias("number")).orderBy("place", "name").collect()
    d = read_dbf(spark, path)
    return d.select("path", "record", *[(F.col("values")[r["name"]].try_cast("double") if r["number"] else F.col("values")[r["name"]]).alias(r["name"]) for r in fields])


def listing(files: DataFrame, web: DataFrame) -> DataFrame:
    """(path, size, kind): files by path, the parts of a shape file folded into its .shp with their sizes summed, a .gdb
    folder as one entry, and web sources added."""
    gdb = F.regexp_extract("path", r"^(.*?\.gdb)/", 1)
    stem = F.regexp_extract("path", r"^(.*)\.(shp|shx|dbf|prj|cpg|sbn|sbx)$", 1)
    owner = F.when(gdb != "", gdb).when(stem != "", F.concat(stem, F.lit(".shp"))).otherwise(F.col("path"))
    own = files.filter(~F.col("path").rlike(r"(^|/)(\.|~\$)[^/]*$")).groupBy(owner.alias("path")).agg(F.sum("size").cast("bigint").alias("size"))
    both = own.withColumn("kind", suffix(F.col("path"))).unionByName(web.select(F.col("url").alias("path"), F.length("text").cast("bigint").alias("size"), F.lit("web").alias("kind")))
    return both.orderBy("path")


def is_scanned(pages: DataFrame, file: str = "file_id", text: str = "text", least: int = 80) -> DataFrame:
    """(file, scanned): too little text a page on average."""
    return pages.groupBy(file).agg((F.coalesce(F.avg(F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))), F.lit(0.0)) < least).alias("scanned"))


def page_documents(pages: DataFrame, file: str = "file_id", page: str = "page_no", least: int = 50, scanned_least: int = 80) -> DataFrame:
    """(file, route, text) of files whose pages were read: text of each page, or what recognition made of it (column ocr) where
    the page has hardly any; its tables (column tables, an array of markdown) behind it. Scanned files go the slow way."""
    own = F.trim(F.coalesce("text", F.lit("")))
    seen = F.when((F.length(own) < least) & (F.coalesce("ocr", F.lit("")) != ""), F.col("ocr")).otherwise(own)
    body = F.array_join(F.filter(F.concat(F.array(seen), F.coalesce("tables", F.array().cast("array<string>"))), lambda t: t != ""), "\n\n")
    rows = pages.groupBy(file).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), body.alias("body")))).alias("a"))
    text = F.array_join(F.filter(F.transform("a", lambda x: x["body"]), lambda t: t != ""), "\n\n")
    return rows.select(file, text.alias("text")).join(is_scanned(pages, file, "text", scanned_least), file).select(file, F.when(F.col("scanned"), "slow").otherwise("fast").alias("route"), "text")


def web_sources(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, source_type) of raw pages."""
    return pages.select("page_id", "url", page_title(F.col("html"), F.col("url")).alias("title"), page_text(F.col("html")).alias("text"), F.lit("web").alias("source_type"))


def pasted(texts: DataFrame, least: int = 10) -> DataFrame:
    """Pasted texts that are long enough."""
    return texts.filter(F.length(F.trim("text")) >= least).withColumn("source_type", F.lit("text"))


def job_states(spark: SparkSession, path: str) -> DataFrame:
    """Job states, one JSON file each; columns that some files lack are null."""
    schema = "project_id string, file_id string, status string, chunks bigint, error_message string, updated_at string, auto_retry_count int"
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)


# Encodings that Spark's reader of delimited text takes.
SPARK_ENCODINGS = ("iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8")
# Beginnings of names of tables that a database keeps for itself.
SYSTEM_TABLES = ("GDB_", "Selections", "SelectedObjects", "MSys")


def is_system_table(name: Column) -> Column:
    return name.rlike("^(" + "|".join(SYSTEM_TABLES) + ")")


def _decoded(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Exported tables in an encoding that Spark's own reader does not take; rows of another width than the header are bad lines."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for data in f["content"]:
                found = csv.reader(io.StringIO(data.decode(encoding, errors="replace"), newline=""))
                head = next(found, [])
                kept = (dict(zip(head, r)) for r in found if len(r) == len(head))
                while part := list(itertools.islice(kept, 10_000)):
                    yield pd.DataFrame({"head": [head] * len(part), "cells": part})

    found = files.mapInPandas(rows, "head array<string>, cells map<string,string>")
    head = found.select("head").first()
    return found.select(*[F.nullif(F.col("cells")[c], F.lit("")).alias(c) for c in (head["head"] if head else [])])


def delimited(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Exported tables: bad lines skipped, geometry left out, null characters removed. Without an encoding it is UTF-8, or GBK
    where that leaves characters that can't be read."""
    read = lambda e: spark.read.option("header", "true").option("mode", "DROPMALFORMED").option("encoding", e).csv(path)
    if encoding and encoding.lower() not in SPARK_ENCODINGS:
        df = _decoded(spark, path, encoding)
    else:
        df = read(encoding or "UTF-8")
        if encoding is None:
            odd = F.exists(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in df.columns]), lambda v: v.contains("\ufffd")) if df.columns else F.lit(False)
            if any("\ufffd" in c for c in df.columns) or df.filter(odd).limit(1).count():
                df = _decoded(spark, path, "gbk")
    return df.select(*[F.replace(F.col(f"`{c}`"), F.lit("\0"), F.lit("")).alias(c) for c in df.columns if c.upper() != "SHAPE"])


def preview(df: DataFrame, limit: int = 200) -> DataFrame:
    """The first rows for a viewer, at most 2000."""
    return df.limit(min(limit, 2000))
