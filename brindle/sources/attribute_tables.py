"""Attribute tables (DBF) as a Spark data source: read by ranges of records, written a file for each part.

    spark.dataSource.register(AttributeTables)
    spark.read.format("attribute_tables").option("columns", "A,B").load(folder)
    df.write.format("attribute_tables").mode("append").save(folder)

Records have one length, so a partition is a range of them and a table of any size is read by many tasks, each some thousand records
at a time. Only the columns named (option columns; all without it) are cut out of the records. The driver reads headers and three
samples of each file, no more.

Options: path; columns; records (most in a partition, else as many as RANGE_BYTES hold); encoding (else tried, see encoding_of).
Files are opened by pyarrow: local and mounted folders, HDFS, object stores. readers.read_dbf takes any store of Spark's.

Columns: path, record (the place in the file, from 0; deleted records keep theirs), then the fields of all files. Numbers are bigint
where no file has decimals (by the header and its first PROBED records), else double; logical fields boolean; all else text. A field
that is a number in one file and text in another is text. Blank cells, and numbers that can't be read as the column's type, are
null; fields that a file lacks are null; names are those of the headers, of equal ones in a file the first counts.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from brindle.sources.readers import ENCODINGS

RANGE_BYTES, FILE_BYTES, BATCH_RECORDS, PROBED = 64 << 20, 64 << 20, 8192, 100
SAMPLE_RECORDS = 500
DELETED, BLANK = 0x2A, 0x20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or a local path."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    at: int
    width: int
    decimals: int


@dataclass(frozen=True)
class Layout:
    """What a file's header says; records: those that the file really holds."""

    uri: str
    records: int
    header: int
    length: int
    fields: tuple[Field, ...]
    encoding: str
    fractions: frozenset[str]  # numeric fields with decimals in the first records

    def kind(self, field: Field) -> str:
        if field.kind in "NF":
            return "double" if field.decimals or field.name in self.fractions or field.width > 18 and field.kind == "F" else "bigint"
        return "boolean" if field.kind == "L" else "string"


@dataclass(frozen=True)
class Range(InputPartition):
    layout: Layout
    first: int
    count: int


def encoding_of(samples: list[bytes], wanted: str | None) -> str:
    """The first encoding in which all samples can be read. A value that it does not fit is read in the next one that does."""
    if wanted:
        return wanted
    for e in ENCODINGS:
        try:
            for s in samples:
                s.decode(e)
            return e
        except UnicodeDecodeError:
            continue
    return ENCODINGS[-1]


def layout_of(uri: str, size: int, encoding: str | None = None) -> Layout:
    """The layout of a file; ValueError if its header is damaged."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        head = f.read(32)
        if len(head) < 32:
            raise ValueError(f"{uri}: no header")
        n, header, length = struct.unpack_from("<IHH", head, 4)
        described = f.read(max(0, header - 32))
        fields, at, seen = [], 1, set()
        for k in range(0, len(described) - 31, 32):
            if described[k] == 0x0D:
                break
            name, width = described[k : k + 11].split(b"\0")[0].decode("latin-1"), described[k + 16]
            if name not in seen:
                fields.append(Field(name, chr(described[k + 11]), at, width, described[k + 17]))
            seen.add(name)
            at += width
        if length < 1 or at > length:
            raise ValueError(f"{uri}: records of {length} bytes are too short for their fields")
        records = max(0, min(n, (size - header) // length))
        samples = []
        for first in sorted({0, records // 2, max(0, records - SAMPLE_RECORDS)}):
            f.seek(header + first * length)
            samples.append(f.read(length * min(SAMPLE_RECORDS, records - first)))
    rows = np.frombuffer(samples[0][: length * PROBED], np.uint8)
    rows = rows[: len(rows) // length * length].reshape(-1, length)
    fractions = frozenset(x.name for x in fields if x.kind in "NF" and np.isin(rows[:, x.at : x.at + x.width], list(b".eE")).any())
    texts = [np.ascontiguousarray(whole[:, x.at : x.at + x.width]).tobytes() for s in samples for whole in [np.frombuffer(s, np.uint8)[: len(s) // length * length].reshape(-1, length)] for x in fields if x.kind == "C"]
    return Layout(uri, records, header, length, tuple(fields), encoding_of(texts, encoding), fractions)


def files_below(uri: str) -> list[tuple[str, int]]:
    """(URI, bytes) of the .dbf files below a folder, or of a file, by path; hidden ones are left out."""
    system, path = opened(uri)
    prefix = uri[: len(uri) - len(path)] if "://" in uri and uri.endswith(path) else ""
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((prefix + i.path, i.size) for i in found if i.is_file and (i is info or i.extension.lower() == "dbf" and not i.base_name.startswith((".", "_"))))


def texts_of(cells: np.ndarray, encoding: str) -> pa.Array:
    """Trimmed texts of cells (rows x width, bytes); null where blank. A text ends at a zero byte."""
    if (cells == 0).any():
        cells = np.where(np.logical_or.accumulate(cells == 0, axis=1), BLANK, cells)
    raw = pa.array(np.ascontiguousarray(cells).view(f"S{cells.shape[1]}").ravel(), pa.binary())
    if encoding == "utf-8" or cells.max(initial=0) < 128:
        try:
            out = raw.cast(pa.string())
        except pa.ArrowInvalid:
            out = None
    else:
        out = None
    if out is None:
        out = pa.array([_decoded(v, encoding) for v in raw.to_pylist()], pa.string())
    out = pc.utf8_trim_whitespace(out)
    return pc.if_else(pc.equal(out, ""), pa.scalar(None, pa.string()), out)


def _decoded(value: bytes, encoding: str) -> str:
    for e in (encoding, *ENCODINGS):
        try:
            return value.decode(e)
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 reads all bytes")


def _number(text: str | None, whole: bool):
    if text is None:
        return None
    try:
        value = int(text) if whole else float(text)
    except ValueError:
        return None
    return None if whole and not -(1 << 63) <= value < 1 << 63 else value


def column_of(cells: np.ndarray, kind: T.DataType, encoding: str) -> pa.Array:
    """Cells as values of a column's type."""
    texts = texts_of(cells, encoding)
    if isinstance(kind, T.BooleanType):
        low = pc.utf8_lower(texts)
        return pc.if_else(pc.is_in(low, pa.array(["t", "y"])), True, pc.if_else(pc.is_in(low, pa.array(["f", "n"])), False, pa.scalar(None, pa.bool_())))
    if isinstance(kind, (T.LongType, T.DoubleType)):
        whole = isinstance(kind, T.LongType)
        wanted = pa.int64() if whole else pa.float64()
        try:
            return texts.cast(wanted)
        except pa.ArrowInvalid:
            return pa.array([_number(t, whole) for t in texts.to_pylist()], wanted)
    return texts


class AttributeTables(DataSource):
    """The data source; see the module."""

    def __init__(self, options):
        super().__init__(options)
        self._layouts: list[Layout] | None = None

    @classmethod
    def name(cls) -> str:
        return "attribute_tables"

    def layouts(self) -> list[Layout]:
        if self._layouts is None:
            with ThreadPoolExecutor(16) as pool:
                self._layouts = list(pool.map(lambda f: layout_of(*f, self.options.get("encoding")), files_below(self.options["path"])))
        return self._layouts

    def schema(self) -> T.StructType:
        kinds: dict[str, set[str]] = {}
        for layout in self.layouts():
            for field in layout.fields:
                kinds.setdefault(field.name, set()).add(layout.kind(field))
        wanted = self.options.get("columns")
        names = [c.strip() for c in wanted.split(",")] if wanted else list(kinds)
        if unknown := [c for c in names if c not in kinds]:
            raise ValueError(f"no table has the columns {', '.join(unknown)}")
        types = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
        kind = lambda k: types[next(iter(k))] if len(k) == 1 else T.DoubleType() if k == {"bigint", "double"} else T.StringType()
        return T.StructType([T.StructField("path", T.StringType()), T.StructField("record", T.LongType()), *(T.StructField(c, kind(kinds[c])) for c in names)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.layouts(), int(self.options.get("records", 0)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("attribute tables are only appended to a folder")
        return _Writer(schema, self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, layouts: list[Layout], records: int):
        self.schema, self.layouts, self.records = schema, layouts, records

    def partitions(self) -> list[Range]:
        out = []
        for layout in self.layouts:
            most = self.records or max(1, RANGE_BYTES // layout.length)
            out += [Range(layout, first, min(most, layout.records - first)) for first in range(0, layout.records, most)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no table holds a record
            return
        layout = partition.layout
        at = {f.name: f for f in layout.fields}
        system, path = opened(layout.uri)
        with system.open_input_file(path) as f:
            f.seek(layout.header + partition.first * layout.length)
            for first in range(partition.first, partition.first + partition.count, BATCH_RECORDS):
                n = min(BATCH_RECORDS, partition.first + partition.count - first)
                rows = np.frombuffer(f.read(n * layout.length), np.uint8).reshape(n, layout.length)
                live = np.flatnonzero(rows[:, 0] != DELETED)
                rows = rows[live]
                columns = [pa.array([layout.uri] * len(live), pa.string()), pa.array(first + live, pa.int64())]
                for column in self.schema.fields[2:]:
                    field = at.get(column.name)
                    if field is None or not field.width:
                        columns.append(pa.nulls(len(live), {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}.get(column.dataType.simpleString(), pa.string())))
                    else:
                        columns.append(column_of(rows[:, field.at : field.at + field.width], column.dataType, layout.encoding))
                yield pa.RecordBatch.from_arrays(columns, names=self.schema.names)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (hidden name, name)


class _Writer(DataSourceArrowWriter):
    """Files under hidden names until the job commits; ValueError for a text that is longer than a cell can be (254 bytes)."""

    def __init__(self, schema: T.StructType, folder: str):
        self.schema, self.folder = schema, folder
        self.fields = []
        for field in schema.fields:
            kind = field.dataType
            name = field.name.encode("latin-1", "replace")
            if len(name) > 10:
                raise ValueError(f"{field.name}: names have ten characters at most")
            if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                self.fields.append((name, b"N", 20, 0))
            elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
                self.fields.append((name, b"F", 32, 15))
            else:
                self.fields.append((name, b"L", 1, 0) if isinstance(kind, T.BooleanType) else (name, b"C", 254, 0))

    def cells(self, column: pa.Array, field: tuple) -> np.ndarray:
        _, kind, width, _ = field
        if kind == b"L":
            column = pc.if_else(column, "T", "F")
        elif kind == b"F":
            column = pa.array([None if v is None else repr(float(v)) for v in column.to_pylist()], pa.string())
        raw = [b"" if v is None else v.encode() for v in column.cast(pa.string()).to_pylist()]
        if (longest := max(map(len, raw), default=0)) > width:
            raise ValueError(f"{field[0].decode('latin-1')}: a text of {longest} bytes, {width} is the most")
        return np.frombuffer(b"".join(v.ljust(width) for v in raw), np.uint8).reshape(len(raw), width)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = opened(self.folder)
        system.create_dir(folder, recursive=True)
        length, files, held, size = 1 + sum(f[2] for f in self.fields), [], [], 0

        def flush() -> None:
            n = sum(len(h) for h in held)
            head = struct.pack("<BBBBIHH20x", 3, 126, 1, 1, n, 33 + 32 * len(self.fields), length)
            head += b"".join(name.ljust(11, b"\0") + kind + bytes(4) + bytes([width, decimals]) + bytes(14) for name, kind, width, decimals in self.fields)
            name = uuid.uuid4().hex
            files.append((f"{folder}/.part-{name}.dbf", f"{folder}/part-{name}.dbf"))
            with system.open_output_stream(files[-1][0]) as out:
                out.write(head + b"\r")
                for rows in held:
                    out.write(rows.tobytes())
                out.write(b"\x1a")
            held.clear()

        for batch in iterator:
            if batch.num_rows:
                held.append(np.hstack([np.full((batch.num_rows, 1), BLANK, np.uint8), *(self.cells(c, f) for c, f in zip(batch.columns, self.fields))]))
                size += batch.num_rows * length
            if size >= FILE_BYTES:
                flush()
                size = 0
        if held:
            flush()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        system, _ = opened(self.folder)
        for hidden, name in (f for m in messages if m for f in m.files):
            system.move(hidden, name)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = opened(self.folder)
        for hidden, _ in (f for m in messages if m for f in m.files):
            system.delete_file(hidden)
