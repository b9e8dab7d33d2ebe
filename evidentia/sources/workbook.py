"""Workbooks (.xlsx) as a data source.

Reading: every task takes some of a folder's files and streams their sheets. The header is the first row that names all
required columns, so each file says itself which column is where. A file that cannot be read, a sheet without header and a cell
that is not what its column asks for come out as rows with an error; nothing is passed over.

Writing: every task writes its rows as a piece of sheet to a hidden folder beside the target. The commit puts the pieces
together, in order of partition, and moves the workbook into place; an abort removes them. So a reader sees the whole workbook or
none. A sheet holds some million rows by its format: larger results go to tables.
"""

from __future__ import annotations

import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .folders import file_system

#: Fixed values of the file format.
MOST_ROWS, MOST_CELL, MOST_NAME = 1_048_576, 32_767, 31
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"

CELLS = T.StructType([T.StructField("file", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("line", T.LongType()), T.StructField("cells", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])
OWN = {"file", "sheet", "line", "cells", "error"}
SPLIT_BYTES = 64 << 20  # files of a task
HEADER_ROWS = 20  # rows among which the header is looked for
BATCH = 4096


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _plain(text: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)


def _texts(node) -> str:
    """The text of a string node: its own or that of its runs, phonetic readings not."""
    parts = [t.text or "" for child in node for t in ([child] if child.tag == f"{MAIN}t" else child.findall(f"{MAIN}t") if child.tag == f"{MAIN}r" else [])]
    return _plain("".join(parts))


def _xml(book: zipfile.ZipFile, name: str, tag: str) -> Iterator:
    """The elements of one kind in a part, each forgotten after it was seen."""
    with book.open(name) as f:
        root = None
        for event, node in ElementTree.iterparse(f, ("start", "end")):
            if root is None:
                root = node
            if event == "end" and node.tag == MAIN + tag:
                yield node
                for held in root.iter(f"{MAIN}sheetData"):
                    held.clear()
                node.clear()


def sheet_names(book: zipfile.ZipFile) -> dict[str, str]:
    """name -> part, in the workbook's order."""
    with book.open("xl/_rels/workbook.xml.rels") as f:
        target = {r.get("Id"): r.get("Target") for r in ElementTree.parse(f).getroot()}
    place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
    return {s.get("name"): place(target[s.get(LINK)]) for s in _xml(book, "xl/workbook.xml", "sheet")}


def sheet_rows(book: zipfile.ZipFile, part: str) -> Iterator[tuple[int, list[str | None], str]]:
    """(row number from 1, its cells, what was wrong with it)."""
    shared = [_texts(s) for s in _xml(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
    number = 0
    for row in _xml(book, part, "row"):
        number = int(row.get("r") or number + 1)
        cells: list[str | None] = []
        wrong = []
        for c in row.iter(f"{MAIN}c"):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            v, kind = c.findtext(f"{MAIN}v"), c.get("t", "n")
            if kind == "s":
                if v is not None and v.isdigit() and int(v) < len(shared):
                    cells[at] = shared[int(v)]
                else:
                    wrong.append(f"cell {at + 1}: no shared string {v}")
            elif kind == "inlineStr":
                cells[at] = "".join(_texts(i) for i in c.findall(f"{MAIN}is"))
            elif kind == "b":
                cells[at] = "true" if v == "1" else "false"
            elif kind == "e":
                wrong.append(f"cell {at + 1}: {v}")
            else:
                cells[at] = None if v is None else _plain(v)
        yield number, cells, "; ".join(wrong)


def _value(text: str | None, kind: T.DataType):
    """A cell as a column's type; ValueError where it is not one."""
    if text is None or isinstance(kind, T.StringType):
        return text
    text = text.strip()
    if text == "":
        return None
    if isinstance(kind, T.BooleanType):
        if text.lower() not in ("true", "false", "1", "0"):
            raise ValueError(text)
        return text.lower() in ("true", "1")
    if isinstance(kind, (T.IntegerType, T.LongType)):
        n = int(text) if re.fullmatch("[+-]?[0-9]+", text) else float(text)
        if n != int(n) or not -(1 << 63) <= n < 1 << 63 or (isinstance(kind, T.IntegerType) and not -(1 << 31) <= n < 1 << 31):
            raise ValueError(text)
        return int(n)
    return float(text.replace(",", "."))


@dataclass
class Files(InputPartition):
    paths: list[str]


class SheetReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        kinds = (T.StringType, T.BooleanType, T.IntegerType, T.LongType, T.DoubleType)
        if bad := [f.name for f in schema if f.name != "cells" and not isinstance(f.dataType, kinds)]:
            raise ValueError(f"columns of a workbook are texts, numbers or truth values: {bad}")
        self.options, self.schema = dict(options), schema
        self.required = [c.strip() for c in self.options.get("required", "").split(",") if c.strip()]

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = file_system(self.options["path"])
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda p: any(x.startswith((".", "_", "~$")) for x in p.path[len(path) :].strip("/").split("/"))
        files = sorted((f for f in found if f.is_file and (f is info or f.path.lower().endswith(".xlsx") and not hidden(f))), key=lambda f: f.path)
        out: list[Files] = []
        held = 0
        for f in files:
            if not out or held + f.size > int(self.options.get("splitbytes", SPLIT_BYTES)):
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out or [Files([])]

    def _file(self, store, path: str) -> Iterator[dict]:
        begun = False
        try:
            with store.open_input_file(path) as f, zipfile.ZipFile(f) as book:
                names = sheet_names(book)
                wanted = self.options.get("sheet")
                for name in list(names) if wanted == "*" else [wanted] if wanted in names else list(names)[:1]:
                    for row in self._sheet(book, names[name]):
                        begun = True
                        yield {"file": path, "sheet": name, **row}
        except (OSError, zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, NotImplementedError, RuntimeError) as e:
            yield {"file": path, "error": f"{'rest of ' if begun else ''}file not read: {type(e).__name__}: {e}"}

    def _sheet(self, book: zipfile.ZipFile, part: str) -> Iterator[dict]:
        header: list[str] | None = None
        top = 0
        for number, cells, wrong in sheet_rows(book, part):
            if header is None:
                names = [(c or "").strip() for c in cells]
                if any(names) and set(self.required) <= set(names):
                    header, top = names, number
                    continue
                if number < HEADER_ROWS and (self.required or not any(names)):
                    continue
                break
            values = {h: c for h, c in zip(header, cells, strict=False) if h}
            row, errors = {"line": number - top, "cells": values}, [wrong] if wrong else []
            for f in self.schema:
                if f.name not in OWN:
                    try:
                        row[f.name] = _value(values.get(f.name), f.dataType)
                    except (ValueError, OverflowError):
                        errors.append(f"{f.name}: not a {f.dataType.simpleString()}: {values[f.name]}")
            yield row | {"error": "; ".join(errors) or None}
        if header is None:
            yield {"error": f"no row with the columns {', '.join(self.required)}" if self.required else "no header"}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        store, _ = file_system(self.options["path"])
        schema, rows = to_arrow_schema(self.schema), []

        def batch() -> pa.RecordBatch:
            columns = [[r.get(f.name) for r in rows] for f in self.schema]
            return pa.RecordBatch.from_arrays([pa.array([list(v.items()) if v is not None else None for v in c] if f.name == "cells" else c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for path in partition.paths:
            for row in self._file(store, path):
                rows.append(row)
                if len(rows) >= BATCH:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


def _safe(text: str) -> str:
    """Text that XML can hold: what it cannot, and what would be read as such an escape, as _xHHHH_."""
    return escape(re.sub("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)", lambda m: f"_x{ord(m[0]):04X}_", text))


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and abs(value) != float("inf") and value == value:
        return f"<c><v>{value!r}</v></c>"
    text = str(value)
    if len(text) > MOST_CELL:
        raise ValueError(f"a cell of {len(text)} characters; a workbook holds {MOST_CELL}")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{_safe(text)}</t></is></c>'


def _row(values) -> bytes:
    return f"<row>{''.join(map(_cell, values))}</row>".encode()


@dataclass
class Pieces(WriterCommitMessage):
    partition: int
    rows: dict[int, int]  # of each sheet
    paths: dict[int, str]


class SheetWriter(DataSourceWriter):
    """Rows of (sheet, cells) for several sheets, or of any columns for one."""

    def __init__(self, options: dict[str, str], schema: T.StructType, overwrite: bool):
        self.target, self.overwrite = options["path"], overwrite
        self.several = "sheets" in options
        self.sheets = json.loads(options["sheets"]) if self.several else [[options.get("sheet", "Sheet1"), [f.name for f in schema]]]
        names = [n.lower() for n, _ in self.sheets]
        if len(set(names)) < len(names) or any(not n or len(n) > MOST_NAME or re.search(r"[\[\]:*?/\\]", n) for n in names):
            raise ValueError(f"names of sheets are up to {MOST_NAME} characters, each another, without []:*?/\\: {names}")
        store, path = file_system(self.target)
        folder, _, name = path.rstrip("/").rpartition("/")
        if not overwrite and store.get_file_info(path).type.name != "NotFound":
            raise FileExistsError(path)
        self.path, self.hidden = f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}"
        store.create_dir(self.hidden, recursive=True)

    def write(self, iterator: Iterator[Row]) -> Pieces:
        store, _ = file_system(self.target)
        made = Pieces(TaskContext.get().partitionId(), {}, {})
        attempt, out = uuid.uuid4().hex, {}
        try:
            for row in iterator:
                at, values = (row[0], [json.loads(c) if c is not None else None for c in row[1]]) if self.several else (0, list(row))
                if at not in out:
                    made.paths[at], made.rows[at] = f"{self.hidden}/{attempt}-{at}", 0
                    out[at] = store.open_output_stream(made.paths[at])
                out[at].write(_row(values))
                made.rows[at] += 1
        finally:
            for f in out.values():
                f.close()
        return made

    def commit(self, messages: list[Pieces | None]) -> None:
        pieces = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        store, _ = file_system(self.target)
        for at, (name, _) in enumerate(self.sheets):
            if (n := sum(p.rows.get(at, 0) for p in pieces)) >= MOST_ROWS:
                raise ValueError(f"{n} rows for sheet {name}; a sheet holds {MOST_ROWS - 1} and its header")
        book = f"{self.hidden}/book"
        with store.open_output_stream(book) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for part, text in self._frame().items():
                z.writestr(part, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
            for at, (_, headers) in enumerate(self.sheets):
                with z.open(f"xl/worksheets/sheet{at + 1}.xml", "w", force_zip64=True) as sheet:
                    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
                    sheet.write(f'<worksheet xmlns="{MAIN[1:-1]}">{view}<sheetData>'.encode() + _row(headers))
                    for p in pieces:
                        if at in p.paths:
                            with store.open_input_stream(p.paths[at]) as piece:
                                while data := piece.read(1 << 20):
                                    sheet.write(data)
                    sheet.write(b"</sheetData></worksheet>")
        if self.overwrite and store.get_file_info(self.path).type.name != "NotFound":
            store.delete_file(self.path)
        store.move(book, self.path)
        store.delete_dir(self.hidden)

    def abort(self, messages: list[Pieces | None]) -> None:
        store, _ = file_system(self.target)
        if store.get_file_info(self.hidden).type.name != "NotFound":
            store.delete_dir(self.hidden)

    def _frame(self) -> dict[str, str]:
        """The parts that name the sheets."""
        kind, many = "application/vnd.openxmlformats-officedocument.spreadsheetml", range(1, len(self.sheets) + 1)
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in many)
        names = "".join(f'<sheet name={quoteattr(self.sheets[k - 1][0])} sheetId="{k}" r:id="rId{k}"/>' for k in many)
        links = "".join(f'<Relationship Id="rId{k}" Type="{LINK[1:-3]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in many)
        return {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{over}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINK[1:-3]}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-3]}"><sheets>{names}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>',
        }


class Workbook(DataSource):
    """Format "workbook". Reading: `sheet` (a name, * for all, else the first), `required` (names that make a header), `splitBytes`; the
    schema is CELLS, or columns of a given schema by their header. Writing: one file; `sheet` names it."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        return CELLS

    def reader(self, schema: T.StructType) -> SheetReader:
        return SheetReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(self.options, schema, overwrite)


def read_workbooks(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """(S18) The rows of all workbooks of a folder, or of one."""
    spark.dataSource.register(Workbook)
    reader = spark.read.format("workbook").options(**options)
    return (reader if schema is None else reader.schema(schema)).load(path)


def write_workbook(frames: dict[str, DataFrame], path: str) -> None:
    """(K3, K6, K7) One workbook with a sheet per frame, rows in the frames' order; an existing one is replaced. Numbers and truth
    values stay such, other values are their text, lists and maps JSON."""
    out = None
    for at, df in enumerate(frames.values()):
        df.sparkSession.dataSource.register(Workbook)
        plain = (T.NumericType, T.BooleanType, T.StringType)
        cell = lambda f: F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`").cast("string")
        # A cell travels as a JSON value, which tells numbers and texts apart.
        as_json = lambda c: F.when(c.isNotNull(), F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1))
        one = df.select(F.lit(at).alias("sheet"), F.array(*[as_json(cell(f)) for f in df.schema]).alias("cells"))
        out = one if out is None else out.union(one)
    sheets = json.dumps([[name, df.columns] for name, df in frames.items()])
    out.write.format("workbook").option("sheets", sheets).mode("overwrite").save(path)
