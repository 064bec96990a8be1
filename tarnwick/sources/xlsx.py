"""XLSX workbooks as a Spark data source, read and written, over the standard library.

Reading: a workbook is one partition, its sheet is parsed as a stream of rows, and columns
are matched by name, so workbooks may differ in their columns and in their order. Option
``sheet`` names the sheet, else the first one is read. Option ``mode=headers`` gives the
path and the header of each workbook instead of its rows. Without a schema columns are
text, named by the first workbook; ``read`` takes the names of all workbooks and infers types.

Writing: each task writes workbooks of at most MOST_ROWS rows under names of its attempt,
and the commit moves those of successful attempts to their places, so a lost executor
leaves no half workbook behind. A table without rows writes no workbook.

Cells: null is a missing cell, and a missing cell is null. Characters that XML cannot hold
are written as ``_xHHHH_``, as the format has it. A folder's files whose names begin with
``_`` or ``.`` are not read. A sheet without rows has no columns; repeated names in a header
get ``.1``, ``.2``, empty ones ``Unnamed: n``.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_REL = f"{{{_RELATION}}}id"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Rows of a batch handed to Spark, and of a written workbook besides its header (a sheet holds 1,048,576).
BATCH, MOST_ROWS = 10_000, 1_000_000
_CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")
_UNSAFE = re.compile(r"[\x00-\x08\x0B-\x1F\uFFFE\uFFFF]|_(?=x[0-9A-Fa-f]{4}_)")


def _column(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _letters(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _plain(text: str) -> str:
    return _CODED.sub(lambda m: chr(int(m[1], 16)), text)


def rows(file: BinaryIO, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Cells of a sheet by name, else of the first, as text; the first row holds the names."""
    with zipfile.ZipFile(file) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_plain("".join(t.text or "" for t in item.iter(f"{_MAIN}t"))) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACKAGE}Relationship")}
        sheets = [(s.get("name"), targets[s.get(_REL)]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]
        wanted = [t for n, t in sheets if n == sheet] if sheet else [sheets[0][1]]
        if not wanted:
            raise ValueError(f"no sheet named {sheet!r}")
        target = wanted[0].lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as f:
            top = None
            for event, node in ElementTree.iterparse(f, ("start", "end")):
                if node.tag == f"{_MAIN}sheetData":
                    top = node
                elif event == "end" and node.tag == f"{_MAIN}row":
                    yield _cells(node, shared)
                    top.clear()  # also drops the row itself, so memory does not grow with the sheet


def _cells(row: ElementTree.Element, shared: list[str]) -> list[str | None]:
    out: list[str | None] = []
    for i, cell in enumerate(row.iter(f"{_MAIN}c")):
        at = _column(cell.get("r")) if cell.get("r") else i
        out += [None] * (at - len(out))
        kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            text = _plain("".join(t.text or "" for t in cell.iter(f"{_MAIN}t")))
        elif value is None:
            text = None
        elif kind == "s":
            text = shared[int(value.text)]
        elif kind == "b":
            text = "true" if value.text == "1" else "false"
        else:
            text = value.text
        out.append(text)
    return out


def header(cells: list[str | None]) -> list[str]:
    """Names of columns: empty cells are numbered, and so are repeats."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        name = given = cell if cell else f"Unnamed: {i}"
        again = 0
        while name in out:
            again += 1
            name = f"{given}.{again}"
        out.append(name)
    return out


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def files(path: str) -> list[str]:
    """A file, the files of a folder, or those whose names match a pattern in the last part of path; in order of their names."""
    from pyarrow import fs

    system, found = _place(path)
    info = system.get_file_info(found)
    if info.type == fs.FileType.File:
        return [path]
    folder, pattern = (path, "*") if info.type == fs.FileType.Directory else path.rsplit("/", 1)
    held = system.get_file_info(fs.FileSelector(_place(folder)[1]))
    names = sorted(f.base_name for f in held if f.is_file and f.base_name[0] not in "._" and fnmatch.fnmatchcase(f.base_name, pattern))
    if not names and folder != path:
        raise FileNotFoundError(path)
    return [f"{folder.rstrip('/')}/{name}" for name in names]


def opened(path: str):
    system, found = _place(path)
    return system.open_input_file(found)


@dataclass
class Book(InputPartition):
    path: str


class Workbooks(DataSource):
    """``spark.read.format("xlsx")`` and ``df.write.format("xlsx")``, after ``register``."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self):
        if self.options.get("mode") == "headers":
            return "path string, header array<string>"
        held = files(self.options["path"])
        if not held:
            return T.StructType()
        with opened(held[0]) as f:  # one row of one workbook
            return T.StructType([T.StructField(name, T.StringType()) for name in header(next(rows(f, self.options.get("sheet")), []))])

    def reader(self, schema):
        return _Reader(self.options, schema)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options.get("sheet") or "Sheet1", schema, overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.sheet, self.only, self.wanted = options["path"], options.get("sheet"), options.get("mode") == "headers", schema

    def partitions(self):
        return [Book(path) for path in files(self.path)]

    def read(self, book):
        if book is None:  # a folder without workbooks
            return
        with opened(book.path) as f:
            cells = rows(f, self.sheet)
            names = header(next(cells, []))
            if self.only:
                yield book.path, names
                return
            places, held = [names.index(c) if c in names else None for c in self.wanted.names], []
            for row in cells:
                held.append(row)
                if len(held) == BATCH:
                    yield self._batch(held, places)
                    held = []
            if held:
                yield self._batch(held, places)

    def _batch(self, held, places):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.wanted)
        texts = [pa.array([row[i] if i is not None and i < len(row) else None for row in held], pa.string()) for i in places]
        return pa.RecordBatch.from_arrays([_typed(t, f.type) for t, f in zip(texts, schema)], schema=schema)


def _typed(texts, kind):
    """Texts as kind; whole numbers may be written as 1.0 or 1E3."""
    import pyarrow as pa

    if pa.types.is_integer(kind):
        try:
            return texts.cast(kind)
        except pa.ArrowInvalid:
            return texts.cast(pa.float64()).cast(kind)
    return texts.cast(kind)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path, sheet, schema, overwrite):
        self.path, self.sheet, self.names, self.overwrite, self.run = path, sheet, schema.names, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        system, folder = _place(self.path)
        system.create_dir(f"{folder}/_{self.run}", recursive=True)
        done, attempt = [], uuid.uuid4().hex
        row = next(iterator, None)
        while row is not None:
            name, n = f"part-{attempt}-{len(done):05d}.xlsx", 0
            with system.open_output_stream(f"{folder}/_{self.run}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
                for part, text in _frame(self.sheet):
                    book.writestr(part, text)
                with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
                    f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                    f.write(_row(1, self.names))
                    while row is not None and n < MOST_ROWS:
                        n += 1
                        f.write(_row(n + 1, row))
                        row = next(iterator, None)
                    f.write(b"</sheetData></worksheet>")
            done.append(name)
        return Written(done)

    def commit(self, messages):
        from pyarrow import fs

        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.is_file] if self.overwrite else []
        for message in messages:
            for name in message.names if message else ():
                system.move(f"{folder}/_{self.run}/{name}", f"{folder}/{name}")
        for path in old:
            system.delete_file(path)
        self._clear(system, folder)

    def abort(self, messages):
        self._clear(*_place(self.path))

    def _clear(self, system, folder):
        from pyarrow import fs

        if system.get_file_info(f"{folder}/_{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_{self.run}")


def _frame(sheet: str) -> list[tuple[str, str]]:
    """The parts of a workbook of one sheet besides its rows."""
    types, packages = "http://schemas.openxmlformats.org/package/2006/content-types", _PACKAGE[1:-1]
    kind, head = "application/vnd.openxmlformats-officedocument.spreadsheetml", '<?xml version="1.0" encoding="UTF-8"?>'
    name = escape(sheet, {'"': "&quot;"})
    return [
        ("[Content_Types].xml", f'{head}<Types xmlns="{types}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>'),
        ("_rels/.rels", f'{head}<Relationships xmlns="{packages}"><Relationship Id="r1" Type="{_RELATION}/officeDocument" Target="xl/workbook.xml"/></Relationships>'),
        ("xl/workbook.xml", f'{head}<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_RELATION}"><sheets><sheet name="{name}" sheetId="1" r:id="r1"/></sheets></workbook>'),
        ("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{packages}"><Relationship Id="r1" Type="{_RELATION}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'),
    ]


def _row(n: int, values) -> bytes:
    return f'<row r="{n}">{"".join(_cell(f"{_letters(i)}{n}", v) for i, v in enumerate(values) if v is not None)}</row>'.encode()


def _cell(ref: str, value) -> str:
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    text = escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", str(value)))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Workbooks)


def read(spark: SparkSession, path: str, sheet: str | None = None, schema: str | None = None) -> DataFrame:
    """The sheet of each workbook under path.

    Without a schema the columns are those of all headers, in the order in which the
    first workbook with them has them, and types are inferred over all rows. Headers are read by tasks; the
    driver gets the different names. A workbook must be unpacked as a whole, so it is one task's work.
    """
    register(spark)
    source = spark.read.format("xlsx").options(**({"sheet": sheet} if sheet else {}))
    if schema:
        return source.schema(schema).load(path)
    heads = spark.read.format("xlsx").options(mode="headers", **({"sheet": sheet} if sheet else {})).load(path)
    found = heads.select("path", F.posexplode("header").alias("pos", "name")).groupBy("name").agg(F.min(F.struct("path", "pos")).alias("first"))
    names = [r["name"] for r in sorted(found.collect(), key=lambda r: r["first"])]  # as many as there are columns
    if not names:
        return spark.createDataFrame([], "_ string").drop("_")
    plain = [f"c{i}" for i in range(len(names))]
    text = source.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).load(path).toDF(*plain)
    kinds = text.agg(*(_kind(c).alias(c) for c in plain)).first()
    return text.select(*(F.col(c).cast(kinds[c]).alias(name) for c, name in zip(plain, names)))


def _kind(name: str):
    value = F.col(name)
    bad = lambda sql_type: F.count(F.when(value.isNotNull() & value.try_cast(sql_type).isNull(), 1))
    whole = F.count(F.when(value.isNotNull() & ~value.rlike(r"^[+-]?\d{1,18}$"), 1))
    return F.when(F.count(value) == 0, "string").when(whole == 0, "bigint").when(bad("double") == 0, "double").when(F.count(F.when(value.isNotNull() & ~value.isin("true", "false"), 1)) == 0, "boolean").otherwise("string")
