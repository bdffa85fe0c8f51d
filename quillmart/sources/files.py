"""Tables in files, in and out: delimited text, spreadsheets, JSON; and one reader that chooses by the file's name."""

from __future__ import annotations

import csv
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Delimiters in the order they are tried.
DELIMITERS = (",", ";", "\t", "|")
MARK = "﻿"


def delimiter(header: str) -> str:
    """The first delimiter that splits the header outside quotes; then whatever else stands between its words; else the comma."""
    plain = re.sub(r'"[^"]*"', "", header.lstrip(MARK))
    other = re.search(r"\w\s*([^\w\s\"'.])\s*\w", plain)
    return next((d for d in DELIMITERS if d in plain), other[1] if other else DELIMITERS[0])


def read_delimited(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Every column as text; the delimiter is taken from the first line, a byte order mark goes. An empty file has no columns and no rows.

    Fields with line breaks need multi_line, which makes each file one task; without it large files are split.
    """
    head = spark.read.text(path).first()
    if head is None:
        return spark.createDataFrame([], "")
    df = spark.read.csv(path, header=True, sep=delimiter(head["value"]), encoding="UTF-8", multiLine=multi_line, escape='"')
    return df.toDF(*[c.lstrip(MARK) for c in df.columns])


def write_delimited(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV part files with a header each, on request behind a byte order mark; values that are no text are written as Spark casts them."""
    names = [MARK * (mark and i == 0) + c for i, c in enumerate(df.columns)]
    df.select([F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(df.columns, names, strict=True)]).write.csv(path, header=True, escape='"', encoding="UTF-8")


def write_one_delimited(df: DataFrame, path: str, mark: bool = True) -> None:
    """One CSV file behind a byte order mark, with one header: tasks write parts beside it, then these are joined in the order of partitions.

    A failing task or join leaves nothing at the path; a file that is there already raises FileExistsError and stays. Bytes go from part
    to file in the driver's store client, none are held.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop
    target, parts, whole = (hadoop.fs.Path(p) for p in (path, *(f"{path}.{kind}-{uuid.uuid4().hex}" for kind in ("parts", "whole"))))
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(target):
        raise FileExistsError(path)
    header = io.StringIO()
    csv.writer(header, lineterminator="\n").writerow(df.columns)
    try:
        df.select([F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)]).write.csv(parts.toString(), escape='"', encoding="UTF-8")
        out = store.create(whole)
        try:
            out.write(bytearray((MARK * mark + header.getvalue()).encode()))
            for part in sorted(f.getPath().getName() for f in store.listStatus(parts)):
                if part.startswith("part-"):
                    from_ = store.open(hadoop.fs.Path(parts, part))
                    hadoop.io.IOUtils.copyBytes(from_, out, 1 << 16, False)
                    from_.close()
        finally:
            out.close()
        if not store.rename(whole, target):
            raise FileExistsError(path)
    finally:
        for left in (parts, whole):
            store.delete(left, True)


def export_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each table as one CSV file with a mark, named after it, in a folder; returns the paths by file name."""
    paths = {f"{name}.csv": f"{folder.rstrip('/')}/{name}.csv" for name in tables}
    for df, path in zip(tables.values(), paths.values(), strict=True):
        write_one_delimited(df, path)
    return paths


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept."""
    df.write.json(path, ignoreNullFields=False)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(data: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of a workbook, cells as text, null where there are none."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.parse(book.open("xl/sharedStrings.xml")).getroot()] if "xl/sharedStrings.xml" in names else []
        first = next(ElementTree.parse(book.open("xl/workbook.xml")).getroot().iter(f"{_MAIN}sheet"))
        links = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
        target = links[first.get(_LINK)]
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag == f"{_MAIN}row":
                    cells: dict[int, str | None] = {}
                    for i, cell in enumerate(row.iter(f"{_MAIN}c")):
                        at = i if not (ref := re.match("[A-Z]+", cell.get("r") or "")) else sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(ref[0]))) - 1
                        kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                        text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")) if kind == "inlineStr" else None if value is None else value.text
                        cells[at] = shared[int(text)] if kind == "s" and text is not None else text
                    yield [cells.get(i) for i in range(max(cells, default=-1) + 1)]
                    row.clear()


def read_spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of an .xlsx workbook (or of all that a glob names): header in the first row, every column as text.

    Workbooks are read by Spark as binary files, so any store will do, and each is parsed in a task of its own; the driver only
    reads the header of the first. Empty rows are left out.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    heads = files.limit(1).rdd.map(lambda r: next(sheet_rows(bytes(r.content)), [])).collect()
    names = [h if h is not None else f"column{i + 1}" for i, h in enumerate(heads[0] if heads else [])]
    width, schema = len(names), StructType([StructField(n, StringType()) for n in names])
    if not width:
        return spark.createDataFrame([], "")

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                found = [r for r in list(sheet_rows(content))[1:] if any(x is not None for x in r)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in found], pa.string()) for i in range(width)], names)

    return files.mapInArrow(rows, schema)


class _Sheets(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            rows = sheet_rows(f.read())
            width = len(next(rows, []))
            yield from (tuple((r + [None] * width)[:width]) for r in rows if any(x is not None for x in r))


class SpreadsheetSource(DataSource):
    """format("spreadsheet") for a workbook on a path that every executor sees: spark.dataSource.register(SpreadsheetSource)."""

    @classmethod
    def name(cls) -> str:
        return "spreadsheet"

    def schema(self) -> StructType:
        with open(self.options["path"], "rb") as f:
            return StructType([StructField(h or f"column{i + 1}", StringType()) for i, h in enumerate(next(sheet_rows(f.read()), []))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Sheets(self.options)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file's name: .xlsx, .parquet, .json, else delimited text. Columns of text files and workbooks are texts."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "xlsx":
        return read_spreadsheet(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.json(path) if kind in ("json", "jsonl") else read_delimited(spark, path)
