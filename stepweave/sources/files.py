"""Text in unknown encodings, workbooks and SQLite databases."""

from __future__ import annotations

import io
import re
import sqlite3
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

# Encodings in the order in which they are tried.
ENCODINGS = ["utf-8", "utf-8-sig", "latin-1", "windows-1252", "gbk", "utf-16", "cp1251"]


def decode(content: bytes | None) -> str | None:
    if content is None:
        return None
    for encoding in ENCODINGS:
        try:
            return bytes(content).decode(encoding)
        except (UnicodeDecodeError, UnicodeError):
            continue
    return bytes(content).decode("utf-8", errors="replace")


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(decode)


def text_files(spark: SparkSession, root: str, kinds: list[str], recursive: bool = True) -> DataFrame:
    """(path, text) of files with one of the endings, in either case."""
    both = sorted({e for k in kinds for e in (k.lower(), k.upper())})
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.{" + ",".join(both) + "}").load(root)
    return files.select("path", decoded("content").alias("text"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Header-keyed rows, all strings: no pass to guess types."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def workbook_cells(content: bytes) -> list[tuple]:
    """(sheet, row, col, kind, value) of an .xlsx workbook; shared and inline strings are resolved, booleans and errors kept."""
    book = zipfile.ZipFile(io.BytesIO(content))
    read = lambda name: ET.fromstring(book.read(name))
    names = set(book.namelist())
    shared = ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
    found = []
    for sheet in read("xl/workbook.xml").iter(f"{_MAIN}sheet"):
        target = targets[sheet.get(f"{_REL}id")].lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        for cell in read(target).iter(f"{_MAIN}c"):
            kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
            text = value.text if value is not None else None
            if kind == "s" and text is not None:
                text = shared[int(text)]
            elif kind == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            if text is None:
                continue
            reference = cell.get("r")
            found.append((sheet.get("name"), int(re.search(r"\d+", reference)[0]) - 1, _column(reference), kind, text))
    return found


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, kind, value), a workbook a task at most."""

    def cells(batches):
        for pdf in batches:
            rows = [(p, *cell) for p, content in zip(pdf["path"], pdf["content"], strict=True) for cell in workbook_cells(content)]
            yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "kind", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cells, "path string, sheet string, row int, col int, kind string, value string")


def sheet_by_address(cells: DataFrame, address: str | int, names: list[str]) -> DataFrame:
    """A sheet by place (3, RI3, EI3) or name (RNTotals, ENTotals); R is the result's book, E the expected one's: choose cells so."""
    text = str(address)
    name = text[2:] if text[:2] in ("RN", "EN") else names[int(text[2:] if text[:2] in ("RI", "EI") else text)]
    return cells.where(F.col("sheet") == name)


class SqliteSource(DataSource):
    """spark.read.format("stepweave_sqlite").option("path", file).option("query", sql): a query of a SQLite file.

    The file has to be where executors see it. `key` and `parts` split the query by ranges of a whole-number column."""

    @classmethod
    def name(cls) -> str:
        return "stepweave_sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            row = db.execute(self.options["query"])
            first = row.fetchone() or ()
            names = [d[0] for d in row.description]
        kinds = {int: "bigint", float: "double", bytes: "binary"}
        return ", ".join(f"`{n}` {kinds.get(type(v), 'string')}" for n, v in zip(names, first or [None] * len(names), strict=True))

    def reader(self, schema):
        return _SqliteReader(self.options, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, options, schema) -> None:
        self.options, self.types = dict(options), [f.dataType.typeName() for f in schema.fields]

    def partitions(self):
        return [InputPartition(i) for i in range(int(self.options.get("parts", 1)))]

    def read(self, partition):
        query, parts = self.options["query"], int(self.options.get("parts", 1))
        if parts > 1:
            query = f"select * from ({query}) where abs({self.options['key']}) % {parts} = {int(partition.value)}"
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            for row in db.execute(query):
                yield tuple(str(v) if v is not None and t == "string" else v for v, t in zip(row, self.types, strict=True))


def sqlite_query(spark: SparkSession, path: str, query: str, **options) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("stepweave_sqlite").option("path", path).option("query", query)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


# Tables of the run log.
LOG_TABLES = {
    "chat_completions": "id bigint, invocation_id string, client_id bigint, wrapper_id bigint, session_id string, source_name string, request string, response string, is_cached int, cost double, start_time string, end_time string",
    "agents": "id bigint, agent_id bigint, wrapper_id bigint, session_id string, name string, class string, init_args string, timestamp string",
    "oai_wrappers": "id bigint, wrapper_id bigint, session_id string, init_args string, timestamp string",
    "oai_clients": "id bigint, client_id bigint, wrapper_id bigint, session_id string, class string, init_args string, timestamp string",
    "version": "id bigint, version_number bigint",
    "events": "event_name string, source_id bigint, source_name string, agent_module string, agent_class string, json_state string, timestamp string",
    "function_calls": "source_id bigint, source_name string, function_name string, args string, returns string, timestamp string",
}


def append_log(df: DataFrame, root: str, table: str) -> None:
    """Rows of one log table, in its columns and types, appended as Parquet by session."""
    kinds = [part.strip().split(" ") for part in LOG_TABLES[table].split(",")]
    df.select(*[F.col(n).cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in kinds]).write.mode("append").parquet(f"{root}/{table}")


def history_rows(visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(urls, visits) tables from (url, title, visited): each URL once under a generated key that its visits refer to."""
    keyed = visits.withColumn("url_id", F.xxhash64("url"))
    urls = keyed.groupBy("url_id", "url").agg(F.max_by("title", "visited").alias("title"), F.max("visited").alias("last_visit_time"), F.count(F.lit(1)).alias("visit_count"))
    return urls, keyed.select(F.xxhash64("url", "visited").alias("visit_id"), "url_id", "visited")


def write_history(visits: DataFrame, path: str) -> None:
    """The same as a SQLite file of one browser profile: bounded, so one writer on the driver streams the rows."""
    urls, seen = history_rows(visits)
    with sqlite3.connect(path) as db:
        db.execute("create table if not exists urls (id integer primary key, url text, title text, visit_count integer, last_visit_time integer)")
        db.execute("create table if not exists visits (id integer primary key, url integer, visit_time integer)")
        db.executemany("insert or replace into urls values (?, ?, ?, ?, ?)", ((r.url_id, r.url, r.title, r.visit_count, r.last_visit_time) for r in urls.toLocalIterator()))
        db.executemany("insert or replace into visits values (?, ?, ?)", ((r.visit_id, r.url_id, r.visited) for r in seen.toLocalIterator()))
