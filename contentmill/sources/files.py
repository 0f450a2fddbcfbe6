"""File sources and sinks: tables, JSON and CSV intake, documents, reports, versions."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

PageReader = Callable[[bytes], list[str]]


class NotInstalled(RuntimeError):
    """No reader is registered for a kind of document."""


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array file, needed keys only; a malformed file or a row without one of
    the keys raises (a key whose value is null doesn't)."""
    strict = {"mode": "FAILFAST"}
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>", strict)).alias("item"))
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    absent = F.array_except(F.lit(names), F.coalesce(F.json_object_keys("item"), F.array().cast("array<string>")))
    checked = F.when(F.size(absent) > 0, F.raise_error(F.concat(F.lit("missing keys: "), F.array_join(absent, ", "))).cast("string")).otherwise(F.col("item"))
    return items.select(F.from_json(checked, schema, strict).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file with header; fields may hold line feeds and have any size; an empty one is null."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', maxCharsPerColumn=-1, mode="FAILFAST", enforceSchema=False)


def read_files(spark: SparkSession, pattern: str, *, name_like: Sequence[str] = (), exam_level: int | None = None) -> DataFrame:
    """Files of a glob: ``path``, ``name``, ``content``, and ``exam``, the name of the folder so many levels up.

    ``name_like`` keeps names that hold one of these strings, in any case.
    """
    df = spark.read.format("binaryFile").load(pattern).select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")
    if name_like:
        keep = F.lit(False)
        for part in name_like:
            keep = keep | F.contains(F.upper("name"), F.lit(part.upper()))
        df = df.where(keep)
    if exam_level is not None:
        df = df.withColumn("exam", F.element_at(F.split("path", "/"), -1 - exam_level))
    return df


def docx_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """(style, text) of each paragraph of the body of a .docx file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    out = []
    for p in body.findall(f"{_W}p") if body is not None else ():
        style = p.find(f"{_W}pPr/{_W}pStyle")
        key = style.get(f"{_W}val") if style is not None else ""
        text = "".join("\t" if n.tag == f"{_W}tab" else "\n" if n.tag in (f"{_W}br", f"{_W}cr") else n.text or "" for n in p.iter() if n.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))
        out.append((names.get(key, key) or "Normal", text))
    return out


def docx_pages(content: bytes) -> list[str]:
    return ["\n".join(text for _, text in docx_paragraphs(content))]


def no_pdf(content: bytes) -> list[str]:
    raise NotInstalled("give a reader for PDF files")


def read_pages(files: DataFrame, *, pdf: PageReader = no_pdf) -> DataFrame:
    """``path``, ``name``, ``pages`` and ``error`` of document files.

    A .docx file is one page of paragraphs joined by line feeds; other files go to ``pdf``,
    an injected reader, whose null pages are empty. A file that fails has an error.
    """

    def run(frames):
        for f in frames:
            out = []
            for path, name, content in f[["path", "name", "content"]].itertuples(index=False):
                try:
                    pages = docx_pages(content) if name.lower().endswith(".docx") else [p or "" for p in pdf(content)]
                    out.append((path, name, pages, None))
                except Exception as e:  # one bad file doesn't end the batch
                    out.append((path, name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "name", "pages", "error"])

    return files.mapInPandas(run, "path string, name string, pages array<string>, error string")


def document_text(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", F.array_join("pages", "\n", ""))


def read_paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs of .docx files: ``path``, ``idx``, ``style``, ``text`` and ``error``.

    A file that can't be read is one row with its error only.
    """

    def run(frames):
        for f in frames:
            rows = []
            for path, content in f[["path", "content"]].itertuples(index=False):
                try:
                    rows += [(path, i, style, text, None) for i, (style, text) in enumerate(docx_paragraphs(content))]
                except Exception as e:  # one bad file doesn't end the batch
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "idx", "style", "text", "error"]).astype({"idx": "Int64"})

    return files.mapInPandas(run, "path string, idx long, style string, text string, error string")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_summary(grouped: DataFrame, by: str, path: str) -> None:
    """Text lines from ``catalog.grouped_lists``: each group with its count, then its items."""
    lines = F.concat(F.array(F.format_string("%s: %d", by, "n")), F.transform("items", lambda t: F.concat(F.lit("  - "), t)))
    grouped.orderBy(by).select(F.array_join(lines, "\n").alias("value")).write.mode("overwrite").text(path)


class Stale(RuntimeError):
    """A table has changed since it was read."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def _manifests(spark: SparkSession, root: str) -> dict[int, list[str]]:
    """The newest complete manifest and its number: folders of rows, the last line is ``end``."""
    p, fs = _path(spark, root)
    names = [status.getPath().getName() for status in fs.listStatus(p)] if fs.exists(p) else []
    found = {}
    for number in sorted((int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.manifest", n))), reverse=True):
        stream = fs.open(_path(spark, f"{root}/v{number}.manifest")[0])
        try:
            lines = bytes(stream.readAllBytes()).decode().splitlines()
        finally:
            stream.close()
        if lines and lines[-1] == "end":
            found[number] = lines[:-1]
            break
    return found


def version(spark: SparkSession, root: str) -> int:
    """The number of a table's newest complete version; 0 without one."""
    return max(_manifests(spark, root), default=0)


def read_latest(spark: SparkSession, root: str, schema: str) -> DataFrame:
    parts = next(iter(_manifests(spark, root).values()), [])
    return spark.read.schema(schema).parquet(*[f"{root}/{p}" for p in parts]) if parts else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, root: str, number: int, parts: list[str]) -> None:
    """Makes the parts version ``number``. Only one of two writers can create its manifest."""
    p, fs = _path(spark, f"{root}/v{number}.manifest")
    try:
        stream = fs.create(p, False)
    except Exception as e:
        raise Stale(f"{root} has a version {number}") from e
    try:
        stream.write(bytearray("\n".join([*parts, "end"]).encode()))
    finally:
        stream.close()


def replace_table(df: DataFrame, root: str, *, based_on: int | None = None) -> DataFrame:
    """Writes a new version; readers see it only when it is complete, and what is read stays.

    ``based_on`` is the version that ``df`` was computed from (the newest, if not given);
    ``Stale`` if another writer has made a newer one, so that no change is lost.
    """
    spark = df.sparkSession
    at = version(spark, root) if based_on is None else based_on
    part = f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{part}")
    _commit(spark, root, at + 1, [part])
    return spark.read.schema(df.schema).parquet(f"{root}/{part}")


def append_rows(df: DataFrame, root: str, *, based_on: int | None = None) -> DataFrame:
    """Adds rows as a part of their own: the table's other parts stay as they are. Returns the rows."""
    spark = df.sparkSession
    newest = _manifests(spark, root)
    at = max(newest, default=0)
    if based_on is not None and based_on != at:
        raise Stale(f"{root} is at version {at}, not {based_on}")
    part = f"rows-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{part}")
    _commit(spark, root, at + 1, [*newest.get(at, []), part])
    return spark.read.schema(df.schema).parquet(f"{root}/{part}")


def backup(df: DataFrame, path: str) -> DataFrame:
    """Writes rows as they are before a change, and returns the written copy."""
    df.write.mode("error").parquet(path)
    return df.sparkSession.read.parquet(path)


class Staging:
    """Previews that are confirmed once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def stage(self, rows: DataFrame) -> str:
        key = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{key}")
        return key

    def preview(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{key}")

    def confirm(self, key: str, use: Callable[[DataFrame], object]) -> object:
        """Passes the staged rows to ``use``, once: they are claimed by a rename before.

        A second call raises ``KeyError``. If ``use`` fails, the rows are staged again.
        """
        if not re.fullmatch("[0-9a-f]{32}", key):
            raise KeyError(key)
        (staged, fs), (claimed, _) = _path(self.spark, f"{self.root}/{key}"), _path(self.spark, f"{self.root}/claimed-{key}")
        if not fs.exists(staged) or fs.exists(claimed) or not fs.rename(staged, claimed):
            raise KeyError(key)
        try:
            result = use(self.spark.read.parquet(f"{self.root}/claimed-{key}"))
        except BaseException:
            fs.rename(claimed, staged)
            raise
        fs.delete(claimed, True)
        return result
