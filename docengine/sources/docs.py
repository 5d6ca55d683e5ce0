"""Files of documents as a Spark data source: ``spark.read.format("docs")``.

Options: ``form`` (yaml, json, cbor), ``family``, ``mode`` (PERMISSIVE, DROPMALFORMED, FAILFAST).
``read_documents``, ``stream_documents`` and ``write_documents`` work on any store of Spark's own,
through its file sources, and are what large inputs want; the registered source serves a folder
that driver and executors share and can open, in batch and as a stream of new files, and writes documents.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from docengine.operators import tables

SCHEMA = "source string, " + tables.DOCUMENTS + ", json string"


def read_documents(spark: SparkSession, path: str, form: str = "yaml", family: str = "core", mode: str = "PERMISSIVE") -> DataFrame:
    """Documents of all files under a path or glob: one row each, by the source's own splits."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return tables.documents(files.withColumnRenamed("path", "source"), "content", form, family, mode, keep=["source"])


def stream_documents(spark: SparkSession, path: str, form: str = "yaml", family: str = "core", mode: str = "PERMISSIVE") -> DataFrame:
    """The same as a stream of new files, from any store that Spark reads; Spark keeps track of the files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return tables.documents(files.withColumnRenamed("path", "source"), "content", form, family, mode, keep=["source"])


def write_documents(df: DataFrame, column: str, path: str, form: str = "yaml", mode: str = "errorifexists") -> None:
    """Texts to any store that Spark writes: YAML streams by markers, JSON by lines (texts without line feeds)."""
    text = F.col(f"`{column}`")
    if form == "yaml":
        text = F.when(text.startswith("---"), text).otherwise(F.concat(F.lit("---\n"), text))
    df.where(F.col(f"`{column}`").isNotNull()).select(F.regexp_replace(text, r"\n\z", "").alias("value")).write.mode(mode).text(path)


def rows_of(path: str, options: dict) -> Iterator[tuple]:
    from docengine.functions.tree import to_json

    with open(path, "rb") as f:
        data = f.read()
    found = tables.decoded(data, options.get("form", "yaml"), options.get("family", "core"), options.get("mode", "PERMISSIVE").upper())
    for i, status, line, col, message, text, root in found:
        text = text if isinstance(text, str) else None
        yield path, i, status, line, col, message, text, to_json(root) if root is not None else None


class Part(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def files_of(path: str) -> list[str]:
    found = sorted(glob.glob(os.path.join(path, "**"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
    return [f for f in found if os.path.isfile(f) and not os.path.basename(f).startswith(("_", "."))]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [Part(f) for f in files_of(self.options["path"])]

    def read(self, partition):
        yield from rows_of(partition.path, self.options)


class StreamReader(DataSourceStreamReader):
    """New files of a folder, each read by a task of its own. The offset holds the names that are known, so a late file with an early name is read, and once."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self):
        return {"files": []}

    def latestOffset(self):
        return {"files": files_of(self.options["path"])}

    def partitions(self, start, end):
        known = set(start["files"])
        return [Part(f) for f in end["files"] if f not in known]

    def read(self, partition):
        yield from rows_of(partition.path, self.options)

    def commit(self, end):
        pass


class Message(WriterCommitMessage):
    def __init__(self, path: str, count: int):
        self.path, self.count = path, count


class Writer(DataSourceArrowWriter):
    """Writes the first text or binary column: YAML streams by markers, JSON by lines, CBOR as a sequence. Files get their names on commit."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        folder, form = self.options["path"], self.options.get("form", "yaml")
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"_part-{task.partitionId():05d}-{uuid.uuid4().hex}.{form}")
        count = 0
        with open(path, "wb") as f:
            for batch in batches:
                for cell in batch.column(0):
                    value = cell.as_py()
                    if value is None:
                        continue
                    raw = value.encode("utf-8") if isinstance(value, str) else bytes(value)
                    if form == "yaml" and not raw.startswith(b"---"):
                        f.write(b"---\n")
                    f.write(raw)
                    if form != "cbor" and not raw.endswith(b"\n"):
                        f.write(b"\n")
                    count += 1
        return Message(path, count)

    def commit(self, messages):
        folder = self.options["path"]
        before = files_of(folder) if self.overwrite else []
        for m in messages:
            if m is not None:
                os.rename(m.path, os.path.join(folder, os.path.basename(m.path)[1:]))
        # what was there goes only when the new files are in place; their names are new
        for f in before:
            os.remove(f)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class DocsSource(DataSource):
    @classmethod
    def name(cls):
        return "docs"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(dict(self.options))

    def streamReader(self, schema):
        return StreamReader(dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocsSource)
