"""Data sources in Spark's own reader and writer: `clusters`, a line of ids for each cluster, and `records`, a folder of CSV files
each in its own encoding. Both read a partition for each file; the writer's files appear when all tasks are done.

register(spark) makes them known; then spark.read.format("clusters").load(path), df.write.format("clusters").save(path).
Paths are those that pyarrow opens (local, file:, hdfs:, s3:, gs:)."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from kindred.sources.records import MAC_ROMAN, UTF_8


@dataclass
class File(InputPartition):
    """A file that one task reads."""

    path: str


def _files(uri: str) -> tuple[pafs.FileSystem, list[str]]:
    """The files at a path, or in it by name; hidden ones and those that begin with _ are left out."""
    fs, path = pafs.FileSystem.from_uri(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.File:
        return fs, [path]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return fs, sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


def _lines(uri: str, path: str) -> tuple[str, Iterator[str]]:
    """(encoding, lines) of a file: UTF-8 if all of it is, else MacRoman. The file is read twice, never held whole."""
    fs, _ = pafs.FileSystem.from_uri(uri)

    def lines(encoding: str) -> Iterator[str]:
        with fs.open_input_stream(path) as stream, io.TextIOWrapper(stream, encoding=encoding, newline="") as text:
            yield from text

    try:
        for _ in lines("utf-8"):
            pass
        return UTF_8, lines("utf-8-sig")
    except UnicodeDecodeError:
        return MAC_ROMAN, lines("mac_roman")


class _FileReader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType):
        self.uri, self.schema = uri, schema

    def partitions(self) -> list[File]:
        return [File(p) for p in _files(self.uri)[1]]


class ClustersReader(_FileReader):
    """(file, line, rid): the ids of each line."""

    def read(self, partition: File) -> Iterator[tuple]:
        name = partition.path.rsplit("/", 1)[-1]
        _, lines = _lines(self.uri, partition.path)
        for n, line in enumerate(lines):
            for word in line.split():
                yield name, n, int(word)


@dataclass
class Written(WriterCommitMessage):
    """The unfinished file of a task."""

    path: str


class ClustersWriter(DataSourceWriter):
    """A line of ids, in order, for each row (..., ids array): files are named when all tasks are done, or deleted."""

    def __init__(self, uri: str, schema: StructType, overwrite: bool):
        self.uri, self.overwrite = uri, overwrite
        arrays = [i for i, f in enumerate(schema.fields) if f.dataType.typeName() == "array"]
        if len(arrays) != 1:
            raise ValueError("a row must have one array column, the ids of a cluster")
        self.at = arrays[0]

    def write(self, iterator: Iterator) -> Written:
        fs, folder = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(folder)
        path = f"{folder}/_part-{uuid.uuid4().hex}"
        with fs.open_output_stream(path) as out:
            for row in iterator:
                out.write((" ".join(str(i) for i in sorted(row[self.at])) + "\n").encode())
        return Written(path)

    def commit(self, messages: list) -> None:
        fs, folder = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(folder)
        old = _files(self.uri)[1]
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.uri} holds files already")
        for n, m in enumerate(x for x in messages if x is not None):
            fs.move(m.path, f"{folder}/part-{n:05d}-{m.path.rsplit('-', 1)[-1]}.txt")
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list) -> None:
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        for m in messages:
            if m is not None and fs.get_file_info(m.path).type == pafs.FileType.File:
                fs.delete_file(m.path)


class Clusters(DataSource):
    """Format `clusters`."""

    @classmethod
    def name(cls) -> str:
        return "clusters"

    def schema(self) -> str:
        return "file string, line long, rid long"

    def reader(self, schema: StructType) -> ClustersReader:
        return ClustersReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> ClustersWriter:
        return ClustersWriter(self.options["path"], schema, overwrite)


class RecordsReader(_FileReader):
    """The columns of each file by its header, as text, with the file's name and encoding; a column that a file lacks is null."""

    def read(self, partition: File) -> Iterator[tuple]:
        encoding, lines = _lines(self.uri, partition.path)
        rows = csv.reader(lines)
        header = next(rows, [])
        name = partition.path.rsplit("/", 1)[-1]
        place = [header.index(f.name) if f.name in header else -1 for f in self.schema.fields[:-2]]
        for row in rows:
            yield *[row[i] if 0 <= i < len(row) and row[i] != "" else None for i in place], name, encoding


class Records(DataSource):
    """Format `records`: the first file's header names the columns, all of them text."""

    @classmethod
    def name(cls) -> str:
        return "records"

    def schema(self) -> str:
        fs, files = _files(self.options["path"])
        header = next(csv.reader(_lines(self.options["path"], files[0])[1]), []) if files else []
        return ", ".join([*[f"`{c}` string" for c in header], "_file string", "_encoding string"])

    def reader(self, schema: StructType) -> RecordsReader:
        return RecordsReader(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (Clusters, Records):
        spark.dataSource.register(source)


def save_clusters(members: DataFrame, path: str) -> None:
    """members(rid, cluster) in the format `clusters`, in place of what is there."""
    register(members.sparkSession)
    grouped = members.groupBy("cluster").agg(F.collect_list("rid").alias("ids")).select("ids")
    grouped.write.format("clusters").mode("overwrite").save(path)
