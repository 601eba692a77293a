"""JSON lines as a data source of Spark's: a sink whose rows are seen all at once or not at all, and its reader.

Tasks write parts of their own names. Only when all have ended does the driver
write a manifest that lists them, in one step; readers know only what manifests
list. A task that failed, was repeated, or lost its executor leaves at most a part
that no manifest names. Paths are opened through Arrow's file systems, so the
folder must be one that driver and executors share.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "json_lines"
_ROWS = 4096


def _opened(path: str):
    """(file system, folder) of a path or URI."""
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, folder = _opened(self.path)
        name, rows = f"part-{uuid.uuid4().hex}.jsonl.gz", 0
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(json.dumps(row, ensure_ascii=False, default=str).encode() + b"\n")
                rows += batch.num_rows
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        system, folder = _opened(self.path)
        system.create_dir(folder, recursive=True)
        old = _manifests(system, folder) if self.overwrite else []
        parts = [{"name": m.name, "rows": m.rows} for m in messages if m is not None and m.rows]
        name = f"{folder}/manifest-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{name}.new") as out:
            out.write(json.dumps({"parts": parts, "replaces": old}).encode())
        system.move(f"{name}.new", f"{name}.json")

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = _opened(self.path)
        for message in messages:
            if message is not None and system.get_file_info(f"{folder}/{message.name}").type != fs.FileType.NotFound:
                system.delete_file(f"{folder}/{message.name}")


def _manifests(system, folder: str) -> list[str]:
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.startswith("manifest-") and f.base_name.endswith(".json"))


@dataclass
class File(InputPartition):
    name: str

    def __init__(self, name: str):
        self.name = name


class LinesReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[File]:
        """The parts of all manifests that no later one replaces: names only, one for each task that wrote."""
        system, folder = _opened(self.path)
        read = {}
        for name in _manifests(system, folder):
            with system.open_input_stream(f"{folder}/{name}") as file:
                read[name] = json.loads(file.read())
        gone = {name for manifest in read.values() for name in manifest["replaces"]}
        return [File(part["name"]) for name, manifest in read.items() if name not in gone for part in manifest["parts"]] or [File("")]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, folder = _opened(self.path)
        schema = to_arrow_schema(self.schema)
        with system.open_input_stream(f"{folder}/{partition.name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as lines:
            held = []
            for line in lines:
                held.append(json.loads(line))
                if len(held) == _ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, schema)


class JsonLines(DataSource):
    """``path``; reading needs a schema."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        raise ValueError("give the schema of the lines")

    def reader(self, schema: StructType) -> LinesReader:
        return LinesReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        return LinesWriter(self.options["path"], overwrite)


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """Add the rows to the folder, or replace what it shows, in one step."""
    df.sparkSession.dataSource.register(JsonLines)
    df.write.format(NAME).mode(mode).option("path", path).save()


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    spark.dataSource.register(JsonLines)
    return spark.read.format(NAME).schema(schema).option("path", path).load()
