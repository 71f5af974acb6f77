"""Partial records as a Spark data source: ``spark.read.format("partial_records")``.

A source lands one JSON object a line, with a name's fields as far as it has them. Options: ``path`` (a folder of such files, in any
store that Arrow reaches), ``source`` (its name) and ``fields`` (a DDL list). Every file is a partition; a row has ticker,
source, error and the fields. A line that is no object, or a value of the wrong kind, costs that line or that field only, and is told in
``error``; a line without a ticker is skipped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

KINDS = {"string": str, "double": float, "bigint": int, "int": int, "boolean": bool}
HEAD = "ticker string, source string, error string"


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, path: str, source: str, schema: StructType) -> None:
        self.path, self.source = path, source
        self.fields = [(f.name, KINDS[f.dataType.simpleString()]) for f in schema.fields[3:]]

    def partitions(self) -> list[File]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"file://{self.path}")
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [File(n) for n in names]

    def read(self, partition: File | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # an empty folder
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.path) as stream:
            left = b""
            while block := stream.read(1 << 20):  # a file is never held whole
                *lines, left = (left + block).split(b"\n")
                yield from self._rows(lines)
            yield from self._rows([left])

    def _rows(self, lines: list[bytes]) -> Iterator[tuple]:
        for line in lines:
            if not line.strip():
                continue
            try:
                record = json.loads(line)
            except ValueError:
                yield (None, self.source, "unreadable line", *[None] * len(self.fields))
                continue
            if not isinstance(record, dict) or not record.get("ticker"):
                continue
            wrong, values = [], []
            for name, kind in self.fields:
                value = record.get(name)
                if value is not None and kind is float and isinstance(value, int) and not isinstance(value, bool):
                    value = float(value)
                if value is not None and (type(value) is not kind):
                    wrong.append(name)
                    value = None
                values.append(value)
            yield (str(record["ticker"]).upper(), self.source, "wrong kind: " + ", ".join(wrong) if wrong else record.get("error"), *values)


class PartialRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "partial_records"

    def schema(self) -> str:
        return f"{HEAD}, {self.options['fields']}"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("source", "unknown"), schema)


def partial_records(spark: SparkSession, path: str, source: str, fields: str) -> DataFrame:
    """The records of one landed source."""
    spark.dataSource.register(PartialRecords)
    return spark.read.format("partial_records").option("path", path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path).option("source", source).option("fields", fields).load()
