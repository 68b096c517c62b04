"""Reports as a batch sink that is whole or absent.

    spark.dataSource.register(ReportSink)
    report.write.format("report").option("path", "file:///shared/reports/today").mode("append").save()

Each task writes its rows as JSON lines to a part file of a name of its own; the driver then names all parts, with their row
counts, in `report.json`, which is moved into place at once. An aborted write removes its parts; a task that ran twice leaves a
part that no report names. A finished report is not written again unless the mode is overwrite. The path is one that
driver and executors share, in any file system that Arrow opens."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

INDEX = "report.json"


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class ReportSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "report"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.names, overwrite)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str], overwrite: bool):
        self.path, self.names, self.overwrite = path, names, overwrite

    def _folder(self):
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(self.path)
        files.create_dir(folder)
        return files, folder

    def write(self, rows) -> Part:
        files, folder = self._folder()
        name, n = f"part-{uuid.uuid4().hex}.jsonl", 0
        with files.open_output_stream(f"{folder}/{name}") as out:
            for row in rows:
                out.write((json.dumps(dict(zip(self.names, row, strict=True)), default=str, sort_keys=True) + "\n").encode())
                n += 1
        return Part(name, n)

    def commit(self, messages: list[Part | None]) -> None:
        files, folder = self._folder()
        if index_of(self.path) is not None and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"there is a report at {self.path}")
        held = [m for m in messages if m is not None]
        passing = f"{folder}/_{uuid.uuid4().hex}"
        with files.open_output_stream(passing) as out:
            out.write(json.dumps({"columns": self.names, "parts": [{"name": m.name, "rows": m.rows} for m in held], "rows": sum(m.rows for m in held)}).encode())
        files.move(passing, f"{folder}/{INDEX}")

    def abort(self, messages: list[Part | None]) -> None:
        files, folder = self._folder()
        for m in messages:
            if m is not None:
                files.delete_file(f"{folder}/{m.name}")


def index_of(path: str) -> dict | None:
    """The finished report's index, None if there is none."""
    from pyarrow import fs

    files, folder = fs.FileSystem.from_uri(path)
    if files.get_file_info(f"{folder}/{INDEX}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{folder}/{INDEX}") as held:
        return json.loads(held.read())


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a finished report; parts that it doesn't name are not read."""
    held = index_of(path)
    if held is None:
        raise FileNotFoundError(f"there is no finished report at {path}")
    parts = [f"{path}/{p['name']}" for p in held["parts"] if p["rows"]]
    return spark.read.schema(schema).json(parts) if parts else spark.createDataFrame([], schema)
