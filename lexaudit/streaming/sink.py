"""A sink for run events as NDJSON lines that are written once, whatever is tried again.

``run_events`` is a data source for streams of (run_id, seq, line). A task writes its events to a file of its
own, one line each; the driver then commits the batch by naming its files in one
file, ``commits/<batch>``, put there whole. Files that no commit names (of failed tasks, or of a batch that
came again after its commit) are never read, and a batch is committed once. An event is visible with its
batch. ``once`` takes out events that the source itself repeats, by (run, seq) within the watermark.

Paths are any that pyarrow's file systems open (``file``, ``hdfs``, ``s3``, ``gs``), shared by driver and executors."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lexaudit.streaming.stages import wire_status

FORMAT = "run_events"
EVENTS = "run_id string, seq long, line string"
_FLUSH = 1000


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if urlsplit(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(path).path
    return fs.FileSystem.from_uri(path)


class EventWriter(DataSourceStreamWriter):
    """Task files under ``events``, one commit file a batch under ``commits``."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        files, root = _opened(self.path)
        files.create_dir(posixpath.join(root, "events"), recursive=True)
        name = out = None
        try:
            for n, row in enumerate(iterator):
                if out is None:
                    name = f"{uuid.uuid4().hex}.ndjson"
                    out = files.open_output_stream(posixpath.join(root, "events", name))
                out.write((json.dumps({"run_id": row["run_id"], "seq": row["seq"], "line": row["line"]}, ensure_ascii=False) + "\n").encode())
                if n % _FLUSH == 0:
                    out.flush()
        finally:
            if out is not None:
                out.close()
        return _Written(name)

    def _commit_file(self, batch: int) -> tuple[fs.FileSystem, str]:
        files, root = _opened(self.path)
        return files, posixpath.join(root, "commits", f"{batch:020d}")

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        files, name = self._commit_file(batchId)
        if files.get_file_info(name).type != fs.FileType.NotFound:  # the batch came again: its first files stand
            self.abort(messages, batchId)
            return
        files.create_dir(posixpath.dirname(name), recursive=True)
        whole = posixpath.join(posixpath.dirname(name), f".{uuid.uuid4().hex}")
        with files.open_output_stream(whole) as out:
            out.write("".join(json.dumps({"batch": batchId, "file": m.name}) + "\n" for m in messages if m is not None and m.name).encode())
        files.move(whole, name)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        files, root = _opened(self.path)
        for m in messages:
            if m is not None and m.name:
                files.delete_file(posixpath.join(root, "events", m.name))


class RunEvents(DataSource):
    """``df.writeStream.format("run_events").option("path", …)`` for rows of (run_id, seq, line)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return EVENTS

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        if "path" not in self.options:
            raise ValueError("the sink needs a path")
        return EventWriter(self.options["path"])


def event_line(stage: F.Column, status: F.Column, data: F.Column | None = None) -> F.Column:
    """An event as a line of the wire: stage, status and data, ``{}`` where there is none."""
    parts = [stage.alias("stage"), wire_status(status).alias("status")]
    whole = F.to_json(F.struct(*parts, *([] if data is None else [data.alias("data")])), {"ignoreNullFields": "false"})
    return whole if data is not None else F.concat(F.substr(whole, F.lit(1), F.length(whole) - 1), F.lit(',"data":{}}'))


def once(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Each (run_id, seq) of a stream once; the first to come counts."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["run_id", "seq"])


def write_events(events: DataFrame, path: str, checkpoint: str):
    """A stream writer of (run_id, seq, line) to the sink; start it with a trigger of one's choice."""
    events.sparkSession.dataSource.register(RunEvents)
    return events.select("run_id", F.col("seq").cast("long").alias("seq"), "line").writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(batch, run_id, seq, line) of committed batches."""
    commits = spark.read.schema("batch long, file string").json(f"{path}/commits")
    lines = spark.read.schema(EVENTS).json(f"{path}/events").select("*", F.col("_metadata.file_name").alias("file"))
    return lines.join(commits, "file").select("batch", "run_id", "seq", "line")
