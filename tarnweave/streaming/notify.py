"""A sink for notifications that sends each message of a batch once, whatever is tried again.

Tasks write their messages to staged files; committing a batch writes one manifest that names the files of the tasks that
succeeded, by renaming, so it is there whole or not at all. A message counts as sent if a manifest names its file: attempts that failed are
named by none, and a batch that has a manifest isn't sent again. The channel is a log of JSON lines in the shared folder; the folder must
be one that all executors reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "tarnweave_messages"


def _at(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def _write(path: str, text: str) -> None:
    files, place = _at(path)
    files.create_dir(place.rpartition("/")[0], recursive=True)
    with files.open_output_stream(place) as out:
        out.write(text.encode())


@dataclass
class Staged(WriterCommitMessage):
    name: str | None


class MessageWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Staged:
        lines = "".join(json.dumps(r.asDict(True), default=str) + "\n" for r in iterator)
        if not lines:
            return Staged(None)
        name = f"{uuid.uuid4().hex}.json"
        _write(f"{self.path}/staged/{name}", lines)
        return Staged(name)

    def _drop(self, messages: list[Staged | None]) -> None:
        for name in [m.name for m in messages if m and m.name]:
            files, place = _at(f"{self.path}/staged/{name}")
            files.delete_file(place)

    def commit(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        from pyarrow import fs

        files, place = _at(f"{self.path}/sent/{batchId:012d}.json")
        if files.get_file_info(place).type != fs.FileType.NotFound:
            self._drop(messages)  # sent already, by a run that ended before Spark could note it
            return
        part = f"{self.path}/sent/_{uuid.uuid4().hex}"
        _write(part, json.dumps({"batch": batchId, "files": [m.name for m in messages if m and m.name]}) + "\n")
        files.move(_at(part)[1], place)

    def abort(self, messages: list[Staged | None], batchId: int) -> None:  # noqa: N803
        self._drop(messages)


class MessageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> MessageWriter:  # noqa: N802
        return MessageWriter(self.options["path"])


def send(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Send every row of the stream that is there now and wasn't sent before."""
    stream.sparkSession.dataSource.register(MessageSource)
    stream.writeStream.format(FORMAT).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sent(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The messages sent, with their batch."""
    named = spark.read.schema("batch long, files array<string>").json(f"{path}/sent/*.json").select("batch", F.explode("files").alias("file"))
    rows = spark.read.schema(schema).json(f"{path}/staged").withColumn("file", F.col("_metadata.file_name"))
    return rows.join(named, "file").drop("file")
