"""A message queue as a stream: at-least-once delivery, acknowledged behind the sink.

The queue is a folder that the driver and all executors mount, as a service's
bridge or a test fills it: one file a message, its name the message id; ids are
in no order. One stream reads a queue at a time. Beside the folder lie claims,
``<path>.claims``: each time messages are taken, a file that is named by how
many have been taken so far lists them. That number is the stream's offset. It
only grows, whatever arrives, and a range of offsets always stands for the same
messages: a micro-batch that fails, or that a restarted stream repeats, reads
them again, and those that were taken but never planned come with the next one.
Messages are acknowledged, which deletes just the ones that were claimed, when
Spark commits the micro-batch, that is after the sink has succeeded.
"""

from __future__ import annotations

import contextlib
import heapq
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Messages that one task reads.
PER_TASK = 100


def pending(path: str, claimed: set[str], most: int) -> list[str]:
    """Names of the oldest messages that are not claimed; files whose name begins with a dot are being written."""
    found = [(e.stat().st_mtime_ns, e.name) for e in os.scandir(path) if e.is_file() and not e.name.startswith(".") and e.name not in claimed]
    return [name for _, name in heapq.nsmallest(most, found)]


class Claims:
    """What has been taken from a queue, by the number of messages taken so far."""

    def __init__(self, path: str):
        self.folder = f"{path.rstrip('/')}.claims"
        os.makedirs(self.folder, exist_ok=True)

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in os.listdir(self.folder) if n.isdigit())

    def names(self, number: int) -> list[str]:
        with open(f"{self.folder}/{number}", encoding="utf-8") as f:
            return json.load(f)

    def put(self, number: int, names: list[str]) -> None:
        with open(f"{self.folder}/.new", "w", encoding="utf-8") as f:
            json.dump(names, f)
        os.replace(f"{self.folder}/.new", f"{self.folder}/{number}")

    def between(self, start: int, end: int) -> list[str]:
        return [name for k in self.numbers() if start < k <= end for name in self.names(k)]

    def settle(self, end: int) -> None:
        """Forgets claims up to ``end``, but for the number of the last one."""
        numbers = self.numbers()
        for k in numbers:
            if k > end:
                break
            if k == numbers[-1]:
                self.put(k, [])
            else:
                os.unlink(f"{self.folder}/{k}")


class _Names(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("maxmessages", options.get("maxMessages", 1000)))
        self.claims = Claims(self.path)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"taken": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        numbers = self.claims.numbers()
        taken = numbers[-1] if numbers else 0
        claimed = {name for k in numbers for name in self.claims.names(k)}
        found = pending(self.path, claimed, self.most)
        if found:
            taken += len(found)
            self.claims.put(taken, found)
        return {"taken": taken}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = self.claims.between(start["taken"], end["taken"])
        return [_Names(names[k : k + PER_TASK]) for k in range(0, len(names), PER_TASK)]

    def read(self, partition: _Names) -> Iterator[tuple]:
        for name in partition.names:
            try:
                with open(os.path.join(self.path, name), encoding="utf-8", errors="replace") as f:
                    yield name, f.read()
            except FileNotFoundError:  # acknowledged by another attempt
                continue

    def commit(self, end: dict) -> None:
        for name in self.claims.between(0, end["taken"]):
            with contextlib.suppress(FileNotFoundError):  # a commit that is repeated
                os.unlink(os.path.join(self.path, name))
        self.claims.settle(end["taken"])


class QueueSource(DataSource):
    """``spark.dataSource.register(QueueSource)``, then ``readStream.format("message_queue").option("path", ...)``: message_id and body."""

    @classmethod
    def name(cls) -> str:
        return "message_queue"

    def schema(self) -> StructType:
        return StructType([StructField("message_id", StringType()), StructField("body", StringType())])

    def streamReader(self, schema: StructType) -> _Reader:  # noqa: N802
        return _Reader(self.options)

    @classmethod
    def stream(cls, spark: SparkSession, path: str, max_messages: int = 1000) -> DataFrame:
        spark.dataSource.register(cls)
        return spark.readStream.format(cls.name()).option("path", path).option("maxMessages", str(max_messages)).load()
