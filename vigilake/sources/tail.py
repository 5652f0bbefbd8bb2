"""A growing log file as a stream: complete lines only, through rotation and truncation.

One file is read by one reader; for many files use ``stream_lines``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StringType, StructField, StructType


def complete_lines(buffer: bytes) -> tuple[list[bytes], bytes]:
    """Lines that have ended, and what is left of the last one."""
    *lines, rest = buffer.split(b"\n")
    return [x.removesuffix(b"\r") for x in lines], rest


def advance(path: str, offset: dict, from_start: bool = False) -> tuple[list[str], dict]:
    """Lines that have been completed since ``offset`` ({"at", "inode"}; at -1 before the first look), and the next offset.

    An offset stands behind the last complete line, so an unfinished one is read again when it has ended.
    """
    try:
        st = os.stat(path)
    except FileNotFoundError:
        return [], offset
    at = offset["at"]
    if at < 0:
        at = 0 if from_start else st.st_size
    elif offset["inode"] not in (0, st.st_ino) or at > st.st_size:
        at = 0
    with open(path, "rb") as f:
        f.seek(at)
        lines, rest = complete_lines(f.read(st.st_size - at))
    end = st.st_size - len(rest)
    return [x.decode("utf-8", "replace") for x in lines if x.strip()], {"at": end, "inode": st.st_ino}


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.from_start = options["path"], options.get("fromstart", options.get("fromStart", "false")).lower() == "true"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1, "inode": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        lines, end = advance(self.path, start, self.from_start)
        return iter([(x, self.path) for x in lines]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        at = start["at"] if 0 <= start["at"] <= end["at"] else 0 if self.from_start else end["at"]
        with open(self.path, "rb") as f:
            f.seek(at)
            lines, _ = complete_lines(f.read(end["at"] - at))
        return iter([(x.decode("utf-8", "replace"), self.path) for x in lines if x.strip()])


class TailSource(DataSource):
    """``spark.dataSource.register(TailSource)``, then ``readStream.format("tail").option("path", ...)``; option fromStart reads what is there already."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> StructType:
        return StructType([StructField("raw", StringType()), StructField("file", StringType())])

    def simpleStreamReader(self, schema: StructType) -> _Reader:  # noqa: N802
        return _Reader(self.options)
