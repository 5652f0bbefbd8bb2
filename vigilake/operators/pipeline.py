"""Pipelines: load, check and run a configuration of transforms over messages."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conditions import Config, ConfigError
from .transforms import OUTBOX, Compiler


@dataclass(frozen=True)
class Result:
    """What a pipeline leaves of its messages, and what it has sent."""

    messages: DataFrame
    outbox: DataFrame


class Pipeline:
    """A compiled pipeline. ``run`` plans one pass; nothing runs until its result is used."""

    def __init__(self, transforms: list[Config], **compiler):
        if not transforms:
            raise ConfigError("no transforms configured")
        self.transforms, self.options = transforms, compiler

    @classmethod
    def load(cls, path: str, **compiler) -> Pipeline:
        """From a JSON file: {"transforms": [...]}. Jsonnet sources are written with ``vigilake.operators.dsl`` instead."""
        if path.endswith((".jsonnet", ".libsonnet")):
            raise ConfigError("Jsonnet needs its evaluator; build the configuration with vigilake.operators.dsl")
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f).get("transforms") or [], **compiler)

    def planned(self, df: DataFrame) -> DataFrame:
        """df (data, optionally meta) with the working columns after all transforms."""
        have = df.columns
        df = df.withColumns({"meta": F.coalesce("meta", F.lit("{}")) if "meta" in have else F.lit("{}"), "alert": F.lit(None).cast("string"), "_live": F.lit(True), "_outbox": F.array().cast(OUTBOX)})
        return Compiler(**self.options).apply(df, self.transforms, F.lit(True))

    def run(self, df: DataFrame) -> Result:
        done = self.planned(df)
        return Result(done.where("_live").drop("_live", "_outbox"), done.select(F.inline("_outbox")))

    def process(self, spark: SparkSession, messages: list[str]) -> list[str]:
        """The messages left of a few given ones."""
        return [r.data for r in self.run(spark.createDataFrame([(m,) for m in messages], "data string")).messages.collect()]

    def stream(self, df: DataFrame, write: Callable[[DataFrame, DataFrame], None], checkpoint: str, **trigger):
        """Runs over a stream of messages; write(messages, outbox) gets each micro-batch, whose end is the flush."""

        def batch(rows: DataFrame, _: int) -> None:
            done = self.planned(rows).persist()
            try:
                write(done.where("_live").drop("_live", "_outbox"), done.select(F.inline("_outbox")))
            finally:
                done.unpersist()

        return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def __str__(self) -> str:
        return json.dumps({"transforms": self.transforms}, separators=(",", ":"))
