"""What rules with state remember between micro-batches, as tables in a shared folder.

First-seen rules keep each key's first match for good. Rules with windows keep
their hits, in folders that say how far their times go, so hits that no window
can reach any more are neither read nor kept. A micro-batch writes under its own
number and reads only those before it, so one that is run again after a failure
finds the same past and replaces what it has written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.operators.detect import Analysis
from vigilake.operators.stateful import micros

_FIRSTS = "rule_id string, state string, batch long"
_HITS = "rule_id string, state string, _at timestamp, eventID string, title string, batch long, until long"


class RuleState:
    """One stream's memory under ``root``; ``window_s`` is the longest window of any rule, ``late_s`` how late records may come."""

    def __init__(self, spark: SparkSession, root: str, window_s: int = 86_400, late_s: int = 86_400):
        self.spark, self.root, self.reach = spark, root.rstrip("/"), (window_s + late_s) * 1_000_000

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str, schema: str, batch: int) -> DataFrame | None:
        path, fs = self._folder(name)
        if not fs.exists(path):
            return None
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}").where(F.col("batch") < batch)

    def seen(self, batch: int) -> DataFrame | None:
        found = self._read("firsts", _FIRSTS, batch)
        return None if found is None else found.select("rule_id", "state")

    def past(self, batch: int) -> DataFrame | None:
        found = self._read("hits", _HITS, batch)
        return None if found is None else found.drop("batch", "until")

    def keep(self, batch: int, found: Analysis, first_rules: list[str]) -> None:
        """Remembers a batch's hits; first_rules are those that only their first match counts for."""
        if found.stateful is None:
            return
        hits = found.stateful
        if "eventID" not in hits.columns:
            hits = hits.withColumn("eventID", F.lit(None).cast("string"))
        firsts = hits.where(F.col("rule_id").isin(*first_rules)).select("rule_id", "state").distinct()
        seen = self.seen(batch)
        if seen is not None:
            firsts = firsts.join(seen, ["rule_id", "state"], "left_anti")
        firsts.write.mode("overwrite").parquet(f"{self.root}/firsts/batch={batch}")
        others = hits.where(~F.col("rule_id").isin(*first_rules))
        newest, now = others.agg(F.max(micros(F.col("_at"))), F.unix_micros(F.first(F.current_timestamp()))).first()
        path, fs = self._folder(f"hits/batch={batch}")
        fs.delete(path, True)
        if newest is not None:
            others.select("rule_id", "state", "_at", "eventID", "title").write.parquet(f"{self.root}/hits/batch={batch}/until={newest}")
            # what is dated in the future pushes nothing out
            self._forget(min(newest, now or newest))

    def _forget(self, newest: int) -> None:
        path, fs = self._folder("hits")
        for batch in fs.listStatus(path):
            for part in fs.listStatus(batch.getPath()):
                name = part.getPath().getName()
                if name.startswith("until=") and int(name[6:]) < newest - self.reach:
                    fs.delete(part.getPath(), True)
