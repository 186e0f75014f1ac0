"""The journal of a pipeline's runs: what each stage has done, for a run that goes on after a stop."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "delivery string, run string, stage string, at double, detail string"
PUBLISHED, REPORTED = "published", "reported"


def fingerprint(files: DataFrame, *settings: object) -> str:
    """What a run works on: the delivery's files by name, size and time, and all settings."""
    summed = F.sum(F.xxhash64("file", "size", "modified").cast("decimal(38,0)"))
    found = files.agg(F.count(F.lit(1)), summed).first()
    told = "\n".join(map(repr, (found[0], found[1], *settings)))
    return hashlib.sha256(told.encode()).hexdigest()


@dataclass(frozen=True)
class Journal:
    """Rows of a table, one for each finished stage of a run, added and never changed."""

    spark: SparkSession
    table: str

    def note(self, delivery: str, run: str, stage: str, **detail: object) -> None:
        """Add a row for a finished stage."""
        row = (delivery, run, stage, time.time(), json.dumps(detail))
        one = self.spark.createDataFrame([row], SCHEMA).coalesce(1)
        one.write.mode("append").format("parquet").saveAsTable(self.table)

    def unfinished(self, delivery: str) -> dict | None:
        """The detail of the last stage `published` of this delivery, unless its reports followed."""
        if not self.spark.catalog.tableExists(self.table):
            return None
        rows = self.spark.table(self.table).filter(F.col("delivery") == delivery)
        last = rows.orderBy(F.desc("at")).limit(1).collect()
        if not last or last[0]["stage"] != PUBLISHED:
            return None
        return json.loads(last[0]["detail"])
