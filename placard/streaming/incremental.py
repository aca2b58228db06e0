"""Incremental collection with Structured Streaming: each micro-batch is merged into the buckets of a table that it touches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placard.operators.merge import KEY, batch_conflicts, fenced, upsert_notices


class SnapshotTable:
    """A table as buckets of its keys' hash under one folder; each version names, for each bucket, the version that wrote it.

    A micro-batch rewrites the buckets of its own keys only. One that runs
    again after a failure reads the same predecessor and writes the same rows
    under the same version, so its effect is the same.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = 64, key: tuple[str, ...] = KEY):
        self.spark, self.folder, self.schema, self.buckets, self.key = spark, folder.rstrip("/"), schema, buckets, key

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _versions(self, version: int) -> dict[int, int]:
        """The version that wrote each bucket, as of a version; a few numbers."""
        if version < 0:
            return {}
        row = self.spark.read.schema("value string").text(f"{self.folder}/manifest/v={version}").first()
        return {int(k): v for k, v in json.loads(row.value).items()}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def at(self, version: int) -> DataFrame:
        return self._read(self._versions(version))

    def buckets_of(self, version: int, touched: set[int]) -> DataFrame:
        return self._read({b: v for b, v in self._versions(version).items() if b in touched})

    def write(self, df: DataFrame, version: int, touched: set[int]) -> None:
        """The touched buckets of a version, with df as all their rows; the others stay as they were."""
        df.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/v={version}")
        written = {r.bucket for r in self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/v={version}").select("bucket").distinct().collect()} if touched else set()
        versions = {b: v for b, v in self._versions(version - 1).items() if b not in touched} | {b: version for b in written}
        self.spark.createDataFrame([(json.dumps(versions),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/manifest/v={version}")


def collect_stream(batches: DataFrame, table: SnapshotTable, checkpoint: str, now: Column | None = None, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merges each micro-batch of notices into the table's next version; a batch that contradicts itself is refused.

    now: the time that is recorded, by default the latest ``collected_at`` of
    the batch where it has that column, so that a batch that runs again records
    the same; else the clock.
    """

    def step(batch: DataFrame, version: int) -> None:
        at = now
        if at is None:
            at = F.lit(batch.agg(F.max("collected_at").alias("at")).first()["at"]) if "collected_at" in batch.columns else F.current_timestamp()
        rows = batch.drop("collected_at").dropDuplicates()
        if not batch_conflicts(rows).filter("n_different > 1").isEmpty():
            raise ValueError("a batch has different rows for one notice")
        touched = {r.b for r in rows.select(table.bucket().alias("b")).distinct().collect()}
        target = table.buckets_of(version - 1, touched)
        table.write(merge(target, rows) if merge else upsert_notices(target, rows, at), version, touched)

    return batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fenced_stream(results: DataFrame, executions: DataFrame, current: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch of results that is accepted to folder/accepted, and late or stale ones to folder/superseded.

    executions (notice_id, execution_token) and current (notice_id,
    content_revision) are read anew for each batch. A batch that runs again
    writes the same folders again.
    """

    def step(batch: DataFrame, version: int) -> None:
        for name, rows in zip(("accepted", "superseded"), fenced(batch, executions, current), strict=True):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/v={version}")

    return results.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
