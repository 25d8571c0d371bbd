"""Append-only daily ingest on Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepanel.operators.joins import keep_one
from tidepanel.operators.staging import folder

KEYS = ["event_date", "code"]


def _digest(df: DataFrame) -> Column:
    body = sorted(c for c in df.columns if c not in (*KEYS, "observed_at"))
    return F.sha2(F.to_json(F.struct(*body)), 256)


def conflicts(df: DataFrame) -> DataFrame:
    """Keys submitted twice for one observation time with different content."""
    d = df.withColumn("_h", _digest(df)).groupBy(*KEYS, "observed_at").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b"))
    return d.where("_a <> _b").select(*KEYS).distinct()


def seal(df: DataFrame, cutoff: Column) -> DataFrame:
    """Rows of one delivery known by each day's cutoff: last observation per key, conflicting keys left out."""
    ok = df.where(F.col("observed_at") <= cutoff)
    return keep_one(ok.join(conflicts(ok), KEYS, "left_anti"), KEYS, ["observed_at"])


class SealedStore:
    """Day-partitioned folders of sealed rows, refused rows and a day index with content digests.

    A day that is stored again must carry the same digest; an older or changed day is
    reported, never merged.  Labels may not be stored.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or f"{folder(spark)}/sealed-{uuid.uuid4().hex}"

    def _path(self, part: str) -> str:
        return f"{self.root}/{part}"

    def _read(self, part: str, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._path(part))
        except Exception as e:  # noqa: BLE001 - only a missing folder means an empty store
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def day_digests(self, rows: DataFrame) -> DataFrame:
        """Order-free digest per day: row digests summed as numbers, hashed with the count."""
        h = F.conv(F.substring(F.col("_h"), 1, 15), 16, 10).cast("decimal(38,0)")
        d = rows.withColumn("_h", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in KEYS], _digest(rows)), 256))
        return d.groupBy("event_date").agg(F.sha2(F.concat_ws("|", F.sum(h).cast("string"), F.count("*").cast("string")), 256).alias("digest"), F.count("*").alias("rows"))

    def append(self, batch: DataFrame, batch_id: int, cutoff: Column) -> None:
        bad = [c for c in batch.columns if c.startswith("label_")]
        if bad:
            raise ValueError(f"labels may not be stored in a sealed day: {bad}")
        batch = batch.persist()
        rows = seal(batch, cutoff).persist()
        fresh = self.day_digests(rows)
        index = self._read("index", "event_date date, digest string, rows long, batch long").where(F.col("batch") != batch_id)
        stored = index.select("event_date", F.col("digest").alias("_old"))
        newest = index.agg(F.max("event_date").alias("_newest"))
        d = fresh.join(stored, "event_date", "left").join(F.broadcast(newest))
        state = (F.when(F.col("_old") == F.col("digest"), "same").when(F.col("_old").isNotNull(), "changed")
                 .when(F.col("event_date") < F.col("_newest"), "older").otherwise("new"))
        d = d.withColumn("state", state).persist()
        take = d.where("state = 'new'").select("event_date", "digest", "rows", F.lit(batch_id).cast("long").alias("batch"))
        # Keyed by batch, so a replayed batch overwrites its own files and nothing else.
        rows.join(F.broadcast(take.select("event_date")), "event_date").write.mode("overwrite").parquet(self._path(f"rows/batch={batch_id}"))
        late = batch.where(F.col("observed_at") > cutoff).select(*KEYS, "observed_at", F.lit("late").alias("reason"))
        clash = batch.join(conflicts(batch.where(F.col("observed_at") <= cutoff)), KEYS, "left_semi").select(*KEYS, "observed_at", F.lit("conflict").alias("reason"))
        days = batch.join(F.broadcast(d.where("state in ('changed', 'older')").select("event_date", "state")), "event_date").select(*KEYS, "observed_at", F.col("state").alias("reason"))
        late.unionByName(clash).unionByName(days).write.mode("overwrite").parquet(self._path(f"refused/batch={batch_id}"))
        take.drop("batch").write.mode("overwrite").parquet(self._path(f"index/batch={batch_id}"))
        d.unpersist()
        rows.unpersist()
        batch.unpersist()

    def ingest(self, source: str, schema: StructType, cutoff: Column, files_per_batch: int | None = None) -> None:
        """Drain the folder once; the checkpoint makes a restart continue where it stopped."""
        r = self.spark.readStream.schema(schema)
        if files_per_batch:
            r = r.option("maxFilesPerTrigger", files_per_batch)
        q = (r.parquet(source).writeStream.foreachBatch(lambda df, i: self.append(df, i, cutoff))
             .option("checkpointLocation", self._path("_checkpoint")).trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception():
            raise q.exception()

    def read(self, schema: StructType, asof: str | None = None) -> DataFrame:
        """Sealed days up to ``asof``; fails if the rows of a day no longer match its stored digest."""
        rows = self._read("rows", schema).drop("batch")
        index = self._read("index", "event_date date, digest string, rows long")
        if asof:
            rows, index = (d.where(F.col("event_date") <= F.lit(asof).cast("date")) for d in (rows, index))
        now = self.day_digests(rows).select("event_date", F.col("digest").alias("_now"))
        changed = F.raise_error(F.concat(F.lit("sealed day changed: "), F.col("event_date").cast("string")))
        days = index.join(now, "event_date", "left").withColumn("_same", F.when(F.coalesce(F.col("_now") == F.col("digest"), F.lit(False)), True).otherwise(changed.cast("boolean")))
        return rows.join(F.broadcast(days.where("_same").select("event_date")), "event_date")

    def refused(self) -> DataFrame:
        return self._read("refused", "event_date date, code long, observed_at timestamp, reason string")


def gap_status(cal: DataFrame, present: DataFrame) -> DataFrame:
    """Per calendar day: ok, data_gap, or recovery for the first day after a gap (calendar sized)."""
    from pyspark.sql import Window as W

    d = cal.join(F.broadcast(present.select("date", F.lit(1).alias("_has")).distinct()), "date", "left")
    s = F.when(F.col("_has").isNull(), "data_gap")
    prev = F.lag("_has").over(W.orderBy("date"))
    return d.select("date", s.when(prev.isNull() & (F.col("pos") > 0), "recovery").otherwise("ok").alias("status"))


def insert_alerts(source: DataFrame, out: str, checkpoint: str, ts: str, delay: str) -> None:
    """Idempotent alert stream: one row per id within the watermark, checked per batch against the stored days it can touch.

    The store is partitioned by batch and day of ``ts``, so a batch reads no day before its own earliest one.
    """
    spark = source.sparkSession
    once = source.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["alert_id"]).withColumn("day", F.to_date(ts))

    def write(df: DataFrame, batch_id: int) -> None:
        first = df.agg(F.min("day")).first()[0]
        try:
            stored = spark.read.parquet(out).where((F.col("batch") != batch_id) & (F.col("day") >= F.lit(first))).select("alert_id")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            stored = spark.createDataFrame([], "alert_id string")
        df.join(stored, "alert_id", "left_anti").write.mode("overwrite").partitionBy("day").parquet(f"{out}/batch={batch_id}")

    q = once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
