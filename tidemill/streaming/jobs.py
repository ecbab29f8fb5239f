"""Structured Streaming jobs: correction feed, job state, notice ingest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemill.functions import text as X
from tidemill.operators import publish, rows
from tidemill.sources import logs
from tidemill.streaming import claims


def correction_counts(spark: SparkSession, path: str) -> DataFrame:
    """T1. A stream of appended corrections, counted by group; write it in complete mode."""
    return spark.readStream.schema(logs.CORRECTION).json(path).groupBy("grp").count()


def refresh_last(spark: SparkSession, path: str, target: str, checkpoint: str, n: int = 200) -> StreamingQuery:
    """T1. After each micro-batch the last n corrections stand in a new version under target.

    A version is made from the one before and the batch alone. Versions are never overwritten while they are read; a batch that
    is run again writes its own version again.
    """

    def refresh(batch: DataFrame, epoch: int) -> None:
        known = last_corrections(batch.sparkSession, target, before=epoch) if epoch else batch.limit(0)
        known.unionByName(batch).orderBy(F.desc("seq")).limit(n).write.mode("overwrite").parquet(f"{target}/version={epoch}")

    rows = spark.readStream.schema(logs.CORRECTION).json(path).filter("case_no is not null")
    return rows.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_corrections(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """T1. The newest version that refresh_last wrote."""
    found = spark.read.schema(f"{logs.CORRECTION}, version long").parquet(target)
    found = found if before is None else found.filter(F.col("version") < before)
    newest = found.agg(F.max("version")).first()[0]
    return found.filter(F.col("version") == F.lit(newest)).drop("version")


class FoldJob(StatefulProcessor):
    """A job's fields, each with the time and number of the event that set it. A job that is done leaves the state `keep` milliseconds later, unless it starts again."""

    def __init__(self, fields: list[str], job: str, ts: str, order: str, keep: int):
        self.fields, self.job, self.ts, self.order, self.keep = fields, job, ts, order, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = {f: handle.getValueState(f, "at long, seq long, value string") for f in self.fields}
        self.ends = handle.getValueState("_ends", "at long")

    def _row(self, key, held: dict, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({self.job: [key[0]]} | {f: pd.Series([held[f][2] if held[f] else None], dtype=object) for f in self.fields} | {"closed": [closed]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        # Spark itself drops events that were late before the last batch; those that became late by it are dropped here
        watermark, seen = timerValues.getCurrentWatermarkInMs() * 1000, False
        held = {f: v.get() if v.exists() else None for f, v in self.values.items()}
        old = self.ends.get()[0] if self.ends.exists() else None
        if old is not None and old * 1000 <= watermark:
            # its time came with this batch, whose events belong to a new run
            yield self._row(key, held, True)
            self.handle.deleteTimer(old)
            for v in (*self.values.values(), self.ends):
                v.clear()
            held, old = dict.fromkeys(held), None
        before = dict(held)
        for part in rows:
            at = part[self.ts].astype("datetime64[us]").astype("int64").to_numpy()
            timely = at >= watermark
            seen |= bool(timely.any())
            for f in self.fields:
                some = part[f].notna().to_numpy() & timely
                if some.any():
                    newest = max(zip(at[some].tolist(), part[self.order][some].tolist(), part[f][some].tolist(), strict=True), key=lambda x: x[:2])
                    if held[f] is None or newest[:2] >= tuple(held[f][:2]):
                        held[f] = newest
        for f, v in self.values.items():
            if held[f] != before[f]:
                v.update(held[f])
        if not seen:
            return
        status = held["status"]
        end = status[0] // 1000 + self.keep if status and status[2] == "done" else None
        if end != old:
            if old is not None:
                self.handle.deleteTimer(old)
                self.ends.clear()
            if end is not None:
                self.handle.registerTimer(end)
                self.ends.update((end,))
        yield self._row(key, held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self._row(key, {f: v.get() if v.exists() else None for f, v in self.values.items()}, True)
        for v in (*self.values.values(), self.ends):
            v.clear()

    def close(self) -> None:
        pass


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, which job_state needs; the session's setting is put back."""
    name, provider = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def job_state(events: DataFrame, fields: list[str], late: str = "10 minutes", keep: timedelta = timedelta(days=1), job: str = "job_id", ts: str = "ts", order: str = "seq") -> DataFrame:
    """T2. The latest value of each field of each job, as history.fold_state, with `closed`; write it in update mode, started inside state_store().

    `status` is one of the fields, all of them strings. A row comes for each job that a batch touches, and a last one, closed, when a done job leaves the
    state: once the watermark is `keep` past the event that ended it. Events later than the watermark are passed over, so an ended job
    doesn't come back by them; a later event is a new run, with nothing of the old one.
    """
    kind = dict(events.dtypes)[job]
    out = f"{job} {kind}, " + ", ".join(f"{f} string" for f in fields) + ", closed boolean"
    rows = events.select(job, ts, order, *fields).withWatermark(ts, late).groupBy(job)
    return rows.transformWithStateInPandas(FoldJob(fields, job, ts, order, int(keep.total_seconds() * 1000)), T.StructType.fromDDL(out), "Update", "EventTime")


def fold_jobs(events: DataFrame, fields: list[str], target: str, checkpoint: str, **options) -> StreamingQuery:
    """T2 run to the end of what is there: each batch's rows under target, by epoch; a batch that is run again replaces its own."""

    def keep_batch(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    with state_store(events.sparkSession):
        return job_state(events, fields, **options).writeStream.outputMode("update").foreachBatch(keep_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_states(spark: SparkSession, target: str, job: str = "job_id") -> DataFrame:
    """T2. The last row that fold_jobs wrote of each job."""
    rows = spark.read.parquet(target)
    names = [c for c in rows.columns if c != "epoch"]
    # a batch that closes a job and has events of its next run gives two rows: the open one is the later
    return rows.groupBy(job).agg(F.max_by(F.struct(*names), F.struct("epoch", ~F.col("closed"))).alias("s")).select("s.*")


def published_notices(texts: DataFrame) -> DataFrame:
    """(job_id, text) -> published rows with header fields: blocks, their fields, normal addresses, classes by rule.

    A document arrives whole, so windows over its order hold within a micro-batch. Texts are dealt by job once; blocks, classes
    and header fields stay where their text is.
    """
    blocks = rows.segment(texts, "job_id", "text").withColumn("f", X.block_fields(F.col("block_text")))
    place = lambda a: F.struct(X.normal_address(F.concat_ws(" ", a, F.col("f.detail"))).alias("address"), X.normal_use(F.col("f.use")).alias("use"))
    blank = F.lit("")
    bits = F.coalesce(publish.flags(F.col("block_text")), F.lit(0))
    records = blocks.withColumn("_bits", bits).select("job_id", F.col("block_no").alias("rec_no"), "case_no", blank.alias("dup_tag"), blank.alias("item_no"), "f.price", "f.min_price", blank.alias("note"), F.transform("f.addresses", place).alias("locations"), F.col("_bits").alias("_any"), F.col("_bits").alias("_all"))
    table = publish.published(publish.classify_records(records, ("job_id", "case_no")), ("job_id", "rec_no"))
    return table.join(rows.headers(texts.select("job_id", "text")).drop("text"), "job_id")


#: Files of a batch which one task is to work on, whatever the session's number of tasks is.
TASK_FILES = 200


def ingest(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, done: str, lease: float = claims.LEASE) -> StreamingQuery:
    """T3. New notice files, each once by its path, published; sink gets each micro-batch and should replace what it has of that batch.

    A file is claimed before it is worked on, in the table under `done` that all runs share (claims.py): what another run
    holds or has done is passed over, however old the file's time is. A batch reads the claims of its own files' buckets
    alone. A batch that is run again does its own files again; a run that died leaves its claims to others when the lease ends.
    Large batches are dealt over so many tasks that a task's texts don't grow with the batch, and needn't be spilled.
    """
    # the source would leave out files much older than the newest one
    files = spark.readStream.option("maxFileAge", "36500d").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("job_id"), F.col("value").alias("text"))
    run = hashlib.md5(checkpoint.encode()).hexdigest()

    def each(batch: DataFrame, epoch: int) -> None:
        own = claims.Claims(batch.sparkSession, done, f"{run}-{epoch}", lease)
        mine = own.claim(batch, f"{done}/batches/{run}-{epoch}")
        tasks = -(-mine.count() // TASK_FILES)
        texts = batch.repartition(tasks, "job_id") if tasks > int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")) else batch
        fresh = texts.dropDuplicates(["job_id"]).join(mine.select("job_id"), "job_id", "left_semi")
        sink(published_notices(fresh), epoch)
        own.finish(mine)

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
