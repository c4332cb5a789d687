"""Incremental runs as Structured Streaming jobs.

Each function turns a stream into another; `run` drives one over the files that are there
(trigger availableNow) into a table of the shared folder. The same functions serve a job
with a processing-time trigger, which is single-flight by design.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.plans.catalog import query
from galley.session import file_system, materialize, shared_dir
from galley.sources.snapshots import source_key
from galley.sources.tables import table
from galley.streaming.state import StateTable

def read(spark: SparkSession, folder: str, name: str, per_batch: int = 64) -> DataFrame:
    """A table as a stream of its files; a table of one file is picked out of its folder."""
    schema = table(spark, folder, name).schema
    at = f"{folder.rstrip('/')}/{name}.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    return source.parquet(at) if whole else source.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drives a stream over what is there and reads its output table."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/galley/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def run_batches(stream: DataFrame, name: str, each, durable: bool = False) -> None:
    """Drives a stream, handing every micro-batch to `each(batch, number)`.

    A batch may come again after a break; `each` writes it with its number into a StateTable,
    which takes a number once. A durable job goes on where its last run ended.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/galley/stream-{name}" + ("" if durable else f"-{uuid.uuid4().hex}")
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()


class Flight:
    """One run of a job at a time, and a pause between runs, for whoever starts it: a schedule or a person.

    The lock is a file of the shared folder that only one starter can create; what is skipped is counted.
    A lock older than `stale` seconds is that of a run that broke off, and is taken over.
    """

    def __init__(self, spark: SparkSession, name: str, cooldown: int = 30, stale: int = 3 * 900):
        self.spark, self.at, self.cooldown, self.stale, self.skipped = spark, f"{shared_dir(spark)}/galley-state/flight-{name}", cooldown, stale, 0

    def start(self, now: int) -> bool:
        """Whether the run may go; if so it must end with `end`."""
        fs, lock = file_system(self.spark, f"{self.at}/lock-{now}")
        folder = lock.getParent()
        fs.mkdirs(folder)
        marks = [s.getPath().getName() for s in fs.listStatus(folder)]
        at = lambda kind: [int(m.split("-")[1]) for m in marks if m.startswith(kind)]
        busy = any(now - t < self.stale for t in at("lock"))
        paused = any(0 <= now - t < self.cooldown for t in at("end"))
        if busy or paused or not fs.createNewFile(file_system(self.spark, f"{self.at}/claim-{now // max(1, self.cooldown)}")[1]):
            self.skipped += 1
            return False
        for t in at("lock"):
            fs.delete(file_system(self.spark, f"{self.at}/lock-{t}")[1], False)
        fs.create(lock, True).close()
        return True

    def end(self, started: int, now: int) -> None:
        fs, folder = file_system(self.spark, self.at)
        for s in fs.listStatus(folder):
            if s.getPath().getName().split("-")[0] in ("end", "claim"):
                fs.delete(s.getPath(), False)
        fs.create(file_system(self.spark, f"{self.at}/end-{now}")[1], True).close()
        fs.delete(file_system(self.spark, f"{self.at}/lock-{started}")[1], False)


def timed(items: DataFrame) -> DataFrame:
    """Items with their arrival as an event time and clean times: undated stay null, future ones are clamped."""
    return items.withColumn("at", F.timestamp_seconds("fetched_ts")).withColumn("published_ts", F.when(F.col("published_ts") > F.col("fetched_ts") + 300, F.col("fetched_ts")).otherwise(F.col("published_ts")))


class OnceById:
    """Append-ignore over runs: of every id the first row that came, however late it is."""

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.state = StateTable(spark, name)

    def add(self, batch: DataFrame, number: int) -> bool:
        if self.state.done(number):
            return False
        new = batch.filter("id is not null").select("id").distinct()
        return self.state.commit(number, {"ids": new.join(self.ids(), "id", "left_anti")})

    def ids(self) -> DataFrame:
        return self.state.log("ids", "id string")


def daily_counts(probes: DataFrame) -> DataFrame:
    """Tumbling daily counts of the fetch log."""
    timed_ = probes.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", "400 days")
    return timed_.groupBy(F.window("at", "1 day").alias("w"), "verdict").agg(F.count("*").alias("n"), F.sum(F.coalesce("n_new", F.lit(0))).alias("n_new"))


class AlertLog:
    """Once-only events: an alert fires once for each cluster, whatever repeats arrive, and over runs if it has a name."""

    def __init__(self, spark: SparkSession, name: str | None = None):
        self.state = StateTable(spark, name)

    def deliver(self, batch: DataFrame, number: int) -> int:
        """Adds the events (alert, cluster_id) of the batch that are new; gives their number. A repeated batch delivers nothing."""
        if self.state.done(number):
            return 0
        new = batch.select("alert", "cluster_id").distinct().join(self.delivered(), ["alert", "cluster_id"], "left_anti")
        self.state.commit(number, {"alerts": new})
        return self.state.read("alerts", ALERT).count()

    def delivered(self) -> DataFrame:
        return self.state.log("alerts", ALERT)


ALERT = "alert string, cluster_id string"


@query("R03_stream_once", "SELECT DISTINCT id FROM items WHERE id IS NOT NULL")
def stream_once(spark: SparkSession, folder: str) -> DataFrame:
    """Every id once from the stream of items, over as many triggers as it takes."""
    once = OnceById(spark)
    run_batches(read(spark, folder, "items", 4).select("id"), "once", once.add)
    return once.ids()


@query("R04_stream_clamped", "SELECT count(*) AS n, count(*) FILTER (WHERE published_ts > fetched_ts + 300) AS n_clamped, count(*) FILTER (WHERE published_ts IS NULL) AS n_undated FROM items")
def stream_clamped(spark: SparkSession, folder: str) -> DataFrame:
    raw = read(spark, folder, "items").select("id", "fetched_ts", "published_ts", F.col("published_ts").alias("given"))
    out = run(timed(raw).select("id", "published_ts", "given"), "clamped")
    return out.agg(F.count("*").alias("n"), F.count_if(F.col("given") != F.col("published_ts")).alias("n_clamped"), F.count_if(F.col("given").isNull()).alias("n_undated"))


@query("R06_once_only_alerts", "SELECT DISTINCT 'forum' AS alert, cluster_id FROM items WHERE cluster_id IS NOT NULL AND lower(trim(source_id)) LIKE '%_forum' UNION SELECT DISTINCT 'government', cluster_id FROM items WHERE cluster_id IS NOT NULL AND lower(trim(source_id)) LIKE '%_gov'")
def once_only_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Saved queries over micro-batches; an event is delivered once."""
    log = AlertLog(spark)

    def each(batch: DataFrame, number: int) -> None:
        key = source_key()
        hits = batch.filter("cluster_id is not null").select("cluster_id", F.when(key.endswith("_forum"), "forum").when(key.endswith("_gov"), "government").alias("alert")).filter("alert is not null")
        log.deliver(hits, number)

    run_batches(read(spark, folder, "items", 4).select("id", "source_id", "cluster_id"), "alerts", each)
    return log.delivered()


@query("R08_tumbling_counts", "SELECT CAST(floor(ts / 86400) AS BIGINT) AS day, verdict, count(*) AS n, sum(coalesce(n_new, 0))::BIGINT AS n_new FROM source_probes GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows: list[DataFrame] = []

    def each(batch: DataFrame, number: int) -> None:
        rows[:] = [materialize(batch, "daily")]

    spark_counts = daily_counts(read(spark, folder, "source_probes"))
    at = f"{shared_dir(spark)}/galley/stream-daily-{uuid.uuid4().hex}"
    spark_counts.writeStream.foreachBatch(each).outputMode("complete").option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    out = rows[0] if rows else spark.createDataFrame([], spark_counts.schema)
    return out.select(F.floor(F.unix_timestamp("w.start") / 86400).alias("day"), "verdict", "n", "n_new")
