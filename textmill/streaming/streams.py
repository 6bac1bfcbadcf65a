"""Streaming twins of the analytics: daily windows, totals, tallies, recent requests, reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textmill.plans import analytics
from textmill.views import as_optimization_events


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of raw events as a stream of optimization events; also how a batch is replayed.

    path is a folder or a pattern; a single file has to be given as a pattern.
    """
    schema = spark.read.parquet(path).schema
    return as_optimization_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def stream_daily(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Statistics of each UTC day by event time; a day closes once the watermark has passed it."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(*analytics.stats_columns())
    return analytics.with_derived(w.withColumn("day", F.to_date("window.start")).drop("window"))


def stream_totals(stream: DataFrame) -> DataFrame:
    return analytics.with_derived(stream.groupBy().agg(*analytics.stats_columns()))


def stream_tallies(stream: DataFrame) -> DataFrame:
    e = stream.where("applied").select(F.explode("transformers").alias("transformer"), F.floor((F.col("tokens_before") - F.col("tokens_after")) / F.size("transformers")).alias("share"))
    return e.groupBy("transformer").agg(F.count("*").alias("uses"), F.sum("share").alias("tokens_saved"))


def stream_dedupe(stream: DataFrame, text: str, late: str = "1 day") -> DataFrame:
    """The first event of each content within the watermark; repeats reuse its result."""
    return stream.withColumn("digest", F.sha2(F.col(text), 256)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["digest"])


def stream_recent(stream: DataFrame, folder: str, checkpoint: str, n: int = analytics.CAPACITY) -> StreamingQuery:
    """Keeps the n newest events in a folder, one version for each batch; the newest version is current."""

    def update(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = [] if epoch == 0 else [spark.read.schema(batch.schema).parquet(f"{folder}/v{epoch - 1}")]
        for o in old:
            batch = batch.unionByName(o)
        analytics.recent(batch, n).write.mode("overwrite").parquet(f"{folder}/v{epoch}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_optimize(stream: DataFrame, bodies: str, events: str, checkpoint: str) -> StreamingQuery:
    """Request log files in; cleaned bodies and metadata events out, each batch written once under its number."""
    from textmill.plans.optimize import optimize

    def update(batch: DataFrame, epoch: int) -> None:
        new, report = optimize(batch)
        new.write.mode("overwrite").parquet(f"{bodies}/batch={epoch}")
        report.write.mode("overwrite").parquet(f"{events}/batch={epoch}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(result: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its result as a table: each batch writes a version, the last one counts."""
    last = [-1]

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v{epoch}")
        last[0] = max(last[0], epoch)

    result.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = result.sparkSession
    return spark.read.schema(result.schema).parquet(f"{folder}/v{last[0]}") if last[0] >= 0 else spark.createDataFrame([], result.schema)


def stream_reuse(stream: DataFrame, store_path: str, fn, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Each batch of (…, digest, text) against the stored results: what is known is joined, what is new is computed and appended."""
    from textmill.operators.store import run_incremental

    def update(batch: DataFrame, epoch: int) -> None:
        run_incremental(batch, store_path, fn, schema).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_folder(result: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs an append-only stream over what is there into Parquet files and returns them as a table; for results that grow."""
    q = result.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(folder)
