"""Optimization analytics: window statistics, tallies, recent requests, cost, views for people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.measures import cache_status, cost, pct
from textmill.functions.text import humanize_step

CAPACITY = 100


def stats_columns() -> list[Column]:
    """Token sums over applied requests only; cache and latency over all."""
    applied = lambda c: F.coalesce(F.sum(F.when(F.col("applied"), F.col(c))), F.lit(0)).cast("long")
    return [
        F.count("*").alias("requests"),
        F.count_if("applied").alias("optimized"),
        F.count_if(~F.col("applied")).alias("skipped"),
        applied("tokens_before").alias("tokens_before"),
        applied("tokens_after").alias("tokens_after"),
        applied("bytes_before").alias("bytes_before"),
        applied("bytes_after").alias("bytes_after"),
        F.sum("cache_hits").cast("long").alias("cache_hits"),
        F.sum(F.greatest(F.lit(0), F.col("cache_lookups") - F.col("cache_hits"))).cast("long").alias("cache_misses"),
        F.sum(F.round(F.col("execution_time_ms") * 1000).cast("long")).alias("latency_us"),
    ]


def with_derived(stats: DataFrame) -> DataFrame:
    """tokens_saved, token_pct, hit_rate and avg_latency_us, zero-safe."""
    looked = F.col("cache_hits") + F.col("cache_misses")
    return (
        stats.withColumn("tokens_saved", F.col("tokens_before") - F.col("tokens_after"))
        .withColumn("token_pct", pct(F.col("tokens_before") - F.col("tokens_after"), F.col("tokens_before")))
        .withColumn("bytes_saved", F.col("bytes_before") - F.col("bytes_after"))
        .withColumn("hit_rate", F.when(looked > 0, F.round(F.col("cache_hits") / looked, 4)).otherwise(F.lit(0.0)))
        .withColumn("avg_latency_us", F.when(F.col("requests") > 0, F.floor(F.col("latency_us") / F.col("requests"))).otherwise(0))
    )


def window_stats(events: DataFrame, *by: str) -> DataFrame:
    return with_derived(events.groupBy(*by).agg(*stats_columns()))


def window_stats_rollup(events: DataFrame) -> DataFrame:
    """A row for each UTC day and one (day null) for all time, from one aggregation."""
    return with_derived(events.withColumn("day", F.to_date("ts")).rollup("day").agg(*stats_columns()))


def transformer_tallies(events: DataFrame) -> DataFrame:
    """For each transformer the applied requests that used it and its share of the tokens they saved."""
    n = F.size("transformers")
    e = events.where("applied").select(F.explode("transformers").alias("transformer"), F.floor((F.col("tokens_before") - F.col("tokens_after")) / n).alias("share"), "ts", "event_id")
    return e.groupBy("transformer").agg(F.count("*").alias("uses"), F.sum("share").alias("tokens_saved"), F.min(F.struct("ts", "event_id")).alias("first_seen"))


def top_transformer(events: DataFrame) -> DataFrame:
    """The transformer that saved most; at a tie the one seen first."""
    return transformer_tallies(events).orderBy(F.desc("tokens_saved"), "first_seen").limit(1).select("transformer", "uses", "tokens_saved")


def recent(events: DataFrame, n: int = 20) -> DataFrame:
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(1, min(n, CAPACITY)))


def last_event(events: DataFrame) -> DataFrame:
    return events.agg(F.max_by(F.struct("*"), F.struct("ts", "event_id")).alias("e")).select("e.*")


def with_cost(stats: DataFrame, rate: float) -> DataFrame:
    return stats.withColumn("saved_usd", cost(F.col("tokens_saved"), rate))


def provider_observations(events: DataFrame, last: int = CAPACITY) -> DataFrame:
    """Of the last requests: for each provider how many, whether any was applied, and the latest known kind of credentials."""
    e = recent(events, last)
    return e.groupBy("provider").agg(
        F.count("*").alias("seen"), F.bool_or("applied").alias("any_applied"),
        F.max(F.when(F.col("auth_method").isNotNull(), F.struct("ts", "event_id", "auth_method"))).alias("a"),
    ).select("provider", "seen", "any_applied", F.col("a.auth_method").alias("auth_method"))


def skip_breakdown(events: DataFrame) -> DataFrame:
    return events.where("not applied").groupBy("skip_reason").agg(F.count("*").alias("skipped"))


def explain(events: DataFrame) -> DataFrame:
    """The latest request's steps as people read them, in order, with what it saved and its cache status."""
    e = last_event(events).withColumn("cache_status", cache_status(F.col("cache_hits"), F.col("cache_lookups")))
    e = e.withColumn("tokens_saved", F.col("tokens_before") - F.col("tokens_after"))
    return e.select("event_id", "cache_status", "tokens_saved", F.posexplode_outer("transformers").alias("ix", "step")).withColumn("label", humanize_step(F.col("step")))


def stats_view(events: DataFrame) -> DataFrame:
    """The latest day and all time side by side, a row for each measure."""
    r = window_stats_rollup(events)
    names = ["requests", "optimized", "skipped", "tokens_before", "tokens_after", "tokens_saved", "bytes_saved", "cache_hits", "cache_misses"]
    long = r.select("day", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("long").alias("v")) for n in names])).alias("m"))
    latest = Window.partitionBy("m.measure").orderBy(F.desc_nulls_last("day"))
    ranked = long.withColumn("rn", F.row_number().over(latest))
    return ranked.groupBy(F.col("m.measure").alias("measure")).agg(
        F.max(F.when(F.col("rn") == 1, F.col("m.v"))).alias("today"), F.max(F.when(F.col("day").isNull(), F.col("m.v"))).alias("all_time")
    )
