"""The benchmark report over case results: totals, by type, steps, cost, latency, size classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.measures import pct
from textmill.operators import dedupe

#: Models and their list prices of input tokens, US dollars a million. Fixed values.
PRICES = [("gpt-4o", 2.50), ("claude-sonnet-4", 3.00), ("gpt-4o-mini", 0.15)]
#: The parameter of the quantile sketches (each takes some 12 KB at most) and the rank error that it allows for.
SKETCH, RANK_ERROR = 800, 0.01


def suite_totals(cases: DataFrame) -> DataFrame:
    """Sums over the cases, mean and overall percentages and, where cases say whether they were served from the store (cache_hit), the hit rate."""
    hit = [F.round(F.avg(F.col("cache_hit").cast("int")), 4).alias("hit_rate")] if "cache_hit" in cases.columns else []
    helped = (F.size("steps") > 0) & (F.col("tokens_saved") > 0)
    return cases.agg(
        F.count("*").alias("cases"), F.count_if(helped).alias("cases_helped"), F.sum("tokens_before").alias("tokens_before"),
        F.sum("tokens_after").alias("tokens_after"), F.sum("bytes_before").alias("bytes_before"), F.sum("bytes_after").alias("bytes_after"),
        F.round(F.avg(pct(F.col("tokens_saved"), F.col("tokens_before"))), 2).alias("mean_pct"), *hit,
    ).withColumn("overall_pct", F.round(100.0 * (F.col("tokens_before") - F.col("tokens_after")) / F.col("tokens_before"), 2))


def file_type_stats(cases: DataFrame) -> DataFrame:
    """A row for each kind with cases and mean percentage, best first; sums of hundredths keep the mean exact."""
    s = cases.groupBy("kind").agg(F.count("*").alias("cases"), F.sum(F.floor(F.col("tokens_saved") * 10000 / F.greatest("tokens_before", F.lit(1)))).alias("pct_points"))
    return s.withColumn("avg_points", F.floor(F.col("pct_points") / F.col("cases"))).orderBy(F.desc("avg_points"), "kind")


def top_steps(cases: DataFrame, k: int = 8) -> DataFrame:
    return cases.select(F.explode("steps").alias("step")).groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "step").limit(k)


def cost_by_provider(totals: DataFrame, prices: DataFrame) -> DataFrame:
    """totals is one row; prices a short list of fixed length."""
    usd = lambda c: F.round(F.col(c) * F.col("usd") / 1e6, 6)
    out = totals.crossJoin(F.broadcast(prices)).select("model", usd("tokens_before").alias("usd_before"), usd("tokens_after").alias("usd_after"))
    return out.withColumn("usd_saved", F.round(F.col("usd_before") - F.col("usd_after"), 6)).withColumn("pct", F.round(100 * (1 - F.col("usd_after") / F.col("usd_before")), 2))


def distinct_values(df: DataFrame, by: str, value: str, places: int = 9) -> DataFrame:
    """by, value (rounded) and how often: what a percentile needs, pre-aggregated, so that a group is as large as its distinct values."""
    return df.where(F.col(value).isNotNull()).groupBy(by, F.round(value, places).alias("v")).agg(F.count("*").alias("n"))


def latency_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """count, errors (rows without a value), mean, p50, p95, p99 and worst of each leg."""
    every = df.groupBy(by).agg(F.count(value).alias("n"), (F.count("*") - F.count(value)).alias("errors"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("worst"))
    q = lambda p: F.round(F.percentile("v", F.lit(p), F.col("n")), 6)
    p = distinct_values(df, by, value).groupBy(F.col(by).alias("of_group")).agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))
    return every.join(p, F.equal_null(F.col(by), F.col("of_group")), "left").select(by, "n", "errors", "mean", "p50", "p95", "p99", "worst")


def latency_sketches(df: DataFrame, *by: str, value: str, k: int = SKETCH) -> DataFrame:
    """A row of fixed size for each group (a day and a leg, say): n, errors, total, worst and a quantile sketch of the values; rows of more groups are merged by merged_latency()."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), (F.count("*") - F.count(value)).alias("errors"), F.sum(value).alias("total"), F.max(value).alias("worst"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged_latency(sketches: DataFrame, *by: str, k: int = SKETCH) -> DataFrame:
    """n, errors, mean, p50, p95, p99 and worst from rows of latency_sketches(): the share of values up to a quantile differs from its rank by less than RANK_ERROR."""
    m = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.sum("total").alias("total"), F.max("worst").alias("worst"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    q = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(p)))
    return m.select(*by, "n", "errors", (F.col("total") / F.nullif("n", F.lit(0))).alias("mean"), q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"), "worst")


def ranks_hold(df: DataFrame, merged: DataFrame, by: str, value: str, error: float | None = None) -> DataFrame:
    """by, and for each quantile of merged_latency() whether its rank among all values is within the error."""
    e = RANK_ERROR if error is None else error
    rows = df.select(F.col(by).alias("of_group"), F.col(value).alias("v")).where("v is not null").groupBy("of_group", "v").agg(F.count("*").alias("many"))
    j = rows.join(merged, F.equal_null(F.col("of_group"), F.col(by)))
    share = lambda when: F.sum(F.when(when, F.col("many")).otherwise(0)) / F.sum("many")
    holds = lambda p, c: (share(F.col("v") < F.col(c)) <= p + e) & (share(F.col("v") <= F.col(c)) >= p - e)
    return j.groupBy(by).agg(holds(0.5, "p50").alias("p50_holds"), holds(0.95, "p95").alias("p95_holds"), holds(0.99, "p99").alias("p99_holds"))


def overhead(stats: DataFrame, by: str, leg: str, base: str) -> DataFrame:
    """What one leg of latency_stats() takes beyond another, by measure."""
    a, b = (stats.where(F.col(by) == x).select(*[F.col(c).alias(f"{c}{k}") for c in ("mean", "p50", "p95", "p99")]) for k, x in enumerate((leg, base)))
    return a.crossJoin(b).select(*[F.round(F.col(f"{c}0") - F.col(f"{c}1"), 6).alias(c) for c in ("mean", "p50", "p95", "p99")])


def timing_stats(df: DataFrame, by: str, ms: str, size: str) -> DataFrame:
    """Median and least time of repeated runs, and the throughput of the median one."""
    s = df.groupBy(by).agg(F.min(ms).alias("least_ms"), F.sum(size).alias("bytes"), F.count("*").alias("runs"))
    m = distinct_values(df, by, ms).groupBy(F.col(by).alias("of_group")).agg(F.percentile("v", F.lit(0.5), F.col("n")).alias("median_ms"))
    s = s.join(m, F.equal_null(F.col(by), F.col("of_group")), "left").drop("of_group")
    return s.withColumn("mb_s", F.round(F.col("bytes") / F.col("runs") / 1e6 / (F.col("median_ms") / 1000), 6))


def size_classes(df: DataFrame, limit: int) -> DataFrame:
    """Texts by size; those above the limit are passed through."""
    n = F.octet_length("text")
    name = F.when(n > limit, "over_limit").when(n >= limit / 4, "large").when(n >= limit / 16, "medium").otherwise("small")
    return df.groupBy(name.alias("size_class")).agg(F.count("*").alias("n"), F.sum(n.cast("long")).alias("bytes"), F.count_if(n > limit).alias("passed_through"))


def case_table(cases: DataFrame) -> DataFrame:
    """Cases by case_id. They are checkpointed first, as a sort reads its input twice: once for the bounds of its ranges."""
    dedupe.checkpointed(cases.sparkSession)
    rows = cases.select("case_id", "kind", "tokens_before", "tokens_after", "tokens_saved", F.array_join("steps", ",").alias("steps"))
    return rows.checkpoint().orderBy("case_id")


def cold_warm(contents: DataFrame, store_path: str, fn, schema: str, passes: int = 2) -> DataFrame:
    """pass, lookups and hits of runs over the same contents (doc_id, digest, text) against a store: a content's first row computes, its repeats and later passes hit."""
    from textmill.operators.store import run_incremental

    out = None
    for k in range(1, passes + 1):
        done = run_incremental(contents, store_path, fn, schema).select("digest", "hit")
        per = done.groupBy("digest").agg(F.count("*").alias("n"), F.bool_or("hit").alias("stored"))
        one = per.agg(F.sum("n").alias("lookups"), F.sum(F.when(F.col("stored"), F.col("n")).otherwise(F.col("n") - 1)).alias("hits"))
        # the hits of a pass depend on what the store held before it, so they are settled here: one row
        row = one.first()
        one = contents.sparkSession.createDataFrame([(k, row.lookups or 0, row.hits or 0)], "pass long, lookups long, hits long")
        out = one if out is None else out.union(one)
    return out


def single_file(rows: DataFrame, path: str) -> None:
    """rows (one column, value) as one text file at path; for results of a few rows."""
    spark = rows.sparkSession
    rows.coalesce(1).write.mode("overwrite").text(f"{path}.parts")
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = fs.globStatus(fs_path(f"{path}.parts/part-*"))[0].getPath()
    fs.delete(fs_path(path), False)
    fs.rename(part, fs_path(path))
    fs.delete(fs_path(f"{path}.parts"), True)


def write_report(cases: DataFrame, out: str) -> None:
    """results.json (totals, by type), website-stats.json (totals, the five top steps, cost), report.md, and summary.csv, a folder with a row a case in order.

    None of them holds a time, so equal cases give equal files.
    """
    totals, kinds = suite_totals(cases), file_type_stats(cases)
    every = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    by_kind = every(kinds.select("kind", "cases", "avg_points"), "by_type")
    top = top_steps(cases, 5)
    steps = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "step", "n"))), lambda x: F.struct(x["step"].alias("step"), x["n"].alias("n"))).alias("top_steps"))
    prices = cases.sparkSession.createDataFrame(PRICES, "model string, usd double")
    cost = every(cost_by_provider(totals, prices), "cost")
    whole = F.struct(*totals.columns).alias("totals")
    single_file(totals.select(whole).crossJoin(by_kind).select(F.to_json(F.struct("totals", "by_type")).alias("value")), f"{out}/results.json")
    single_file(totals.select(whole).crossJoin(steps).crossJoin(cost).select(F.to_json(F.struct("totals", "top_steps", "cost")).alias("value")), f"{out}/website-stats.json")
    case_table(cases).write.mode("overwrite").option("header", True).csv(f"{out}/summary.csv")
    line = F.concat_ws(" | ", F.lit(""), "kind", F.col("cases").cast("string"), F.format_number(F.col("avg_points") / 100, 2), F.lit(""))
    rows = kinds.agg(F.array_join(F.array_sort(F.collect_list(F.trim(line))), "\n").alias("body"))
    head = F.concat(
        F.lit("# Report\n\n"), F.col("cases").cast("string"), F.lit(" cases, "), F.col("cases_helped").cast("string"), F.lit(" helped, tokens "),
        F.col("tokens_before").cast("string"), F.lit(" to "), F.col("tokens_after").cast("string"), F.lit("\n\n| type | cases | mean % |\n|---|---|---|\n"),
    )
    single_file(totals.crossJoin(rows).select(F.concat(head, "body").alias("value")), f"{out}/report.md")
