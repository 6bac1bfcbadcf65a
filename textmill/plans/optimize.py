"""The whole chain: requests to segments, classification, cleaning, measures, new bodies, reports and events."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.measures import cache_status, never_grow, sealed, token_count, with_savings
from textmill.functions.json_text import compact_json
from textmill.functions.text import decode_text, normalize_text
from textmill.operators import dedupe, detect, pages, policy, segments, tables
from textmill.operators.rules import Rules

NONE = "array<string>"


def by_content(rows: DataFrame, fn, key: str) -> DataFrame:
    """rows with cleaned and steps from fn, which maps (key, text) of distinct texts to (key, cleaned, steps)."""
    keyed = rows.drop("cleaned", "steps").withColumn(key, F.sha2("text", 256))
    done = fn(keyed.groupBy(key).agg(F.first("text").alias("text")))
    return keyed.join(done, key).drop(key)


def clean(contents: DataFrame, prompts: bool = False, csv: bool = False, rules: Rules | None = None, html: bool = True, prune: bool = False) -> DataFrame:
    """Rows with text, classified, cleaned by the rule of their type, measured, growth undone (the preview of a content).

    Texts and JSON are cleaned in place. Pages, and prompts if these are asked for, take several steps over
    their blocks, once for each distinct text; html says that there may be pages, prune takes empty containers out of JSON. A rule that is registered for a type comes before the built-in
    cleaner if its priority is lower than 100.
    """
    d = detect.detect(contents, prompts=prompts, csv=csv, extra=rules.detectors() if rules else None)
    d = d.withColumn("transformer", rules.route(F.col("content_type")) if rules else detect.route(F.col("content_type")))
    empty, kind = F.array().cast(NONE), F.col("transformer")
    many = ["html"] * html + ["prompt"] * prompts
    plain = (d.where(kind.isNull() | ~kind.isin(many)) if many else d).withColumn("prose", F.when(kind == "text", F.col("text")))
    plain = normalize_text(plain, "prose").drop("prose")
    plain = sealed(plain.withColumn("small", F.when(kind == "json", compact_json(F.col("text"), prune))), "small")
    if csv:
        plain = sealed(plain.withColumn("delimiter", F.when(kind == "csv", detect.csv_delimiter(F.col("text")))), "delimiter")
    table = tables.csv_to_markdown(F.col("text"), F.col("delimiter")) if csv else F.lit(None).cast(f"struct<cleaned:string,steps:{NONE}>")
    plain = sealed(plain.withColumn("table", F.when(kind == "csv", table)), "table").drop("delimiter")
    steps = F.when(kind == "json", F.col("small.steps")).when(kind == "text", F.col("steps")).when(kind == "csv", F.coalesce("table.steps", empty)).otherwise(empty)
    cleaned = F.when(kind == "json", F.col("small.cleaned")).when(kind == "text", F.col("cleaned")).when(kind == "csv", F.coalesce("table.cleaned", "text")).otherwise(F.col("text"))
    plain = plain.withColumn("steps", steps).withColumn("cleaned", cleaned).drop("table", "small")
    if rules:
        plain = rules.apply_named(plain, "transformer")
    parts = [plain]
    if html:
        parts.append(by_content(d.where(kind == "html"), lambda t: pages.pages_to_markdown(t, "text", "page_key"), "page_key"))
    if prompts:
        parts.append(by_content(d.where(kind == "prompt"), lambda t: dedupe.dedupe_prompts(t.withColumnRenamed("prompt_key", "doc_id")).withColumnRenamed("doc_id", "prompt_key"), "prompt_key"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.withColumn("tokens_before", token_count(F.col("text"))).withColumn("tokens_after", token_count(F.col("cleaned")))
    return with_savings(never_grow(out))


def results(segs: DataFrame, prompts: bool = False, csv: bool = False, rules: Rules | None = None, prune: bool = False) -> DataFrame:
    """One result for each segment: each distinct text is cleaned once and joined back; repeats are cache hits.

    The distinct texts are checkpointed, as several cleaners read them; without a tag in any, none is a page.
    """
    dedupe.checkpointed(segs.sparkSession)
    keyed = segs.withColumn("digest", F.sha2("text", 256))
    order = F.struct("request_id", "seg_ix", "part_ix")
    once = keyed.groupBy("digest").agg(F.min(order).alias("first"), F.first("text").alias("text"))
    once = once.checkpoint()
    tagged = rules is not None or not once.where(F.contains("text", F.lit("<"))).isEmpty()
    done = clean(once, prompts, csv, rules, tagged, prune).drop("text")
    return keyed.join(done, "digest").withColumn("cache_hit", order != F.col("first")).drop("first")


def document_texts(docs: DataFrame, limit: int = policy.MAX_DOCUMENT) -> DataFrame:
    """docs (data, media_type, filename) with format, detail (why not, or null) and, of those that can be read, text, steps and tokens before (of the base64 form) and after.

    A document of which the text is no shorter than its base64 form, in tokens, stays as it is: its detail is
    no_gain. Tables become Markdown, pages too; PDF and office files have no extractor here.
    """
    d = docs.withColumn("format", detect.detect_format(F.col("data"), F.col("media_type"), F.coalesce("filename", F.lit(""))))
    d = policy.document_eligibility(d, limit=limit)
    raw = F.when(F.col("detail").isNull(), decode_text(F.col("data")))
    d = normalize_text(d.withColumn("raw", raw), "raw").drop("steps")
    d = sealed(d, "format", "detail", "raw", "cleaned")
    d = sealed(d.withColumn("delimiter", F.coalesce(detect.csv_delimiter(F.col("cleaned")), F.lit(","))), "delimiter")
    d = sealed(d.withColumn("table", F.when(F.col("format") == "csv", tables.csv_to_markdown(F.col("cleaned"), F.col("delimiter")))), "table")
    d = d.withColumn("text", F.coalesce("table.cleaned", "cleaned")).drop("cleaned", "table", "delimiter")
    page = by_content(d.where("format = 'html' and detail is null").withColumn("text", F.col("raw")), lambda t: pages.pages_to_markdown(t, "text", "page_key"), "page_key")
    d = d.where("format <> 'html' or detail is not null").drop("raw").unionByName(page.drop("raw", "steps").withColumn("text", F.col("cleaned")).drop("cleaned"))
    d = d.withColumn("tokens_before", token_count(F.base64("data"))).withColumn("tokens_after", token_count(F.col("text")))
    d = d.withColumn("detail", F.when(F.col("detail").isNull() & (F.col("tokens_after") >= F.col("tokens_before")), "no_gain").otherwise(F.col("detail")))
    return d.withColumn("text", F.when(F.col("detail").isNull(), F.col("text"))).withColumn("steps", F.when(F.col("detail").isNull(), F.array(F.lit("extracted_document"), F.concat(F.lit("format_"), "format"))).otherwise(F.array().cast(NONE)))


def as_results(docs: DataFrame) -> DataFrame:
    """document_texts() rows that were read, in the columns of results() that reports need."""
    n = F.octet_length(F.base64("data")).cast("long")
    after = F.octet_length("text").cast("long")
    return docs.where("detail is null").select(
        "request_id", "seg_ix", "part_ix", F.col("format").alias("content_type"), F.lit("document").alias("transformer"), "steps", "tokens_before", "tokens_after",
        n.alias("bytes_before"), after.alias("bytes_after"), F.lit(True).alias("changed"), F.lit(False).alias("cache_hit"),
    )


def request_report(res: DataFrame) -> DataFrame:
    """A row for each request: sums, transformers of changed segments, content types of all, cache hits, whether anything changed."""
    return res.groupBy("request_id").agg(
        F.count("*").alias("segments"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"),
        F.sum("bytes_before").alias("bytes_before"), F.sum("bytes_after").alias("bytes_after"),
        F.array_sort(F.collect_set(F.when(F.col("changed"), F.col("transformer")))).alias("transformers"), F.array_sort(F.collect_set("content_type")).alias("content_types"),
        F.count_if("cache_hit").alias("cache_hits"), F.bool_or("changed").alias("applied"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg_ix", "part_ix", "steps"))), lambda x: x["steps"]))).alias("steps"),
    )


def shared_time(res: DataFrame, elapsed_ms: float) -> DataFrame:
    """request_id and execution_time_ms: the time of a job that cleaned all texts at once, shared out by the bytes that were cleaned for each request; hits cost nothing."""
    work = F.when(F.col("cache_hit"), 0).otherwise(F.greatest("bytes_before", F.lit(1)))
    per = res.groupBy("request_id").agg(F.sum(work).alias("work"))
    total = per.agg(F.sum("work")).first()[0] or 1
    return per.select("request_id", (F.col("work") * F.lit(elapsed_ms) / F.lit(total)).alias("execution_time_ms"))


def to_events(requests: DataFrame, report: DataFrame, skips: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """A metadata event for each request, with no content in it.

    requests: request_id, path and, if there, ts, provider and auth_method; skips: request_id and skip_reason.
    Requests that went through no report count nothing and took no time. times: see shared_time().
    """
    given = lambda c, kind: F.col(c) if c in requests.columns else F.lit(None).cast(kind)
    base = requests.select("request_id", given("ts", "timestamp").alias("ts"), given("provider", "string").alias("provider"), policy.path_of(F.col("path")).alias("endpoint"), given("auth_method", "string").alias("auth_method"))
    j = base.join(report, "request_id", "left").join(skips.where("skip_reason is not null"), "request_id", "left")
    for c in ("segments", "tokens_before", "tokens_after", "bytes_before", "bytes_after", "cache_hits"):
        j = j.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    for c in ("transformers", "content_types", "steps"):
        j = j.withColumn(c, F.coalesce(c, F.array().cast(NONE)))
    j = j.withColumn("applied", F.coalesce("applied", F.lit(False))).withColumn("cache_lookups", F.col("segments"))
    j = j.join(times, "request_id", "left").withColumn("execution_time_ms", F.coalesce("execution_time_ms", F.lit(0.0))) if times is not None else j.withColumn("execution_time_ms", F.lit(0.0))
    return j.withColumn("event_id", F.col("request_id")).withColumn("cache_status", cache_status(F.col("cache_hits"), F.col("segments")))


def optimize(requests: DataFrame, least: int = 0, prompts: bool = False, csv: bool = False, documents: bool = True, rules: Rules | None = None, prune: bool = False) -> tuple[DataFrame, DataFrame]:
    """(request_id, new_body and any_changed of the requests that policy lets through, an event for each request).

    Results are checkpointed, as bodies, reports and reasons all read them: each text is cleaned once.
    """
    dedupe.checkpointed(requests.sparkSession)
    decided = policy.policy_decide(requests)
    go = segments.parsed(decided.where("optimize").drop("skip_reason", "optimize", "model"))
    segs = segments.segments(go, least)
    began = time.monotonic()
    res = results(segs, prompts, csv, rules, prune).checkpoint()
    texts, every = None, res
    found = segments.document_segments(go.where(F.contains("body", F.lit("base64"))))
    if documents and not found.isEmpty():
        texts = document_texts(found).checkpoint()
        every = res.select(*as_results(texts).columns).union(as_results(texts))
        texts = texts.where("detail is null")
    times = shared_time(every, 1000 * (time.monotonic() - began))
    new = segments.reassemble(go, res, texts)
    later = segments.skip_reason(go, segs, every)
    skips = decided.where("not optimize").select("request_id", "skip_reason").union(later.where("skip_reason is not null"))
    return new, to_events(requests, request_report(every), skips, times)

