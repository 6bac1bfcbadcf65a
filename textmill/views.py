"""Views that several queries derive from the given tables, in Spark and (the strings) in DuckDB."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own in a local session; an error on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return base.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a table in fewer files than there are cores is dealt out before heavy work on its texts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dirty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, text: documents with the noise that the cleaners look for worked in by rules on doc_id."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).selectExpr("doc_id", "lang", "case when doc_id % 3 = 0 then replace(text, chr(10), concat('  ', chr(10))) else text end as u")
    d = d.selectExpr(
        "doc_id", "lang",
        "case when doc_id % 7 = 0 then concat('Requirements:', chr(10), '- ', replace(u, '. ', concat(chr(10), '- '))) "
        "when doc_id % 2 = 0 then replace(u, '. ', concat('.', chr(13), chr(10), chr(13), chr(10), chr(13), chr(10))) else u end as t",
    )
    return d.selectExpr("doc_id", "lang", "case when doc_id % 5 = 0 then concat(t, chr(10), chr(10), t) else t end as text")


DIRTY = """dirty as (select doc_id, lang, case when doc_id % 5 = 0 then concat(t, chr(10), chr(10), t) else t end as text
from (select doc_id, lang, case when doc_id % 7 = 0 then concat('Requirements:', chr(10), '- ', replace(u, '. ', concat(chr(10), '- ')))
  when doc_id % 2 = 0 then replace(u, '. ', concat('.', chr(13), chr(10), chr(13), chr(10), chr(13), chr(10))) else u end as t
  from (select doc_id, lang, case when doc_id % 3 = 0 then replace(text, chr(10), concat('  ', chr(10))) else text end as u from documents) a) b)"""


def tokens_sql(c: str) -> str:
    """The token count of functions.measures in DuckDB."""
    return rf"""coalesce(list_sum(list_transform(regexp_extract_all({c}, '''(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{Nd}}+| ?[^\s\p{{L}}\p{{M}}\p{{N}}_]+|\s+'),
    lambda p: case when trim(p, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' then 1 + (length(p) - 1) // 16 else 1 + (length(ltrim(p, ' ')) - 1) // 6 end)), 0)"""


EVENT_COLUMNS = """event_id, ts, case user_id % 3 when 0 then 'openai' when 1 then 'anthropic' else 'groq' end as provider,
  event_type <> 'error' as applied,
  case when event_type = 'error' then case k % 2 when 0 then 'content_already_optimal' else 'endpoint_not_eligible' end end as skip_reason,
  case event_type when 'click' then 'html' when 'view' then 'json' when 'purchase' then 'html,json' when 'signup' then 'text' else '' end as transformers_csv,
  case when event_type <> 'error' then 100 + 10 * k else 0 end as tokens_before,
  case when event_type <> 'error' then 40 + 3 * k else 0 end as tokens_after,
  case when event_type <> 'error' then 400 + 41 * k else 0 end as bytes_before,
  case when event_type <> 'error' then 160 + 13 * k else 0 end as bytes_after,
  case when event_type <> 'error' then 1 + k % 3 else 0 end as cache_lookups,
  case when event_type <> 'error' then k % (2 + k % 3) else 0 end as cache_hits,
  value as execution_time_ms,
  case user_id % 4 when 0 then 'api_key' when 1 then 'oauth_token' end as auth_method"""
EVENTS = f"oe as (select {EVENT_COLUMNS} from (select *, cast(json_extract_string(props, '$.k') as int) as k from events) e)"


def as_optimization_events(events: DataFrame) -> DataFrame:
    """One metadata row for each request, from raw events (a table or a stream)."""
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.selectExpr(*[c.strip() for c in split_columns(EVENT_COLUMNS)])
    return e.withColumn("transformers", F.when(F.col("transformers_csv") == "", F.array().cast("array<string>")).otherwise(F.split("transformers_csv", ",")))


def split_columns(text: str) -> list[str]:
    """The columns of a SELECT list; commas in quotes or CASE lists do not occur outside quotes here but in 'html,json'."""
    out, quoted, word = [], False, ""
    for ch in text:
        quoted ^= ch == "'"
        if ch == "," and not quoted:
            out.append(word)
            word = ""
        else:
            word += ch
    return [*out, word]


def optimization_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_optimization_events(table(spark, sf_dir, "events"))
