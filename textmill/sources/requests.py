"""Request logs, payload assembly, event logs, binary documents and delimited files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "request_id string, method string, path string, content_type string, body string"


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines request log with malformed: whether a body is no JSON object."""
    r = spark.read.schema(REQUEST).json(path)
    return r.withColumn("v", F.try_parse_json("body")).withColumn("malformed", ~F.coalesce(F.expr("schema_of_variant(v) like 'OBJECT%'"), F.lit(False))).drop("v")


def conversations_to_requests(turns: DataFrame, model: str = "gpt-4o") -> DataFrame:
    """One chat request for each conversation: turns in order as messages; the path depends on conv_id."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    r = turns.groupBy("conv_id").agg(m.alias("messages"))
    path = F.expr("case conv_id % 4 when 0 then 'v1/chat/completions' when 1 then 'v1/messages' when 2 then 'v1/responses' else 'v1/embeddings' end")
    key = F.when(F.col("conv_id") % 4 == 2, F.to_json(F.struct(F.lit(model).alias("model"), F.col("messages").alias("input")))).otherwise(F.to_json(F.struct(F.lit(model).alias("model"), "messages")))
    return r.select(F.col("conv_id").alias("request_id"), F.lit("POST").alias("method"), path.alias("path"), F.lit("application/json").alias("content_type"), F.lit(model).alias("model"), key.alias("body"))


def write_events(events: DataFrame, path: str) -> None:
    """Appends metadata rows, a folder for each day."""
    events.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, media_type (by extension) and data of binary files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    media = F.when(ext == "pdf", "application/pdf").when(ext == "csv", "text/csv").when(ext.isin("html", "htm"), "text/html").when(ext == "json", "application/json").when(ext == "xml", "application/xml").when(ext.isin("txt", "md"), "text/plain")
    return f.select("path", name.alias("filename"), media.alias("media_type"), F.col("content").alias("data"))


def read_cases(spark: SparkSession, manifest: str, root: str, project: str | None = None) -> DataFrame:
    """The cases of a manifest with their files' texts, sorted by id; project filters without regard to case."""
    cases = spark.read.option("multiLine", True).json(manifest).select(F.explode("cases").alias("c")).select("c.*")
    if project:
        cases = cases.where(F.lower("project") == project.lower())
    files = spark.read.text(f"{root}/*", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.col("value").alias("text"))
    return cases.join(files, "file").orderBy("id")


def read_table_auto(spark: SparkSession, path: str) -> DataFrame:
    """Delimited files with a header, the delimiter inferred from the first lines of the first file."""
    from textmill.operators.tables import infer_delimiter

    # a file's parts are ordered by where they start, and lines within a part by their number
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("ix"), F.col("value").alias("line"))
    first = lines.where(F.col("ix.start") == 0).agg(F.min("file")).first()[0]
    sep = infer_delimiter(lines.where((F.col("file") == first) & (F.col("ix.start") == 0))).first() if first else None
    return spark.read.option("header", True).option("sep", sep.delimiter if sep else ",").csv(path)


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """An XML file as rows, one for each element of a name."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)
