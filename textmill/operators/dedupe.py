"""Exact duplicates within texts and across a corpus, as explode and window jobs keyed by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions.measures import sealed
from textmill.functions.text import normalize_text
from textmill.views import shared_folder

#: What opens a fence, a list item and a section. Fixed values.
FENCE = r"^\s{0,3}(?:```+|~~~+)"
ITEM = r"^\s*(?:[-*+]|\d+[.)])\s+\S"
HEADING = r"^\s{0,3}#{1,6}\s+\S|^[A-Za-z][A-Za-z0-9 _/&-]{0,40}:\s*$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s++|(?<!\s)\s++$", "")


def lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ix, line, and is_fence, in_fence, is_item, is_heading and heading (the last one above or at the line); and the columns in keep."""
    rows = docs.select("doc_id", *keep, F.posexplode(F.split(text, "\n", -1)).alias("ix", "line"))
    upto = Window.partitionBy("doc_id").orderBy("ix")
    rows = rows.withColumn("is_fence", F.col("line").rlike(FENCE)).withColumn("fences", F.sum(F.col("is_fence").cast("int")).over(upto))
    rows = rows.withColumn("in_fence", (F.col("fences") % 2 == 1) | F.col("is_fence"))
    rows = rows.withColumn("is_heading", ~F.col("in_fence") & F.col("line").rlike(HEADING)).withColumn("is_item", ~F.col("in_fence") & ~F.col("is_heading") & F.col("line").rlike(ITEM))
    return rows.withColumn("heading", F.coalesce(F.last(F.when(F.col("is_heading"), strip(F.col("line"))), ignorenulls=True).over(upto), F.lit(""))).drop("fences")


def repeated_items(rows: DataFrame) -> DataFrame:
    """rows of lines() with again: a list item that stood, stripped, under the same heading before."""
    first = F.row_number().over(Window.partitionBy("doc_id", "heading", "is_item", strip(F.col("line"))).orderBy("ix"))
    return rows.withColumn("n", first).withColumn("again", F.col("is_item") & (F.col("n") > 1)).drop("n")


def dedupe_list_items(docs: DataFrame) -> DataFrame:
    """Lines without a list item that stood, stripped, under the same heading before; fences untouched."""
    return repeated_items(lines(docs)).where("not again").drop("again")


def blocks(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, block, body and first: blocks of lines() rows split at blank lines; a fenced block is one."""
    blank = ~F.col("in_fence") & (strip(F.col("line")) == "")
    upto = Window.partitionBy("doc_id").orderBy("ix")
    rows = rows.withColumn("blank", blank).withColumn("block", F.sum(F.col("blank").cast("int")).over(upto)).where(~F.col("blank"))
    line = F.struct("ix", F.regexp_replace("line", r"(?<!\s)\s++$", "").alias("key"), "line", "is_item", "is_heading")
    b = rows.groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(line)).alias("lines"), *[F.first(c).alias(c) for c in keep])
    return b.select(
        "doc_id", "block", *keep, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("body"),
        F.array_join(F.transform("lines", lambda x: x["key"]), "\n").alias("key"),
        F.forall("lines", lambda x: x["is_item"]).alias("items_only"), (F.size("lines") == 1).alias("single"),
        F.when(F.element_at("lines", 1)["is_heading"], strip(F.element_at("lines", 1)["line"])).alias("opens"),
    )


def repeated_blocks(b: DataFrame) -> DataFrame:
    """blocks() with gone: equal to an earlier one, but for those of list items alone; a bare heading if it was there before."""
    again = F.row_number().over(Window.partitionBy("doc_id", "items_only", "key").orderBy("block")) > 1
    bare = F.col("single") & F.col("opens").isNotNull()
    claimed = F.min(F.when(~F.col("repeat") | bare, F.col("block"))).over(Window.partitionBy("doc_id", "opens")) < F.col("block")
    b = b.withColumn("repeat", ~F.col("items_only") & again).withColumn("claimed", F.when(bare, claimed).otherwise(F.lit(False)))
    return b.withColumn("gone", F.when(bare, F.col("claimed")).otherwise(F.col("repeat")))


def dedupe_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, block, body of the blocks kept: the first of equal ones, list-only ones all, a bare heading only if new."""
    return repeated_blocks(blocks(lines(docs))).where("not gone").select("doc_id", "block", "body")


def repeated_sentences(rows: DataFrame) -> DataFrame:
    """rows of lines() with line without sentences that equal the one before them, and changed; fences, code, items and headings stay."""
    parts = F.split("line", r"(?<=[.!?])\s+", -1)
    keep = lambda x, i: (i == 0) | (x != F.element_at(F.col("parts"), F.greatest(i, F.lit(1)))) | (x == "")
    rows = rows.withColumn("parts", parts).withColumn("own_parts", F.filter("parts", keep))
    eligible = ~F.col("in_fence") & ~F.col("is_item") & ~F.col("is_heading") & ~F.contains("line", F.lit("`"))
    rows = rows.withColumn("changed", eligible & (F.size("own_parts") < F.size("parts")))
    return rows.withColumn("line", F.when(F.col("changed"), F.array_join("own_parts", " ")).otherwise(F.col("line"))).drop("parts", "own_parts")


def dedupe_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, ix, line: within a line, a sentence equal to the one before it goes; fences, code, items and headings stay."""
    return repeated_sentences(lines(docs)).select("doc_id", "ix", "line", "changed")


def rejoined(rows: DataFrame, ix: str, line: str, sep: str, gone: str | None, fired: str, name: str, keep: tuple[str, ...]) -> DataFrame:
    """doc_id, text, the columns in keep and own with name appended if a row of a document fired; rows that are gone are left out."""
    each = F.struct(ix, line) if gone is None else F.when(~F.col(gone), F.struct(ix, line))
    out = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x[line]), sep).alias("text"), *[F.first(c).alias(c) for c in (*keep, "own")], F.bool_or(fired).alias("fired"))
    return out.withColumn("own", F.when(F.col("fired"), F.concat("own", F.array(F.lit(name)))).otherwise(F.col("own"))).drop("fired")


def checkpointed(spark: SparkSession) -> None:
    """Sets the session's checkpoint folder where none is set; on a cluster spark.checkpoint.dir has to name one that all executors share."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def may_repeat(c: Column) -> Column:
    """Whether a round could remove something from a text (line ends are newlines): a stripped line that stands twice, a sentence twice in a line, or a fence.

    Equal items, blocks and headings begin with equal lines, so a text without any of these loses nothing.
    """
    rows = F.split(c, "\n", -1)
    keys = F.filter(F.transform(rows, strip), lambda x: x != "")
    twice = lambda x: F.size(x) > F.size(F.array_distinct(x))
    sentences = F.exists(rows, lambda x: twice(F.split(x, r"(?<=[.!?])\s+", -1)))
    return F.coalesce(F.contains(c, F.lit("```")) | F.contains(c, F.lit("~~~")) | twice(keys) | sentences, F.lit(False))


def one_blank_line(c: Column) -> Column:
    """What a round makes of a text without a fence that loses nothing: its blocks with one empty line between, blank lines at its ends gone."""
    blank = r"[ \t\x0B\f\r]*+"
    c = F.regexp_replace(F.regexp_replace(c, rf"\A(?:{blank}\n)++", ""), rf"\n(?:{blank}\n)++", "\n\n")
    c = F.regexp_replace(c, rf"(?:\n{blank})++\z", "")
    return F.when(c.rlike(rf"\A{blank}\z"), "").otherwise(c)


def dedupe_prompts(docs: DataFrame) -> DataFrame:
    """doc_id, cleaned, steps: list items, blocks and sentences until nothing changes, then normalisation; each step is named once, where it first fired.

    Documents in which nothing can go (see may_repeat) take no round. Of the others, only documents that the
    last round changed go into the next one; each round is cut by a checkpoint in the folder that the session names. A round that changes a document removes a line, block or sentence of
    it, so the rounds end.
    """
    checkpointed(docs.sparkSession)
    none = F.array().cast("array<string>")
    every = docs.select("doc_id", F.col("text").alias("before"), F.regexp_replace("text", "\r\n|\r", "\n").alias("text"))
    every = sealed(every.withColumn("rounds", may_repeat(F.col("text"))), "rounds")
    live = every.where("rounds").select("doc_id", "text", none.alias("seen"))
    first = every.where("rounds").select(F.col("doc_id").alias("d"), "before")
    plain = every.where("not rounds").select("doc_id", "before", one_blank_line(F.col("text")).alias("text"), none.alias("seen"))
    keep, done = ("seen",), None
    while True:
        own = live.withColumn("own", none)
        a = rejoined(repeated_items(lines(own, keep=("seen", "own"))), "ix", "line", "\n", "again", "again", "removed_duplicate_list_items", keep)
        b = rejoined(repeated_blocks(blocks(lines(a, keep=("seen", "own")), ("seen", "own"))), "block", "body", "\n\n", "gone", "gone", "removed_duplicate_blocks", keep)
        c = rejoined(repeated_sentences(lines(b, keep=("seen", "own"))), "ix", "line", "\n", None, "changed", "removed_duplicate_sentences", keep)
        step = c.checkpoint().select("doc_id", "text", F.array_distinct(F.concat("seen", "own")).alias("seen"), (F.size("own") > 0).alias("more"))
        ended = step.where("not more").drop("more")
        done = ended if done is None else done.union(ended)
        live = step.where("more").drop("more")
        if live.isEmpty():
            break
    # a document of blank lines alone has no block and does not come back from the rounds
    done = first.join(done, F.col("doc_id") == F.col("d"), "left").select(F.col("d").alias("doc_id"), "before", F.when(F.col("before").isNotNull(), F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("seen", none).alias("seen"))
    out = normalize_text(plain.union(done)).withColumn("steps", F.concat("seen", "steps"))
    return out.select("doc_id", "cleaned", F.when(F.equal_null(F.col("cleaned"), F.col("before")), none).otherwise(F.col("steps")).alias("steps"))


def dedupe_exact(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each distinct content, the one of the lowest key, with its copies counted; pre-aggregated by digest."""
    d = df.withColumn("digest", F.sha2(F.col(text), 256))
    return d.groupBy("digest").agg(F.min(key).alias(key), F.count("*").alias("copies"))


def duplicate_line_ratio(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (not blank) and n_repeats: lines that equal, stripped, an earlier one."""
    key = F.filter(F.transform(F.split("text", "\n", -1), strip), lambda x: x != "")
    return docs.select("doc_id", F.size(key).alias("n_lines"), (F.size(key) - F.size(F.array_distinct(key))).alias("n_repeats"))
