"""Operator 12 [native]: exact de-duplication by skew-safe combining.

DataFrame functions only. Texts are hashed once (SHA-256) into a narrow table of ids and digests. A digest
that makes up a thousandth of all rows or more is hot; there are at most ``HOT`` of them, so they are
broadcast. Then equal texts are combined in three stages, each of which groups by the text itself and so
compares whole contents:

1. locally: the map-side half of the first grouping leaves one row of a text in each input task;
2. in salted groups: rows of a hot digest are dealt to groups by the input task they come from, others have one group;
3. globally: the salts' winners of hot digests are combined; no more rows than tasks are left of a text.

Each digest is then looked up in the narrow table: hot ones by the broadcast, the others by a join in which no
key has a thousandth of the rows. A digest found to have more than one text decides nothing: its documents are
joined by their texts.

Defined cases: a null text is empty; null doc_ids count as the smallest, and stay where their group has no
other; rows that repeat the largest doc_id of a group all stay (``kept`` compares ids); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import common

#: A digest is hot if it has one row in HOT; so many groups has a hot digest.
HOT, SALTS = 1000, 1024

OP12_SQL = """with g as (
  select doc_id, coalesce(text, '') as t, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
    count(*) over (partition by coalesce(text, '')) as group_size from documents)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t) as text_sha256 from g"""


def exact_duplicates(docs: DataFrame, digits: int = 64, hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256.

    digits: how many hex digits of the SHA-256 make the digest that groups are dealt by; results do not depend on it.
    """
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.substring(F.sha2("text", 256), 1, digits)
    ids = common.materialize(text.select("doc_id", F.sha2("text", 256).alias("text_sha256")), "digests")
    ids = ids.withColumn("digest", F.substring("text_sha256", 1, digits))
    total = ids.count()
    frequent = common.materialize(ids.groupBy("digest").agg(F.count("*").alias("rows")).where(F.col("rows") * hot >= total), "frequent")

    full = text.withColumn("digest", digest)
    salt = F.when(F.col("rows").isNotNull(), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(-1)
    full = full.join(F.broadcast(frequent), "digest", "left").withColumn("salt", salt)  # hot rows at most
    winners = full.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = common.materialize(winners, "winners")
    last = winners.where("salt >= 0").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    found = winners.where("salt < 0").select("digest", "text", "keep_id", "group_size").union(last)

    by_digest = found.groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    by_digest = common.materialize(by_digest.where("texts > 1 or group_size > 1"), "groups")
    common_ones = by_digest.join(F.broadcast(frequent), "digest", "left_semi")
    rare = by_digest.join(F.broadcast(frequent), "digest", "left_anti")
    renamed = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in ("digest", "texts", "keep_id", "group_size")])
    hot_rows = renamed(common_ones, "h_")
    out = ids.join(F.broadcast(hot_rows), F.col("digest") == F.col("h_digest"), "left")  # hot rows at most
    #: A hot row needs no look-up any more, so its key is its own and makes no task large.
    key = F.when(F.col("h_texts").isNotNull(), F.concat(F.lit("-"), F.monotonically_increasing_id())).otherwise(F.col("digest"))
    out = out.withColumn("look_up", key).join(renamed(rare, "r_"), F.col("look_up") == F.col("r_digest"), "left")
    either = lambda c: F.coalesce("h_" + c, "r_" + c)
    alone = either("texts").isNull()
    out = out.withColumn("texts", F.coalesce(either("texts"), F.lit(1)))
    done = out.where("texts = 1").select("doc_id", F.when(alone, F.col("doc_id")).otherwise(either("keep_id")).alias("keep_id"), F.coalesce(either("group_size"), F.lit(1).cast("long")).alias("group_size"), "text_sha256")
    shared = by_digest.where("texts > 1").select("digest")
    if not shared.isEmpty():  # different texts of one digest: their own words decide
        mine = text.withColumn("digest", digest).join(shared, "digest", "left_semi")
        mine = mine.join(found.join(shared, "digest", "left_semi"), ["digest", "text"])
        done = done.union(mine.select("doc_id", "keep_id", "group_size", F.sha2("text", 256)))
    return done.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(common.read(spark, sf_dir, "documents"))
