"""A corpus pipeline of five stages, each a Spark job over all that the stage before kept.

Language ID drops documents without a recognised language; near-duplicate removal keeps one document
of each group (five-word shingles, similarity 0.8); secrets are replaced by their kind in brackets;
mixing repeats, keeps, cuts or drops documents so that sources reach their target weights, in blocks by highest quotients; and byte-level
BPE gives the token ids, checked by decoding.

Defined cases: a null text has no language and goes in the first stage; rows with a null doc_id pass
near-duplicate removal unlinked; rows that share a doc_id are one document there and stay or go together;
extra columns are dropped by the first stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import bpe, common, language, minhash, mixing, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language scores below this fits none of the learned ones.
LEAST_SCORE = 0.05
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.predict(docs, language.train(docs), keep=tuple(COLUMNS[1:]))
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.scan_secrets(docs, keep=("lang", "source"))
    return clean.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document of which the mix takes more words than it has comes out repeated, the last time cut to what is left."""
    taken = mixing.mix(docs, keep=("text", "lang")).where("taken > 0")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size"))))
    left = lambda: F.least(F.col("size"), F.col("taken") - F.col("part") * F.col("size"))
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.slice(words, F.lit(1), left().cast("int")), "")
    text = F.when(left() == F.col("size"), F.col("text")).otherwise(cut)
    out = taken.withColumn("part", part).withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, name)
    return docs
