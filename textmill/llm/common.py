"""Helpers shared by the corpus operators: shared storage, row keys, Arrow batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space, in Java's and Python's regex dialects.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handled in runs of about this many bytes, so that numpy temporaries stay small.
RUN_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own in a local session; an error on a cluster that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("textmill.own.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("textmill.own.dir", base)
    return base.rstrip("/") + "/textmill"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.textmill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table that materialize() wrote and that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.textmill_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about limit; a larger row is alone in its range."""
    lo, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def text_runs(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about limit bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for lo, hi in runs(sizes, limit):
        yield batch.slice(lo, hi - lo)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column laid end to end, and where each row starts (one more entry at the end)."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = pc.fill_null(column.cast(kind), b"")
    _, offsets, data = column.buffers()
    wide = np.int64 if kind == pa.large_binary() else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", scale: int = 1) -> DataFrame:
    """df through fn in Arrow batches of about scale times RUN_BYTES of text."""
    limit = scale * RUN_BYTES

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_runs(batch, column, limit):
                yield fn(part)

    return df.mapInArrow(each, schema)


def components(edges: DataFrame, kind: str = "long") -> DataFrame:
    """node, component: the smallest node reachable over edges(a, b); only nodes that have an edge.

    Alternating large-star and small-star rounds (Kiveris et al.), each written to the shared folder;
    the number of rounds grows with the logarithm of the longest chain. Minima are pre-aggregated, so a
    node with very many neighbours is no larger in a task than any other.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    size = -1
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = new.count()
        same = now == size and new.join(e, ["u", "v"], "left_anti").isEmpty()
        discard(e)
        e, size = new, now
        if same:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), id (a null doc_id counts as the smallest) and th, a 64-bit hash of the text."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("th"))


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held and any(held[0].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.concat_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)
