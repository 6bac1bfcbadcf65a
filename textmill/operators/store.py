"""Content-addressed results: keys, compute once, incremental runs, expiry, eviction, statistics, drift."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
MAX_ENTRIES, MAX_BYTES = 2048, 128 << 20
#: What stands for a null part of a key.
NOTHING = "\x1e"
#: Hex digits of the digest by which a store's rows are dealt to folders, and how often a writer tries to commit.
PREFIX, TRIES = 2, 20
#: The end of an entry of a store's log.
WHOLE = "."


def digest(content: Column, rules: str, options: str, version: str = "1", kind: str = "text", encoding: str = "heuristic", qualifier: Column | str = "") -> Column:
    """The key of a result: everything that it depends on, joined by unit separators and hashed."""
    q = F.lit(qualifier) if isinstance(qualifier, str) else qualifier
    parts = [F.lit(kind), F.sha2(content, 256), F.lit(rules), F.lit(version), F.lit(options), F.lit(encoding), q]
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit(NOTHING)) for p in parts]), 256)


def fingerprint(rules: list[tuple[str, str]]) -> str:
    """16 hex digits that change with any rule's name or version, not with their order."""
    return hashlib.sha256(";".join(sorted(f"{n}@{v}" for n, v in rules)).encode()).hexdigest()[:16]


def options_fingerprint(options: dict) -> str:
    return hashlib.sha256(json.dumps(options, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def fingerprint_table(rules: DataFrame) -> DataFrame:
    """The fingerprint of a table of (name, version)."""
    joined = F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("@"), "version"))), ";")
    return rules.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


def compute_distinct(df: DataFrame, text: str, fn: Callable[[DataFrame], DataFrame], order: str) -> DataFrame:
    """fn once for each distinct content, joined back; cache_hit marks all rows but a content's first by ``order``.

    fn maps a table of (digest, text) to one with the digest and its results.
    """
    keyed = df.withColumn("digest", F.sha2(F.col(text), 256))
    once = keyed.groupBy("digest").agg(F.min(order).alias("first_id"), F.first(text).alias("text"))
    results = fn(once.select("digest", "text")).join(once.select("digest", "first_id"), "digest")
    return keyed.join(results.drop("text"), "digest").withColumn("cache_hit", F.col(order) != F.col("first_id")).drop("first_id")


def valid(store: DataFrame) -> DataFrame:
    """Rows of the current schema that are whole; others count as misses."""
    whole = F.lit(True)
    for c in store.columns:
        whole &= F.col(c).isNotNull()
    return store.where((F.col("schema_version") == SCHEMA_VERSION) & whole)


def incremental(df: DataFrame, store: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results for all rows of df by digest, the new rows to append to the store); only misses are computed.

    A result with a null column (no cleaner for the content, say) is no success: it is given out, not stored.
    """
    known = valid(store).dropDuplicates(["digest"])
    keys = df.select("digest", "text").dropDuplicates(["digest"])
    new = fn(keys.join(known.select("digest"), "digest", "left_anti")).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    every = known.withColumn("hit", F.lit(True)).unionByName(new.withColumn("hit", F.lit(False)), allowMissingColumns=True)
    return df.drop("text").join(every, "digest", "left"), valid(new)


class Store:
    """Results by digest in a shared folder: runs of files dealt by the digest's prefix, and a log of which runs count.

    A run's rows count once the next entry of the log names it. An entry is created only if there is none of its
    number, so of two writers one has to take in what the other has committed and try again: there is one row for
    a digest. A reader takes the last entry's runs and only the folders of the prefixes that it asks for.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def at(self, name: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def last(self) -> tuple[int, list[str]]:
        """The number of the last entry (-1: none) and the runs that count; an entry that its writer left half-written counts as the one before."""
        fs, log = self.at("_log")
        if not fs.exists(log):
            return -1, []
        numbers = sorted((int(n) for f in fs.listStatus(log) if (n := f.getPath().getName()).isdigit()), reverse=True)
        for number in numbers:
            for _ in range(5 if number == numbers[0] else 1):
                words = self.spark._jvm.org.apache.commons.io.IOUtils.toString(*self.opened(f"_log/{number}"), "UTF-8").split()
                if words[-1:] == [WHOLE]:
                    return numbers[0], words[:-1]
                time.sleep(0.2)
        return max(numbers, default=-1), []

    def opened(self, name: str) -> tuple[Any]:
        fs, p = self.at(name)
        return (fs.open(p),)

    def commit(self, number: int, runs: list[str]) -> bool:
        """Writes an entry, unless another writer was first."""
        fs, p = self.at(f"_log/{number}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.toString():
                return False
            raise
        out.write(bytearray(" ".join([*runs, WHOLE]), "utf-8"))
        out.close()
        return True

    def read(self, runs: list[str], prefixes: list[str] | None = None) -> DataFrame:
        """The whole rows of the current schema in some runs, of some prefixes; files of another shape give nulls, which do not count."""
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, prefix string").option("basePath", self.path).parquet(*[f"{self.path}/{r}" for r in runs])
        return valid((rows if prefixes is None else rows.where(F.col("prefix").isin(prefixes))).drop("prefix", "run"))

    def add(self, new: DataFrame) -> DataFrame:
        """Commits new rows and returns those of them that count; digests that were committed in the meantime are left out."""
        number, runs = self.last()
        for _ in range(TRIES):
            run = f"run={uuid.uuid4().hex}"
            valid(new).withColumn("prefix", F.substring("digest", 1, PREFIX)).repartition("prefix").write.partitionBy("prefix").parquet(f"{self.path}/{run}")
            if self.commit(number + 1, [*runs, run]):
                return self.read([run])
            number, later = self.last()
            others = self.read([r for r in later if r not in runs])
            new, runs = self.read([run]).join(others.select("digest"), "digest", "left_anti"), later
        raise RuntimeError(f"{self.path} changes too fast to be added to")

    def compact(self) -> None:
        """All runs as one; readers of the old ones go on, as their files stay until they are removed by hand."""
        number, runs = self.last()
        if len(runs) > 1:
            run = f"run={uuid.uuid4().hex}"
            self.read(runs).withColumn("prefix", F.substring("digest", 1, PREFIX)).repartition("prefix").write.partitionBy("prefix").parquet(f"{self.path}/{run}")
            self.commit(number + 1, [run])


def run_incremental(df: DataFrame, path: str, fn: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """incremental() against the store at path, which is added to: a second run over the same contents computes nothing, and reads only the folders of its digests' prefixes."""
    store = Store(df.sparkSession, path, schema)
    prefixes = [r[0] for r in df.select(F.substring("digest", 1, PREFIX)).where("digest is not null").distinct().collect()]  # 16 ** PREFIX values at most
    runs = store.last()[1]
    known = store.read(runs, prefixes)
    store.add(incremental(df, known, fn)[1])
    now = store.read(store.last()[1], prefixes)
    hits = known.select(F.col("digest").alias("known"))
    return df.drop("text").join(now, "digest", "left").join(hits, F.col("digest") == F.col("known"), "left").withColumn("hit", F.col("known").isNotNull()).drop("known")


def live_entries(store: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    return store if ttl_seconds == 0 else store.where(F.unix_timestamp("created_at") + ttl_seconds > F.unix_timestamp(now))


def evict(store: DataFrame, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES, buckets: int = 64) -> DataFrame:
    """The most recently used entries that fit both budgets; an entry above the byte budget is never admitted.

    The running sums are in two steps: totals of time buckets, then within each bucket, so that no task
    holds all entries.
    """
    s = store.where(F.col("bytes") <= max_bytes)
    # buckets hold about as many entries each, however busy an hour was; one instant is one bucket
    ends = s.agg(F.percentile_approx(-F.unix_micros("last_access"), [k / buckets for k in range(1, buckets)], 10_000).alias("ends"))
    s = s.crossJoin(F.broadcast(ends)).withColumn("bucket", F.size(F.filter("ends", lambda e: e < -F.unix_micros("last_access")))).drop("ends")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    t = s.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    t = t.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    own = Window.partitionBy("bucket").orderBy(F.desc("last_access"), "key")
    j = s.join(F.broadcast(t), "bucket").withColumn("rank", F.col("n0") + F.row_number().over(own)).withColumn("total", F.col("b0") + F.sum("bytes").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return j.where((F.col("rank") <= max_entries) & (F.col("total") <= max_bytes)).select("key", "bytes", "last_access", "rank")


def cache_stats(outcomes: DataFrame) -> DataFrame:
    """hits, misses, stores, errors, corrupted, lookups and hit_rate from rows of (outcome)."""
    n = lambda k: F.count_if(F.col("outcome") == k)
    s = outcomes.agg(n("hit").alias("hits"), n("miss").alias("misses"), n("store").alias("stores"), n("error").alias("errors"), n("corrupted").alias("corrupted"))
    s = s.withColumn("lookups", F.col("hits") + F.col("misses"))
    return s.withColumn("hit_rate", F.when(F.col("lookups") > 0, F.round(F.col("hits") / F.col("lookups"), 4)).otherwise(F.lit(0.0)))


def checksum(c: Column) -> Column:
    return F.sha2(F.regexp_replace(c, "\r\n|\r", "\n"), 256)


def checksum_drift(files: DataFrame, lock: DataFrame) -> DataFrame:
    """name and status (added, removed, changed) of files (name, text) against a lock (name, checksum); equal ones are left out."""
    f = files.select("name", checksum(F.col("text")).alias("now"))
    j = f.join(lock.select("name", F.col("checksum").alias("was")), "name", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed")
    return j.select("name", status.alias("status")).where("status is not null")


def bucket_of(name: Column) -> Column:
    return F.substring(F.sha2(name.cast("string"), 256), 1, PREFIX)


def bucket_digests(checksums: DataFrame) -> DataFrame:
    """bucket, n and sums of (name, checksum) rows: sums of the parts of each row's digest, whatever their order; equal ones have equal rows, but for odds of 2^-200."""
    row = F.sha2(F.concat_ws("\x1f", F.col("name").cast("string"), "checksum"), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)"))
    return checksums.groupBy(bucket_of(F.col("name")).alias("bucket")).agg(F.count("*").alias("n"), F.concat_ws(",", *[part(k) for k in range(4)]).alias("sums"))


def write_lock(files: DataFrame, path: str) -> None:
    """The checksums of files (name, text) as a lock: rows in folders by bucket of the name, and a digest for each bucket."""
    rows = files.select("name", checksum(F.col("text")).alias("checksum"))
    rows.withColumn("bucket", bucket_of(F.col("name"))).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    bucket_digests(files.sparkSession.read.parquet(f"{path}/rows").select("name", "checksum")).coalesce(1).write.parquet(f"{path}/digests")


def locked(files: DataFrame, path: str) -> tuple[list[str], DataFrame]:
    """The buckets in which files differ from the lock at path, and the lock's rows of these: equal buckets are not read."""
    spark = files.sparkSession
    now = bucket_digests(files.select("name", checksum(F.col("text")).alias("checksum")))
    was = spark.read.parquet(f"{path}/digests").select("bucket", F.col("n").alias("n0"), F.col("sums").alias("sums0"))
    apart = now.join(was, "bucket", "full_outer").where(~(F.equal_null(F.col("n"), F.col("n0")) & F.equal_null(F.col("sums"), F.col("sums0"))))
    buckets = [r.bucket for r in apart.select("bucket").collect()]  # 16 ** PREFIX at most
    kind = dict(files.dtypes)["name"]
    rows = spark.read.schema(f"name {kind}, checksum string, bucket string").parquet(f"{path}/rows")
    return buckets, rows.where(F.col("bucket").isin(buckets)).drop("bucket")


def lock_drift(files: DataFrame, path: str) -> DataFrame:
    """checksum_drift() against the lock at path, of which only the buckets with a difference are read."""
    buckets, rows = locked(files, path)
    return checksum_drift(files.where(bucket_of(F.col("name")).isin(buckets)), rows)
