"""Keys counted over all runs of rows, for operators that ask which of their passages occur again.

A run is a few megabytes of rows, written once as a compressed Arrow table. Each run asks about its
distinct 64-bit keys; keys travel sorted, as differences, packed by bucket (a range of keys), and a
bucket's answers go back to the runs as one packed table each. However often a key occurs, it is one
entry for each run, so no key makes a bucket large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import common

#: Text that one bucket of keys stands for, and runs that a task of a join by run gets.
BUCKET_BYTES, RUNS_A_TASK = 24 << 20, 4
Kind = list[tuple[str, str]]


def compressed(data: bytes, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def decompressed(data) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def pack(kind: Kind, columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, byte plane by byte plane; a column named key is sorted and goes as differences."""
    out = []
    for (name, t), c in zip(kind, columns, strict=True):
        c = np.diff(c, prepend=c.dtype.type(0)) if name == "key" else c
        out.append(np.ascontiguousarray(c, t).view(np.uint8).reshape(len(c), np.dtype(t).itemsize).T.tobytes())
    return compressed(b"".join(out))


def unpack(kind: Kind, data) -> list[np.ndarray]:
    raw = np.frombuffer(decompressed(data), np.uint8)
    sizes = [np.dtype(t).itemsize for _, t in kind]
    n, at, out = len(raw) // sum(sizes), 0, []
    for (name, t), size in zip(kind, sizes, strict=True):
        c = np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(t).ravel()
        out.append(np.cumsum(c, dtype=np.uint64) if name == "key" else c)
        at += n * size
    return out


def packed_runs(df: DataFrame, column: str = "text", scale: int = 2, turn: Callable[[pa.RecordBatch], pa.RecordBatch] = lambda x: x) -> DataFrame:
    """run, size (bytes of the column) and data: df through turn in runs of about scale MB, as a table in the shared folder."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sink, table = pa.BufferOutputStream(), turn(batch)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_batch(table)
        size = len(common.utf8(batch.column(column))[0])
        return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([compressed(sink.getvalue().to_pybytes())], pa.binary())], names=["size", "data"])

    runs = common.by_batch(df, each, "size long, data binary", column, scale)
    return common.materialize(runs.withColumn("run", F.monotonically_increasing_id()), "runs")


def opened(data) -> pa.RecordBatch:
    return pa.ipc.open_stream(decompressed(data)).read_next_batch()


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key; it rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys' sorted order, where each distinct key starts in it, and the place of each key among the distinct ones."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), place


def cuts(of: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of equal entries."""
    ends = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), len(of)]
    return zip(ends[:-1], ends[1:], strict=True)


def buckets_for(runs: DataFrame, size: int = BUCKET_BYTES) -> int:
    total = runs.agg(F.sum("size")).first()[0] or 0
    return max(common.shuffle_parts(runs.sparkSession), int(total // size) + 1)


def tally(runs: DataFrame, ask: Callable[[pa.RecordBatch], list[np.ndarray]], kind: Kind, answer: Callable[..., list[np.ndarray]], said_kind: Kind, buckets: int) -> DataFrame:
    """run and said, read by heard().

    ask gives a run's distinct keys, sorted, and what goes with them (kind); answer gets those of all runs
    in a bucket and returns a row for each entry (said_kind).
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, data in zip(batch.column("run").to_pylist(), batch.column("data"), strict=True):
                columns = ask(opened(data.as_buffer()))
                to = bucket_of(columns[0], buckets)
                rows = [(int(to[a]), pack(kind, [c[a:b] for c in columns])) for a, b in cuts(to)]
                cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([run] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "run", "keys"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in common.groups(batches, ("bucket",)):
            parts = [unpack(kind, x.as_buffer()) for x in g.column("keys")]
            ends = np.cumsum([len(p[0]) for p in parts])[:-1]
            said = zip(*(np.split(c, ends) for c in answer(*(np.concatenate(c) for c in zip(*parts, strict=True)))), strict=True)
            yield pa.RecordBatch.from_arrays([g.column("run"), g.column("bucket"), pa.array([pack(said_kind, list(s)) for s in said], pa.binary())], names=["run", "bucket", "said"])

    sent = runs.select("run", "data").mapInArrow(send, "bucket long, run long, keys binary")
    counted = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "run long, bucket long, said binary")
    return counted.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("bucket", "said"))).alias("said"))


def heard(said_kind: Kind, said: pa.ListScalar) -> list[np.ndarray]:
    """The answers to a run's keys, in the keys' order."""
    parts = [unpack(said_kind, x["said"].as_buffer()) for x in said.values] if said.is_valid else []
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for _, t in said_kind]


def by_run(runs: DataFrame, *others: DataFrame) -> DataFrame:
    """runs joined with tables that have at most one row for a run."""
    parts = max(common.shuffle_parts(runs.sparkSession), runs.count() // RUNS_A_TASK + 1)
    out = runs.repartition(parts, "run")
    for other in others:
        out = out.join(other.repartition(parts, "run").hint("shuffle_hash"), "run", "left")
    return out
