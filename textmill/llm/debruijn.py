"""Operator 10: removal of repeated word sequences through a compacted de Bruijn graph.

A window of ``length`` words is an edge of the graph, from the node of its first ``length - 1`` words to
that of its last. Each distinct edge's occurrences, and whether all of them go on to one edge, are counted
over the corpus (see tallies.py). Two consecutive edges are on one nonbranching path if every occurrence
of either is next to the other: the first goes on in one way only, and both occur equally often, so the
second is reached in one way only, too. The edges' answers are joined back to the documents,
where the maximal paths of repeated edges become one stretch each, with source coordinates (document and
word). Every occurrence of a path runs along all of it, so one row stands for the whole path: a Spark
grouping by the path's words (a 128-bit digest of the text itself) finds its first occurrence, and a join
tells the others, which are covered.

Edges are told apart by 48 bits for counting: edges that share them cut a path in two, no more, as a path
is removed only if its whole words occur earlier. Their ways on are told apart by 24 other bits: odds of
2^-24, at a branching where both edges occur equally often, that a path is left which should go.

Defined cases: a null text has no words; texts below ``length`` words lose nothing; a null doc_id
counts as the smallest; rows that share a doc_id but not a text are ordered by a 64-bit hash of the text;
rows that repeat both are one document, with one result for each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import common, hashing, tallies

LENGTH = 20
#: An edge with several ways on, or one that ends a document; text that one bucket of edges stands for.
BRANCH, BUCKET_BYTES = 1 << 24, 6 << 20
ASKED = [("key", "<u8"), ("n", "<u4"), ("after", "<u4")]
SAID = [("n", "<u4"), ("ends", "u1")]
PLACES = [("path", "<u4"), ("doc", "<u4"), ("lo", "<u4"), ("hi", "<u4")]


class Edges(NamedTuple):
    """Each edge's document (its row in the run), first word within it, and place among the distinct keys; and these keys with what is asked."""

    doc: np.ndarray
    place: np.ndarray
    entry: np.ndarray
    asked: list[np.ndarray]


class Words(NamedTuple):
    """The words of a run joined by one space each, begin and end of each, and each text's first word (one more at the end)."""

    raw: bytes
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def words_of(texts: pa.Array) -> Words:
    raw, at = common.utf8(texts)
    begin, end, first = hashing.words(raw, at)
    size = end - begin
    to = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = raw[np.repeat(begin, size) + step]
    return Words(out.tobytes(), to, to + size, first)


def one_way(ways: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The way that all of a group have, or BRANCH."""
    low, high = np.minimum.reduceat(ways, head), np.maximum.reduceat(ways, head)
    return np.where(low == high, low, BRANCH).astype(np.uint32)


def edges_of(w: Words, length: int) -> Edges:
    raw = np.frombuffer(w.raw, np.uint8)
    edge = hashing.windows(hashing.stretch(hashing.prefix_sums(raw), w.begin, w.end), length)
    n = np.maximum(np.diff(w.first) - length + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h = edge[w.first[doc] + place]
    if not len(h):
        return Edges(doc, place, doc, [np.zeros(0, t) for _, t in ASKED])
    after = np.full(len(h), BRANCH, np.uint32)
    same = doc[1:] == doc[:-1]
    after[:-1][same] = (h[1:] & np.uint64(BRANCH - 1)).astype(np.uint32)[same]
    h &= ~np.uint64(0xFFFF)
    order, head, entry = tallies.grouped(h)
    return Edges(doc, place, entry, [h[order[head]], np.diff([*head, len(h)]).astype(np.uint32), one_way(after[order], head)])


def counted(keys: np.ndarray, n: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """Of each entry its edge's occurrences (0 if there is one only), and whether it goes on in more than one way."""
    order, head, place = tallies.grouped(keys)
    total = np.minimum(np.add.reduceat(n[order].astype(np.int64), head), (1 << 32) - 1)
    again = total > 1
    ends = again & (one_way(after[order], head) == BRANCH)
    return [np.where(again, total, 0).astype(np.uint32)[place], ends.astype(np.uint8)[place]]


def paths(e: Edges, n: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last edge (places in e) of each nonbranching path of repeated edges."""
    n, ends = n[e.entry], ends[e.entry]
    on = np.zeros(len(n) + 1, bool)
    on[1:-1] = (n[1:] > 0) & (n[1:] == n[:-1]) & (e.doc[1:] == e.doc[:-1]) & (ends[:-1] == 0)
    return np.flatnonzero((n > 0) & ~on[:-1]), np.flatnonzero((n > 0) & ~on[1:])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the remaining words joined by one space)."""
    runs = tallies.packed_runs(common.keyed(docs))
    said = tallies.tally(runs, lambda t: edges_of(words_of(t.column("text")), length).asked, ASKED, counted, SAID, tallies.buckets_for(runs, BUCKET_BYTES))

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, data, answers in zip(batch.column("run").to_pylist(), batch.column("data"), batch.column("said"), strict=True):
                t = tallies.opened(data.as_buffer())
                w = words_of(t.column("text"))
                e = edges_of(w, length)
                a, b = paths(e, *tallies.heard(SAID, answers))
                doc, lo, hi = e.doc[a], e.place[a], e.place[b] + length
                begin, end = w.begin[w.first[doc] + lo].tolist(), w.end[w.first[doc] + hi - 1].tolist()
                view = memoryview(w.raw)
                digests = [hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(begin, end, strict=True)]
                names: dict[bytes, int] = {}
                path = np.array([names.setdefault(d, len(names)) for d in digests], np.int64)
                ids, th = (t.column(c).to_numpy() for c in ("id", "th"))
                order = np.lexsort((lo, th[doc], ids[doc], path))
                head = order[np.diff(path[order], prepend=-1) > 0]
                lists = [pa.array(list(names), pa.binary()), pa.array(ids[doc[head]]), pa.array(th[doc[head]]), pa.array(lo[head].astype(np.int64))]
                cols = [pa.array([run], pa.int64()), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists), pa.array([tallies.pack(PLACES, [path, doc, lo, hi])], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["run", "digests", "ids", "ths", "los", "places"])

    found = tallies.by_run(runs.select("run", "data"), said).mapInArrow(compact, "run long, digests array<binary>, ids array<long>, ths array<long>, los array<long>, places binary")
    found = common.materialize(found, "paths")
    each = found.select("run", F.posexplode(F.arrays_zip("digests", "ids", "ths", "los")).alias("path", "p"))
    each = each.select("run", "path", F.col("p.digests").alias("digest"), F.struct("p.ids", "p.ths", "p.los").alias("at"))
    first = each.groupBy("digest").agg(F.min("at").alias("first"))
    firsts = each.drop("at").join(first, "digest").groupBy("run").agg(F.sort_array(F.collect_list(F.struct("path", "first"))).alias("firsts"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, places, own in zip(*(batch.column(c) for c in ("data", "places", "firsts")), strict=True):
                t = tallies.opened(data.as_buffer())
                yield kept_rows(t, words_of(t.column("text")), tallies.unpack(PLACES, places.as_buffer()), own)

    done = tallies.by_run(runs.select("run", "data"), found.select("run", "places"), firsts).select("data", "places", "firsts")
    return done.mapInArrow(drop, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string, kept string")


def kept_rows(t: pa.RecordBatch, w: Words, places: list[np.ndarray], firsts: pa.ListScalar) -> pa.RecordBatch:
    """The result of each document of a run, without the stretches that are not their path's first."""
    path, doc, lo, hi = (c.astype(np.int64) for c in places)
    gone = np.zeros(len(w.begin), bool)
    if len(path):
        first = firsts.values.field("first")
        same = lo == first.field("los").to_numpy()[path]
        for own, name in (("id", "ids"), ("th", "ths")):
            same &= t.column(own).to_numpy()[doc] == first.field(name).to_numpy()[path]
        a, b = (w.first[doc] + x for x in (lo, hi))
        gone = hashing.covered(len(gone), a[~same], b[~same])
    view, rows = memoryview(w.raw), []
    begin, end, keep = w.begin.tolist(), w.end.tolist(), np.flatnonzero(~gone)
    at = np.searchsorted(keep, w.first).tolist()
    keep = keep.tolist()
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        own = keep[at[i] : at[i + 1]]
        whole = len(own) == b - a
        rows.append((b - a, b - a - len(own), bytes(view[begin[a] : end[b - 1]]) if whole and own else b" ".join([view[begin[x] : end[x]] for x in own])))
    cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
    sha = pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())
    return pa.RecordBatch.from_arrays([t.column("doc_id"), *cols[:2], sha, cols[2]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read(spark, sf_dir, "documents")).drop("kept")
