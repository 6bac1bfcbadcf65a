"""Windows of bytes brought together by content, for the operator that sorts suffixes.

Each window of ``length`` bytes is assigned to its anchor: the place of the smallest hash among its
``k``-byte grams, the leftmost at a tie. Equal windows have equal anchors at equal offsets. Consecutive
windows with one anchor are a slice of text. Slices and anchors are counted over the corpus first (see
tallies.py): a slice that occurs again repeats as a whole, one whose anchor has no other text does not
repeat at all, and only what is left travels: to the bucket that the anchor's hash names, or, if an
anchor has more than ``HOT`` texts, as hashes of its windows, dealt by these, so that no bucket grows
with the number of places that share an anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm import common, hashing, tallies

#: What is asked: a slice's or an anchor's hash, how often (an anchor: with how many texts), and an anchor's only text (1: several).
ASKED = [("key", "<u8"), ("n", "<u4"), ("text", "<u8")]
SAID = [("state", "u1")]
#: What a slice carries: its anchor's hash, run, document (row in the run), first window, number of windows, the anchor's
#: offset in the first one, bytes, and whether its windows are known to repeat.
SLICE = [("route", "<u8"), ("run", "<i8"), ("doc", "<i4"), ("lo", "<i4"), ("windows", "<i4"), ("offset", "<i4"), ("size", "<i4"), ("done", "u1")]
#: A stretch of a run's documents that is known to be covered, and a window.
SPAN, WINDOW = [("run", "<i8"), ("doc", "<i4"), ("lo", "<i4"), ("hi", "<i4")], [("doc", "<i4"), ("lo", "<i4")]
WINDOWS = [("key", "<u8"), ("n", "<u4")]
#: Texts of an anchor above which windows are compared by their hashes; text that a bucket stands for, and of it what is sorted at a time.
HOT, BUCKET_BYTES, BLOCK_BYTES = 2000, 40 << 20, 2 << 20
OWN, TEXT, HASHES = 0, 1, 2
DEALT = "run long, kind int, bucket long, head binary, body binary"


class Bucket(NamedTuple):
    slices: np.ndarray
    starts: np.ndarray
    data: np.ndarray


class Slices(NamedTuple):
    """doc, lo (bytes from the run's start), windows, offset, size and route of each slice, its text's hash; and what is asked, with the places of both."""

    doc: np.ndarray
    lo: np.ndarray
    windows: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    route: np.ndarray
    same: np.ndarray
    sums: np.ndarray
    asked: list[np.ndarray]
    of_text: np.ndarray
    of_anchor: np.ndarray


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive entries, by prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(suffix[:n], prefix[w - 1 : w - 1 + n])


def cut(grams: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """text, first window, windows and anchor of each slice: maximal runs of windows with one anchor."""
    low = np.uint64(0xFFFFFFFF)
    least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
    n = np.maximum(np.diff(at) - length + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + at[text]
    anchor = (least[window] & low).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    return text[head], window[head], np.diff([*head, len(window)]), anchor[head]


def slices_of(raw: np.ndarray, at: np.ndarray, length: int, k: int) -> Slices:
    sums = hashing.prefix_sums(raw)
    place = np.arange(max(0, len(raw) - k + 1))
    grams = np.zeros(len(raw), np.uint64)
    grams[: len(place)] = hashing.stretch(sums, place, place + k)
    doc, lo, n, anchor = cut(grams, at, length, k)
    route = grams[anchor]
    same = hashing.stretch(sums, lo, lo + n + length - 1)
    order, head, text = tallies.grouped(same)
    lead = order[head]
    by, first, of_route = tallies.grouped(route[lead])
    texts = np.diff([*first, len(lead)])
    keys = np.concatenate([hashing.mixed(same[lead], 11), hashing.mixed(route[lead][by][first], 12)])
    only = np.where(texts > 1, np.uint64(1), same[lead][by][first] | np.uint64(2)) if len(lead) else same
    count, named = np.concatenate([np.diff([*head, len(same)]), texts]), np.concatenate([np.zeros(len(lead), np.uint64), only])
    ranks = np.argsort(keys, kind="stable")
    place_of = np.empty(len(keys), np.int64)
    place_of[ranks] = np.arange(len(keys))
    anchor_of = place_of[len(lead) :][of_route[text]] if len(lead) else text
    return Slices(doc, lo, n, anchor - lo, n + length - 1, route, same, sums, [keys[ranks], count[ranks].astype(np.uint32), named[ranks]], place_of[: len(lead)][text], anchor_of)


def settled(keys: np.ndarray, n: np.ndarray, text: np.ndarray, hot: int = HOT) -> list[np.ndarray]:
    """Of each entry: for a slice, whether its text occurs again; for an anchor, 0 if it has one text only, 1 if several, 2 if more than hot."""
    order, head, place = tallies.grouped(keys)
    total, t = np.add.reduceat(n[order].astype(np.int64), head), text[order]
    low, high = np.minimum.reduceat(t, head), np.maximum.reduceat(t, head)
    several = (low != high) | (low == 1)
    state = np.where(low == 0, total > 1, several * (1 + (total > hot)))
    return [state[place].astype(np.uint8)]


def counted(keys: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    order, head, place = tallies.grouped(keys)
    return [(np.add.reduceat(n[order].astype(np.int64), head) > 1)[place].astype(np.uint8)]


def table_of(kind: tallies.Kind, columns: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(columns[0]), kind)
    for (name, _), c in zip(kind, columns, strict=True):
        out[name] = c
    return out


def dealt(run: int, raw: np.ndarray, at: np.ndarray, s: Slices, state: np.ndarray, length: int, buckets: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """A run's rows: its own spans and windows, slices whose anchor has other texts by bucket, and hashes of hot anchors' windows by bucket."""
    again, of = state[s.of_text] > 0, state[s.of_anchor]
    # of equal slices one travels, and decides nothing for itself: they repeat
    _, lead = np.unique(s.of_text, return_index=True)
    open_, hot = lead[of[lead] == 1], lead[of[lead] == 2]
    to = tallies.bucket_of(hashing.mixed(s.route[open_], 3), buckets)
    open_, to = open_[np.argsort(to, kind="stable")], np.sort(to)
    view = memoryview(raw)
    place = s.lo - at[s.doc]
    for a, b in tallies.cuts(to):
        i = open_[a:b]
        head = [s.route[i], np.full(len(i), run), s.doc[i], place[i], s.windows[i], s.offset[i], s.size[i], again[i]]
        body = b"".join([view[x:y] for x, y in zip(s.lo[i].tolist(), (s.lo[i] + s.size[i]).tolist(), strict=True)])
        yield run, TEXT, int(to[a]), tallies.pack(SLICE, head), tallies.compressed(body)
    n = s.windows[hot]
    row = np.repeat(hot, n)
    window = s.lo[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    order, first, _ = tallies.grouped(hashing.stretch(s.sums, window, window + length))
    window, doc = window[order], s.doc[row[order]]
    keys = hashing.stretch(s.sums, window[first], window[first] + length) if len(first) else np.zeros(0, np.uint64)
    many = np.diff([*first, len(window)]) + again[row[order]][first]
    where = tallies.bucket_of(keys, buckets)
    for a, b in tallies.cuts(where):
        yield run, HASHES, int(where[a]), tallies.pack(WINDOWS, [keys[a:b], many[a:b]]), b""
    i = np.flatnonzero(again)
    spans = tallies.pack(SPAN[1:], [s.doc[i], place[i], place[i] + s.size[i]])
    own = tallies.pack(WINDOW + [("entry", "<i4")], [doc, window - at[doc], np.repeat(np.arange(len(first)), np.diff([*first, len(window)]))])
    yield run, OWN, -1, spans, own


def covered(runs: DataFrame, repeated: Callable[[Bucket], np.ndarray], length: int, k: int, hot: int = HOT) -> DataFrame:
    """run, own (the run's spans and windows) and found (lists of kind and a packed answer by bucket), read by spans_of_run().

    repeated gets the slices whose anchors a bucket holds more than once, a block at a time, and returns
    SPAN rows for those that are not done.
    """
    buckets = tallies.buckets_for(runs, BUCKET_BYTES)
    slices = lambda t: slices_of(*common.utf8(t.column("text")), length, k)
    said = tallies.tally(runs, lambda t: slices(t).asked, ASKED, lambda *x: settled(*x, hot), SAID, tallies.buckets_for(runs))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, data, answers in zip(batch.column("run").to_pylist(), batch.column("data"), batch.column("said"), strict=True):
                raw, at = common.utf8(tallies.opened(data.as_buffer()).column("text"))
                rows = list(dealt(run, raw, at, slices_of(raw, at, length, k), tallies.heard(SAID, answers)[0], length, buckets))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["run", "kind", "bucket", "head", "body"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.groups(batches, ("kind", "bucket")):
            kind, bucket = part.column("kind")[0].as_py(), part.column("bucket")[0].as_py()
            if kind == HASHES:
                keys, n = zip(*(tallies.unpack(WINDOWS, x.as_buffer()) for x in part.column("head")), strict=True)
                hit = np.split(counted(np.concatenate(keys), np.concatenate(n))[0], np.cumsum([len(x) for x in keys])[:-1])
                out = [(run, h.astype(np.uint8).tobytes()) for run, h in zip(part.column("run").to_pylist(), hit, strict=True)]
            else:
                rows = np.concatenate([np.empty(0, SPAN), *blocks(part, repeated)])
                rows = rows[np.argsort(rows["run"], kind="stable")]
                out = [(int(rows["run"][a]), tallies.pack(SPAN[1:], [rows[f][a:b] for f, _ in SPAN[1:]])) for a, b in tallies.cuts(rows["run"])]
            cols = [pa.array([r for r, _ in out], pa.int64()), pa.array([kind] * len(out), pa.int32()), pa.array([bucket] * len(out), pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([tallies.compressed(x) if kind == HASHES else x for _, x in out], pa.binary())], names=["run", "kind", "bucket", "answer"])

    rows = common.materialize(tallies.by_run(runs.select("run", "data"), said).mapInArrow(deal, DEALT), "slices")
    sent = rows.where(f"kind <> {OWN}").repartition(buckets, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    found = sent.mapInArrow(find, "run long, kind int, bucket long, answer binary")
    found = found.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "answer"))).alias("found"))
    own = rows.where(f"kind = {OWN}").select(F.col("run"), F.struct("head", "body").alias("own"))
    return own.join(found, "run", "left")


def blocks(part: pa.RecordBatch, repeated: Callable[[Bucket], np.ndarray]) -> Iterator[np.ndarray]:
    """The spans found in a bucket, one block of anchors at a time."""
    table = np.concatenate([table_of(SLICE, tallies.unpack(SLICE, x.as_buffer())) for x in part.column("head")])
    raw = np.frombuffer(b"".join([tallies.decompressed(x.as_buffer()) for x in part.column("body")]), np.uint8)
    begin = np.cumsum(table["size"], dtype=np.int64) - table["size"]
    order = np.argsort(table["route"], kind="stable")
    route = table["route"][order]
    size = table["size"][order].astype(np.int64)
    ends = np.concatenate([[0], np.flatnonzero(route[1:] != route[:-1]) + 1, [len(route)]])
    view = memoryview(raw)
    for lo, hi in common.runs(np.add.reduceat(size, ends[:-1]), BLOCK_BYTES):
        own = order[ends[lo] : ends[hi]]
        data = np.frombuffer(b"".join([view[a:b] for a, b in zip(begin[own].tolist(), (begin[own] + table["size"][own]).tolist(), strict=True)]), np.uint8)
        yield repeated(Bucket(table[own], np.concatenate([[0], np.cumsum(table["size"][own], dtype=np.int64)]), data))


def spans_of_run(own: dict, found: list[dict] | None, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, lo and hi of the stretches of a run's documents that repeat."""
    parts = [tallies.unpack(SPAN[1:], own["head"])]
    doc, lo, entry = tallies.unpack(WINDOW + [("entry", "<i4")], own["body"])
    parts += [tallies.unpack(SPAN[1:], x["answer"]) for x in found or () if x["kind"] == TEXT]
    hits = [np.frombuffer(tallies.decompressed(x["answer"]), np.uint8) for x in found or () if x["kind"] == HASHES]
    if hits:
        good = np.concatenate(hits)[entry] > 0
        parts.append([doc[good], lo[good], lo[good] + length])
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))
