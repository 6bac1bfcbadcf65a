"""Operator 7: removal of byte strings that repeat, by blockwise suffix sorting with a difference cover.

Suffixes that start a window of ``length`` bytes are brought together by content (see routing.py): only
slices of text whose anchor has other texts elsewhere travel, and these are sorted one block of suffix
buckets at a time. In a block, the suffixes at a difference cover's residues are ranked first; the others
are then sorted by anchor, offset and their first bytes, and what is still tied there is resolved by the
cover's ranks: for two suffixes the cover has a shift that takes both to ranked ones. So a long tie costs
one look-up and memory is bounded by the block. Neighbours in the order that agree on ``length`` bytes
repeat. An anchor with very many texts has its windows dealt by their hash instead and counted there.

Slices, anchors and the windows of such anchors are told apart by 64-bit hashes before any bytes are
compared. At 30 GB, with some 6e8 slices, the odds of one false repetition are about 1 in 100.

Defined cases: a null text counts as empty; texts below ``length`` bytes lose nothing; rows with equal
texts, repeated rows too, are occurrences of their own, so both are removed whole; null and repeated
doc_ids are documents like any others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import common, hashing, routing, tallies

#: A long gram as anchor has other texts only around what really repeats.
LENGTH, GRAM = 200, 96
#: A difference cover: each residue of the period is a difference of two members. Fixed values.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)


def shifts() -> np.ndarray:
    """For residues i and j the shift below the period that takes both into the cover."""
    out = np.full((PERIOD, PERIOD), -1, np.int64)
    for i in range(PERIOD):
        for j in range(PERIOD):
            out[i, j] = next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER)
    return out


def big_endian(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number that orders as they do."""
    out = np.zeros(len(data), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for j in range(8):
        out = out << np.uint64(8) | padded[j : j + len(data)]
    return out


def refined(group: np.ndarray, keys, rounds: int) -> np.ndarray:
    """Dense ranks by group and then keys(round, rows); only rows that are still tied are looked at."""
    order = np.argsort(group, kind="stable")
    rank = np.empty(len(group), np.int64)
    new = np.ones(len(group), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if len(group) else 0
    live = np.arange(len(group))
    for r in range(rounds):
        size = np.bincount(rank[live], minlength=len(group))
        live = live[size[rank[live]] > 1]
        if not len(live):
            break
        key = keys(r, live)
        by = np.argsort(key) if rank[live[0]] == 0 and size[0] == len(live) else np.lexsort((key, rank[live]))
        g, k = rank[live][by], key[by]
        start = np.ones(len(by), bool)
        start[1:] = g[1:] != g[:-1]
        new = start.copy()
        new[1:] |= k[1:] != k[:-1]
        at = np.arange(len(by))
        head = np.maximum.accumulate(np.where(start, at, 0))
        rank[live[by]] = g + np.maximum.accumulate(np.where(new, at, 0)) - head
    return rank


def by_cover(rank: np.ndarray, place: np.ndarray, cover_rank: np.ndarray, table: np.ndarray) -> np.ndarray:
    """rank with ties resolved by the cover: each round splits every tied group at its middle row, in three."""
    rank = rank.copy()
    live = np.arange(len(rank))
    while True:
        size = np.bincount(rank[live], minlength=len(rank) + 1)
        live = live[size[rank[live]] > 1]
        if not len(live):
            return rank
        live = live[np.argsort(rank[live], kind="stable")]
        g = rank[live]
        start = np.flatnonzero(np.diff(g, prepend=-1))
        count = np.diff([*start, len(g)])
        pivot = np.repeat(live[start + count // 2], count)
        shift = table[place[live] % PERIOD, place[pivot] % PERIOD]
        side = np.sign(cover_rank[place[live] + shift] - cover_rank[place[pivot] + shift])
        by = np.lexsort((side, g))
        live, g, side = live[by], g[by], side[by]
        new = np.ones(len(live), bool)
        new[1:] = (g[1:] != g[:-1]) | (side[1:] != side[:-1])
        at = np.arange(len(live))
        rank[live] = g + np.maximum.accumulate(np.where(new, at, 0)) - np.repeat(start, count)
        live = live[side != 0]  # what equals the pivot agrees with it on all the cover's ranks compare


def repeated(bucket: routing.Bucket, length: int = LENGTH) -> np.ndarray:
    """The stretches of windows that occur again, of the slices that are not done."""
    s, starts, data = bucket
    n = s["windows"].astype(np.int64)
    row = np.repeat(np.arange(len(s)), n)
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    _, route = np.unique(s["route"], return_inverse=True)
    meet = route[row] * (length + 1) + s["offset"][row] - step
    hit = s["done"][row] > 0
    size, undecided = np.bincount(meet), np.bincount(meet, ~hit)
    # a window without another of its anchor and offset is alone; a group of decided ones needs no sorting
    two = np.flatnonzero((size[meet] > 1) & (undecided[meet] > 0))
    if len(two):
        used = np.unique(row[two])
        a, b = starts[used], starts[used + 1]
        moved = np.zeros(len(s), np.int64)
        moved[used] = np.cumsum(b - a) - (b - a)
        text = np.concatenate([data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        hit[two] |= equal_windows(text, moved[row[two]] + step[two], meet[two], length)
    at = np.flatnonzero(hit & (s["done"][row] == 0))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    a, b = at[new], at[np.append(new[1:], True)] if len(at) else at
    of = row[a]
    return routing.table_of(routing.SPAN, [s["run"][of], s["doc"][of], s["lo"][of] + step[a], s["lo"][of] + step[b] + length])


def equal_windows(data: np.ndarray, place: np.ndarray, meet: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix has a neighbour in its group, in sorted order, that agrees on length bytes."""
    padded = np.concatenate([data, np.zeros(length + PERIOD + 8, np.uint8)])
    word = big_endian(padded)
    cover = np.flatnonzero(np.isin(np.arange(len(data) + PERIOD) % PERIOD, COVER))
    cover_rank = np.full(len(data) + PERIOD, -1, np.int64)
    cover_rank[cover] = refined(np.zeros(len(cover), np.int64), lambda r, i: word[cover[i] + 8 * r], -(-length // 8))
    rank = refined(meet, lambda r, i: word[place[i] + 8 * r], -(-PERIOD // 8))
    rank = by_cover(rank, place, cover_rank, shifts())
    order = np.lexsort((rank, meet))
    p, g = place[order], meet[order]
    agree = g[1:] == g[:-1]
    for r in range(length // 8):
        at = np.flatnonzero(agree)
        agree[at] = word[p[at] + 8 * r] == word[p[at + 1] + 8 * r]
    for r in range(length - length % 8, length):
        at = np.flatnonzero(agree)
        agree[at] = padded[p[at] + r] == padded[p[at + 1] + r]
    out = np.zeros(len(place), bool)
    out[order[1:][agree]] = True
    out[order[:-1][agree]] = True
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = routing.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    runs = tallies.packed_runs(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    spans = routing.covered(runs, lambda b: repeated(b, length), length, min(GRAM, length // 2), hot)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, own, found in zip(batch.column("data"), batch.column("own"), batch.column("found"), strict=True):
                t = tallies.opened(data.as_buffer())
                raw, at = common.utf8(t.column("text"))
                doc, lo, hi = routing.spans_of_run(own.as_py(), found.as_py(), length)
                gone = hashing.covered(len(raw), at[doc] + lo, at[doc] + hi)
                rows = []
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    g = gone[a:b]
                    rows.append((b - a, int(g.sum()), int((g[1:] & ~g[:-1]).sum() + g[:1].sum()), raw[a:b][~g].tobytes()))
                cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                sha = pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([t.column("doc_id"), *cols[:3], sha, cols[3]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = tallies.by_run(runs.select("run", "data"), spans).select("data", "own", "found")
    return done.mapInArrow(drop, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.read(spark, sf_dir, "documents")).drop("kept")
