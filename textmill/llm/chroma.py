"""Operator 8: chroma audio fingerprints for media columns, and the alignment of recordings.

A recording (mono 16-bit PCM) becomes frames of 12 pitch-class energies. Filters compare sums over
rectangles of that picture, taken from its integral image; each gives two bits, and 16 of them a packed
32-bit integer for each frame. Every offset at which two recordings have a pair of integers with three
equal bytes is looked at, and the share of differing bits over the overlap there decides. Equal
fingerprints are compared once; blocks of queries meet parts of the recordings.

The corpus has no audio, so the query derives a media column from ``embeddings``: each vector is
rendered as a melody, a note for each component, after a pause that depends on vec_id. The stated
query set, vec_ids divisible by 50, is aligned against all recordings.

Defined cases: null, empty or too short audio has no integers and aligns with nothing; a vector that is
null, or with null or non-finite components, is rendered as null; null and repeated ids are rows like
any others (a null id is no query); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm import common

RATE, FRAME, HOP, WIDTH, FILTERS = 2000, 512, 120, 16, 16
LOWEST, HIGHEST = 110.0, 900.0
NOTE, STEPS = 240, 6
#: Overlaps of less than half of the shorter recording need so many equal integers, and aligned recordings differ in at most this share of their bits.
VOTES, ERRORS = 4, 0.2
MEDIA, PRINTS = "rec_id long, audio binary", "rec_id long, n_codes long, codes binary"
#: Recordings that are held at a time, codes that are compared at a time, and queries of a block and recordings of a part.
ROWS, CELLS, BLOCK, PART = 128, 1 << 20, 2048, 4096


def melody(vec_id: int | None, vector: list[float | None] | None) -> bytes | None:
    """A note of one of six pitches for each component, after up to four frames' pause, as PCM."""
    x = np.array([np.nan if c is None else c for c in vector or ()], float)
    size = np.linalg.norm(x)
    if not len(x) or not np.isfinite(size) or size == 0:
        return None
    z = np.clip(x / size * np.sqrt(len(x)), -8, 8)
    step = np.minimum((STEPS / (1 + np.exp(-1.702 * z))).astype(int), STEPS - 1)
    pause = np.zeros(((vec_id or 0) % 5) * HOP, np.int16)
    return np.concatenate([pause, notes()[step].ravel()]).tobytes()


@lru_cache(1)
def notes() -> np.ndarray:
    t = np.arange(NOTE) / RATE
    return np.stack([9000 * np.sin(2 * np.pi * 220 * 2 ** (2 * s / 12) * t) for s in range(STEPS)]).astype(np.int16)


def render(vectors: DataFrame) -> DataFrame:
    """rec_id and audio, a media column, from vec_id and embedding."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                audio = [melody(i, v) for i, v in zip(part.column("vec_id").to_pylist(), part.column("embedding").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(audio, pa.binary())], names=["rec_id", "audio"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(each, MEDIA)


@lru_cache(1)
def pitch_classes() -> np.ndarray:
    """Which pitch class each frequency bin adds to (bins by 12)."""
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(f), 12), np.float32)
    good = np.flatnonzero((f >= LOWEST) & (f <= HIGHEST))
    out[good, np.round(12 * np.log2(f[good] / 220.0)).astype(int) % 12] = 1
    return out


@lru_cache(1)
def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width in frames) of each filter, by a rule: kinds in turn, sizes in steps."""
    return [(i % 4, (5 * i) % 12, 1 + i % 4, WIDTH - 4 * (i // 6)) for i in range(FILTERS)]


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Frames by 12 pitch-class energies, each frame of unit length."""
    n = (len(pcm) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME)[::HOP][:n] * np.hanning(FRAME).astype(np.float32)
    power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2 @ pitch_classes()
    return power / np.maximum(np.linalg.norm(power, axis=1, keepdims=True), 1e-3 * np.linalg.norm(power, axis=1).max(initial=1e-9) + 1e-9)


def packed(picture: np.ndarray) -> np.ndarray:
    """A 32-bit integer for each place where a window of WIDTH frames fits."""
    n = len(picture) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    doubled = np.concatenate([picture, picture], 1)  # pitch classes go round
    image = np.zeros((len(picture) + 1, 25))
    image[1:, 1:] = doubled.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return image[at + t1, p1] - image[at + t0, p1] - image[at + t1, p0] + image[at + t0, p0]

    out = np.zeros(n, np.uint32)
    for kind, p, h, w in filters():
        if kind == 0:  # halves in time
            a, b = area(0, w // 2, p, p + h), area(w // 2, w, p, p + h)
        elif kind == 1:  # neighbouring pitch classes
            a, b = area(0, w, p, p + h), area(0, w, p + h, p + 2 * h)
        elif kind == 2:  # the middle third against the sides
            t = w // 3
            a, b = area(t, w - t, p, p + h), area(0, t, p, p + h) + area(w - t, w, p, p + h)
        else:  # opposite quarters
            a = area(0, w // 2, p, p + h) + area(w // 2, w, p + h, p + 2 * h)
            b = area(w // 2, w, p, p + h) + area(0, w // 2, p + h, p + 2 * h)
        value = np.log((1 + a) / (1 + b))
        level = (value > -0.35).astype(int) + (value > 0) + (value > 0.35)
        out = out << np.uint32(2) | np.array([0, 1, 3, 2], np.uint32)[level]
    return out


def prints_of(ids: pa.Array, audio: list[bytes | None]) -> pa.RecordBatch:
    codes = [packed(chroma(np.frombuffer(a or b"", "<i2", count=len(a or b"") // 2).astype(np.float32))) for a in audio]
    cols = [ids, pa.array([len(c) for c in codes], pa.int64()), pa.array([c.astype("<u4").tobytes() for c in codes], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["rec_id", "n_codes", "codes"])


def fingerprints(media: DataFrame) -> DataFrame:
    """rec_id, n_codes and codes (the packed integers as unsigned 32-bit little-endian bytes) of rec_id and audio."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return prints_of(batch.column("rec_id"), batch.column("audio").to_pylist())

    return common.by_batch(media, each, PRINTS, column="audio")


def vector_fingerprints(vectors: DataFrame) -> DataFrame:
    """fingerprints(render(vectors)) with a recording never leaving its task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                yield prints_of(part.column("vec_id"), [melody(i, v) for i, v in zip(part.column("vec_id").to_pylist(), part.column("embedding").to_pylist(), strict=True)])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(each, PRINTS)


def candidates(q: np.ndarray, of_q: np.ndarray, at_q: np.ndarray, r: np.ndarray, of_r: np.ndarray, at_r: np.ndarray, n: int) -> np.ndarray:
    """Distinct (recording, query, offset) as rows, where two codes agree in three of their four bytes; n: queries."""
    span = int(max(at_q.max(initial=0), at_r.max(initial=0))) + 1
    found = []
    for mask in (0xFFFFFF00, 0xFFFF00FF, 0xFF00FFFF, 0x00FFFFFF):
        order = np.argsort(q & np.uint32(mask), kind="stable")
        keys, own = q[order] & np.uint32(mask), r & np.uint32(mask)
        lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
        i = np.repeat(np.arange(len(r)), hi - lo)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[i]]
        found.append(np.unique((of_r[i] * n + of_q[j]) * (2 * span) + at_r[i] - at_q[j] + span))
    both, offset = np.divmod(np.unique(np.concatenate(found)), 2 * span)
    return np.stack([both // n, both % n, offset - span])


def pairs(queries: list[bytes], recs: list[bytes], votes: int, errors: float) -> Iterator[tuple[np.ndarray, ...]]:
    """query, recording (places in the lists), offset, votes, overlap and error rate of the pairs that align, some recordings at a time.

    An alignment differs in at most ``errors`` of its bits and covers half of the shorter recording, or has
    ``votes`` equal codes. Of several offsets the one with the most agreeing over differing bits counts, the
    lowest at a tie.
    """
    qn, rn = (np.array([len(c) // 4 for c in x]) for x in (queries, recs))
    if not qn.sum() or not rn.sum():
        return
    q = np.frombuffer(b"".join(queries), "<u4")
    of_q, first_q = np.repeat(np.arange(len(qn)), qn), np.cumsum(qn) - qn
    at_q = np.arange(len(q)) - first_q[of_q]
    for lo in range(0, len(recs), ROWS):
        own, n = recs[lo : lo + ROWS], rn[lo : lo + ROWS]
        r = np.frombuffer(b"".join(own), "<u4")
        of_r, first_r = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        rec, query, offset = candidates(q, of_q, at_q, r, of_r, np.arange(len(r)) - first_r[of_r], len(qn))
        a, b = np.maximum(0, -offset), np.maximum(0, offset)
        over = np.minimum(qn[query] - a, n[rec] - b)
        wrong, equal = np.zeros(len(rec), np.int64), np.zeros(len(rec), np.int64)
        for x, y in common.runs(over, CELLS):
            size = over[x:y]
            start = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(start, size)
            d = q[np.repeat(first_q[query[x:y]] + a[x:y], size) + step] ^ r[np.repeat(first_r[rec[x:y]] + b[x:y], size) + step]
            wrong[x:y] = np.add.reduceat(np.bitwise_count(d).astype(np.int64), start)
            equal[x:y] = np.add.reduceat((d == 0).astype(np.int64), start)
        good = np.flatnonzero((wrong <= errors * 32 * over) & ((2 * over >= np.minimum(qn[query], n[rec])) | (equal >= votes)))
        order = good[np.lexsort((offset[good], 2 * wrong[good] - 32 * over[good], query[good], rec[good]))]
        top = np.ones(len(order), bool)
        top[1:] = (rec[order[1:]] != rec[order[:-1]]) | (query[order[1:]] != query[order[:-1]])
        k = order[top]
        yield query[k], rec[k] + lo, offset[k], equal[k], over[k], wrong[k] / (32 * np.maximum(over[k], 1))


def met(queries: DataFrame, prints: DataFrame, each: Callable[[pa.RecordBatch, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Each block of the queries' distinct codes with each part of the recordings', as each(queries, recordings); null ids and empty codes left out.

    Rows are key (the codes' hash), codes and, of queries, n (how many), ids (the two smallest).
    """
    spark, key = prints.sparkSession, F.sha2("codes", 256).alias("key")
    ok = "n_codes > 0 and rec_id is not null"
    q = queries.where(ok).groupBy("codes", "rec_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("codes").orderBy("rec_id"))
    q = q.withColumn("place", place).groupBy("codes").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("place") <= 2, F.col("rec_id")))).alias("ids"))
    q = q.select(key, "codes", "n", "ids")
    q = common.materialize(q, "queries")
    r = prints.where(ok).select("codes").distinct()
    parts = max(common.shuffle_parts(spark), int(prints.count() // PART) + 1)
    n_blocks = int(q.count() // BLOCK) + 1
    q = q.select((F.pmod(F.xxhash64("key"), F.lit(n_blocks))).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(0).alias("side"), "key", "codes", "n", "ids")
    r = r.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("codes"), F.lit(parts)).alias("part"), F.lit(1).alias("side"), key, "codes", F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("ids"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in common.groups(batches, ("block", "part")):
            cut = int(np.searchsorted(g.column("side").to_numpy(), 1))
            if 0 < cut < g.num_rows:
                yield from each(g.slice(0, cut), g.slice(cut))

    return q.union(r).repartition(parts * n_blocks, "block", "part").sortWithinPartitions("block", "part", "side").mapInArrow(meet, schema)


def aligned(queries: DataFrame, prints: DataFrame, votes: int = VOTES, errors: float = ERRORS) -> DataFrame:
    """query_id, rec_id, offset, votes, overlap and error_rate of the recordings that align; a recording not with itself."""

    def each(q: pa.RecordBatch, r: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, *rest in pairs(q.column("codes").to_pylist(), r.column("codes").to_pylist(), votes, errors):
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.float64())
            cols = [q.column("key").take(pa.array(i)), r.column("key").take(pa.array(j)), *(pa.array(x, t) for x, t in zip(rest, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names=["q_key", "r_key", "offset", "votes", "overlap", "error_rate"])

    found = met(queries, prints, each, "q_key string, r_key string, offset int, votes long, overlap long, error_rate double")
    named = lambda d, name, key: d.where("rec_id is not null").select(F.col("rec_id").alias(name), F.sha2("codes", 256).alias(key)).distinct()
    out = found.join(named(queries, "query_id", "q_key"), "q_key").join(named(prints, "rec_id", "r_key"), "r_key").where("query_id <> rec_id")
    return out.select("query_id", "rec_id", "offset", "votes", "overlap", "error_rate")


def tallies(queries: DataFrame, prints: DataFrame, votes: int = VOTES, errors: float = ERRORS) -> DataFrame:
    """key, n (query rows that align with these codes) and tops (their best (error_rate, query_id, offset), the two best of different queries).

    Pairs are summed up where they are found, so that a group of near copies makes no more rows than any other.
    """

    def each(q: pa.RecordBatch, r: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        many, ids, names = q.column("n").to_numpy(), q.column("ids").to_pylist(), r.column("key")
        for i, j, offset, _, _, rate in pairs(q.column("codes").to_pylist(), r.column("codes").to_pylist(), votes, errors):
            n: dict[int, int] = {}
            top: dict[int, list[tuple[float, int, int]]] = {}
            for a, b, o, e in zip(i.tolist(), j.tolist(), offset.tolist(), rate.tolist(), strict=True):
                n[b] = n.get(b, 0) + int(many[a])
                top.setdefault(b, []).extend((e, k, o) for k in ids[a])
            rows = [(b, x) for b, of in top.items() for x in two(of)]
            cols = [names.take(pa.array([b for b, _ in rows], pa.int64())), *(pa.array([x[c] for _, x in rows], t) for c, t in enumerate((pa.float64(), pa.int64(), pa.int32())))]
            lead = [not k or rows[k - 1][0] != b for k, (b, _) in enumerate(rows)]
            cols.append(pa.array([n[b] if first else 0 for (b, _), first in zip(rows, lead, strict=True)], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=["key", "error_rate", "query_id", "offset", "n"])

    found = met(queries, prints, each, "key string, error_rate double, query_id long, offset int, n long")
    best = found.groupBy("key", "query_id").agg(F.min(F.struct("error_rate", "query_id", "offset")).alias("top"), F.sum("n").alias("n"))
    return best.groupBy("key").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("top")).alias("tops"))


def two(found: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """The two lowest of different queries."""
    found = sorted(found)
    return found[:1] + [x for x in found if x[1] != found[0][1]][:1]


def op8_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each recording: rec_id, n_codes, codes_sha256, n_matches (queries that align with it) and the best one's query_id, offset and error_rate."""
    prints = common.materialize(vector_fingerprints(common.read(spark, sf_dir, "embeddings")), "prints")
    return with_matches(prints, prints.where("rec_id % 50 = 0"))


def with_matches(prints: DataFrame, queries: DataFrame) -> DataFrame:
    """prints with what aligns; query rows of a recording's own id and codes are not counted, and its own id is never its best query."""
    key = F.sha2("codes", 256).alias("codes_sha256")
    own = queries.where("rec_id is not null and n_codes > 0").groupBy(F.col("rec_id").alias("i"), F.sha2("codes", 256).alias("k")).agg(F.count("*").alias("own"))
    p = prints.select("rec_id", "n_codes", key)
    out = p.join(tallies(queries, prints), F.col("key") == F.col("codes_sha256"), "left").join(own, (F.col("i") == F.col("rec_id")) & (F.col("k") == F.col("codes_sha256")), "left")
    real = F.col("rec_id").isNotNull()
    best = F.when(real, F.get(F.filter("tops", lambda x: x["query_id"] != F.col("rec_id")), F.lit(0)))
    n = F.when(real, F.coalesce("n", F.lit(0)) - F.coalesce("own", F.lit(0))).otherwise(0)
    return out.select("rec_id", "n_codes", "codes_sha256", n.alias("n_matches"), best.alias("best")).select("rec_id", "n_codes", "codes_sha256", "n_matches", "best.query_id", "best.offset", "best.error_rate")
