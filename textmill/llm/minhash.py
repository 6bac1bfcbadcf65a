"""Operator 9: near-duplicate documents by MinHash with sequential Bayesian verification.

A document's words (ASCII lower-cased) give its set of shingles. Documents with equal sets form a
class, represented by its smallest doc_id. Representatives get a signature of 125 one-byte minima,
cut into 25 bands of 5; equal bands make candidates. Within a band's bucket, signatures are compared
batch by batch, and a pair is dropped once the posterior probability (uniform prior) that its
similarity reaches the threshold is below ``miss``. A pair is looked at in its first common band only.

What is left is verified exactly on the full sets, in the same cell: only members of a surviving pair
bring their texts. A cell puts out a spanning forest of its verified links, so that a large group never
puts out all its pairs and no link between groups is lost. A bucket above ``block`` members is cut to
blocks of its members; each is verified by itself, together with a few pivots that all blocks hold. The
links so far are contracted to components, and only members outside the bucket's largest component meet
the other blocks, as pairs within a component need no link. So a group of near copies travels once, not
once for each of its blocks, and what is left open is verified all the same.

Shingles and sets are told apart by 64- and 128-bit hashes of their words; with some thousand shingles in a
pair of texts the odds that a hash changes a decision are below 1e-12 a pair.

Defined cases: a null or blank text has no shingles and is linked with nothing; a null doc_id is linked
with nothing, has component null and is kept; rows that repeat both id and text get the same result;
rows that share a doc_id but not a text are one node of the graph; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import common, hashing

BANDS, ROWS, MISS, BLOCK = 25, 5, 1e-4, 768
LANES = BANDS * ROWS
EMPTY = bytes(16)


def multipliers() -> np.ndarray:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 31, LANES, np.uint32) * np.uint32(2) + np.uint32(1)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, cls (16 bytes that equal sets share) and sig (a byte for each lane)."""
    a = multipliers()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, at = common.utf8(batch.column("text"))
        row, h = hashing.shingles(raw, at, k)
        n = np.bincount(row, minlength=len(at) - 1)
        full = np.flatnonzero(n)
        sig, cls = np.zeros((len(n), LANES), np.uint8), np.zeros((len(n), 2), np.uint64)
        if len(full):
            begin = np.searchsorted(row, full)
            x = (h >> np.uint64(32)).astype(np.uint32)
            low = np.empty((LANES, len(full)), np.uint32)
            for j in range(LANES):
                low[j] = np.minimum.reduceat(x * a[j] + np.uint32(j), begin)
            sig[full] = (hashing.mixed(low.astype(np.uint64)) & np.uint64(255)).T
            for j in range(2):
                cls[full, j] = np.add.reduceat(hashing.mixed(h, 7 + j), begin) + n[full].astype(np.uint64)
        cols = [
            batch.column("doc_id"), pa.array(n.astype(np.int64)),
            pa.array([c.tobytes() for c in cls], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "cls", "sig"])

    doc_id = dict(docs.dtypes)["doc_id"]
    return common.by_batch(docs.select("doc_id", "text"), each, f"doc_id {doc_id}, n_shingles long, cls binary, sig binary")


def least_matches(threshold: float, miss: float = MISS, batch: int = BANDS) -> list[tuple[int, int]]:
    """(lanes compared, matches below which the posterior of reaching the threshold is under miss)."""
    j = (np.arange(20000) + 0.5) / 20000
    r = j + (1 - j) / 256
    out = []
    for n in range(batch, LANES + 1, batch):
        for m in range(n + 1):
            logs = m * np.log(r) + (n - m) * np.log1p(-r)
            mass = np.exp(logs - logs.max())
            if mass[j >= threshold].sum() / mass.sum() >= miss:
                out.append((n, m))
                break
    return out


def survivors(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, band: int, least: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """Of the pairs (x, y) of rows of a and b, those whose first common band is this one and that no batch rules out; and their matches."""
    same, lo = np.zeros(len(x), np.int32), 0
    for n, m in least:
        equal = a[x, lo:n] == b[y, lo:n]
        common_bands = equal.reshape(len(x), (n - lo) // ROWS, ROWS).all(2)
        earlier = common_bands[:, : max(0, band - lo // ROWS)].any(1)
        same = same + equal.sum(1, dtype=np.int32)
        keep = ~earlier & (same >= m)
        x, y, same, lo = x[keep], y[keep], same[keep], n
    return x, y, same


def forest(n: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indices of the pairs that make a maximum spanning forest over n rows (Boruvka's rounds)."""
    if len(x) <= 1:
        return np.arange(len(x))
    rank = np.empty(len(x), np.int64)
    rank[np.argsort(-weight, kind="stable")] = np.arange(len(x))
    label, chosen = np.arange(n), []
    live = np.arange(len(x))
    while len(live):
        best = np.full(n, len(x))
        np.minimum.at(best, label[x[live]], rank[live])
        np.minimum.at(best, label[y[live]], rank[live])
        by_rank = np.empty(len(x), np.int64)
        by_rank[rank] = np.arange(len(x))
        new = by_rank[np.unique(best[best < len(x)])]
        chosen.append(new)
        p, q = label[x[new]], label[y[new]]
        while True:  # hook the larger label to the smaller until the labels settle
            low = np.minimum(p, q)
            up = np.arange(n)
            np.minimum.at(up, np.maximum(p, q), low)
            while (up != up[up]).any():
                up = up[up]
            label, p, q = up[label], up[p], up[q]
            if (p == q).all():
                break
        live = live[label[x[live]] != label[y[live]]]
    return np.unique(np.concatenate(chosen))


def buckets(sigs: DataFrame, block: int) -> DataFrame:
    """key, band, n (members), pivots (up to four of them, above ``block`` members) and id: the bands that at least two representatives share."""
    e = sigs.select("id", F.posexplode(F.array(*[F.xxhash64(F.lit(b), F.substring("sig", b * ROWS + 1, ROWS)) for b in range(BANDS)])).alias("band", "key"))
    mixed = F.xxhash64("id")
    n = e.groupBy("key").agg(F.count("*").alias("n"), F.array(F.min("id"), F.max("id"), F.min_by("id", mixed), F.max_by("id", mixed)).alias("pivots")).where("n > 1")
    n = n.withColumn("pivots", F.when(F.col("n") > block, F.col("pivots")).otherwise(F.array().cast("array<bigint>")))
    return e.join(n, "key")


def cells(members: DataFrame, block: int) -> DataFrame:
    """members (key, band, n, pivots, id) dealt to cells (key, p, q), here p = q: the blocks of a bucket above ``block`` members, pivots in each."""
    c = members.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    c = c.withColumn("p", F.explode(F.when(F.array_contains("pivots", F.col("id")), every).otherwise(F.array("own"))))
    return c.select("key", "p", F.col("p").alias("q"), F.col("p").alias("own"), "band", "id")


def open_cells(members: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """Cells of blocks for the buckets above ``block`` members whose members parts (node, component) leaves in several components.

    Members of the largest component are blocks that meet the others' blocks only; those meet each other, too.
    """
    big = members.where(F.col("n") > block).join(parts, F.col("id") == F.col("node"), "left").select("key", "band", "id", F.coalesce("component", "id").alias("part"))
    size = big.groupBy("key", "part").agg(F.count("*").alias("size"))
    main = size.groupBy("key").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("n")).where("most < n")
    c = big.join(main, "key").withColumn("a", F.ceil(F.col("most") / block)).withColumn("b", F.ceil((F.col("n") - F.col("most")) / block))
    inner = F.col("part") == F.col("main")
    c = c.withColumn("own", F.when(inner, F.pmod(F.xxhash64("id"), "a")).otherwise(F.col("a") + F.pmod(F.xxhash64("id"), "b")))
    c = c.withColumn("other", F.explode(F.sequence(F.when(inner, F.col("a")).otherwise(F.lit(0).cast("long")), F.col("a") + F.col("b") - 1)))
    return c.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "band", "id")


def in_cells(rows: DataFrame, each, schema: str) -> DataFrame:
    parts = common.shuffle_parts(rows.sparkSession)
    return rows.repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q").mapInArrow(each, schema)


def candidates(part: pa.RecordBatch, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a cell's rows that no batch of lanes rules out and whose first common band is the cell's."""
    ids, own = part.column("id").to_numpy(), part.column("own").to_numpy()
    sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(-1, LANES)
    p, q, band = (part.column(c)[0].as_py() for c in ("p", "q", "band"))
    found = []
    for lo in range(0, len(ids), 128):  # 128 rows against all, to bound the arrays
        x, y = (z.ravel() for z in np.meshgrid(np.arange(lo, min(lo + 128, len(ids))), np.arange(len(ids)), indexing="ij"))
        good = (ids[x] < ids[y]) if p == q else (own[x] == p) & (own[y] == q) & (ids[x] != ids[y])
        found.append(survivors(sig, sig, x[good], y[good], band, least)[:2])
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def similar(texts: pa.Array, x: np.ndarray, y: np.ndarray, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the full sets of the pairs (x, y) of texts reach the threshold, and their intersections' sizes."""
    raw, at = common.utf8(texts)
    found = [(lo, *hashing.shingles(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], k)) for lo, hi in common.runs(np.diff(at), common.RUN_BYTES)]
    row, h = np.concatenate([lo + r for lo, r, _ in found]), np.concatenate([g for _, _, g in found])
    _, name = np.unique(h, return_inverse=True)
    begin = np.searchsorted(row, np.arange(len(at)))
    size = np.diff(begin)
    there, both = np.zeros(len(h), bool), np.zeros(len(x), np.int64)
    for i in np.unique(x):
        there[name[begin[i] : begin[i + 1]]] = True
        for at_ in np.array_split(np.flatnonzero(x == i), 1 + (x == i).sum() // 256):
            other = y[at_]
            ends = np.cumsum(size[other])
            flat = np.repeat(begin[other] - ends + size[other], size[other]) + np.arange(ends[-1])
            both[at_] = np.add.reduceat(there[name[flat]].astype(np.int64), ends - size[other])
        there[name[begin[i] : begin[i + 1]]] = False
    return 100 * both >= percent * (size[x] + size[y] - both), both


def links(dealt: DataFrame, sigs: DataFrame, docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """a, b: in each of the cells a spanning forest of the pairs that reach the threshold exactly."""
    least = least_matches(percent / 100, miss)

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.groups(batches, ("key", "p", "q")):
            x, y = candidates(part, least)
            if len(x):
                yield part.take(pa.array(np.union1d(x, y))).drop_columns(["sig"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.groups(batches, ("key", "p", "q")):
            x, y = candidates(part, least)
            good, both = similar(part.column("text"), x, y, k, percent)
            x, y, both = x[good], y[good], both[good]
            pick = forest(part.num_rows, x, y, both)
            ids = part.column("id").to_numpy()
            a, b = ids[x[pick]], ids[y[pick]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    dealt = in_cells(dealt.join(sigs, "id"), live, "id long, key long, p long, q long, own long, band int")
    dealt = common.materialize(dealt, "live")
    return in_cells(dealt.join(sigs, "id").join(texts, "id"), verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept."""
    own = common.materialize(sketch(docs, k), "sketch")
    ids = own.where("doc_id is not null and n_shingles > 0").select(F.col("doc_id").cast("long").alias("id"), "cls", "sig")
    reps = common.materialize(ids.groupBy("cls").agg(F.min("id").alias("rep")), "classes")
    sigs = ids.join(reps, "cls").where("id = rep").select("id", "sig").distinct()
    members = common.materialize(buckets(sigs, block), "members")
    found = common.materialize(links(cells(members, block), sigs, docs, k, percent, miss), "links")
    parts = common.materialize(common.components(found), "parts")
    named = reps.join(parts, reps.rep == parts.node, "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    if not members.where(F.col("n") > block).isEmpty():
        more = common.materialize(links(open_cells(members, parts, block), sigs, docs, k, percent, miss), "links")
        if not more.isEmpty():
            # links between components, by the components' names
            label = lambda d, c: d.join(parts.select(F.col("node").alias(f"n_{c}"), F.col("component").alias(f"c_{c}")), F.col(c) == F.col(f"n_{c}"), "left").withColumn(c, F.coalesce(f"c_{c}", c)).select("a", "b")
            joined = common.components(label(label(more, "a"), "b").distinct())
            named = named.join(joined, F.col("component_id") == F.col("node"), "left").select("cls", F.coalesce("component", "component_id").alias("component_id"))
    out = own.join(named.withColumnRenamed("cls", "c"), own.cls == F.col("c"), "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id").cast("long")).alias("component_id"),
    )
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents"))
