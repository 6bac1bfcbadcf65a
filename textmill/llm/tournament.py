"""Operator 13: centroid clustering by a bisector tournament.

Vectors of ``DIM`` components are turned into integers floor(64 * x). For each pair of centroids a < b the
integer normal 2 (b - a) and the threshold |b|^2 - |a|^2 are computed once a round; a vector is nearer to b
just when its product with the normal exceeds the threshold, and a product that equals it favours a. A vector
passes k - 1 such tests, each of which eliminates the loser; only for the winner is a distance taken, exactly.

A round is one Spark job: tasks hold the k centroids (at most ``K`` by ``DIM`` integers), and put out each
cluster's count and component sums, which Spark adds up; the driver sees K * DIM sums. Nothing else leaves the
tasks. All arithmetic is exact: vectors with a component beyond 2^24 go through Python's integers, and sums
travel in digits of 40 bits.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out;
a null vec_id hashes as ``1:`` and is a vector like any other; vectors of one vec_id have one hash and start
in the order of their components; with fewer than K vectors there are as many centroids; of equal centroids the
smaller number wins, so the other ones stay empty; a distance or an inertia beyond the range of long is null;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm import common

DIM, SCALE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Products of components below WIDE fit 64 bits; rows that are worked on at once; sums travel in digits of 2^DIGIT.
WIDE, ROWS, DIGIT = 1 << 24, 4096, 40


def integers(column: pa.Array, dim: int = DIM, scale: int = SCALE) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers and floor(scale * x) of lists of dim numbers, in blocks; int64, or Python's integers where one is large."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    for lo in range(0, len(values), ROWS):
        x = values[lo : lo + ROWS]
        large = np.abs(x).max(initial=0) >= WIDE / scale
        if not large:
            yield lo, np.floor(x * scale).astype(np.int64)
        else:  # scale * x may pass the largest double, so the product is taken as a fraction
            exact = lambda v: (scale * (r := v.as_integer_ratio())[0]) // r[1]
            yield lo, np.array([[exact(v) for v in row] for row in x.tolist()], object)


class Bisectors:
    """Normals and thresholds of all pairs of the centroids."""

    def __init__(self, centroids: list[list[int]]) -> None:
        wide = max((abs(v) for c in centroids for v in c), default=0) >= WIDE
        self.centroids = np.array(centroids, object if wide else np.int64)
        norms = (self.centroids**2).sum(1)
        self.normals = 2 * (self.centroids[None] - self.centroids[:, None])
        self.thresholds = norms[None] - norms[:, None]

    def winners(self, x: np.ndarray) -> np.ndarray:
        best = np.zeros(len(x), np.int64)
        for j in range(1, len(self.centroids)):
            side = (x * self.normals[best, j]).sum(1) - self.thresholds[best, j]
            best[(side > 0).astype(bool)] = j
        return best

    def distances(self, x: np.ndarray, of: np.ndarray) -> np.ndarray:
        return ((x - self.centroids[of]) ** 2).sum(1)


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and embedding of the vectors with dim finite components."""
    e = F.col("embedding")
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select("vec_id", "embedding").where(F.coalesce((F.size(e) == dim) & fine, F.lit(False)))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    """The k vectors of the smallest hashes; no more than k rows come to the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.withColumn("key", key).orderBy("key", "embedding").limit(k).select("embedding").collect()
    return [[int(v) for v in x[0]] for r in rows for _, x in integers(pa.array([r.embedding], pa.list_(pa.float64())), len(r.embedding))]


def digits(n: int) -> list[tuple[int, int]]:
    """(place, digit) of an integer in base 2^DIGIT, zeros left out; a negative number has negative digits."""
    out, rest, place = [], abs(n), 0
    while rest:
        if d := rest & (1 << DIGIT) - 1:
            out.append((place, -d if n < 0 else d))
        rest >>= DIGIT
        place += 1
    return out


def next_centroids(kept: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: the floor of each cluster's mean; empty clusters stay."""
    own, dim = Bisectors(centroids), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(centroids), dim), object), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, x in integers(batch.column("embedding"), dim):
                of = own.winners(x)
                for c in np.unique(of).tolist():
                    total[c] += x[of == c].sum(0).astype(object)
                count += np.bincount(of, minlength=len(count))
        rows = [(c, -1, 0, n) for c, n in enumerate(count.tolist()) if n]
        rows += [(c, i, place, d) for c in range(len(total)) for i in range(dim) for place, d in digits(int(total[c, i]))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["cluster", "component", "place", "digit"])

    found = kept.select("embedding").mapInArrow(sums, "cluster long, component long, place long, digit long")
    found = found.groupBy("cluster", "component", "place").agg(F.sum(F.col("digit").cast("decimal(20,0)")).cast("string").alias("digit"))
    total: dict[tuple[int, int], int] = {}
    for r in found.collect():  # K * (DIM + 1) sums of a few digits each
        total[r.cluster, r.component] = total.get((r.cluster, r.component), 0) + (int(r.digit) << DIGIT * r.place)
    return [[total.get((c, i), 0) // n for i in range(dim)] if (n := total.get((c, -1), 0)) else old for c, old in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance of each usable vector, and the final centroids."""
    kept = usable(vectors, dim)
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(kept, centroids)
    own = Bisectors(centroids) if centroids else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, x in integers(batch.column("embedding"), dim):
                of = own.winners(x)
                far = [d if d < 1 << 63 else None for d in own.distances(x, of).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(lo, len(x)), pa.array(of, pa.int32()), pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = dict(kept.dtypes)["vec_id"]
    return kept.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), centroids


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256."""
    spark = vectors.sparkSession
    found, centroids = cluster(vectors, k, rounds, dim, seed)
    found = common.materialize(found, "clusters")
    parts = found.groupBy("cluster").agg(
        F.count_if(F.col("distance").isNull()).alias("wide"), F.sum(F.col("distance").cast("decimal(20,0)")).cast("string").alias("sum"))
    sums = {r.cluster: None if r.wide else int(r.sum) for r in parts.collect()}  # K rows
    whole = None if None in sums.values() else sum(sums.values())
    fits = lambda n: n if n is not None and n < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = spark.createDataFrame([(c, fits(n), fits(whole), names[c]) for c, n in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # K rows


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(common.read(spark, sf_dir, "embeddings"))
