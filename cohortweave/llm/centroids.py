"""Centroid clustering of integer vectors through scalar lookup tables.

A component x counts as the integer floor(scale * x). In every round, and for every dimension, the
squared differences of the integers that occur there to each centroid's component are tabulated;
distances are gathered from these tables and added up. Sums and counts of a round are aggregated
per task and then by Spark, so only k centroids pass through the driver. All arithmetic is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cohortweave.session import materialize

#: Rows whose distances are held at once.
ROWS = 8_192
#: Integers of at least this size would overflow the distances, which are longs.
LARGEST = 1 << 27


def occurring(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and the place of each value among them."""
    low, high = int(values.min()), int(values.max())
    if high - low > 4 * len(values) + 1024:
        return np.unique(values, return_inverse=True)
    there = np.zeros(high - low + 1, bool)
    there[values - low] = True
    place = np.cumsum(there) - 1
    return np.flatnonzero(there) + low, place[values - low]


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distance of every vector to every centroid, as sums of looked-up squares."""
    out = np.zeros((len(vectors), len(centroids)), np.int64)
    for d in range(vectors.shape[1] if len(vectors) else 0):
        values, place = occurring(vectors[:, d])
        table = (values[:, None] - centroids[None, :, d]) ** 2
        out += table[place]
    return out


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equals) and the squared distance."""
    far = distances(vectors, centroids)
    own = far.argmin(axis=1)
    return own, far[np.arange(len(far)), own]


def integers(column: pa.Array, size: int, scale: float) -> np.ndarray:
    """floor(scale * x) of an array column of ``size`` finite components each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(scale * flat)
    if len(whole) and np.abs(whole).max() >= LARGEST:
        raise ValueError(f"components of {LARGEST / scale} or more in size are too large for exact distances")
    return np.ascontiguousarray(whole.astype(np.int64).reshape(-1, size))


def _each(size: int, scale: float) -> Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]:
    """Slices of a batch's vectors (its second column), with where each begins."""

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for at in range(0, batch.num_rows, ROWS):
            yield at, integers(batch.column(1).slice(at, ROWS), size, scale)

    return parts


def starts(kept: DataFrame, k: int, seed: int, size: int, scale: float) -> list[list[int]]:
    """The vectors with the k smallest SHA-256 of ``seed:key``; of one key's the smallest, then repeated."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    rows: list[Row] = kept.where("key is not null").orderBy(named, "vector").limit(k).collect()
    return integers(pa.array([r.vector for r in rows], pa.list_(pa.float64())), size, scale).tolist() if rows else []


def cluster(
    table: DataFrame,
    key: str,
    vector: str,
    k: int = 16,
    size: int = 64,
    scale: float = 64.0,
    rounds: int = 3,
    seed: int = 1,
) -> DataFrame:
    """Per kept row: ``key``, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Rows are kept whose vector has ``size`` components, none null or non-finite. Centroids start as
    the k kept vectors with the smallest SHA-256 of ``seed:key`` (fewer rows: fewer centroids); each
    round assigns all vectors to the nearest (ties: the smaller number) and moves each centroid to the
    floor of its vectors' mean; empty ones stay. Repeated rows count each. Rows with a null key are
    assigned and count, but never start a centroid; if no kept row has a key, there are no rows, as
    for an empty table. Other columns are ignored. A component of 2^27 / ``scale`` or more in size is
    an error, as no distance could be given as a long.
    """
    spark = table.sparkSession
    kind = table.schema[key].dataType.simpleString()
    named = table.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    infinite = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    kept = named.where((F.size("vector") == size) & finite)
    schema = (
        f"`{key}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    )
    centroids = starts(kept, k, seed, size, scale)
    if not centroids:
        return spark.createDataFrame([], schema)
    parts = _each(size, scale)

    for _ in range(rounds):
        now = np.array(centroids, np.int64)

        def add_up(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((len(now), size), np.int64), np.zeros(len(now), np.int64)
            for batch in batches:
                for _, vectors in parts(batch):
                    own, _ = nearest(vectors, now)
                    counts += np.bincount(own, minlength=len(now))
                    order = np.argsort(own, kind="stable")
                    there, first = np.unique(own[order], return_index=True)
                    sums[there] += np.add.reduceat(vectors[order], first, axis=0)
            there = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(there.astype(np.int32)), pa.array(counts[there]), pa.array(list(sums[there]), pa.list_(pa.int64()))],
                names=["cluster", "n", "sums"],
            )

        partial = kept.mapInArrow(add_up, "cluster int, n bigint, sums array<bigint>")
        moved = partial.groupBy("cluster").agg(
            F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")).alias(f"s{d}") for d in range(size)]
        )
        for r in moved.collect():  # at most k rows
            centroids[r.cluster] = [int(r[f"s{d}"]) // r.n for d in range(size)]

    last = np.array(centroids, np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, vectors in parts(batch):
                own, far = nearest(vectors, last)
                keys = batch.column(0).slice(at, ROWS)
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(own.astype(np.int32)), pa.array(far)], names=[key, "cluster", "distance"]
                )

    assigned = materialize(kept.mapInArrow(assign, f"`{key}` {kind}, cluster int, distance bigint"))
    inertia = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    of = lambda values, to: F.get(F.array(*[F.lit(v).cast(to) for v in values]), F.col("cluster"))
    named_by = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return assigned.select(
        key,
        "cluster",
        "distance",
        of([inertia.get(c, 0) for c in range(len(centroids))], "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("bigint").alias("inertia"),
        of(named_by, "string").alias("centroid_sha256"),
    )


__all__ = ["cluster", "distances", "nearest", "occurring"]
