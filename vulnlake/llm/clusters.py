"""Centroid clustering with Elkan's bounds and exact integer distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, free_names, stage

#: Components beyond this are set to it: squared distances of 64 such components just fit 64 bits.
LARGEST = 2**27
#: What a double computed from exact integers by a root and a few sums may be off by, many times over.
_SLACK = 1e-12


def quantised(vectors: DataFrame, vector: str = "embedding", dims: int = 64, scale: int = 256) -> DataFrame:
    """Rows whose vector has ``dims`` components, none null or non-finite; the vector as integers floor(scale * x)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    return vectors.where((F.size(vector) == dims) & finite).withColumn(vector, whole)


def _between(centroids: np.ndarray) -> np.ndarray:
    """Distances between centroids, rounded down."""
    square = np.stack([((centroids - c) ** 2).sum(1) for c in centroids]) if len(centroids) else np.zeros((0, 0))
    return np.sqrt(square.astype(np.float64)) * (1 - _SLACK)


def elkan_step(q: np.ndarray, centroids: np.ndarray, between: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, int]:
    """Assign rows of ``q`` to their nearest centroids, ties to the smaller number; bounds and clusters change in place.

    A centroid is passed over where its lower bound, or half its distance from the row's centroid, is strictly above
    the upper bound, so ties are always computed. Distances are exact integers; only bounds are rounded, to the
    safe side. Returns which rows changed cluster, and how many distances were computed.
    """
    k = len(centroids)
    apart = between + np.where(np.eye(k, dtype=bool), np.inf, 0)
    rows = np.flatnonzero(upper >= 0.5 * apart.min(1)[cluster]) if k > 1 else np.zeros(0, np.int64)
    was = cluster.copy()
    if not len(rows):
        return was != cluster, 0
    x, own, low = q[rows], cluster[rows], lower[rows]
    best = ((x - centroids[own]) ** 2).sum(1)
    top = np.sqrt(best.astype(np.float64)) * (1 + _SLACK)
    low[np.arange(len(rows)), own] = top * (1 - 4 * _SLACK)
    done = len(rows)
    for j in range(k):
        at = np.flatnonzero((own != j) & (low[:, j] <= top) & (0.5 * between[own, j] <= top))
        if not len(at):
            continue
        d = ((x[at] - centroids[j]) ** 2).sum(1)
        done += len(at)
        root = np.sqrt(d.astype(np.float64))
        low[at, j] = root * (1 - _SLACK)
        nearer = (d < best[at]) | ((d == best[at]) & (j < own[at]))
        to = at[nearer]
        own[to], best[to], top[to] = j, d[nearer], root[nearer] * (1 + _SLACK)
    cluster[rows], upper[rows], lower[rows] = own, top, low
    return was != cluster, done


def _rounded_down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _pass(dims: int, centroids: np.ndarray, moved: np.ndarray | None, last: bool, state: list[str], vector: str, block: int = 4096):
    """One assignment of a task's rows: columns of ``state`` (cluster, upper, lower, distance) are made or replaced."""
    k, between = len(centroids), _between(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                batch = whole.slice(start, block)
                n = batch.num_rows
                q = _matrix(batch.column(vector), dims, np.int64)
                if moved is None:
                    cluster, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros((n, k))
                else:
                    cluster = batch.column(state[0]).to_numpy(zero_copy_only=False).astype(np.int64)
                    upper = (batch.column(state[1]).to_numpy(zero_copy_only=False) + moved[cluster]) * (1 + _SLACK)
                    lower = np.maximum((_matrix(batch.column(state[2]), k, np.float64) - moved) * (1 - _SLACK), 0)
                _, done = elkan_step(q, centroids, between, cluster, upper, lower)
                exact = ((q - centroids[cluster]) ** 2).sum(1) if last else np.zeros(n, np.int64)
                bounds = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * k, pa.array(_rounded_down(lower).reshape(-1)))
                computed = np.zeros(n, np.int64)
                computed[:1] = done
                made = dict(zip(state, (pa.array(cluster.astype(np.int32)), pa.array(upper), bounds, pa.array(exact), pa.array(computed)), strict=True))
                names = [c for c in batch.schema.names if c not in made] + state
                yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names=names)

    return assign


def cluster_vectors(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2", counts: list | None = None) -> DataFrame:
    """Cluster vectors around ``k`` centroids in ``rounds`` rounds, each vector with the nearest, by Elkan's bounds.

    Vectors are ``quantised``; the others are left out. The first centroids are the ``k`` vectors with the smallest SHA-256 of
    "``seed``:id". A round assigns every vector, then puts each non-empty centroid at floor(sum / count) of its
    vectors; a last assignment follows. A vector's upper bound and its ``k`` lower bounds (as floats, rounded down) go with it from
    round to round, written to the shared folder, so a lost executor repeats one round's tasks at most. Sums are pre-aggregated
    in the tasks and grouped by cluster, so only ``k`` rows reach the driver and a cluster with most vectors is no hot key.

    Result: columns of ``vectors`` but the vector, plus cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256 (of the final centroid's components as decimal integers joined by commas); columns with these names are replaced. With fewer
    than ``k`` vectors each is a centroid. Rows that repeat an id are vectors of their own, equal hashes come in the order of their components.
    A row without an id is clustered but comes last among the first centroids. Components are limited to +-2**27 after scaling. An
    empty table gives an empty result. ``counts`` receives the number of distances computed in each pass.
    """
    results = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    rest = [c for c in vectors.columns if c != vector and c not in results]
    rows = quantised(vectors, vector, dims, scale).select(*rest, vector)
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).asc_nulls_last(), F.col(vector).asc()]
    centroids = np.array([r[0] for r in rows.orderBy(*order).select(vector).limit(k).collect()], np.int64).reshape(-1, dims)
    state = free_names(rows, "cluster", "upper", "lower", "distance", "computed")
    types = [f"`{c}` {t}" for c, t in zip(state, ("int", "double", "array<float>", "bigint", "bigint"), strict=True)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + types)
    moved, held = None, rows
    for n in range(rounds + 1 if len(centroids) else 0):
        after = stage(held.mapInArrow(_pass(dims, centroids, moved, n == rounds, state, vector), schema), "clusters")
        if held is not rows:
            drop_staged(held)
        held = after
        if counts is not None:
            counts.append(held.agg(F.sum(state[4])).first()[0])
        if n < rounds:
            sums = held.groupBy(state[0]).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.col(vector)[i]) for i in range(dims))).alias("s")).collect()
            new = centroids.copy()
            for r in sums:
                new[r[0]] = [s // r.n for s in r.s]
            moved = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)) * (1 + _SLACK)
            centroids = new
    if not len(centroids):
        return rows.select(*rest, F.lit(0).alias("cluster"), *(F.lit(0).cast("bigint").alias(c) for c in results[1:4]), F.lit("").alias("centroid_sha256")).limit(0)
    sizes = dict(held.groupBy(state[0]).agg(F.sum(state[3])).collect())
    known = [(j, sizes.get(j, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    about = held.sparkSession.createDataFrame(known, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    out = held.select(*rest, F.col(state[0]).alias("cluster"), F.col(state[3]).alias("distance")).join(F.broadcast(about), "cluster")
    return out.select(*rest, "cluster", "distance", "cluster_inertia", F.lit(sum(sizes.values())).cast("bigint").alias("inertia"), "centroid_sha256")
