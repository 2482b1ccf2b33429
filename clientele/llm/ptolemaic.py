"""Centroid clustering of integer vectors with Ptolemaic pivots.

Lloyd's rounds with exact integer distances. A few pivots are fixed at the start
and every vector's distances to them are computed once and stored. In each round
the centroids' distances to the pivots give, by Ptolemy's inequality over fixed
pairs of pivots p, s,

    d(v, c) >= |d(v, p) d(c, s) - d(v, s) d(c, p)| / d(p, s),

a lower bound for every vector and centroid without touching the components. The
centroid of the least bound is measured first; of the others only those whose
bound, rounded down by more than the error of its arithmetic, does not exceed that
distance are measured, in integers. So the bounds spare work and never decide.

Each task sums its vectors per cluster, so k rows a task are shuffled however many
vectors are alike; k centroids and the pivots are all that the driver holds.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import written

PIVOTS, PAIRS = 8, 12
SAMPLE = 64  # vectors among which the pivots are chosen, those of smallest hash
LARGEST = 1 << 26  # components from here on would not leave squared distances of 64 of them in 63 bits
SLACK = 1e-12  # relative; the bounds' arithmetic errs by a few units of 2**-53
ROWS = 8192  # vectors worked on at once


def quantised(df: DataFrame, id_col: str, vec_col: str, size: int, scale: int) -> DataFrame:
    """``vec_id, v``: vectors of exactly ``size`` finite components x as integers floor(scale x)."""
    x = F.transform(F.col(vec_col).cast("array<double>"), lambda c: c * F.lit(float(scale)))
    fine = F.coalesce((F.size(x) == size) & F.forall(x, lambda c: F.coalesce(F.abs(c) < float(LARGEST), F.lit(False))), F.lit(False))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(fine).select("vec_id", F.transform("x", lambda c: F.floor(c)).alias("v"))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of a to the rows of b."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def choose_pivots(vectors: np.ndarray) -> np.ndarray:
    """Each next one farthest from those before; no two alike."""
    if not len(vectors):
        return vectors
    chosen, far = [0], _squares(vectors, vectors[:1])[:, 0]
    while len(chosen) < PIVOTS and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _squares(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


class Bounds:
    """Lower bounds of the distances to centroids from distances to pivots."""

    def __init__(self, pivots: np.ndarray, centroids: np.ndarray):
        among, to = np.sqrt(_squares(pivots, pivots).astype(float)), np.sqrt(_squares(centroids, pivots).astype(float))
        # the pairs that lie farthest apart, each (p, s) with its distance; none if all vectors are alike
        pairs = sorted(itertools.combinations(range(len(pivots)), 2), key=lambda x: -among[x])[:PAIRS]
        self.pairs = [(p, s, among[p, s], to[:, p], to[:, s]) for p, s in pairs]
        self.k = len(centroids)

    def squares(self, to_pivots: np.ndarray) -> np.ndarray:
        """Per row of squared pivot distances and centroid a number that the squared distance is not below."""
        d = np.sqrt(to_pivots.astype(float))
        best = np.zeros((len(d), self.k))
        for p, s, apart, cp, cs in self.pairs:
            one, two = d[:, p:p + 1] * cs, d[:, s:s + 1] * cp
            np.maximum(best, (np.abs(one - two) - SLACK * (one + two)) / apart, out=best)
        return best * best * (1 - 4 * SLACK)


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) and exact squared distance of each row; how many distances were measured."""
    least = bounds.squares(to_pivots)
    own = least.argmin(axis=1)
    best = ((v - centroids[own]) ** 2).sum(axis=1)
    measured = len(v)
    for c in range(len(centroids)):
        rows = np.flatnonzero((own != c) & (least[:, c] <= best * (1 + SLACK)))
        if len(rows):
            d = ((v[rows] - centroids[c]) ** 2).sum(axis=1)
            measured += len(rows)
            better = (d < best[rows]) | ((d == best[rows]) & (c < own[rows]))
            best[rows[better]], own[rows[better]] = d[better], c
    return own, best, measured


def _arrays(column, width: int) -> np.ndarray:
    """A column of lists of the same length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width) if width else np.zeros((len(column), 0), np.int64)


def _parts(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _measure(pivots: np.ndarray):
    def run(batches):
        for part in _parts(batches):
            to = _squares(_arrays(part.column("v"), pivots.shape[1]), pivots)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(list(to), pa.list_(pa.int64()))], names=["vec_id", "v", "p"])
    return run


def _sums(pivots: np.ndarray, centroids: np.ndarray):
    """Per task and cluster the number and the sum of its vectors."""
    def run(batches):
        bounds, k, size = Bounds(pivots, centroids), *centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for part in _parts(batches):
            v = _arrays(part.column("v"), size)
            own, _, _ = nearest(v, _arrays(part.column("p"), len(pivots)), centroids, bounds)
            count += np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            there, first = np.unique(own[order], return_index=True)
            total[there] += np.add.reduceat(v[order], first, axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "total"])
    return run


def _assign(pivots: np.ndarray, centroids: np.ndarray):
    def run(batches):
        bounds = Bounds(pivots, centroids)
        for part in _parts(batches):
            own, best, _ = nearest(_arrays(part.column("v"), centroids.shape[1]), _arrays(part.column("p"), len(pivots)), centroids, bounds)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(own, pa.int32()), pa.array(best)], names=["vec_id", "cluster", "distance"])
    return run


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per kept vector ``vec_id, cluster, distance, cluster_inertia, inertia, centroid``.

    Kept are vectors of exactly ``size`` components, none null or non-finite, as integers floor(scale x). The first
    centroids are the ``k`` vectors of smallest sha256 of ``seed:id``; ``rounds`` times every vector goes to the nearest
    (squared distance, ties to the smaller number) and each centroid that has vectors becomes their mean, rounded down.
    Defined cases: fewer vectors than ``k`` give fewer centroids, none give no rows; a centroid without vectors stays;
    repeated rows count each, among equal ids the smaller vector is taken first as centroid, a null id last; vectors with a
    component of 2**26 or more after scaling are not kept, as their squared distances would not fit a long; other
    columns are ignored.
    """
    spark = df.sparkSession
    kept = quantised(df, id_col, vec_col, size, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(key), "v").limit(max(SAMPLE, k)).select("v").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    sample = np.array([r.v for r in first], np.int64)
    centroids, pivots = sample[:k].copy(), choose_pivots(sample[:SAMPLE])
    table = written(kept.mapInArrow(_measure(pivots), "vec_id long, v array<long>, p array<long>"), "vectors")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    for _ in range(rounds):
        sums = table.mapInArrow(_sums(pivots, centroids), "cluster int, n long, total array<long>")
        sums = sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[exact(F.col("total")[i]) for i in range(size)]).alias("total"))
        for r in sums.collect():  # k rows at most
            centroids[r.cluster] = [int(x) // r.n for x in r.total]
    placed = written(table.mapInArrow(_assign(pivots, centroids), "vec_id long, cluster int, distance long"), "clusters")
    per = placed.groupBy("cluster").agg(exact(F.col("distance")).alias("cluster_inertia")).collect()  # k rows at most
    total = sum(int(r.cluster_inertia) for r in per)
    facts = spark.createDataFrame([(r.cluster, int(r.cluster_inertia), total, centroids[r.cluster].tolist()) for r in per],
                                  "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    out = placed.join(F.broadcast(facts), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_sha256(centroid: Column) -> Column:
    """Digest of a centroid's components as decimal integers joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ",").cast("binary"), 256)
