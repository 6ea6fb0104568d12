"""Centroid clustering of integer vectors, with distances pruned by Ptolemaic pivots.

Vectors become integers floor(SCALE * x). The first centroids are the vectors whose ids hash least, and so are the pivots, which never
change: each vector's distances to the pivots are found once and kept beside it. For points x, c and pivots p, q Ptolemy's inequality
says |xp * cq - xq * cp| <= xc * pq, a lower bound of the distance xc that costs no look at the vectors. In each round a vector's
centroids are bounded by the pairs of pivots with the one nearest to the centroid; the centroid of the least bound is measured first, and
of the others those whose bound doesn't exceed what was found. Bounds lie below by more than the rounding of their terms, distances are
exact integers, so the result is that of measuring all.

Scale: the kept vectors are written once with their pivot distances; a round reads them, and a task returns one row of sums for
each centroid, added up by Spark. The driver sees k centroids a round, of fixed size. No vector is shuffled.

Defined results: vectors that are null, of another number of components, or with a null or non-finite component are left out; a null
id is hashed as an empty one; equal ids go by their components; repeated rows are vectors each; fewer vectors than k make as many centroids;
an empty table gives an empty result; extra columns are ignored. A component beyond LARGEST fails with an error that says so, since squared
distances would not fit into a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cragline.session import written

COMPONENTS = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
PREFIX = "3:"
#: Of an integer component: 64 squares of twice this stay below 2 ** 63.
LARGEST = 2**27
#: Far above the relative error of a bound's terms, a few times 2 ** -53.
ROUNDING = 1e-14


def integers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", size: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) of the vectors that are kept."""
    bad: Column = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where((F.size(vec_col) == size) & ~bad).select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("x"))
    scaled = F.transform("x", lambda x: F.floor(scale * x.cast("double")))
    checked = F.when(F.exists("x", lambda x: F.abs(scale * x.cast("double")) >= LARGEST), F.raise_error(F.lit(f"a component exceeds {LARGEST} after scaling")))
    return kept.select("vec_id", F.coalesce(checked.cast("array<int>"), scaled.cast("array<int>")).alias("v"))


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)


def roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, each the rounded root of an exact integer."""
    return np.stack([np.sqrt(((a - row) ** 2).sum(1).astype(np.float64)) for row in b], 1) if len(b) else np.zeros((len(a), 0))


def bounds(to_pivots: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """A lower bound of the squared distance of each vector to each centroid, from its distances to the pivots."""
    gaps, ends = roots(pivots, pivots), roots(centroids, pivots)
    low = np.zeros((len(to_pivots), len(centroids)))
    for c in range(len(centroids)):
        p = int(ends[c].argmin())
        for q in np.flatnonzero(gaps[p]):
            one, other = to_pivots[:, p] * ends[c, q], to_pivots[:, q] * ends[c, p]
            np.maximum(low[:, c], (np.abs(one - other) - ROUNDING * (one + other)) / gaps[p, q], out=low[:, c])
    return low * low * (1 - ROUNDING)


def nearest(v: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centroid, squared distance, number of distances measured) of each vector; ties go to the smaller number."""
    low = bounds(to_pivots, pivots, centroids)
    first = low.argmin(1)
    cluster, best = first.copy(), ((v - centroids[first]) ** 2).sum(1)
    measured = np.ones(len(v), np.int32)
    for c in range(len(centroids)):
        rows = np.flatnonzero((low[:, c] <= best * (1 + ROUNDING)) & (first != c))
        d = ((v[rows] - centroids[c]) ** 2).sum(1)
        better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
        cluster[rows[better]], best[rows[better]] = c, d[better]
        measured[rows] += 1
    return cluster, best, measured


def _assigned(cached: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, measured) of rows (vec_id, v, pivots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), np.int64, pivots.shape[1])
            found = nearest(v, _matrix(batch.column("pivots"), np.float64, len(pivots)), pivots, centroids)
            arrays = [pa.array(x, t) for x, t in zip(found, (pa.int32(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *arrays], ["vec_id", "cluster", "distance", "measured"])

    kind = cached.schema["vec_id"].dataType.simpleString()
    return cached.mapInArrow(run, f"vec_id {kind}, cluster int, distance long, measured int")


def _moved(cached: DataFrame, pivots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floors of the means, empty ones where they were."""
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), np.int64, width)
            cluster = nearest(v, _matrix(batch.column("pivots"), np.float64, len(pivots)), pivots, centroids)[0]
            np.add.at(sums, cluster, v)
            counts += np.bincount(cluster, minlength=len(centroids))
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(counts[full]), pa.array(list(sums[full]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = cached.select("v", "pivots").mapInArrow(run, "cluster int, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = centroids.copy()
    for row in added.collect():  # one row a centroid
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return out


def kmeans(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, prefix: str = PREFIX, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, measured) of every kept vector, and the final centroids. measured: distances computed in the last round."""
    kept = integers(vectors, id_col, vec_col)
    order = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    seeds = kept.select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    pivots = np.array([r["v"] for r in seeds], np.int64).reshape(-1, COMPONENTS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = roots(_matrix(batch.column("v"), np.int64, COMPONENTS), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(away), pa.list_(pa.float64()))], ["vec_id", "v", "pivots"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    cached = written(kept.mapInArrow(measure, f"vec_id {kind}, v array<int>, pivots array<double>"), "vectors")
    centroids = pivots
    for _ in range(rounds if len(seeds) else 0):
        centroids = _moved(cached, pivots, centroids)
    return written(_assigned(cached, pivots, centroids), "assigned"), centroids


def op11(vectors: DataFrame) -> DataFrame:
    found, centroids = kmeans(vectors)
    sums = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # one row a centroid
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    known = [F.struct(F.lit(sums.get(c, 0)).cast("long").alias("sum"), F.lit(d).alias("digest")) for c, d in enumerate(digests or [""])]
    own = F.array(*known)[F.col("cluster")]
    return found.select("vec_id", "cluster", "distance", own["sum"].alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), own["digest"].alias("centroid_sha256"))


def _oracle() -> str:
    """In DuckDB: all distances, and one pair of CTEs a round."""
    far = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    finite = "len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND {finite})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept QUALIFY c < 8)",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT k.id, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min(({far}, c.c)) AS m FROM kept k, c{i} c GROUP BY k.id)")
        if i < ROUNDS:
            sums = f"SELECT m[2] AS c, u.i, sum(v[u.i]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, 65)) AS i) u GROUP BY 1, 2"
            parts.append(f"n{i} AS (SELECT c, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM ({sums}) GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN n{i} n ON n.c = c.c)")
    last = f"SELECT a.vec_id, CAST(m[2] AS INTEGER) AS cluster, CAST(m[1] AS BIGINT) AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia, CAST(sum(m[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = m[2]"
    return "WITH " + ",\n".join(parts) + "\n" + last


ORACLE = _oracle()
