"""Centroid clustering in whole numbers, with float32 screening.

A component x becomes floor(256 x).  Each round assigns every vector to its
nearest centroid: a float32 matrix product gives each distance with an interval
that bounds its rounding error; centroids whose interval begins beyond the least
upper bound can't be nearest, and where more than one is left, those are
compared by exact integers, the smaller number winning ties.  Tasks send one row
of sums for each centroid; only ``k`` centroids ever reach the driver, so that a
third of all rows in one cluster costs nothing more.

Vectors of another length, null ones, and those with a null or non-finite
component are left out, as are those with a whole component beyond ``MOST``,
whose squared distances would leave a long.  Repeated rows and ids are vectors
of their own.  Null ids hash like an empty string, and order last.  With fewer
than ``k`` vectors there are as many centroids; an empty table gives no row.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, stage

#: Largest size of a whole component: 64 squares of differences of such add up to less than 2^63.
MOST = 1 << 27
_U32, _U64 = 2.0**-24, 2.0**-53
_STATE = "cluster int, distance long"


def whole_vectors(vectors: DataFrame, dims: int, scale: int, *, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(vec_id, v array<int>) of the vectors kept."""
    x = F.col(vector_col)
    fine = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    kept = vectors.filter(x.isNotNull() & fine).filter(F.forall(x, lambda c: F.abs(c.cast("double")) * scale < MOST))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(whole, lambda c: c.cast("int")).alias("v"))


class Screen:
    """Nearest of some centroids, exactly, for many vectors at a time."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.int64)
        self.c32 = self.c.astype(np.float32)
        self.square = (self.c * self.c).sum(1)  # exact: below 2^60 for 64 components
        self.norm = np.sqrt(self.square.astype(np.float64)) * (1 + 1e-12)
        n = self.c.shape[1] + 2  # two more roundings: of a vector's and of a centroid's component
        self.gamma = n * _U32 / (1 - n * _U32)

    def shortlist(self, v: np.ndarray) -> np.ndarray:
        """Which centroids may be nearest, as a mask of vectors by centroids.

        |x - c|^2 less |x|^2, which all centroids share, is |c|^2 - 2 x.c.  Of a
        float32 product of n terms summed in any order the error is at most
        gamma(n + 2) times the sum of |x_i c_i|, hence of |x| |c|; the float64
        steps after it add at most a few units of the largest term.
        """
        product = (v.astype(np.float32) @ self.c32.T).astype(np.float64)
        length = np.sqrt((v.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
        square = self.square.astype(np.float64)
        about = square[None] - 2 * product
        radius = (2 * self.gamma * (1 + 1e-9)) * (length[:, None] * self.norm[None]) + 8 * _U64 * (square[None] + 2 * np.abs(product))
        return about - radius <= (about + radius).min(1)[:, None]

    def assign(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and the squared distance to it; v is int64."""
        may = self.shortlist(v)
        best = may.argmax(1)
        unsure = np.flatnonzero(may.sum(1) > 1)
        if len(unsure):
            row, c = np.nonzero(may[unsure])  # row by row, centroids ascending
            exact = np.empty(len(row), np.int64)
            for a in range(0, len(row), 1 << 14):
                d = v[unsure[row[a : a + (1 << 14)]]] - self.c[c[a : a + (1 << 14)]]
                exact[a : a + (1 << 14)] = (d * d).sum(1)
            order = np.lexsort((c, exact, row))
            first = np.searchsorted(row[order], np.arange(len(unsure)))
            best[unsure] = c[order[first]]
        d = v - self.c[best]
        return best, (d * d).sum(1)


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(kept: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Number and component sums of the vectors nearest to each centroid that has any."""
    k, dims = centroids.shape

    def work(batches):
        screen = Screen(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), dims)
            best, _ = screen.assign(v)
            count += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            used, at = np.unique(best[order], return_index=True)
            if len(used):
                total[used] += np.add.reduceat(v[order], at, axis=0)
        has = np.flatnonzero(count)
        if len(has):
            cols = [pa.array(has.astype(np.int32)), pa.array(count[has])] + [pa.array(total[has, i]) for i in range(dims)]
            yield pa.RecordBatch.from_arrays(cols, names=["c", "n", *[f"s{i}" for i in range(dims)]])

    parts = kept.select("v").mapInArrow(work, "c int, n long, " + ", ".join(f"s{i} long" for i in range(dims)))
    wide = [F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), *wide).collect()  # one for each centroid at most
    return {r["c"]: (r["n"], [int(r[f"s{i}"]) for i in range(dims)]) for r in rows}


def cluster(vectors: DataFrame, *, k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """One row for each vector kept: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    The first centroids are the ``k`` vectors with the least lowercase-hex sha256
    of ``<seed>:<vec_id>`` (equal ids: by components).  A centroid without
    vectors stays as it is.  Sums of distances beyond a long come back as null.
    """
    spark = vectors.sparkSession
    kept = stage(whole_vectors(vectors, dims, scale, id_col=id_col, vector_col=vector_col), "whole-vectors")
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("v", "vec_id", mark.alias("mark")).orderBy(F.col("vec_id").isNull(), "mark", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(first) else 0):
        for c, (n, total) in _sums(kept, centroids).items():
            centroids[c] = [s // n for s in total]

    def work(batches):
        screen = Screen(centroids) if len(centroids) else None
        for batch in batches:
            if batch.num_rows:
                best, distance = screen.assign(_matrix(batch.column("v"), dims))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found = stage(kept.mapInArrow(work, "vec_id long, " + _STATE), "assigned")
    discard(kept)
    by = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    total = fits(sum(by.values()))
    about = [(c, fits(d), total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(by.items())]
    table = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows


def _oracle(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64, scale: int = 256) -> str:
    steps = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id IS NULL, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM e QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT r, vec_id, e.v, c, list_sum(list_transform(list_zip(e.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM e, c{i})")
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min_by(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY r)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dims})) AS i FROM a{i}) GROUP BY c, i)")
            steps.append(f"m{i} AS (SELECT c, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS v FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))")
    return f"WITH {', '.join(steps)} SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"


ORACLE_SQL = _oracle()
