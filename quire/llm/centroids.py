"""Plain Lloyd clustering of integer vectors, exact and the same in every run.

Components become integers, so distances, sums and the floor of each mean are exact whatever
the order of rows. A round broadcasts the centroids (k vectors), each partition assigns its
vectors in NumPy and sends one sum a centroid and component, and these sums are merged by a
grouped sum: k * dim rows, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components at or beyond this size could make a squared distance overflow a long.
LARGEST = 1 << 27
#: Vectors that are compared with all centroids at a time.
BLOCK = 4096


def quantised(vector: Column, dim: int, scale: int) -> Column:
    """floor(scale * component) of each component in double precision; null unless there are dim finite ones."""
    fit = (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)))
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double")))) * float(scale)
    safe = F.when(most < float(LARGEST), whole).otherwise(F.raise_error(F.lit(f"components of {LARGEST // scale} and more can't be clustered")).cast("array<bigint>"))
    return F.when(fit, safe)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, smallest first; squared distance) of each row."""
    which, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        d = np.stack([((part - c) ** 2).sum(1) for c in centroids], 1)
        which[at : at + BLOCK] = d.argmin(1)
        far[at : at + BLOCK] = d.min(1)
    return which, far


def _means(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: floor of each component's mean; those without vectors stay."""
    k, dim = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if len(batch):
                x = np.stack(batch["q"].to_numpy())
                which, _ = nearest(x, shared.value)
                for c in np.unique(which):
                    total[c] += x[which == c].sum(0)
                count += np.bincount(which, minlength=k)
        own = np.flatnonzero(count)
        yield pd.DataFrame({"c": np.repeat(own, dim), "j": np.tile(np.arange(dim), len(own)), "s": total[own].ravel(), "n": np.repeat(count[own], dim)})

    merged = vectors.select("q").mapInPandas(sums, "c int, j int, s long, n long").groupBy("c", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in merged.collect():  # k * dim rows at most
        out[r.c, r.j] = r.s // r.n
    shared.destroy()
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Assigns every fit vector to one of k centroids after ``rounds`` of Lloyd's algorithm.

    Fit are vectors of exactly ``dim`` components, none null or non-finite; others (null ones too)
    have no row in the result. Centroids start as the fit vectors with the smallest SHA-256
    of ``seed:id`` (null ids: of ``seed:``; rows of one id by their components), and there are
    fewer if there are fewer vectors. Equal distances go to the smaller number. Components whose
    scaled size reaches 2**27 raise an error, as a distance might not fit a long.

    Returns id_col, cluster, distance (squared), cluster_inertia, inertia and centroid (its
    components), one row per fit input row; repeated rows are vectors of their own. Other columns are
    ignored; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    fit = vectors.select(F.col(id_col).alias("id"), quantised(F.col(vector), dim, scale).alias("q")).where("q is not null")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = fit.select("q", start.alias("x")).orderBy("x", "q").limit(k).collect()
    centroids = np.array([r.q for r in first], np.int64).reshape(-1, dim)
    for _ in range(rounds if len(first) else 0):
        centroids = _means(fit, centroids)
    shared = spark.sparkContext.broadcast(centroids)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                which, far = nearest(np.stack(batch["q"].to_numpy()), shared.value)
                yield pd.DataFrame({"id": batch["id"], "cluster": which.astype(np.int32), "distance": far})

    out = fit.mapInPandas(assigned, f"id {vectors.schema[id_col].dataType.simpleString()}, cluster int, distance long")
    inertia = {r.cluster: r.s for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(c, inertia[c], sum(inertia.values()), centroids[c].tolist()) for c in inertia]
    side = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>")  # k rows
    return out.join(F.broadcast(side), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: Column) -> Column:
    """SHA-256 of the components as decimal integers, comma-joined."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)


def _sql(rounds: int) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT v.vec_id, v.q, c.i, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r} AS c),
a{r} AS (SELECT vec_id, q, i, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, i) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT i, j, CAST(floor_div(sum(x), count(*)) AS BIGINT) AS x FROM (SELECT i, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{r}) GROUP BY i, j),
c{r + 1} AS (SELECT c.i, coalesce(g.q, c.q) AS q FROM c{r} AS c LEFT JOIN (SELECT i, list(x ORDER BY j) AS q FROM m{r} GROUP BY i) AS g ON g.i = c.i)""")
    return ",\n".join(steps).replace("floor_div(sum(x), count(*))", "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)")


#: The same rows in DuckDB (ids are distinct).
SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS INTEGER) AS i, q FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),
{_sql(3)}
SELECT a.vec_id, a.i AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.i) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM a3 AS a JOIN c3 ON c3.i = a.i
"""
