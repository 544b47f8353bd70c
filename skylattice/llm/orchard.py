"""Centroid clustering of integer vectors; assignment by Orchard's search.

Vectors are staged once as blocks of integers in the shared folder.  In a round each block is assigned
against the centroids (k of them, a parameter) and gives its sums and counts by cluster; Spark adds
them and the driver, which holds k centroids and nothing that grows, divides.

The search: every centroid has the list of the others by rising distance from it.  A vector starts at
the centroid that is nearest along the axis on which the centroids spread most, walks its list, and
moves to the list of a closer centroid (or one as close with a smaller number) whenever it finds one;
centroids it has met are marked.  It ends at the first one that is strictly farther from the present
centroid than twice the vector's distance: none beyond can be closer or as close.  All vectors of a
block take a step together.

Distances are exact in 64-bit integers.  Vectors of another length and those with a null or non-finite
component are left out.  Components are held to 2^27 after scaling, as squared distances would not fit
beyond; so are they in results.  Repeated ids are vectors each, null ids are carried along (for the
choice of first centroids they count as the empty string), equal hashes go by the vector.  With fewer
vectors than k there are as many centroids; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Vectors of a block, and the largest component.
BLOCK, MOST = 4096, 1 << 27

_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("data", pa.binary())])


def _vectors(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows with exactly ``dims`` finite components, and their scaled integers."""
    size = np.array(column.value_lengths().fill_null(-1), np.int64)
    rows = np.flatnonzero(size == dims)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    values = np.array(flat.fill_null(np.nan), np.float64).reshape(-1, dims)
    good = np.isfinite(values).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values[good])
    return rows[good], np.clip(scaled, -MOST, MOST).astype(np.int32)


def _block_batches(dims: int, scale: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, BLOCK) for whole in batches for at in range(0, whole.num_rows, BLOCK)):
            rows, data = _vectors(batch.column("vector"), dims, scale)
            if len(rows):
                ids = batch.column("vec_id").take(pa.array(rows)).to_pylist()
                yield pa.RecordBatch.from_pylist([{"ids": ids, "data": data.tobytes()}], _BLOCK)

    return run


def blocks(vectors: DataFrame, dims: int = 64, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``ids, data``: the kept vectors as blocks of 32-bit integers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return staged(rows.mapInArrow(_block_batches(dims, scale), "ids array<long>, data binary"), "vector-blocks")


def _first_batches(k: int, salt: str, dims: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, tuple[int, ...]]] = []
        for batch in batches:
            for ids, data in zip(batch.column("ids").to_pylist(), batch.column("data").to_pylist(), strict=True):
                values = np.frombuffer(data, np.int32).reshape(-1, dims)
                named = [(hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).hexdigest(), r) for r, i in enumerate(ids)]
                limit = best[-1][0] if len(best) == k else "g"
                best = sorted(best + [(h, tuple(values[r].tolist())) for h, r in named if h <= limit])[:k]
        yield pa.RecordBatch.from_pydict({"hash": [h for h, _ in best], "vector": [list(v) for _, v in best]}, pa.schema([("hash", pa.string()), ("vector", pa.list_(pa.int32()))]))

    return run


def first_centroids(table: DataFrame, k: int, dims: int = 64, salt: str = "2:") -> np.ndarray:
    """The k vectors of least SHA-256 of salt and id; each task sends k at most."""
    rows = table.mapInArrow(_first_batches(k, salt, dims), "hash string, vector array<int>").orderBy("hash", "vector").limit(k).collect()
    return np.array([r["vector"] for r in rows], np.int64).reshape(-1, dims)


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all by rising squared distance from it (itself first), and the distances."""
    far = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    order = np.argsort(far, axis=1, kind="stable")
    # A copy of a centroid may come before it at distance 0; either order serves.
    return order, np.take_along_axis(far, order, axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid (the smaller number on ties)."""
    n, k = len(vectors), len(centroids)
    vectors = vectors.astype(np.int64)
    order, far = neighbour_lists(centroids)
    axis = int(np.argmax(centroids.astype(np.float64).var(axis=0)))
    line = np.argsort(centroids[:, axis], kind="stable")
    middle = (centroids[line[1:], axis] + centroids[line[:-1], axis]) / 2
    now = line[np.searchsorted(middle, vectors[:, axis])]

    def distance(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        d = vectors[rows] - centroids[to]
        return np.einsum("ij,ij->i", d, d)

    best = distance(np.arange(n), now)
    seen = np.zeros((n, k), bool)
    seen[np.arange(n), now] = True
    place = np.zeros(n, np.int64)
    active = np.arange(n)
    while len(active):
        at, here = place[active], now[active]
        # Doubled distances are compared as squares; beyond the list's end the walk is over too.
        going = at < k
        active, at, here = active[going], at[going], here[going]
        near = far[here, at] <= 4 * best[active]
        active, at, here = active[near], at[near], here[near]
        other = order[here, at]
        place[active] += 1
        fresh = ~seen[active, other]
        rows, to = active[fresh], other[fresh]
        seen[rows, to] = True
        d = distance(rows, to)
        closer = (d < best[rows]) | ((d == best[rows]) & (to < now[rows]))
        rows, to, d = rows[closer], to[closer], d[closer]
        now[rows], best[rows], place[rows] = to, d, 0
    return now, best


def _sum_batches(centroids: np.ndarray) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for data in batch.column("data").to_pylist():
                vectors = np.frombuffer(data, np.int32).reshape(-1, dims)
                cluster, _ = nearest(vectors, centroids)
                order = np.argsort(cluster, kind="stable")
                found, first = np.unique(cluster[order], return_index=True)
                sums[found] += np.add.reduceat(vectors[order].astype(np.int64), first, axis=0)
                counts += np.bincount(cluster, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def updated(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid becomes the floor of its vectors' mean; the sums are exact."""
    part = table.mapInArrow(_sum_batches(centroids), "cluster int, n long, sums array<long>")
    each = part.select("cluster", "n", F.posexplode("sums").alias("dim", "s"))
    rows = each.groupBy("cluster", "dim").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["dim"]] = int(r["s"]) // int(r["n"])
    return out


def _assign_batches(centroids: np.ndarray) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("data").to_pylist(), strict=True):
                cluster, distance = nearest(np.frombuffer(data, np.int32).reshape(-1, centroids.shape[1]), centroids)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    return table.mapInArrow(_assign_batches(centroids), "vec_id long, cluster int, distance long")


def fit(table: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, salt: str = "2:") -> np.ndarray:
    """Centroids after so many rounds."""
    centroids = first_centroids(table, k, dims, salt)
    for _ in range(rounds if len(centroids) else 0):
        centroids = updated(table, centroids)
    return centroids


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, salt: str = "2:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector.

    Inertias beyond a long are held to the largest one.
    """
    table = blocks(vectors, dims, scale)
    centroids = fit(table, k, rounds, dims, salt)
    if not len(centroids):
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return table.sparkSession.createDataFrame([], schema)
    rows = staged(assigned(table, centroids), "vector-clusters")
    # One row for each cluster, k at most.
    total = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most = (1 << 63) - 1
    named = [(c, min(s, most), min(sum(total.values()), most), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in total.items()]
    known = table.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    return f"""a{i} AS MATERIALIZED (SELECT r, (min(dist * 64 + c) % 64)::INTEGER AS cluster, min(dist) AS distance FROM (
  SELECT r, c, sum((x - y) * (x - y))::BIGINT AS dist FROM comp JOIN k{i} USING (d) GROUP BY r, c) GROUP BY r)"""


def _update(i: int) -> str:
    return f"""s{i} AS (SELECT cluster AS c, d, sum(x)::BIGINT AS s, count(*) AS n FROM comp JOIN a{i - 1} USING (r) GROUP BY cluster, d),
k{i} AS MATERIALIZED (SELECT c, d, coalesce((s - ((s % n) + n) % n) // n, y)::BIGINT AS y FROM k{i - 1} LEFT JOIN s{i} USING (c, d))"""


#: The same by all distances of all vectors to all centroids.
ORACLE = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
comp AS MATERIALIZED (SELECT r, unnest(range(64)) AS d, unnest(e) AS x FROM v),
f AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS c, e FROM v QUALIFY c < 40),
k0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS d, unnest(e) AS y FROM f), {_round(0)},
{", ".join(f"{_update(i)}, {_round(i)}" for i in range(1, 6))},
t AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia, (sum(sum(distance)) OVER ())::BIGINT AS inertia FROM a5 GROUP BY cluster),
g AS (SELECT c AS cluster, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM k5 GROUP BY c)
SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM a5 JOIN v USING (r) JOIN t USING (cluster) JOIN g USING (cluster)"""
