"""Nearest neighbours from randomly rotated one-bit codes.

Each vector, less the mean, is turned by a random rotation and kept as its signs.
The inner product with a query is estimated from the packed signs and two
scalars; the estimate's error bound tells which vectors can still be among the
nearest, and only those are compared exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one pass over the vectors; more queries take more passes.
QUERY_BLOCK = 8192
#: Width of the error bound in standard deviations; a miss is rarer than one in 10^8.
EPSILON = 6.0
SEED = 20240501
_ROWS = 2048


def rotation(d: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """__id, __vec (double) of the rows that take part: id and components present and finite, not all zero."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(key).isNotNull() & v.isNotNull() & good & some).select(F.col(key).alias("__id"), v.alias("__vec"))


def centers(good: DataFrame) -> dict[int, np.ndarray]:
    """Mean of all vectors of each length, summed by task."""
    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for v in batch["__vec"]:
                row = total.setdefault(len(v), np.zeros(len(v) + 1))
                row[:-1] += v
                row[-1] += 1
        yield pd.DataFrame({"d": list(total), "s": [x.tolist() for x in total.values()]})

    parts = good.select("__vec").mapInPandas(sums, "d long, s array<double>")
    flat = parts.select("d", F.posexplode("s").alias("i", "x")).groupBy("d", "i").agg(F.sum("x").alias("x"))
    out: dict[int, np.ndarray] = {}
    for d, i, x in flat.collect():  # one number per dimension
        out.setdefault(d, np.zeros(d + 1))[i] = x
    return {d: x[:-1] / max(1.0, x[-1]) for d, x in out.items()}


class Codes:
    """Packed signs and correction scalars of some vectors of one length."""

    def __init__(self, vectors: np.ndarray, center: np.ndarray):
        d = vectors.shape[1]
        moved = vectors - center
        self.norm = np.sqrt((moved * moved).sum(1))
        turned = (moved / np.where(self.norm > 0, self.norm, 1.0)[:, None]) @ rotation(d).T
        self.bits = np.packbits(turned >= 0, axis=1)
        self.own = np.abs(turned).sum(1) / np.sqrt(d)  # inner product of a vector with its own code

    def distances(self, queries: np.ndarray, center: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the squared distances, queries by vectors."""
        d = queries.shape[1]
        moved = queries - center
        norm = np.sqrt((moved * moved).sum(1))
        turned = (moved / np.where(norm > 0, norm, 1.0)[:, None]) @ rotation(d).T
        # <code, q> from the packed signs: bytes pick sums of the query's components.
        n_bytes = self.bits.shape[1]
        padded = np.zeros((len(queries), n_bytes * 8))
        padded[:, :d] = turned
        signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1
        dot = np.zeros((len(queries), len(self.bits)), dtype=np.float32)
        for b in range(n_bytes):
            dot += (padded[:, b * 8:b * 8 + 8] @ signs.T).astype(np.float32)[:, self.bits[:, b]]
        own = np.maximum(self.own, 1e-12)
        estimate = dot / np.sqrt(d) / own
        error = epsilon * np.sqrt(np.maximum(0.0, 1.0 - own * own)) / own / np.sqrt(max(1, d - 1)) + 1e-5
        both = self.norm[None, :] ** 2 + norm[:, None] ** 2
        scale = 2.0 * self.norm[None, :] * norm[:, None]
        return both - scale * (estimate + error) - 1e-6 * both, both - scale * (estimate - error) + 1e-6 * both


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances, components added in order."""
    gap = vectors - query
    return np.sqrt(np.cumsum(gap * gap, axis=1)[:, -1])


def _search(queries: dict[int, tuple[np.ndarray, np.ndarray]], center: dict[int, np.ndarray], k: int, epsilon: float):
    """For one task: the nearest of its vectors to every query, in a running list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {d: [(np.empty(0), np.empty(0, dtype=np.int64)) for _ in ids] for d, (ids, _) in queries.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                lists = part.column(1)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                for d in np.unique(sizes):
                    if int(d) not in queries:
                        continue
                    rows = np.flatnonzero(sizes == d)
                    vectors = flat[(ends[rows] - d)[:, None] + np.arange(d)]
                    scan(int(d), ids[rows], vectors, kept[int(d)])
        out = [(int(q), int(v), float(s)) for d, (qids, _) in queries.items()
               for q, (dist, near) in zip(qids, kept[d]) for s, v in zip(dist, near)]
        cols = list(zip(*out)) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())],
                                         names=["query_id", "vec_id", "score"])

    def scan(d, ids, vectors, kept):
        qids, qvecs = queries[d]
        codes = Codes(vectors, center[d])
        for lo in range(0, len(qids), 512):
            lower, upper = codes.distances(qvecs[lo:lo + 512], center[d], epsilon)
            limit = np.partition(upper, k, axis=1)[:, k] if upper.shape[1] > k + 1 else np.full(len(lower), np.inf)
            for j in range(len(lower)):
                dist, near = kept[lo + j]
                worst = min(limit[j], dist[-1] ** 2 * (1 + 1e-9)) if len(dist) >= k else limit[j]
                rows = np.flatnonzero(lower[j] <= worst)
                rows = rows[ids[rows] != qids[lo + j]]
                if len(rows):
                    dist = np.concatenate([dist, exact(qvecs[lo + j], vectors[rows])])
                    near = np.concatenate([near, ids[rows]])
                    first = np.lexsort((near, dist))[:k]
                    kept[lo + j] = dist[first], near[first]
    return run


def nearest(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding",
            epsilon: float = EPSILON, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of every query row.

    ``is_query`` is a condition on ``vectors``.  Only rows of the query's own
    length are candidates; a row is no candidate of its own id.  Rows with a
    null id, null, zero or non-finite vectors take no part.  Repeated rows each
    count.  Ties go to the smaller id.  An empty table gives an empty result.
    Queries are taken ``block`` at a time against all rows, so what is sent to
    the tasks has a fixed bound; each task returns ``k`` rows per query at most.
    """
    spark = vectors.sparkSession
    good = usable(vectors, key, vector)
    center = centers(good)
    chosen = usable(vectors.where(is_query), key, vector).dropDuplicates(["__id"])
    n = chosen.count()
    blocks = max(1, -(-n // block))
    schema = "query_id long, vec_id long, score double"
    found = spark.createDataFrame([], schema)
    for b in range(blocks if n else 0):
        part = chosen.where(F.pmod(F.xxhash64("__id"), F.lit(blocks)) == b).collect() if blocks > 1 else chosen.collect()
        by_length: dict[int, list] = {}
        for i, v in sorted((r[0], r[1]) for r in part):
            by_length.setdefault(len(v), []).append((i, v))
        queries = {d: (np.array([i for i, _ in x], dtype=np.int64), np.array([v for _, v in x])) for d, x in by_length.items()}
        found = found.unionByName(good.mapInArrow(_search(queries, center, k, epsilon), schema))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE_SQL = """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
  sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[2] - p[1]) * (p[2] - p[1])), lambda a, b: a + b)) AS score
  FROM good q JOIN good c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
