"""Centroid clustering of integer vectors by partial-distance search.

Every round is one scan: tasks assign their vectors and sum them by centroid, Spark adds up the tasks' sums, and one
row a centroid (a number that is fixed beforehand) comes to the driver, which divides them exactly. Assigning a batch
goes through the dimensions from the one of greatest variance on, in steps of STEPS. The first step is taken for all
centroids; the one that is nearest in it is finished first and gives a vector its first bound. The others are then
taken in turn: a vector drops a centroid once its partial sum is strictly above the vector's best distance so far,
and what is left after the last dimension is compared, ties going to the smaller number. Sums of squares only grow, so
no centroid that is nearest, or as near, is dropped. All arithmetic is on 64-bit integers and exact, so neither the
order of dimensions nor the partitions change a result.

Cases: only vectors with exactly DIMS components, none null or not finite, take part; a component beyond
+-MOST after scaling would overflow a 64-bit distance and raises an error. Repeated rows are vectors of their own. Of
vectors with one id, those that are smaller component by component are earlier starts; null ids are the last to be
starts and keep their rows. With fewer vectors than centroids each is a start; a table without any gives no rows. A
centroid without vectors stays as it is and has no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import ready, table

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2:"
#: Dimensions after which partial sums are compared.
STEPS = (8, 16, 32)
#: Greatest component: a squared distance stays below 64 * 2 ** 56.
MOST = 1 << 27
#: Vectors that a task assigns at a time.
ROWS = 4096


def integers(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of every component, a row for each vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        x = np.floor(scale * flat)
    if len(x) and not np.abs(x).max() <= MOST:
        raise ValueError(f"a scaled component is beyond {MOST}; distances would overflow")
    return x.astype(np.int64).reshape(-1, dims)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, steps: tuple[int, ...] = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid and the squared distance to it."""
    x, c = x[:, order], centroids[:, order]
    cuts = [*[s for s in steps if s < x.shape[1]], x.shape[1]]
    head = cuts[0]
    partial = np.empty((len(x), len(c)), np.int64)
    for j in range(len(c)):
        d = x[:, :head] - c[j, :head]
        partial[:, j] = np.einsum("ij,ij->i", d, d)
    who = partial.argmin(axis=1)
    d = x - c[who]
    best = np.einsum("ij,ij->i", d, d)
    begun = who.copy()
    for j in range(len(c)):
        live = np.flatnonzero((partial[:, j] <= best) & (begun != j))
        total = partial[live, j]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            d = x[live, a:b] - c[j, a:b]
            total = total + np.einsum("ij,ij->i", d, d)
            stay = total <= best[live]
            live, total = live[stay], total[stay]
        won = (total < best[live]) | (j < who[live])
        who[live[won]], best[live[won]] = j, total[won]
    return who, best


class State:
    """Centroids and the order of dimensions; K times DIMS numbers, whatever the input."""

    def __init__(self, centroids: np.ndarray, order: np.ndarray, scale: float):
        self.centroids, self.order, self.scale = centroids, order, scale

    def assign(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = integers(column, self.centroids.shape[1], self.scale)
        return x, *nearest(x, self.centroids, self.order)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _moments(dims: int, scale: float):
    """Per task and dimension: number, sum and sum of squares. They only order the dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, dims))
        for part in _pieces(batches):
            x = integers(part.column(0), dims, scale).astype(np.float64)
            total += np.stack([np.full(dims, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), *[pa.array(t) for t in total]], names=["dim", "n", "s", "q"])

    return run


def _sums(state: State):
    """Per task and centroid: its vectors, their sum, and the sum of their distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = state.centroids.shape
        n, total, far = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, object)
        for part in _pieces(batches):
            x, who, d = state.assign(part.column(0))
            by = np.argsort(who, kind="stable")
            some, first = np.unique(who[by], return_index=True)
            if len(some):
                n[some] += np.diff(np.append(first, len(by)))
                total[some] += np.add.reduceat(x[by], first, axis=0)
                far[some] += np.add.reduceat(d[by].astype(object), first)
        some = np.flatnonzero(n)
        if len(some):
            cols = [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(far[some].tolist(), pa.decimal128(38, 0)), pa.array(total[some].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["cluster", "n", "far", "total"])

    return run


def _by_centroid(vectors: DataFrame, state: State) -> dict[int, tuple[int, int, list[int]]]:
    """Number of vectors, sum of distances and sum of vectors of every centroid that has some."""
    dims = state.centroids.shape[1]
    each = vectors.mapInArrow(_sums(state), "cluster int, n long, far decimal(38,0), total array<long>")
    adds = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(dims)]
    rows = each.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("far").alias("far"), *adds).collect()  # at most one a centroid
    return {r["cluster"]: (int(r["n"]), int(r["far"]), [int(r[f"t{i}"]) for i in range(dims)]) for r in rows}


def _labels(state: State, inertias: dict[int, int]):
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in state.centroids.tolist()]
    own = pa.array([inertias.get(k, 0) for k in range(len(shas))], pa.int64())
    every = sum(inertias.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            _, who, d = state.assign(part.column(0))
            at = pa.array(who)
            cols = [part.column(1), pa.array(who.astype(np.int32)), pa.array(d), own.take(at), pa.array(np.full(len(d), every, np.int64)), pa.array(shas, pa.string()).take(at)]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster_vectors(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: str = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    ready(spark)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = vectors.select(F.col(vec_col).cast("array<double>").alias("v"), F.col(id_col).cast("long").alias("id"))
    kept = src.filter((F.size("v") == dims) & F.coalesce(fine, F.lit(False)))
    as_int = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
    starts = kept.select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("h"), as_int.alias("i"), "v")
    first = starts.orderBy(F.col("h").asc_nulls_last(), "i").limit(centroids).select("v").toArrow()
    if not first.num_rows:
        return spark.createDataFrame([], _OUT)
    start = integers(first.column("v").combine_chunks(), dims, scale)
    only = kept.select("v")
    moments = only.mapInArrow(_moments(dims, scale), "dim int, n double, s double, q double").groupBy("dim").agg(*[F.sum(c).alias(c) for c in "nsq"]).orderBy("dim").collect()
    spread = np.array([r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 for r in moments])
    state = State(start, np.argsort(-spread, kind="stable"), scale)
    for _ in range(rounds):
        new = state.centroids.copy()
        for k, (n, _, total) in _by_centroid(only, state).items():
            new[k] = [t // n for t in total]
        state = State(new, state.order, scale)
    inertias = {k: far for k, (_, far, _) in _by_centroid(only, state).items()}
    return kept.mapInArrow(_labels(state, inertias), _OUT)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _round_sql(r: int) -> str:
    return f"""
a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'k': k}}) AS best
  FROM (SELECT x.*, c.k, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM kept x, c{r} c)
  GROUP BY rid
)"""


def _update_sql(r: int) -> str:
    return f"""
c{r + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT best.k AS k, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n FROM a{r}, range(1, {DIMS + 1}) t(i) GROUP BY 1, 2)
    GROUP BY k) m ON m.k = c.k
)"""


#: The same with all distances in full.
OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v
  FROM (SELECT sha256('{SEED}' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {CENTROIDS})
), {", ".join(_round_sql(r) + ", " + _update_sql(r) for r in range(ROUNDS))}, {_round_sql(ROUNDS)}
SELECT a.vec_id, CAST(best.k AS INT) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.best.k
"""
