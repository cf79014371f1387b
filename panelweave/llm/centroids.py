"""Lloyd's clustering of integer vectors in which only vectors whose bound expires are looked at again.

For every vector the distance to its own centroid and the least one to another are known when it is assigned; their difference
is its gap.  Moving centroids shrink a gap by at most the drift of its own centroid plus the largest drift of another, so a
cluster keeps one running sum of these and a heap of (gap + sum at assignment): a vector can only have changed its cluster
once its key is no more than the cluster's sum.  Those are popped, measured against all centroids in whole numbers and pushed
again; the others are not read.

On Spark, vectors are packed into blocks of ``BLOCK`` rows, and a block has its own heaps, one per cluster, however many
vectors a cluster has.  Blocks and heaps are written as tables bucketed by block, so a round joins them without a shuffle,
writes the heaps of the next round and returns sums of the vectors that moved, added up by Spark: clusters times 65 numbers.
Every round is a written table, so a lost executor costs a part of one round.

Vectors with another length than ``dim`` or with null, NaN or infinite components are left out; so are null vectors.  A null id
is kept but sorts last among the starts.  Repeated rows are vectors of their own; equal ids are ordered by their components.  Ties of
distance go to the smaller cluster number.  With fewer vectors than clusters there are as many clusters as vectors.  An
empty table gives no rows.  Components beyond 2**27 after scaling raise an error, since their distances exceed a long.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.sources.staging import new_path, stage

BLOCK = 4096
LARGEST = 1 << 27
#: Products of components up to this size are exact in double precision when summed over a vector.
EXACT = 1 << 21
#: Bounds are made this much weaker, relative to the distances, so that rounding never keeps a vector from its rescan.
SLACK = 1e-9


@dataclass(frozen=True)
class Clustering:
    clusters: int = 8
    rounds: int = 10
    dim: int = 64
    scale: int = 1024
    seed: int = 3


def integer_vectors(rows: DataFrame, id: str, vector: str, spec: Clustering) -> DataFrame:
    """(vec_id, v): the valid vectors with components floor(scale * x)."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False)))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(spec.scale))))
    return rows.select(F.col(id).alias("vec_id"), F.when((F.size(x) == spec.dim) & finite, whole).alias("v")).where(F.col("v").isNotNull())


def first_centroids(vectors: DataFrame, spec: Clustering) -> np.ndarray:
    """The vectors with the least hashes of their ids, as rows: at most ``spec.clusters``."""
    hashed = F.sha2(F.concat(F.lit(f"{spec.seed}:"), F.col("vec_id").cast("string")), 256)
    least = vectors.orderBy(hashed.asc_nulls_last(), "v").limit(spec.clusters).collect()
    return np.array([r["v"] for r in least], np.int64).reshape(-1, spec.dim)


def pack(vectors: DataFrame, dim: int) -> DataFrame:
    """(block, ids, matrix): up to ``BLOCK`` vectors a row, in 32-bit numbers."""

    def run(batches):
        part, made, ids, values = TaskContext.get().partitionId() << 33, 0, [], []

        def rows():
            matrix = np.concatenate(values)
            if (np.abs(matrix) > LARGEST).any():
                raise ValueError(f"a component is beyond {LARGEST} after scaling")
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([part + made], pa.int64()), "ids": pa.array([[i for c in ids for i in c]], pa.list_(pa.int64())),
                    "matrix": pa.array([matrix.astype(np.int32).tobytes()], pa.binary()),
                }
            )

        held = 0
        for batch in batches:
            matrix = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            names = batch.column("vec_id").to_pylist()
            for lo in range(0, len(names), BLOCK):
                ids.append(names[lo : lo + BLOCK])
                values.append(matrix[lo : lo + BLOCK])
                held += len(ids[-1])
                if held >= BLOCK:
                    yield rows()
                    made, held, ids, values = made + 1, 0, [], []
        if held:
            yield rows()

    return vectors.select("vec_id", "v").mapInArrow(run, "block long, ids array<long>, matrix binary")


def bucketed(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder in buckets of ``block``, and the name of the table."""
    spark = df.sparkSession
    name = f"panelweave_{label}_{uuid.uuid4().hex}"
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    df.write.format("parquet").option("path", new_path(spark, label)).bucketBy(parts, "block").saveAsTable(name)
    return spark.table(name), name


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to all centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        out[:, j] = ((x - c) ** 2).sum(axis=1)
    return out


def expired(keys: np.ndarray, limit: float) -> np.ndarray:
    """Places of a heap whose keys are at most ``limit``: a walk down from the top that stops below larger keys."""
    found, level = [], np.arange(min(1, len(keys)))
    while len(level):
        level = level[keys[level] <= limit]
        found.append(level)
        level = np.concatenate([2 * level + 1, 2 * level + 2])
        level = level[level < len(keys)]
    return np.concatenate(found) if found else level


def _advance(x: np.ndarray, heaps: list | None, centroids: np.ndarray, spent: np.ndarray):
    """One assignment of a block: its new heaps and the sums (count, components) that moved between clusters."""
    k, dim = centroids.shape
    if heaps is None:
        heaps = [(np.zeros(0), np.zeros(0, np.int32))] * k
        popped, old = np.arange(len(x)), None
    else:
        tops = [expired(keys, limit) for (keys, _), limit in zip(heaps, spent, strict=True)]
        popped = np.concatenate([places[top] for (_, places), top in zip(heaps, tops, strict=True)])
        old = np.repeat(np.arange(k), [len(t) for t in tops])
        heaps = [(np.delete(keys, t), np.delete(places, t)) if len(t) else (keys, places) for (keys, places), t in zip(heaps, tops, strict=True)]
    if not len(popped):
        return heaps, None
    rows = x[popped].astype(np.int64)
    far = squared(rows, centroids)
    new = far.argmin(axis=1)
    every = np.arange(len(new))
    upper = np.sqrt(far[every, new].astype(np.float64))
    far[every, new] = np.iinfo(np.int64).max
    lower = np.sqrt(far.min(axis=1).astype(np.float64)) if k > 1 else np.full(len(new), np.inf)
    gap = lower - upper - SLACK * (upper + np.where(np.isinf(lower), 0, lower) + spent[new])
    moved = np.zeros((k, dim + 1), np.int64)
    was = np.full(len(new), -1) if old is None else old
    for c in np.union1d(new, was[was >= 0]):
        mine, came, gone = new == c, (new == c) & (was != c), (was == c) & (new != c)
        keys = np.concatenate([heaps[c][0], gap[mine] + spent[c]])
        places = np.concatenate([heaps[c][1], popped[mine].astype(np.int32)])
        order = np.argsort(keys, kind="stable")  # ascending keys are a heap; untouched heaps stay as they are
        heaps[c] = (keys[order], places[order])
        moved[c] = np.append(came.sum(), rows[came].sum(axis=0)) - np.append(gone.sum(), rows[gone].sum(axis=0))
    return heaps, moved if moved.any() else None


STATE = "block long, sizes array<int>, keys binary, places binary, moved array<long>"


def _heaps(batch: pa.RecordBatch, i: int) -> list | None:
    if "sizes" not in batch.schema.names:
        return None
    cuts = np.cumsum(batch.column("sizes")[i].as_py())[:-1]
    keys = np.frombuffer(batch.column("keys")[i].as_py(), np.float64)
    places = np.frombuffer(batch.column("places")[i].as_py(), np.int32)
    return list(zip(np.split(keys, cuts), np.split(places, cuts), strict=True))


def _matrix(batch: pa.RecordBatch, i: int, dim: int) -> np.ndarray:
    return np.frombuffer(batch.column("matrix")[i].as_buffer(), np.int32).reshape(-1, dim)


def assign_blocks(centroids: np.ndarray, spent: np.ndarray):
    """Blocks with their heaps to the heaps after one assignment, and what moved."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                heaps, moved = _advance(_matrix(batch, i, centroids.shape[1]), _heaps(batch, i), centroids, spent)
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": batch.column("block").slice(i, 1), "sizes": pa.array([[len(keys) for keys, _ in heaps]], pa.list_(pa.int32())),
                        "keys": pa.array([np.concatenate([keys for keys, _ in heaps]).tobytes()], pa.binary()),
                        "places": pa.array([np.concatenate([p for _, p in heaps]).astype(np.int32).tobytes()], pa.binary()),
                        "moved": pa.array([None if moved is None else moved.ravel()], pa.list_(pa.int64())),
                    }
                )

    return run


def final_rows(centroids: np.ndarray):
    """Blocks with their heaps to (vec_id, cluster, distance)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = _matrix(batch, i, centroids.shape[1])
                cluster = np.empty(len(x), np.int32)
                for c, (_, places) in enumerate(_heaps(batch, i)):
                    cluster[places] = c
                distance = np.empty(len(x), np.int64)
                for c in range(len(centroids)):
                    mine = cluster == c
                    distance[mine] = ((x[mine].astype(np.int64) - centroids[c]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("ids")[i].values, "cluster": pa.array(cluster), "distance": pa.array(distance)})

    return run


def total_moves(state: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """What moved in all blocks; as many rows as there are numbers in ``shape``."""
    sums = state.where(F.col("moved").isNotNull()).select(F.posexplode("moved").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(shape[0] * shape[1], object)
    for r in sums:
        out[r["pos"]] = r["x"]
    return out.reshape(shape)


@dataclass(frozen=True)
class Clusters:
    """``rows``: (vec_id, cluster, distance), stored; ``centroids``: the final ones."""

    rows: DataFrame
    centroids: np.ndarray


def cluster(spark: SparkSession, vectors: DataFrame, spec: Clustering) -> Clusters:
    centroids = first_centroids(vectors, spec)
    k = len(centroids)
    if not k:
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids)
    names = []
    blocks, name = bucketed(pack(vectors, spec.dim), "vectors")
    names.append(name)
    state, sums, spent = None, np.zeros((k, spec.dim + 1), object), np.zeros(k)
    for step in range(spec.rounds + 1):
        old = blocks.select("block", "matrix")
        old = old if state is None else old.join(state.drop("moved"), "block")
        state, name = bucketed(old.mapInArrow(assign_blocks(centroids, spent), STATE), "heaps")
        names.append(name)
        if step == spec.rounds:
            break
        sums = sums + total_moves(state, sums.shape)
        moved = np.array([[int(s) // int(row[0]) for s in row[1:]] if row[0] else list(c) for row, c in zip(sums, centroids, strict=True)], np.int64)
        if (moved == centroids).all():
            break  # the remaining rounds would change nothing
        drift = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        others = [np.delete(drift, c).max(initial=0.0) for c in range(k)]
        centroids, spent = moved, spent + drift + others
    rows = stage(blocks.join(state.drop("moved"), "block").mapInArrow(final_rows(centroids), "vec_id long, cluster int, distance long"), "clusters")
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    return Clusters(rows, centroids)


def digest(components: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in components).encode()).hexdigest()


def cluster_embeddings(rows: DataFrame, spec: Clustering = Clustering(), id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every valid vector."""
    spark = rows.sparkSession
    found = cluster(spark, integer_vectors(rows, id, vector, spec), spec)
    sums = {r["cluster"]: r["d"] for r in found.rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row per cluster
    about = [(c, sums[c], sum(sums.values()), digest(found.centroids[c])) for c in sorted(sums)]
    side = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
