"""Exact nearest neighbours of many queries.

Vectors and queries are packed into blocks of rows; every pair of blocks is one matrix product in NumPy. Spark
broadcasts the side of query blocks only where its statistics say that it is small, else it takes the Cartesian product
of the blocks. Each task keeps k candidates a query, so what is shuffled is k rows a query and task.

Queries are shuffled first, into as few parts as they fill, since the vectors are read once for each part of queries: so
that number follows the queries and not the files that they lie in. A block has a MB at most and a batch of pairs 8 MB,
and a pair is measured in slices; the memory of a worker doesn't grow with the tables. Of a pair of blocks only what is
nearer than the k-th best so far is measured."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import small_batches

BLOCK = 4096
BYTES = 1 << 20
SLICE = 512
FLUSH = 500_000
CHUNK = 16_384


def cut(b: pa.RecordBatch, block: int):
    """A batch of rows with a vector v in slices of that many rows and of a MB at most."""
    size = max(1, min(block, BYTES * len(b) // max(1, 8 * len(b["v"].flatten()))))
    for a in range(0, len(b), size):
        yield b.slice(a, size)


def packed(rows: DataFrame, id_col: str, vec_col: str, names: tuple[str, str], block: int = BLOCK, gather: bool = False) -> DataFrame:
    """Rows as blocks of ids and of components (packed doubles). gather: rows are shuffled into as few parts as they fill."""
    small_batches(rows.sparkSession)

    def run(batches):
        for b in batches:
            for part in cut(b, block):
                flat = part["v"].flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([part["id"].to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()), pa.array([flat.astype(np.float64).tobytes()], pa.binary())], list(names))

    flat = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0")
    return (flat.repartition("id") if gather else flat).mapInArrow(run, f"{names[0]} binary, {names[1]} binary")


def scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return -(q @ v.T)
    return (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (q @ v.T)


def exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Of row pairs, summed in order of the components."""
    return -np.cumsum(q * v, 1)[:, -1] if metric == "dot" else np.sqrt(np.cumsum((q - v) ** 2, 1)[:, -1])


def nearest(qi: np.ndarray, q: np.ndarray, vi: np.ndarray, v: np.ndarray, k: int, metric: str, keep_self: bool, among: np.ndarray | None = None, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query (by its place) at least its k nearest, with near ties: places, ids, exact distances. among: which pairs
    count. bound: a distance for each query, infinite where there is none; what lies beyond isn't wanted."""
    s = scores(q, v, metric)
    if among is not None:
        s[~among] = np.inf
    if not keep_self:
        s[qi[:, None] == vi[None, :]] = np.inf
    n = min(k, len(vi))
    rounding = 1e-15 * q.shape[1] * ((q * q).sum(1)[:, None] + (v * v).sum(1).max())  # what it can do
    # near ties stay until they are measured exactly
    wanted = lambda edge: s <= edge + 1e-9 * (1 + np.abs(edge)) + rounding
    near = None
    if bound is not None:
        near = wanted((bound if metric == "dot" else bound * bound)[:, None])
    if near is None or np.count_nonzero(near) > 4 * n * len(s):
        first = wanted(np.partition(s, n - 1, 1)[:, n - 1 : n])
        near = first if near is None else near & first
    i, j = np.nonzero(near)
    held = np.isfinite(s[i, j])
    i, j = i[held], j[held]
    d = [exact(q[i[a : a + CHUNK]], v[j[a : a + CHUNK]], metric) for a in range(0, len(i), CHUNK)]
    return i, vi[j], np.concatenate(d) if d else np.zeros(0)


def best(i: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each place by distance, then id."""
    order = np.lexsort((ids, d, i))
    i, ids, d = i[order], ids[order], d[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    m = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
    return i[m], ids[m], d[m]


def near(qi: np.ndarray, q: np.ndarray, rows: np.ndarray, vi: np.ndarray, v: np.ndarray, k: int, metric: str, keep_self: bool, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """nearest() of those rows of q, cut down to k a query, a slice at a time, so that memory doesn't grow with the block."""
    out = []
    for a in range(0, len(rows), SLICE):
        own = rows[a : a + SLICE]
        i, ids, d = best(*nearest(qi[own], q[own], vi, v, k, metric, keep_self, bound=None if bound is None else bound[own]), k)
        out.append((own[i], ids, d))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class Held:
    """The k best so far of the n queries of a block (by place), and the distance of the last of those."""

    def __init__(self, n: int, k: int):
        self.k, self.bound = k, np.full(n, np.inf)
        self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, *part: np.ndarray) -> int:
        """How many rows are held more than before."""
        if not len(part[0]):
            return 0
        had = len(self.hits[0])
        self.hits = i, _, d = best(*(np.concatenate(c) for c in zip(self.hits, part, strict=True)), self.k)
        n = np.bincount(i, minlength=len(self.bound))
        full = n == self.k
        self.bound[full] = d[np.cumsum(n)[full] - 1]
        return len(i) - had


def side(rows: DataFrame, key: str, id_col: str, names: tuple[str, str, str], gather: bool = False) -> DataFrame:
    """Rows as blocks of keys, ids and components, in whatever order they come. gather: as in packed()."""
    small_batches(rows.sparkSession)
    block = BLOCK

    def run(batches):
        for b in batches:
            for part in cut(b, block):
                g, ids = (part[c].to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("g", "id"))
                flat = part["v"].flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (g, ids, flat.astype(np.float64).tobytes())], list(names))

    some = rows.select(F.col(key).cast("long").alias("g"), F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter("g is not null and id is not null and v is not null and size(v) > 0")
    return (some.repartition("g", "id") if gather else some).mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def grouped_hits(queries: DataFrame, vectors: DataFrame, key: str, k: int, metric: str = "l2") -> DataFrame:
    """key, query_id, vec_id, distance: what grouped_knn chooses from, k rows a query, group and task.

    Blocks hold rows of many groups, and in a pair of blocks the rows of each group that both have are multiplied. So no
    group is gathered in one place, however large, and vectors are not shuffled."""
    pairs = side(vectors, key, "vec_id", ("v_g", "v_ids", "v")).crossJoin(side(queries, key, "query_id", ("q_g", "q_ids", "q"), gather=True))

    def run(batches):
        held: dict[tuple[bytes, bytes], Held] = {}
        size = 0

        def flush():
            for (q_g, q_ids), h in held.items():
                i, ids, dist = h.hits
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(q_g, np.int64)[i]), pa.array(np.frombuffer(q_ids, np.int64)[i]), pa.array(ids), pa.array(dist)], ["g", "query_id", "vec_id", "distance"])

        for b in batches:
            for r in range(len(b)):
                v_g, v_ids, v, q_g, q_ids, q = (b[c][r].as_buffer() for c in ("v_g", "v_ids", "v", "q_g", "q_ids", "q"))
                (vg, vi), (qg, qi) = ([np.frombuffer(x, np.int64) for x in y] for y in ((v_g, v_ids), (q_g, q_ids)))
                v, q = np.frombuffer(v, np.float64).reshape(len(vi), -1), np.frombuffer(q, np.float64).reshape(len(qi), -1)
                v_order, q_order = np.argsort(vg, kind="stable"), np.argsort(qg, kind="stable")
                groups = np.intersect1d(vg, qg)
                ends = [np.searchsorted(x[o], groups, s) for x, o in ((vg, v_order), (qg, q_order)) for s in ("left", "right")]
                h = held.setdefault((qg.tobytes(), qi.tobytes()), Held(len(qi), k))
                for v0, v1, q0, q1 in zip(*ends, strict=True):
                    own = v_order[v0:v1]
                    size += h.add(*near(qi, q, q_order[q0:q1], vi[own], v[own], k, metric, True, h.bound))
                if size > FLUSH:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return pairs.mapInArrow(run, "g long, query_id long, vec_id long, distance double").withColumnRenamed("g", key)


def grouped_knn(queries: DataFrame, vectors: DataFrame, key: str, k: int, metric: str = "l2") -> DataFrame:
    """key, query_id, vec_id, distance: for each query of a group (a long) the k nearest vectors of that group."""
    hits = grouped_hits(queries, vectors, key, k, metric)
    lists = hits.groupBy(key, "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))), 1, k).alias("l"))
    return lists.select(key, "query_id", F.explode("l").alias("x")).select(key, "query_id", "x.vec_id", "x.distance")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, distance, rank: the k first of each query's rows of hits."""
    lists = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))), 1, k).alias("l"))
    flat = lists.select("query_id", F.posexplode("l").alias("pos", "x"))
    return flat.select("query_id", F.col("x.vec_id").alias("vec_id"), F.col("x.distance").alias("distance"), (F.col("pos") + 1).cast("long").alias("rank"))


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, metric: str = "l2", q_cols=("query_id", "embedding"), v_cols=("vec_id", "embedding"), keep_self: bool = True) -> DataFrame:
    """query_id, vec_id, distance (l2, or for "dot" the negative product), rank from 1; ties go by vec_id."""
    pairs = packed(vectors, *v_cols, ("v_ids", "v")).crossJoin(packed(queries, *q_cols, ("q_ids", "q"), gather=True))

    def run(batches):
        held: dict[bytes, Held] = {}
        size = 0

        def flush():
            for q_ids, h in held.items():
                q, (i, ids, dist) = np.frombuffer(q_ids, np.int64), h.hits
                yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(ids), pa.array(dist)], ["query_id", "vec_id", "distance"])

        for b in batches:
            for r in range(len(b)):
                v_ids, v, q_ids, q = (b[c][r].as_buffer() for c in ("v_ids", "v", "q_ids", "q"))
                vi, qi = np.frombuffer(v_ids, np.int64), np.frombuffer(q_ids, np.int64)
                v, q = np.frombuffer(v, np.float64).reshape(len(vi), -1), np.frombuffer(q, np.float64).reshape(len(qi), -1)
                h = held.setdefault(qi.tobytes(), Held(len(qi), k))
                size += h.add(*near(qi, q, np.arange(len(qi)), vi, v, k, metric, keep_self, h.bound))
                if size > FLUSH:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return ranked(pairs.mapInArrow(run, "query_id long, vec_id long, distance double"), k)


def knn_filtered(queries: DataFrame, vectors: DataFrame, where, k: int = 10, mode: str = "pre", **options) -> DataFrame:
    """where: a predicate on vectors. "pre" ranks what it lets through; "post" ranks all, then filters."""
    if mode == "pre":
        return knn(queries, vectors.filter(where), k, **options)
    hits = knn(queries, vectors, k, **options)
    return hits.join(vectors.filter(where).select("vec_id"), "vec_id", "left_semi")


def with_scores(hits: DataFrame) -> DataFrame:
    """score: the cosine of unit vectors at that distance."""
    return hits.withColumn("score", 1 - F.col("distance") * F.col("distance") / 2)


def with_documents(hits: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    """Hits with the named columns of their documents, null where there is none."""
    return hits.join(docs.select(F.col("doc_id").alias("vec_id"), *columns), "vec_id", "left")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the share of true pairs (query_id, vec_id) that were found."""
    hits = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").agg(F.count("*").alias("hits"))
    n = truth.agg(F.countDistinct("query_id").alias("n_queries"))
    return hits.crossJoin(n).select((F.col("hits") / (F.col("n_queries") * k)).alias("recall"), "n_queries")


def measures(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """dot, l2, cosine and geodesic of all pairs, summed in order of the components."""
    dot, l2, x = (np.zeros((len(a), len(b))) for _ in range(3))
    for i in range(a.shape[1]):
        u, w = a[:, i, None], np.ascontiguousarray(b[:, i])[None, :]
        dot += np.multiply(u, w, out=x)
        np.subtract(u, w, out=x)
        l2 += np.multiply(x, x, out=x)
    na, nb = (np.sqrt(np.cumsum(y * y, 1)[:, -1]) for y in (a, b))
    with np.errstate(divide="ignore", invalid="ignore"):
        return dot, np.sqrt(l2), dot / (na[:, None] * nb[None, :]), np.arccos(np.clip(dot, -1.0, 1.0))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves go away from zero."""
    y = x * 10.0**digits
    return np.trunc(y + np.copysign(0.5, y)) / 10.0**digits


def pair_measures(vectors: DataFrame, key: str, digits: int, stripe: int = 1024) -> DataFrame:
    """a_id, b_id (a_id < b_id), dot, l2, cosine, geodesic of every two vectors of a key, rounded; null where a vector or one
    of its components is null, the cosine also where one is zero.

    The vectors of a key are dealt into stripes, and a pair of stripes is one group: a vector is sent once for each stripe of
    its key, and a task holds a pair of stripes, its largest matrices being a sixteenth of that."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.filter("vec_id is not null").filter(F.col(key).isNotNull()).select(F.col(key).alias("g"), F.col("vec_id").alias("id"), F.when(F.forall(v, lambda x: x.isNotNull()), v).alias("v"))
    n = rows.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    s = max(1, -(-n // stripe))
    own = rows.withColumn("r", F.pmod(F.xxhash64("id"), F.lit(s)).cast("int"))
    sent = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("o")).select("g", F.least("r", "o").alias("i"), F.greatest("r", "o").alias("j"), "r", "id", "v")

    def run(t: pa.Table) -> pa.Table:
        i, j, r = t["i"][0].as_py(), t["j"][0].as_py(), t["r"].to_numpy()
        ids, held = t["id"].to_numpy(), t["v"].combine_chunks()
        none = ~held.is_valid().to_numpy(zero_copy_only=False)
        flat = held.drop_null().flatten().to_numpy(zero_copy_only=False)
        x = np.zeros((len(ids), len(flat) // max(1, (~none).sum())))
        x[~none] = flat.reshape((~none).sum(), -1)
        left, right = np.flatnonzero(r == i), np.flatnonzero(r == j)
        out = []
        for a in range(0, len(left), 64):
            m = left[a : a + 64]
            keep = np.ones((len(m), len(right)), bool) if i != j else ids[m][:, None] < ids[right][None, :]
            p, q = np.nonzero(keep)
            own = [rounded(y[keep], digits) for y in measures(x[m], x[right])]
            p, q = m[p], right[q]
            bad = none[p] | none[q]
            u, w = ids[p], ids[q]
            gone = (bad, bad, bad | np.isnan(own[2]), bad)
            out.append(pa.table({"a_id": np.minimum(u, w), "b_id": np.maximum(u, w)} | {c: pa.array(y, mask=z) for c, y, z in zip(("dot", "l2", "cosine", "geodesic"), own, gone, strict=True)}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], k) for c, k in zip(("a_id", "b_id", "dot", "l2", "cosine", "geodesic"), [pa.int64()] * 2 + [pa.float64()] * 4, strict=True)})

    return sent.groupBy("g", "i", "j").applyInArrow(run, "a_id long, b_id long, dot double, l2 double, cosine double, geodesic double")
