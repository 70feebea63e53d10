"""Cross-polytope hashing with many probes."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import l2
from .knn import FLUSH, SLICE, best, nearest, packed, ranked


class CrossPolytope:
    """tables x k random rotations; a rotation hashes a vector to its greatest coordinate, with its sign."""

    def __init__(self, dim: int, n_tables: int = 15, n_bits: int = 18, seed: int = 42):
        self.k = max(1, math.ceil(n_bits / math.log2(2 * dim)))
        rng = np.random.default_rng(seed)
        self.rotations = np.empty((n_tables, self.k, dim, dim))
        for t in range(n_tables):
            for j in range(self.k):
                q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
                self.rotations[t, j] = q * np.sign(np.diag(r))

    def codes(self, x: np.ndarray) -> np.ndarray:
        """n x tables keys: the k hashes as one number."""
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
        out = np.zeros((len(x), len(self.rotations)), np.int64)
        for t, table in enumerate(self.rotations):
            for r in table:
                y = x @ r.T
                at = np.abs(y).argmax(1)
                out[:, t] = out[:, t] * (2 * x.shape[1]) + 2 * at + (y[np.arange(len(x)), at] < 0)
        return out

    def probes(self, x: np.ndarray, n_probes: int) -> list[list[list[int]]]:
        """Of each vector and table, the n_probes keys of the greatest sum of coordinates."""
        d = x.shape[1]
        m = min(d, max(2, 2 * math.ceil(n_probes ** (1 / self.k))))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-10)
        out = []
        for v in x:
            tables = []
            for table in self.rotations:
                options = []
                for r in table:
                    y = r @ v
                    top = np.argsort(-np.abs(y), kind="stable")[:m]
                    options.append([(float(abs(y[i])), int(2 * i + (y[i] < 0))) for i in top])
                best = sorted(itertools.product(*options), key=lambda c: (-sum(s for s, _ in c), [h for _, h in c]))[:n_probes]
                keys = []
                for c in best:
                    key = 0
                    for _, h in c:
                        key = key * 2 * d + h
                    keys.append(key)
                tables.append(keys)
            out.append(tables)
        return out


def buckets(vectors: DataFrame, lsh: CrossPolytope) -> DataFrame:
    """table_id, bucket, vec_id."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                c = lsh.codes(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
                n, t = c.shape
                yield pd.DataFrame({"table_id": np.tile(np.arange(t, dtype=np.int32), n), "bucket": c.ravel(), "vec_id": np.repeat(pdf["vec_id"].to_numpy(), t)})

    return vectors.select("vec_id", "embedding").mapInPandas(run, "table_id int, bucket long, vec_id long")


def probe_rows(queries: DataFrame, lsh: CrossPolytope, n_probes: int) -> DataFrame:
    """query_id, table_id, bucket."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                rows = [(q, t, key) for q, tables in zip(pdf["query_id"], lsh.probes(np.stack(pdf["embedding"].to_numpy()).astype(np.float64), n_probes), strict=True) for t, keys in enumerate(tables) for key in keys]
                yield pd.DataFrame(rows, columns=["query_id", "table_id", "bucket"])

    return queries.select("query_id", "embedding").mapInPandas(run, "query_id long, table_id int, bucket long")


def query(queries: DataFrame, vectors: DataFrame, lsh: CrossPolytope, k: int = 10, n_probes: int = 50, n_candidates: int = 600, keep_self: bool = True, built: DataFrame | None = None) -> DataFrame:
    """query_id, vec_id, distance, rank: candidates by number of shared buckets (then id), ranked by exact distance.
    built: the buckets of the vectors, where they are at hand."""
    hits = probe_rows(queries, lsh, n_probes).join(buckets(vectors, lsh) if built is None else built, ["table_id", "bucket"]).groupBy("query_id", "vec_id").agg(F.count("*").alias("shared"))
    if not keep_self:
        hits = hits.filter("query_id != vec_id")
    w = W.partitionBy("query_id").orderBy(F.desc("shared"), "vec_id")
    cand = hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n_candidates)
    d = cand.join(vectors.select("vec_id", "embedding"), "vec_id").join(queries.select("query_id", F.col("embedding").alias("qv")), "query_id").withColumn("distance", l2(F.col("qv"), F.col("embedding")))
    w = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return d.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "vec_id", "distance", "rank")


def query_all(queries: DataFrame, vectors: DataFrame, lsh: CrossPolytope, k: int = 10, n_probes: int = 50, keep_self: bool = True) -> DataFrame:
    """query_id, vec_id, distance, rank: the nearest of all vectors that share a bucket with the query, however many.

    Where a large share of the vectors shares a bucket with each query, rows of them outgrow any disk. Here buckets meet in
    pairs of blocks, in memory: of each query a table of the buckets that it probes, looked up by the vectors' codes. What is
    shuffled is k rows a query and task."""
    cells = (2 * lsh.rotations.shape[-1]) ** lsh.k
    some = min(SLICE, 32_000_000 // (len(lsh.rotations) * cells))
    if not some:
        raise ValueError("too many buckets for their table in memory")

    def run(batches):
        held: dict[bytes, list] = {}
        size = 0
        codes: dict[bytes, np.ndarray] = {}
        probed: dict[bytes, list] = {}

        def flush():
            for q_ids, parts in held.items():
                i, ids, dist = best(*(np.concatenate([p[j] for p in parts]) for j in range(3)), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(q_ids, np.int64)[i]), pa.array(ids), pa.array(dist)], ["query_id", "vec_id", "distance"])

        for b in batches:
            for v_ids, v, q_ids, q in zip(*(b[c].to_pylist() for c in ("v_ids", "v", "q_ids", "q")), strict=True):
                vi, qi = np.frombuffer(v_ids, np.int64), np.frombuffer(q_ids, np.int64)
                v, q = np.frombuffer(v, np.float64).reshape(len(vi), -1), np.frombuffer(q, np.float64).reshape(len(qi), -1)
                if v_ids not in codes:  # of one block, for its pairs with all blocks of queries come together
                    codes = {v_ids: lsh.codes(v)}
                if q_ids not in probed:
                    probed = dict(list(probed.items())[-8:]) | {q_ids: lsh.probes(q, n_probes)}
                code = codes[v_ids]
                for a in range(0, len(qi), some):
                    tables = np.zeros((code.shape[1], min(some, len(qi) - a), cells), bool)
                    for i, of in enumerate(probed[q_ids][a : a + some]):
                        for t, keys in enumerate(of):
                            tables[t, i, keys] = True
                    shared = np.zeros((tables.shape[1], len(vi)), bool)
                    for t in range(len(tables)):
                        shared |= tables[t][:, code[:, t]]
                    i, ids, d = best(*nearest(qi[a : a + some], q[a : a + some], vi, v, k, "l2", keep_self, shared), k)
                    held.setdefault(q_ids, []).append((i + a, ids, d))
                    size += len(i)
                if size > FLUSH:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    pairs = packed(vectors, "vec_id", "embedding", ("v_ids", "v")).crossJoin(packed(queries, "query_id", "embedding", ("q_ids", "q")))
    return ranked(pairs.mapInArrow(run, "query_id long, vec_id long, distance double"), k)
