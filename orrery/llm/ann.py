"""Approximate nearest neighbours by learned partitions.

1. A tree of parts: every node has `fan` parts at most, and there are as many levels as it takes for a leaf to hold some
   `target` vectors, so parts are in proportion to the vectors. A sample of each node's vectors (`sample` of them, by
   hashed id; a documented bound for a node, so all samples together grow with the table) is joined into a graph of near
   neighbours, and the graph cut into parts of equal size: halves along main directions, then vectors move to the part
   that holds most of their neighbours, as far as parts have room.
2. A small classifier for each node (one hidden layer) learns to tell a vector's part, by the parts of its neighbours.
3. Every vector is stored in its most probable leaf. A query goes down the tree, of every level's nodes the `probes` most
   probable ones, and is compared with all vectors of its `probes` leaves.
`probes` is the least number by which `held` queries, which no classifier was fitted on, find `recall` of their true
neighbours (against all vectors): few leaves where vectors are clustered, about half of them where they are uniform.

Vectors move in blocks of one node, and routers, queries and blocks meet by joins on the node, so neither a large node
nor a vector that repeats is ever held by one task.

Distances are Euclidean, ties go by id. Defined results: rows with a null id, a null vector, a component that is null
or not finite, or another length than most rows (of lengths as frequent, the greatest), have no neighbours and are none.
Rows that repeat an id are one neighbour, at the distance of the nearest of them, and share one list; a vector is never
its own neighbour. Fewer than k others give fewer rows; an empty table, or none of the queries, gives none. Other
columns are not looked at, whatever their names; texts play no part, and vectors may be of any length."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import column, drop_table, written

K, TARGET, FAN, SAMPLE, RECALL, HELD, NEAR, HIDDEN = 10, 150, 32, 1200, 0.96, 400, 12, 64
BLOCK = 1024
BLOCKS = "node long, ids binary, v binary"


@dataclass
class Router:
    """Weights of the classifier."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    center: np.ndarray
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The logarithms of the chances of all parts."""
        h = np.maximum((x - self.center) * self.scale @ self.w1 + self.b1, 0)
        s = h @ self.w2 + self.b2
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))

    def packed(self) -> bytes:
        return b"".join(x.astype(np.float32).tobytes() for x in (self.center, np.array([self.scale]), self.w1, self.b1, self.b2, self.w2))

    @staticmethod
    def unpacked(data: bytes, dim: int, hidden: int) -> Router:
        x = np.frombuffer(data, np.float32)
        parts = (len(x) - dim - 1 - dim * hidden - hidden) // (hidden + 1)
        cut = np.cumsum([dim, 1, dim * hidden, hidden, parts])
        center, scale, w1, b1, b2, w2 = np.split(x, cut)
        return Router(w1.reshape(dim, hidden), b1, w2.reshape(hidden, parts), b2, center, float(scale[0]))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared, between all rows."""
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T), 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1000):
        d = distances(x[a : a + 1000], x)
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 1000] = np.argpartition(d, k - 1, 1)[:, :k]
    return out


def halves(x: np.ndarray, rows: np.ndarray, parts: int, first: int, out: np.ndarray) -> None:
    """Parts of equal size, by cuts across the main direction."""
    if parts == 1:
        out[rows] = first
        return
    c = x[rows] - x[rows].mean(0)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(20):
        v = c.T @ (c @ v)
        v /= np.linalg.norm(v) + 1e-12
    order = rows[np.argsort(c @ v, kind="stable")]
    left = parts // 2
    cut = len(rows) * left // parts
    halves(x, order[:cut], left, first, out)
    halves(x, order[cut:], parts - left, first + left, out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 15, slack: float = 1.05) -> np.ndarray:
    """A part for each node: few edges between parts, none larger than slack times the mean."""
    part = np.zeros(len(x), np.int64)
    halves(x, np.arange(len(x)), parts, 0, part)
    room = int(np.ceil(len(x) / parts * slack))
    ends = np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])
    starts = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])
    for _ in range(rounds):
        held = np.bincount(starts * parts + part[ends], minlength=len(x) * parts).reshape(len(x), parts)
        here = held[np.arange(len(x)), part]
        want = held.argmax(1)
        gain = held.max(1) - here
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[want[i]] < room:
                sizes[part[i]] -= 1
                sizes[want[i]] += 1
                part[i] = want[i]
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, goal: np.ndarray, hidden: int = HIDDEN, epochs: int = 40, seed: int = 5) -> Router:
    """Cross-entropy against the goal's shares, by Adam over small batches."""
    rng = np.random.default_rng(seed)
    d, parts = x.shape[1], goal.shape[1]
    center = x.mean(0)
    scale = float(1 / (x.std() + 1e-9))
    z = (x - center) * scale
    p = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m1, m2, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for e in range(epochs):
        order = rng.permutation(len(z))
        rate = 0.004 * (1 - e / epochs) + 1e-4
        for a in range(0, len(z), 128):
            i = order[a : a + 128]
            h0 = z[i] @ p[0] + p[1]
            h = np.maximum(h0, 0)
            s = h @ p[2] + p[3]
            s = np.exp(s - s.max(1, keepdims=True))
            g = (s / s.sum(1, keepdims=True) - goal[i]) / len(i)
            gh = (g @ p[2].T) * (h0 > 0)
            t += 1
            for j, gr in enumerate((z[i].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m1[j] = 0.9 * m1[j] + 0.1 * gr
                m2[j] = 0.999 * m2[j] + 0.001 * gr * gr
                p[j] = p[j] - rate * (m1[j] / (1 - 0.9**t)) / (np.sqrt(m2[j] / (1 - 0.999**t)) + 1e-8)
    return Router(*(w.astype(np.float32) for w in p), center.astype(np.float32), scale)


def train(x: np.ndarray, parts: int) -> Router:
    graph = neighbour_graph(x, NEAR)
    part = balanced_parts(x, graph, parts)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    goal[np.arange(len(x)), part] += 0.5
    return fit_router(x, goal)


def floats(x, dim: int) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.float32).reshape(-1, dim)


def longs(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int64)


def closest(q: np.ndarray, mine: np.ndarray, x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and squared distances of at least the k nearest others of each query; ids may repeat by `twice`.

    A product of matrices names what may be among them, then differences give the distance, so equal vectors tie."""
    k += twice(own)
    size = (x * x).sum(1).max() if len(x) else 0.0
    out = []
    for a in range(0, len(q), 64):
        d = distances(q[a : a + 64], x)
        d[mine[a : a + 64, None] == own[None, :]] = np.inf
        edge = np.partition(d, k - 1, 1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
        slack = 1.2e-7 * x.shape[1] * ((q[a : a + 64] ** 2).sum(1) + size)
        i, j = np.nonzero((d <= (edge + slack)[:, None]) & np.isfinite(d))
        out.append((mine[a + i], own[j], ((q[a + i].astype(np.float64) - x[j]) ** 2).sum(1)))
    return tuple(np.concatenate(y) for y in zip(*out, strict=True))


def batch(rows: list[tuple]) -> pa.RecordBatch:
    """Blocks (node, ids, vectors)."""
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (1, 2))], ["node", "ids", "v"])


def packed(rows: DataFrame, dim: int, most: int = BLOCK) -> DataFrame:
    """Rows (node, id, v array) as blocks, runs of one node each."""

    def run(batches):
        for b in batches:
            node, ids = b["node"].to_numpy(), b["id"].to_numpy()
            v = b["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), dim)
            cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(node, prepend=node[:1] - 1)), np.arange(0, len(ids), most)]))
            if len(ids):
                yield batch([(node[i], ids[i:j], v[i:j]) for i, j in zip(cuts, [*cuts[1:], len(ids)], strict=True)])

    return rows.mapInArrow(run, BLOCKS)


def merged(blocks: DataFrame, dim: int) -> DataFrame:
    """Blocks of the same nodes brought together; ranges by node and hash, so that large nodes lie in many."""

    def run(batches):
        node, ids, v, size = None, [], [], 0
        done = lambda: (node, np.concatenate(ids), np.concatenate(v))
        for b in batches:
            out = []
            for i, x, y in zip(b["node"].to_pylist(), b["ids"], b["v"], strict=True):
                if size and (i != node or size >= BLOCK):
                    out.append(done())
                    ids, v, size = [], [], 0
                node = i
                ids.append(longs(x).copy())
                v.append(floats(y, dim).copy())
                size += len(ids[-1])
            if out:
                yield batch(out)
        if size:
            yield batch([done()])

    return blocks.repartitionByRange("node", F.xxhash64("ids")).sortWithinPartitions("node").mapInArrow(run, BLOCKS)


def fitted(blocks: DataFrame, dim: int, fan: int, sample: int, held: np.ndarray) -> DataFrame:
    """node, router: of a sample of each node's vectors, without the held ids; none for a node with too few."""

    def pick(batches):
        for b in batches:
            out = []
            for node, x, y, n in zip(b["node"].to_pylist(), b["ids"], b["v"], b["n"].to_pylist(), strict=True):
                ids = longs(x)
                h = (ids.astype(np.uint64) + np.uint64(node % 2**32)) * np.uint64(0x9E3779B97F4A7C15)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(33)
                keep = (h < min(1.0, sample / n) * 2**31) & ~np.isin(ids, held)
                if keep.any():
                    out.append((node, ids[keep], floats(y, dim)[keep]))
            if out:
                yield batch(out)

    def fit(key, t):
        ids = np.concatenate([longs(x) for x in t["ids"]])
        x = np.concatenate([floats(y, dim) for y in t["v"]])
        # an id that repeats is one of the sample, so this is bounded too
        x = x[np.lexsort((*x.T[:2], ids))]
        x = x[np.sort(np.unique(np.sort(ids), return_index=True)[1])]
        parts = min(fan, len(x) // 8)
        router = [] if parts < 2 else [train(x, parts).packed()]
        return pa.table({"node": pa.array([key[0].as_py()] * len(router), pa.int64()), "router": pa.array(router, pa.binary())})

    sizes = blocks.groupBy("node").agg(F.sum(F.length("ids") / 8).alias("n"))
    return blocks.join(sizes, "node").mapInArrow(pick, BLOCKS).groupBy("node").applyInArrow(fit, "node long, router binary")


def divided(blocks: DataFrame, routers: DataFrame, dim: int, fan: int) -> DataFrame:
    """Blocks of the next level: every vector in its most probable part; the first one where there is no router."""

    def run(batches):
        for b in batches:
            out = []
            for node, x, y, r in zip(b["node"].to_pylist(), b["ids"], b["v"], b["router"], strict=True):
                ids, v = longs(x), floats(y, dim)
                part = Router.unpacked(r.as_buffer(), dim, HIDDEN).scores(v).argmax(1) if r.is_valid else np.zeros(len(ids), int)
                out += [(node * fan + p, ids[part == p], v[part == p]) for p in np.unique(part).tolist()]
            if out:
                yield batch(out)

    return blocks.join(routers, "node", "left").mapInArrow(run, BLOCKS)


def leaves(queries: DataFrame, routers: list[DataFrame], dim: int, fan: int, width: int) -> DataFrame:
    """id, node, place (from 1): the `width` most probable leaves of each query (id, v), by as many nodes on every level."""
    spread = "above long, node long, id long, chance double"

    def run(batches):
        for b in batches:
            out = []
            for node, x, y, r in zip(b["node"].to_pylist(), b["ids"], b["v"], b["router"], strict=True):
                ids, v = longs(x), floats(y, dim)
                s = Router.unpacked(r.as_buffer(), dim, HIDDEN).scores(v) if r.is_valid else np.zeros((len(ids), 1))
                out.append((np.full(s.size, node), np.tile(node * fan + np.arange(s.shape[1]), len(ids)), np.repeat(ids, s.shape[1]), s.ravel()))
            if out:
                cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3].astype(np.float64))], ["above", "node", "id", "chance"])

    at = queries.select(F.lit(0).cast("long").alias("node"), "id", F.lit(0.0).alias("so_far"))
    order = W.partitionBy("id").orderBy(F.desc("so_far"), "node")
    for i, r in enumerate(routers):
        rows = at.join(queries, "id")
        if i:
            rows = rows.repartitionByRange("node", "id")
        blocks = packed(rows.sortWithinPartitions("node").select("node", "id", "v"), dim)
        below = blocks.join(r, "node", "left").mapInArrow(run, spread)
        up = at.select(F.col("node").alias("above"), "id", "so_far")
        below = below.join(up, ["above", "id"]).select("node", "id", (F.col("so_far") + F.col("chance")).alias("so_far"))
        last, at = at, written(below.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= width).select("node", "id", "so_far"), "beam")
        if i:
            drop_table(last)
    return at.select("id", "node", F.row_number().over(order).alias("place"))


def met(pairs: DataFrame, dim: int, k: int) -> DataFrame:
    """vec_id, neighbour_id, distance, leaf: of query blocks (q_ids, q) joined with blocks (node, ids, v), the k nearest others of
    each batch."""

    def run(batches):
        for b in batches:
            out = []
            for node, qi, q, i, v in zip(*(b[c] for c in ("node", "q_ids", "q", "ids", "v")), strict=True):
                got = closest(floats(q, dim), longs(qi), floats(v, dim), longs(i), k)
                out.append((*got, np.full(len(got[0]), node.as_py(), np.int64)))
            if not out:
                continue
            q, nb, d, leaf = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((d, nb, q))
            q, nb, d, leaf = q[order], nb[order], d[order], leaf[order]
            one = np.concatenate([[True], (q[1:] != q[:-1]) | (nb[1:] != nb[:-1])]) if len(q) else np.zeros(0, bool)
            q, nb, d, leaf = q[one], nb[one], d[one], leaf[one]
            order = np.lexsort((nb, d, q))
            q, nb, d, leaf = q[order], nb[order], d[order], leaf[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < k
            yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(nb[keep]), pa.array(np.sqrt(d[keep])), pa.array(leaf[keep])], ["vec_id", "neighbour_id", "distance", "leaf"])

    return pairs.mapInArrow(run, "vec_id long, neighbour_id long, distance double, leaf long")


def nearest(found: DataFrame, k: int) -> DataFrame:
    """vec_id, neighbour_id, rank, distance, leaf: of what tasks found, the k nearest of each query."""
    one = found.groupBy("vec_id", "neighbour_id").agg(F.min(F.struct("distance", "leaf")).alias("m"))
    lists = one.groupBy("vec_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("m.distance", "neighbour_id", "m.leaf"))), 1, k).alias("l"))
    flat = lists.select("vec_id", F.posexplode("l").alias("rank", "x"))
    return flat.select("vec_id", F.col("x.neighbour_id").alias("neighbour_id"), (F.col("rank") + 1).alias("rank"), F.col("x.distance").alias("distance"), F.col("x.leaf").alias("leaf"))


def query_blocks(rows: DataFrame, dim: int) -> DataFrame:
    return packed(rows, dim).select("node", F.col("ids").alias("q_ids"), F.col("v").alias("q"))


def probes_for(held: DataFrame, blocks: DataFrame, routers: list[DataFrame], dim: int, fan: int, k: int, recall: float) -> int:
    """The least number of leaves by which the held queries find that share of their true neighbours."""
    every = query_blocks(held.coalesce(1).select(F.lit(0).cast("long").alias("node"), "id", "v"), dim).drop("node")  # HELD queries at most
    true = written(nearest(met(blocks.crossJoin(F.broadcast(every)), dim, k), k), "true")
    n, most = true.count(), fan ** len(routers)
    width = min(1024, most)
    while n:
        at = leaves(held, routers, dim, fan, width)
        places = true.join(at, (true["vec_id"] == at["id"]) & (true["leaf"] == at["node"])).groupBy("place").count().orderBy("place")
        so_far = 0
        for r in places.collect():  # a row for each place of a true neighbour, HELD * k at most
            so_far += r["count"]
            if so_far >= recall * n:
                return r["place"]
        if width >= most:
            break
        width = min(4 * width, most)
    return most


def neighbours(rows: DataFrame, queries: DataFrame | None = None, k: int = K, recall: float = RECALL, target: int = TARGET, fan: int = FAN, sample: int = SAMPLE, held: int = HELD) -> DataFrame:
    """vec_id, neighbour_id, rank (from 1), distance; of the queries (of all rows, where none are named) against all rows."""
    spark = rows.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        v = df.select(column(df, "vec_id").cast("long").alias("id"), column(df, "embedding").cast("array<float>").alias("v"))
        return v.filter("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = float('inf'))")

    v = valid(rows)
    length = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if not length:
        return spark.createDataFrame([], "vec_id long, neighbour_id long, rank int, distance double")
    dim, n = length.dim, length.n
    v = v.filter(F.size("v") == dim)
    q = (v if queries is None else valid(queries).filter(F.size("v") == dim)).distinct()
    n_leaves = max(1, round(n / target))
    depth = ceil(log(n_leaves) / log(fan) - 1e-9) if n_leaves > 1 else 0
    fan = ceil(n_leaves ** (1 / depth) - 1e-9) if depth else 1
    # a tenth of the ids at most, so that classifiers have enough to learn from
    ids = [r.id for r in v.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(max(1, min(held, n // 10))).collect()] if depth else []
    blocks, routers = written(packed(v.select(F.lit(0).cast("long").alias("node"), "id", "v"), dim), "blocks"), []
    for _ in range(depth):
        routers.append(written(fitted(blocks, dim, fan, sample, np.array(ids, np.int64)), "routers"))
        parted = written(divided(blocks, routers[-1], dim, fan), "parted")
        drop_table(blocks)
        blocks = written(merged(parted, dim), "blocks")
        drop_table(parted)
    if depth:
        chosen = spark.createDataFrame([(i,) for i in ids], "id long")
        some = written(v.join(F.broadcast(chosen), "id", "left_semi").dropDuplicates(["id"]), "held")  # HELD ids at most
        probes = probes_for(some, blocks, routers, dim, fan, k, recall)
        # one row for each vector of an id that repeats
        named = written(q.withColumn("row", F.xxhash64("id", "v")), "queries")
        at = leaves(named.select(F.col("row").alias("id"), "v").dropDuplicates(["id"]), routers, dim, fan, probes)
        sent = at.select(F.col("id").alias("row"), "node").join(named, "row").select("node", "id", "v")
        sent = written(sent, "sent").repartitionByRange("node", "id").sortWithinPartitions("node")
        for x in (*routers, some, named):
            drop_table(x)
    else:
        sent = q.select(F.lit(0).cast("long").alias("node"), "id", "v")
    found = met(query_blocks(sent, dim).join(blocks, "node"), dim, k)
    return nearest(found, k).drop("leaf")


def twice(ids: np.ndarray) -> int:
    """How many rows repeat an id."""
    return len(ids) - len(np.unique(ids))
