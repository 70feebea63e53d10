"""Shards, routing among their nodes, and the merging of their results."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import haversine, l2, md5_mod
from .collection import placed

RRF_K = 60


def by_hash(key: Column, n: int) -> Column:
    return F.concat(F.lit("edge-"), md5_mod(key, n).cast("string"))


def by_centroid(points: DataFrame, centroids: DataFrame, n_edges: int) -> DataFrame:
    """vec_id, shard: by the place of the nearest centroid, modulo the edges. Centroids: idx, centroid."""
    d = points.crossJoin(centroids).withColumn("d", l2(F.col("embedding"), F.col("centroid")))
    near = d.groupBy("vec_id").agg(F.min_by("idx", F.struct("d", "idx")).alias("idx"))
    return near.select("vec_id", F.concat(F.lit("edge-"), (F.col("idx") % n_edges).cast("string")).alias("shard"))


def by_geo(places: DataFrame, edges: DataFrame) -> DataFrame:
    """place, shard: the nearest edge (edge, lat, lon) on the globe; places without coordinates go to the first edge."""
    e = edges.select("edge", F.col("lat").alias("elat"), F.col("lon").alias("elon"))
    d = places.crossJoin(e).withColumn("d", haversine(F.col("lat"), F.col("lon"), F.col("elat"), F.col("elon")))
    return d.groupBy("place").agg(F.coalesce(F.min_by("edge", F.struct("d", "edge")), F.min("edge")).alias("shard"))


def by_least(lists: DataFrame) -> DataFrame:
    """vec_id of all shards' lists with the least distance."""
    return lists.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))


def merge(lists: DataFrame, k: int, strategy: str = "rrf") -> DataFrame:
    """query_id, vec_id, score, distance, rank. lists: query_id, shard, vec_id, distance.

    "rrf": sum over shards of 1 / (60 + place in the shard's list); "score": least distance."""
    if strategy == "rrf":
        w = W.partitionBy("query_id", "shard").orderBy("distance", "vec_id")
        placed = lists.withColumn("place", F.row_number().over(w))
        m = placed.groupBy("query_id", "vec_id").agg(F.sum(1.0 / (RRF_K + F.col("place"))).alias("score"), F.min("distance").alias("distance"))
        order = [F.desc("score"), F.asc("vec_id")]
        m = m.withColumn("score", F.round("score", 12))
    elif strategy == "score":
        m = by_least(lists).withColumn("score", -F.col("distance"))
        order = [F.asc("distance"), F.asc("vec_id")]
    else:
        raise ValueError(f"unknown strategy {strategy}")
    w = W.partitionBy("query_id").orderBy(*order)
    return m.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


# routing: nodes (node_id, active_queries, latency_ms, last_energy, weight, seconds_since_heartbeat)


def online(nodes: DataFrame, limit: float = 30.0) -> DataFrame:
    return nodes.filter(F.col("seconds_since_heartbeat") < limit)


def least_loaded(nodes: DataFrame) -> DataFrame:
    """Nodes with their load, by rising load."""
    load = 100.0 * F.col("active_queries") + F.col("latency_ms")
    return nodes.select("node_id", load.alias("load")).withColumn("rank", F.row_number().over(W.orderBy("load", "node_id")).cast("long"))


def round_robin(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, node_id in turn."""
    q = placed(queries, "turn", "query_id", first=0)
    n = nodes.select("node_id", (F.row_number().over(W.orderBy("node_id")) - 1).alias("place"))
    n = n.crossJoin(nodes.agg(F.count("*").alias("n_nodes")))
    return q.join(n, F.pmod(q["turn"], n["n_nodes"]) == n["place"]).select("query_id", "node_id")


def broadcast_all(queries: DataFrame, nodes: DataFrame, some: int = 10_000) -> DataFrame:
    """query_id, node_id: every query to every node.

    Ids alone are small, so that Spark would leave them in a part or two and one task would write the whole product; queries
    are dealt to many tasks here, and meet the nodes in lists of some."""
    n = nodes.count()
    parts = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * queries.sparkSession.sparkContext.defaultParallelism)
    lists = nodes.groupBy(F.pmod(F.xxhash64("node_id"), F.lit(-(-n // some) or 1)).alias("g")).agg(F.collect_list(F.struct("node_id")).alias("held")).select("held")
    dealt = queries.select("query_id").repartition(parts)
    pairs = dealt.crossJoin(F.broadcast(lists)) if n <= 100_000 else dealt.hint("shuffle_replicate_nl").crossJoin(lists.repartition(-(-n // 1_000_000)))
    return pairs.select("query_id", F.explode("held").alias("x")).select("query_id", "x.node_id")


def energy_chances(nodes: DataFrame) -> DataFrame:
    """node_id, p: more likely the lower the weighted energy."""
    e = nodes.select("node_id", (F.col("last_energy") * F.col("weight")).alias("e"))
    p = e.crossJoin(e.agg(F.max("e").alias("top"))).withColumn("p", F.col("top") - F.col("e") + 0.1)
    return p.crossJoin(p.agg(F.sum("p").alias("z"))).select("node_id", (F.col("p") / F.col("z")).alias("p"))


def energy_draw(nodes: DataFrame, seed: int = 42) -> DataFrame:
    return energy_chances(nodes).withColumn("t", -F.log(F.rand(seed)) / F.col("p")).orderBy("t", "node_id").limit(1).select("node_id")


def least_active(nodes: DataFrame) -> DataFrame:
    """Nodes by rising number of active queries."""
    return nodes.select("node_id", "active_queries").withColumn("rank", F.row_number().over(W.orderBy("active_queries", "node_id")).cast("long"))


class EnergyCache:
    """Energies of (query, node) for some seconds; a miss takes the node's last energy, or 1."""

    def __init__(self, ttl: float = 60.0, clock=time.monotonic):
        self.ttl, self.clock = ttl, clock
        self.last: dict[str, float] = {}
        self.kept: dict[tuple[str, str], tuple[float, float]] = {}

    def report(self, node: str, energy: float) -> None:
        self.last[node] = energy

    def get(self, query: str, node: str) -> float:
        now = self.clock()
        at, energy = self.kept.get((query, node), (None, 0.0))
        if at is None or now - at >= self.ttl:
            energy = self.last.get(node, 1.0)
            self.kept[query, node] = now, energy
        return energy


def locality(nodes: DataFrame) -> DataFrame:
    s = 1 - F.least(F.coalesce("last_energy", F.lit(1.0)), F.lit(1.0))
    return nodes.select("node_id", s.alias("score")).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "node_id")).cast("long"))


def hybrid(nodes: DataFrame) -> DataFrame:
    """Energy, load and locality together; the least is best."""
    e = F.coalesce("last_energy", F.lit(1.0))
    s = 0.4 * e + 0.2 * F.least(F.col("active_queries") / 100.0, F.lit(1.0)) + 0.3 * e
    return nodes.select("node_id", s.alias("score")).withColumn("rank", F.row_number().over(W.orderBy("score", "node_id")).cast("long"))


def route_counts(routes: DataFrame) -> DataFrame:
    return routes.groupBy("node_id").agg(F.count("*").alias("n"))
