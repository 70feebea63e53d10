"""Metrics, scaling decisions, query patterns, tiers of memory, and a small result cache."""

from __future__ import annotations

import sys
import time
from collections import OrderedDict
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_by_node(metrics: DataFrame, *fields: str) -> DataFrame:
    """node_id and the fields of its latest row (ts, then seq)."""
    return metrics.groupBy("node_id").agg(F.max_by(F.struct(*fields), F.struct("ts", "seq")).alias("m")).select("node_id", "m.*")


def cluster_stats(metrics: DataFrame) -> DataFrame:
    """One row over the latest metrics of all nodes."""
    m = latest_by_node(metrics, "cpu", "memory", "latency_ms", "qps", "active")
    return m.agg(F.count("*").alias("n_nodes"), F.avg("cpu").alias("cpu"), F.avg("memory").alias("memory"), F.avg("latency_ms").alias("latency_ms"), F.sum("qps").alias("qps"), F.sum("active").alias("active"))


def history(metrics: DataFrame, window: int) -> DataFrame:
    """The last `window` rows of each node."""
    w = W.partitionBy("node_id").orderBy(F.desc("ts"), F.desc("seq"))
    return metrics.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= window)


def trends(metrics: DataFrame, value: str, window: int = 10) -> DataFrame:
    """node_id, trend: the second half of the last rows against the first, beyond a tenth of it."""
    h = history(metrics, window).withColumn("n", F.count("*").over(W.partitionBy("node_id")))
    early = F.col("age") > F.col("n") - F.floor(F.col("n") / 2)
    s = h.groupBy("node_id").agg(F.count("*").alias("n"), F.avg(F.when(early, F.col(value))).alias("a"), F.avg(F.when(~early, F.col(value))).alias("b"))
    d, t = F.col("b") - F.col("a"), F.col("a") * 0.1
    return s.select("node_id", F.when(F.col("n") < 3, "stable").when(d > t, "increasing").when(d < -t, "decreasing").otherwise("stable").alias("trend"))


def scaling(stats: DataFrame, current: int, low: int = 1, high: int = 10, up: float = 80.0, down: float = 30.0, latency: float = 20.0, rising: bool = False) -> DataFrame:
    """action, target, reason for one row of cluster_stats. rising: whether a predicted load counts as well."""
    reason = F.when(F.col("cpu") > up, "cpu").when(F.col("memory") > up, "memory").when(F.col("latency_ms") > latency, "latency")
    reason = reason.when(F.lit(rising) & (F.col("cpu") > up * 0.8), "predicted").when((F.col("cpu") < down) & (F.col("memory") < down) & F.lit(current > low), "idle")
    r = stats.withColumn("reason", reason)
    step = F.when(F.col("reason") == "idle", -1).when(F.col("reason").isNotNull(), 1).otherwise(0)
    target = F.least(F.greatest(F.lit(current) + step, F.lit(low)), F.lit(high))
    action = F.when(target > current, "scale_up").when(target < current, "scale_down").otherwise("none")
    return r.select(action.alias("action"), target.cast("long").alias("target"), F.coalesce("reason", F.lit("steady")).alias("reason"))


def percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """p50, p95, p99 (exact, interpolated), mean, least, greatest and count."""
    p = lambda q: F.percentile(value, F.lit(q)).alias(f"p{round(q * 100)}")
    return rows.groupBy(*by).agg(p(0.5), p(0.95), p(0.99), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count("*").alias("n"))


def patterns(log: DataFrame, n: int) -> DataFrame:
    """Sequences of n queries in a row within a session, and how often: log has session, seq, query."""
    w = W.partitionBy("session").orderBy("seq")
    steps = log.select("session", *[F.lead("query", i).over(w).alias(f"q{i}") for i in range(n)])
    return steps.filter(F.col(f"q{n - 1}").isNotNull()).groupBy(*[f"q{i}" for i in range(n)]).agg(F.count("*").alias("n"))


def next_queries(log: DataFrame) -> DataFrame:
    """query, next_query, n, rank: what follows a query, most often first."""
    p = patterns(log, 2).select(F.col("q0").alias("query"), F.col("q1").alias("next_query"), "n")
    return p.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("n"), "next_query")).cast("long"))


def predicted(log: DataFrame, now: Column | float | None = None) -> DataFrame:
    """query, predicted, score: of the patterns of 3 and 2 queries that end with a query the one of the highest frequency
    over 1 + age; what it begins with is what the query leads to. log has session, seq (seconds), query; now: the last seq."""
    w = W.partitionBy("session").orderBy("seq")
    steps = log.select("query", "seq", F.lag("query", 1).over(w).alias("one"), F.lag("query", 2).over(w).alias("two"))
    three = F.when(F.col("two").isNotNull(), F.concat_ws("|", "two", "one", "query"))
    two = F.when(F.col("two").isNotNull(), F.concat_ws("|", "one", "query"))
    flat = steps.select("query", "seq", F.explode(F.array(F.struct(F.col("two").alias("first"), three.alias("pattern")), F.struct(F.col("one").alias("first"), two.alias("pattern")))).alias("p")).filter("p.pattern is not null")
    n = flat.groupBy("query", "p.pattern", "p.first").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    if now is None:
        n, now = n.crossJoin(log.agg(F.max("seq").alias("now"))), F.col("now")
    s = n.withColumn("score", F.col("n") / (1 + (now - F.col("last"))))
    best = s.groupBy("query").agg(F.max_by(F.struct("first", "score"), F.struct("score", "pattern")).alias("b"))
    return best.select("query", F.col("b.first").alias("predicted"), "b.score")


def most_common(log: DataFrame, k: int) -> DataFrame:
    return log.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(k)


def tiers_by_access(accesses: DataFrame, promote: int = 10) -> DataFrame:
    """item, n, tier: hot from `promote` accesses on, warm from a tenth of that, else cold."""
    n = accesses.groupBy("item").agg(F.count("*").alias("n"))
    return n.withColumn("tier", F.when(F.col("n") >= promote, "hot").when(F.col("n") >= max(1, promote // 10), "warm").otherwise("cold"))


def cache_hits(log: DataFrame, ttl: float) -> DataFrame:
    """One row: hits and misses of a cache without a size limit, of entries that live `ttl` seconds after their last use."""
    w = W.partitionBy("query").orderBy("at", "seq")
    hit = log.select(F.coalesce(F.col("at") - F.lag("at").over(w) <= ttl, F.lit(False)).alias("hit"))
    return hit.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")).withColumn("hit_rate", F.col("hits") / (F.col("hits") + F.col("misses")))


class Scaler:
    """Decisions over time: none within a cooldown after the last one that changed something; each is told to listeners."""

    def __init__(self, nodes: int, low: int = 1, high: int = 10, cooldown: float = 60.0, clock=time.monotonic):
        self.nodes, self.low, self.high, self.cooldown, self.clock = nodes, low, high, cooldown, clock
        self.changed: float | None = None
        self.listeners: list = []

    def decide(self, stats: DataFrame, **limits: Any) -> dict[str, Any]:
        now = self.clock()
        if self.changed is not None and now - self.changed < self.cooldown:
            return {"action": "none", "target": self.nodes, "reason": "cooldown"}
        out = scaling(stats, self.nodes, self.low, self.high, **limits).first().asDict()
        if out["action"] != "none":
            self.nodes, self.changed = out["target"], now
            for f in self.listeners:
                f(out)
        return out


class Tiers:
    """Items in a hot, a warm and a cold tier of so many places: used `promote` times they rise, and a tier that is over
    `full` of its places sends those that were used longest ago down."""

    def __init__(self, hot: int, warm: int, promote: int = 10, full: float = 0.8):
        self.sizes, self.promote, self.full = {"hot": hot, "warm": warm}, promote, full
        self.kept: dict[str, OrderedDict[Any, int]] = {t: OrderedDict() for t in ("hot", "warm", "cold")}

    def tier(self, item: Any) -> str | None:
        return next((t for t, k in self.kept.items() if item in k), None)

    def use(self, item: Any) -> str:
        was = self.tier(item)
        n = 1 + (self.kept[was].pop(item) if was else 0)
        self.kept["hot" if n >= self.promote else "warm" if n >= max(1, self.promote // 10) else "cold"][item] = n
        for t, below in (("hot", "warm"), ("warm", "cold")):
            while len(self.kept[t]) > self.full * self.sizes[t]:
                old, m = self.kept[t].popitem(last=False)
                self.kept[below][old] = m
        return self.tier(item)


class ResultCache:
    """Collected results by (snapshot version, query key): least recently used go first, beyond so many entries or bytes,
    old ones when asked for. A result that is larger than all that room is not kept."""

    def __init__(self, size: int = 1000, ttl: float = 3600.0, clock=time.monotonic, max_bytes: int = 100 << 20):
        self.size, self.ttl, self.clock, self.max_bytes, self.bytes = size, ttl, clock, max_bytes, 0
        self.kept: OrderedDict[Any, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = self.evictions = 0

    def _drop(self, key: Any) -> None:
        if key in self.kept:
            self.bytes -= self.kept.pop(key)[2]

    def get(self, key: Any) -> Any:
        if key in self.kept and self.clock() - self.kept[key][0] <= self.ttl:
            self.hits += 1
            self.kept.move_to_end(key)
            return self.kept[key][1]
        self._drop(key)
        self.misses += 1
        return None

    def put(self, key: Any, value: Any) -> None:
        n = int(value.memory_usage(deep=True).sum()) if hasattr(value, "memory_usage") else sys.getsizeof(value)
        self._drop(key)
        if n > self.max_bytes:
            return
        self.kept[key] = (self.clock(), value, n)
        self.bytes += n
        while len(self.kept) > self.size or self.bytes > self.max_bytes:
            self._drop(next(iter(self.kept)))
            self.evictions += 1

    def stats(self) -> dict[str, float]:
        n = self.hits + self.misses
        return dict(hit_rate=self.hits / n if n else 0.0, hits=self.hits, misses=self.misses, evictions=self.evictions)
