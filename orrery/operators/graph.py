"""A directed property graph in two tables: nodes (id, kind, name, alpha, kappa) and edges (source, target, relation, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("DOCUMENT", "ENTITY", "CONCEPT", "RELATION")


def documents(ids: DataFrame, id_col: str, name_col: str) -> DataFrame:
    return ids.select(F.concat(F.lit("d:"), F.col(id_col).cast("string")).alias("id"), F.lit("DOCUMENT").alias("kind"), F.col(name_col).cast("string").alias("name"), F.lit(1.0).alias("alpha"), F.lit(10.0).alias("kappa"))


def entities(names: DataFrame, name_col: str) -> DataFrame:
    """One node for each name without regard to case; the least spelling stays."""
    n = names.filter(F.col(name_col).isNotNull()).groupBy(F.lower(name_col).alias("key")).agg(F.min(name_col).alias("name"))
    return n.select(F.concat(F.lit("e:"), F.col("key")).alias("id"), F.lit("ENTITY").alias("kind"), "name", F.lit(0.8).alias("alpha"), F.lit(15.0).alias("kappa"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    j = nodes.select("id").join(d, "id", "left").na.fill(0, ["o", "i"])
    return j.select("id", F.col("o").alias("out_degree"), F.col("i").alias("in_degree"), (F.col("o") + F.col("i")).alias("degree"))


def bfs(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """id and its least depth, along outgoing edges; depth is small, so the plan is."""
    seen = start.select("id").distinct().withColumn("depth", F.lit(0).cast("long"))
    frontier = seen
    for i in range(1, depth + 1):
        step = frontier.join(edges, frontier["id"] == edges["source"]).select(F.col("target").alias("id")).distinct()
        frontier = step.join(seen, "id", "left_anti").withColumn("depth", F.lit(i).cast("long"))
        seen = seen.unionByName(frontier)
    return seen


def expanded_edges(reached: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """The edges that leave nodes that a search of that depth expanded."""
    return edges.join(reached.filter(F.col("depth") < depth).select(F.col("id").alias("source")), "source", "left_semi")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return valid_edges(edges, ids)


def boost(out_degree):
    return F.least(0.05 * out_degree, F.lit(0.2))


def hybrid(hits: DataFrame, nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """hits: query_id, vec_id, similarity of 2k documents; reranked by similarity plus a boost for outgoing edges."""
    from pyspark.sql import Window as W

    out = edges.groupBy("source").agg(F.count("*").alias("n"))
    j = hits.withColumn("source", F.concat(F.lit("d:"), F.col("vec_id").cast("string"))).join(out, "source", "left").na.fill(0, ["n"])
    j = j.withColumn("score", F.col("similarity") + boost(F.col("n")))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return j.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def search_entities(embedded: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, vec_id, similarity, rank: of embedded entities (vec_id, embedding) those of greatest product with each query."""
    from .knn import knn

    return knn(queries, embedded, k, "dot").select("query_id", "vec_id", (-F.col("distance")).alias("similarity"), "rank")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, n: every kind, those without nodes too, and EDGE."""
    kinds = nodes.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    n = kinds.join(nodes.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").na.fill(0, ["n"])
    return n.unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("EDGE").alias("kind"), "n"))


def mentions(found: DataFrame, doc_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extracted entities (doc_col, entity, score, n) of a score of 0.3 or more."""
    kept = found.filter(F.col("score") >= 0.3)
    nodes = documents(kept.select(doc_col).distinct(), doc_col, doc_col).unionByName(entities(kept, "entity"))
    edges = kept.select(F.concat(F.lit("d:"), F.col(doc_col).cast("string")).alias("source"), F.concat(F.lit("e:"), F.lower("entity")).alias("target"), F.lit("MENTIONS").alias("relation"), (F.col("score") * F.col("n")).alias("weight"))
    return nodes, edges
