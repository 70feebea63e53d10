"""Vectors summed up as splats: a centroid, weight and concentration for each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import kappa_of, l2
from .ivf import centroids_of


def splats_of(assigned: DataFrame, by: str, total: int) -> DataFrame:
    """by, mu, alpha (share of the total), kappa, n_vectors, mean_distance of each cluster of (vec_id, embedding, by)."""
    mu = centroids_of(assigned, by).withColumnRenamed("centroid", "mu")
    d = assigned.join(mu, by).withColumn("d", l2(F.col("embedding"), F.col("mu")))
    s = d.groupBy(by).agg(F.count("*").alias("n_vectors"), F.avg("d").alias("mean_distance"), F.var_pop("d").alias("v"))
    out = s.join(mu, by)
    return out.select(by, "mu", (F.col("n_vectors") / total).alias("alpha"), kappa_of(F.col("mean_distance"), F.col("v")).alias("kappa"), "n_vectors", "mean_distance")


def access(splats: DataFrame, hits: DataFrame, by: str) -> DataFrame:
    """by, access: of how often a splat is nearest to a query (hits: by, n), its size and its kappa; sums to 1."""
    j = splats.join(hits, by, "left").na.fill(0, ["n"])
    top = j.agg(*[F.max(c).alias(f"top_{c}") for c in ("n", "n_vectors", "kappa")])
    share = lambda c: F.when(F.col(f"top_{c}") > 0, F.col(c) / F.col(f"top_{c}")).otherwise(0.0)
    a = j.crossJoin(top).withColumn("a", 0.4 * share("n") + 0.3 * share("n_vectors") + 0.3 * share("kappa"))
    return a.crossJoin(a.agg(F.sum("a").alias("z"))).select(by, (F.col("a") / F.col("z")).alias("access"))


def tiers(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, tier: the upper fifth hot, up to the half warm, the rest cold. Rows are splats, of which there are few."""
    w = W.orderBy(F.desc(value), by)
    r = rows.withColumn("r", F.row_number().over(w)).crossJoin(rows.agg(F.count("*").alias("n")))
    return r.select(by, F.when(F.col("r") <= F.floor(F.col("n") * 0.2), "hot").when(F.col("r") <= F.floor(F.col("n") * 0.5), "warm").otherwise("cold").alias("tier"))


def ingested(vectors: DataFrame, n_active: int, most: int, alpha: float = 1.0, kappa: float = 10.0) -> DataFrame:
    """vec_id, mu (of length 1), alpha, kappa, frequency of new splats; more than there is room for are refused."""
    from ..functions.vectors import normalize

    n = vectors.count()
    if n_active + n > most:
        raise ValueError(f"{n_active} splats and {n} more are over the {most} that there is room for")
    return vectors.select("vec_id", normalize(F.col("embedding")).alias("mu"), F.lit(alpha).alias("alpha"), F.lit(kappa).alias("kappa"), F.lit(1.0).alias("frequency"))


def statistics(splats: DataFrame, most: int) -> DataFrame:
    """One row: how many splats there are and may be, their mean frequency, kappa and alpha, and the entropy, which is fixed."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("frequency", "kappa", "alpha")]
    return splats.agg(F.count("*").alias("n_active_splats"), F.lit(most).cast("long").alias("max_splats"), *means, F.lit(0.5).alias("entropy"))


def retrieve(queries: DataFrame, splats: DataFrame, k: int = 64) -> DataFrame:
    """query_id, splat_id, distance, rank, mu, alpha, kappa: the splats nearest to each query, which is scaled to length 1."""
    from ..functions.vectors import normalize
    from .knn import knn

    q = queries.select("query_id", normalize(F.col("embedding")).alias("embedding"))
    hits = knn(q, splats.select(F.col("splat_id").alias("vec_id"), F.col("mu").alias("embedding")), k).withColumnRenamed("vec_id", "splat_id")
    return hits.join(splats.select("splat_id", "mu", "alpha", "kappa"), "splat_id")


def compression(splats: DataFrame, total: int, dim: int) -> DataFrame:
    """One row of sizes: vectors of 4-byte floats against splats with their member lists."""
    s = splats.agg(F.count("*").alias("splat_count"), F.sum(F.lit(4 * dim + 16) + 4 * F.col("n_vectors")).alias("compressed_bytes"))
    s = s.withColumn("original_bytes", F.lit(4 * dim * total).cast("long"))
    return s.select("splat_count", "original_bytes", "compressed_bytes", (F.lit(float(total)) / F.col("splat_count")).alias("compression_ratio"), ((1 - F.col("compressed_bytes") / F.col("original_bytes")) * 100).alias("savings_pct"))
