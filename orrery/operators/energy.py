"""The energy landscape of splats (mu, alpha, kappa): energies, gradients, gaps, and self-organised criticality."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.vectors import doubles, l2
from .knn import cut

POINTS, SPLATS, WALK = 4096, 512, 1000
FLOOR, HIGH, ALONE = 1e-10, 10.0, 1.0


def energy_of(total: Column) -> Column:
    """-ln of the sum of alpha exp(-kappa d^2), and 10 below the floor."""
    return F.when(total.isNull() | (total < FLOOR), F.lit(HIGH)).otherwise(-F.log(total))


def blocks(points: DataFrame, splats: DataFrame) -> DataFrame:
    """Pairs of blocks: p_ids (of whatever type) and p of points (id, x), and mu, alpha and kappa of splats, all packed. A
    block has a MB at most and one of splats 512 rows, so that no matrix of a pair grows with the tables. Splats are shuffled
    into as few parts as they fill, since points are read and packed once for each."""
    import pyarrow as pa

    small_batches(points.sparkSession)

    def pack_points(batches):
        for b in batches:
            for part in cut(b, POINTS):
                ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part["id"])
                yield pa.RecordBatch.from_arrays([ids, pa.array([part["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()], pa.binary())], ["p_ids", "p"])

    def pack(batches):
        for whole in batches:
            for b in (whole.slice(a, SPLATS) for a in range(0, len(whole), SPLATS)):
                yield pa.RecordBatch.from_arrays([pa.array([b[c].flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes() if c == "mu" else b[c].to_numpy(zero_copy_only=False).astype(np.float64).tobytes()], pa.binary()) for c in ("mu", "alpha", "kappa")], ["mu", "alpha", "kappa"])

    some = points.select("id", doubles(F.col("x")).alias("v")).filter("id is not null and size(v) > 0")
    p = some.mapInArrow(pack_points, f"p_ids array<{points.schema['id'].dataType.simpleString()}>, p binary")
    s = splats.select(doubles(F.col("mu")).alias("mu"), F.col("alpha").cast("double"), F.col("kappa").cast("double")).repartition("alpha", "kappa").mapInArrow(pack, "mu binary, alpha binary, kappa binary")
    return p.crossJoin(s)


def unpacked(b):
    """Of each pair of a batch: ids, points, means, kappas, and alpha exp(-kappa d^2) of point and splat."""
    for r in range(len(b)):
        ids, (x, mu, alpha, kappa) = b["p_ids"][r], (b[c][r].as_buffer() for c in ("p", "mu", "alpha", "kappa"))
        ids, a, kp = ids.values, np.frombuffer(alpha, np.float64), np.frombuffer(kappa, np.float64)
        x, m = np.frombuffer(x, np.float64).reshape(len(ids), -1), np.frombuffer(mu, np.float64).reshape(len(a), -1)
        d2 = np.maximum((x * x).sum(1)[:, None] + (m * m).sum(1)[None] - 2 * x @ m.T, 0)
        yield ids, x, m, kp, a * np.exp(-kp * d2)


def energies(points: DataFrame, splats: DataFrame) -> DataFrame:
    """id, energy. Points (id, x) and splats (mu, alpha, kappa) meet in blocks; sums of blocks are added up."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for ids, *_, w in unpacked(b):
                yield pa.RecordBatch.from_arrays([ids, pa.array(w.sum(1))], ["id", "total"])

    kind = points.schema["id"].dataType.simpleString()
    sums = blocks(points, splats).mapInArrow(run, f"id {kind}, total double").groupBy("id").agg(F.sum("total").alias("total"))
    alone = splats.limit(1).agg(F.count("*").alias("some"))
    out = points.select("id").distinct().join(sums, "id", "left").crossJoin(alone)
    return out.select("id", F.when(F.col("some") == 0, F.lit(ALONE)).otherwise(energy_of(F.col("total"))).alias("energy"))


def zone(e: Column) -> Column:
    return F.when(e < 0.3, "high_confidence").when(e < 0.7, "moderate").otherwise("uncertain")


def confidence(e: Column) -> Column:
    return F.when(e != -1, 1 / (1 + e))


def with_confidence(rows: DataFrame) -> DataFrame:
    return rows.withColumn("confidence", confidence(F.col("energy"))).withColumn("zone", zone(F.col("energy")))


def gradient(points: DataFrame, splats: DataFrame) -> DataFrame:
    """id, pos (from 0), value: of the energy at each point; not divided where the sum is at the floor.

    Of the weights w, the sum of 2 kappa w (x - mu) over a block of splats is a row sum less a matrix product."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for ids, x, m, kp, w in unpacked(b):
                wk = 2 * w * kp
                num = wk.sum(1)[:, None] * x - wk @ m
                dim = x.shape[1]
                rows = pa.array(np.repeat(np.arange(len(ids)), dim))
                yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(np.tile(np.arange(dim), len(ids))), pa.array(num.ravel()), pa.array(np.repeat(w.sum(1), dim))], ["id", "pos", "num", "den"])

    kind = points.schema["id"].dataType.simpleString()
    s = blocks(points, splats).mapInArrow(run, f"id {kind}, pos long, num double, den double").groupBy("id", "pos").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return s.select("id", "pos", F.when(F.col("den") > FLOOR, F.col("num") / F.col("den")).otherwise(F.col("num")).alias("value"))


def grid(spark, resolution: int, reach: float, dim: int) -> DataFrame:
    """id, gx, gy, x: a square grid in the first two dimensions, zero in the others."""
    step = 2 * reach / (resolution - 1)
    g = spark.range(resolution * resolution).select("id", (F.floor(F.col("id") / resolution) * step - reach).alias("gx"), (F.col("id") % resolution * step - reach).alias("gy"))
    return g.withColumn("x", F.concat(F.array("gx", "gy"), F.array_repeat(F.lit(0.0), dim - 2)))


def free_energy(splats: DataFrame) -> DataFrame:
    """One row: -ln of the sum of alpha, infinite without any."""
    s = splats.agg(F.sum("alpha").alias("s"))
    return s.select(F.when(F.col("s") > 0, -F.log("s")).otherwise(F.lit(float("inf"))).alias("free_energy"))


def composite(rows: DataFrame, w_splat=1.0, w_geom=0.1, w_comp=0.0, temperature=0.0, entropy=0.5) -> DataFrame:
    """Weighted energy terms less temperature times entropy; the geometric and compositional terms are 0."""
    return rows.withColumn("composite", w_splat * F.col("energy") + F.lit(w_geom * 0.0 + w_comp * 0.0 - temperature * entropy))


def langevin(points: DataFrame, splats: DataFrame, steps: int = 200, dt: float = 1e-3, friction: float = 0.1, temperature: float = 1.0, seed: int = 42) -> DataFrame:
    """id, x: overdamped dynamics along the energy's gradient with seeded noise, a point a row.

    Splats are the memory of this sampler, so each task holds them: at most 100,000, else it raises."""
    n = splats.count()
    if n > 100_000:
        raise ValueError("sample from a summary of the splats: there are more than 100,000")
    rows = splats.select(doubles(F.col("mu")).alias("mu"), "alpha", "kappa").collect()
    mu, a, k = np.array([r.mu for r in rows]), np.array([r.alpha for r in rows], float), np.array([r.kappa for r in rows], float)

    def run(batches):
        for pdf in batches:
            out = []
            for i, x in zip(pdf["id"], pdf["x"], strict=True):
                rng, x = np.random.default_rng([seed, int(i)]), np.asarray(x, float).copy()
                for _ in range(steps):
                    g = np.zeros_like(x)
                    if len(mu):
                        d = x - mu
                        w = a * np.exp(-k * (d * d).sum(1))
                        g = (2 * (k * w)[:, None] * d).sum(0) / max(w.sum(), FLOOR)
                    x += -g * dt / friction + np.sqrt(2 * temperature * dt / friction) * rng.normal(size=len(x))
                out.append(x)
            yield pd.DataFrame({"id": pdf["id"], "x": out})

    return points.select("id", doubles(F.col("x")).alias("x")).mapInPandas(run, "id long, x array<double>")


# exploration


def sample_points(spark, n: int, center: list[float], sigma: float, seed: int = 42) -> DataFrame:
    """id, x: seeded Gaussian points around a center."""
    return spark.range(n).select("id", F.array(*[F.randn(seed + i) * sigma + c for i, c in enumerate(center)]).alias("x"))


def regions(points: DataFrame, min_energy: float, n_regions: int, radius: float = 0.5) -> DataFrame:
    """region, center, energy, n_points: of points (id, x, energy) from min_energy up, grouped greedily by falling energy.

    A round takes the 1,000 highest free points of all and finds the regions that start among them; a point belongs to the
    first region whose highest point lies within the radius. A round has one such at least. Rounds run when this is called."""
    small_batches(points.sparkSession)
    high = points.filter(F.col("energy") >= min_energy).select("id", doubles(F.col("x")).alias("x"), F.col("energy").cast("double").alias("energy")).persist()
    tops: list[tuple[int, np.ndarray]] = []

    def within(ids: np.ndarray, m: np.ndarray, i: int, x: np.ndarray) -> np.ndarray:
        return (np.linalg.norm(m - x, axis=1) < radius) | (ids == i)

    def owned() -> DataFrame:
        @F.pandas_udf("int")
        def owner(ids: pd.Series, xs: pd.Series) -> pd.Series:
            out = np.full(len(ids), -1, np.int32)
            if len(ids):
                m = np.stack(xs.to_numpy())
                for j, (i, x) in enumerate(tops):
                    out[(out < 0) & within(ids.to_numpy(), m, i, x)] = j
            return pd.Series(out)

        return high.withColumn("region", owner("id", "x"))

    while len(tops) < n_regions:
        free = owned().filter("region < 0") if tops else high
        rows = free.select("id", "x", "energy").orderBy(F.desc("energy"), "id").limit(WALK).collect()
        if not rows:
            break
        ids, m = np.array([r.id for r in rows]), np.array([r.x for r in rows])
        left = np.ones(len(rows), bool)
        while len(tops) < n_regions and left.any():
            i = int(left.argmax())
            tops.append((rows[i].id, m[i]))
            left &= ~within(ids, m, *tops[-1])
            left[i] = False
    dim = len(tops[0][1]) if tops else 0
    center = F.array(*[F.avg(F.col("x")[i]) for i in range(dim)]).cast("array<double>")
    rows = owned().filter("region >= 0").groupBy("region").agg(center.alias("center"), F.max("energy").alias("energy"), F.count("*").alias("n_points")).orderBy("region").collect()
    high.unpersist()
    return points.sparkSession.createDataFrame(rows, "region long, center array<double>, energy double, n_points long")


def gaps(points: DataFrame, n_gaps: int = 5, radius: float = 0.5) -> DataFrame:
    """The regions of highest energy between what splats cover: those from energy 0.5 up."""
    return regions(points, 0.5, n_gaps, radius)


def suggestions(points: DataFrame, n: int = 3, min_energy: float = 0.7, radius: float = 0.5, near: int = 5) -> DataFrame:
    """region, center, energy, n_points, nearby (ids of the points next to the center), description, queries and
    potential_value of the n regions of highest energy."""
    from .knn import knn

    r = regions(points, min_energy, 2 * n, radius).orderBy(F.desc("energy"), "region").limit(n)
    hits = knn(r.select(F.col("region").alias("query_id"), F.col("center").alias("embedding")), points.select(F.col("id").alias("vec_id"), F.col("x").alias("embedding")), near)
    ids = hits.groupBy(F.col("query_id").alias("region")).agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("l")).select("region", F.col("l.vec_id").alias("nearby"))
    e, first = F.format_number("energy", 3), F.array_join(F.slice(F.col("nearby").cast("array<string>"), 1, 3), ", ")
    text = F.concat(F.lit("A region of high uncertainty (energy "), e, F.lit(") with "), F.col("n_points").cast("string"), F.lit(" points, next to "), first, F.lit("."))
    queries = F.array(F.concat(F.lit("explore near "), F.col("nearby")[0].cast("string")), F.concat(F.lit("find what complements energy "), F.format_number("energy", 2)))
    return r.join(ids, "region").select("region", "center", "energy", "n_points", "nearby", text.alias("description"), queries.alias("queries"), F.col("energy").alias("potential_value"))


def boltzmann(points: DataFrame, temperature: float) -> DataFrame:
    """Points with their chance, proportional to exp(energy / temperature)."""
    top = points.agg(F.max("energy").alias("top"))
    w = points.crossJoin(top).withColumn("w", F.exp((F.col("energy") - F.col("top")) / temperature)).drop("top")
    return w.crossJoin(w.agg(F.sum("w").alias("z"))).withColumn("p", F.col("w") / F.col("z")).drop("w", "z")


def boltzmann_sample(points: DataFrame, temperature: float, k: int, seed: int = 42) -> DataFrame:
    """k points without replacement by those chances: the k least of exponential times over chances."""
    return boltzmann(points, temperature).withColumn("t", -F.log(F.rand(seed)) / F.col("p")).orderBy("t", "id").limit(k).drop("t")


# self-organised criticality


def criticality(splats: DataFrame, by: str = "cluster_id") -> DataFrame:
    """index, state and the variances of cluster energies and sizes; splats have energy and a cluster."""
    c = splats.groupBy(by).agg(F.avg("energy").alias("e"), F.count("*").alias("n"))
    v = c.agg(F.var_pop("e").alias("energy_variance"), F.var_pop("n").alias("size_variance"), F.count("*").alias("n_clusters"))
    i = 0.6 * F.col("energy_variance") / (F.col("energy_variance") + 1) + 0.4 * F.col("size_variance") / (F.col("size_variance") + 1)
    v = v.withColumn("criticality_index", i)
    i = F.col("criticality_index")
    return v.withColumn("state", F.when(i < 0.3, "subcritical").when(i < 0.7, "critical").otherwise("supercritical"))


def soc_statistics(splats: DataFrame, by: str = "cluster_id", avalanches: tuple[int, ...] = ()) -> DataFrame:
    """One row: criticality, the mean energy of clusters, whether relaxing or watching is called for, and the avalanches so
    far (how many clusters each has hit)."""
    c = splats.groupBy(by).agg(F.avg("energy").alias("e")).agg(F.coalesce(F.avg("e"), F.lit(0.0)).alias("equilibrium_state"))
    r = criticality(splats, by).crossJoin(c)
    flags = [(F.col("state") == "supercritical").alias("needs_relaxation"), F.col("state").isin("critical", "supercritical").alias("needs_monitoring")]
    past = [F.lit(len(avalanches)).cast("long").alias("n_avalanches"), F.lit(avalanches[-1] if avalanches else 0).cast("long").alias("last_avalanche_clusters")]
    return r.select("state", "criticality_index", "n_clusters", "equilibrium_state", *flags, *past)


def consolidate(splats: DataFrame, threshold: float = 0.8) -> DataFrame:
    return splats.filter(F.col("alpha") >= threshold)


def relax(splats: DataFrame, steps: int = 1) -> DataFrame:
    """Alphas drift up a little and are scaled to sum 1, kappas grow by a hundredth within [0.1, 100]."""
    for _ in range(steps):
        s = splats.withColumn("alpha", F.col("alpha") * (1 + 0.05 * F.exp(-0.1 * F.col("kappa"))))
        total = s.agg(F.sum("alpha").alias("total"))
        splats = s.crossJoin(total).withColumn("alpha", F.col("alpha") / F.col("total")).drop("total").withColumn("kappa", F.greatest(F.lit(0.1), F.least(F.lit(100.0), F.col("kappa") * 1.01)))
    return splats


def neighbours_within(splats: DataFrame, radius: float = 2.0, most: int = 10, of: DataFrame | None = None) -> DataFrame:
    """splat_id, neighbour_id, distance, rank: of each splat (or of those in `of`) the nearest others within a radius."""
    from .knn import knn

    asked = splats if of is None else of
    near = knn(asked.select(F.col("splat_id").alias("query_id"), F.col("mu").alias("embedding")), splats.select(F.col("splat_id").alias("vec_id"), F.col("mu").alias("embedding")), most, keep_self=False)
    return near.filter(F.col("distance") <= radius).select(F.col("query_id").alias("splat_id"), F.col("vec_id").alias("neighbour_id"), "distance", "rank")


def avalanche(splats: DataFrame, edges: DataFrame | Callable[[list], DataFrame], seed_id: int | None = None, threshold: float = 0.8, release: float = 0.3, rest: float = 0.7, most: int = 1000) -> DataFrame:
    """splat_id, energy, alpha, hit. The cascade is first in, first out and each splat topples once, `most` at most. edges: a
    table of near neighbours, or what gives it for a list of splats.

    The queue runs in the driver, over the splats that it reaches: when it comes to one whose neighbours it hasn't, it asks
    for those of all that wait, so there is a search for each generation, and none for splats that never topple."""
    splats = splats.select("splat_id", F.col("energy").cast("double").alias("energy"), F.col("alpha").cast("double").alias("alpha"))
    held = splats.persist()
    e: dict = {}
    links: dict = {}

    def learn(ids: list) -> None:
        new = [i for i in ids if i not in e]
        e.update((r.splat_id, r.energy) for r in held.filter(F.col("splat_id").isin(new)).select("splat_id", "energy").collect())

    def ask(ids: list) -> None:
        rows = (edges(ids) if callable(edges) else edges.filter(F.col("splat_id").isin(ids))).select("splat_id", "rank", "neighbour_id").collect()
        links.update((i, []) for i in ids)
        for r in sorted(rows):
            links[r.splat_id].append(r.neighbour_id)
        learn([r.neighbour_id for r in rows])

    if seed_id is None and (first := held.orderBy(F.desc("energy"), "splat_id").first()):
        seed_id = first.splat_id
    queue, seen, hit, at = [] if seed_id is None else [seed_id], set(), [], 0
    learn(queue)
    while at < len(queue) and len(hit) < most:
        i = queue[at]
        at += 1
        if i in seen:
            continue
        seen.add(i)
        if e[i] > threshold:
            if i not in links:
                waiting = dict.fromkeys([i, *(j for j in queue[at:] if j not in seen and j not in links)])
                ask(list(waiting)[: most - len(hit)])
            own = links[i]
            share = e[i] * release / len(own) if own else 0.0
            for j in own:
                e[j] += share
                if e[j] > threshold and j not in seen:
                    queue.append(j)
            e[i] *= rest
            hit.append(i)
    held.unpersist()
    hits = set(hit)
    known = splats.sparkSession.createDataFrame([(i, float(x), i in hits) for i, x in e.items()], "id long, now double, toppled boolean")
    x = splats.join(F.broadcast(known), F.col("splat_id") == F.col("id"), "left")  # eleven rows for each of `most` at most
    toppled = F.coalesce("toppled", F.lit(False))
    return x.select("splat_id", F.coalesce("now", "energy").alias("energy"), F.when(toppled, F.col("alpha") * 0.7).otherwise(F.col("alpha")).alias("alpha"), toppled.alias("hit"))


def nearest_distance(points: DataFrame, splats: DataFrame) -> DataFrame:
    d = points.crossJoin(splats.select("splat_id", "mu")).withColumn("distance", l2(F.col("x"), F.col("mu")))
    w = W.partitionBy("id").orderBy("distance", "splat_id")
    return d.withColumn("r", F.row_number().over(w)).filter("r = 1").select("id", "splat_id", "distance")
