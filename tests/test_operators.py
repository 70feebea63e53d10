"""Worked examples and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import encode, filters
from orrery.functions import vectors as v
from orrery.operators import collection, control, dataset, energy, graph, ivf, knn, lsh, shard, text
from orrery.sources import splat_format
from orrery.streaming import oplog

METRICS = "node_id string, ts long, seq long, cpu double, memory double, latency_ms double, qps double, active long"


def one(df):
    (r,) = df.collect()
    return r


def vectors(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def crud(spark):
    """Ten documents of alternate categories and rising years."""
    rng = np.random.default_rng(42)
    rows = [(f"doc_{i}", rng.normal(size=64).tolist(), f'{{"category": "{"science" if i % 2 else "tech"}", "year": {2020 + i}}}', f"Document {i} content") for i in range(10)]
    return collection.add(collection.empty(spark), spark.createDataFrame(rows, "id string, vector array<float>, metadata string, document string"), 1)


def test_crud(spark, crud):
    assert crud.count() == 10
    gone = collection.delete_where(crud, filters.on_json({"year": {"$gt": 2025}}))
    assert tuple(one(collection.stats(gone))) == (10, 6, 4)
    assert collection.ids(gone).count() == 6 and collection.ids(gone, True).count() == 10
    assert collection.get(gone, "doc_9").count() == 0 and one(collection.get(gone, "doc_0")).document == "Document 0 content"
    assert collection.delete(crud, spark.createDataFrame([("doc_1",)], "id string"), hard=True).count() == 9
    changes = spark.createDataFrame([("doc_9", "back"), ("new", "fresh"), ("doc_0", "changed")], "id string, document string")
    plain = {r.id: r for r in collection.update(gone, changes, 2).collect()}
    assert len(plain) == 10 and plain["doc_9"].deleted and plain["doc_9"].document == "Document 9 content" and plain["doc_0"].document == "changed"
    up = {r.id: r for r in collection.update(gone, changes, 2, upsert=True).collect()}
    assert len(up) == 11 and not up["doc_9"].deleted and up["doc_9"].document == "back" and up["new"].metadata == "{}"
    assert {r.id: r.status for r in collection.update_status(gone, changes).collect()} == {"doc_9": "is deleted", "new": "not found", "doc_0": "updated"}


def test_ids_are_made_up(spark):
    rows = spark.createDataFrame([([1.0],), ([2.0],)], "vector array<float>")
    assert collection.add(collection.empty(spark), rows, 1).select("id").distinct().count() == 2


def test_filters(spark, crud):
    n = lambda w: crud.filter(filters.on_json(w)).count()
    assert n({"category": "tech"}) == 5 and n({"year": {"$gte": 2021, "$lt": 2023}}) == 2 and n({}) == 10
    assert n({"missing": {"$ne": 1}}) == 0 and n({"category": {"$ne": "tech"}, "year": {"$lte": 2021}}) == 1
    with pytest.raises(ValueError):
        filters.on_json({"a": {"$in": [1]}})


def test_log(spark, tmp_path):
    rows = [(1, "add", "a", "x"), (2, "add", "b", "y"), (3, "update", "a", "z"), (4, "delete", "b", None), (5, "add", "b", "w"), (6, "delete", "a", None)]
    log = spark.createDataFrame(rows, "lsn long, op string, id string, document string").withColumn("vector", F.array(F.lit(1.0))).withColumn("metadata", F.lit(None).cast("string"))
    got = {r.id: (r.document, r.deleted, r.version) for r in collection.replay(log).collect()}
    assert got == {"a": ("z", True, 6), "b": ("w", False, 5)}
    assert {r.id: r.deleted for r in collection.replay(log, 4).collect()} == {"a": False, "b": True}
    assert [r.lsn for r in collection.truncate(log, 5).collect()] == [5, 6]
    assert collection.replay(collection.checkpoint_row(log)).count() == 2
    path = collection.backup(log, f"file://{tmp_path}", "1")
    assert collection.restore(spark, path).count() == 6
    # the same log as a stream of files, and again
    for i, part in enumerate((log.filter("lsn <= 3"), log.filter("lsn > 3"))):
        part.coalesce(1).write.json(f"{tmp_path}/in/{i}")
        oplog.follow(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    now = oplog.current(spark, f"{tmp_path}/out")
    assert {r.id: (r.document, r.deleted, r.version) for r in now.collect()} == got
    assert {tuple(map(str, r)) for r in oplog.merged(now, log).collect()} == {tuple(map(str, r)) for r in now.collect()}


def test_catalog(spark):
    c = collection.Catalog(spark)
    c.create("x", 3)
    with pytest.raises(ValueError):
        c.create("x", 3)
    assert c.list() == ["x"] and c.get("x").count() == 0
    c.delete("x")
    with pytest.raises(KeyError):
        c.get("x")


def test_knn_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 37)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[5] = x[4]
    df = vectors(spark, x).repartition(4)
    x = x.astype(np.float32).astype(float)
    got = knn.knn(df.withColumnRenamed("vec_id", "query_id"), df, 7, keep_self=False).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(300):
        order = sorted((d[i, j], j) for j in range(300) if j != i)[:7]
        own = sorted((r["rank"], r.vec_id) for r in got if r.query_id == i)
        assert [j for _, j in own] == [j for _, j in order]
    assert knn.knn(df.limit(0).withColumnRenamed("vec_id", "query_id"), df, 3).count() == 0
    nulls = df.unionByName(spark.createDataFrame([(None, [1.0] * 8), (999, None)], df.schema))
    assert knn.knn(nulls.withColumnRenamed("vec_id", "query_id"), nulls, 1).count() == 300


def test_probing_all_clusters_is_exact(spark):
    df = vectors(spark, np.random.default_rng(1).normal(size=(400, 8)))
    index = ivf.build(df, 8, 4)
    q = df.withColumnRenamed("vec_id", "query_id")
    c = ivf.centroids_of(index, "coarse_id")
    found = ivf.lod2(ivf.probe(q, c, 8), index, 5)
    truth = knn.knn(q, df, 5)
    assert one(knn.recall(found, truth, 5)).recall == 1.0
    few = one(knn.recall(ivf.lod2(ivf.probe(q, c, 2), index, 5), truth, 5)).recall
    assert 0.2 < few < 1
    fine = ivf.centroids_of(index, "coarse_id", "fine_id")
    assert ivf.lod1(ivf.probe(q, c, 2), index, fine, 5).count() > 0 and ivf.lod0(ivf.probe(q, c, 2), index, 5).count() == 2000


def test_lsh(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:50] + 0.001 * rng.normal(size=(50, 64))
    found = lsh.query(vectors(spark, q).withColumnRenamed("vec_id", "query_id"), vectors(spark, x), lsh.CrossPolytope(64, 10, 18), 1, 30, 600)
    assert sum(r.query_id == r.vec_id for r in found.collect()) >= 48
    assert lsh.CrossPolytope(64, 1, 18).k == 3 and lsh.CrossPolytope(640, 1, 18).k == 2


def test_index_choice(spark):
    rng = np.random.default_rng(1)
    assert ivf.choose_index(vectors(spark, rng.normal(size=(300, 32)))) == "lsh"
    mu = rng.normal(size=(17, 32)) * 20
    assert ivf.choose_index(vectors(spark, mu[np.arange(300) % 17] + rng.normal(size=(300, 32)) * 0.1)) == "ivf"
    assert ivf.sizes_for(100_000) == (31, 3225)


def test_energy(spark):
    splat = spark.createDataFrame([([0.0, 0.0], 1.0, 10.0)], "mu array<double>, alpha double, kappa double")
    points = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])], "id long, x array<double>")
    assert [round(r.energy, 6) for r in energy.energies(points, splat).orderBy("id").collect()] == [0, 10, 10]
    assert {r.energy for r in energy.energies(points, splat.limit(0)).collect()} == {1.0}
    z = spark.createDataFrame([(0.29,), (0.3,), (0.69,), (0.7,)], "energy double")
    assert [r.zone for r in energy.with_confidence(z).collect()] == ["high_confidence", "moderate", "moderate", "uncertain"]
    assert round(one(energy.free_energy(splat.union(splat))).free_energy, 6) == -0.693147
    assert math.isinf(one(energy.free_energy(splat.limit(0))).free_energy)
    g = {(r.id, r.pos): r.value for r in energy.gradient(points, splat).collect()}
    assert g[0, 0] == 0 and abs(g[1, 0] - 20) < 1e-9
    c = spark.createDataFrame([(0, 0.0), (1, 2.0)], "cluster_id long, energy double")
    r = one(energy.criticality(c))
    assert abs(r.criticality_index - 0.3) < 1e-12 and r.state == "critical"
    s = spark.createDataFrame([(0, 1.0, 10.0), (1, 3.0, 10.0)], "splat_id long, alpha double, kappa double")
    assert [(round(x.alpha, 6), round(x.kappa, 6)) for x in energy.relax(s).orderBy("splat_id").collect()] == [(0.25, 10.1), (0.75, 10.1)]
    assert energy.consolidate(s, 2).count() == 1


def test_avalanche(spark):
    s = spark.createDataFrame([(0, 1.0, 1.0, [0.0]), (1, 0.6, 1.0, [1.0]), (2, 0.6, 1.0, [0.5])], "splat_id long, energy double, alpha double, mu array<double>")
    got = {r.splat_id: (round(r.energy, 6), r.alpha, r.hit) for r in energy.avalanche(s, energy.neighbours_within(s)).collect()}
    assert got == {0: (0.7, 0.7, True), 1: (0.75, 1.0, False), 2: (0.75, 1.0, False)}


def test_exploration(spark):
    rows = [(i, [float(i // 5), 0.01 * i], 0.4 + 0.1 * (i % 5)) for i in range(15)]
    p = spark.createDataFrame(rows, "id long, x array<double>, energy double")
    got = energy.regions(p, 0.5, 10, 0.5).collect()
    assert [r.n_points for r in got] == [4, 4, 4] and all(abs(r.energy - 0.8) < 1e-9 for r in got)
    assert abs(sum(r.p for r in energy.boltzmann(p, 0.5).collect()) - 1) < 1e-9
    assert energy.boltzmann_sample(p, 0.5, 5).distinct().count() == 5
    splat = spark.createDataFrame([([0.0, 0.0], 1.0, 1.0)], "mu array<double>, alpha double, kappa double")
    far = energy.langevin(p.select("id", "x"), splat, steps=200, dt=0.01, temperature=0.0)
    assert all(np.linalg.norm(r.x) < np.linalg.norm(rows[r.id][1]) + 1e-9 for r in far.collect())
    assert energy.grid(spark, 3, 1.0, 4).count() == 9 and energy.sample_points(spark, 5, [0.0, 1.0], 2.0).count() == 5


def test_regions_hold_all_points(spark):
    # 10,500 points about 0 and 20 lower ones about 5
    x = F.when(F.col("id") < 10_500, F.col("id") / 100_000).otherwise(5 + (F.col("id") - 10_500) / 1000)
    p = spark.range(10_520).select("id", F.array(x).alias("x"), (2 - F.col("id") / 10_520).alias("energy"))
    got = energy.regions(p, 0.5, 3, 0.5).orderBy("region").collect()
    assert [(r.region, r.n_points, r.energy) for r in got] == [(0, 10_500, 2.0), (1, 20, 2 - 10_500 / 10_520)]
    assert np.allclose([r.center[0] for r in got], [np.arange(10_500).mean() / 100_000, 5 + 0.0095])
    assert energy.regions(p, 3.0, 3, 0.5).count() == 0


def test_merges(spark):
    lists = spark.createDataFrame([(0, "edge-0", 100, 0.1), (0, "edge-0", 101, 0.5), (0, "edge-1", 101, 0.2), (0, "edge-1", 102, 0.3)], "query_id long, shard string, vec_id long, distance double")
    got = [(r.vec_id, round(r.score, 9), r.distance) for r in shard.merge(lists, 3).orderBy("rank").collect()]
    assert got == [(101, round(1 / 62 + 1 / 61, 9), 0.2), (100, round(1 / 61, 9), 0.1), (102, round(1 / 62, 9), 0.3)]
    assert [(r.vec_id, r.distance) for r in shard.merge(lists, 2, "score").orderBy("rank").collect()] == [(100, 0.1), (101, 0.2)]
    with pytest.raises(ValueError):
        shard.merge(lists, 2, "other")


def test_shards_and_routes(spark):
    c = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 10.0])], "idx long, centroid array<double>")
    p = vectors(spark, [[1, 1], [9, 9]])
    assert [r.shard for r in shard.by_centroid(p, c, 2).orderBy("vec_id").collect()] == ["edge-0", "edge-1"]
    import hashlib

    ids = spark.createDataFrame([(str(i),) for i in range(50)], "id string")
    assert all(r.s == f"edge-{int(hashlib.md5(r.id.encode()).hexdigest(), 16) % 7}" for r in ids.select("id", shard.by_hash(F.col("id"), 7).alias("s")).collect())
    n = spark.createDataFrame([("edge-1", 10, 50.0), ("edge-2", 2, 20.0), ("edge-3", 5, 30.0)], "node_id string, active_queries long, latency_ms double")
    assert [(r.node_id, r.load) for r in shard.least_loaded(n).orderBy("rank").collect()] == [("edge-2", 220), ("edge-3", 530), ("edge-1", 1050)]
    q = spark.createDataFrame([(i,) for i in range(5)], "query_id long")
    assert [r.node_id for r in shard.round_robin(q, n).orderBy("query_id").collect()] == [f"edge-{i}" for i in (1, 2, 3, 1, 2)]
    assert shard.broadcast_all(q, n).count() == 15
    e = n.withColumn("last_energy", F.col("active_queries") / 10).withColumn("weight", F.lit(1.0))
    assert abs(sum(r.p for r in shard.energy_chances(e).collect()) - 1) < 1e-12 and shard.energy_draw(e).count() == 1


def test_scaling(spark):
    rows = [("n", t, t, 5.0 * t, 10.0, 1.0, 2.0, 1) for t in range(20)]
    m = spark.createDataFrame(rows, METRICS)
    assert one(control.trends(m, "cpu")).trend == "increasing"
    assert one(control.trends(m.limit(2), "cpu")).trend == "stable"
    hot = control.cluster_stats(spark.createDataFrame([("n", 1, 1, 90.0, 10.0, 1.0, 2.0, 1)], METRICS))
    assert one(control.scaling(hot, 1)).action == "scale_up" and one(control.scaling(hot, 10)).action == "none"
    idle = control.cluster_stats(spark.createDataFrame([("n", 1, 1, 20.0, 25.0, 1.0, 2.0, 1)], METRICS))
    assert one(control.scaling(idle, 3)).action == "scale_down" and one(control.scaling(idle, 1)).action == "none"


def test_patterns_and_cache(spark):
    log = spark.createDataFrame([(0, i, f"q{i % 3 + 1}") for i in range(9)], "session long, seq long, query string")
    top = {r.query: r.next_query for r in control.next_queries(log).filter("rank = 1").collect()}
    assert top == {"q1": "q2", "q2": "q3", "q3": "q1"}
    assert control.patterns(log, 3).agg(F.sum("n")).first()[0] == 7
    now = [0.0]
    c = control.ResultCache(2, 10, lambda: now[0])
    c.put("a", 1), c.put("b", 2), c.get("a"), c.put("c", 3)
    assert c.get("b") is None and c.get("a") == 1
    now[0] = 11
    assert c.get("a") is None and c.stats()["evictions"] == 1 and c.stats()["hits"] == 2


def test_entities(spark):
    t = "Write to ann.lee@mail.example.org, see https://docs.example.org/a or ring 555-987-6543 by 2025-03-04; it costs $2,345.60"
    assert {k for _, k, *_ in text.structural(t)} == {"contact", "url", "date", "money"} and len(text.structural(t)) == 5
    got = {e for e, *_ in text.ngrams("Steve Jobs founded Apple Computer in Cupertino.")}
    assert {"Steve Jobs", "Apple Computer", "Cupertino"} <= got
    assert text.ngrams("Ministerio de Hacienda")[0][0] == "Ministerio de Hacienda"
    docs = spark.createDataFrame([(1, "This is a document about Open AI."), (2, "open ai and Open Source."), (3, None)], "doc_id long, text string")
    nodes, edges = graph.mentions(text.extract(docs))
    assert nodes.filter("kind = 'ENTITY'").count() >= 2 and edges.count() >= 1
    assert graph.valid_edges(edges, nodes).count() == edges.count()


def test_graph(spark):
    nodes = spark.createDataFrame([(x, "ENTITY", x, 0.8, 15.0) for x in "abcd"], "id string, kind string, name string, alpha double, kappa double")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")], "source string, target string")
    edges = graph.valid_edges(edges, nodes)
    assert edges.count() == 4
    reached = graph.bfs(nodes.filter("id = 'a'"), edges, 2)
    assert {(r.id, r.depth) for r in reached.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.expanded_edges(reached, edges, 2).count() == 2 and graph.induced(edges, reached).count() == 3
    assert {r.id: (r.out_degree, r.in_degree) for r in graph.degrees(nodes, edges).collect()}["c"] == (2, 1)
    b = spark.createDataFrame([(0,), (3,), (9,)], "n long").select(F.round(graph.boost(F.col("n")), 6).alias("b")).collect()
    assert [r.b for r in b] == [0, 0.15, 0.2]


def test_datasets(spark, tmp_path):
    splats = spark.createDataFrame([(i, float(i)) for i in range(7)], "id long, w double")
    tiers = {r.id: r.tier for r in dataset.tiers(splats, "id", "w").collect()}
    assert [tiers[i] for i in range(6, -1, -1)] == ["hot", "warm", "warm", "cold", "cold", "cold", "cold"]
    x = vectors(spark, np.random.default_rng(0).normal(size=(60, 4))).withColumn("c", F.col("vec_id") % 3)
    s = dataset.splats_of(x, "c", 60)
    assert abs(s.agg(F.sum("alpha")).first()[0] - 1) < 1e-12 and one(dataset.compression(s, 60, 4)).splat_count == 3
    assert ivf.hierarchy(x, 4).select("leaf").distinct().count() == 4
    splat_format.register(spark)
    rows = x.groupBy("c").agg(F.sort_array(F.collect_list(F.col("vec_id").cast("int"))).alias("indices")).join(s, "c").select(F.col("mu").cast("array<float>").alias("mu"), F.col("alpha").cast("float").alias("alpha"), F.col("kappa").cast("float").alias("kappa"), "indices")
    rows.write.format("splats").mode("append").save(f"{tmp_path}/s")
    back = spark.read.format("splats").load(f"{tmp_path}/s")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    np.save(tmp_path / "shard_001.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    npy = spark.read.format("npy").option("rows", 3).load(str(tmp_path / "shard_001.npy"))
    assert [r.vector for r in npy.orderBy("position").collect()][3] == [9.0, 10.0, 11.0]
    assert splat_format.blobs(spark, 50, 4, 5).count() == 50
    three = encode.full(splat_format.splats_3d(spark, 20))
    assert {len(r.code) for r in three.select("code").collect()} == {636}


def test_rotations(spark):
    q = spark.createDataFrame([([0.5, 0.5, -0.5, 0.5],), ([1.0, 2.0, 3.0, 4.0],)], "q array<double>")
    for r in q.select(v.quat_matrix(F.col("q")).alias("m"), v.covariance(F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0)]), F.col("q")).alias("c")).collect():
        m = np.array(r.m)
        assert np.allclose(m @ m.T, np.eye(3))
        assert np.allclose(np.array(r.c), m @ np.diag([1.0, 4.0, 9.0]) @ m.T)


def test_sphere(spark):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(5):
        a, b = rng.normal(size=(2, 6))
        rows.append(((a / np.linalg.norm(a)).tolist(), (b / np.linalg.norm(b)).tolist()))
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    back = df.select("b", v.exp_map_sphere(F.col("a"), v.log_map_sphere(F.col("a"), F.col("b"))).alias("c"), v.geodesic(F.col("a"), F.col("b")).alias("g"), v.norm(v.log_map_sphere(F.col("a"), F.col("b"))).alias("n"))
    for r in back.collect():
        assert np.allclose(r.b, r.c) and abs(r.g - r.n) < 1e-9


def test_plain_kmeans_is_that_of_a_loop(spark):
    x = np.random.default_rng(8).normal(size=(200, 3)).round(3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got, c = ivf.lloyd(df, 6)
    first = [r.vec_id for r in df.orderBy(F.xxhash64("vec_id", F.lit(42)), "vec_id").limit(6).collect()]
    want = x[first]
    for _ in range(30):
        own = ((x[:, None] - want[None]) ** 2).sum(2).argmin(1)
        new = np.stack([x[own == j].mean(0) if (own == j).any() else want[j] for j in range(6)])
        if np.allclose(new, want, atol=1e-6):
            break
        want = new
    assert np.allclose(c, want) and {r.vec_id: r.coarse_id for r in got.collect()} == dict(enumerate(((x[:, None] - want[None]) ** 2).sum(2).argmin(1).tolist()))


def test_avalanche_is_that_of_a_queue(spark):
    r = np.random.default_rng(9)
    x, e = r.normal(size=(60, 2)), r.uniform(0.4, 1.2, 60)
    s = spark.createDataFrame([(i, float(e[i]), 1.0, x[i].tolist()) for i in range(60)], "splat_id long, energy double, alpha double, mu array<double>")
    got = {q.splat_id: (q.energy, q.alpha, q.hit) for q in energy.avalanche(s, energy.neighbours_within(s, 1.0)).collect()}
    near = {i: [j for d, j in sorted((np.linalg.norm(x[i] - x[j]), j) for j in range(60) if j != i) if d <= 1.0][:10] for i in range(60)}
    held, queue, seen, hit = e.copy(), [int(e.argmax())], set(), set()
    while queue:
        i = queue.pop(0)
        if i in seen:
            continue
        seen.add(i)
        if held[i] > 0.8:
            for j in near[i]:
                held[j] += held[i] * 0.3 / len(near[i])
                if held[j] > 0.8 and j not in seen:
                    queue.append(j)
            held[i] *= 0.7
            hit.add(i)
    assert len(hit) > 5 and {i for i in got if got[i][2]} == hit
    assert all(np.isclose(got[i][0], held[i]) and np.isclose(got[i][1], 0.7 if i in hit else 1.0) for i in range(60))


def test_langevin_is_that_of_a_loop(spark):
    mu, a, k = np.array([[0.0, 1.0], [2.0, 0.0]]), np.array([0.5, 1.0]), np.array([1.0, 3.0])
    splats = spark.createDataFrame([(m.tolist(), float(p), float(q)) for m, p, q in zip(mu, a, k, strict=True)], "mu array<double>, alpha double, kappa double")
    start = np.array([[0.1, 0.2], [1.5, -0.5]])
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(start)], "id long, x array<double>")
    for r in energy.langevin(points, splats, steps=15).collect():
        rng, x = np.random.default_rng([42, r.id]), start[r.id].copy()
        for _ in range(15):
            w = a * np.exp(-k * ((x - mu) ** 2).sum(1))
            g = sum(2 * k[j] * w[j] * (x - mu[j]) for j in range(2)) / w.sum()
            x = x - g * 1e-3 / 0.1 + np.sqrt(2 * 1e-3 / 0.1) * rng.normal(size=2)
        assert np.allclose(r.x, x)


def test_gaps_and_suggestions(spark):
    rows = [(i, [float(i // 5), 0.01 * i], 0.4 + 0.1 * (i % 5) + 0.01 * (i // 5)) for i in range(15)]
    p = spark.createDataFrame(rows, "id long, x array<double>, energy double")
    assert energy.gaps(p, 2).count() == 2
    got = energy.suggestions(p, 2, 0.5).orderBy(F.desc("energy")).collect()
    assert [round(r.potential_value, 2) for r in got] == [0.82, 0.81] and [r.n_points for r in got] == [4, 4]
    for r in got:
        assert r.nearby == [i for _, i in sorted((np.linalg.norm(np.array(x) - r.center), i) for i, x, _ in rows)[:5]]
        assert r.description.startswith(f"A region of high uncertainty (energy {r.energy:.3f}) with 4 points") and r.queries[0] == f"explore near {r.nearby[0]}"


def test_filters_on_numbers_and_keys(spark):
    rows = [(1, '{"score": 2.5, "a.b": 3}'), (2, '{"score": 2, "a.b": 3.0}'), (3, '{"score": 3, "it\'s": "x"}'), (4, '{"score": "x", "big": 1e30}')]
    df = spark.createDataFrame(rows, "id long, metadata string")
    n = lambda w: {r.id for r in df.filter(filters.on_json(w)).collect()}
    assert n({"score": {"$gt": 2}}) == {1, 3} and n({"score": 2}) == {2} and n({"score": {"$lte": 2.5}}) == {1, 2}
    assert n({"a.b": 3}) == {1, 2} and n({"it's": "x"}) == {3} and n({"big": {"$gt": 10**20}}) == {4}


def test_places(spark):
    df = spark.createDataFrame([(i, (i * 37) % 50) for i in range(300)], "id long, k long").repartition(7)
    got = {r.id: r.at for r in collection.placed(df, "at", F.desc("k"), "id", first=5).collect()}
    assert got == {i: p for p, i in enumerate(sorted(range(300), key=lambda i: (-((i * 37) % 50), i)), 5)}
    assert collection.placed(df.limit(0), "at", "id").count() == 0


def test_export_noise_is_the_same_every_time(spark):
    s = spark.createDataFrame([(i, 1.0, [0.0] * 50) for i in range(40)], "splat_id long, kappa double, mu array<double>")
    a, b = (sorted(tuple(r.mu) for r in collection.export_batches(s.repartition(n), 8, noise=0.5).collect()) for n in (1, 4))
    assert a == b and abs(np.std(a) - 0.5) < 0.03 and abs(np.mean(a)) < 0.05


def test_splat_rules(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.mu, r.alpha, r.kappa, r.frequency) for r in dataset.ingested(v, 8, 10).collect()}
    assert np.allclose(got[1][0], [0.6, 0.8]) and got[2][1:] == (1.0, 10.0, 1.0)
    with pytest.raises(ValueError):
        dataset.ingested(v, 9, 10)


def test_caches_tiers_and_cooldown(spark):
    now = [0.0]
    cache = control.ResultCache(10, 5.0, lambda: now[0], max_bytes=3000)
    for i in range(5):
        cache.put(i, "x" * 900)
    assert cache.evictions == 2 and cache.get(0) is None and cache.get(4) and cache.bytes < 3000
    cache.put("large", "x" * 9000)
    assert cache.get("large") is None and cache.get(4)
    now[0] = 6.0
    assert cache.get(4) is None
    e = shard.EnergyCache(10.0, lambda: now[0])
    assert e.get("q", "n") == 1.0
    e.report("n", 0.2)
    assert e.get("q", "n") == 1.0 and e.get("p", "n") == 0.2
    now[0] = 16.0
    assert e.get("q", "n") == 0.2
    t = control.Tiers(2, 2, promote=3)
    assert [t.use("a") for _ in range(4)] == ["warm", "warm", "hot", "hot"]
    for x in "bcd":
        t.use(x)
    assert t.tier("b") == "cold" and t.tier("d") == "warm" and t.tier("a") == "hot" and t.tier("zz") is None
    heard = []
    s = control.Scaler(2, cooldown=60, clock=lambda: now[0])
    s.listeners.append(heard.append)
    busy = spark.createDataFrame([(3, 90.0, 50.0, 5.0)], "n_nodes long, cpu double, memory double, latency_ms double")
    assert s.decide(busy)["action"] == "scale_up" and s.decide(busy)["reason"] == "cooldown" and s.nodes == 3 and len(heard) == 1
    now[0] += 60
    assert s.decide(busy)["target"] == 4


def test_colors_of_255(spark):
    from orrery.functions import encode

    a, b = (spark.createDataFrame([(1, [x, 0.0, 0.0]), (2, [0.0, 0.0, x / 2])], "vec_id long, color array<double>") for x in (1.0, 255.0))
    assert [r.color for r in encode.unit_colors(a).orderBy("vec_id").collect()] == [r.color for r in encode.unit_colors(b).orderBy("vec_id").collect()]


def test_semantic_validation_without_splats(spark):
    x = np.random.default_rng(3).normal(size=(40, 4)) * 0.05 + np.eye(4)[np.arange(40) % 4]
    df = spark.createDataFrame([(i, 0.5, v.tolist()) for i, v in enumerate(x)], "vec_id long, score double, embedding array<double>")
    got = text.validated(df).collect()
    assert len(got) == 40 and {r.score for r in got} == {0.5} and 4 <= len({r.cluster_id for r in got}) <= 5


def test_arrays_and_energy_states_are_written(spark, tmp_path):
    from orrery.sources import splat_format

    splat_format.register(spark)
    x = np.random.default_rng(1).normal(size=(30, 3)).astype(np.float32)
    df = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)], "shard string, position long, vector array<float>").repartition(3)
    df.write.format("npy").mode("append").save(f"{tmp_path}/npy")
    back = spark.read.format("npy").load(f"{tmp_path}/npy")
    assert sorted(tuple(r.vector) for r in back.collect()) == sorted(map(tuple, x.tolist()))
    s = spark.createDataFrame([(1, [1.0], 0.5, 2.0)], "splat_id long, mu array<double>, alpha double, kappa double")
    splat_format.save_energy(s, f"file://{tmp_path}/energy")
    assert splat_format.load_energy(spark, f"file://{tmp_path}/energy").collect() == s.collect()


def plain_ward(x, k):
    """Greedy merges of the pair that adds least to the sum of squares."""
    groups = [[i] for i in range(len(x))]
    loss = lambda g: ((x[g] - x[g].mean(0)) ** 2).sum()
    while len(groups) > k:
        pairs = [(loss(a + b) - loss(a) - loss(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i])]
        _, i, j = min(pairs)
        groups[j] = groups[j] + groups[i]
        del groups[i]
    return {tuple(sorted(g)) for g in groups}


def test_ward_is_that_of_greedy_merges():
    for seed in range(3):
        x = np.random.default_rng(seed).normal(size=(35, 3))
        for k in (2, 5):
            label = ivf.ward(x, np.ones(35), k)
            assert {tuple(np.flatnonzero(label == j).tolist()) for j in range(k)} == plain_ward(x, k)


def test_ward_tree(spark):
    x = np.random.default_rng(6).normal(size=(120, 3)) + np.repeat(np.eye(3) * 20, 40, 0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.node for r in ivf.ward_tree(df, 2, 6, 10).collect()}
    assert len(got) == 120
    # 3 = 6 / 2 children of the root, then 4 = 40 / 10 of each
    assert sorted(got) == list(range(120)) and len({n.split(".")[0] for n in got.values()}) == 3 and len(set(got.values())) == 12
    for i in range(3):
        assert len({got[j].split(".")[0] for j in range(40 * i, 40 * i + 40)}) == 1
    summed = {r.vec_id: r.node for r in ivf.ward_tree(df, 1, 3, 10, most=60).collect()}
    assert sorted(summed) == list(range(120)) and all(len({summed[j] for j in range(40 * i, 40 * i + 40)}) == 1 for i in range(3))


def test_lloyd_and_ward_tree_over_parts_without_rows(spark):
    x = np.random.default_rng(3).normal(size=(200, 4))
    df = vectors(spark, x)
    sparse = df.withColumn("one", F.lit(1)).repartition(7, "one").drop("one")
    # seven parts, of which one has all rows
    assert sparse.rdd.getNumPartitions() == 7
    want, c = ivf.lloyd(df.coalesce(1), 3)
    got, d = ivf.lloyd(sparse, 3)
    assert np.allclose(c, d) and {tuple(r) for r in got.select("vec_id", "coarse_id").collect()} == {tuple(r) for r in want.select("vec_id", "coarse_id").collect()}
    assert ivf.ward_tree(sparse, 1, 3, 10, most=60).count() == 200


def test_mean_does_not_hang_on_the_order_of_rows(spark):
    from orrery.plans import catalogue

    rows = [("a", x) for x in (0.1, 0.2, 0.3)] + [("b", x) for x in (0.3, 0.2, 0.1)] + [("c", 1e25), ("c", 3e25), ("d", None)]
    df = spark.createDataFrame(rows, "node string, value double").coalesce(1)
    plain, got = ({r.node: r.m for r in df.groupBy("node").agg(m.alias("m")).collect()} for m in (F.avg("value"), catalogue.mean("value")))
    # sums of doubles tell the two nodes apart, so that their order is chance
    assert plain["a"] != plain["b"] and got["a"] == got["b"]
    assert got["c"] == 2e25 and got["d"] is None


def test_pair_measures_by_stripes(spark):
    x = np.random.default_rng(5).normal(size=(60, 5))
    x[7] = 0
    rows = [(i, None if i == 11 else y.tolist(), i % 2) for i, y in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {(r.a_id, r.b_id): tuple(r)[2:] for r in knn.pair_measures(df, "label", 6, stripe=8).collect()}
    assert set(got) == {(a, b) for a in range(60) for b in range(a + 2, 60, 2)} == set(got) and len(got) == 2 * 30 * 29 // 2
    for (a, b), (dot, l2, cosine, geodesic) in got.items():
        if 11 in (a, b):
            assert (dot, l2, cosine, geodesic) == (None,) * 4
            continue
        d = x[a] @ x[b]
        assert abs(dot - d) < 1e-6 and abs(l2 - np.linalg.norm(x[a] - x[b])) < 1e-6 and abs(geodesic - np.arccos(np.clip(d, -1, 1))) < 1e-6
        assert cosine is None if 7 in (a, b) else abs(cosine - d / np.linalg.norm(x[a]) / np.linalg.norm(x[b])) < 1e-6


def test_rounding_of_halves():
    assert knn.rounded(np.array([0.5, 1.5, -2.5, 2.4]), 0).tolist() == [1, 2, -3, 2]


def test_broadcast_all_is_dealt_to_many_tasks(spark):
    q, n = spark.range(50).select(F.col("id").alias("query_id")).coalesce(1), spark.createDataFrame([(0,), (1,), (2,), (None,)], "node_id long").coalesce(1)
    got = shard.broadcast_all(q, n, 2)
    assert got.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted((r.query_id, str(r.node_id)) for r in got.collect()) == sorted((i, j) for i in range(50) for j in ("0", "1", "2", "None"))


def test_avalanche_asks_for_neighbours_of_what_topples(spark):
    s = spark.createDataFrame([(i, 2.0 if i < 3 else 0.1, 1.0, [float(i), 0.0]) for i in range(40)], "splat_id long, energy double, alpha double, mu array<double>")
    seen = []

    def near(ids):
        seen.extend(ids)
        return energy.neighbours_within(s, 1.0, of=s.filter(F.col("splat_id").isin(ids)))

    rows = lambda df: sorted(map(tuple, df.select("splat_id", "energy", "alpha", "hit").collect()))
    got = rows(energy.avalanche(s, near))
    assert got == rows(energy.avalanche(s, energy.neighbours_within(s, 1.0)))
    hit = [r[0] for r in got if r[3]]
    assert len(got) == 40 and hit and set(seen) == set(hit) and len(seen) == len(hit) < 40


def test_heads_of_clusters(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(300)], "vec_id long, coarse_id int")
    assert sorted((r.coarse_id, r.vec_id) for r in ivf.heads(a, 2, "coarse_id").collect()) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]
    p = spark.createDataFrame([(9, 2, 1, 0.5), (9, 0, 2, 0.7)], "query_id long, coarse_id int, probe_rank int, centroid_distance double")
    df = ivf.lod0(p, a, 4)
    assert [(r.vec_id, r.distance, r["rank"]) for r in df.orderBy("rank").collect()] == [(2, 0.5, 1), (5, 0.5, 2), (8, 0.5, 3), (11, 0.5, 4)]
    # members are cut down before they meet the queries
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_grouped_search_gathers_no_group(spark):
    rng = np.random.default_rng(6)
    x, g = rng.normal(size=(1500, 3)), rng.integers(0, 3, 1500)
    df = spark.createDataFrame([(i, y.tolist(), int(j)) for i, (y, j) in enumerate(zip(x, g, strict=True))], "vec_id long, embedding array<double>, shard long").repartition(3)
    q = df.select(F.col("vec_id").alias("query_id"), "embedding", "shard")
    got = knn.grouped_knn(q, df, "shard", 2)
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = {}
    for r in got.collect():
        assert r.shard == g[r.query_id] == g[r.vec_id]
        pairs.setdefault(r.query_id, set()).add(r.vec_id)
    for i in range(0, 1500, 50):
        d = np.where(g == g[i], np.linalg.norm(x - x[i], axis=1), np.inf)
        assert pairs[i] == set(np.argsort(d)[:2].tolist())
    assert len(pairs) == 1500


def test_matrices_of_a_search_have_bounded_rows(monkeypatch):
    rng, most = np.random.default_rng(7), []
    q, real = rng.normal(size=(1300, 3)), knn.scores
    monkeypatch.setattr(knn, "scores", lambda a, b, m: most.append(len(a)) or real(a, b, m))
    i, ids, d = knn.near(np.arange(1300), q, np.arange(1300), np.arange(1300), q, 2, "l2", False)
    assert max(most) <= knn.SLICE and np.bincount(i).tolist() == [2] * 1300
    far = np.linalg.norm(q[:, None] - q[None], axis=2) + np.diag([np.inf] * 1300)
    assert np.allclose(d[::2], far.min(1)) and (ids[::2] == far.argmin(1)).all()


def test_all_that_share_a_bucket(spark):
    x = np.random.default_rng(8).normal(size=(600, 8))
    df = vectors(spark, x)
    q = df.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    h = lsh.CrossPolytope(8, 3, 4)
    want, got = (sorted((r.query_id, r.vec_id, r["rank"]) for r in f.collect()) for f in (lsh.query(q, df, h, 5, 2, 600, keep_self=False), lsh.query_all(q, df, h, 5, 2, keep_self=False)))
    assert want == got and got
    assert "SortMergeJoin" not in lsh.query_all(q, df, h, 5, 2)._jdf.queryExecution().executedPlan().toString()


def test_entities_come_in_bounded_frames():
    import pandas as pd

    docs = pd.DataFrame({"doc_id": range(500), "text": ["Ada met Bob, Eve met Ida" if i % 5 else None for i in range(500)]})
    got = list(text.frames(iter([docs, docs]), text.merged, 50))
    assert max(map(len, got)) < 53 and sum(map(len, got)) == 2 * 400 * 3
    assert pd.concat(got)["doc_id"].tolist() == 2 * [i for i in range(500) if i % 5 for _ in range(3)]


def test_blocks_and_parts_of_queries_do_not_follow_the_files(spark):
    # 60 files of 50 queries each; vectors are read once for each part of queries
    df = vectors(spark, np.random.default_rng(8).normal(size=(3000, 64))).repartition(60)
    assert knn.packed(df, "vec_id", "embedding", ("ids", "v"), gather=True).count() <= 8
    wide = spark.range(2000, numPartitions=1).select(F.col("id").alias("vec_id"), F.array_repeat(F.lit(0.5), 640).alias("embedding"))
    sizes = [len(r.v) for r in knn.packed(wide, "vec_id", "embedding", ("ids", "v")).collect()]
    assert max(sizes) <= 1 << 20 and sum(sizes) == 2000 * 640 * 8
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


def test_a_search_measures_few_pairs_and_those_in_chunks(monkeypatch):
    rng, seen, real = np.random.default_rng(9), [], knn.exact
    monkeypatch.setattr(knn, "exact", lambda q, v, m: seen.append(len(q)) or real(q, v, m))
    q, v = np.zeros((100, 3)), np.ones((1000, 3))  # all pairs tie
    i, ids, d = knn.near(np.arange(100), q, np.arange(100), np.arange(1000), v, 2, "l2", True)
    assert sum(seen) == 100_000 and max(seen) <= 16_384 and ids.tolist() == [0, 1] * 100
    for metric in ("l2", "dot"):
        seen.clear()
        q, v, h = rng.normal(size=(60, 4)), rng.normal(size=(5000, 4)), knn.Held(60, 5)
        for a in range(0, 5000, 500):
            h.add(*knn.near(np.arange(60), q, np.arange(60), np.arange(a, a + 500), v[a : a + 500], 5, metric, True, h.bound))
        all_d = -(q @ v.T) if metric == "dot" else np.linalg.norm(q[:, None] - v[None], axis=2)
        assert h.hits[1].reshape(60, 5).tolist() == np.argsort(all_d, axis=1)[:, :5].tolist()
        assert sum(seen) < 60 * 5 * 8  # of ten blocks, five a query and block were measured before


def test_no_task_holds_a_great_cluster(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(c, 0.01, (n, 2)) for c, n in ((0, 60), (5, 70), (50, 20))])
    rows = [(i, y.tolist(), int(i >= 130)) for i, y in enumerate(x)]
    coarse = spark.createDataFrame(rows, "vec_id long, embedding array<double>, coarse_id int").repartition(3)
    got = {r.vec_id: r.fine_id for r in ivf.fine_clusters(coarse, 4, most=50).collect()}
    assert sorted(got) == list(range(150))
    assert not {got[i] for i in range(60)} & {got[i] for i in range(60, 130)} and len({got[i] for i in range(130)}) <= 4
    alone = {r.vec_id: r.fine_id for r in ivf.fine_clusters(coarse.filter("coarse_id = 1"), 4).collect()}
    assert {i: got[i] for i in alone} == alone


def test_splats_meet_points_in_few_parts(spark):
    p = spark.range(100, numPartitions=1).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    splats = spark.range(30).select(F.array(F.lit(0.0), F.col("id").cast("double")).alias("mu"), F.lit(1.0).alias("alpha"), (F.col("id") + 1.0).alias("kappa")).repartition(30)
    assert energy.blocks(p, splats).count() <= 8


def test_regions_are_found_in_one_round(spark, monkeypatch):
    p = spark.createDataFrame([(i, [float(10 * (i % 20)), 0.0], 1.0 + i) for i in range(200)], "id long, x array<double>, energy double")
    sorts, real = [], type(p).orderBy
    monkeypatch.setattr(type(p), "orderBy", lambda self, *a, **b: sorts.append(1) or real(self, *a, **b))
    got = energy.regions(p, 0.5, 8, 0.5).collect()
    assert [(r.energy, r.n_points) for r in got] == [(200.0 - i, 10) for i in range(8)]
    assert len(sorts) == 2  # before, nine: a round for each region, and one of what they hold
    monkeypatch.setattr(energy, "WALK", 3)
    assert [tuple(r) for r in energy.regions(p, 0.5, 8, 0.5).collect()] == [tuple(r) for r in got]
