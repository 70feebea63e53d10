import numpy as np
import pytest

from orrery.plans.engine import Engine


def test_requests(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}")
    assert e.handle({"action": "create", "collection": "c", "dimension": 4})["status"] == 201
    assert e.handle({"action": "create", "collection": "c", "dimension": 4})["status"] == 409
    assert e.handle({"action": "get", "collection": "x", "id": "d1"})["status"] == 404
    x = np.random.default_rng(0).normal(size=(5, 4)).tolist()
    add = {"action": "add", "collection": "c", "vectors": x, "ids": [f"d{i}" for i in range(5)], "metadata": [f'{{"n": {i}}}' for i in range(5)]}
    assert e.handle(add)["added"] == 5
    assert e.handle({**add, "ids": ["d1"]})["status"] == 400
    find = {"action": "search", "collection": "c", "vector": x[2], "k": 2}
    r = e.handle(find)["results"]
    assert len(r) == 2 and r[0]["id"] == "d2" and r[0]["distance"] == pytest.approx(0, abs=1e-6)
    e.handle(find)
    assert e.cache.hits == 1
    e.handle({"action": "delete", "collection": "c", "ids": ["d2"]})
    assert e.handle(find)["results"][0]["id"] != "d2"
    assert e.handle({**find, "filter": {"n": {"$gte": 4}}})["results"][0]["id"] == "d4"
    assert e.handle({"action": "stats", "collection": "c"}) == {"status": 200, "total": 5, "active": 4, "deleted": 1}
    assert e.handle({"action": "get", "collection": "c", "id": "d2"})["status"] == 404
    assert e.handle({"action": "get", "collection": "c", "id": "d1"})["metadata"] == '{"n": 1}'
    assert e.handle({"action": "list"})["collections"] == ["c"] and e.handle({"action": "drop", "collection": "c"})["status"] == 200


def test_searches_agree(spark):
    c = Engine(spark).create("c", 8)
    x = np.random.default_rng(1).normal(size=(80, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c.add_lists(x.tolist(), [f"d{i}" for i in range(80)])
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "query_id long, embedding array<double>")
    exact = {(r.query_id, r["rank"]): r.id for r in c.search(q, 5, with_energy=True).collect()}
    assert all(exact[i, 1] == f"d{i}" for i in range(6))
    assert {(r.query_id, r["rank"]): r.id for r in c.search_sharded(q, 5, 3, "score").collect()} == exact
    assert sum(exact[i, 1] in {r.id for r in c.search_approximate(q, 5, "lsh").collect() if r.query_id == i} for i in range(6)) >= 5
    assert c.search_approximate(q, 5, "ivf", 50).count() == 30


def test_texts_and_dimensions(spark):
    c = Engine(spark).create("c", 2)
    c.add_texts(spark.createDataFrame([("hello",), ("hi",)], "document string"), lambda ts: [[len(t), 1.0] for t in ts])
    q = spark.createDataFrame([(0, [5.0, 1.0])], "query_id long, embedding array<double>")
    assert c.search(q, 1, include=["document"]).first().document == "hello"
    c.add_lists([[1.0, 2.0, 3.0]])
    with pytest.raises(Exception, match="2 numbers"):
        c.snapshot.collect()


def test_more_requests(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/engine")
    do = lambda action, **more: e.handle({"action": action, "collection": "c", **more})
    assert e.handle({"action": "health"})["state"] == "ok" and do("create", dimension=3)["status"] == 201
    x = np.eye(3).tolist() + [[0.0, 0.0, 2.0]]
    assert do("add", vectors=x, ids=list("abcd"), metadata=['{"n.x": 1.5}'] * 4)["added"] == 4
    energy = lambda v: -np.log(max(sum(np.exp(-10 * ((np.array(v) - y) ** 2).sum()) for y in x), 1e-10))
    r = do("update", id="a", vector=[0.9, 0.1, 0.0])
    assert r["success"] and r["energy_delta"] == pytest.approx(energy([0.9, 0.1, 0.0]) - energy(x[0]), abs=1e-6)
    assert do("update", id="z", document="x")["status"] == 404 and do("update", id="a", vector=[1.0])["status"] == 400
    assert do("upsert", id="z")["message"] == "upserted" and do("get", id="z")["vector"] == [0.0, 0.0, 0.0]
    got = do("delete", ids=["d", "nope"])
    assert got["deleted"] == 1 and do("update", id="d", document="x")["message"] == "is deleted"
    assert do("ids")["ids"] == ["a", "b", "c", "z"] and do("ids", include_deleted=True)["ids"] == ["a", "b", "c", "d", "z"]
    assert [r["id"] for r in do("search_batch", vectors=[x[1], x[2]], k=1)["results"]] == ["b", "c"]
    assert [r["id"] for r in do("search", vector=x[0], k=9, filter={"n.x": {"$gt": 1}})["results"]] == ["a", "b", "c"]
    r = do("search_energy", vector=x[1], k=2)
    assert r["results"][0]["id"] == "b" and 0 < r["mean_confidence"] < 2 and len(r["uncertain_regions"]) <= 3
    assert do("energy", vectors=[x[1], [9.0, 9.0, 9.0]])["zones"] == ["high_confidence", "uncertain"]
    assert do("explore", vector=[5.0, 5.0, 5.0], n=2)["regions"][0]["energy"] == pytest.approx(10)
    s = do("suggest", n=1, min_energy=-5.0)["suggestions"]
    assert len(s) == 1 and set(s[0]["nearby"]) <= set("abcz")
    assert do("info")["dimension"] == 3 and e.handle({"action": "all_stats"})["collections"][0]["total"] == 5
    assert do("search")["status"] == 400 and do("nope")["status"] == 400
    path = f"file://{tmp_path}/saved"
    assert do("backup", path=path)["saved"] == ["c"]
    other = Engine(spark)
    assert other.handle({"action": "restore", "path": path})["loaded"] == ["c"]
    assert other.handle({"action": "get", "collection": "c", "id": "z"})["vector"] == [0.0, 0.0, 0.0] and other.collection("c").version == e.collection("c").version


def test_an_index_is_built_once_and_saved(spark, tmp_path, monkeypatch):
    from orrery.operators import ivf
    from orrery.plans.engine import Collection

    c = Engine(spark, f"file://{tmp_path}/e").create("c", 4)
    x = np.random.default_rng(2).normal(size=(60, 4))
    c.add_lists(x.tolist(), [f"d{i}" for i in range(60)])
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(3)], "query_id long, embedding array<double>")
    made, own = [], ivf.build
    monkeypatch.setattr(ivf, "build", lambda *a: made.append(1) or own(*a))
    find = lambda c: {(r.query_id, r["rank"]): r.id for r in c.search_approximate(q, 3, "ivf", 50).collect()}
    first = find(c)
    assert find(c) == first and len(made) == 1
    c.save(f"file://{tmp_path}/saved")
    assert find(Collection.load(spark, f"file://{tmp_path}/saved")) == first and len(made) == 1
    c.add_lists([[0.0] * 4])
    find(c)
    assert len(made) == 2


def test_texts_are_found_by_texts(spark):
    c = Engine(spark).create("c", 2)
    embed = lambda ts: [[len(t), 1.0] for t in ts]
    c.add_texts(spark.createDataFrame([("hello", '{"n": 1}'), ("hi", '{"n": 2}')], "document string, metadata string"), embed)
    got = {(r.query_id, r["rank"]): r.document for r in c.search_texts(["abcde", "ab"], embed, 2).collect()}
    assert got == {(0, 1): "hello", (0, 2): "hi", (1, 1): "hi", (1, 2): "hello"}
    assert c.search_texts(["abcde"], embed, 2, where={"n": {"$gt": 1.5}}).first().document == "hi"
