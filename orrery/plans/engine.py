"""The engine as one object: collections by name, changed and searched by calls or by requests.

A collection is a snapshot that each change replaces. Snapshots are written to a folder once a chain of changes has grown
long, so plans stay small. Searches give DataFrames; nothing is collected but what the result cache keeps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.vectors import md5_mod, query_key
from ..operators import collection, control, energy, ivf, knn, lsh, shard

LONGEST_CHAIN = 20
VECTORS = "id string, vector array<float>, metadata string, document string"


class Collection:
    """One collection: add, update, delete, get, search, stats."""

    def __init__(self, spark: SparkSession, dimension: int, folder: str | None = None):
        self.spark, self.dimension, self.folder = spark, dimension, folder
        self.snapshot, self.version, self.chain = collection.empty(spark), 0, 0
        self.built: dict[str, tuple[int, DataFrame]] = {}

    def _set(self, snapshot: DataFrame) -> None:
        self.version, self.chain = self.version + 1, self.chain + 1
        if self.folder and self.chain >= LONGEST_CHAIN:
            path = f"{self.folder}/v={self.version}"
            snapshot.write.mode("overwrite").parquet(path)
            snapshot, self.chain = self.spark.read.schema(collection.SCHEMA).parquet(path), 0
        self.snapshot = snapshot

    def _checked(self, rows: DataFrame) -> DataFrame:
        ok = F.col("vector").isNull() | (F.size("vector") == self.dimension)
        wrong = F.raise_error(F.concat(F.lit(f"a vector of {self.dimension} numbers is needed, not of "), F.size("vector").cast("string")))
        return rows.withColumn("vector", F.when(ok, F.col("vector")).otherwise(wrong.cast("array<float>")))

    def add(self, rows: DataFrame) -> None:
        """rows: vector and any of id, metadata (JSON), document."""
        self._set(collection.add(self.snapshot, self._checked(rows.withColumn("vector", F.col("vector").cast("array<float>"))), self.version + 1))

    def add_lists(self, vectors: Sequence[Sequence[float]], ids: Sequence[str] | None = None, metadata: Sequence[str] | None = None, documents: Sequence[str] | None = None) -> int:
        """The same from lists on the driver, which must be of one length."""
        for other in (ids, metadata, documents):
            if other is not None and len(other) != len(vectors):
                raise ValueError("lists differ in length")
        rows = [(None if ids is None else ids[i], [float(x) for x in v], None if metadata is None else metadata[i], None if documents is None else documents[i]) for i, v in enumerate(vectors)]
        self.add(self.spark.createDataFrame(rows, VECTORS))
        return len(rows)

    def add_texts(self, rows: DataFrame, embed: Callable[[list[str]], Sequence[Sequence[float]]]) -> None:
        """rows: document and any of id, metadata. embed: vectors of texts, called on executors for a batch at a time."""

        def run(batches):
            for pdf in batches:
                yield pdf.assign(vector=[list(map(float, v)) for v in embed(pdf["document"].tolist())] if len(pdf) else [])

        full = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in ("id", "metadata", "document")])
        self.add(full.mapInPandas(run, "id string, metadata string, document string, vector array<float>"))

    def splats(self) -> DataFrame:
        """The active vectors as splats of one weight and concentration: the landscape that energies are taken in."""
        return collection.active(self.snapshot).filter("vector is not null").select(F.col("vector").alias("mu"), F.lit(1.0).alias("alpha"), F.lit(10.0).alias("kappa"))

    def update(self, changes: DataFrame, upsert: bool = False) -> DataFrame:
        """id, success, message and energy_delta of each change, which are computed only when they are read."""
        if "vector" in changes.columns:
            changes = self._checked(changes.withColumn("vector", F.col("vector").cast("array<float>")))
        told = collection.update_result(self.snapshot, changes, self.splats(), upsert)
        self._set(collection.update(self.snapshot, changes, self.version + 1, upsert, self.dimension))
        return told

    def delete(self, ids: DataFrame | None = None, where: Mapping[str, Any] | None = None, hard: bool = False) -> DataFrame:
        """By ids, by filter, or by both; gives deleted and energy_freed, which are computed only when they are read."""
        gone = collection.ids(self.snapshot).limit(0) if ids is None else ids.select("id")
        if where is not None:
            gone = gone.unionByName(collection.active(self.snapshot).filter(filters.on_json(where)).select("id"))
        told = collection.delete_result(self.snapshot, gone, self.splats())
        s = self.snapshot
        if ids is not None:
            s = collection.delete(s, ids, hard)
        if where is not None:
            s = collection.delete_where(s, filters.on_json(where), hard)
        self._set(s)
        return told

    def save(self, path: str) -> None:
        """The snapshot, the version and the dimension; an index that is up to date goes along."""
        self.snapshot.write.mode("overwrite").parquet(f"{path}/rows")
        for kind, (version, index) in self.built.items():
            if version == self.version:
                (ivf.save if kind == "ivf" else lambda x, to: x.write.mode("overwrite").parquet(to))(index, f"{path}/{kind}")
        kinds = ",".join(k for k, (version, _) in self.built.items() if version == self.version)
        self.spark.createDataFrame([(self.dimension, self.version, kinds)], "dimension int, version long, indexes string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str, folder: str | None = None) -> Collection:
        about = spark.read.parquet(f"{path}/about").first()
        c = cls(spark, about.dimension, folder)
        c.snapshot, c.version = spark.read.schema(collection.SCHEMA).parquet(f"{path}/rows"), about.version
        c.built = {k: (about.version, ivf.load(spark, f"{path}/{k}") if k == "ivf" else spark.read.parquet(f"{path}/{k}")) for k in about.indexes.split(",") if k}
        return c

    def index(self, kind: str) -> DataFrame:
        """The index over the present snapshot: built once for each version, in the folder where there is one."""
        if kind in self.built and self.built[kind][0] == self.version:
            return self.built[kind][1]
        rows = self._numbered(None)
        if kind == "ivf":
            made = ivf.build(rows, ivf.sizes_for(max(1000, rows.count()))[0])
        elif kind == "lsh":
            made = lsh.buckets(rows, lsh.CrossPolytope(self.dimension))
        else:
            raise ValueError(f"unknown index {kind}")
        if self.folder:
            path = f"{self.folder}/{kind}-v={self.version}"
            made.write.mode("overwrite").parquet(path)
            made = self.spark.read.schema(made.schema).parquet(path)
        else:
            made = made.persist()
        self.built[kind] = self.version, made
        return made

    def get(self, key: str) -> DataFrame:
        return collection.get(self.snapshot, key)

    def stats(self) -> DataFrame:
        return collection.stats(self.snapshot)

    def _numbered(self, where: Mapping[str, Any] | None) -> DataFrame:
        """Active rows with a number each: ids are strings, searches take numbers."""
        rows = collection.active(self.snapshot)
        if where:
            rows = rows.filter(filters.on_json(where))
        return rows.filter("vector is not null").withColumn("vec_id", F.xxhash64("id")).withColumnRenamed("vector", "embedding")

    def search(self, queries: DataFrame, k: int = 10, where: Mapping[str, Any] | None = None, mode: str = "pre", include: Sequence[str] = ("metadata",), with_energy: bool = False) -> DataFrame:
        """query_id, id, distance, score, rank and what is to be included of vector, metadata and document; with_energy
        adds energy, confidence and zone. queries: query_id, embedding."""
        rows = self._numbered(where if mode == "pre" else None)
        hits = knn.with_scores(knn.knn(queries, rows, k))
        names = ["id", *(c if c != "vector" else F.col("embedding").alias("vector") for c in include)]
        source = rows.filter(filters.on_json(where)) if where and mode == "post" else rows
        out = hits.join(source.select("vec_id", *names), "vec_id")
        if with_energy:
            points = source.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
            splats = rows.select(F.col("embedding").alias("mu"), F.lit(1.0).alias("alpha"), F.lit(10.0).alias("kappa"))
            e = energy.energies(points.join(hits.select(F.col("vec_id").alias("id")).distinct(), "id", "left_semi"), splats)
            out = energy.with_confidence(out.join(e.withColumnRenamed("id", "vec_id"), "vec_id"))
        return out.drop("vec_id")

    def search_approximate(self, queries: DataFrame, k: int = 10, index: str = "auto", n_probe: int = 5) -> DataFrame:
        """The same through an index: "ivf", "lsh", or what the data call for."""
        rows = self._numbered(None)
        if index == "auto":
            index = ivf.choose_index(rows)
        built = self.index(index)
        if index == "lsh":
            hits = lsh.query(queries, rows, lsh.CrossPolytope(self.dimension), k, built=built)
        else:
            hits = ivf.lod2(ivf.probe(queries, ivf.centroids_of(built, "coarse_id"), n_probe), built, k)
        return knn.with_scores(hits).join(rows.select("vec_id", "id"), "vec_id").drop("vec_id")

    def search_texts(self, texts: Sequence[str], embed: Callable[[list[str]], Sequence[Sequence[float]]], k: int = 10, **options: Any) -> DataFrame:
        """search() of the vectors that embed gives these texts; query_id is a text's place."""
        rows = [(i, [float(y) for y in x]) for i, x in enumerate(embed(list(texts)))]
        return self.search(self.spark.createDataFrame(rows, "query_id long, embedding array<double>"), k, **{"include": ("metadata", "document"), **options})

    def energies(self, points: DataFrame) -> DataFrame:
        """energy, confidence and zone of points (id, x)."""
        return energy.with_confidence(energy.energies(points, self.splats()))

    def search_with_energy(self, vector: Sequence[float], k: int = 10, n_regions: int = 3) -> dict[str, Any]:
        """One query: its hits with their energies, its own energy, the hits' mean confidence, uncertain regions near by."""
        q = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, embedding array<double>")
        hits = self.search(q, k, include=("metadata", "document"), with_energy=True).orderBy("rank").toPandas()  # k rows
        own = self.energies(q.select(F.col("query_id").alias("id"), F.col("embedding").alias("x"))).first()
        return {"results": hits, "query_energy": own.energy, "mean_confidence": float(hits["confidence"].mean()) if len(hits) else 0.0, "uncertain_regions": self.explore(vector, n_regions)}

    def explore(self, vector: Sequence[float], n_regions: int = 3, n_samples: int = 500, sigma: float = 1.0, min_energy: float = 0.7) -> list[dict[str, Any]]:
        """The regions of highest energy among seeded points around a vector."""
        p = energy.sample_points(self.spark, n_samples, [float(x) for x in vector], sigma)
        return [r.asDict() for r in energy.regions(p.join(energy.energies(p, self.splats()), "id"), min_energy, n_regions).collect()]  # n_regions rows

    def suggest(self, n: int = 3, min_energy: float = 0.7) -> list[dict[str, Any]]:
        """Where to explore: the regions of highest energy among the vectors, with the ids next to them."""
        rows = self._numbered(None).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), F.col("id").alias("name"))
        p = rows.join(energy.energies(rows.select("id", "x"), self.splats()), "id")
        out = [r.asDict() for r in energy.suggestions(p, n, min_energy).collect()]  # n rows
        names = dict(map(tuple, rows.filter(F.col("id").isin([i for r in out for i in r["nearby"]])).select("id", "name").collect())) if out else {}
        return [{**r, "nearby": [names[i] for i in r["nearby"]]} for r in out]

    def search_sharded(self, queries: DataFrame, k: int = 10, n_shards: int = 4, strategy: str = "rrf") -> DataFrame:
        """Searches hash shards each by itself and merges their lists."""
        rows = self._numbered(None).withColumn("shard", md5_mod(F.col("id"), n_shards))
        lists = knn.grouped_knn(queries.crossJoin(self.spark.range(n_shards).select(F.col("id").alias("shard"))), rows, "shard", k)
        return shard.merge(lists, k, strategy).join(rows.select("vec_id", "id"), "vec_id").drop("vec_id")


class Engine:
    """Collections by name, and a cache of collected results under (name, version, query)."""

    def __init__(self, spark: SparkSession, folder: str | None = None, cache_size: int = 1000, ttl: float = 3600.0):
        self.spark, self.folder = spark, folder
        self.collections: dict[str, Collection] = {}
        self.cache = control.ResultCache(cache_size, ttl)

    def create(self, name: str, dimension: int) -> Collection:
        if name in self.collections:
            raise ValueError(f"collection {name} exists")
        self.collections[name] = Collection(self.spark, dimension, f"{self.folder}/{name}" if self.folder else None)
        return self.collections[name]

    def collection(self, name: str) -> Collection:
        return self.collections[name]

    def drop(self, name: str) -> None:
        del self.collections[name]

    def search_cached(self, name: str, vector: Sequence[float], k: int = 10, where: Mapping[str, Any] | None = None) -> pd.DataFrame:
        """One query's hits, kept until the collection changes or they grow old."""
        c = self.collections[name]
        q = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, embedding array<double>")
        key = (name, c.version, q.select(query_key(F.col("embedding"), F.lit(k), F.lit(repr(sorted((where or {}).items()))))).first()[0])
        hits = self.cache.get(key)
        if hits is None:
            hits = c.search(q, k, where).orderBy("rank").toPandas()
            self.cache.put(key, hits)
        return hits

    def save(self, path: str) -> list[str]:
        """All collections; their names."""
        for name, c in self.collections.items():
            c.save(f"{path}/{name}")
        names = sorted(self.collections)
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_names")
        return names

    def load(self, path: str) -> list[str]:
        names = [r.name for r in self.spark.read.parquet(f"{path}/_names").collect()]  # a name for each collection
        for n in names:
            self.collections[n] = Collection.load(self.spark, f"{path}/{n}", f"{self.folder}/{n}" if self.folder else None)
        return names

    def handle(self, request: Mapping[str, Any]) -> dict[str, Any]:
        """A request as a mapping: action, collection, and the action's own fields; status as of HTTP."""
        try:
            return self._answer(request.get("action"), request.get("collection"), request)
        except KeyError as e:
            return {"status": 400, "error": f"{e.args[0]!r} is missing"}
        except ValueError as e:
            return {"status": 400, "error": str(e)}

    def _answer(self, action: Any, name: Any, request: Mapping[str, Any]) -> dict[str, Any]:
        ok = {"status": 200}
        if action == "health":
            return {**ok, "state": "ok", "collections": len(self.collections)}
        if action == "list":
            return {**ok, "collections": sorted(self.collections)}
        if action == "all_stats":
            return {**ok, "collections": [{"name": n, **c.stats().first().asDict()} for n, c in sorted(self.collections.items())], "cache": self.cache.stats()}
        if action in ("checkpoint", "backup"):
            return {**ok, "saved": self.save(request["path"] if action == "backup" or self.folder is None else f"{self.folder}/_checkpoint")}
        if action == "restore":
            return {**ok, "loaded": self.load(request["path"])}
        if action == "create":
            if name in self.collections:
                return {"status": 409, "error": f"collection {name} exists"}
            self.create(name, request["dimension"])
            return {"status": 201}
        if name not in self.collections:
            return {"status": 404, "error": f"no collection {name}"}
        c = self.collections[name]
        ids = lambda x: self.spark.createDataFrame([(y,) for y in x], "id string")
        if action == "drop":
            self.drop(name)
            return ok
        if action == "info":
            return {**ok, "name": name, "dimension": c.dimension, "version": c.version, "indexes": sorted(c.built)}
        if action == "add":
            return {**ok, "added": c.add_lists(request["vectors"], request.get("ids"), request.get("metadata"), request.get("documents"))}
        if action in ("update", "upsert"):
            row = (request["id"], request.get("vector"), request.get("metadata"), request.get("document"))
            if row[1] is not None and len(row[1]) != c.dimension:
                raise ValueError(f"a vector of {c.dimension} numbers is needed, not of {len(row[1])}")
            r = c.update(self.spark.createDataFrame([row], VECTORS), action == "upsert").first()
            return {"status": 200 if r.success else 404, "success": r.success, "message": r.message, "energy_delta": r.energy_delta}
        if action == "delete":
            told = c.delete(ids(request["ids"]) if "ids" in request else None, request.get("filter"), request.get("hard", False))
            return {**ok, **told.first().asDict()}
        if action == "get":
            row = c.get(request["id"]).first()
            return {**ok, **row.asDict()} if row else {"status": 404, "error": f"no document {request['id']}"}
        if action == "ids":
            return {**ok, "ids": sorted(r.id for r in collection.ids(c.snapshot, request.get("include_deleted", False)).limit(request.get("limit", 1000)).collect())}
        if action == "search":
            return {**ok, "results": self.search_cached(name, request["vector"], request.get("k", 10), request.get("filter")).to_dict("records")}
        if action == "search_batch":
            q = self.spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(request["vectors"])], "query_id long, embedding array<double>")
            return {**ok, "results": c.search(q, request.get("k", 10), request.get("filter")).orderBy("query_id", "rank").toPandas().to_dict("records")}
        if action == "search_energy":
            r = c.search_with_energy(request["vector"], request.get("k", 10))
            return {**ok, **r, "results": r["results"].to_dict("records")}
        if action == "energy":
            rows = [(i, [float(y) for y in x]) for i, x in enumerate(request["vectors"])]
            out = c.energies(self.spark.createDataFrame(rows, "id long, x array<double>")).orderBy("id").collect()
            return {**ok, "energies": [r.energy for r in out], "zones": [r.zone for r in out]}
        if action == "explore":
            return {**ok, "regions": c.explore(request["vector"], request.get("n", 3), min_energy=request.get("min_energy", 0.7))}
        if action == "suggest":
            return {**ok, "suggestions": c.suggest(request.get("n", 3), request.get("min_energy", 0.7))}
        if action == "stats":
            return {**ok, **c.stats().first().asDict()}
        return {"status": 400, "error": f"unknown action {action}"}
