"""Collections: rows (id, vector, metadata, document, deleted, version) that operations change, and the log of operations.

Every operation gives a new snapshot; among rows of one id the latest wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .energy import energies

SCHEMA = "id string, vector array<float>, metadata string, document string, deleted boolean, version long"
COLUMNS = ["id", "vector", "metadata", "document", "deleted", "version"]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def latest(rows: DataFrame, key: str = "id", order: str = "version") -> DataFrame:
    """The row of greatest order of each key; a partial maximum is taken before the shuffle."""
    cols = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in cols])


def batch(rows: DataFrame, version: int) -> DataFrame:
    """Rows as a batch of a collection: missing ids are random UUIDs, missing columns null."""
    has = set(rows.columns)
    pick = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    ids = F.coalesce(F.col("id").cast("string"), F.uuid()) if "id" in has else F.uuid()
    return rows.select(ids.alias("id"), pick("vector", "array<float>"), F.coalesce(pick("metadata", "string"), F.lit("{}")).alias("metadata"), pick("document", "string"), F.lit(False).alias("deleted"), F.lit(version).cast("long").alias("version"))


def add(snapshot: DataFrame, rows: DataFrame, version: int) -> DataFrame:
    """Later rows of an id replace earlier ones, deleted or not."""
    return latest(snapshot.unionByName(batch(rows, version)))


def update(snapshot: DataFrame, changes: DataFrame, version: int, upsert: bool = False, dimension: int | None = None) -> DataFrame:
    """changes: id and any of vector, metadata, document; null leaves a field as it is. Deleted or absent ids change
    nothing, unless upsert is set: then they come anew, with what is given, and where no vector is, with zeros of the
    dimension (that of the snapshot's longest vector, unless it is named)."""
    c = changes.select("id", *[(F.col(x) if x in changes.columns else F.lit(None)).alias("new_" + x) for x in ("vector", "metadata", "document")], F.lit(True).alias("hit"))
    j = snapshot.join(c, "id", "full" if upsert else "left")
    hit, gone = F.coalesce(F.col("hit"), F.lit(False)), F.coalesce(F.col("deleted"), F.lit(True))
    live = hit & (F.lit(upsert) | ~gone)
    width = F.lit(dimension)
    if upsert and dimension is None:
        j, width = j.crossJoin(snapshot.agg(F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width"))), F.col("width")
    zero = F.array_repeat(F.lit(0.0).cast("float"), F.coalesce(width, F.lit(0)))
    vector = F.col("new_vector").cast("array<float>")
    new = lambda x: F.when(live & gone, F.col("new_" + x)).when(live, F.coalesce(F.col("new_" + x), F.col(x))).otherwise(F.col(x)).alias(x)
    return j.select(
        "id",
        F.when(live & gone, F.coalesce(vector, zero)).when(live, F.coalesce(vector, F.col("vector"))).otherwise(F.col("vector")).alias("vector"),
        F.coalesce(new("metadata"), F.lit("{}")).alias("metadata"),
        new("document"),
        F.when(live, F.lit(False)).otherwise(F.col("deleted")).alias("deleted"),
        F.when(live, F.lit(version)).otherwise(F.col("version")).cast("long").alias("version"),
    )


def update_status(snapshot: DataFrame, ids: DataFrame) -> DataFrame:
    """id, status: what an update without upsert would say of each id."""
    j = ids.select("id").distinct().join(snapshot.select("id", "deleted"), "id", "left")
    return j.select("id", F.when(F.col("deleted").isNull(), "not found").when(F.col("deleted"), "is deleted").otherwise("updated").alias("status"))


def update_result(snapshot: DataFrame, changes: DataFrame, splats: DataFrame, upsert: bool = False) -> DataFrame:
    """id, success, message, energy_delta: what an update says of each id; where it gives a live row another vector, by how
    much the energy at its vector changes, else 0."""
    c = changes.select("id", (F.col("vector") if "vector" in changes.columns else F.lit(None)).cast("array<float>").alias("new"))
    j = c.join(snapshot.select("id", "vector", "deleted"), "id", "left")
    moved = j.filter("deleted = false and new is not null and vector is not null")
    both = moved.select("id", F.explode(F.array(F.struct(F.lit(1.0).alias("sign"), F.col("new").alias("x")), F.struct(F.lit(-1.0).alias("sign"), F.col("vector").alias("x")))).alias("e"))
    points = both.select(F.concat(F.when(F.col("e.sign") > 0, "+").otherwise("-"), "id").alias("id"), "e.x")
    e = energies(points, splats).select(F.substr("id", F.lit(2)).alias("id"), F.when(F.col("id").startswith("+"), F.col("energy")).otherwise(-F.col("energy")).alias("e"))
    delta = e.groupBy("id").agg(F.sum("e").alias("energy_delta"))
    message = F.when(F.col("deleted").isNull(), "upserted" if upsert else "not found").when(F.col("deleted"), "restored and upserted" if upsert else "is deleted").otherwise("updated")
    return j.join(delta, "id", "left").select("id", (F.lit(upsert) | (message == "updated")).alias("success"), message.alias("message"), F.coalesce("energy_delta", F.lit(0.0)).alias("energy_delta"))


def delete_result(snapshot: DataFrame, ids: DataFrame, splats: DataFrame) -> DataFrame:
    """One row: how many of the ids there are, and the sum of the energies at their vectors."""
    gone = snapshot.join(ids.select("id").distinct(), "id", "left_semi")
    freed = energies(gone.select("id", F.col("vector").alias("x")), splats).agg(F.coalesce(F.sum("energy"), F.lit(0.0)).alias("energy_freed"))
    return gone.agg(F.count("*").alias("deleted")).crossJoin(freed)


def delete(snapshot: DataFrame, ids: DataFrame, hard: bool = False) -> DataFrame:
    """Soft: the rows are marked; hard: they go."""
    gone = ids.select("id").distinct()
    if hard:
        return snapshot.join(gone, "id", "left_anti")
    marked = snapshot.join(gone.withColumn("gone", F.lit(True)), "id", "left")
    return marked.withColumn("deleted", F.col("deleted") | F.coalesce("gone", F.lit(False))).drop("gone")


def delete_where(snapshot: DataFrame, where, hard: bool = False) -> DataFrame:
    return snapshot.filter(~where) if hard else snapshot.withColumn("deleted", F.col("deleted") | where)


def active(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter(~F.col("deleted"))


def get(snapshot: DataFrame, key: str) -> DataFrame:
    return active(snapshot).filter(F.col("id") == key)


def ids(snapshot: DataFrame, include_deleted: bool = False) -> DataFrame:
    return (snapshot if include_deleted else active(snapshot)).select("id")


def stats(snapshot: DataFrame) -> DataFrame:
    """total, active, deleted."""
    return snapshot.agg(F.count("*").alias("total"), F.count_if(~F.col("deleted")).alias("active"), F.count_if(F.col("deleted")).alias("deleted"))


# log of operations: lsn, op (add, update, delete, checkpoint), id, vector, metadata, document


def placed(rows: DataFrame, name: str, *order, first: int = 1) -> DataFrame:
    """rows with their place in an order: sorted ranges, each of which begins where the counts of those before it end.
    Counts, a number for each range, come to the driver; the sorted rows are kept so that both passes see the same."""
    at, low = F.col("place_id"), 2**33 - 1
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_id", F.monotonically_increasing_id()).persist()
    starts, total = [], first
    for part, n in sorted(map(tuple, ranges.groupBy(F.shiftright("place_id", 33).alias("part")).count().collect())):
        starts.append((part, total))
        total += n
    begin = F.coalesce(*[F.when(F.shiftright(at, 33) == p, F.lit(s)) for p, s in starts]) if len(starts) < 100 else F.create_map(*[F.lit(x) for y in starts for x in y])[F.shiftright(at, 33)]
    return ranges.withColumn(name, (begin if starts else F.lit(first)) + at.bitwiseAND(low)).drop("place_id")


def numbered(log: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """Log sequence numbers in an order."""
    return placed(log, "lsn", *order, first=first)


def replay(log: DataFrame, upto: int | None = None) -> DataFrame:
    """The snapshot that a log leads to: of each id the last add or delete, and each field's last value since the last add."""
    ops = log.filter(F.col("op") != "checkpoint")
    if upto is not None:
        ops = ops.filter(F.col("lsn") <= upto)
    adds = F.max(F.when(F.col("op") == "add", F.col("lsn"))).over(W.partitionBy("id"))
    since = ops.withColumn("born", adds).filter(F.col("lsn") >= F.col("born"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & F.col("op").isin("add", "update"), F.col("lsn"))).alias(c)
    return since.groupBy("id").agg(last("vector"), last("metadata"), last("document"), F.max_by(F.col("op") == "delete", "lsn").alias("deleted"), F.max("lsn").alias("version"))


def truncate(log: DataFrame, lsn: int) -> DataFrame:
    return log.filter(F.col("lsn") >= lsn)


def checkpoint_row(log: DataFrame) -> DataFrame:
    """The log with a checkpoint behind its last entry."""
    mark = log.agg((F.coalesce(F.max("lsn"), F.lit(0)) + 1).alias("lsn")).select("lsn", F.lit("checkpoint").alias("op"))
    return log.unionByName(mark, allowMissingColumns=True)


def backup(df: DataFrame, folder: str, stamp: str) -> str:
    path = f"{folder.rstrip('/')}/snapshot_{stamp}"
    df.write.mode("errorifexists").parquet(path)
    return path


def restore(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def export_batches(splats: DataFrame, size: int, by_kappa: bool = True, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """Rows with position and batch_id, by kappa from the top, then id; noise is the deviation of what is added to mu."""
    order = [F.desc("kappa"), F.asc("splat_id")] if by_kappa else [F.asc("splat_id")]
    out = placed(splats, "position", *order).withColumn("batch_id", F.floor((F.col("position") - 1) / size))
    if noise:
        # two uniform numbers of a component's hash make a normal one, the same in every run
        u = lambda i, salt: (F.pmod(F.xxhash64("splat_id", i, F.lit(seed), F.lit(salt)), F.lit(2**31)) + 1) / F.lit(float(2**31 + 1))
        out = out.withColumn("mu", F.transform("mu", lambda x, i: x + noise * F.sqrt(-2 * F.log(u(i, 0))) * F.cos(2 * F.lit(3.141592653589793) * u(i, 1))))
    return out


class Catalog:
    """Collections by name, on the driver."""

    def __init__(self, spark: SparkSession):
        self.spark, self.snapshots, self.info = spark, {}, {}

    def create(self, name: str, dimension: int, mode: str = "standard") -> None:
        if name in self.snapshots:
            raise ValueError(f"collection {name} exists")
        if mode not in ("edge", "standard", "ebm"):
            raise ValueError(f"unknown mode {mode}")
        self.snapshots[name], self.info[name] = empty(self.spark), {"dimension": dimension, "mode": mode, "version": 0}

    def get(self, name: str) -> DataFrame:
        if name not in self.snapshots:
            raise KeyError(name)
        return self.snapshots[name]

    def put(self, name: str, snapshot: DataFrame) -> None:
        self.get(name)
        self.info[name]["version"] += 1
        self.snapshots[name] = snapshot
        snapshot.createOrReplaceTempView(name)

    def list(self) -> list[str]:
        return sorted(self.snapshots)

    def delete(self, name: str) -> None:
        self.get(name)
        del self.snapshots[name], self.info[name]
