"""Operations as a stream: files of operations are applied to a stored snapshot batch by batch.

A batch may come again after a failure: an operation that isn't newer than its row's version changes nothing, so the
snapshot is the same. Each batch writes the snapshot's next version and then moves the pointer to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "lsn long, op string, id string, vector array<float>, metadata string, document string"


def merged(snapshot: DataFrame, ops: DataFrame) -> DataFrame:
    """snapshot: id, vector, metadata, document, deleted, version. Operations that are newer win, field by field."""
    ops = ops.filter("op <> 'checkpoint' and id is not null")
    state = snapshot.select("id", F.col("version").alias("lsn"), F.when(F.col("deleted"), "deleted").otherwise("state").alias("op"), "vector", "metadata", "document")
    newer = ops.join(snapshot.select("id", "version"), "id", "left").filter("version is null or lsn > version").select("id", "lsn", "op", "vector", "metadata", "document")
    rows = state.unionByName(newer)
    born = rows.groupBy("id").agg(F.max(F.when(F.col("op") == "add", F.col("lsn"))).alias("born"))
    live = rows.join(born, "id").filter("born is null or lsn >= born")
    known = live.groupBy("id").agg(F.max(F.col("op").isin("add", "state", "deleted")).alias("known"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & (F.col("op") != "delete"), F.col("lsn"))).alias(c)
    out = live.join(known.filter("known"), "id", "left_semi").groupBy("id").agg(last("vector"), last("metadata"), last("document"), F.max_by(F.col("op").isin("delete", "deleted"), "lsn").alias("deleted"), F.max("lsn").alias("version"))
    return out


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The latest version of the snapshot in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(f"{folder}/v={max(int(n[2:]) for n in done)}") if done else None


def follow(spark: SparkSession, source: str, folder: str, checkpoint: str, max_files: int = 100):
    """Starts a query that applies JSON operations from source to the snapshot in folder."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        base = current(spark, folder)
        if base is None:
            base = spark.createDataFrame([], "id string, vector array<float>, metadata string, document string, deleted boolean, version long")
        merged(base, batch).write.mode("overwrite").parquet(f"{folder}/v={batch_id + 1}")

    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", max_files).json(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_history(metrics: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """node_id, window, n, mean latency of a stream of metrics (ts, node_id, latency_ms); late rows count up to the delay."""
    w = metrics.withWatermark("ts", delay).groupBy("node_id", F.window("ts", window))
    return w.agg(F.count("*").alias("n"), F.avg("latency_ms").alias("latency_ms"))
