"""Data sources: a binary format of splat summaries, and NumPy arrays.

Binary: a header of four unsigned ints (splats, dimensions, original vectors, levels), then for each splat its mean (float
of each dimension), alpha, kappa, the number of its vectors, and their indices (ints).

Both formats are for paths that every machine sees as files (a mounted share, or a single machine)."""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "mu array<float>, alpha float, kappa float, indices array<int>"


def files_of(path: str) -> list[str]:
    """The files at a path: one, or those of a folder."""
    if os.path.isdir(path):
        return sorted(f for f in glob.glob(os.path.join(path, "*")) if not os.path.basename(f).startswith(("_", ".")))
    return [path]


class SplatFile(DataSource):
    """format("splats"), read and write."""

    @classmethod
    def name(cls) -> str:
        return "splats"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SplatReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SplatWriter(self.options["path"], int(self.options.get("levels", 1)))


class SplatReader(DataSourceReader):
    """A partition for each file."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in files_of(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            head = f.read(16)
            if len(head) < 16:
                raise ValueError(f"{partition.value} has no header")
            n, dim, _, _ = struct.unpack("<IIII", head)
            for _ in range(n):
                mu = np.frombuffer(f.read(4 * dim), "<f4")
                tail = f.read(12)
                if len(mu) < dim or len(tail) < 12:
                    raise ValueError(f"{partition.value} is cut off")
                alpha, kappa, m = struct.unpack("<ffI", tail)
                yield mu.tolist(), alpha, kappa, np.frombuffer(f.read(4 * m), "<i4").tolist()


class Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class SplatWriter(DataSourceWriter):
    """A file for each partition that has rows."""

    def __init__(self, path: str, levels: int):
        self.path, self.levels = path, levels

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        context = TaskContext.get()
        path = os.path.join(self.path, f".part-{context.partitionId():05d}-{context.taskAttemptId()}.bin")
        n = dim = total = 0
        with open(path, "wb") as f:
            f.write(b"\0" * 16)
            for row in iterator:
                mu, indices = np.asarray(row.mu, "<f4"), np.asarray(row.indices or [], "<i4")
                if n and len(mu) != dim:
                    raise ValueError("splats of one file have one dimension")
                n, dim, total = n + 1, len(mu), total + len(indices)
                f.write(mu.tobytes() + struct.pack("<ffI", row.alpha, row.kappa, len(indices)) + indices.tobytes())
            f.seek(0)
            f.write(struct.pack("<IIII", n, dim, total, self.levels))
        if not n:
            os.remove(path)
        return Written(path if n else None)

    def commit(self, messages) -> None:
        """Files get their names when all are there."""
        for m in messages:
            if m and m.path:
                folder, name = os.path.split(m.path)
                os.replace(m.path, os.path.join(folder, name.lstrip(".")))

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class NpySource(DataSource):
    """format("npy"), read and write: arrays of vectors, one row each, with their file and place."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "shard string, position long, vector array<float>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NpyWriter(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options["path"], int(self.options.get("rows", 100_000)))


class NpyReader(DataSourceReader):
    """A partition for so many rows of a file, which is mapped and not loaded."""

    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((f, a)) for f in files_of(self.path) if f.endswith(".npy") for a in range(0, len(np.load(f, mmap_mode="r")), self.rows)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        f, a = partition.value
        x = np.load(f, mmap_mode="r")[a : a + self.rows]
        for i in range(0, len(x), 8192):
            part = np.asarray(x[i : i + 8192], np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(f)] * len(part)), pa.array(np.arange(a + i, a + i + len(part))), lists], ["shard", "position", "vector"])


class NpyWriter(DataSourceWriter):
    """A file for each partition that has rows; names are given when all are there."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        rows = [row.vector for row in iterator]
        if not rows:
            return Written(None)
        context = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        path = os.path.join(self.path, f".part-{context.partitionId():05d}-{context.taskAttemptId()}.npy")
        np.save(path, np.asarray(rows, np.float32))
        return Written(path)

    commit, abort = SplatWriter.commit, SplatWriter.abort


def save_energy(splats: DataFrame, path: str) -> None:
    """The state of an energy landscape: mu, alpha and kappa of its splats."""
    splats.select("splat_id", "mu", "alpha", "kappa").write.mode("overwrite").parquet(path)


def load_energy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SplatFile)
    spark.dataSource.register(NpySource)


def embeddings(spark: SparkSession, path: str, column: str, dim: int) -> DataFrame:
    """The column's vectors, cut to their first components and scaled to length 1."""
    from pyspark.sql import functions as F

    from ..functions.vectors import normalize

    return spark.read.parquet(path).select(normalize(F.slice(column, 1, dim)).cast("array<float>").alias("vector"))


def blobs(spark: SparkSession, n: int, dim: int, centers: int = 200, sigma: float = 0.5, seed: int = 42) -> DataFrame:
    """vec_id, embedding, label: Gaussian clusters around seeded centers."""
    from pyspark.sql import functions as F

    def run(batches):
        import pandas as pd

        mu = np.random.default_rng(seed).normal(size=(centers, dim)) * 3
        for pdf in batches:
            label = pdf["vec_id"].to_numpy() % centers
            x = np.stack([mu[c] + np.random.default_rng([seed, int(i)]).normal(size=dim) * sigma for i, c in zip(pdf["vec_id"], label, strict=True)]) if len(pdf) else np.zeros((0, dim))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "embedding": list(x.astype(np.float32)), "label": label})

    return spark.range(n).select(F.col("id").alias("vec_id")).mapInPandas(run, "vec_id long, embedding array<float>, label long")


def splats_3d(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Seeded 3-D splats: position, color, opacity, scale, rotation."""
    from pyspark.sql import functions as F

    from ..functions.vectors import quat_normalize

    a = lambda f, k, o: F.array(*[f(seed + o + i) for i in range(k)])
    rows = spark.range(n).select(F.col("id").alias("splat_id"), F.transform(a(F.randn, 3, 0), lambda x: x * 10).alias("position"), a(F.rand, 3, 3).alias("color"), F.rand(seed + 6).alias("opacity"), F.transform(a(F.randn, 3, 7), lambda x: F.exp(x - 2)).alias("scale"), a(F.randn, 4, 10).alias("rotation"))
    return rows.withColumn("rotation", quat_normalize(F.col("rotation")))
