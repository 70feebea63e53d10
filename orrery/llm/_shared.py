"""What the operators of this subpackage share: the shared folder, written tables, and the reading of columns."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import small_batches

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, with its scheme. Where that is unset a temporary one, if
    driver and executors are one process (as in tests), else this raises, as no machine's own folder is shared."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        base = _own[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="orrery-")
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return ("file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def trim() -> None:
    """Gives a worker's freed memory back to the machine, which the allocators else keep for the worker's life."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts lineage and outlives lost executors."""
    small_batches(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df as a table, with a hint to broadcast it where it has so few rows; where it has more, joins shuffle."""
    df = written(df, "small")
    return F.broadcast(df) if df.count() <= most else df


def drop_table(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more. What a result still reads is its caller's to delete,
    with the folder."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if path.getParent().toUri().getPath() == spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def column(df: DataFrame, name: str) -> Column:
    """The column of that exact name, dots and all."""
    return df[f"`{name}`"]


def doc_columns(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id (long), text and the named extras (null where missing); every other column is left behind."""
    small_batches(docs.sparkSession)
    cols = [column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").cast("string").alias("text")]
    for name in extra:
        cols.append((column(docs, name) if name in docs.columns else F.lit(None)).cast("string").alias(name))
    return docs.select(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
