"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent (tests, notebooks) a local one is made
    and remembered in the session, so later calls find the same folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quantalume-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor afterwards costs a re-read, never a
    recomputation. Only this folder is used, never a machine-local one.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quantalume/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quantalume_path = path
    return out


def drop_table(*tables: DataFrame) -> None:
    """Delete the files behind tables that :func:`materialize` made.

    Only for tables whose readers have been written themselves: nothing that is
    still to run, or to run again after a lost executor, may need them. The
    collection lets Spark's cleaner delete shuffle files that nothing refers to.
    """
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._quantalume_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def release_memory() -> None:
    """Give a Python worker's free memory back to the system.

    Workers are kept for later tasks; what earlier stages allocated and freed
    would else count beside what the next stage needs.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name
