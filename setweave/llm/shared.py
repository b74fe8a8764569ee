"""Small helpers that every operator of this subpackage uses."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The white space of every contract of this subpackage: \x20 and \x09-\x0D.
WHITESPACE = " \t\n\x0b\x0c\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where a local session names none, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="setweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._setweave_path = path
    return out


_written: list[str] = []


def clean(spark: SparkSession) -> None:
    """Delete every table that this process has written to the shared folder; results that read them end too."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads."""
    for t in tables:
        if path := getattr(t, "_setweave_path", None):
            _delete(t.sparkSession, path)
            _written.remove(path)


def release(spark: SparkSession) -> None:
    """Let the driver drop plans that nothing refers to any more, so that their shuffle files go."""
    gc.collect()
    spark._jvm.System.gc()


#: Longs that a join may broadcast; counted before it does.
MOST_BROADCAST_LONGS = 1_000_000


def few(table: DataFrame, columns: int = 1) -> DataFrame:
    """``table`` (written, with so many columns of longs), marked for broadcast if its longs are few enough."""
    return F.broadcast(table) if columns * table.count() <= MOST_BROADCAST_LONGS else table


def rows_with(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``keys``: few keys go to the rows, else both are shuffled."""
    return df.join(few(keys), column, "left_semi")


def rows_without(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return df.join(few(keys), column, "left_anti")


def project(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns (with whatever names) can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
