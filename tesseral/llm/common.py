"""Reading tables, shared storage and the document keys that the operators share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys from here on stand for null ids, one for each text; ids are below it.
NO_ID = 2**62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one if all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tesseral-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, kind: str) -> str:
    """An unused path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended, and with it the folder's use
        pass


def stash(df: DataFrame, kind: str) -> DataFrame:
    """df, computed once and reread from a table in the shared folder: later failures do not reach behind it."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash = path
    return out


def drop_stash(*frames: DataFrame) -> None:
    """Frees the disk of stashes that nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df._stash)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def key(id_col: str, text_col: str) -> Column:
    """Orders documents: the id, or for a null id a number above all ids that the text decides."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text_of(text_col)), 2))


def key_columns(id_col: str, text_col: str) -> list[Column]:
    """k, th, text: k orders documents, th tells apart texts under one id. Equal rows are the same document."""
    return [key(id_col, text_col).alias("k"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text")]


def id_of(column: str = "k") -> Column:
    """The document id behind a key; null for a key that stands for a null id."""
    return F.when(F.col(column) < F.lit(NO_ID), F.col(column))


def keep_fraction(bound: int, total: int) -> float:
    return min(1.0, bound / max(1, total))


def uniform(*columns: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that only the columns' values decide, so a recomputed task draws the same rows."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(2**53))
