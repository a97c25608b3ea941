"""Reading inputs and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where that is unset and the master is local."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="vexel-")
    conf.set("spark.checkpoint.dir", made)
    spark.sparkContext._conf.set("spark.checkpoint.dir", made)
    return made


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone when Python ends
        pass


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lost executors lose no part of it. It goes when Python ends.

    Zstandard, as Parquet's Snappy writers leave buffers outside the heap that only a later collection frees.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vexel/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not keep:
        atexit.register(_remove_quietly, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.vexel_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a written() table that nothing reads any more."""
    _remove(df.sparkSession, df.vexel_path)


def n_words(text):
    """The number of [^\\x20\\x09-\\x0D]+ in a text column; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


#: Up to so many groups, join_groups() broadcasts them; beyond, it deals a group's rows over SALTS parts.
BROADCAST_GROUPS, SALTS = 200_000, 64


def join_groups(rows: DataFrame, groups: DataFrame, same: Column, salt: Column, most: int = BROADCAST_GROUPS) -> DataFrame:
    """rows with the group that each belongs to; groups is written, one narrow row each, and any may have most of the rows."""
    if groups.count() <= most:
        return rows.join(F.broadcast(groups), same)
    dealt = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(dealt, same & (F.col("_salt") == F.col("_part"))).drop("_salt", "_part")
