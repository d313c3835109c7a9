"""Sessions, tables and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def session(name: str = "corpusmill", **conf: str) -> SparkSession:
    """A session with the settings that results depend on; further settings as keywords."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions, as one small file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < min(cores, 64) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; set here only if unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpusmill-"))
        where = sc._jsc.sc().getCheckpointDir().get()
    return str(where)


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, hot_rows: int = 2000, spread: int = 4096) -> DataFrame:
    """Inner join with ``right``, which has one row a key and, in ``weight``, the rows of ``left`` that carry it.

    Rows of a hot key are dealt over several tasks by their hash, and its row of ``right`` goes to
    each; a key beyond the ``spread`` most frequent has at most rows / ``spread`` rows.
    """
    hot = right.where(F.col(weight) > hot_rows).select(key, F.least(F.ceil(F.col(weight) / hot_rows), F.lit(spread)).cast("int").alias("_deal"))
    hot = F.broadcast(hot.orderBy(F.desc("_deal"), key).limit(spread))
    dealt = left.join(hot, key, "left").withColumn("_at", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_deal")).cast("int"), F.lit(0)))
    given = right.drop(weight).join(hot, key, "left").withColumn("_at", F.explode(F.sequence(F.lit(0), F.coalesce("_deal", F.lit(1)) - 1)))
    return dealt.drop("_deal").join(given.drop("_deal"), [key, "_at"]).drop("_at")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone
        pass
