"""Cutting lineage through the folder that the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bits of a size estimate beyond which it is forgotten.
MOST_BITS = 60


def ensure_folder(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; a folder of our own only where that is unset and everything is on one machine, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(where or "/tmp/checkpoints")


def saved(df: DataFrame) -> DataFrame:
    """``df``, computed now and kept in the checkpoint folder, with no past."""
    ensure_folder(df.sparkSession)
    return forget_size(df.checkpoint(eager=True))


def forget_size(df: DataFrame) -> DataFrame:
    """A checkpoint keeps the planner's estimate of its size, which joins multiply: over many rounds that number alone fills the
    driver's memory. Once it is absurd, the table is taken up anew without it."""
    if int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes())).bit_length() < MOST_BITS:
        return df
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)
