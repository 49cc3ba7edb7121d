"""Event-time operators over streams of events; the same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event times with a zone, which watermarks need; the session runs in UTC."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(df: DataFrame, width: str, by: list[str], late: str = "1 hour", column: str = "ts", value: str = "value") -> DataFrame:
    return sliding(df, width, width, by, late, column, value)


def sliding(df: DataFrame, width: str, step: str, by: list[str], late: str = "1 hour", column: str = "ts", value: str = "value") -> DataFrame:
    """Counts and means by window and key; events later than ``late`` behind the newest are dropped in a stream."""
    timed = with_time(df, column).withWatermark(column, late)
    out = timed.groupBy(F.window(column, width, step).alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "mean")


def sessions(df: DataFrame, gap: str, by: str, late: str = "1 hour", column: str = "ts") -> DataFrame:
    """Runs of a key's events that are less than ``gap`` apart."""
    timed = with_time(df, column).withWatermark(column, late)
    out = timed.groupBy(F.session_window(column, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of(df: DataFrame, key: list[str], late: str = "1 hour", column: str = "ts") -> DataFrame:
    """Repeats of a key within the watermark are dropped."""
    timed = with_time(df, column).withWatermark(column, late)
    return timed.dropDuplicatesWithinWatermark(key) if timed.isStreaming else timed.dropDuplicates(key)


def running(df: DataFrame, key: str, value: str = "value", kind: str = "string") -> DataFrame:
    """``key, n, total`` of all events of a key so far, whenever some come: a state of two numbers for each key. Batch tables give the last row of each."""
    if not df.isStreaming:
        return df.groupBy(key).agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).cast("double").alias("total"))

    def add(keys, frames, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total]})

    ddl = f"{key} {kind}, n long, total double"
    return df.select(key, value).groupBy(key).applyInPandasWithState(add, ddl, "n long, total double", "update", "NoTimeout")
