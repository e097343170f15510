"""The activity of a growing log, kept by day.

The log comes in day partitions, such as a table written with partitionBy("log_day").  The summary is partial counts per
label, schema and hour, a partition for each of the log's days; all statistics take it in place of the log, as they
add counts up.  A refresh reads the days that are new or have grown, and replaces their partitions whole, so it can be
repeated.  Rows of a day may carry times of other days, or none.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlog.operators import labels, statistics


def read_summary(spark, folder: str) -> DataFrame | None:
    """The summary as the ``activity`` that statistics take; None if there is none yet."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None


def days_to_read(log: DataFrame, summary: DataFrame | None, day: str) -> list:
    """The days of the log whose number of rows differs from the summary's; reads no column but the partition's.

    The driver gets a number for each day.
    """
    rows = log.groupBy(day).agg(F.count("*").alias("rows"))
    if summary is None:
        return sorted(r[day] for r in rows.filter(F.col(day).isNotNull()).collect())
    known = summary.groupBy(day).agg(F.sum("n").alias("known"))
    grown = rows.join(known, day, "left").filter(F.col(day).isNotNull() & ~F.col("rows").eqNullSafe(F.col("known")))
    return sorted(r[day] for r in grown.collect())


def refresh(log: DataFrame, folder: str, day: str = "log_day", days: list | None = None, strict_tables: bool = False) -> list:
    """Bring the summary in ``folder`` up to the log and return the days that were read.

    ``days``: read these, for instance those of corrected files with as many rows as before.
    """
    spark = log.sparkSession
    if days is None:
        days = days_to_read(log, read_summary(spark, folder), day)
    if days:
        labelled = labels.label_statements(log.filter(F.col(day).isin(days)), strict_tables)
        counts = statistics.activity(labelled, F.col(day)).repartition(day)
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(folder)
    return days
