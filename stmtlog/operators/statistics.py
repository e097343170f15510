"""Counts over the labelled log.

Every function takes the labelled log itself or its ``activity`` summary, which holds the same
rows counted per label, schema and hour in column ``n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtlog.operators.labels import CHECK, FIX

TIME = "last_load_time"


def activity(labelled: DataFrame, *by: Column) -> DataFrame:
    """One pass over the log: statements per purpose, sub_type, schema, day and hour, and ``by``, with time bounds."""
    return labelled.groupBy(
        "purpose", "sub_type", "parsing_schema_name", F.to_date(TIME).alias("day"), F.hour(TIME).alias("hour"), *by
    ).agg(F.count("*").alias("n"), F.min(TIME).alias("first_time"), F.max(TIME).alias("last_time"))


def _n(data: DataFrame) -> Column:
    return F.col("n") if "n" in data.columns else F.lit(1)


def _total(data: DataFrame, test: Column | None = None) -> Column:
    value = _n(data) if test is None else F.when(test, _n(data))
    return F.coalesce(F.sum(value), F.lit(0)).cast("long")


def purpose_counts(data: DataFrame) -> DataFrame:
    """Statements per purpose with their share in percent.

    The total is a scalar subquery over the same counts, whose shuffle it reuses.
    """
    counts = data.groupBy("purpose").agg(_total(data).alias("n_statements"))
    total = counts.agg(F.sum("n_statements")).scalar()
    return counts.withColumn("percentage", F.col("n_statements") / total * 100).orderBy(
        F.desc("n_statements"), "purpose"
    )


def schema_counts(data: DataFrame) -> DataFrame:
    """Statements per schema, nulls left out."""
    return (
        data.filter(F.col("parsing_schema_name").isNotNull())
        .groupBy("parsing_schema_name")
        .agg(_total(data).alias("n_statements"))
        .orderBy(F.desc("n_statements"), "parsing_schema_name")
    )


def statement_totals(data: DataFrame) -> DataFrame:
    return data.agg(
        _total(data).alias("total_statements"),
        _total(data, F.col("purpose") == CHECK).alias("total_checks"),
        _total(data, F.col("purpose") == FIX).alias("total_fixes"),
    )


def sequence_totals(sequences: DataFrame) -> DataFrame:
    return sequences.agg(
        F.count("*").alias("discovered_sequences"),
        F.count_distinct("issue_type").alias("unique_issue_types"),
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """Put one-row results side by side; the later ones are scalar subqueries."""
    first, *rest = parts
    names = list(first.columns)
    for i, part in enumerate(rest):
        row = part.select(F.struct(*part.columns).alias("r")).scalar()
        first = first.withColumn(f"_part{i}", row)
    return first.select(
        *names, *[F.col(f"_part{i}.{c}").alias(c) for i, part in enumerate(rest) for c in part.columns]
    )


def integrity_counts(data: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row: checks, fixes, discovered sequences and their distinct issue types."""
    return one_row(
        statement_totals(data).select("total_checks", "total_fixes"), sequence_totals(sequences)
    )


def date_range(data: DataFrame) -> DataFrame:
    low, high = ("first_time", "last_time") if "n" in data.columns else (TIME, TIME)
    return data.agg(
        _total(data).alias("total_statements"),
        F.min(low).alias("start_time"),
        F.max(high).alias("end_time"),
    )


def analysis_summary(data: DataFrame, sequences: DataFrame) -> DataFrame:
    return one_row(
        date_range(data), statement_totals(data).select("total_checks", "total_fixes"), sequence_totals(sequences)
    )


def _timed(data: DataFrame) -> DataFrame:
    """Rows with a time, as day and hour by the wall clock."""
    if "n" not in data.columns:
        data = data.withColumns({"day": F.to_date(TIME), "hour": F.hour(TIME)})
    return data.filter(F.col("day").isNotNull())


def _timed_integrity(data: DataFrame) -> DataFrame:
    return _timed(data).filter(F.col("purpose").isin(CHECK, FIX))


def hourly_counts(data: DataFrame) -> DataFrame:
    return _timed(data).groupBy("hour").agg(_total(data).alias("n_statements")).orderBy("hour")


def daily_counts(data: DataFrame) -> DataFrame:
    return _timed(data).groupBy("day").agg(_total(data).alias("n_statements")).orderBy("day")


def _integrity_pivot(data: DataFrame, key: str) -> DataFrame:
    sides = [_total(data, F.col("purpose") == purpose).alias(purpose) for purpose in (CHECK, FIX)]
    return _timed_integrity(data).groupBy(key).agg(*sides).orderBy(key)


def hourly_pivot(data: DataFrame) -> DataFrame:
    """Checks and fixes per hour of the day, side by side, 0 where there are none."""
    return _integrity_pivot(data, "hour")


def daily_pivot(data: DataFrame) -> DataFrame:
    """Checks and fixes per day, side by side, 0 where there are none."""
    return _integrity_pivot(data, "day")


def weekly_trends(data: DataFrame, k: int = 10) -> DataFrame:
    """Checks and fixes per week (Monday to Sunday) and sub_type; above the mean is ``increasing``.

    The mean over all (week, sub_type) groups is a scalar subquery that reuses their shuffle.
    """
    monday = F.date_sub("day", F.weekday("day"))
    counts = (
        _timed_integrity(data)
        .groupBy(monday.alias("week_start"), F.coalesce("sub_type", F.lit("")).alias("issue_type"))
        .agg(_total(data).alias("n_statements"))
    )
    mean = counts.agg(F.avg("n_statements")).scalar()
    return (
        counts.withColumn("trend", F.when(F.col("n_statements") > mean, "increasing").otherwise("stable"))
        .select(
            F.concat_ws(
                "/", F.col("week_start").cast("string"), F.date_add("week_start", 6).cast("string")
            ).alias("period"),
            "issue_type",
            "n_statements",
            "trend",
        )
        .orderBy(F.desc("n_statements"), "period", "issue_type")
        .limit(k)
    )


def sample_statements(labelled: DataFrame, purposes: str | list[str], size: int = 100, seed: int = 0) -> DataFrame:
    """``size`` statements of each purpose by hashed identity: repeatable, whatever the partitioning.

    The log is labelled once for all purposes; each task drops all but its own first rows before the shuffle.
    """
    lot = F.md5(F.concat_ws("|", F.lit(str(seed)), "sql_id", "parsing_schema_name", F.col(TIME).cast("string")))
    place = F.row_number().over(Window.partitionBy("purpose").orderBy("lot", "sql_fulltext"))
    return (
        labelled.filter(F.col("purpose").isin(purposes))
        .select("purpose", "sql_id", "sql_fulltext", "parsing_schema_name", TIME, "sub_type", lot.alias("lot"))
        .withColumn("place", place)
        .filter(F.col("place") <= size)
        .select("sql_id", "sql_fulltext", "parsing_schema_name", TIME, "sub_type")
    )
