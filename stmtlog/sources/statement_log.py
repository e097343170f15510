"""Readers that bring a statement log to its four-column contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlog.functions import patterns as P

LOG_COLUMNS = ["sql_id", "sql_fulltext", "parsing_schema_name", "last_load_time"]
LOG_SCHEMA = (
    "sql_id string, sql_fulltext string, parsing_schema_name string, last_load_time timestamp_ntz"
)
# Tried after the ISO spellings; the first is how databases often print the load time of a statement.
TIME_FORMATS = ("yyyy-MM-dd/HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd-MMM-yyyy HH:mm:ss")


def _time(text: Column, formats: Sequence[str]) -> Column:
    """Wall-clock time: read as if at UTC and taken apart again, so the session's time zone plays no part."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    tries = [text.try_cast("timestamp_ntz")]
    for f in formats:
        at_utc = F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{f} xx"))
        tries.append(epoch + F.make_dt_interval(secs=(F.unix_micros(at_utc) / F.lit(1_000_000)).cast("decimal(18,6)")))
    return F.coalesce(*tries)


def conform(data: DataFrame, formats: Sequence[str] = TIME_FORMATS) -> DataFrame:
    """Keep the four columns, found by name in any case; a missing one is an error.

    A time that cannot be read becomes null.
    """
    kinds = dict(data.dtypes)
    by_name = {c.lower(): c for c in data.columns}
    missing = [c.upper() for c in LOG_COLUMNS if c not in by_name]
    if missing:
        raise ValueError(f"statement log lacks {', '.join(missing)}")
    out = []
    for name in LOG_COLUMNS:
        source = F.col(f"`{by_name[name]}`")
        if name != "last_load_time":
            source = source.cast("string")
        elif kinds[by_name[name]] == "string":
            source = _time(source, formats)
        else:
            source = source.cast("timestamp_ntz")
        out.append(source.alias(name))
    return data.select(*out)


def read_csv(
    spark: SparkSession, path: str | list[str], formats: Sequence[str] = TIME_FORMATS, multi_line: bool = True
) -> DataFrame:
    """Read exported CSV whose statement texts may span lines.

    The columns are taken by header name, everything is read as text, and ``enforceSchema``
    is off so that files with another column order fail instead of being misread.  A file with
    texts over several lines cannot be split; give large logs as many files, as parquet, or, where no text holds
    a line end, with ``multi_line=False``, which splits files.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        .option("enforceSchema", False)
        .csv(path)
    )
    missing = [F.lit(t) for t in P.MISSING_TEXTS]
    log = conform(raw, formats)
    return log.select(
        *[F.when(~F.col(c).isin(*missing), F.col(c)).alias(c) for c in LOG_COLUMNS[:3]],
        "last_load_time",
    )


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    return conform(spark.read.parquet(*paths))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return conform(spark.table(name))

