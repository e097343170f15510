from datetime import datetime, timedelta

from stmtlog.sources.events_log import TEMPLATES
from stmtlog.sources.statement_log import LOG_SCHEMA

F = {i: t for i, t in enumerate(TEMPLATES, 1)}
F[24] = F[20] + " /* " + "x" * 192 + " */"
TEN = datetime(2024, 3, 4, 10, 0, 0)


def at(seconds=0.0):
    return TEN + timedelta(seconds=seconds)


def make_log(spark, rows):
    """rows: (id, text, schema, time)."""
    return spark.createDataFrame(rows, LOG_SCHEMA)
