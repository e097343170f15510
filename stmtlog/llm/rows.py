"""Row numbers on which all reads of a table agree."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtlog.plans.stage import stage, stage_numbered

#: Bits of a row's number in its file.
ROWS = 40


def numbered(docs: DataFrame, name: str, number: str, *columns: str) -> DataFrame:
    """The ``columns`` of ``docs`` with a number of each row in the column ``number``.

    Rows read from files are numbered by file and place in it, however the files are cut into tasks; nothing is copied.
    Rows that come otherwise are written once with their number.
    """
    try:
        placed = docs.select(*columns, F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__index"))
    except AnalysisException:
        return stage_numbered(docs.select(*columns), name, number)
    files = placed.select("__path").distinct()
    files = stage(files.withColumn("__file", F.row_number().over(Window.orderBy("__path")).cast("bigint")), "files")
    joined = placed.join(files, "__path")
    return joined.select(*columns, F.shiftleft("__file", ROWS).bitwiseOR(F.col("__index")).alias(number))
