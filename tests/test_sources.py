import pytest
from helpers import at
from pyspark.sql import functions as F

from stmtlog.sources import statement_log as L


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_by_name_with_texts_over_lines(spark, tmp_path):
    text = (
        "EXTRA,SQL_FULLTEXT,LAST_LOAD_TIME,SQL_ID,PARSING_SCHEMA_NAME\n"
        '1,"SELECT ""a"", b\nFROM t\r\nWHERE c = \'x,y\'",2024-03-04 10:00:00,q1,APP\n'
        "2,SELECT 1,2024-03-04/10:00:00,q2,NULL\n"
        "3,SELECT 2,soon,q3,APP\n"
        "4,SELECT 3,,q4,\n"
    )
    rows = L.read_csv(spark, write(tmp_path / "log.csv", text)).orderBy("sql_id").collect()
    assert [tuple(r) for r in rows] == [
        ("q1", "SELECT \"a\", b\nFROM t\r\nWHERE c = 'x,y'", "APP", at()),
        ("q2", "SELECT 1", None, at()),
        ("q3", "SELECT 2", "APP", None),
        ("q4", "SELECT 3", None, None),
    ]


def test_missing_column_is_an_error(spark, tmp_path):
    path = write(tmp_path / "log.csv", "SQL_ID,SQL_FULLTEXT,LAST_LOAD_TIME\n1,SELECT 1,2024-01-01\n")
    with pytest.raises(ValueError, match="PARSING_SCHEMA_NAME"):
        L.read_csv(spark, path)


def test_files_with_another_column_order_fail(spark, tmp_path):
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "a.csv", "SQL_ID,SQL_FULLTEXT,PARSING_SCHEMA_NAME,LAST_LOAD_TIME\n1,SELECT 1,A,2024-01-01\n")
    write(tmp_path / "d" / "b.csv", "SQL_FULLTEXT,SQL_ID,PARSING_SCHEMA_NAME,LAST_LOAD_TIME\nSELECT 2,2,A,2024-01-01\n")
    with pytest.raises(Exception, match="CSV header"):
        L.read_csv(spark, str(tmp_path / "d")).collect()


def test_parquet_and_table_are_pruned_to_the_contract(spark, tmp_path):
    data = spark.sql(
        "SELECT 'q' AS Sql_Id, 'SELECT 1' AS sql_fulltext, 'A' AS parsing_schema_name, "
        "TIMESTAMP_NTZ'2024-03-04 10:00:00' AS last_load_time, 7 AS other"
    )
    data.write.parquet(str(tmp_path / "log"))
    log = L.read_parquet(spark, str(tmp_path / "log"))
    assert log.columns == L.LOG_COLUMNS and tuple(log.first()) == ("q", "SELECT 1", "A", at())
    plan = log._jdf.queryExecution().executedPlan().toString()
    assert "other" not in plan[plan.index("ReadSchema") :]
    data.createOrReplaceTempView("some_log")
    assert L.read_table(spark, "some_log").collect() == log.collect()


@pytest.mark.parametrize("zone", ["America/New_York", "UTC", "Asia/Kolkata"])
def test_times_are_wall_clock_in_any_zone(spark, tmp_path, zone):
    """Also 02:30 of the night in which New York has no such time."""
    spellings = ["2024-03-10 02:30:00", "2024-03-10/02:30:00", "03/10/2024 02:30:00", "10-Mar-2024 02:30:00"]
    rows = "".join(f"q{i},SELECT 1,A,{t}\n" for i, t in enumerate([*spellings, "1969-12-31/23:59:59"]))
    path = write(tmp_path / "log.csv", "SQL_ID,SQL_FULLTEXT,PARSING_SCHEMA_NAME,LAST_LOAD_TIME\n" + rows)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for multi_line in (True, False):
            times = L.read_csv(spark, path, multi_line=multi_line).orderBy("sql_id").select(F.col("last_load_time").cast("string"))
            assert [r[0] for r in times.collect()] == ["2024-03-10 02:30:00"] * 4 + ["1969-12-31 23:59:59"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
