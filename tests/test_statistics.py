from datetime import datetime

import pytest
from helpers import F as TEXT
from helpers import make_log
from pyspark.sql import functions as F

from stmtlog.operators import labels
from stmtlog.operators import statistics as S
from stmtlog.sources.events_log import events_log

FUNCTIONS = [
    S.purpose_counts, S.schema_counts, S.statement_totals, S.date_range, S.hourly_counts, S.daily_counts,
    S.hourly_pivot, S.daily_pivot, S.weekly_trends,
]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labelled(spark):
    log = events_log(spark, SF, "real")
    # a fifth without schema, a seventh without time
    holes = log.select(
        "sql_id",
        "sql_fulltext",
        F.when(F.crc32("sql_id") % 5 != 0, F.col("parsing_schema_name")).alias("parsing_schema_name"),
        F.when(F.crc32("sql_id") % 7 != 0, F.col("last_load_time")).alias("last_load_time"),
    )
    return labels.label_statements(holes).cache()


@pytest.mark.parametrize("function", FUNCTIONS, ids=lambda f: f.__name__)
def test_same_from_log_and_summary_and_any_partitioning(spark, labelled, function):
    want = function(labelled).collect()
    assert want
    assert function(S.activity(labelled)).collect() == want
    assert function(labelled.repartition(13)).collect() == want
    assert function(labelled.coalesce(1)).collect() == want


def test_rows_without_time_or_schema_are_left_out(labelled):
    total = labelled.count()
    with_time = labelled.filter("last_load_time IS NOT NULL").count()
    with_schema = labelled.filter("parsing_schema_name IS NOT NULL").count()
    assert with_time < total and with_schema < total

    def sums(data):
        return sum(r.n_statements for r in data.collect())

    assert sums(S.purpose_counts(labelled)) == total
    assert sums(S.schema_counts(labelled)) == with_schema
    assert sums(S.hourly_counts(labelled)) == sums(S.daily_counts(labelled)) == with_time


def test_weeks_run_monday_to_sunday(spark):
    rows = [
        ("1", TEXT[1], "A", datetime(2024, 1, 7, 23, 59)),  # Sunday
        ("2", TEXT[1], "A", datetime(2024, 1, 8)),  # Monday
        ("3", TEXT[8], "A", datetime(2024, 1, 14)),
        ("4", TEXT[8], "A", datetime(2024, 1, 14)),
        ("5", TEXT[15], "A", datetime(2024, 1, 14)),
    ]
    got = S.weekly_trends(labels.label_statements(make_log(spark, rows))).collect()
    assert [tuple(r) for r in got] == [
        ("2024-01-08/2024-01-14", "orphan_removal", 2, "increasing"),
        ("2024-01-01/2024-01-07", "duplicate_check", 1, "stable"),
        ("2024-01-08/2024-01-14", "duplicate_check", 1, "stable"),
    ]


def test_days_do_not_depend_on_the_session_zone(spark):
    rows = [("1", TEXT[1], "A", None)]
    log = make_log(spark, rows).withColumn("last_load_time", F.expr("TIMESTAMP_NTZ'2024-03-31 02:30:00'"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # 02:30 does not exist there
        for data in (labels.label_statements(log), S.activity(labels.label_statements(log))):
            assert S.hourly_counts(data).first().hour == 2
            assert str(S.daily_counts(data).first().day) == "2024-03-31"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_samples_are_whole_and_repeatable(labelled):
    checks = labelled.filter(F.col("purpose") == "integrity_check").count()
    assert S.sample_statements(labelled, "integrity_check", 10**6).count() == checks
    few = S.sample_statements(labelled, "integrity_check", 20, seed=5)
    assert few.count() == 20
    other = S.sample_statements(labelled.repartition(11), "integrity_check", 20, seed=5)
    assert {r.sql_id for r in few.collect()} == {r.sql_id for r in other.collect()}
    assert {r.sql_id for r in S.sample_statements(labelled, "integrity_check", 20, seed=6).collect()} != {
        r.sql_id for r in few.collect()
    }
