"""The published report document, and the summary kept by day."""

import json
from datetime import date, timedelta

import pytest
from helpers import F as TEXT
from helpers import TEN, make_log
from pyspark.sql import functions as F

from stmtlog.operators import labels
from stmtlog.operators import statistics as S
from stmtlog.plans import daily, publish


def _document(spark, folder):
    found = publish.manifest(spark, folder)
    return json.loads(spark.read.text(f"{folder}/versions/{found['version']}", wholetext=True).first()[0])


def test_a_document_holds_all_sections_in_order(spark, tmp_path):
    numbers = spark.range(500).repartition(7).orderBy(F.desc("id"))
    odd = spark.createDataFrame([('quote " and \n line', None, ["a", "b"]), ("é", 1.5, None)], "t string, x double, l array<string>")
    sections = {"numbers": numbers, "od\"d": odd, "none": spark.range(0)}
    folder = str(tmp_path / "report")
    publish.publish(sections, folder, "2024-05-01")
    assert _document(spark, folder) == {
        "numbers": [{"id": i} for i in range(499, -1, -1)],
        "od\"d": [{"t": 'quote " and \n line', "x": None, "l": ["a", "b"]}, {"t": "é", "x": 1.5, "l": None}],
        "none": [],
    }
    read = publish.read_section(spark, folder, "numbers", "id bigint").orderBy("place").collect()
    assert [(r.place, r.id) for r in read[:2]] == [(0, 499), (1, 498)]
    with pytest.raises(ValueError):
        publish.read_section(spark, folder, "other", "id bigint")


def test_a_failed_rerun_leaves_the_old_report(spark, tmp_path):
    folder = str(tmp_path / "report")
    assert publish.manifest(spark, folder) is None
    publish.publish({"a": spark.range(1), "b": spark.range(2)}, folder, "1")
    fails = spark.range(3).select(F.assert_true(F.col("id") < 2, F.lit("broken")).cast("string").alias("id"))
    with pytest.raises(Exception, match="broken"):
        publish.publish({"a": spark.range(5), "b": fails}, folder, "2")
    assert publish.manifest(spark, folder)["created"] == "1"
    assert {k: len(v) for k, v in _document(spark, folder).items()} == {"a": 1, "b": 2}
    versions = []
    for i in range(3, 6):
        versions.append(publish.publish({"a": spark.range(i)}, folder, str(i)))
    assert len(_document(spark, folder)["a"]) == 5
    left = {p.name for p in (tmp_path / "report" / "versions").iterdir()}
    assert set(versions[1:]) <= left and versions[0] not in left


RESULTS = [S.purpose_counts, S.schema_counts, S.date_range, S.hourly_counts, S.daily_counts, S.hourly_pivot, S.daily_pivot, S.weekly_trends]


def test_a_second_day_reads_that_day_only(spark, tmp_path):
    texts = list(TEXT.values())
    rows = [(str(i), texts[i % len(texts)], f"S{i % 3}" if i % 5 else None, None if i % 11 == 0 else TEN + timedelta(hours=i)) for i in range(120)]
    log = make_log(spark, rows).withColumn("log_day", F.date_add(F.lit(date(2024, 3, 4)), (F.col("sql_id").cast("int") / 24).cast("int")))
    table, summary = str(tmp_path / "log"), str(tmp_path / "summary")
    first = F.col("log_day") < "2024-03-06"
    log.filter(first).write.partitionBy("log_day").parquet(table)
    read = lambda: spark.read.parquet(table)
    assert daily.refresh(read(), summary) == [date(2024, 3, 4), date(2024, 3, 5)]
    assert daily.refresh(read(), summary) == []
    log.filter(~first).write.mode("append").partitionBy("log_day").parquet(table)
    for broken in (tmp_path / "log").glob("log_day=2024-03-0[45]/*.parquet"):  # old days can be counted, not read
        data = broken.read_bytes()
        broken.write_bytes(b"PAR1" + b"\xff" * (len(data) - 4 - int.from_bytes(data[-8:-4], "little") - 8) + data[-8 - int.from_bytes(data[-8:-4], "little") :])
        broken.with_name(f".{broken.name}.crc").unlink(missing_ok=True)
    assert len(daily.refresh(read(), summary)) == 3
    kept, full = daily.read_summary(spark, summary), labels.label_statements(log.drop("log_day"))
    for result in RESULTS:
        assert sorted(map(repr, result(kept).collect())) == sorted(map(repr, result(full).collect())), result.__name__


def test_a_day_that_grows_is_read_again(spark, tmp_path):
    log = make_log(spark, [("a", TEXT[2], "A", TEN), ("b", TEXT[8], "A", TEN)]).withColumn("log_day", F.lit(date(2024, 3, 4)))
    table, summary = str(tmp_path / "log"), str(tmp_path / "summary")
    for n in (2, 4):
        log.write.mode("append").partitionBy("log_day").parquet(table)
        assert daily.refresh(spark.read.parquet(table), summary) == [date(2024, 3, 4)]
        assert S.statement_totals(daily.read_summary(spark, summary)).first().total_statements == n
    assert daily.refresh(spark.read.parquet(table), summary, days=[date(2024, 3, 4)]) == [date(2024, 3, 4)]
    assert daily.read_summary(spark, summary).agg(F.sum("n")).first()[0] == 4
