"""The whole analysis, its reports, and what comes back from the sinks."""

import json

import pytest
from pyspark.sql import functions as F

from stmtlog.plans import reports
from stmtlog.plans.analysis import analyse
from stmtlog.sources.events_log import events_log

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def analysis(spark):
    return analyse(events_log(spark, SF))


def read_back(spark, folder, name, form="json"):
    return spark.read.format(form).load(f"{folder}/{name}")


def test_analysis_report(spark, analysis, tmp_path):
    sections = reports.analysis_report(
        analysis, spark.createDataFrame([('{"common_issues": ["a"]}',)], "response string")
    )
    reports.write_sections(sections, str(tmp_path))
    meta = read_back(spark, tmp_path, "metadata").first()
    assert meta.total_statements == 1000
    found = read_back(spark, tmp_path, "discovered_sequences")
    assert 0 < found.count() <= 50
    assert found.count() == min(50, analysis.sequences.count())
    purposes = read_back(spark, tmp_path, "sql_purposes")
    assert purposes.agg(F.sum("n_statements")).first()[0] == 1000
    assert abs(purposes.agg(F.sum("percentage")).first()[0] - 100) < 1e-9
    issues = read_back(spark, tmp_path, "integrity_issues").first()
    assert issues.discovered_sequences == found.count()
    assert read_back(spark, tmp_path, "insight_request").first().request.count("Issue type: ") == 10
    assert json.loads(read_back(spark, tmp_path, "integrity_analysis").first().common_issues) == ["a"]


def test_comprehensive_report(spark, analysis, tmp_path):
    sections = reports.comprehensive_report(analysis)
    reports.write_sections(sections, str(tmp_path), "parquet")
    rules = read_back(spark, tmp_path, "discovered_rules", "parquet")
    assert rules.count() == min(50, analysis.rules.count())
    summary = read_back(spark, tmp_path, "plan_summary", "parquet").first()
    figures = read_back(spark, tmp_path, "executive_figures", "parquet").first()
    assert figures.total_rules == summary.total_rules == analysis.rules.count()
    assert figures.total_statements == 1000
    assert read_back(spark, tmp_path, "preventive_measures", "parquet").count() == 5
    assert read_back(spark, tmp_path, "table_profiles", "parquet").count() == min(20, analysis.profiles.count())
    health = read_back(spark, tmp_path, "table_health_scores", "parquet")
    assert health.filter("health_score < 0 OR health_score > 1").count() == 0
    for name in sections:
        read_back(spark, tmp_path, name, "parquet").collect()


def test_charts(spark, analysis):
    charts = reports.chart_data(analysis)
    issues = charts["issue_types"].collect()
    assert [r.occurrences for r in issues] == sorted(r.occurrences for r in issues)
    assert sum(r.occurrences for r in issues) == analysis.sequences.agg(F.sum("occurrence_count")).first()[0]
    hours = charts["hourly_integrity"].collect()
    totals = charts["purpose_distribution"].filter("purpose LIKE 'integrity%'").agg(F.sum("n_statements")).first()[0]
    assert sum(r.integrity_check + r.integrity_fix for r in hours) == totals


def test_external_answers_change_the_analysis(spark):
    log = events_log(spark, SF)
    unknown = log.filter("sql_fulltext LIKE 'ALTER%'")
    answers = unknown.select(
        "sql_id", F.lit('{"purpose": "integrity_fix", "sub_type": "ddl_fix", "confidence": 0.95}').alias("response")
    )
    insights = spark.createDataFrame([("orphan_check", '{"issue_description": "orphans"}')], "check_pattern string, response string")
    a = analyse(log, label_responses=answers, rule_responses=insights, min_length=30)
    fixes = a.activity.filter("sub_type = 'ddl_fix'").agg(F.sum("n")).first()[0]
    assert fixes == unknown.count() > 0
    texts = {r.description for r in a.rules.filter("check_pattern = 'orphan_check'").collect()}
    assert texts == {"orphans"}
    assert a.discovered.filter("description = 'orphans'").count() == 0


def test_stage_tables_live_in_the_shared_folder(spark, analysis):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    for data in (analysis.activity, analysis.facts, analysis.sequences, analysis.rules):
        assert all(shared in path for path in data.inputFiles())
