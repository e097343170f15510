"""What the plans read and move."""

import re

import pytest
from pyspark.sql import functions as F

from stmtlog.operators import facts as K
from stmtlog.operators import labels
from stmtlog.operators import sequences as Q
from stmtlog.operators import statistics as S
from stmtlog.sources.events_log import events_log
from stmtlog.sources.statement_log import read_parquet


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "log")
    events_log(spark, "/root/testdata/sf0.001").write.parquet(path)
    return read_parquet(spark, path)


def plan_of(data):
    return data._jdf.queryExecution().executedPlan().toString()


def columns_read(data):
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan_of(data))
    return [{column.split("#")[0] for column in scan.split(",")} for scan in scans]


def test_scans_read_what_is_asked(log):
    labelled = labels.label_statements(log)
    assert columns_read(labelled.groupBy("purpose").count()) == [{"sql_fulltext"}]
    assert columns_read(S.hourly_counts(log)) == [{"last_load_time"}]
    assert columns_read(S.schema_counts(log)) == [{"parsing_schema_name"}]
    assert columns_read(K.statement_facts(labelled, K.SCHEMA_KINDS)) == [{"sql_fulltext"}]


def test_filters_on_the_raw_log_reach_the_scan(log):
    late = labels.label_statements(log.filter(F.col("parsing_schema_name") == "APP1"))
    plan = plan_of(late)
    assert "EqualTo(parsing_schema_name,APP1)" in plan


def test_the_rule_chain_runs_once(log):
    labelled = labels.label_statements(log)
    checks = labelled.filter(F.col("purpose") == labels.CHECK).select("sql_id", "sub_type", "confidence")
    assert plan_of(checks).count("RLIKE") == plan_of(labelled).count("RLIKE")


def test_labels_need_no_shuffle(log):
    assert "Exchange" not in plan_of(labels.label_statements(log))
    assert "Exchange" not in plan_of(labels.label_requests(labels.label_statements(log)))


def test_facts_are_counted_before_the_one_shuffle(log):
    plan = plan_of(K.statement_facts(labels.label_statements(log), K.PROFILE_KINDS + K.SCHEMA_KINDS))
    assert plan.count("Exchange") == 1
    assert "partial_count" in plan


def test_texts_stay_out_of_the_pair_join(log):
    scans = columns_read(Q.check_fix_pairs(labels.label_statements(log)))
    assert scans and not any("sql_fulltext" in s for s in scans)


def longest_method(data):
    """Bytes of the longest method generated for the plan; the JVM leaves those over 8000 uncompiled."""
    plan = data._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(data.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(plan)
    return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length()))


def test_generated_code_stays_compilable(spark, log):
    answers = log.select("sql_id", F.col("sql_fulltext").alias("response"))
    spark.conf.set("spark.sql.adaptive.enabled", False)  # an adaptive plan has no code before it runs
    try:
        labelled = labels.label_statements(log)
        for data in (
            labelled,
            S.activity(labelled),
            K.statement_facts(labelled, K.PROFILE_KINDS + K.SCHEMA_KINDS),
            labels.merge_labels(labelled, answers),
        ):
            assert 0 < longest_method(data) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)
