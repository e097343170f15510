"""Requests and responses: labels, insights, measures."""

import json

from helpers import F as TEXT
from helpers import at, make_log

from pyspark.sql import functions as F

from stmtlog.functions import patterns as P
from stmtlog.operators import insights, labels
from stmtlog.operators import rules as R


def test_all_unknown_statements_ask_with_whole_texts(spark):
    log = make_log(spark, [(str(i), t, "A", at()) for i, t in TEXT.items()] + [("99", "x" * 200, "A", at()), ("98", "y" * 3000, "A", at())])
    labelled = labels.label_statements(log)
    unknown = {r.sql_id for r in labelled.filter("purpose = 'unknown'").collect()}
    asked = {r.sql_id: r.request for r in labels.label_requests(labelled).collect()}
    assert set(asked) == unknown and {"24", "98", "99"} < unknown
    assert "y" * 3000 in asked["98"]
    few = {r.sql_id: r.request for r in labels.label_requests(labelled, min_length=200, most_chars=1000).collect()}
    assert set(few) == {"24", "98"}
    assert TEXT[24] in few["24"]
    assert "y" * 1000 in few["98"] and "y" * 1001 not in few["98"]


def test_merge_of_labels(spark):
    texts = {k: "z" * 201 + k for k in "abcdefghi"}
    rows = [(k, t, "A", at()) for k, t in texts.items()] + [("a", TEXT[2], "A", at()), ("s", "short", "A", at())]
    responses = {
        "a": json.dumps({"purpose": "reporting", "sub_type": "sum", "confidence": 0.9, "reasoning": "why"}),
        "b": "not json",
        "c": "{}",
        "d": '{"purpose": "maintenance"} and more',
        "e": "[1]",
        "f": '{"confidence": "high", "purpose": "integrity_fix"}',
        "g": '{"purpose": "x"',
        "s": '{"purpose": "reporting"}',
    }
    answers = spark.createDataFrame(list(responses.items()), "sql_id string, response string")
    merged = labels.merge_labels(labels.label_statements(make_log(spark, rows)), answers, min_length=200)
    got = {(r.sql_id, r.sql_fulltext == TEXT[2]): (r.purpose, r.sub_type, r.confidence, r.indicators) for r in merged.collect()}
    failed = ("unknown", "", 0.0, [])
    assert got == {
        ("a", False): ("reporting", "sum", 0.9, ["why"]),
        ("a", True): ("integrity_check", "orphan_check", 0.8, ["Pattern: orphan_check"]),
        ("b", False): failed,
        ("c", False): ("unknown", "", 0.5, [""]),
        ("d", False): failed,
        ("e", False): failed,
        ("f", False): ("integrity_fix", "", 0.5, [""]),
        ("g", False): failed,
        ("h", False): failed,  # no response
        ("i", False): failed,
        ("s", False): failed,  # never asked
    }


def test_merge_of_insights(spark):
    rules = spark.createDataFrame(
        [(p, "d", "i") for p in ("a", "b", "c", "e")], "check_pattern string, description string, business_impact string"
    )
    responses = [
        ("a", '{"issue_description": "new", "business_impact": "big", "root_causes": ["x"]}'),
        ("b", '{"business_impact": null}'),
        ("c", "sorry"),
    ]
    merged = R.merge_insights(rules, spark.createDataFrame(responses, "check_pattern string, response string"))
    assert merged.columns == rules.columns
    assert {tuple(r) for r in merged.collect()} == {
        ("a", "new", "big"), ("b", "d", None), ("c", "d", "i"), ("e", "d", "i")
    }


def test_preventive_measures(spark):
    def measures(text):
        rows = insights.preventive_measures(spark.createDataFrame([(text,)], "response string")).collect()
        return [r.measure for r in sorted(rows)]

    assert measures('["a", "b"]') == ["a", "b"]
    assert measures("[]") == []
    assert measures('{"a": 1}') == []
    assert measures("3") == []
    for unusable in ("no", '["a"', '["a"] b', None):
        assert measures(unusable) == P.FALLBACK_MEASURES


def test_overall_insight(spark):
    text = '{"common_issues": ["a"], "root_causes": "b"}'
    row = insights.overall_insight(spark.createDataFrame([(text,)], "response string")).first()
    assert tuple(row) == ('["a"]', "b", None, None)


def test_forms_of_statements(spark):
    same = [
        ["select a from t where b = 1 and c in (1, 2,3)", "SELECT a\n FROM t WHERE b = 42  AND c IN ('x')", "select a from t where b='' and c in (:p, 1)"],
        ["insert into t2 values (1.5, 'its')", " INSERT INTO t2 VALUES (7,'y')"],
    ]
    texts = [t for group in same for t in group] + ["select a2 from t", "select a3 from t", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    forms = [r.f for r in rows.select(labels.statement_form(F.col("t")).alias("f")).collect()]
    assert forms == [
        "SELECT A FROM T WHERE B = ? AND C IN (?)", "SELECT A FROM T WHERE B = ? AND C IN (?)",
        "SELECT A FROM T WHERE B=? AND C IN (:P, ?)", "INSERT INTO T2 VALUES (?)", "INSERT INTO T2 VALUES (?)",
        "SELECT A2 FROM T", "SELECT A3 FROM T", None,
    ]


def test_requests_grow_with_forms(spark):
    texts = [f"frobnicate {i} 'v{i}'" for i in range(50)] + ["frobnicate x", TEXT[2], None]
    labelled = labels.label_statements(make_log(spark, [(str(i), t, "A", at()) for i, t in enumerate(texts)]))
    asked = labels.label_requests(labelled, by="form").collect()
    assert sorted(r.n_statements for r in asked) == [1, 50] and all("frobnicate" in r.request for r in asked)
    answer = json.dumps({"purpose": "maintenance", "confidence": 0.7})
    many = next(r.form_id for r in asked if r.n_statements == 50)
    answers = spark.createDataFrame([(many, answer)], "form_id string, response string")
    for stored in (labelled, labels.store_labels(labelled), labels.store_labels(labelled, texts=False)):
        merged = labels.merge_labels(stored, answers, by="form")
        assert merged.columns == stored.columns
        got = {r.sql_id: (r.purpose, r.confidence) for r in merged.collect()}
        assert {got[str(i)] for i in range(50)} == {("maintenance", 0.7)}
        assert got["50"] == ("unknown", 0.0) and got["51"] == ("integrity_check", 0.8) and len(got) == 53


def test_rules_run_once_for_merged_labels(spark, tmp_path):
    path = str(tmp_path / "log")
    make_log(spark, [("a", TEXT[2], "A", at()), ("b", "frobnicate", "A", at())]).write.parquet(path)
    stored = labels.store_labels(labels.label_statements(spark.read.parquet(path)), texts=False)
    answers = labels.label_requests(labels.label_statements(spark.read.parquet(path))).select("sql_id", F.lit("{}").alias("response"))
    plan = labels.merge_labels(stored, labels.stage(answers, "answers"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "sql_fulltext" not in plan and "sub_type" in plan
