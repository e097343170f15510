"""Hand-derived rows: labels, tables, operations, pairs, scores."""

import pytest
from helpers import F as TEXT
from helpers import at, make_log
from pyspark.sql import functions as F

from stmtlog.functions import extract as X
from stmtlog.functions.values import micros, round_binary
from stmtlog.operators import labels, monitor
from stmtlog.operators import rules as R
from stmtlog.operators import sequences as Q

GOLDEN = {
    1: ("integrity_check", "duplicate_check", ["CUSTOMER"], "SELECT"),
    2: ("integrity_check", "orphan_check", ["CUSTOMER", "ORDERS"], "SELECT"),
    3: ("integrity_check", "missing_reference_check", ["LINEITEM", "ORDERS"], "SELECT"),
    4: ("integrity_check", "existence_check", ["LINEITEM", "SUPPLIER"], "SELECT"),
    5: ("integrity_check", "circular_reference_check", ["NATION", "T"], "OTHER"),
    6: ("integrity_check", "aggregation_anomaly_check", ["ORDERS"], "SELECT"),
    7: ("integrity_check", "set_difference_check", ["CUSTOMER", "ORDERS"], "SELECT"),
    8: ("integrity_fix", "orphan_removal", ["CUSTOMER", "ORDERS"], "DELETE"),
    9: ("integrity_fix", "reference_correction", ["LINEITEM", "ORDERS"], "UPDATE"),
    10: ("integrity_fix", "data_synchronization", ["CUSTOMER", "SET"], "MERGE"),
    11: ("integrity_fix", "upsert_fix", ["PART", "SET"], "INSERT"),
    12: ("integrity_fix", "cascading_cleanup", ["CUSTOMER", "LINEITEM"], "DELETE"),
    13: ("integrity_fix", "bulk_correction", ["LINEITEM", "ORDERS", "T"], "UPDATE"),
    14: ("integrity_check", "aggregation_anomaly_check", ["CUSTOMER"], "DELETE"),
    15: ("normal_usage", "parameterized_query", ["ORDERS"], "SELECT"),
    16: ("normal_usage", "single_record_fetch", ["ORDERS"], "SELECT"),
    17: ("normal_usage", "single_insert", ["REGION"], "INSERT"),
    18: ("normal_usage", "single_update", ["ORDERS"], "UPDATE"),
    19: ("normal_usage", "pagination_query", ["LINEITEM"], "SELECT"),
    20: ("unknown", "", [], "OTHER"),
    21: ("unknown", "", ["CUSTOMER", "ORDERS"], "SELECT"),
    22: ("normal_usage", "pagination_query", ["DUAL"], "SELECT"),
    23: ("unknown", "", ["ORDERS", "O_ORDERDATE"], "SELECT"),
    24: ("unknown", "", [], "OTHER"),
}
CONFIDENCE = {"integrity_check": 0.8, "integrity_fix": 0.8, "normal_usage": 0.7, "unknown": 0.0}


def test_labels_tables_operations(spark):
    log = make_log(spark, [(str(i), t, "APP", at(i)) for i, t in TEXT.items()] + [("25", None, "APP", at())])
    rows = {int(r.sql_id): r for r in labels.label_statements(log).collect()}
    assert len(rows) == 25
    for i, (purpose, sub_type, tables, operation) in GOLDEN.items():
        r = rows[i]
        assert (r.purpose, r.sub_type, sorted(r.tables), r.operation) == (purpose, sub_type, sorted(tables), operation), i
        assert r.confidence == CONFIDENCE[purpose]
        assert r.indicators == ([f"Pattern: {sub_type}"] if sub_type else [])
    nothing = rows[25]
    assert (nothing.purpose, nothing.sub_type, nothing.tables, nothing.operation) == ("unknown", "", [], "OTHER")


def test_strict_tables(spark):
    log = make_log(spark, [("1", TEXT[10], "A", at()), ("2", "SELECT * FROM a, (SELECT 1) WHERE LAST_UPDATE > 1", "A", at())])
    rows = {r.sql_id: r.tables for r in labels.label_statements(log, strict_tables=True).collect()}
    assert rows == {"1": ["CUSTOMER"], "2": ["A"]}


def test_extraction_quirks(spark):
    def read(text, f):
        return spark.createDataFrame([(text,)], "t string").select(f(F.upper("t")).alias("x")).first().x

    assert {tuple(p) for p in read(TEXT[2], X.qualified_columns)} == {("O", "O_ORDERKEY"), ("O", "O_CUSTKEY")}
    assert {tuple(p) for p in read(TEXT[3], X.relationship_edges)} == {
        ("L", "L_ORDERKEY", "O", "O_ORDERKEY"), ("O", "O_ORDERKEY", "L", "L_ORDERKEY")
    }
    assert {tuple(p) for p in read(TEXT[11], X.insert_columns)} == {("PART", "P_PARTKEY"), ("PART", "P_NAME")}
    assert read(TEXT[3], lambda u: X.related_tables(u, F.lit("ORDERS"))) == ["L"]
    assert read(TEXT[3], lambda u: X.related_tables(u, F.lit("LINEITEM"))) == []
    joined = "SELECT 1 FROM orders JOIN part ON 1 = 1"
    assert read(joined, lambda u: X.related_tables(u, F.lit("ORDERS"))) == ["PART"]
    assert read(joined, lambda u: X.related_tables(u, F.lit("PART"))) == ["FROM"]
    assert read("SELECT SUBORDER.X FROM ORDER", lambda u: X.columns_of_table(u, F.lit("ORDER"))) == ["X"]
    assert read("SELECT a FROM own.big.t1, LATERAL own.t2 JOIN own.t3", X.real_table_names) == ["T1", "T3"]


def test_pairs_at_the_edges_of_the_window(spark):
    check = ("C", TEXT[2], "APP1", at())
    fixes = [
        ("f1", TEXT[8], "APP1", at(0)), ("f2", TEXT[8], "APP1", at(1)), ("f3", TEXT[8], "APP1", at(300)),
        ("f4", TEXT[8], "APP1", at(300.000001)), ("f5", TEXT[8], "APP2", at(60)), ("f6", TEXT[8], "APP1", None),
        ("f7", TEXT[11], "APP1", at(60)), ("f8", TEXT[12], "APP1", at(120)), ("f9", TEXT[8], None, at(60)),
    ]
    labelled = labels.label_statements(make_log(spark, [check, *fixes]))
    pairs = {r.sequence_id: r for r in Q.check_fix_pairs(labelled).collect()}
    assert set(pairs) == {"C_f2", "C_f3", "C_f8"}
    assert pairs["C_f2"].issue_type == "orphaned_records" and pairs["C_f2"].tables == ["CUSTOMER", "ORDERS"]
    assert pairs["C_f8"].issue_type == "data_inconsistency" and pairs["C_f8"].tables == ["CUSTOMER"]
    folded = {(r.check_pattern, r.fix_pattern): r for r in Q.fold_sequences(labelled).collect()}
    assert {k: r.occurrence_count for k, r in folded.items()} == {
        ("orphan_check", "orphan_removal"): 2, ("orphan_check", "cascading_cleanup"): 1
    }
    first = folded["orphan_check", "orphan_removal"]
    assert (first.sequence_id, first.confidence, first.check_sql, first.fix_sql) == ("C_f2", 0.8, TEXT[2], TEXT[8])


def test_patterns_span_schemas(spark):
    rows = [
        ("c1", TEXT[2], "APP2", at(0)), ("f1", TEXT[8], "APP2", at(5)),
        ("c2", TEXT[2], "APP1", at(10)), ("f2", TEXT[8], "APP1", at(11)),
        ("n", TEXT[20], "APP1", at(-50)),
    ]
    (pattern,) = Q.fold_sequences(labels.label_statements(make_log(spark, rows))).collect()
    # APP1 appears first in the log, by a statement that is no check
    assert (pattern.sequence_id, pattern.occurrence_count) == ("c2_f2", 2)


@pytest.mark.parametrize(
    "mean, has, level",
    [(0.7, True, "high"), (0.71, True, "critical"), (0.5, True, "medium"), (0.3, True, "low"), (None, True, "medium"), (None, False, "low")],
)
def test_severity(spark, mean, has, level):
    row = spark.createDataFrame([(mean, has)], "m double, h boolean")
    assert row.select(R.severity(F.col("m"), F.col("h"))).first()[0] == level


def test_priority_effort_health(spark):
    rows = spark.createDataFrame([("high", 20, 0.8), ("low", 1000, 0.8)], "s string, f long, c double")
    got = [r[0] for r in rows.select(R.priority(F.col("s"), F.col("f"), F.col("c"))).collect()]
    assert got == [9.0, 10.0]
    days = spark.createDataFrame([("critical",), ("high",), ("low",)], "s string")
    assert days.agg(F.sum(R.effort_days(F.col("s"))).cast("int")).first()[0] == 4
    one = spark.createDataFrame([(3, 10, 4)], "i long, u long, n long")
    assert one.select(monitor.health_score(F.col("i"), F.col("u"), F.col("n"))).first()[0] == 0.65


def test_impact(spark):
    rows = spark.createDataFrame(
        [(["PORTAL"], "x_y"), (["ORDER_LOG"], "x_y"), (["A_PATH"], "x_y"), (["MY_TEMP"], "x_y"), (["Q"], "x_y")],
        "t array<string>, i string",
    )
    assert [r[0] for r in rows.select(R.business_impact("t", "i")).collect()] == [
        "High - Affects x y", "Critical - Affects x y", "Medium - Affects x y", "Low - Affects x y",
        "Medium - General data quality impact",
    ]


def test_categories(spark):
    want = {1: "duplicate", 2: "orphan", 3: "orphan", 4: "orphan", 5: "circular", 6: "custom", 7: "custom", 14: "custom"}
    rows = spark.createDataFrame([(i, TEXT[i]) for i in want], "i int, t string").withColumn("u", F.upper("t"))
    assert {r.i: r.c for r in rows.select("i", R.category("u").alias("c")).collect()} == want


def test_rounding_is_that_of_the_binary_value(spark):
    values = [i / 1000 for i in range(0, 1001)] + [i / 200 + j / 20 for i in range(40) for j in range(20)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    got = rows.select("v", round_binary(F.col("v")).alias("r")).collect()
    assert [(r.v, r.r) for r in got if r.r != round(r.v, 2)] == []


def test_micros_ignore_the_session_zone(spark):
    rows = spark.sql(
        "SELECT * FROM VALUES (TIMESTAMP_NTZ'2024-03-31 02:30:00.000001'), (TIMESTAMP_NTZ'1969-12-31 23:59:59.999999') AS t(x)"
    )
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert [r[0] for r in rows.select(micros(F.col("x"))).collect()] == [1711852200000001, -1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
