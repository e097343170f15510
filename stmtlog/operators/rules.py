"""Integrity rules made from recurring sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlog.functions import patterns as P
from stmtlog.functions.regex import first_found_sql
from stmtlog.functions.values import json_object
from stmtlog.operators.labels import one_response_per
from stmtlog.operators.sequences import DISCOVERY_ORDER


def rule_order() -> list[Column]:
    return [F.desc("priority_score"), *[F.col(c) for c in DISCOVERY_ORDER]]


def category(upper_check_sql: str) -> Column:
    """Category of the first library pattern found in a column of upper-cased check texts."""
    patterns = [pattern for _, pattern in P.CATEGORY_RULES]
    values = [f"'{name}'" for name, _ in P.CATEGORY_RULES]
    return F.expr(first_found_sql(upper_check_sql, patterns, values, f"'{P.DEFAULT_CATEGORY}'"))


def business_impact(tables: str, issue_type: str) -> Column:
    """Impact by the first level one of whose words occurs in a table name."""
    cases = []
    for level, words in P.IMPACT_KEYWORDS:
        any_word = " OR ".join(f"contains(upper(t), '{word}')" for word in words)
        text = f"concat('{level} - Affects ', replace({issue_type}, '_', ' '))"
        cases.append(f"WHEN exists({tables}, t -> {any_word}) THEN {text}")
    return F.expr(f"CASE {' '.join(cases)} ELSE '{P.DEFAULT_IMPACT}' END")


def severity(mean_importance: Column, has_tables: Column) -> Column:
    """By mean importance of the tables; without tables low, with none of them profiled medium."""
    chain = F.when(~has_tables, "low").when(mean_importance.isNull(), "medium")
    for bound, level in P.SEVERITY_ABOVE:
        chain = chain.when(mean_importance > bound, level)
    return chain.otherwise("low")


def _score(level: Column, scores: dict[str, float]) -> Column:
    chain = None
    for name, score in scores.items():
        chain = F.when(level == name, score) if chain is None else chain.when(level == name, score)
    return chain


def priority(severity: Column, frequency: Column, confidence: Column) -> Column:
    """Severity 4 to 1, plus a tenth of the frequency up to 5, plus five times the confidence."""
    return _score(severity, P.SEVERITY_SCORE) + F.least(frequency / 10, F.lit(5.0)) + confidence * 5


def effort_days(severity: Column) -> Column:
    return F.coalesce(_score(severity, P.EFFORT_DAYS), F.lit(1.0))


def has_fix() -> Column:
    return F.coalesce("fix_pattern", F.lit("")) != ""


def mean_importance(sequences: DataFrame, profiles: DataFrame) -> DataFrame:
    """Sequences with the mean importance of those of their tables that have a profile.

    The importances are added in table order, so that partitioning cannot change the last digit.
    """
    key = ["check_pattern", "fix_pattern", "tables_key"]
    named = sequences.select(*key, F.explode("tables").alias("table_name"))
    means = (
        named.join(profiles.select("table_name", "importance"), "table_name")
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("table_name", "importance"))).alias("found"))
        .select(
            *key,
            (
                F.aggregate("found", F.lit(0.0), lambda total, x: total + x["importance"]) / F.size("found")
            ).alias("mean_importance"),
        )
    )
    return sequences.join(means, key, "left")


def integrity_rules(sequences: DataFrame, profiles: DataFrame, example_chars: int | None = None) -> DataFrame:
    """One rule per sequence; ``profiles`` holds (table_name, importance).

    ``sequence_id`` and ``tables_key`` tell rules apart, which ``rule_id`` need not.  The examples are whole texts
    unless ``example_chars`` cuts them.
    """

    def example(text: str) -> Column:
        return F.col(text) if example_chars is None else F.substring(text, 1, example_chars)

    issue = F.col("issue_type")
    spaced = F.replace(issue, F.lit("_"), F.lit(" "))
    base = (
        mean_importance(sequences, profiles)
        .withColumn("_upper", F.upper("check_sql"))
        .select(
            "*",
            category("_upper").alias("category"),
            severity(F.col("mean_importance"), F.size("tables") > 0).alias("severity"),
        )
    )
    return base.select(
        F.format_string(
            P.RULE_ID, "category", F.array_join(F.slice(F.sort_array("tables"), 1, 2), "_"), F.substring("sequence_id", 1, 8)
        ).alias("rule_id"),
        F.format_string(P.RULE_NAME, F.initcap(spaced)).alias("rule_name"),
        F.format_string(P.RULE_DESCRIPTION, issue, F.array_join(F.sort_array("tables"), ", ")).alias("description"),
        F.sort_array("tables").alias("affected_tables"),
        "check_pattern",
        "fix_pattern",
        example("check_sql").alias("example_check_sql"),
        F.when(F.col("fix_sql") != "", example("fix_sql")).alias("example_fix_sql"),
        "severity",
        F.col("occurrence_count").alias("frequency"),
        "confidence",
        business_impact("tables", "issue_type").alias("business_impact"),
        priority(F.col("severity"), F.col("occurrence_count"), F.col("confidence")).alias("priority_score"),
        *DISCOVERY_ORDER[:-3],
        "tables_key",
    )


def merge_insights(rules: DataFrame, responses: DataFrame) -> DataFrame:
    """Overwrite description and impact from ``responses(check_pattern, response)``.

    Each is overwritten when the JSON object has its key; an unusable response changes nothing.
    """
    answers = one_response_per(responses, "check_pattern").select(
        "check_pattern", json_object(F.col("response")).alias("_answer")
    )

    def taken(key: str, column: str) -> Column:
        has = F.coalesce(F.map_contains_key("_answer", F.lit(key)), F.lit(False))
        return F.when(has, F.col("_answer")[key]).otherwise(F.col(column)).alias(column)

    new = {"description": "issue_description", "business_impact": "business_impact"}
    return rules.join(answers, "check_pattern", "left").select(
        *[taken(new[c], c) if c in new else F.col(c) for c in rules.columns]
    )


def prioritised(rules: DataFrame) -> DataFrame:
    """All rules in order; a range-partitioned sort."""
    return rules.orderBy(*rule_order())


def rule_report(rules: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` rules of highest priority as report rows."""
    return rules.orderBy(*rule_order()).limit(k).select(*report_columns())


def report_columns() -> list:
    return [
        "rule_id",
        "sequence_id",
        "tables_key",
        F.col("rule_name").alias("name"),
        "description",
        "severity",
        F.col("affected_tables").alias("tables"),
        "frequency",
        has_fix().alias("has_automated_fix"),
        "business_impact",
    ]


def common_patterns(rules: DataFrame, k: int = 5) -> DataFrame:
    """Check patterns with the most rules."""
    return (
        rules.groupBy("check_pattern")
        .agg(F.count("*").alias("n_rules"))
        .orderBy(F.desc("n_rules"), "check_pattern")
        .limit(k)
    )
