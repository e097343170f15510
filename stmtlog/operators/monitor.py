"""Monitoring tables: overview, table health, recommendations, executive figures.

The weekly trend is in ``statistics``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlog.functions import patterns as P
from stmtlog.functions.values import round_binary
from stmtlog.operators import remediation
from stmtlog.operators import rules as R
from stmtlog.operators.statistics import one_row, statement_totals


def overview(rules: DataFrame) -> DataFrame:
    """One row: rules, rules per severity, tables named, rules with a fix, occurrences."""
    totals = rules.agg(
        F.count("*").alias("total_integrity_rules"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in P.SEVERITY_SCORE],
        F.count_if(R.has_fix()).alias("automated_fix_available"),
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_issue_occurrences"),
    )
    tables = rules.select(F.explode("affected_tables").alias("t")).agg(
        F.count_distinct("t").alias("tables_with_issues")
    )
    return one_row(totals, tables)


def _rules_per_table(rules: DataFrame) -> DataFrame:
    return (
        rules.select(F.explode("affected_tables").alias("table_name"))
        .groupBy("table_name")
        .agg(F.count("*").alias("issues"))
    )


def health_score(integrity, usage, issues):
    """Mean of two factors in [0, 1]: share of everyday use, and fewness of rules."""
    ratio = 1 - F.least(integrity / F.greatest(usage, F.lit(1)), F.lit(1.0))
    issue = 1 - F.least(issues / 10, F.lit(1.0))
    return round_binary((ratio + issue) / 2)


def table_health(important: DataFrame, rules: DataFrame, k: int = 20) -> DataFrame:
    """Health of the most important tables; ties by name.

    Only the k listed tables meet the rules.
    """
    top = important.orderBy(F.desc("importance"), "table_name").limit(k)
    issues = F.coalesce("issues", F.lit(0))
    return (
        top.join(_rules_per_table(rules), "table_name", "left")
        .select(
            "table_name",
            "importance",
            health_score(F.col("n_checks") + F.col("n_fixes"), F.col("usage"), issues).alias("health_score"),
        )
        .orderBy(F.desc("importance"), "table_name")
    )


def recommendations(rules: DataFrame) -> DataFrame:
    """Up to three recommendations, each only where there is something to recommend."""
    worst = (
        _rules_per_table(rules.filter(F.col("severity") == "critical"))
        .orderBy(F.desc("issues"), "table_name")
        .limit(1)
    )
    counts = rules.agg(
        F.count_if(~R.has_fix() & (F.col("frequency") > 5)).alias("manual"),
        F.count_if((F.col("severity") == "low") & (F.col("frequency") > 10)).alias("minor"),
    )

    def row(priority, category, text, action):
        return [
            F.lit(priority).alias("priority"), F.lit(category).alias("category"),
            F.concat(*text).alias("recommendation"), F.concat(*action).alias("action"),
        ]

    lit, table = F.lit, F.col("table_name")
    # fixed values: wording of the recommendations
    first = worst.select(
        *row(
            "high", "critical_tables",
            [lit("Focus immediate attention on "), table, lit(" table with "), F.col("issues").cast("string"), lit(" critical issues")],
            [lit("Review and execute all critical fixes for "), table, lit(" table")],
        )
    )
    second = row(
        "medium", "automation",
        [lit("Develop automated fixes for "), F.col("manual").cast("string"), lit(" recurring manual patterns")],
        [lit("Create SQL templates or procedures for common manual fixes")],
    )
    third = row(
        "low", "quick_wins",
        [lit("Address "), F.col("minor").cast("string"), lit(" high-frequency minor issues for quick improvements")],
        [lit("Schedule batch execution of low-risk automated fixes")],
    )
    others = counts.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.when(F.col("manual") > 0, F.struct(*second)),
                    F.when(F.col("minor") > 0, F.struct(*third)),
                )
            )
        )
    )
    return first.unionByName(others)


def executive_figures(data: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: statements, rules, critical rules, rules with a fix, effort in days."""
    fixes = rules.agg(F.count_if(R.has_fix()).alias("automated_fixes"))
    return one_row(
        statement_totals(data).select("total_statements"), remediation.plan_summary(rules), fixes
    )


def leading_critical_rules(rules: DataFrame, k: int = 3) -> DataFrame:
    """Those of the first ``k`` rules that are critical."""
    return (
        rules.orderBy(*R.rule_order())
        .limit(k)
        .filter(F.col("severity") == "critical")
        .select("rule_name", "description", "affected_tables", "frequency")
    )
