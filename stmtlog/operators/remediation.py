"""Remediation plan over the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtlog.operators import rules as R

# ---- fixed values: lists of the plan -----------------------------------------------------
# list number: (name, days per rule)
PLAN_LISTS = {
    1: ("Critical Issue Remediation", 2.0),
    2: ("High Frequency Issue Resolution", 1.5),
    3: ("Quick Wins", None),
}
# most rules of each list in a short plan
SHORT_PLAN = {1: 10, 2: 15, 3: 10}


def _listed(rules: DataFrame) -> DataFrame:
    """A row per rule and list it belongs to."""
    level, frequency = F.col("severity"), F.col("frequency")
    member = {
        1: level == "critical",
        2: level.isin("high", "medium") & (frequency > 10),
        3: (F.col("confidence") > 0.8) & R.has_fix() & level.isin("medium", "low"),
    }
    lists = F.array_compact(F.array(*[F.when(test, F.lit(i)) for i, test in member.items()]))
    return rules.withColumn("list", F.explode(lists))


def _value(position: int):
    chain = None
    for number, values in PLAN_LISTS.items():
        test = F.col("list") == number
        value = F.lit(values[position])
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def plan_summary(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count("*").alias("total_rules"),
        F.count_if(F.col("severity") == "critical").alias("critical_issues"),
        F.coalesce(F.sum(R.effort_days(F.col("severity"))), F.lit(0.0)).cast("int").alias("estimated_effort_days"),
    )


def plan_phases(rules: DataFrame) -> DataFrame:
    """Phases 1 and 2 with their duration, which counts every rule and not only the listed ones."""
    return (
        _listed(rules)
        .filter(F.col("list").isin(1, 2))
        .groupBy("list")
        .agg(F.count("*").alias("n_rules"))
        .select(
            F.col("list").alias("phase"),
            _value(0).alias("name"),
            "n_rules",
            (F.col("n_rules") * _value(1)).alias("duration_days"),
        )
    )


def plan_items(rules: DataFrame, most: dict[int, int] | None = None) -> DataFrame:
    """The rules listed per phase (1, 2) and as quick wins (3), best first: all, or the best ``most`` of each list.

    With ``most``, e.g. SHORT_PLAN, rows carry their rank; its bound lets every task drop all but its own best
    rows before the shuffle.
    """
    listed = _listed(rules)
    if most is None:
        ordered = listed.orderBy("list", *R.rule_order())
        return ordered.select("list", _value(0).alias("list_name"), *R.report_columns())
    rank = F.row_number().over(Window.partitionBy("list").orderBy(*R.rule_order()))
    bound = F.element_at(F.create_map(*(F.lit(x) for item in most.items() for x in item)), F.col("list"))
    return (
        listed.withColumn("rank", rank)
        .filter(F.col("rank") <= max(most.values()))
        .filter(F.col("rank") <= bound)
        .select("list", _value(0).alias("list_name"), "rank", *R.report_columns())
    )
