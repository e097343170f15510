"""Request tables for an external text service, and use of its answers.

Nothing here calls a service: requests are rows to be answered elsewhere, answers come back as
rows of (key, response).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtlog.functions import patterns as P
from stmtlog.functions.values import json_object, json_strings
from stmtlog.operators import rules as R
from stmtlog.operators.sequences import DISCOVERY_ORDER, first_discovered

RULE_REQUEST_TAIL = (
    "\n\nSay which integrity issue this is, what may cause it, what it means for the business if it stays, "
    "and how to prevent it.\n"
    'Answer with one JSON object with the keys "issue_description", "root_causes", "business_impact" and '
    '"prevention_measures".\n'
)
OVERALL_REQUEST_HEAD = "These data-integrity patterns were found in a log of executed SQL statements:\n\n"
OVERALL_REQUEST_TAIL = (
    "\n\nSay which issues are common, what causes them, how to prevent them, and in which order to fix them.\n"
    'Answer with one JSON object with the keys "common_issues", "root_causes", "prevention_recommendations" and '
    '"priority_order".\n'
)
MEASURES_REQUEST_HEAD = "These kinds of integrity check recur in a log of executed SQL statements:\n\n"
MEASURES_REQUEST_TAIL = (
    "\n\nName five preventive measures: constraints, validation in applications, changes of process, monitoring.\n"
    "Answer with a JSON array of strings.\n"
)


def rule_insight_requests(rules: DataFrame, k: int | None = None, samples: int = 3) -> DataFrame:
    """A request for each check pattern, or for the ``k`` with the most occurrences.

    It names the tables of the pattern's first ``samples`` rules and quotes the first rule.
    ``rules`` are taken in discovery order, as before prioritising.
    """
    top = (
        rules.groupBy("check_pattern")
        .agg(F.sum("frequency").alias("occurrences"))
    )
    if k is not None:
        top = top.orderBy(F.desc("occurrences"), "check_pattern").limit(k)
    order = Window.partitionBy("check_pattern").orderBy(*DISCOVERY_ORDER)
    sample = (
        rules.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= samples)
        .groupBy("check_pattern")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("affected_tables")))).alias("tables"),
            F.min_by(F.struct("example_check_sql", "example_fix_sql"), "rank").alias("first"),
        )
    )
    return top.join(sample, "check_pattern").select(
        "check_pattern",
        "occurrences",
        F.concat(
            F.lit("Check pattern: "), F.col("check_pattern"),
            F.lit("\nTables: "), F.array_join("tables", ", "),
            F.lit("\n\nA check:\n"), F.col("first.example_check_sql"),
            F.lit("\n\nIts fix:\n"), F.coalesce("first.example_fix_sql", F.lit(P.NO_FIX)),
            F.lit(RULE_REQUEST_TAIL),
        ).alias("request"),
    )


def _in_one_text(rows: DataFrame, order: list[str], line, head: str, tail: str, separator: str) -> DataFrame:
    """One row with the lines of a few ordered rows; ``rows`` is a top-k result."""
    lines = rows.agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), separator)
    return lines.filter(F.size("lines") > 0).select(
        F.concat(F.lit(head), text, F.lit(tail)).alias("request")
    )


def overall_insight_request(sequences: DataFrame, quoted: int = 10) -> DataFrame:
    """One request quoting the first discovered sequences; none without sequences."""
    few = first_discovered(sequences, quoted)
    line = F.concat(
        F.lit("Issue type: "), F.col("issue_type"),
        F.lit("\nTables: "), F.array_join("tables", ", "),
        F.lit("\nCheck pattern: "), F.col("check_pattern"),
        F.lit("\nFix pattern: "), F.col("fix_pattern"),
        F.lit("\nOccurrences: "), F.col("occurrence_count").cast("string"),
    )
    return _in_one_text(few, DISCOVERY_ORDER, line, OVERALL_REQUEST_HEAD, OVERALL_REQUEST_TAIL, "\n\n")


def overall_insight(responses: DataFrame) -> DataFrame:
    """The answer's four parts as JSON texts; null where the response is unusable."""
    answer = json_object(F.col("response"))
    keys = ["common_issues", "root_causes", "prevention_recommendations", "priority_order"]
    return responses.select(answer.alias("a")).select(*[F.col("a")[k].alias(k) for k in keys])


def preventive_measures_request(rules: DataFrame, k: int = 5) -> DataFrame:
    top = R.common_patterns(rules, k).withColumn("_order", -F.col("n_rules"))
    line = F.concat(
        F.lit("- "), F.col("check_pattern"), F.lit(": "), F.col("n_rules").cast("string"), F.lit(" occurrences")
    )
    return _in_one_text(
        top, ["_order", "check_pattern"], line, MEASURES_REQUEST_HEAD, MEASURES_REQUEST_TAIL, "\n"
    )


def preventive_measures(responses: DataFrame) -> DataFrame:
    """(position, measure) of ``responses(response)``, a single row.

    A JSON list gives its items, other JSON nothing, and malformed or no JSON the fixed five.
    """
    fallback = F.array(*[F.lit(m) for m in P.FALLBACK_MEASURES])
    answer = responses.agg(F.min("response").alias("response"))
    return answer.select(
        F.posexplode(F.coalesce(json_strings(F.col("response")), fallback)).alias("position", "measure")
    )
