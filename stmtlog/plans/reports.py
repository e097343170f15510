"""Reports as named sections, one DataFrame each, and their sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlog.operators import insights, monitor, profiles, remediation, schema, sequences
from stmtlog.operators import rules as R
from stmtlog.operators import statistics as S
from stmtlog.plans.analysis import Analysis

Sections = Mapping[str, DataFrame]


def sequence_report(found: DataFrame, k: int = 50) -> DataFrame:
    return sequences.first_discovered(found, k).select(
        "sequence_id", "issue_type", "tables", F.col("occurrence_count").alias("occurrences"),
        "confidence", "check_pattern", "fix_pattern",
    )


def analysis_report(a: Analysis, overall_response: DataFrame | None = None) -> Sections:
    """Metadata, statistics, first sequences, insight and schema summary."""
    sections = {
        "metadata": S.date_range(a.activity),
        "sql_purposes": S.purpose_counts(a.activity),
        "schemas": S.schema_counts(a.activity),
        "integrity_issues": S.integrity_counts(a.activity, a.sequences),
        "sqls_per_hour": S.hourly_counts(a.activity),
        "sqls_per_day": S.daily_counts(a.activity),
        "discovered_sequences": sequence_report(a.sequences),
        "top_issue_types": sequences.top_issue_types(a.sequences),
        "schema_summary": schema.schema_summary(a.facts),
        "top_tables_by_usage": schema.top_tables(a.facts),
        "insight_request": insights.overall_insight_request(a.sequences),
    }
    if overall_response is not None:
        sections["integrity_analysis"] = insights.overall_insight(overall_response)
    return sections


def chart_data(a: Analysis) -> Sections:
    """The series behind the purpose, time and issue charts."""
    return {
        "purpose_distribution": S.purpose_counts(a.activity),
        "hourly_integrity": S.hourly_pivot(a.activity),
        "daily_integrity": S.daily_pivot(a.activity),
        "issue_types": sequences.issue_type_totals(a.sequences).orderBy("occurrences", "issue_type"),
    }


def dashboard(a: Analysis) -> Sections:
    return {
        "overview": monitor.overview(a.rules),
        "trending_issues": S.weekly_trends(a.activity),
        "table_health_scores": monitor.table_health(a.profiles, a.rules),
        "recommendations": monitor.recommendations(a.rules),
    }


def remediation_plan(a: Analysis, measures_response: DataFrame | None = None) -> Sections:
    sections = {
        "plan_summary": remediation.plan_summary(a.rules),
        "plan_phases": remediation.plan_phases(a.rules),
        "plan_items": remediation.plan_items(a.rules, remediation.SHORT_PLAN),
        "measures_request": insights.preventive_measures_request(a.rules),
    }
    if measures_response is None:
        measures_response = a.rules.sparkSession.createDataFrame([(None,)], "response string")
    sections["preventive_measures"] = insights.preventive_measures(measures_response)
    return sections


def comprehensive_report(a: Analysis, measures_response: DataFrame | None = None) -> Sections:
    """Summary, leading rules, plan, dashboard, leading table profiles and executive figures."""
    return {
        "analysis_summary": S.analysis_summary(a.activity, a.sequences),
        "discovered_rules": R.rule_report(a.rules),
        **remediation_plan(a, measures_response),
        **dashboard(a),
        "table_profiles": profiles.top_profiles(a.profiles),
        "executive_figures": monitor.executive_figures(a.activity, a.rules),
        "leading_critical_rules": monitor.leading_critical_rules(a.rules),
    }


def write_sections(
    sections: Sections, folder: str, form: str = "json", mode: str = "overwrite", created: str | None = None
) -> None:
    """Write every section to its own folder; ``form`` is a Spark format such as json or parquet.

    ``created``, the time of the report, becomes a column of that name; it is given, so that results can be repeated.
    """
    for name, section in sections.items():
        if created is not None:
            section = section.withColumn("created", F.lit(created))
        section.write.format(form).mode(mode).save(f"{folder.rstrip('/')}/{name}")
