"""

Every query reads a statement log that Spark derives from the whole ``events`` table, see
``stmtlog.sources.events_log``.  Arrays leave as comma-joined strings and times as text, so that
both engines can be compared by value.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles  # noqa: E402
from stmtlog.functions import extract as X  # noqa: E402
from stmtlog.functions import tokens as T  # noqa: E402
from stmtlog.operators import facts as K  # noqa: E402
from stmtlog.operators import insights, labels, monitor, profiles, remediation  # noqa: E402
from stmtlog.operators import rules as R  # noqa: E402
from stmtlog.operators import schema, sequences  # noqa: E402
from stmtlog.operators import statistics as S  # noqa: E402
from stmtlog.plans import daily, publish, reports  # noqa: E402
from stmtlog.plans.stage import new_folder, stage  # noqa: E402
from stmtlog.sources.events_log import events_log  # noqa: E402
from stmtlog.sources.statement_log import read_csv  # noqa: E402


#: The operators for training data and their pipeline may be absent; the rest works without them.
if importlib.util.find_spec("stmtlog.llm") and importlib.util.find_spec("corpus_pipeline"):
    import corpus_pipeline
    from stmtlog.llm import queries as llm_queries
else:
    corpus_pipeline = llm_queries = None


def _log(spark: SparkSession, folder: str, clock: str = "dense") -> DataFrame:
    return labels.label_statements(events_log(spark, folder, clock))


def _real(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder, "real")


def _upper(spark: SparkSession, folder: str) -> DataFrame:
    return events_log(spark, folder).select("sql_id", F.upper("sql_fulltext").alias("u"))


def _facts(spark: SparkSession, folder: str, *kinds: str) -> DataFrame:
    return K.statement_facts(_log(spark, folder), kinds)


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    log = events_log(spark, folder)
    return sequences.fold_sequences(labels.label_statements(log), seen_in=log, texts_from=log)


def _profiles(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.table_profiles(_facts(spark, folder, *K.PROFILE_KINDS))


def _important(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.with_importance(_profiles(spark, folder))


def _rules(spark: SparkSession, folder: str) -> DataFrame:
    return R.integrity_rules(_sequences(spark, folder), _important(spark, folder))


def _staged_rules(spark: SparkSession, folder: str) -> DataFrame:
    return stage(_rules(spark, folder), "rules")


def _joined(data: DataFrame, *columns: str) -> DataFrame:
    return data.withColumns({c: F.array_join(c, ",") for c in columns})


def _as_text(data: DataFrame, pattern: str, *columns: str) -> DataFrame:
    return data.withColumns({c: F.date_format(c, pattern) for c in columns})


SECONDS, MICROS = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS"


def classified_log(spark, folder):
    log = _log(spark, folder).select(
        "sql_id", "parsing_schema_name", "last_load_time", "purpose", "sub_type", "confidence", "indicators"
    )
    return _as_text(_joined(log, "indicators"), SECONDS, "last_load_time")


def label_requests(spark, folder):
    return labels.label_requests(_log(spark, folder))


def _label_responses(labelled: DataFrame) -> DataFrame:
    """Responses of five kinds, by statement number: full, malformed, partial, empty, none."""
    kind = F.substring("sql_id", 2, 12).cast("bigint") % 5
    response = (
        F.when(
            kind == 0,
            F.to_json(
                F.struct(
                    F.lit("reporting").alias("purpose"), F.lit("year_report").alias("sub_type"),
                    F.lit(0.9).alias("confidence"), F.concat(F.lit("about "), "sql_id").alias("reasoning"),
                )
            ),
        )
        .when(kind == 1, F.lit("no idea"))
        .when(kind == 2, F.lit('{"purpose": "maintenance"}'))
        .when(kind == 3, F.lit("{}"))
    )
    asking = labelled.filter(labels.wants_external_label())
    return asking.select("sql_id", response.alias("response")).filter(F.col("response").isNotNull())


def label_merge(spark, folder):
    labelled = labels.store_labels(_log(spark, folder), texts=False)
    merged = labels.merge_labels(labelled, _label_responses(labelled))
    return _joined(merged.select("sql_id", "purpose", "sub_type", "confidence", "indicators"), "indicators")


def form_label_requests(spark, folder):
    """One request for all statements of one form; every statement with a number of its own."""
    own = F.concat("sql_fulltext", F.lit(" /* "), F.substring("sql_id", 2, 12), F.lit(", 'x') */"))
    return labels.label_requests(_log(spark, folder).withColumn("sql_fulltext", own), by="form")


def form_label_merge(spark, folder):
    """The labels of forms taken over by all their statements."""
    labelled = labels.store_labels(_log(spark, folder), texts=False)
    asked = labelled.filter(labels.wants_external_label()).select("form_id").distinct()
    answer = F.to_json(F.struct(F.lit("reporting").alias("purpose"), F.substring("form_id", 1, 4).alias("sub_type")))
    merged = labels.merge_labels(labelled, asked.select("form_id", answer.alias("response")), by="form")
    return _joined(merged.select("sql_id", "purpose", "sub_type", "confidence", "indicators"), "indicators")


def statement_tables(spark, folder):
    return _joined(_upper(spark, folder).select("sql_id", X.statement_tables(F.col("u")).alias("tables")), "tables")


def operation_types(spark, folder):
    return _upper(spark, folder).select("sql_id", X.operation(F.col("u")).alias("operation"))


def _pieces(read) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, folder):
        found = _upper(spark, folder).select("sql_id", read(F.col("u")).alias("found"))
        return found.select("sql_id", F.inline_outer("found")).filter(F.col("table_name").isNotNull())

    return query


def real_table_names(spark, folder):
    return _joined(_upper(spark, folder).select("sql_id", X.real_table_names(F.col("u")).alias("tables")), "tables")


def walked_table_names(spark, folder):
    """Tables by the walk over tokens, of each statement behind a comment and before strings that say FROM."""
    walked = T.walk(F.upper(_odd_text("sql_fulltext")))
    found = events_log(spark, folder).select("sql_id", walked.alias("walked"))
    return _joined(found.select("sql_id", F.array_sort("walked.tables").alias("tables"), "walked.operation"), "tables")


def _odd_text(text: str) -> Column:
    return F.concat(F.lit("/* update notes */ "), F.col(text), F.lit(" -- from nowhere\n, 'from x', \"Own\".later"))


def walked_table_operations(spark, folder):
    facts = K.statement_facts(_log(spark, folder), [K.USAGE], names="tokens")
    return schema.table_operations(facts, by="operation")


def integrity_sequences(spark, folder):
    return _joined(_sequences(spark, folder), "tables").select(
        "sequence_id", "check_sql", "fix_sql", "check_pattern", "fix_pattern", "tables", "issue_type", "confidence",
        "occurrence_count",
    )


def csv_log(spark, folder):
    """The log written as CSV with a quoted text over lines, and read back."""
    path = new_folder(spark, "csv").path
    log = _as_text(events_log(spark, folder), "yyyy-MM-dd/HH:mm:ss", "last_load_time")
    log.toDF("SQL_ID", "SQL_FULLTEXT", "PARSING_SCHEMA_NAME", "LAST_LOAD_TIME").write.csv(
        path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return _as_text(read_csv(spark, path), SECONDS, "last_load_time")


def _written(spark: SparkSession, section: DataFrame, name: str) -> DataFrame:
    """A report section as it is read back from its JSON files."""
    path = new_folder(spark, "reports").path
    reports.write_sections({name: section}, path, created="2024-05-01 00:00:00")
    return spark.read.schema(section.withColumn("created", F.lit("")).schema).json(f"{path}/{name}")


def written_rule_report(spark, folder):
    return _joined(_written(spark, R.rule_report(_rules(spark, folder)), "discovered_rules"), "tables")


def written_issue_totals(spark, folder):
    return _written(spark, sequences.issue_type_totals(_sequences(spark, folder)), "issue_types")


def _published(spark: SparkSession, sections: reports.Sections, name: str) -> DataFrame:
    """A section as it is read back from the published document, over an older one."""
    path = new_folder(spark, "published").path
    publish.publish({name: sections[name].limit(1)}, path, "2024-05-01 00:00:00")
    publish.publish(sections, path, "2024-05-02 00:00:00")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sections[name].schema)
    return publish.read_section(spark, path, name, schema).drop("place")


def published_rules(spark, folder):
    rules = _staged_rules(spark, folder)
    sections = {"discovered_rules": R.rule_report(rules), "executive": monitor.leading_critical_rules(rules)}
    return _joined(_published(spark, sections, "discovered_rules"), "tables")


def _dashboard(spark: SparkSession, folder: str) -> reports.Sections:
    important = stage(_important(spark, folder), "profiles")
    rules = stage(R.integrity_rules(_sequences(spark, folder), important), "rules")
    return {
        "overview": monitor.overview(rules),
        "trending_issues": S.weekly_trends(_real(spark, folder)),
        "table_health_scores": monitor.table_health(important, rules),
        "recommendations": monitor.recommendations(rules),
    }


def published_table_health(spark, folder):
    return _published(spark, _dashboard(spark, folder), "table_health_scores")


def published_overview(spark, folder):
    return _published(spark, _dashboard(spark, folder), "overview")


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    """The summary kept by day of a log that grows: the days up to one in the middle, then all."""
    path = new_folder(spark, "daily").path
    log = events_log(spark, folder, "real").withColumn("log_day", F.to_date("last_load_time"))
    log.write.partitionBy("log_day").parquet(f"{path}/log")
    log = spark.read.parquet(f"{path}/log")
    bounds = log.agg(F.min("log_day").alias("a"), F.max("log_day").alias("b")).first()
    daily.refresh(log.filter(F.col("log_day") <= bounds.a + (bounds.b - bounds.a) / 2), f"{path}/summary")
    daily.refresh(log, f"{path}/summary")
    return daily.read_summary(spark, f"{path}/summary")


def kept_weekly_trends(spark, folder):
    return S.weekly_trends(_kept(spark, folder))


def kept_daily_pivot(spark, folder):
    return _as_text(S.daily_pivot(_kept(spark, folder)), "yyyy-MM-dd", "day")


def kept_date_range(spark, folder):
    return _as_text(S.date_range(_kept(spark, folder)), MICROS, "start_time", "end_time")


def _made_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules of every severity, with and without a fix, unsure and sure, made from counts of the events per user group."""
    g = F.col("g")
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), g % len(values))
    text = lambda prefix: F.concat(F.lit(prefix), g.cast("string"))
    found = spark.read.parquet(f"{folder}/events.parquet").groupBy((F.col("user_id") % 60).cast("int").alias("g"))
    rules = found.agg(F.count("*").alias("frequency")).select(
        text("R").alias("rule_id"), text("Q").alias("sequence_id"), text("T").alias("tables_key"), text("N").alias("rule_name"),
        text("D").alias("description"), pick("critical", "high", "medium", "low").alias("severity"),
        F.array(text("T"), pick("U0", "U1", "U2", "U3", "U4", "U5", "U6")).alias("affected_tables"), "frequency",
        pick("", "mend", "mend").alias("fix_pattern"), pick("peek", "look", "find", "scan", "test").alias("check_pattern"),
        text("I").alias("business_impact"), pick(0.75, 0.8, 0.85, 0.9, 0.95).alias("confidence"),
    )
    rules = rules.withColumn("tables_key", F.array_join("affected_tables", ","))
    return rules.withColumn("priority_score", R.priority(F.col("severity"), F.col("frequency"), F.col("confidence")))


def made_plan_items(spark, folder):
    rules = _made_rules(spark, folder).withColumns(
        {c: F.lit(0) for c in ("schema_first_us", "parsing_schema_name", "check_us", "fix_us", "check_tables", "fix_tables")}
    )
    return _joined(remediation.plan_items(rules), "tables")


def made_recommendations(spark, folder):
    return monitor.recommendations(_made_rules(spark, folder))


def overall_insight(spark, folder):
    top = sequences.top_issue_types(_sequences(spark, folder), k=1)
    answer = F.to_json(F.struct(F.array("issue_type").alias("common_issues")))
    return insights.overall_insight(top.select(answer.alias("response")))


def first_sequences(spark, folder):
    return _joined(sequences.first_discovered(_sequences(spark, folder), 50), "tables").select(
        "sequence_id", "issue_type", "tables", F.col("occurrence_count").alias("occurrences"), "confidence",
        "check_pattern", "fix_pattern",
    )


def analysis_summary(spark, folder):
    log = _log(spark, folder)
    activity = stage(S.activity(log), "activity")
    summary = S.analysis_summary(activity, sequences.fold_sequences(log, seen_in=activity, texts_from=events_log(spark, folder)))
    return _as_text(summary, MICROS, "start_time", "end_time")


def integrity_counts(spark, folder):
    log = _log(spark, folder)
    activity = stage(S.activity(log), "activity")
    return S.integrity_counts(activity, sequences.fold_sequences(log, seen_in=activity, texts_from=events_log(spark, folder)))


def statement_samples(spark, folder):
    log = _log(spark, folder)
    return S.sample_statements(log, [labels.CHECK, labels.FIX], 100, seed=7).drop("last_load_time")


def table_operations(spark, folder):
    facts = stage(_facts(spark, folder, K.USAGE), "facts")
    by = [
        schema.table_operations(facts, b).select(F.lit(b).alias("counted_by"), "*") for b in ("purpose", "operation")
    ]
    return by[0].unionByName(by[1])


def integrity_rules(spark, folder):
    """Rules, highest priority first."""
    rules = _joined(R.prioritised(_rules(spark, folder)), "affected_tables")
    return rules.select(
        "rule_id", "rule_name", "description", "affected_tables", "check_pattern", "fix_pattern",
        "example_check_sql", "example_fix_sql", "severity", "frequency", "confidence", "business_impact",
        "priority_score",
    )


def rule_report(spark, folder):
    return _joined(R.rule_report(_rules(spark, folder)), "tables")


def rule_insight_merge(spark, folder):
    rules = _staged_rules(spark, folder)
    text = F.lit("About ")
    issue = F.concat(text, "check_pattern").alias("issue_description")
    response = (
        F.when(
            F.col("check_pattern") == "orphan_check",
            F.to_json(F.struct(issue, F.lit("Orphans cost money").alias("business_impact"))),
        )
        .when(F.col("check_pattern") == "duplicate_check", F.to_json(F.struct(issue)))
        .otherwise(F.concat(F.lit('{"issue_description": '), "check_pattern"))
    )
    responses = rules.select("check_pattern", response.alias("response")).distinct()
    return R.merge_insights(rules, responses).select(
        "rule_id", "sequence_id", "check_pattern", "fix_pattern", "description", "business_impact"
    )


def plan_items(spark, folder):
    return _joined(remediation.plan_items(_rules(spark, folder)), "tables")


def table_health(spark, folder):
    important = _important(spark, folder)
    return monitor.table_health(important, R.integrity_rules(_sequences(spark, folder), important))


def executive_figures(spark, folder):
    activity = S.activity(_log(spark, folder))
    return monitor.executive_figures(activity, _staged_rules(spark, folder))


def preventive_measures(spark, folder):
    common = R.common_patterns(_rules(spark, folder))
    measure = F.concat(F.lit("Guard against "), "check_pattern")
    answers = common.agg(F.to_json(F.array_sort(F.collect_list(measure))).alias("response"))
    return insights.preventive_measures(answers)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: prioritised integrity rules."""
    return integrity_rules(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    trained = llm_queries.queries() | {"pipeline": corpus_pipeline.run} if llm_queries else {}
    return _own_queries() | trained


def _own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "purpose_counts": lambda s, d: S.purpose_counts(_log(s, d)),
        "classified_log": classified_log,
        "label_requests": label_requests,
        "label_merge": label_merge,
        "form_label_requests": form_label_requests,
        "form_label_merge": form_label_merge,
        "statement_tables": statement_tables,
        "operation_types": operation_types,
        "qualified_columns": _pieces(X.qualified_columns),
        "insert_columns": _pieces(X.insert_columns),
        "relationship_edges": _pieces(X.relationship_edges),
        "real_table_names": real_table_names,
        "walked_table_names": walked_table_names,
        "walked_table_operations": walked_table_operations,
        "table_columns": lambda s, d: profiles.table_columns(_facts(s, d, K.COLUMN)),
        "related_tables": lambda s, d: profiles.related_tables(_facts(s, d, K.RELATED)),
        "join_columns": lambda s, d: profiles.join_columns(_facts(s, d, K.JOIN_COLUMN)),
        "check_fix_pairs": lambda s, d: _joined(sequences.check_fix_pairs(_log(s, d)), "tables"),
        "pair_counts": lambda s, d: _as_text(_joined(sequences.pair_counts(_log(s, d)), "tables"), "yyyy-MM-dd", "day"),
        "integrity_sequences": integrity_sequences,
        "first_sequences": first_sequences,
        "csv_log": csv_log,
        "written_rule_report": written_rule_report,
        "written_issue_totals": written_issue_totals,
        "published_rules": published_rules,
        "published_table_health": published_table_health,
        "published_overview": published_overview,
        "kept_weekly_trends": kept_weekly_trends,
        "kept_daily_pivot": kept_daily_pivot,
        "kept_date_range": kept_date_range,
        "made_plan_items": made_plan_items,
        "made_recommendations": made_recommendations,
        "overall_insight": overall_insight,
        "issue_type_totals": lambda s, d: sequences.issue_type_totals(_sequences(s, d)),
        "top_issue_types": lambda s, d: _joined(sequences.top_issue_types(_sequences(s, d)), "tables", "patterns"),
        "schema_counts": lambda s, d: S.schema_counts(events_log(s, d)),
        "integrity_counts": integrity_counts,
        "hourly_counts": lambda s, d: S.hourly_counts(events_log(s, d, "real")),
        "daily_counts": lambda s, d: _as_text(S.daily_counts(events_log(s, d, "real")), "yyyy-MM-dd", "day"),
        "date_range": lambda s, d: _as_text(S.date_range(events_log(s, d, "real")), MICROS, "start_time", "end_time"),
        "hourly_pivot": lambda s, d: S.hourly_pivot(_real(s, d)),
        "daily_pivot": lambda s, d: _as_text(S.daily_pivot(_real(s, d)), "yyyy-MM-dd", "day"),
        "analysis_summary": analysis_summary,
        "statement_samples": statement_samples,
        "table_usage": lambda s, d: schema.table_usage(_facts(s, d, K.USAGE)),
        "table_operations": table_operations,
        "schema_columns": lambda s, d: schema.schema_columns(_facts(s, d, K.QUALIFIED)),
        "schema_edges": lambda s, d: schema.schema_edges(_facts(s, d, K.EDGE)),
        "schema_summary": lambda s, d: schema.schema_summary(_facts(s, d, *K.SCHEMA_KINDS)),
        "top_tables": lambda s, d: schema.top_tables(_facts(s, d, *K.SCHEMA_KINDS)),
        "table_profiles": _profiles,
        "table_importance": lambda s, d: _important(s, d).select("table_name", "importance"),
        "top_profiles": lambda s, d: profiles.top_profiles(_important(s, d)),
        "integrity_rules": integrity_rules,
        "rule_report": rule_report,
        "rule_insight_requests": lambda s, d: insights.rule_insight_requests(_staged_rules(s, d)),
        "rule_insight_merge": rule_insight_merge,
        "common_patterns": lambda s, d: R.common_patterns(_rules(s, d)),
        "plan_summary": lambda s, d: remediation.plan_summary(_rules(s, d)),
        "plan_phases": lambda s, d: remediation.plan_phases(_rules(s, d)),
        "plan_items": plan_items,
        "monitor_overview": lambda s, d: monitor.overview(_staged_rules(s, d)),
        "weekly_trends": lambda s, d: S.weekly_trends(_real(s, d)),
        "table_health": table_health,
        "recommendations": lambda s, d: monitor.recommendations(_staged_rules(s, d)),
        "executive_figures": executive_figures,
        "leading_critical_rules": lambda s, d: _joined(
            monitor.leading_critical_rules(_rules(s, d)), "affected_tables"
        ),
        "overall_insight_request": lambda s, d: insights.overall_insight_request(_sequences(s, d)),
        "preventive_measures_request": lambda s, d: insights.preventive_measures_request(_rules(s, d)),
        "preventive_measures": preventive_measures,
    }


def oracle_sql() -> dict[str, str]:
    trained = llm_queries.oracle_sql() if llm_queries else {}
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        trained["pipeline"] = corpus_pipeline.ORACLE_SQL
    return oracles.oracle_sql() | trained
