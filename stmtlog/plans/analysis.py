"""The whole analysis of a statement log, from labels to rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from stmtlog.functions import patterns as P
from stmtlog.operators import facts as K
from stmtlog.operators import labels, profiles, rules, sequences, statistics
from stmtlog.plans.stage import StageFolder, new_folder, stage, staging_in


@dataclass
class Analysis:
    """Results other tables are made from; all but ``labelled`` are stage tables."""

    labelled: DataFrame  # the log with its labels, not stored
    activity: DataFrame  # statements per label, schema and hour
    facts: DataFrame  # counted facts read from the texts
    sequences: DataFrame  # recurring check-then-fix patterns
    profiles: DataFrame  # tables with their importance
    rules: DataFrame  # integrity rules with priority
    discovered: DataFrame  # the rules before any insight was merged
    folder: StageFolder  # where the stage tables are

    def close(self) -> None:
        """Remove the stage tables of this analysis; nothing of it can be read afterwards."""
        self.folder.close()


def analyse(
    log: DataFrame,
    label_responses: DataFrame | None = None,
    rule_responses: DataFrame | None = None,
    window_minutes: int = P.WINDOW_MINUTES,
    min_length: int | None = None,
    strict_tables: bool = False,
    names: str = "words",
    label_responses_by: str = "statement",
) -> Analysis:
    """Run the analysis.

    ``names`` is how the schema finds tables, see facts.statement_facts.

    The log is read three times: for the counts per label, for the facts, and for the checks and
    fixes.  Labels are computed again each time, which costs less than a second copy of all
    texts; only with external labels to merge is the labelled log stored, before they are.  ``label_responses_by`` is
    what they name: a statement or a form, see labels.merge_labels.
    """
    with staging_in(new_folder(log.sparkSession, "analysis")) as folder:
        return _analyse(log, label_responses, rule_responses, window_minutes, min_length, strict_tables, names, label_responses_by, folder)


def _analyse(log, label_responses, rule_responses, window_minutes, min_length, strict_tables, names, label_responses_by, folder) -> Analysis:
    labelled = labels.label_statements(log, strict_tables)
    if label_responses is not None:
        labelled = labels.merge_labels(labels.store_labels(labelled), label_responses, min_length, label_responses_by)
    activity = stage(statistics.activity(labelled), "activity")
    facts = stage(K.statement_facts(labelled, K.PROFILE_KINDS + K.SCHEMA_KINDS, names), "facts")
    folded = stage(
        sequences.fold_sequences(labelled, window_minutes, seen_in=activity, texts_from=log), "sequences"
    )
    important = profiles.with_importance(profiles.table_profiles(facts))
    discovered = stage(rules.integrity_rules(folded, important), "rules")
    final = discovered if rule_responses is None else stage(
        rules.merge_insights(discovered, rule_responses), "rules-merged"
    )
    return Analysis(labelled, activity, facts, folded, important, final, discovered, folder)
