"""Labelled log, requests for an external labeller, and the merge of its responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlog.functions import extract as X
from stmtlog.functions.classify import confidence_of, indicators_of, purpose_of, rule_number, sub_type_of
from stmtlog.functions.regex import UNICODE
from stmtlog.functions.values import json_object
from stmtlog.plans.stage import stage

CHECK = "integrity_check"
FIX = "integrity_fix"

LABEL_REQUEST_HEAD = "Tell what the following SQL statement is for.\n\nStatement:\n"
LABEL_REQUEST_TAIL = (
    "\n\nChoose one purpose: integrity_check (looks for bad data), integrity_fix (repairs bad data), "
    "normal_usage (everyday reads and writes), reporting (analysis) or maintenance (upkeep).\n"
    'Answer with one JSON object with the keys "purpose", "sub_type", "confidence" (0.0 to 1.0) and "reasoning".\n'
)


def label_statements(log: DataFrame, strict_tables: bool = False) -> DataFrame:
    """Add label columns, ``tables`` and ``operation`` to a log; a map-only pass.

    The rule number comes out of a one-element ``explode`` so that a later filter on the label
    stays above it: pushed into the scan it would have the chain of regexes run twice.
    """
    upper = F.col("_upper")
    return (
        log.select("*", F.upper("sql_fulltext").alias("_upper"))
        .select("*", F.explode(F.array(rule_number("_upper"))).alias("_rule"))
        .select(
            *log.columns,
            purpose_of("_rule").alias("purpose"),
            sub_type_of("_rule").alias("sub_type"),
            confidence_of("_rule").alias("confidence"),
            indicators_of("_rule").alias("indicators"),
            X.statement_tables(upper, strict_tables).alias("tables"),
            X.operation(upper).alias("operation"),
        )
    )


def wants_external_label(min_length: int | None = None) -> Column:
    """Whether no rule recognised a statement and, if asked for, its text is longer than ``min_length``."""
    unknown = F.col("purpose") == "unknown"
    return unknown if min_length is None else unknown & (F.length("sql_fulltext") > min_length)


def statement_form(text: Column) -> Column:
    """The form of a statement: upper case, each string and number a ``?``, lists of them one, white space one blank.

    Statements that differ in these only are of one kind.
    """
    upper = F.regexp_replace(F.upper(text), "'[^']*+'?", "?")
    word = UNICODE.word
    numbers = F.regexp_replace(upper, rf"(?<![{word[1:-1]}:])\p{{Nd}}++(?:\.\p{{Nd}}++)?+(?!{word})", "?")
    blanks = F.trim(F.regexp_replace(numbers, f"{UNICODE.space}++", " "))
    return F.regexp_replace(blanks, r"\?(?: ?, ?\?)++", "?")


def form_id(text: Column) -> Column:
    """128 bits of the form, in hexadecimal digits; null texts have none."""
    return F.md5(statement_form(text))


def label_requests(
    labelled: DataFrame, min_length: int | None = None, most_chars: int | None = None, by: str = "statement"
) -> DataFrame:
    """One request with the whole text per statement that wants an external label, (sql_id, request).

    ``by="form"`` asks once for all statements of one form, (form_id, request, n_statements), with the least of their texts.
    ``min_length`` leaves out short statements; ``most_chars`` cuts the quoted text.
    """
    asking = labelled.filter(wants_external_label(min_length))
    shown = F.col("sql_fulltext") if most_chars is None else F.substring("sql_fulltext", 1, most_chars)
    request = F.concat(F.lit(LABEL_REQUEST_HEAD), shown, F.lit(LABEL_REQUEST_TAIL)).alias("request")
    if by == "statement":
        return asking.select("sql_id", request)
    if by != "form":
        raise ValueError("by is 'statement' or 'form'")
    forms = asking.filter(F.col("sql_fulltext").isNotNull()).groupBy(form_id(F.col("sql_fulltext")).alias("form_id"))
    forms = forms.agg(F.min("sql_fulltext").alias("sql_fulltext"), F.count("*").alias("n_statements"))
    return forms.select("form_id", request, "n_statements")


def store_labels(labelled: DataFrame, texts: bool = True) -> DataFrame:
    """The labels as a stage table, so that the rules run once whatever is made from them.

    Without ``texts`` the table is narrow: each text is left out for its form_id and text_hash, which is all that merging
    labels and the sequences look at.
    """
    if not texts:
        keys = {"form_id": form_id(F.col("sql_fulltext")), "text_hash": F.xxhash64("sql_fulltext")}
        labelled = labelled.withColumns(keys).drop("sql_fulltext")
    return stage(labelled, "labels")


def one_response_per(responses: DataFrame, key: str) -> DataFrame:
    return responses.groupBy(key).agg(F.min("response").alias("response"))


def merge_labels(
    labelled: DataFrame, responses: DataFrame, min_length: int | None = None, by: str = "statement"
) -> DataFrame:
    """Take labels from ``responses(sql_id, response)`` for the statements that asked for one.

    ``by="form"``: from ``responses(form_id, response)``, for all statements of the form.

    A response that is not a JSON object gives unknown with confidence 0.0; a missing key gives
    that key's default.  A statement without a response keeps its label.  Only the asking
    statements meet the join; the rest of the log is not shuffled.  Give it what store_labels() made: otherwise the rules
    run for the asking statements and once more for the rest.
    """
    asks = F.coalesce(wants_external_label(min_length), F.lit(False))
    key = {"statement": "sql_id", "form": "form_id"}[by]
    columns = labelled.columns
    asking = labelled.filter(asks)
    if key not in columns:
        asking = asking.withColumn(key, form_id(F.col("sql_fulltext")))
    usable = F.col("_answer").isNotNull()
    merged = {
        "purpose": F.when(usable, F.coalesce(F.col("_answer")["purpose"], F.lit("unknown"))).otherwise("unknown"),
        "sub_type": F.when(usable, F.coalesce(F.col("_answer")["sub_type"], F.lit(""))).otherwise(""),
        "confidence": F.when(
            usable, F.coalesce(F.col("_answer")["confidence"].try_cast("double"), F.lit(0.5))
        ).otherwise(0.0),
        "indicators": F.when(
            usable, F.array(F.coalesce(F.col("_answer")["reasoning"], F.lit("")))
        ).otherwise(F.array().cast("array<string>")),
    }
    asked = (
        asking.join(one_response_per(responses, key), key, "left")
        .withColumn("_answer", json_object(F.col("response")))
        .select(
            *[
                F.when(F.col("response").isNotNull(), merged[c]).otherwise(F.col(c)).alias(c)
                if c in merged
                else F.col(c)
                for c in columns
            ]
        )
    )
    return labelled.filter(~asks).unionByName(asked)
