"""Purpose label of a statement as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtlog.functions import patterns as P
from stmtlog.functions.regex import first_found_sql


def rule_number(upper: str) -> Column:
    """Number (from 1) of the first purpose rule found in the upper-cased text column, else 0."""
    patterns = [rule[3] for rule in P.PURPOSE_RULES]
    numbers = [str(n) for n in range(1, len(patterns) + 1)]
    return F.expr(first_found_sql(upper, patterns, numbers, "0"))


def _by_number(number: str, field: int, default: str) -> Column:
    values = [rule[field] for rule in P.PURPOSE_RULES]
    items = [f"{v}D" if isinstance(v, float) else f"'{v}'" for v in values]
    return F.expr(f"get(array({', '.join([default, *items])}), {number})")


def purpose_of(number: str) -> Column:
    return _by_number(number, 0, "'unknown'")


def sub_type_of(number: str) -> Column:
    return _by_number(number, 1, "''")


def confidence_of(number: str) -> Column:
    return _by_number(number, 2, "0D")


def indicators_of(number: str) -> Column:
    text = F.concat(F.lit("Pattern: "), sub_type_of(number))
    return F.when(F.col(number) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
