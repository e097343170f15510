r"""Table names and the kind of operation by a walk over a statement's tokens, as column expressions.

One linear scan cuts the upper-cased text into tokens: strings, comments, names (words and quoted names, joined by
dots), brackets, any other sign.  An automaton is then folded over them.  Only tokens outside all brackets count,
so subqueries, column lists and function arguments name no table, nor do strings and comments.

A name is taken after FROM, JOIN, INTO, UPDATE or TABLE, and after a comma in the list that such a name begins; IF NOT
EXISTS and ONLY may stand between.  A word that ends a list, a bracket, a string or another sign in between means that
none is named.  The last part of a dotted name counts; quotes are taken off.  Quotes are doubled to stand
for themselves, which reads as two strings or names; a quote or comment left open goes on to the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtlog.functions import patterns as P
from stmtlog.functions.regex import UNICODE, Classes


def _part(classes: Classes) -> str:
    return rf'(?:{classes.word}++|"[^"]*+"?|`[^`]*+`?)'


def tokens(upper: Column, classes: Classes = UNICODE) -> Column:
    """The tokens of a text in order, without comments and white space."""
    part, space = _part(classes), classes.space
    name = rf"{part}(?:{space}*+\.{space}*+{part})*+"
    comment = r"--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?"
    found = F.regexp_extract_all(upper, F.lit(rf"(?s)'[^']*+'?|{comment}|{name}|(?!{space})."), F.lit(0))
    return F.filter(found, lambda t: ~(F.startswith(t, F.lit("--")) | F.startswith(t, F.lit("/*"))))


def _last_part(name: Column, classes: Classes) -> Column:
    part, space = _part(classes), classes.space
    last = F.regexp_extract(name, rf"\A(?:{part}{space}*+\.{space}*+)*+({part})", 1)
    return F.regexp_replace(last, r'\A"([^"]*+)"?\z|\A`([^`]*+)`?\z', "$1$2")


def walk(upper: Column, classes: Classes = UNICODE) -> Column:
    """struct(tables, operation): the names in order of first appearance, and the first of SELECT, INSERT, UPDATE, DELETE
    and MERGE outside brackets, else OTHER."""

    def merge(acc, token):
        opens, closes = token == "(", token == ")"
        top = (acc["depth"] == 0) & ~opens & ~closes
        keyword = top & token.isin(*P.REAL_NAME_KEYWORDS)
        ends = token.isin(*P.LIST_ENDS)
        passed = token.isin(*P.PASSED_OVER)
        name = ~keyword & ~ends & ~passed & token.rlike(rf'^(?:{classes.word}|["`])') & ~token.rlike(rf"^{classes.digit}")
        taken = top & acc["want"] & name
        want = (
            F.when(~top, acc["want"] & ~opens)
            .when(keyword, True)
            .when(token == ",", acc["listing"])
            .otherwise(acc["want"] & passed)
        )
        listing = F.when(taken, True).when(top & (ends | (token == ";")), False).otherwise(acc["listing"])
        depth = F.greatest(acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0), F.lit(0))
        operation = F.when(acc["operation"].isNull() & top & token.isin(*P.OPERATIONS), token).otherwise(acc["operation"])
        tables = F.when(taken, F.array_append(acc["tables"], token)).otherwise(acc["tables"])
        return F.struct(
            depth.alias("depth"), want.alias("want"), listing.alias("listing"), operation.alias("operation"),
            tables.alias("tables"),
        )

    zero = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("want"), F.lit(False).alias("listing"),
        F.lit(None).cast("string").alias("operation"), F.array().cast("array<string>").alias("tables"),
    )

    def finish(acc):
        names = F.filter(F.transform(acc["tables"], lambda t: _last_part(t, classes)), lambda t: t != "")
        return F.struct(
            F.array_distinct(names).alias("tables"), F.coalesce(acc["operation"], F.lit("OTHER")).alias("operation")
        )

    return F.aggregate(tokens(upper, classes), zero, merge, finish)


def table_names(upper: Column, classes: Classes = UNICODE) -> Column:
    """Sorted distinct tables by the walk."""
    return F.array_sort(walk(upper, classes)["tables"])


def operation(upper: Column, classes: Classes = UNICODE) -> Column:
    return walk(upper, classes)["operation"]
