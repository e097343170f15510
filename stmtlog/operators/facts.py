"""Facts read from statement texts, counted: the one pass behind schema and profiles.

Each statement yields small (kind, a, b, c, d) rows.  They are counted by hash aggregation
before the shuffle, so what is exchanged is the vocabulary of the log and not its text, and no
table, however often it is named, gathers rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlog.functions import extract as X
from stmtlog.functions import tokens as T
from stmtlog.functions.regex import ASCII, UNICODE, Classes, is_ascii

# kind: (a, b, c, d)
OPERATION = "operation"  # table, operation, purpose
COLUMN = "column"  # table, column
RELATED = "related"  # table, related table
JOIN_COLUMN = "join column"  # table, column
QUALIFIED = "qualified"  # qualifier or INSERT target, column
EDGE = "edge"  # table, column, other table, other column
USAGE = "usage"  # real table name, operation, purpose

PROFILE_KINDS = (OPERATION, COLUMN, RELATED, JOIN_COLUMN)
SCHEMA_KINDS = (QUALIFIED, EDGE, USAGE)


def _fact(kind: str, a: Column, b: Column, c: Column | None = None, d: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"),
        a.alias("a"),
        b.alias("b"),
        (none if c is None else c).alias("c"),
        (none if d is None else d).alias("d"),
    )


def _per_table(kind: str, scan, read) -> Column:
    """The text is scanned once; the array of one element keeps the scan out of the loop over tables."""
    upper = F.col("_upper")
    scanned = F.array(F.when(is_ascii(upper), scan(upper, ASCII)).otherwise(scan(upper, UNICODE)))
    return F.flatten(
        F.flatten(
            F.transform(
                scanned, lambda s: F.transform("tables", lambda t: F.transform(read(s, t), lambda v: _fact(kind, t, v)))
            )
        )
    )


#: Kinds read for each table of a statement: the scan of its text, and what belongs to one table.
_SCANS = {
    COLUMN: (X.dotted_chains, X.columns_in),
    RELATED: (X.join_sites, X.related_in),
    JOIN_COLUMN: (X.equations, X.join_columns_in),
}


def _usage(names: str, classes: Classes) -> Column:
    upper, purpose = F.col("_upper"), F.col("purpose")
    if names == "words":
        return F.transform(X.real_table_names(upper, classes), lambda t: _fact(USAGE, t, F.col("operation"), purpose))
    if names == "tokens":
        walked = F.array(T.walk(upper, classes))
        each = F.transform(walked, lambda w: F.transform(w["tables"], lambda t: _fact(USAGE, t, w["operation"], purpose)))
        return F.flatten(each)
    raise ValueError("names is 'words' or 'tokens'")


def _rows(kind: str, classes: Classes, names: str) -> Column:
    upper = F.col("_upper")
    if kind == QUALIFIED:
        return F.transform(
            X.schema_columns(upper, classes), lambda p: _fact(kind, p["table_name"], p["column_name"])
        )
    if kind == EDGE:
        return F.transform(
            X.relationship_edges(upper, classes),
            lambda e: _fact(kind, e["table_name"], e["column_name"], e["other_table"], e["other_column"]),
        )
    if kind == USAGE:
        return _usage(names, classes)
    raise ValueError(f"unknown kind of fact {kind!r}")


def statement_facts(labelled: DataFrame, kinds: Iterable[str], names: str = "words") -> DataFrame:
    """(kind, a, b, c, d, n) over all statements; only the asked kinds are extracted.

    ``names`` says how USAGE finds tables and operations: by ``words`` after a keyword wherever they stand, or by a walk
    over ``tokens``, for which strings, comments and what stands in brackets name none.

    ``inline_outer`` because for ``inline`` the optimizer infers a test for empty arrays, and pushing
    it down would have every text read twice.
    """
    kinds = list(kinds)
    empty = F.array().cast("array<struct<kind:string,a:string,b:string,c:string,d:string>>")

    def rows(kind: str) -> Column:
        if kind in _SCANS:
            return _per_table(kind, *_SCANS[kind])
        if kind == OPERATION:
            return F.transform("tables", lambda t: _fact(kind, t, F.col("operation"), F.col("purpose")))
        upper = F.col("_upper")
        return F.when(is_ascii(upper), _rows(kind, ASCII, names)).otherwise(_rows(kind, UNICODE, names))

    def facts(_: Column) -> Column:
        """Within a lambda, so that all of it is no part of one generated method, too long for the JVM to compile."""
        return F.concat(*[F.coalesce(rows(kind), empty) for kind in kinds])

    return (
        labelled.select(F.upper("sql_fulltext").alias("_upper"), "tables", "operation", "purpose")
        .select(F.flatten(F.transform(F.array(F.lit(0)), facts)).alias("_facts"))
        .select(F.inline_outer("_facts"))
        .filter(F.col("kind").isNotNull())
        .groupBy("kind", "a", "b", "c", "d")
        .agg(F.count("*").alias("n"))
    )


def of_kind(facts: DataFrame, kind: str, *names: str) -> DataFrame:
    """The facts of one kind with their own column names and ``n``."""
    columns = [F.col(x).alias(name) for x, name in zip("abcd", names)]
    return facts.filter(F.col("kind") == kind).select(*columns, "n")
