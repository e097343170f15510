"""Schema recovered from the statement texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlog.operators import facts as K


def table_usage(facts: DataFrame) -> DataFrame:
    """Statements that name a table after a keyword, per table."""
    usage = K.of_kind(facts, K.USAGE, "table_name")
    return usage.groupBy("table_name").agg(F.sum("n").alias("usage_count"))


def table_operations(facts: DataFrame, by: str = "purpose") -> DataFrame:
    """Statements per table and purpose, or per table and kind of operation."""
    if by not in ("purpose", "operation"):
        raise ValueError("by is 'purpose' or 'operation'")
    usage = K.of_kind(facts, K.USAGE, "table_name", "operation", "purpose")
    return usage.groupBy("table_name", F.col(by).alias("operation_type")).agg(F.sum("n").alias("n"))


def schema_columns(facts: DataFrame) -> DataFrame:
    """Distinct (table, column).  Kept as rows: under a number such as ``1.5`` the set has no bound."""
    return K.of_kind(facts, K.QUALIFIED, "table_name", "column_name").drop("n")


def schema_edges(facts: DataFrame) -> DataFrame:
    """Distinct column pairs of related tables, both directions."""
    names = ("table_name", "column_name", "other_table", "other_column")
    return K.of_kind(facts, K.EDGE, *names).drop("n")


def schema_summary(facts: DataFrame) -> DataFrame:
    """One row: names seen in any role, names with a relationship, related (table, other) pairs.

    Names that occur only as a qualifier count as tables with no usage.
    """
    is_edge = F.col("kind") == K.EDGE
    pairs = (
        facts.filter(F.col("kind").isin(*K.SCHEMA_KINDS))
        .select(F.col("a").alias("table_name"), F.when(is_edge, F.col("c")).alias("other"))
        .distinct()
    )
    per_table = pairs.groupBy("table_name").agg(F.count("other").alias("others"))
    return per_table.agg(
        F.count("*").alias("total_tables"),
        F.count_if(F.col("others") > 0).alias("tables_with_relationships"),
        F.coalesce(F.sum("others"), F.lit(0)).alias("total_relationships"),
    )


def top_tables(facts: DataFrame, k: int = 20) -> DataFrame:
    """The most used names, unused qualifiers included with 0; ties by name."""
    n = F.when(F.col("kind") == K.USAGE, F.col("n")).otherwise(0)
    return (
        facts.filter(F.col("kind").isin(*K.SCHEMA_KINDS))
        .groupBy(F.col("a").alias("table_name"))
        .agg(F.sum(n).alias("usage_count"))
        .orderBy(F.desc("usage_count"), "table_name")
        .limit(k)
    )
