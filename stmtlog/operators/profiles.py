"""Profiles of the tables the statements use, and their importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlog.functions import patterns as P
from stmtlog.operators import facts as K
from stmtlog.operators.labels import CHECK, FIX
from stmtlog.plans.stage import stage


def _total(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))


def table_profiles(facts: DataFrame) -> DataFrame:
    """One row per table: usage, usage by operation, checks, fixes, and sizes of its sets.

    The sets themselves stay rows: ``table_columns``, ``related_tables``, ``join_columns``.
    """
    kind, operation, purpose = F.col("kind"), F.col("b"), F.col("c")
    used = kind == K.OPERATION
    return (
        facts.filter(kind.isin(*K.PROFILE_KINDS))
        .groupBy(F.col("a").alias("table_name"))
        .agg(
            _total(used).alias("usage"),
            *[_total(used & (operation == o)).alias(f"n_{o.lower()}") for o in [*P.OPERATIONS, "OTHER"]],
            _total(used & (purpose == CHECK)).alias("n_checks"),
            _total(used & (purpose == FIX)).alias("n_fixes"),
            F.count_if(kind == K.COLUMN).alias("n_columns"),
            F.count_if(kind == K.RELATED).alias("n_related"),
            F.count_if(kind == K.JOIN_COLUMN).alias("n_join_columns"),
        )
    )


def table_columns(facts: DataFrame) -> DataFrame:
    return K.of_kind(facts, K.COLUMN, "table_name", "column_name").drop("n")


def related_tables(facts: DataFrame) -> DataFrame:
    return K.of_kind(facts, K.RELATED, "table_name", "related_table").drop("n")


def join_columns(facts: DataFrame) -> DataFrame:
    """Each use of a column in a join condition counts, also twice in one statement."""
    return K.of_kind(facts, K.JOIN_COLUMN, "table_name", "column_name").withColumnRenamed("n", "uses")


def with_importance(profiles: DataFrame) -> DataFrame:
    """Add importance in [0, 1]: 0.3 usage + 0.4 integrity + 0.3 relationships, each over its maximum.

    The maxima are one row; they come as a scalar subquery over the staged profiles.
    """
    profiles = stage(profiles, "profiles")
    integrity = F.col("n_checks") + F.col("n_fixes")
    top = profiles.agg(
        F.struct(
            F.greatest(F.max("usage"), F.lit(1)).alias("usage"),
            F.greatest(F.max(integrity), F.lit(1)).alias("integrity"),
            F.greatest(F.max("n_related"), F.lit(1)).alias("related"),
        ).alias("top")
    ).scalar()
    importance = (
        F.lit(0.3) * (F.col("usage") / F.col("_top")["usage"])
        + F.lit(0.4) * (integrity / F.col("_top")["integrity"])
        + F.lit(0.3) * (F.col("n_related") / F.col("_top")["related"])
    )
    return profiles.withColumn("_top", top).withColumn("importance", importance).drop("_top")


def top_profiles(important: DataFrame, k: int = 20) -> DataFrame:
    """The most important tables with their integrity statements and relationships; ties by name."""
    return (
        important.select(
            "table_name",
            "importance",
            (F.col("n_checks") + F.col("n_fixes")).alias("integrity_issues"),
            F.col("n_related").alias("relationships"),
        )
        .orderBy(F.desc("importance"), "table_name")
        .limit(k)
    )
