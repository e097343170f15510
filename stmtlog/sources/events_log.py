"""A statement log derived from the ``events`` table, for tests, oracles and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Template n (from 0) is the text of every event with (2 * event_id) % 23 == n.
TEMPLATES = [
    "SELECT c_name, COUNT(*) FROM customer GROUP BY c_name HAVING COUNT(*) > 1",
    "SELECT o.o_orderkey FROM orders o WHERE o.o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "SELECT l.l_orderkey FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderkey IS NULL",
    "SELECT s_suppkey FROM supplier s WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey)",
    "WITH RECURSIVE t AS (SELECT n_nationkey FROM nation UNION ALL SELECT r.n_nationkey FROM nation r JOIN t ON r.n_regionkey = t.n_nationkey) SELECT * FROM t",
    "SELECT o_custkey, SUM(o_totalprice) FROM orders GROUP BY o_custkey HAVING SUM(o_totalprice) < 0",
    "SELECT c_custkey FROM customer MINUS SELECT o_custkey FROM orders",
    "DELETE FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "UPDATE lineitem SET l_orderkey = (SELECT o_orderkey FROM orders WHERE o_custkey = 1)",
    "MERGE INTO customer USING supplier ON (c_custkey = s_suppkey) WHEN MATCHED THEN UPDATE SET c_acctbal = s_acctbal",
    "INSERT INTO part (p_partkey, p_name) VALUES (1, 'x') ON CONFLICT (p_partkey) DO UPDATE SET p_name = 'x'",
    "DELETE FROM lineitem USING orders JOIN customer ON o_custkey = c_custkey",
    "UPDATE t FROM lineitem t JOIN orders o ON t.l_orderkey = o.o_orderkey SET l_tax = 0",
    "DELETE FROM customer WHERE c_custkey IN (SELECT MIN(c_custkey) FROM customer GROUP BY c_name HAVING COUNT(*) > 1)",
    "SELECT * FROM orders WHERE o_orderkey = :id",
    "SELECT * FROM orders WHERE o_orderkey = 42",
    "INSERT INTO region VALUES (9, 'X')",
    "UPDATE orders SET o_orderstatus = 'F' WHERE o_orderkey = :id",
    "SELECT * FROM lineitem ORDER BY l_shipdate FETCH FIRST 10 ROWS ONLY",
    "ALTER TABLE part ADD note VARCHAR",
    "SELECT o.o_orderkey\nFROM orders o\nWHERE o.o_custkey NOT IN\n(SELECT c_custkey FROM customer)",
    "  select 1 from dual limit 5 \n",
    "SELECT EXTRACT(YEAR FROM o_orderdate) FROM orders",
]
# Tables named after the user, by user_id % 3: as they are, with _1, with _2.
VARIED = ("customer", "orders", "lineitem")


def events_log(spark: SparkSession, folder: str, clock: str = "dense") -> DataFrame:
    """``dense``: one statement every 20 seconds from 2024-01-01; ``real``: the event's time."""
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", "user_id", "ts")
    texts = ", ".join("r'{}'".format(t) if "'" not in t else f'r"{t}"' for t in TEMPLATES)
    text = F.expr(f"get(array({texts}), CAST(event_id * 2 % {len(TEMPLATES)} AS INT))")
    if clock == "dense":
        seconds = F.make_dt_interval(secs=F.col("event_id") * 20)
        time = F.lit("2024-01-01").cast("timestamp_ntz") + seconds
    else:
        time = F.col("ts").cast("timestamp_ntz")
    # table names, and so the patterns, vary with the user; some statements have no schema
    variant = F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("_"), (F.col("user_id") % 3).cast("string")))
    for table in VARIED:
        text = F.replace(text, F.lit(table), F.concat(F.lit(table), variant))
    schema = F.concat(F.lit("APP"), (F.col("user_id") % 4).cast("string"))
    return events.select(
        F.concat(F.lit("S"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("sql_id"),
        text.alias("sql_fulltext"),
        F.when(F.col("event_id") % 97 != 5, schema).alias("parsing_schema_name"),
        time.alias("last_load_time"),
    )
