"""The fold against brute force, on logs with hot schemas, buckets, times and tables."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stmtlog.operators import sequences as Q
from stmtlog.plans.stage import stage

SCHEMA = (
    "sql_id string, sql_fulltext string, parsing_schema_name string, last_load_time timestamp_ntz, purpose string, "
    "sub_type string, confidence double, tables array<string>"
)
START = datetime(2024, 1, 1)


def random_log(seed, count, spread_us, tables=4, schemas=3, step_us=1):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        purpose = rng.choice(["integrity_check", "integrity_fix", "unknown"])
        time = START + timedelta(microseconds=rng.randrange(-spread_us, spread_us, step_us))
        if rng.random() < 0.3:  # a third of all rows at one moment of one schema
            time, schema = START + timedelta(seconds=30), "HOT"
        else:
            schema = rng.choice([f"S{k}" for k in range(schemas)] + [None])
        names = sorted(rng.sample([f"T{k}" for k in range(tables)], rng.randint(0, min(3, tables))))
        rows.append(
            (
                f"id{rng.randrange(count)}", f"text {i}", schema, None if rng.random() < 0.05 else time, purpose,
                rng.choice(["a", "b"]), rng.choice([0.5, 0.8]), names,
            )
        )
    return rows


def micros(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def brute_force(rows, width_us):
    first_seen = {}
    for r in rows:
        if r[2] is not None and r[3] is not None:
            first_seen[r[2]] = min(first_seen.get(r[2], r[3]), r[3])
    checks = [r for r in rows if r[4] == "integrity_check" and r[2] and r[3]]
    fixes = [r for r in rows if r[4] == "integrity_fix" and r[2] and r[3]]
    patterns = defaultdict(list)
    pairs = []
    for c in checks:
        for f in fixes:
            wait = micros(f[3]) - micros(c[3])
            common = sorted(set(c[7]) & set(f[7]))
            if c[2] == f[2] and 0 < wait <= width_us and common:
                order = (
                    first_seen[c[2]], c[2], c[3], f[3], ",".join(c[7]), ",".join(f[7]), c[0], c[1], f[0], f[1],
                )
                patterns[c[5], f[5], ",".join(common)].append((order, c, f))
                pairs.append((f"{c[0]}_{f[0]}", c[1], f[1], tuple(common)))
    out = {}
    for key, group in patterns.items():
        _, c, f = min(group, key=lambda g: g[0])
        out[key] = (len(group), f"{c[0]}_{f[0]}", c[1], f[1], min(c[6], f[6]))
    return pairs, out


CASES = [
    ("spread over hours", 400, 3_600_000_000, 4, 1),
    ("within two windows", 400, 400_000_000, 4, 1),
    ("whole seconds, many ties", 500, 600_000_000, 3, 1_000_000),
    ("window edges", 400, 900_000_000, 2, 30_000_000),
    ("few tables per many", 300, 500_000_000, 12, 7),
]


@pytest.mark.parametrize("name, count, spread, tables, step", CASES, ids=[c[0] for c in CASES])
@pytest.mark.parametrize("cells", [1, 60])
def test_fold_equals_brute_force(spark, name, count, spread, tables, step, cells):
    rows = random_log(hash((count, spread)) % 1000, count, spread, tables, step_us=step)
    labelled = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pairs, want = brute_force(rows, 300_000_000)
    got = {
        (r.check_pattern, r.fix_pattern, ",".join(r.tables)): (
            r.occurrence_count, r.sequence_id, r.check_sql, r.fix_sql, r.confidence
        )
        for r in Q.fold_sequences(labelled, cells=cells).collect()
    }
    assert got == want
    if cells == 60:
        listed = Q.check_fix_pairs(labelled).select("sequence_id", "tables").collect()
        assert sorted((r[0], tuple(r[1])) for r in listed) == sorted((p[0], p[3]) for p in pairs)
        counted = Q.pair_counts(labelled)
        assert counted.agg(F.sum("pairs")).first()[0] == (len(pairs) or None)
        by_pattern = counted.groupBy("check_pattern", "fix_pattern", F.array_join("tables", ",")).agg(F.sum("pairs"))
        assert {tuple(r)[:3]: r[3] for r in by_pattern.collect()} == {k: v[0] for k, v in want.items()}


def test_pairs_of_a_schema_and_a_time(spark):
    rows = [(f"u{i}", *r[1:]) for i, r in enumerate(random_log(8, 300, 400_000_000))]
    labelled = spark.createDataFrame(rows, SCHEMA)
    time = {r[0]: r[3] for r in rows}
    since, until = START - timedelta(seconds=100), START + timedelta(seconds=100)
    some = Q.check_fix_pairs(labelled, schemas=["S0"], since=str(since), until=str(until)).collect()
    every = Q.check_fix_pairs(labelled).collect()
    wanted = [r for r in every if r.parsing_schema_name == "S0" and since <= time[r.check_sql_id] < until]
    assert 0 < len(some) < len(every) and sorted(map(repr, some)) == sorted(map(repr, wanted))


@pytest.mark.parametrize("cell_rows", [1, 7, 1000])
def test_pairs_do_not_depend_on_the_cut(spark, cell_rows):
    rows = [(f"u{i}", *r[1:]) for i, r in enumerate(random_log(11, 400, 400_000_000))]
    pairs, _ = brute_force(rows, 300_000_000)
    got = Q.check_fix_pairs(spark.createDataFrame(rows, SCHEMA), cell_rows=cell_rows).select("sequence_id", "tables").collect()
    assert sorted((r[0], tuple(r[1])) for r in got) == sorted((p[0], p[3]) for p in pairs)


def test_a_hot_window_is_many_tasks(spark):
    """Half of the log in one window of one schema with one table set: no task makes many more pairs than others."""
    def row(i):
        hot = i % 2 == 0
        time = START + timedelta(seconds=30, microseconds=i) if hot else START + timedelta(minutes=10 + i)
        purpose = "integrity_check" if i % 4 < 2 else "integrity_fix"
        return (f"u{i}", "t", "HOT" if hot else f"S{i % 5}", time, purpose, "a", 0.5, ["T", "U"] if hot else ["T"])

    labelled = spark.createDataFrame([row(i) for i in range(4000)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = Q.check_fix_pairs(labelled, cell_rows=50).withColumn("task", F.spark_partition_id())
        made = sorted(r["count"] for r in pairs.groupBy("task").count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(made) > 400_000 and len(made) == 8 and made[-1] <= 3 * made[4]


def test_a_hot_kind_is_summed_in_blocks(spark, monkeypatch):
    """20,000 moments of one schema, kind and table within one cell: no running sum takes more than a part of them."""
    def row(i):
        purpose = "integrity_check" if i % 2 else "integrity_fix"
        return (f"u{i:05}", "t", "HOT", START + timedelta(microseconds=i * 249), purpose, "a", 0.5, ["T"])

    rows = [row(i) for i in range(20_000)]
    staged = {}
    monkeypatch.setattr(Q, "stage", lambda data, name: staged.setdefault(name, stage(data, name)))
    counted = Q.pair_counts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.pairs for r in counted) == 10_000 * 10_001 // 2 - 10_000  # each check with the fixes after it
    blocks = staged["blocks"].groupBy("parsing_schema_name", "bucket", "cell", "fix_pattern", "fix_tables", "_block").count()
    sizes = [r["count"] for r in blocks.collect()]
    assert len(sizes) >= 50 and max(sizes) <= 3 * sum(sizes) / len(sizes)


def test_issue_types_with_a_bound_on_names(spark):
    rows = [(f"u{i}", *r[1:]) for i, r in enumerate(random_log(12, 300, 400_000_000))]
    found = Q.fold_sequences(spark.createDataFrame(rows, SCHEMA)).cache()
    names = {(r.issue_type, r.kind): {} for r in Q.issue_type_names(found).collect()}
    for r in Q.issue_type_names(found).collect():
        names[r.issue_type, r.kind][r.name] = r.occurrences
    for most in (None, 2):
        for r in Q.top_issue_types(found, most=most).collect():
            for kind, listed in (("table", r.tables), ("pattern", r.patterns)):
                order = sorted(names[r.issue_type, kind].items(), key=lambda x: (-x[1], x[0]))[:most]
                assert listed == sorted(n for n, _ in order)


def test_no_stage_of_the_fold_holds_texts(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(Q, "stage", lambda data, name: staged.append(data.columns) or stage(data, name))
    Q.fold_sequences(spark.createDataFrame(random_log(8, 50, 400_000_000), SCHEMA)).collect()
    assert len(staged) > 3 and not any("sql_fulltext" in c for c in staged)


def test_many_table_sets_around_one_table_cost_their_sum(spark):
    """10,000 checks and 10,000 fixes of one window, each with a table of its own beside the one they share."""
    def side(purpose, second, prefix):
        own = F.concat(F.lit(prefix), F.col("id").cast("string"))
        return spark.range(10_000).select(
            own.alias("sql_id"), F.lit("text").alias("sql_fulltext"), F.lit("HOT").alias("parsing_schema_name"),
            (F.lit(START + timedelta(seconds=second)) + F.make_dt_interval(secs=F.col("id") / 1000)).cast("timestamp_ntz").alias("last_load_time"),
            F.lit(purpose).alias("purpose"), F.lit("k").alias("sub_type"), F.lit(0.8).alias("confidence"),
            F.array(F.lit("HOT"), F.concat(F.lit("T"), own)).alias("tables"),
        )

    (pattern,) = Q.fold_sequences(side("integrity_check", 0, "c").unionByName(side("integrity_fix", 60, "f"))).collect()
    assert (pattern.occurrence_count, pattern.tables, pattern.sequence_id) == (100_000_000, ["HOT"], "c0_f0")


def test_other_windows(spark):
    rows = random_log(3, 300, 900_000_000, 3)
    labelled = spark.createDataFrame(rows, SCHEMA)
    for minutes in (1, 7):
        _, want = brute_force(rows, minutes * 60_000_000)
        got = Q.fold_sequences(labelled, window_minutes=minutes).collect()
        assert {(r.check_pattern, r.fix_pattern, r.tables_key): r.occurrence_count for r in got} == {
            k: v[0] for k, v in want.items()
        }


def test_a_hot_moment_costs_its_sum(spark):
    """30,000 checks and 30,000 fixes in one window: 900 million pairs, counted without listing them."""
    base = spark.range(30_000)

    def side(purpose, second, prefix):
        return base.select(
            F.concat(F.lit(prefix), F.col("id").cast("string")).alias("sql_id"),
            F.lit("text").alias("sql_fulltext"),
            F.lit("HOT").alias("parsing_schema_name"),
            (F.lit(START + timedelta(seconds=second)) + F.make_dt_interval(secs=F.col("id") / 1000)).cast(
                "timestamp_ntz"
            ).alias("last_load_time"),
            F.lit(purpose).alias("purpose"),
            F.lit("k").alias("sub_type"),
            F.lit(0.8).alias("confidence"),
            F.array(F.lit("T")).alias("tables"),
        )

    log = side("integrity_check", 0, "c").unionByName(side("integrity_fix", 60, "f"))
    (pattern,) = Q.fold_sequences(log).collect()
    assert pattern.occurrence_count == 900_000_000
    assert pattern.sequence_id == "c0_f0"


def test_no_sequences(spark):
    labelled = spark.createDataFrame(random_log(1, 50, 1000), SCHEMA).filter("purpose = 'unknown'")
    folded = Q.fold_sequences(labelled)
    assert folded.count() == 0
    assert Q.top_issue_types(folded).count() == 0
