"""Check-then-fix sequences: the pairs, and their fold into recurring patterns.

A pair is a check and a fix of the same schema that share a table, the fix in the five minutes
after the check (later than it, at most the window later).  ``check_fix_pairs`` lists them.
``fold_sequences`` counts them per pattern and finds the first of each pattern *without*
listing them, so that a busy schema costs the sum and not the product of its checks and fixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtlog.functions import patterns as P
from stmtlog.functions.values import floor_div, micros
from stmtlog.operators.labels import CHECK, FIX
from stmtlog.plans.stage import stage, stage_numbered

MINUTE, DAY = 60_000_000, 86_400_000_000
#: Blocks of a cell, for running sums.
BLOCKS = 50

# Total order in which sequences are discovered: schemas as they first appear in the log, then
# check time, fix time; what follows breaks ties by name.
DISCOVERY_ORDER = [
    "schema_first_us", "parsing_schema_name", "check_us", "fix_us", "check_tables", "fix_tables",
    "sequence_id", "check_pattern", "fix_pattern", "tables_key",
]


def integrity_statements(labelled: DataFrame) -> DataFrame:
    """The checks and fixes that can take part in a sequence, without their texts.

    Table sets become comma-joined sorted names (``tables_key``), which group and compare faster
    than arrays.  Without a time, a schema or a table there is no sequence.  The result is a
    stage table; names are tested on what was staged, so that they are extracted once.  ``row``
    numbers the staged rows, ``text_hash`` tells texts of one id apart.
    """
    statements = labelled.filter(
        F.col("purpose").isin(CHECK, FIX)
        & F.col("parsing_schema_name").isNotNull()
        & F.col("last_load_time").isNotNull()
    ).select(
        F.monotonically_increasing_id().alias("row"),
        (F.col("purpose") == CHECK).alias("is_check"),
        "parsing_schema_name",
        micros(F.col("last_load_time")).alias("us"),
        F.coalesce("sub_type", F.lit("")).alias("sub_type"),
        F.array_join("tables", ",").alias("tables_key"),
        _known_id().alias("sql_id"),
        "confidence",
        F.col("text_hash") if "text_hash" in labelled.columns else F.xxhash64("sql_fulltext").alias("text_hash"),
    )
    return stage(statements, "integrity").filter(F.col("tables_key") != "")


def _known_id() -> Column:
    return F.coalesce("sql_id", F.lit("nan"))


def _texts(log: DataFrame) -> DataFrame:
    """What statements are found by, with their texts."""
    return log.select(
        _known_id().alias("sql_id"), "parsing_schema_name", micros(F.col("last_load_time")).alias("us"),
        F.xxhash64("sql_fulltext").alias("text_hash"), "sql_fulltext",
    )


def issue_type(check_pattern: str, fix_pattern: str) -> Column:
    cases = [f"WHEN {check_pattern} = '{c}' AND {fix_pattern} = '{f}' THEN '{i}'" for c, f, i in P.ISSUE_TYPES]
    return F.expr(f"CASE {' '.join(cases)} ELSE '{P.DEFAULT_ISSUE_TYPE}' END")


def _shared(left: Column, right: Column) -> Column:
    """Sorted tables of both keys."""
    return F.sort_array(F.array_intersect(F.split(left, ","), F.split(right, ",")))


# ---- the pairs ----------------------------------------------------------------------------


def _split(side: DataFrame, key: list[str], cell_rows: int) -> DataFrame:
    """``side`` with the number of parts of its window and table set, one for every ``cell_rows`` rows, and a row's part.

    Only window and table sets with more rows than that are joined, so that side stays small.
    """
    large = side.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows)
    parts = large.select(*key, F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    parted = side.join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return parted.withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))


def _cells(checks: DataFrame, fixes: DataFrame, window: list[str]) -> DataFrame:
    """The cells of all windows, numbered: a part of the checks of one table set, and one of the fixes of a table set that
    shares a table.  Each pair of statements belongs to one cell."""

    def kinds(side: DataFrame, p: str) -> DataFrame:
        kind = side.select(*window, f"{p}_tables_key", F.col("parts").alias(f"{p}_parts")).distinct()
        return kind.withColumn("shared_table", F.explode(F.split(f"{p}_tables_key", ",")))

    tables = _shared(F.col("check_tables_key"), F.col("fix_tables_key"))
    met = kinds(checks, "check").join(kinds(fixes, "fix"), [*window, "shared_table"])
    met = met.filter(F.col("shared_table") == tables[0]).select(
        *window, "check_tables_key", "fix_tables_key", tables.alias("tables"), "fix_parts",
        F.explode(F.sequence(F.lit(0), F.col("check_parts") - 1)).alias("check_part"),
    )
    met = met.withColumn("fix_part", F.explode(F.sequence(F.lit(0), F.col("fix_parts") - 1))).drop("fix_parts")
    return stage_numbered(met, "cells", "cell")


def check_fix_pairs(
    labelled: DataFrame,
    window_minutes: int = P.WINDOW_MINUTES,
    schemas: list[str] | None = None,
    since: str | None = None,
    until: str | None = None,
    cell_rows: int = 1000,
) -> DataFrame:
    """Pairs as rows: an interval join in cells of at most about ``cell_rows`` checks and fixes each.

    A check meets the fixes of its own bucket, as wide as the window, and of the next.  Table sets are matched first, so
    two statements meet once however many tables they share.  A busy window is cut into parts by counts, and every part of
    its checks meets every part of its fixes in a cell of their own: one hot schema, table and time is many tasks.

    The rows are as many as the pairs, so on a large log ask for some ``schemas`` and for checks with
    since <= time < until; ``pair_counts`` tells how many there are.
    """
    width = window_minutes * MINUTE
    statements = integrity_statements(labelled)
    if schemas is not None:
        statements = statements.filter(F.col("parsing_schema_name").isin(schemas))
    bucket = floor_div(F.col("us"), width)
    window = ["parsing_schema_name", "bucket"]

    def side(check: bool, buckets: Column) -> DataFrame:
        p = "check_" if check else "fix_"
        rows = statements.filter(F.col("is_check") == check)
        if check and since is not None:
            rows = rows.filter(F.col("us") >= micros(F.lit(since).cast("timestamp_ntz")))
        if check and until is not None:
            rows = rows.filter(F.col("us") < micros(F.lit(until).cast("timestamp_ntz")))
        names = ("us", "tables_key", "sub_type", "sql_id", "confidence")
        rows = rows.select("row", window[0], *[F.col(c).alias(p + c) for c in names], F.explode(buckets).alias("bucket"))
        return _split(rows, [*window, f"{p}tables_key"], cell_rows)

    checks, fixes = side(True, F.array(bucket, bucket + 1)), side(False, F.array(bucket))
    cells = _cells(checks, fixes, window)

    def dealt(rows: DataFrame, p: str, *more: str) -> DataFrame:
        key = [*window, f"{p}_tables_key", f"{p}_part"]
        named = rows.withColumnRenamed("part", f"{p}_part")
        kept = [f"{p}_{c}" for c in ("us", "sub_type", "sql_id", "confidence")]
        return named.join(cells, key).select("cell", *kept, *more)

    return (
        dealt(checks, "check", window[0], "tables")
        .join(dealt(fixes, "fix"), "cell")
        .filter((F.col("fix_us") > F.col("check_us")) & (F.col("fix_us") <= F.col("check_us") + width))
        .select(
            F.concat_ws("_", "check_sql_id", "fix_sql_id").alias("sequence_id"),
            window[0],
            "check_sql_id",
            "fix_sql_id",
            F.col("check_sub_type").alias("check_pattern"),
            F.col("fix_sub_type").alias("fix_pattern"),
            "tables",
            issue_type("check_sub_type", "fix_sub_type").alias("issue_type"),
            F.least("check_confidence", "fix_confidence").alias("confidence"),
            F.lit(1).alias("occurrence_count"),
        )
    )


# ---- the fold -----------------------------------------------------------------------------


def _after(points: DataFrame, marks: DataFrame, keys: list[str], position: str, span: int | None = None) -> DataFrame:
    """For every point the sum of ``n`` and the least ``first`` over the marks placed after it.

    One running pass from the last position to the first.  A point comes before the marks of its
    own position, which therefore do not count as after it.

    With ``span`` the pass is in two levels, so that one busy key is the work of many tasks: running sums within blocks of
    ``span`` positions, and over the totals of blocks.  A task then sorts one block's rows, or a key's blocks.
    """
    both = points.withColumn("_is_mark", F.lit(False)).unionByName(
        marks.withColumn("_is_mark", F.lit(True)), allowMissingColumns=True
    )
    within = keys
    if span is not None:
        both, within = both.withColumn("_block", floor_div(F.col(position), span)), [*keys, "_block"]
    running = (
        Window.partitionBy(*within)
        .orderBy(F.col(position).desc(), F.col("_is_mark"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    both = both.withColumn("after_n", F.coalesce(F.sum("n").over(running), F.lit(0))).withColumn(
        "after_first", F.min("first").over(running)
    )
    if span is None:
        return both.filter(~F.col("_is_mark")).drop("_is_mark", "n", "first")
    both = stage(both, "blocks")
    blocks = both.groupBy(*within).agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*within, F.sum("n").over(later).alias("_later_n"), F.min("first").over(later).alias("_later_first"))
    found = both.filter(~F.col("_is_mark")).drop("_is_mark", "n", "first")
    found = found.join(blocks.filter("_later_n IS NOT NULL"), within, "left")
    return found.withColumns(
        {
            "after_n": F.col("after_n") + F.coalesce("_later_n", F.lit(0)),
            "after_first": F.least("after_first", "_later_first"),
        }
    ).drop("_block", "_later_n", "_later_first")


def _cut_kinds(checks: DataFrame, fixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The statements with ``tables`` cut to those that checks and fixes of their window both name.

    A window is a schema and a check's bucket; a fix stands in two of them.  The shared tables of a pair stay the
    same, and statements that name none of the window's common tables go.  Statements of one time and cut kind
    become one row with their number and least table set.
    """
    window = ["parsing_schema_name", "bucket"]
    kinds = [
        side.select(*window, "sub_type", "tables_key").distinct().withColumn("name", F.explode(F.split("tables_key", ",")))
        for side in (checks, fixes)
    ]
    named = [k.select(*window, "name").distinct() for k in kinds]
    common = named[0].join(named[1], [*window, "name"])

    def cut(side: DataFrame, kind: DataFrame) -> DataFrame:
        key = [*window, "sub_type", "tables_key"]
        left = kind.join(common, [*window, "name"]).groupBy(*key)
        left = left.agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("tables"))
        return (
            side.join(left, key)
            .groupBy(*window, "cell", "us", "sub_type", "tables")
            .agg(F.sum("n").alias("n"), F.min("tables_key").alias("least_tables"))
        )

    return cut(checks, kinds[0]), cut(fixes, kinds[1])


def _matched(moments: DataFrame, width: int, cells: int) -> DataFrame:
    """Pairs per check moment and (check kind, fix kind), with the earliest fix of each.

    A kind is a sub_type with a table set.  ``moments`` counts statements per kind and time.
    The window ``(t, t + width]`` is ``cells`` cells wide, cell = time div (width / cells), so
    it covers the rest of the check's own cell, the next ``cells`` cells in full, less what lies
    beyond ``t + width`` in the last of them.  Fixes shifted back by the window fall into the
    check's cell, which makes the first and last part one signed running sum within one cell,
    and the middle part one signed running sum over cell totals.  A task thus sorts the moments
    of a fiftieth of a cell, or the cells of two windows, however many statements they stand for.
    """
    cell_width = width // cells
    if cell_width * cells != width:
        raise ValueError("the window must be a whole number of cells")
    schema = "parsing_schema_name"
    bucket_of = floor_div(F.col("cell"), cells)
    moments = moments.withColumn("cell", floor_div(F.col("us"), cell_width))
    columns = [schema, "cell", "us", "sub_type", "tables_key", "n"]
    # fixes in the window of their own bucket, and of the one before
    checks, fixes = _cut_kinds(
        moments.filter("is_check").select(*columns, bucket_of.alias("bucket")),
        moments.filter("not is_check").select(*columns, F.explode(F.array(bucket_of, bucket_of - 1)).alias("bucket")),
    )
    checks, fixes = (
        stage(
            side.withColumnsRenamed({"sub_type": f"{p}_pattern", "tables": f"{p}_tables", "least_tables": f"{p}_least"}),
            f"{p}-kinds",
        )
        for side, p in ((checks, "check"), (fixes, "fix"))
    )
    check_kind, fix_kind = ["check_pattern", "check_tables"], ["fix_pattern", "fix_tables"]
    earliest = F.min(F.struct(F.col("us"), F.col("fix_least").alias("tables"))).alias("first")
    check_cells = checks.select(schema, "cell", "bucket", *check_kind).distinct()
    fix_cells = fixes.groupBy(schema, "bucket", "cell", *fix_kind).agg(F.sum("n").alias("n"), earliest)

    # check cells with the fix kinds of their window that share a table
    near = fix_cells.select(schema, "bucket", *fix_kind).distinct()
    tables = _shared(F.col("check_tables"), F.col("fix_tables"))
    partners = (
        check_cells.withColumn("shared_table", F.explode(F.split("check_tables", ",")))
        .join(
            near.withColumn("shared_table", F.explode(F.split("fix_tables", ","))),
            [schema, "bucket", "shared_table"],
        )
        .filter(F.col("shared_table") == tables[0])
        .drop("shared_table")
        .withColumn("tables_key", F.array_join(tables, ","))
    )

    nothing = F.lit(None).cast("struct<us: bigint, tables: string>")

    def mark(**fields) -> Column:
        return F.struct(*[value.alias(name) for name, value in fields.items()])

    # middle part: whole cells; those of the next bucket end where the window does
    cell_marks = fix_cells.select(
        schema,
        "bucket",
        *fix_kind,
        F.inline(
            F.array(
                mark(cell=F.col("cell"), n=F.col("n"), first=F.col("first")),
                mark(cell=F.col("cell") - cells, n=-F.col("n"), first=nothing),
            )
        ),
    )
    per_cell = (
        _after(partners, cell_marks, [schema, "bucket", *fix_kind], "cell")
        .withColumnRenamed("after_n", "later_n")
        .withColumnRenamed("after_first", "later_first")
    )

    # first and last part: within one cell
    first = F.struct(F.col("us"), F.col("fix_least").alias("tables"))
    moment_marks = fixes.select(
        schema,
        "bucket",
        *fix_kind,
        F.inline(
            F.array(
                mark(cell=F.col("cell"), us=F.col("us"), n=F.col("n"), first=first),
                mark(cell=F.col("cell") - cells, us=F.col("us") - width, n=-F.col("n"), first=nothing),
            )
        ),
    )
    points = checks.withColumnRenamed("n", "checks").join(per_cell, [schema, "bucket", "cell", *check_kind])
    return (
        _after(points, moment_marks, [schema, "bucket", "cell", *fix_kind], "us", max(1, cell_width // BLOCKS))
        .withColumn("pairs", F.col("checks") * (F.col("after_n") + F.col("later_n")))
        .withColumn("fix", F.coalesce("after_first", "later_first"))
        .filter(F.col("pairs") > 0)
    )


def _moments(statements: DataFrame) -> DataFrame:
    key = ["is_check", "parsing_schema_name", "us", "sub_type", "tables_key"]
    return stage(statements.groupBy(*key).agg(F.count("*").alias("n")), "moments")


def pair_counts(labelled: DataFrame, window_minutes: int = P.WINDOW_MINUTES, cells: int = 60) -> DataFrame:
    """Pairs per schema, day of the check, and pattern (check kind, fix kind, shared tables), without listing them."""
    matched = _matched(_moments(integrity_statements(labelled)), window_minutes * MINUTE, cells)
    day = (F.lit("1970-01-01").cast("date") + floor_div(F.col("us"), DAY).cast("int")).alias("day")
    keys = ["parsing_schema_name", day, "check_pattern", "fix_pattern", F.split("tables_key", ",").alias("tables")]
    return matched.groupBy(*keys).agg(F.sum("pairs").alias("pairs"))


def _first_seen(data: DataFrame) -> DataFrame:
    time = "first_time" if "first_time" in data.columns else "last_load_time"
    return (
        data.filter(F.col("parsing_schema_name").isNotNull())
        .groupBy("parsing_schema_name")
        .agg(micros(F.min(time)).alias("schema_first_us"))
    )


def fold_sequences(
    labelled: DataFrame,
    window_minutes: int = P.WINDOW_MINUTES,
    cells: int = 60,
    seen_in: DataFrame | None = None,
    texts_from: DataFrame | None = None,
) -> DataFrame:
    """Recurring patterns (check kind, fix kind, shared tables) over all schemas.

    Each has the number of its pairs and, as representative, the first in discovery order.  Of
    statements with equal schema, time and kind the least id stands for all.  ``seen_in`` is where
    the first appearance of a schema is read from: the unlabelled log or its activity summary;
    ``texts_from`` is where the representatives' texts are looked up, by default the labelled log.  Both
    spare labelling the log once more.
    """
    schema = "parsing_schema_name"
    statements = integrity_statements(labelled)
    first_seen = _first_seen(labelled if seen_in is None else seen_in)
    first = F.struct(
        "schema_first_us", schema, F.col("us").alias("check_us"), F.col("fix.us").alias("fix_us"),
        F.col("check_least").alias("check_tables"), F.col("fix.tables").alias("fix_tables"),
    )
    patterns = stage(
        _matched(_moments(statements), window_minutes * MINUTE, cells)
        .join(first_seen, schema)
        .groupBy("check_pattern", "fix_pattern", "tables_key")
        .agg(F.sum("pairs").alias("occurrence_count"), F.min(first).alias("first"))
        .select("check_pattern", "fix_pattern", "tables_key", "occurrence_count", "first.*"),
        "patterns",
    )

    # the representatives: the least id of each moment wanted, then their texts by one pruned scan
    moment = ["is_check", schema, "us", "sub_type", "tables_key"]

    def moments_of(is_check: bool, prefix: str) -> Column:
        names = [schema, f"{prefix}_us", f"{prefix}_pattern", f"{prefix}_tables"]
        return F.struct(
            F.lit(is_check).alias("is_check"), *[F.col(c).alias(m) for c, m in zip(names, moment[1:])]
        )

    wanted = patterns.select(
        F.inline(F.array(moments_of(True, "check"), moments_of(False, "fix")))
    ).distinct()
    least = F.min(F.struct("sql_id", "text_hash", "confidence")).alias("s")
    chosen = statements.join(wanted, moment).groupBy(*moment).agg(least).select(*moment, "s.*")
    chosen = stage(chosen, "representatives")
    found = ["sql_id", schema, "us", "text_hash"]
    texts = _texts(labelled if texts_from is None else texts_from).join(chosen.select(*found).distinct(), found, "left_semi")
    texts = chosen.join(texts.dropDuplicates(found), found)

    def texts_of(check: bool, prefix: str) -> DataFrame:
        return texts.filter(F.col("is_check") == check).select(
            schema,
            F.col("us").alias(f"{prefix}_us"),
            F.col("sub_type").alias(f"{prefix}_pattern"),
            F.col("tables_key").alias(f"{prefix}_tables"),
            F.struct("sql_id", "sql_fulltext", "confidence").alias(f"_{prefix}"),
        )

    check, fix = texts_of(True, "check"), texts_of(False, "fix")
    both = patterns.join(check, [schema, "check_us", "check_pattern", "check_tables"]).join(
        fix, [schema, "fix_us", "fix_pattern", "fix_tables"]
    )
    return both.select(
        F.concat_ws("_", "_check.sql_id", "_fix.sql_id").alias("sequence_id"),
        F.col("_check.sql_fulltext").alias("check_sql"),
        F.col("_fix.sql_fulltext").alias("fix_sql"),
        "check_pattern",
        "fix_pattern",
        F.split("tables_key", ",").alias("tables"),
        issue_type("check_pattern", "fix_pattern").alias("issue_type"),
        F.least("_check.confidence", "_fix.confidence").alias("confidence"),
        "occurrence_count",
        "schema_first_us", schema, "check_us", "fix_us", "check_tables", "fix_tables", "tables_key",
    )


def first_discovered(sequences: DataFrame, k: int) -> DataFrame:
    return sequences.orderBy(*DISCOVERY_ORDER).limit(k)


def issue_type_totals(sequences: DataFrame) -> DataFrame:
    return sequences.groupBy("issue_type").agg(F.sum("occurrence_count").alias("occurrences"))


def issue_type_names(sequences: DataFrame) -> DataFrame:
    """(issue_type, kind, name, occurrences): the tables and check patterns of each issue type, a row each."""
    named = sequences.select("issue_type", "occurrence_count", F.explode("tables").alias("name"), F.lit("table").alias("kind"))
    kinds = sequences.filter("check_pattern <> ''").select(
        "issue_type", "occurrence_count", F.col("check_pattern").alias("name"), F.lit("pattern").alias("kind")
    )
    named = named.unionByName(kinds).groupBy("issue_type", "kind", "name")
    return named.agg(F.sum("occurrence_count").alias("occurrences"))


def top_issue_types(sequences: DataFrame, k: int = 5, most: int | None = None) -> DataFrame:
    """The ``k`` most frequent issue types over all sequences, with their tables and check patterns.

    Tables and patterns are made distinct per type before they are collected: all, or with ``most`` that many, those with
    the most occurrences, which bounds a row whatever the log; issue_type_names() gives all as rows.
    """
    top = issue_type_totals(sequences).orderBy(F.desc("occurrences"), "issue_type").limit(k)
    names = issue_type_names(sequences)
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("issue_type", "kind").orderBy(F.desc("occurrences"), "name"))
        names = names.withColumn("rank", rank).filter(F.col("rank") <= most)
    names = names.groupBy("issue_type").agg(
        *(
            F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("name")))).alias(n)
            for kind, n in (("table", "tables"), ("pattern", "patterns"))
        )
    )
    return top.join(names, "issue_type", "left").orderBy(F.desc("occurrences"), "issue_type")
