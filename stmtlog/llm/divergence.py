r"""How far the sources of a language lie apart: an audit on run-length columns.

Terms are runs of letters A-Z, lower-cased, and of characters beyond ASCII.  A language keeps the terms of at least
``least_docs`` of its documents; V is their number.  In a group (a language, or one of its sources) a kept term that occurs
``count`` times has the share p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), N the sum of the group's counts, all exact.

* Counts are summed per slice of text, then by Spark per language, source and term.
* A term's counts in the sources of its language are its row.  The vocabulary is reordered by these rows, sources and
  counts in turn, so that equal counts stand together; Spark's range partitioning splits the order over tasks, and
  batches of a partition are the blocks.
* Within a block each source is a column of run-length codes: where its count changes, and the count from there.
* The distance of two sources, the sum of f = abs(p - q) over all kept terms, takes one f for each stretch between
  boundaries of either column, times its length.  Columns meet in tiles of TILE sources by block, whatever their
  number is; a task holds two tiles of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtlog.llm import text as T
from stmtlog.plans.stage import stage

UNIT, EXTRA = 10**9, 5
#: Sources of a tile; bytes of text whose terms are counted at a time.
TILE, SLICE = 64, 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

COUNTED = "lang string, source string, term string, n long, docs long"


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and the text of each."""
    letter = _LETTER[data]
    starts, stops, first = T.words(np.where(letter, np.uint8(0x61), np.uint8(0x20)), offsets)
    ends = np.append(0, np.cumsum(stops - starts))
    buffers = [None, pa.py_buffer(ends), pa.py_buffer(T.LOWER[data[letter]])]
    found = pa.LargeStringArray.from_buffers(len(starts), *buffers[1:])
    return found, np.repeat(np.arange(len(first) - 1), np.diff(first))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per language, source and term of a slice; a group's row without a term says it occurs."""
    for part in T.slices(batches, "text", SLICE):
        lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
        group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        groups, of_doc = np.unique(group, return_inverse=True)
        found, doc = terms(*T.utf8(part.column("text")))
        found = found.dictionary_encode()
        words = max(1, len(found.dictionary))
        pairs, times = np.unique(doc * words + found.indices.to_numpy(), return_counts=True)
        keys, at = np.unique(of_doc[pairs // words] * words + pairs % words, return_inverse=True)
        n = np.bincount(at, times, len(keys)).astype(np.int64)
        docs = np.bincount(at, minlength=len(keys))
        owner = groups[np.append(keys // words, np.arange(len(groups)))]
        none = np.zeros(len(groups), np.int64)
        term = found.dictionary.take(pa.array(keys % words)).cast(pa.string())
        columns = [
            lang.dictionary.take(pa.array(owner // len(source.dictionary))),
            source.dictionary.take(pa.array(owner % len(source.dictionary))),
            pa.concat_arrays([term, pa.nulls(len(groups), pa.string())]),
            pa.array(np.append(n, none)), pa.array(np.append(docs, none)),
        ]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COUNTED.split(", ")])


COLUMNS = "lang string, block long, length int, source string, starts array<int>, counts array<long>"


def run_lengths(places: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the counts of a column change, from 0, and the count from there; 0 where no place is given."""
    whole = np.zeros(length, np.int64)
    whole[places] = counts
    starts = np.append(0, np.flatnonzero(whole[1:] != whole[:-1]) + 1)
    return starts, whole[starts]


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length columns of each source that occurs in a block: a language's rows in one batch."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        listed = batch.column("row")
        flat, lists = listed.flatten(), np.asarray(listed.offsets)
        lists = lists - lists[0]
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists))
        source = flat.field("source").dictionary_encode()
        code, n = source.indices.to_numpy(), flat.field("n").to_numpy()
        lang = batch.column("lang").to_pylist()
        edges = [0, *(i for i in range(1, len(lang)) if lang[i] != lang[i - 1]), len(lang)]
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            if first == last:
                continue
            part = slice(lists[first], lists[last])
            order = np.argsort(code[part], kind="stable")
            codes, places, counts = code[part][order], owner[part][order] - first, n[part][order]
            some, begin = np.unique(codes, return_index=True)
            rows = [
                run_lengths(places[i:j], counts[i:j], last - first)
                for i, j in zip(begin, np.append(begin[1:], len(codes)), strict=True)
            ]
            columns = [
                pa.array([lang[first]] * len(some)), pa.array([number] * len(some), pa.int64()),
                pa.array([last - first] * len(some), pa.int32()), source.dictionary.take(pa.array(some)),
                pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COLUMNS.split(", ")])
            number += 1


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """p of counts in a group whose counts sum to ``total``, in whole numbers of any size."""
    some, at = np.unique(counts, return_inverse=True)
    return np.array([1 + UNIT * (int(c) + EXTRA) // (total + EXTRA * kept) for c in some], np.int64)[at]


def distance(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], length: int) -> int:
    """The sum of abs(p - q) over ``length`` terms from two run-length columns (starts, shares)."""
    edges = np.union1d(left[0], right[0])
    p, q = (values[np.searchsorted(starts, edges, side="right") - 1] for starts, values in (left, right))
    return int((np.abs(p - q) * np.diff(np.append(edges, length))).sum())


PARTIAL = "lang string, low int, high int, value long"


def _tiles(table: pa.Table, tile: int) -> pa.Table:
    """Distances within one block between the sources of two tiles, or of one."""
    table = table.combine_chunks()
    lang, length = table["lang"][0].as_py(), table["length"][0].as_py()
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    sides: tuple[list, list] = ([], [])
    for row in table.select(["number", "total", "kept", "starts", "counts"]).to_pylist():
        starts = np.array([0] if row["starts"] is None else row["starts"], np.int64)
        counts = np.array([0] if row["counts"] is None else row["counts"], np.int64)
        column = starts, shares(counts, row["total"], row["kept"])
        for side, wanted in zip(sides, (low, high), strict=True):
            if row["number"] // tile == wanted:
                side.append((row["number"], column))
    out = [(i, j, distance(a, b, length)) for i, a in sides[0] for j, b in sides[1] if i < j]
    columns = [[lang] * len(out), *([o[k] for o in out] for k in range(3))]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "low", "high", "value"])


def _share(count: str, total: str) -> Column:
    whole = "decimal(20, 0)"
    return F.expr(f"1 + {UNIT} * CAST({count} + {EXTRA} AS {whole}) DIV CAST({total} + {EXTRA} * kept AS {whole})")


def audit(
    docs: DataFrame, least_docs: int = 30, most_terms: int = 50, text: str = "text", lang: str = "lang", source: str = "source",
    tile: int = TILE,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for every pair of language and source that occurs.

    part 'pair': item is each other source of the language, value its distance.  part 'term': item is a kept term that
    occurs in the group with p above that of the whole language, value the difference; the ``most_terms`` largest.
    rank counts from 1 by falling value, then item.

    Null text, language and source are empty; a group without terms, or a language without kept terms, has its pairs
    (value 0 without kept terms).  Repeated rows count each.  No rows give no rows; other columns are not looked at.
    A document's terms and a term's counts by source are held in memory by one task.
    """
    named = zip((lang, source, text), ("lang", "source", "text"), strict=True)
    docs = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in named))
    counts = docs.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term")
    counts = stage(counts.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
    rows = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("row")
    )
    rows = stage(rows.filter(F.col("docs") >= least_docs).drop("docs"), "term-rows")
    groups = stage(_groups(counts, rows), "term-groups")
    blocks = rows.select("lang", "row").repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")
    columns = stage(blocks.mapInArrow(_columns, COLUMNS), "term-columns")
    every = columns.select("lang", "block", "length").distinct().join(groups, "lang")
    every = every.join(columns.drop("length"), ["lang", "block", "source"], "left")
    met = every.withColumn("tile", F.floor(F.col("number") / tile).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / tile).cast("int")))
    )
    met = met.select(
        "lang", "block", "length", "number", "total", "kept", "starts", "counts", F.least("tile", "other").alias("low"),
        F.greatest("tile", "other").alias("high"),
    )
    partial = met.groupBy("lang", "block", "low", "high").applyInArrow(lambda t: _tiles(t, tile), PARTIAL)
    return _pairs(groups, partial.groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))).unionByName(
        _terms(groups, rows, most_terms)
    )


def _groups(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """(lang, source, number, sources, total, kept, lang_total): a row for each group, numbered within its language."""
    total = rows.select("lang", F.inline("row")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = rows.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("number")
    sources = F.count("*").over(Window.partitionBy("lang")).cast("int").alias("sources")
    groups = counts.filter("term IS NULL").select("lang", "source", number, sources)
    return groups.join(total, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["total", "kept", "lang_total"])


def _ranked(data: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return data.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _pairs(groups: DataFrame, distances: DataFrame) -> DataFrame:
    one = groups.select("lang", "source", "number")
    other = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("other"))
    low, high = F.least("number", "other").alias("low"), F.greatest("number", "other").alias("high")
    pairs = one.join(other, "lang").filter("number <> other").select("lang", "source", "item", low, high)
    pairs = pairs.join(distances, ["lang", "low", "high"], "left")
    return _ranked(pairs.withColumn("value", F.coalesce("value", F.lit(0))), "pair")


def _terms(groups: DataFrame, rows: DataFrame, most: int) -> DataFrame:
    each = rows.select("lang", F.col("term").alias("item"), F.col("n").alias("lang_n"), F.inline("row"))
    each = each.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    each = each.withColumn("value", _share("n", "total") - _share("lang_n", "lang_total")).filter("n > 0 AND value > 0")
    return _ranked(each, "term").filter(F.col("rank") <= most)
