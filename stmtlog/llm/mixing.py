"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents stand in an order drawn by a hash of id and text, cut into blocks of some thousand words.
The mix takes whole rounds of a source, then the first blocks of one more round.  In that round documents longer than
AROUND words are settled first, the longest size class before the others: each is taken or passed over against the
room that is left, so that the shorter ones can always fill it.  The place in which the target lies among the others
is filled with the documents that fit.  The block quotas of all sources are dealt to the output shards by
a tree: each node splits its quotas between its halves by a multivariate-hypergeometric draw, so every shard
gets a random composition and the quotas are exact.  A node's draw depends on its place alone, so a task makes
the draws on the way to its own blocks and no others.  Within a shard, documents are shuffled by a hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtlog.plans.stage import stage

BLOCK_WORDS, SHARD_WORDS = 65_536, 4_000_000
#: Words before and after the target among which documents are chosen to meet it; documents longer than that are settled first.
AROUND = 16_384
#: Rows of a source that one window task sorts, about; blocks of all sources the draws can hold.
BUCKET_ROWS, MOST_BLOCKS = 1_000, 5e8


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """``sizes`` (source, words, documents) with weight and target.

    Sources by code point, null last, take the weights in turn.  Shares of all words by weight are cut to
    ``most`` times the source's own words and the excess goes to the others by weight until none is above, so
    a target is the smaller of that cut and one common level times the weight.
    """
    every, rank = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1)
    sizes = sizes.withColumn("weight", weight.cast("double")).withColumn("cut", F.col("words") * F.lit(float(most)))
    by_cut = Window.orderBy(F.col("cut") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cut.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("words").over(every) - F.coalesce(F.sum("cut").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(by_cut.rowsBetween(0, Window.unboundedFollowing))
    sizes = sizes.withColumn("level", rest / weights_left).withColumn("at", F.row_number().over(by_cut))
    below = F.when(F.col("level") * F.col("weight") < F.col("cut"), F.struct("at", "level"))
    level = F.min(below).over(every)["level"]
    target = F.coalesce(F.least("cut", level * F.col("weight")), F.col("cut"))
    return sizes.withColumn("target", target).drop("cut", "level", "at")


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the documents around the target, those that fit, in their drawn order."""
    rows = rows.sort_values(["h", "uid"])
    size, most = rows["size"].to_numpy(), rows["left"].to_numpy()
    room, times = int(rows["rest"].iloc[0] - rows["start"].min()), np.zeros(len(rows), np.int64)
    for turn in range(int(most.max())):  # once more only where once is too little
        for i in np.flatnonzero((most > turn) & (size <= room)):
            if size[i] <= room:
                times[i] += 1
                room -= int(size[i])
    for _ in range(3):  # exchange one for another as long as the room gets smaller
        inside, outside = np.flatnonzero(times > 0), np.flatnonzero(times < most)
        inside = inside[np.argsort(size[inside], kind="stable")]
        at = np.searchsorted(size[inside], size[outside] - room)
        gain = np.where(at < len(inside), size[outside] - np.append(size[inside], 0)[at], 0)
        if not len(gain) or gain.max() <= 0:
            break
        best = int(gain.argmax())
        times[inside[at[best]]] -= 1
        times[outside[best]] += 1
        room -= int(gain[best])
    return pd.DataFrame({"uid": rows["uid"], "chosen": times})[times > 0]


def _size_class(size: Column) -> Column:
    """0 up to AROUND words, then k for those above AROUND * 2**(k - 1) up to AROUND * 2**k."""
    return F.when(size > AROUND, F.length(F.bin(F.floor((size - 1) / AROUND).cast("bigint")))).otherwise(0).cast("int")


@dataclass
class _Last:
    """What a source still gives: whole rounds so far, copies of a document left, words left."""

    rounds: int
    left: int
    rest: int

    def whole(self, words: int) -> None:
        """Whole rounds of documents with that many words, as far as they fit."""
        n = min(self.left, self.rest // words) if words else 0
        self.rounds, self.left, self.rest = self.rounds + n, self.left - n, self.rest - n * words


def _settle_long(rows: DataFrame, sums: DataFrame, last: dict[int, _Last]) -> list[tuple]:
    """(of, class, rounds, cut_h, cut_uid, extra) for each source and size class from 1: which documents the last round takes.

    ``rows`` (at, bucket, class, h, uid, size); ``sums`` (at, bucket, class, n): their words.  From the longest class
    down, the documents that end before the room does, counted over this class and the shorter ones, are taken:
    those before (cut_h, cut_uid).  The one over the cut is passed over if the shorter ones can fill the room;
    if they can't, ``extra`` is the longest that fits, one already taken only where no other does.  As the room left
    then is less than this class's sizes, one is enough.  ``last`` holds the rest for the documents of class 0.
    """
    spark, out = rows.sparkSession, []
    words: dict[int, dict[int, int]] = {}
    for r in sums.groupBy("at", "class").agg(F.sum("n").alias("n")).collect():
        words.setdefault(r["at"], {})[r["class"]] = r["n"]
    for k in sorted({k for x in words.values() for k in x if k}, reverse=True):
        shorter = {a: sum(n for j, n in x.items() if j < k) for a, x in words.items() if k in x}
        for a in shorter:
            last[a].whole(shorter[a] + words[a][k])
        open_ = [(a, last[a].rest) for a in shorter if last[a].left and last[a].rest > 0]
        room = F.broadcast(spark.createDataFrame(open_, "at long, room long"))
        n = sums.filter(F.col("class") <= k).join(room, "at").groupBy("at", "bucket", "room").agg(F.sum("n").alias("n"))
        before = Window.partitionBy("at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        n = n.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        n = n.filter((F.col("base") <= F.col("room")) & (F.col("room") < F.col("base") + F.col("n"))).drop("n")
        order = Window.partitionBy("at").orderBy("h", "uid").rowsBetween(Window.unboundedPreceding, 0)
        inside = rows.filter(F.col("class") <= k).join(n, ["at", "bucket"])
        inside = inside.withColumn("end", F.col("base") + F.sum("size").over(order)).filter(F.col("end") > F.col("room"))
        cut = {r["at"]: r["c"] for r in inside.groupBy("at").agg(F.min(F.struct("h", "uid")).alias("c")).collect()}
        cuts = spark.createDataFrame([(a, c.h, c.uid) for a, c in cut.items()], "at long, cut_h long, cut_uid long")
        long = rows.filter(F.col("class") == k).join(F.broadcast(cuts), "at")
        taken = (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("uid") < F.col("cut_uid")))
        for r in long.filter(taken).groupBy("at").agg(F.sum("size").alias("n")).collect():
            last[r["at"]].rest -= r["n"]
        short = [(a, last[a].rest, last[a].left) for a in cut if last[a].rest > shorter[a]]
        extra = {}
        if short:
            fit = long.join(F.broadcast(spark.createDataFrame(short, "at long, room long, left long")), "at")
            fit = fit.filter((F.col("size") <= F.col("room")) & (~taken | (F.col("left") > 1)))
            best = fit.groupBy("at").agg(F.max(F.struct((~taken).alias("new"), "size", "h", "uid")).alias("x")).collect()
            extra = {r["at"]: r["x"] for r in best}
        for a in shorter:
            if a in extra:
                last[a].rest -= extra[a]["size"]
            c = cut.get(a)
            out.append((a, k, last[a].rounds, c and c.h, c and c.uid, extra[a].uid if a in extra else None))
    for a, x in words.items():
        last[a].whole(x.get(0, 0))
    return out


class Tree:
    """Which shard each block goes to, for block quotas by source and a number of shards."""

    def __init__(self, quotas: np.ndarray, shards: int, seed: int):
        self.quotas, self.shards, self.seed = quotas, shards, seed

    def shard(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(source), np.int64)
        todo = [(0, self.shards, self.quotas, np.arange(len(source)), block)]
        while todo:
            low, high, quotas, rows, place = todo.pop()
            if not len(rows):
                continue
            if high - low == 1:
                out[rows] = low
                continue
            middle = (low + high) // 2
            draw = np.random.default_rng([self.seed, low, high])
            n = int(quotas.sum()) * (middle - low) // (high - low)
            left = draw.multivariate_hypergeometric(quotas, n, method="marginals")
            first = place < left[source[rows]]
            todo.append((low, middle, left, rows[first], place[first]))
            todo.append((middle, high, quotas - left, rows[~first], (place - left[source[rows]])[~first]))
        return out


def _dealt(batches: Iterator[pa.RecordBatch], tree: Tree, seed: int) -> Iterator[pa.RecordBatch]:
    """One row for each document, with its copies: round, shard, place."""
    for batch in batches:
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        copies, source, block, blocks = (get(c).astype(np.int64) for c in ("copies", "at", "block", "blocks"))
        row = np.repeat(np.arange(len(copies)), copies)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
        shard = tree.shard(source[row], turn * blocks[row] + block[row])
        uid = get("h").astype(np.int64).view(np.uint64)[row] + (turn + seed + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        uid = (uid ^ (uid >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        place = (uid ^ (uid >> np.uint64(29))).view(np.int64)
        fields = [pa.array(turn, pa.int32()), pa.array(shard, pa.int64()), pa.array(place, pa.int64())]
        items = pa.StructArray.from_arrays(fields, names=["round", "shard", "place"])
        drawn = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(copies)), pa.int32()), items)
        names = ["uid", "doc_id", "size", "source_size", "target"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), drawn], [*names, "drawn"])


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    most: int = 3,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    row: str | None = None,
) -> DataFrame:
    """(uid, doc_id, size, source_size, target, drawn): one row for each row of ``docs``.

    ``drawn`` lists the copies the mix takes: round, shard, and the place that orders the shard.  ``uid`` is the
    column ``row`` of ``docs``, without one monotonically_increasing_id(); see take().  size is the number of words; source_size and target are the
    source's words, its own and those it should give.  A source gives whole documents, whose words come to its
    target but for less than the smallest document that could still be taken around it; none is taken more than
    ``most`` times.  A document with more words than the room it meets is passed over and others fill the room, so
    a source is left short by more than that only where it has no documents left that fit.

    A null text has no words; documents without words are taken in whole rounds only.  A null source is a
    source.  Repeated rows are documents of their own.  Draws depend on seed, ids and texts, not on how rows are
    spread.  No documents give no rows.  Other columns are not looked at.  The driver holds one row per source.
    """
    key = F.xxhash64(F.lit(seed), F.col(doc_id).cast("bigint"), F.col(text))
    rows = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("uid"), F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("h"),
    )
    rows = stage(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("documents"))
    aims = stage(targets(sizes, weights, most), "targets")
    total = aims.agg(F.sum("words"), F.sum("target")).first()
    block_words = max(BLOCK_WORDS, int((total[0] or 0) * most / MOST_BLOCKS))
    rounds = F.when(F.col("words") > 0, F.floor(F.round("target") / F.col("words"))).otherwise(0)
    aims = aims.withColumn("rounds", rounds.cast("bigint"))
    aims = aims.withColumn("rest", (F.round("target") - F.col("rounds") * F.col("words")).cast("bigint"))
    aims = aims.withColumn("blocks", F.greatest(F.ceil(F.col("words") / block_words), F.lit(1)).cast("bigint"))
    aims = aims.withColumn("buckets", F.ceil(F.col("documents") / BUCKET_ROWS).cast("bigint"))
    quota = F.col("rounds") * F.col("blocks") + F.least(F.floor(F.col("rest") / block_words) + 1, "blocks")
    listed = aims.select("source", "rounds", "rest", quota.cast("bigint").alias("quota"))
    listed = listed.orderBy(F.col("source").asc_nulls_last()).collect()
    spark = docs.sparkSession
    numbered = [(r.source, i) for i, r in enumerate(listed)]
    numbers = spark.createDataFrame(numbered, "source string, at long")
    aims = aims.join(numbers, aims["source"].eqNullSafe(numbers["source"])).drop(numbers["source"])
    aims = aims.withColumnRenamed("source", "of")

    rows = rows.join(aims, rows["source"].eqNullSafe(aims["of"])).drop("of")
    bucket = F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("buckets")), F.col("buckets") - 1)
    rows = rows.withColumn("class", _size_class(F.col("size")))
    rows = stage(rows.withColumn("bucket", bucket), "rows")
    sums = stage(rows.groupBy("at", "bucket", "class").agg(F.sum("size").alias("n")), "sums")
    short = F.sum(F.when(F.col("class") == 0, F.col("n")).otherwise(0))
    by_bucket = sums.groupBy("at", "bucket").agg(F.sum("n").alias("n"), short.alias("short"))
    before = Window.partitionBy("at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base, base_short = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("n", "short"))
    by_bucket = by_bucket.select("at", "bucket", base.alias("base"), base_short.alias("base_short"))
    within = Window.partitionBy("at", "bucket").orderBy("h", "uid").rowsBetween(Window.unboundedPreceding, -1)
    size_short = F.when(F.col("class") == 0, F.col("size")).otherwise(0)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.withColumn("within_short", F.coalesce(F.sum(size_short).over(within), F.lit(0)))
    rows = rows.join(by_bucket, ["at", "bucket"]).withColumn("start", F.col("base") + F.col("within"))
    rows = rows.withColumn("start_short", F.col("base_short") + F.col("within_short"))
    rows = rows.withColumn("block", F.least(F.floor(F.col("start") / block_words), F.col("blocks") - 1))
    rows = stage(rows.drop("base", "base_short", "within", "within_short", "source", "weight", "rounds"), "ordered")

    last = {i: _Last(r.rounds, most - r.rounds, r.rest) for i, r in enumerate(listed)}
    settled = _settle_long(rows.select("at", "bucket", "class", "h", "uid", "size"), sums, last)
    settled = [(a, k, n, None, None, h, u, x) for a, k, n, h, u, x in settled]
    settled += [(a, 0, x.rounds, x.left, x.rest, None, None, None) for a, x in last.items()]
    settled = spark.createDataFrame(
        settled, "at long, class int, rounds long, left long, room long, cut_h long, cut_uid long, extra long"
    )
    rows = rows.join(F.broadcast(settled), ["at", "class"])
    end = F.col("start_short") + F.col("size")
    sure = end <= F.col("room") - AROUND
    around = (F.col("class") == 0) & (F.col("size") > 0) & ~sure & (F.col("start_short") < F.col("room") + AROUND)
    around &= (F.col("room") > 0) & (F.col("left") > 0)
    chosen = rows.filter(around).select(
        "at", "uid", "h", F.col("start_short").alias("start"), "size", F.col("room").alias("rest"), "left"
    )
    chosen = chosen.groupBy("at").applyInPandas(_fill, "uid long, chosen long")
    rows = rows.join(chosen, "uid", "left")
    before_cut = (F.col("h") < F.col("cut_h")) | ((F.col("h") == F.col("cut_h")) & (F.col("uid") < F.col("cut_uid")))
    long = F.coalesce(before_cut, F.lit(False)).cast("bigint") + F.coalesce(F.col("uid") == F.col("extra"), F.lit(False)).cast("bigint")
    sure = ((F.col("size") > 0) & sure & (F.col("left") > 0)).cast("bigint")
    partly = F.when(F.col("class") > 0, long).otherwise(F.coalesce("chosen", sure))
    rows = rows.withColumn("copies", F.col("rounds") + partly).withColumnRenamed("words", "source_size")
    # a document taken beyond the quota's last block stands in that block
    end_block = F.floor(F.col("rest") / block_words)
    rows = rows.withColumn("block", F.when(partly > 0, F.least("block", end_block)).otherwise(F.col("block")))
    shards = max(1, int(-(-(total[1] or 0) // SHARD_WORDS)))
    tree = Tree(np.array([r.quota for r in listed], np.int64), shards, seed)
    columns = ["uid", "doc_id", "size", "source_size", "target", "copies", "at", "block", "blocks", "h"]
    schema = (
        "uid long, doc_id long, size long, source_size long, target double,"
        " drawn array<struct<round: int, shard: long, place: long>>"
    )
    return rows.select(*columns).mapInArrow(partial(_dealt, tree=tree, seed=seed), schema)


def take(docs: DataFrame, mixed: DataFrame, row: str | None = None) -> DataFrame:
    """The copies that ``mixed``, made from the same ``docs``, takes, each shard in its own order.

    Rows are matched by the stored column ``row`` that ``mixed`` was made with, see stage_numbered(); it is left out of
    the result.  Without it they are counted anew, which is right only if ``docs`` comes in the same partitions again.
    """
    numbered = docs.withColumn("__uid", F.col(row) if row else F.monotonically_increasing_id())
    drawn = mixed.select(F.col("uid").alias("__uid"), F.explode("drawn").alias("__drawn"))
    taken = numbered.join(drawn, "__uid").repartition(F.col("__drawn.shard"))
    return taken.sortWithinPartitions("__drawn.shard", "__drawn.place").select(*(c for c in docs.columns if c != row))
