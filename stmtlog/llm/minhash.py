"""Near duplicates by SetSketch registers.

A text's set of word shingles is sketched by registers of exponentially spaced, truncated minima: register i
is floor(1 - log_b x), cut to 0..255, where x is the least of the elements' exponential values under hash i.
Registers of parts of a set merge by maximum.  Equal sets have equal registers, similar sets agree in many:

1. bands of registers put similar texts into common buckets;
2. within a bucket, the similarity of two texts is estimated by likelihood, jointly from the numbers of larger,
   smaller and equal registers and the exact set sizes; pairs that may reach the limit are kept as a forest,
   so a bucket gives fewer links than it has members.  A bucket over ``BUCKET`` members gives a star instead;
3. the components of those links hold all links there can be; within them all links are settled on the full
   sets, in cells of two blocks of bounded size, and the components of these exact links are the answer.

Texts with the same words are one node from the start, so copies are never compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlog.llm import text as T
from stmtlog.llm.graph import components
from stmtlog.plans.stage import stage

REGISTERS, BAND = 125, 5
BASE, RATE = 1.1, 20.0
#: Members of a bucket compared by estimate; rows of a block; shingles of a block, about.
BUCKET, BLOCK_ROWS, BLOCK_SHINGLES = 256, 512, 1_000_000
#: A pair stays if its limit's log-likelihood is at most this much below the best one.
DOUBT = 12.0

_RANDOM = np.random.default_rng(7)
_XOR = _RANDOM.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 2**63, BAND, dtype=np.uint64) | np.uint64(1)


def registers(hashed: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of registers for each text that has shingles; ``begin``: where each such text's hashes begin."""
    out = np.empty((len(begin), REGISTERS), np.uint8)
    for i in range(REGISTERS):
        least = np.minimum.reduceat((hashed ^ _XOR[i]) * _TIMES[i], begin)
        x = -np.log1p(-((least >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 255)
    return out


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A key for each text and band of its registers."""
    bands = rows.reshape(len(rows), -1, BAND).astype(np.uint64) + np.uint64(1)
    return T.mix((bands * _PLACE).sum(2) + np.arange(bands.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def may_link(one, other, n_one, n_other, limit: float) -> np.ndarray:
    """Whether pairs of registers and set sizes may belong to sets of at least ``limit`` similarity.

    With u and v the shares of the sizes and p(x) = -log_b(1 - x (b - 1) / b), a register of the first set is
    larger with probability p(u - v J) and smaller with p(v - u J); J runs over a grid.
    """
    larger, smaller = (one > other).sum(1)[:, None], (one < other).sum(1)[:, None]
    u = (n_one / (n_one + n_other))[:, None]
    most = np.minimum(u / (1 - u), (1 - u) / u)
    grid = np.append(np.linspace(0.3, 0.99, 70), 1 - 1e-6)[None, :] * most
    at = np.concatenate([grid, np.minimum(np.maximum(limit, grid), most * (1 - 1e-6))], 1)
    p = lambda x: -np.log1p(-np.maximum(x, 1e-9) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - (1 - u) * at), p((1 - u) - u * at)
    score = larger * np.log(up) + smaller * np.log(down)
    score += (one.shape[1] - larger - smaller) * np.log(np.maximum(1 - up - down, 1e-9))
    n = grid.shape[1]
    return (most[:, 0] >= limit - 1e-9) & (score[:, n:].max(1) >= score.max(1) - DOUBT)


def roots(k: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The smallest of 0..k-1 that each can reach over the pairs (one, other)."""
    label = np.arange(k)
    while True:
        new = label.copy()
        np.minimum.at(new, one, label[other])
        np.minimum.at(new, other, label[one])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _signatures(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for part in T.slices(batches, "text"):
        data, offsets = T.utf8(part.column("text"))
        hashed, begin = T.shingles(data, offsets, size)
        some = np.flatnonzero(np.diff(begin))
        n, rows, node = np.zeros(part.num_rows, np.int64), [None] * part.num_rows, [None] * part.num_rows
        sketches = registers(hashed, begin[some]) if len(some) else None
        lower = T.LOWER[data].tobytes()
        for at, d in enumerate(some):
            n[d] = len(np.unique(hashed[begin[d] : begin[d + 1]]))
            same = b" ".join(lower[offsets[d] : offsets[d + 1]].split())
            node[d] = int.from_bytes(hashlib.blake2b(same, digest_size=8).digest(), "big", signed=True)
            rows[d] = sketches[at].tobytes()
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), part.column("doc_id"), pa.array(n), pa.array(node, pa.int64()), pa.array(rows, pa.binary())],
            ["row", "doc_id", "n_shingles", "node", "registers"],
        )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint8)
            keys = band_keys(rows.reshape(-1, REGISTERS))
            node = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], ["bucket", "node"])


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``; what is kept back is the last group's rows."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cut = batch.num_rows
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        same = np.logical_and.reduce([c == c[-1] for c in columns])
        cut = batch.num_rows - int(same.sum())
        if rest and any(rest[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(rest)
            rest = []
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest)


def _bounds(table: pa.Table, *keys: str) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        column = table.column(k).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def _links(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([p[i] for p in pairs] or [np.zeros(0, np.int64)]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _within_buckets(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """Forests of the pairs that may be linked, bucket by bucket."""
    for table in _groups(batches, "bucket"):
        node, n = table.column("node").to_numpy(), table.column("n_shingles").to_numpy().astype(float)
        rows = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        bounds, found = _bounds(table, "bucket"), []
        sizes = np.diff(bounds)
        two = bounds[:-1][sizes == 2]
        for at in range(0, len(two), 10_000):
            x = two[at : at + 10_000]
            x = x[may_link(rows[x], rows[x + 1], n[x], n[x + 1], limit)]
            found.append((node[x], node[x + 1]))
        for start, k in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            one, other = np.triu_indices(k, 1)
            keep = np.concatenate(
                [
                    may_link(rows[start + i], rows[start + j], n[start + i], n[start + j], limit)
                    for i, j in ((one[c : c + 10_000], other[c : c + 10_000]) for c in range(0, len(one), 10_000))
                ]
            )
            root = roots(k, one[keep], other[keep])
            own = np.flatnonzero(root != np.arange(k))
            found.append((node[start + own], node[start + root[own]]))
        yield _links(found)


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of ``sets`` of distinct hashes."""
    k = len(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, begin = owner[order], np.concatenate([[0], np.cumsum(df)])[:-1]
    out = np.zeros((k, k), np.float32)
    for d in range(2, 9):  # rare shingles: their pairs; the others: products of 0/1 matrices
        at = begin[df == d]
        for i in range(d):
            for j in range(i + 1, d):
                out += np.bincount(owner[at + i] * k + owner[at + j], minlength=k * k).reshape(k, k) if len(at) else 0
    often = np.flatnonzero(df > 8)
    for c in range(0, len(often), 2048):
        cols = often[c : c + 2048]
        ones = np.zeros((k, len(cols)), np.float32)
        rows = np.concatenate([owner[begin[x] : begin[x] + df[x]] for x in cols])
        ones[rows, np.repeat(np.arange(len(cols)), df[cols])] = 1
        out += np.triu(ones @ ones.T, 1)
    return out


def _settle(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Forests of the exact links, cell by cell; of a cell with two blocks, of the links between them."""
    keys = ("coarse", "low", "high")
    for table in _groups(batches, *keys):
        found, bounds = [], _bounds(table, *keys)
        nodes, blocks = table.column("node").to_numpy(), table.column("block").to_numpy()
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            node, first = np.unique(nodes[start:stop], return_index=True)  # a repeated row once
            if len(node) < 2:
                continue
            first = first + start
            data, offsets = T.utf8(table.column("text").take(pa.array(first)))
            hashed, begin = T.shingles(data, offsets, size)
            sets = [np.unique(hashed[i:j]) for i, j in zip(begin[:-1], begin[1:], strict=True)]
            n = np.array([len(s) for s in sets])
            one, other = np.triu_indices(len(node), 1)
            if low[start] != high[start]:
                apart = blocks[first[one]] != blocks[first[other]]
                one, other = one[apart], other[apart]
            both = shared(sets)[one, other].astype(np.int64)
            linked = 100 * both >= percent * (n[one] + n[other] - both)
            root = roots(len(node), one[linked], other[linked])
            own = np.flatnonzero(root != np.arange(len(node)))
            found.append((node[own], node[root[own]]))
        yield _links(found)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 85, row: str | None = None
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row, component) for each row of ``docs``.

    Two rows are linked when 100 * intersection >= percent * union of their sets of distinct ``shingle``-word
    shingles (A-Z in lower case; fewer words: the whole sequence as one).  component_id is the smallest doc_id
    that can be reached over links, kept says that it is the row's own.  row is the column ``row`` of
    ``docs``, without one monotonically_increasing_id(); component a number of the component, null for an empty set;
    see one_of_each().

    A null or blank text has an empty set, is linked with nothing and keeps its own id.  Repeated rows, also of
    one doc_id, are linked as any others.  A row without doc_id has its component's id, or null, and is kept
    only where that is null.  Other columns are not looked at.  Texts are told apart by 64-bit hashes of their
    words, shingles by 64-bit hashes within a comparison.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    docs = docs.select(number.alias("row"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    limit = percent / 100
    schema = "row long, doc_id long, n_shingles long, node long, registers binary"
    signed = stage(docs.mapInArrow(partial(_signatures, size=shingle), schema), "signatures")

    sets = signed.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("least_id"), F.max("n_shingles").alias("n_shingles"), F.count("*").alias("copies")
    )
    first = signed.filter("node is not null").dropDuplicates(["node"]).select("node", "n_shingles", "registers")
    first = stage(first, "sketches")
    banded = first.select("node", "registers").mapInArrow(_bands, "bucket long, node long")
    banded = stage(banded, "bands")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("members"), F.min("node").alias("hub"))
    member = stage(banded.join(buckets.filter("members > 1"), "bucket"), "members")
    stars = member.filter(F.col("members") > BUCKET).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    rows = member.filter(F.col("members") <= BUCKET).select("bucket", "node").join(first, "node")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    forest = rows.mapInArrow(partial(_within_buckets, limit=limit), "a long, b long")
    coarse = stage(components(stars.union(forest)).withColumnRenamed("root", "coarse"), "coarse")

    member = coarse.join(first.select("node", "n_shingles"), "node")
    blocks = F.greatest(
        F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS), F.lit(1)
    ).cast("int")
    member = member.join(member.groupBy("coarse").agg(blocks.alias("blocks")), "coarse")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    member = member.select("node", "coarse", "blocks", block.alias("block"))
    member = member.join(sets.select("node", "least_id"), "node")
    known = docs.drop("row").mapInArrow(_named, "doc_id long, node long, text string")
    cells = known.join(member, (known.node == member.node) & known.doc_id.eqNullSafe(member.least_id))
    cells = cells.select(member.node, "text", "coarse", "blocks", "block")
    cells = cells.dropDuplicates(["node"]).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        "coarse", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node", "text"
    )
    keys = ("coarse", "low", "high")
    cells = cells.repartition(*keys).sortWithinPartitions(*keys)
    exact = cells.mapInArrow(partial(_settle, size=shingle, percent=percent), "a long, b long")
    linked = stage(components(exact), "linked")

    named = linked.join(sets.select("node", "least_id"), "node")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_node = sets.select("node", "least_id").join(linked, "node", "left").join(least, "root", "left")
    of_node = of_node.select(
        "node", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("root", "node").alias("component")
    )
    out = signed.drop("registers").join(of_node, "node", "left")
    least_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(least_id)
    return out.select("doc_id", "n_shingles", least_id.alias("component_id"), kept.alias("kept"), "row", "component")


def one_of_each(docs: DataFrame, groups: DataFrame, row: str | None = None) -> DataFrame:
    """Of ``docs``, one row of each component of ``groups``, made from it: the one with the smallest doc_id, of several
    the first.  Rows with an empty set stay.

    Rows are matched by the stored column ``row`` that ``groups`` was made with, see stage_numbered(); it is left out of
    the result.  Without it they are counted anew, which is right only if ``docs`` comes in the same partitions again.
    """
    kept = groups.filter("kept")
    first = kept.filter("component is not null").groupBy("component").agg(F.min("row").alias("__row")).select("__row")
    chosen = first.union(kept.filter("component is null").select("row"))
    numbered = docs.withColumn("__row", F.col(row) if row else F.monotonically_increasing_id())
    return numbered.join(chosen, "__row", "left_semi").select(*(c for c in docs.columns if c != row))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that have words, with their id and node."""
    for part in T.slices(batches, "text"):
        data, offsets = T.utf8(part.column("text"))
        lower, node, keep = T.LOWER[data].tobytes(), [], []
        for d in range(part.num_rows):
            if same := b" ".join(lower[offsets[d] : offsets[d + 1]].split()):
                node.append(int.from_bytes(hashlib.blake2b(same, digest_size=8).digest(), "big", signed=True))
                keep.append(d)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id").take(pa.array(keep, pa.int64())),
                pa.array(node, pa.int64()),
                part.column("text").take(pa.array(keep, pa.int64())),
            ],
            ["doc_id", "node", "text"],
        )
