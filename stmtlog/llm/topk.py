"""Exact top-k search by inner product: branch and bound over blocks of dimensions in vertical layout.

Vectors are turned into integers and dealt to candidate blocks; queries form query blocks.  A cell is one query
block against one candidate block, both of bounded size.  In a cell the candidates lie column by column.  A few
candidates are scored in full to give each query a first k-th best score; then the scores of all others grow one
block of dimensions at a time, and a candidate stays with a query only while its partial score plus the most the
remaining dimensions can add, the product of the remaining norms, reaches the query's k-th best.  Survivors are
compacted after each block.  The best of all cells are merged per query.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stmtlog.plans.stage import stage

#: Rows of a candidate block and of a query block at most, about; the least number of candidate blocks.
CANDIDATES, QUERIES, LEAST_BLOCKS = 65_536, 8_192, 24
STEP, SEEDS = 16, 64
EXACT = float(2**53)
LONG = 2**63 - 1


def _matrix(vectors: pa.ChunkedArray, scale: int, dims: int) -> np.ndarray:
    """A row of floor(scale * x) for each vector; shorter vectors end in zeros."""
    vectors = vectors.combine_chunks()
    out = np.zeros((len(vectors), dims))
    if len(vectors):
        flat = np.asarray(vectors.flatten(), np.float64)
        lengths = np.diff(np.asarray(vectors.offsets))
        out[np.repeat(np.arange(len(lengths)), lengths), _runs(lengths)] = np.floor(flat * scale)
    return out


def _runs(lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= kth)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))


def search(queries: np.ndarray, own: np.ndarray, found: np.ndarray, ids: np.ndarray, k: int):
    """For each query row the places and scores of its k best candidates among those with another id."""
    n, dims = found.shape
    order = np.argsort(-np.abs(queries).sum(0), kind="stable")  # dimensions with most mass first
    columns, queries = np.ascontiguousarray(found[:, order].T), queries[:, order]
    cuts = [*range(0, dims, STEP), dims]
    rest = np.sqrt(np.array([(columns[c:] ** 2).sum(0) for c in cuts]))  # remaining norms by cut and candidate
    mass = np.sqrt(np.array([(queries[:, c:] ** 2).sum(1) for c in cuts]))
    first = queries[:, : cuts[1]] @ columns[: cuts[1]]
    seeds = np.linspace(0, n - 1, min(n, max(SEEDS, 2 * k))).astype(int)
    full = queries @ columns[:, seeds]
    for q in range(len(queries)):
        mine = ids != own[q]
        known = full[q][mine[seeds]]
        floor = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else -np.inf
        score, alive = first[q], np.flatnonzero(mine)
        score = score[alive]
        for step in range(1, len(cuts)):
            reach = score + mass[step, q] * rest[step, alive] * (1 + 1e-9)
            keep = reach >= floor - 1e-6
            alive, score = alive[keep], score[keep]
            if step + 1 < len(cuts):
                low, high = cuts[step], cuts[step + 1]
                score = score + queries[q, low:high] @ columns[low:high, alive]
        top = _best(score, ids[alive], k)
        yield alive[top], score[top]


def _exactly(queries: np.ndarray, own: np.ndarray, found: np.ndarray, ids: np.ndarray, k: int):
    """The same by whole numbers of any size, for components whose products doubles can't hold."""
    queries, found = (np.array([[int(x) for x in row] for row in m], object) for m in (queries, found))
    for q in range(len(queries)):
        alive = np.flatnonzero(ids != own[q])
        scores = [min(max(int((queries[q] * found[c]).sum()), -LONG - 1), LONG) for c in alive]
        top = sorted(range(len(alive)), key=lambda i: (-scores[i], ids[alive[i]]))[:k]
        yield alive[top], [scores[i] for i in top]


def _cell(left: pa.Table, right: pa.Table, scale: int, k: int) -> pa.Table:
    out = {"query_row": [], "query_id": [], "vec_id": [], "score": []}
    if left.num_rows and right.num_rows:
        lengths = [max(len(v) for v in t.column("vector")) for t in (left, right)]
        dims = max(1, *lengths)
        queries, found = (_matrix(t.column("vector"), scale, dims) for t in (left, right))
        own, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
        large = np.abs(queries).max(initial=0) * np.abs(found).max(initial=0) * dims >= EXACT
        rows = left.column("query_row").to_numpy()
        for q, (places, scores) in enumerate((_exactly if large else search)(queries, own, found, ids, k)):
            out["query_row"] += [rows[q]] * len(places)
            out["query_id"] += [own[q]] * len(places)
            out["vec_id"] += list(ids[places])
            out["score"] += [int(s) for s in scores]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best rows of ``vectors``.

    The score is the inner product of floor(scale * x), x as double; ties go to smaller vec_id.  Rows with the
    query's id are no candidates of it.  Rows without id, with a null vector or with a null or non-finite
    component take no part.  Missing components of a shorter vector count as zero.  A repeated row is a candidate
    as often as it occurs, and a repeated query is answered as often.  A score beyond the range of long counts as
    the end of that range.  Other columns are not looked at.
    """

    def usable(data: DataFrame) -> DataFrame:
        data = data.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return data.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & whole)

    asked = usable(queries).withColumn("query_row", F.monotonically_increasing_id())
    asked = stage(asked, "queries")
    rows, found = asked.count(), usable(vectors)
    groups = max(1, math.ceil(rows / QUERIES))
    blocks = max(LEAST_BLOCKS, math.ceil(found.count() / CANDIDATES))
    deal = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    asked = asked.withColumn("g", F.pmod(F.xxhash64("query_row"), F.lit(groups)).cast("int"))
    asked = asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = found.withColumn("b", deal(blocks)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    cells = asked.groupBy("g", "b").cogroup(found.groupBy("g", "b"))
    schema = "query_row long, query_id long, vec_id long, score long"
    best = cells.applyInArrow(partial(_cell, scale=scale, k=k), schema)
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("rank", place).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
