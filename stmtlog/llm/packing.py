"""Packing documents into few sequences: dominance reduction, then best fit, on the histogram of lengths.

Pieces are no longer than a sequence, so the instance is a histogram with at most ``capacity`` entries however
many documents there are.  First, sets of pieces that dominate every other way to place a piece are fixed as
whole sequences (Martello and Toth); what is left is packed by best fit, longest first.  Both work on counts
and give a list of patterns with multiplicities.  Pieces then find their place by their rank among the pieces
of the same length, which is counted within each task and moved on by the counts of the tasks before.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stmtlog.llm import text as T
from stmtlog.plans.stage import stage

#: Words whose ids are remembered; bytes of text encoded at a time.
REMEMBERED, SLICE = 300_000, 2 << 20
_KIND = np.zeros(256, np.uint8)  # 1: a letter, 2: punctuation but for the apostrophe, of ASCII
_KIND[97:123] = 1
_KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 2
END = 0


@dataclass
class Pattern:
    """``times`` sequences with the same (length, copies) parts, in this order."""

    times: int
    parts: list[tuple[int, int]] = field(default_factory=list)


class _Lengths:
    """Counts by length, with the lengths that occur in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {length: n for length, n in counts.items() if n > 0}
        self.order = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.order.pop(bisect_right(self.order, length) - 1)

    def largest(self, most: int, without: tuple[int, ...] = ()) -> int | None:
        """The largest length up to ``most`` that occurs beyond the pieces ``without``."""
        at = bisect_right(self.order, most) - 1
        while at >= 0 and self.counts[self.order[at]] <= without.count(self.order[at]):
            at -= 1
        return self.order[at] if at >= 0 else None

    def smallest(self, n: int, without: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for length in self.order:
            out += [length] * max(0, min(n - len(out), self.counts[length] - without.count(length)))
            if len(out) == n:
                break
        return out


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences that some best packing has, and the counts left.

    A set that holds piece j dominates if every set that may stand with j can be exchanged against it, piece for
    piece no larger.  From the longest piece down, with room r = capacity - j and a the largest other piece
    within r:

    * nothing fits: {j};
    * a fills the room: {j, a};
    * no two others fit: {j, a};
    * no three others fit, and b, the largest that fits beside a, is as large as the smaller piece of any pair
      within r: {j, a, b}; and {j, a} if a is as large as every such pair together.

    Pieces for which none holds stay.  Taking pieces away keeps each condition true, so equal sets are fixed together.
    """
    left, fixed = _Lengths(counts), []
    for j in sorted(counts, reverse=True):
        while left.counts.get(j):
            room = capacity - j
            a = left.largest(room, (j,))
            if a is None:
                chosen = (j,)
            elif a == room:
                chosen = (j, a)
            else:
                small = left.smallest(3, (j,))
                if len(small) < 2 or sum(small[:2]) > room:
                    chosen = (j, a)
                elif len(small) < 3 or sum(small) > room:
                    b = left.largest(room - a, (j, a))
                    together, lesser = _pairs(left, room, j)
                    if a >= together:
                        chosen = (j, a)
                    elif b is not None and b >= lesser:
                        chosen = (j, a, b)
                    else:
                        break
                else:
                    break
            times = min(left.counts[x] // chosen.count(x) for x in chosen)
            for x in set(chosen):
                left.take(x, times * chosen.count(x))
            fixed.append(Pattern(times, [(x, chosen.count(x)) for x in dict.fromkeys(chosen)]))
    return _joined(fixed), left.counts


def _pairs(left: _Lengths, room: int, j: int) -> tuple[int, int]:
    """Of the pairs of other pieces within ``room``: the largest sum, and the largest smaller piece."""
    together = lesser = 0
    for x in left.order:
        if 2 * x > room:
            break
        if left.counts[x] <= (x == j):
            continue
        y = left.largest(room - x, (j, x))
        if y is not None and y >= x:
            together, lesser = max(together, x + y), x
    return together, lesser


def _joined(patterns: list[Pattern]) -> list[Pattern]:
    """Neighbours with the same parts as one."""
    out: list[Pattern] = []
    for p in patterns:
        if out and out[-1].parts == p.parts:
            out[-1].times += p.times
        else:
            out.append(p)
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Longest first, each piece into the sequence with least room for it; equal sequences are handled together."""
    open_: dict[int, list[Pattern]] = {}  # by room
    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        n = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            each, stay = room // length, []
            for p in open_.pop(room):
                full = min(p.times, n // each)
                rest = min(n - full * each, each) if full < p.times else 0
                for times, copies in ((full, each), (1 if rest else 0, rest), (p.times - full - bool(rest), 0)):
                    if times:
                        new = Pattern(times, p.parts + [(length, copies)] * bool(copies))
                        (stay if not copies else open_.setdefault(room - copies * length, [])).append(new)
                n -= full * each + rest
            if stay:
                open_.setdefault(room, []).extend(stay)
            if not n:
                break
        each = capacity // length
        for times, copies in ((n // each, each), (1, n % each)):
            if times and copies:
                open_.setdefault(capacity - copies * length, []).append(Pattern(times, [(length, copies)]))
    return [p for room in sorted(open_) for p in open_[room]]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every piece of the histogram once."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(patterns: list[Pattern]) -> dict[int, list[np.ndarray]]:
    """By length: where the runs of ranks begin, their first sequence, copies in a sequence and offset there."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for length, copies in p.parts:
            runs.setdefault(length, []).append((used.get(length, 0), sequence, copies, offset))
            used[length] = used.get(length, 0) + p.times * copies
            offset += length * copies
        sequence += p.times
    return {length: list(np.array(r, np.int64).T) for length, r in runs.items()}


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple[Tokenizer, dict[bytes, bytes]]:
    return Tokenizer.from_file(path), {}


def encode(texts: pa.Array, path: str, remembered: int = REMEMBERED) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers.

    The tokenizer ignores case, splits at white space and between letters and punctuation, and looks at nothing beyond
    such a place.  So the pieces of all texts between these places are encoded once, those not remembered
    together, and the texts are put together from them.  Texts in which a special token may stand are encoded
    as they are.
    """
    data, offsets = T.utf8(texts)
    tokenizer, known = _tokenizer(path)
    plain = T.LOWER[data]
    kind = _KIND[plain]
    between = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    ends = offsets + np.searchsorted(between, offsets, side="left")
    whole, plain = data.tobytes(), np.insert(plain, between, 0x20).tobytes()
    special = b"<|" in whole
    split = [
        None if special and b"<|" in whole[offsets[d] : offsets[d + 1]] else plain[i:j].split()
        for d, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True))
    ]
    words = {w for text in split if text for w in text}
    new = list(words.difference(known))
    if len(known) + len(new) > remembered:  # those of these texts stay, so the common ones do
        kept = {w: known[w] for w in words.intersection(known)}
        known.clear()
        known.update(kept)
    for at in range(0, len(new), 20_000):
        some = new[at : at + 20_000]
        found = tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
        known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, found, strict=True))
    for d, text in enumerate(split):
        if text is None:
            ids = tokenizer.encode(whole[offsets[d] : offsets[d + 1]].decode(), add_special_tokens=False).ids
            yield np.array(ids, "<u4").tobytes()
        else:
            yield b"".join(map(known.__getitem__, text))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, local long"


def _pieces(
    batches: Iterator[pa.RecordBatch], path: str, capacity: int, keep_ids: bool, memory: tuple[int, int, bool]
) -> Iterator[pa.RecordBatch]:
    """The pieces of all texts with their rank among those of the same length in this task."""
    task, ranks, end = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), np.array([END], "<u4").tobytes()
    remembered, size, forget = memory
    for part in T.slices(batches, "text", size):
        ids = part.column("doc_id").to_pylist()
        rows: list[tuple] = []
        for doc_id, encoded in zip(ids, encode(part.column("text"), path, remembered), strict=True):
            encoded += end
            for piece, at in enumerate(range(0, len(encoded), 4 * capacity)):
                own = encoded[at : at + 4 * capacity]
                n = len(own) // 4
                rows.append((doc_id, piece, at // 4, n, zlib.crc32(own), own if keep_ids else None, task, int(ranks[n])))
                ranks[n] += 1
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    if forget:
        _tokenizer(path)[1].clear()


def _placed(batches: Iterator[pa.RecordBatch], where: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            own = np.flatnonzero(length == x)
            begin, first, copies, at = where[x]
            run = np.searchsorted(begin, rank[own], side="right") - 1
            within = rank[own] - begin[run]
            sequence[own] = first[run] + within // copies[run]
            offset[own] = at[run] + within % copies[run] * x
        columns = [batch.column(c) for c in batch.schema.names if c != "rank"]
        names = [c for c in batch.schema.names if c != "rank"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False,
    remembered: int = REMEMBERED, slice_bytes: int = SLICE, forget: bool = True,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), with ``ids`` if asked for: one row per piece.

    A document is its text's ids and an end id 0.  Only documents of more than ``capacity`` ids are cut, into
    pieces of that many; the last may be shorter.  Each sequence is filled from 0 without gaps.  A null or empty
    text is the end id alone.  A repeated row is packed as often as it occurs, also under one doc_id or none.
    ``remembered`` words keep their ids, until a task ends if ``forget``, and ``slice_bytes`` of text are encoded at a time;
    more of each takes memory and spares time, and results are the same.

    No documents give no rows.  Other columns are not looked at.  Only the histogram of lengths, at most
    ``capacity`` rows, and the patterns made from it pass through the driver.
    """
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    memory = remembered, slice_bytes, forget
    pieces = docs.mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity, keep_ids=keep_ids, memory=memory), PIECES)
    pieces = stage(pieces if keep_ids else pieces.drop("ids"), "pieces")
    # one row for each task and length; the sums before a task run over blocks of tasks, then within one
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = stage(counts.withColumn("hundred", F.floor(F.col("task") / 1000)), "counts")
    before = Window.partitionBy("length").orderBy("hundred").rowsBetween(Window.unboundedPreceding, -1)
    hundreds = counts.groupBy("length", "hundred").agg(F.sum("n").alias("n"))
    hundreds = hundreds.select("length", "hundred", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "hundred").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.join(hundreds, ["length", "hundred"]).select(
        "task", "length", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("moved")
    )
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(histogram, capacity))
    ranked = pieces.join(moved, ["task", "length"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = ranked.select(*columns, (F.col("local") + F.col("moved")).alias("rank"))
    kinds = {"piece": "int", "ids": "binary"}
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in columns) + ", sequence_id long, offset long"
    return ranked.mapInArrow(partial(_placed, where=where), schema)
