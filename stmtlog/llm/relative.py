r"""Removal of repeated passages of words by relative Lempel-Ziv parsing.

A word goes if a window of ``window`` consecutive words that covers it also starts anywhere else.  Words are runs
of bytes other than 0x20 and 0x09-0x0D.

* Blocks.  The texts are written once as reference blocks of about BLOCK bytes, numbered; all that is exchanged after
  that names a block, so what a block holds many times is asked for once.
* Runs.  Of the grams in a window the one with the least hash (the first of equals) is its anchor.  Equal windows have
  equal anchors.  Neighbouring windows with one anchor form a run; a run's words are its hull.
* The index of runs.  Spark's sort brings all runs of a gram together, by hull.  A hull that stands at two places is a
  reference for all its windows.  Only where a gram has several hulls, at the ends of repeated passages, can windows of
  one hull be repeated within others; one run of each of these hulls is open.
* The index of windows.  The windows of open runs are merged over all blocks by hash, with their first and last places
  (block and word), and each block is told what is found at another place too.
* Factors.  From left to right, a factor starts at the first window with a reference and follows that reference of its two
  that goes on longer, window by window in consecutive places.  Where it ends, the windows that cross the boundary are
  looked up for themselves, so the next factor may overlap with it.  Every factor has ``window`` words or more, and its
  words are the duplicate span.

A block, or a single longer text, is held in memory by one task, and of the rows of one hull or window a row for each
block.  Runs are told apart by 128 bits of hashes, windows by 96.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from stmtlog.llm import text as T
from stmtlog.plans.stage import stage

BLOCK = 1 << 20
#: Bits of a word's number in a block and of a block's number in its partition.
WORDS, SEQUENCE = 30, 16
_PLACE = (1 << WORDS) - 1

_BASES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_INVERSES = np.array([pow(int(b), -1, 2**64) for b in _BASES], np.uint64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Words:
    """The words of some texts in a row, with hashes of spans of words."""

    def __init__(self, texts: pa.Array):
        data, offsets = T.utf8(texts)
        starts, stops, self.first = T.words(data, offsets)
        self.hashed = T.span_hashes(T.prefix_hashes(data), starts, stops) if len(starts) else np.zeros(0, np.uint64)
        self.sizes = np.diff(self.first)
        self._sums: dict[int, np.ndarray] = {}

    def spans(self, starts: np.ndarray, stops: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of spans of words; ``which`` of two independent ones."""
        n = len(self.hashed)
        if which not in self._sums:
            values = T.mix(self.hashed + np.uint64(which)) * T.powers(_BASES[which], n)
            self._sums[which] = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
        sums = self._sums[which]
        raw = (sums[stops] - sums[starts]) * T.powers(_INVERSES[which], n + 1)[starts]
        return T.mix(raw + (stops - starts).astype(np.uint64))

    def windows(self, window: int) -> np.ndarray:
        """Where a window starts that lies in one text."""
        room = np.repeat(self.first[1:], self.sizes) - np.arange(len(self.hashed))
        return room[: max(0, len(room) - window + 1)] >= window

    def runs(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs of windows: first window, number, hashes of the anchor gram and of the hull."""
        some = self.windows(window)
        if not some.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at = np.arange(len(self.hashed) - gram + 1)
        grams, mask = self.spans(at, at + gram), np.uint64(_PLACE)
        least = _least(grams & ~mask | at.astype(np.uint64), window - gram + 1) & mask
        begins = some.copy()
        begins[1:] &= (least[1:] != least[:-1]) | ~some[:-1]  # an anchor lies in one text
        first = np.flatnonzero(begins)
        total = np.append(0, np.cumsum(some))
        count = total[np.append(first[1:], len(some))] - total[first]
        return first, count, grams[least[first].astype(np.int64)], self.spans(first, first + count - 1 + window)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def _check(values: np.ndarray) -> pa.Array:
    """32 bits of a second hash."""
    return pa.array((values >> np.uint64(32)).astype(np.uint32).view(np.int32))


def _numbered(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Rows with the block they are in and their number there."""
    partition = TaskContext.get().partitionId()
    for number, part in enumerate(T.slices(batches, column, size)):
        if number >> SEQUENCE or partition >> (63 - WORDS - SEQUENCE):
            raise ValueError("too many blocks in a partition, or partitions")
        block = pa.array(np.full(part.num_rows, partition << SEQUENCE | number, np.int64))
        place = pa.array(np.arange(part.num_rows, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*part.columns, block, place], [*part.schema.names, "block", "place"])


RUNS = "gram long, hull long, block long, places long"


def _first_and_last(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, the index of one of each, and the first and last place of each as one number.  ``at`` rises."""
    different, one = np.unique(keys, return_index=True)
    last = len(keys) - 1 - np.unique(keys[::-1], return_index=True)[1]
    return different, one, at[one].astype(np.int64) << WORDS | at[last]


def _runs(batches: Iterator[pa.RecordBatch], column: str, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Each block's different runs with their first and last word in the block."""
    block, texts = None, []

    def row() -> pa.RecordBatch:
        words = Words(pa.chunked_array(texts))
        first, _, grams, hulls = words.runs(window, gram)
        hull, one, places = _first_and_last(hulls, first)
        columns = [_signed(grams[one]), _signed(hull), pa.array(np.full(len(hull), block, np.int64)), pa.array(places)]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RUNS.split(", ")])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if i == j:
                continue
            if texts and block != blocks[i]:
                yield row()
                texts = []
            block = blocks[i]
            texts.append(batch.column(column).slice(i, j - i))
    if texts:
        yield row()


class _Groups:
    """Rows sorted by a key, in batches, as whole groups of equal keys."""

    def __init__(self, batches: Iterator[pa.RecordBatch], keys: list[str]):
        self.batches, self.keys = batches, keys

    def __iter__(self) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
        """Columns of some rows, and where each group starts; a group is never cut."""
        held: list[dict[str, np.ndarray]] = []
        for batch in self.batches:
            if not batch.num_rows:
                continue
            rows = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            new = np.zeros(batch.num_rows, bool)
            for k in self.keys:
                new[1:] |= rows[k][1:] != rows[k][:-1]
                new[0] |= bool(held) and rows[k][0] != held[-1][k][-1]
            if not new.any():
                held.append(rows)
                continue
            cut = int(np.flatnonzero(new)[-1])
            held.append({c: v[:cut] for c, v in rows.items()})
            yield self._joined(held)
            held = [{c: v[cut:] for c, v in rows.items()}]
        if held:
            yield self._joined(held)

    def _joined(self, held: list[dict[str, np.ndarray]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        rows = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        n = len(rows[self.keys[0]])
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in self.keys])
        return rows, np.flatnonzero(new)


def _places(rows: dict[str, np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and last place of each group over all its blocks, and the group of each row."""
    base = rows["block"] << WORDS
    first = np.minimum.reduceat(base | rows["places"] >> WORDS, starts)
    last = np.maximum.reduceat(base | rows["places"] & _PLACE, starts)
    return first, last, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(base))))


#: kind 0: a run found elsewhere; 1: an open run; 2: a window found elsewhere.
ANSWERS = "hash long, check int, block long, kind int, first long, last long"
_NAMES = [c.split()[0] for c in ANSWERS.split(", ")]


def _answers(hashes, check, block, kind, first, last) -> pa.RecordBatch:
    columns = [hashes, check.astype(np.int32), block, np.full(len(block), kind, np.int32), first, last]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _NAMES)


def _meet_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by gram and hull: hulls that stand at two places, for all their blocks, and open hulls, for one."""
    gram, pending = None, None  # the last gram, with its only hull so far

    def opened(block: np.ndarray, hull: np.ndarray) -> pa.RecordBatch:
        none = np.zeros(len(block), np.int64)
        return _answers(hull, none, block, 1, none, none)

    for rows, starts in _Groups(batches, ["gram", "hull"]):
        first, last, group = _places(rows, starts)
        met = (first != last)[group]
        if met.any():
            hull, block = rows["hull"][met], rows["block"][met]
            yield _answers(hull, np.zeros(len(hull)), block, 0, first[group][met], last[group][met])
        grams, blocks, hulls = (rows[c][starts] for c in ("gram", "block", "hull"))
        same = np.zeros(len(starts), bool)
        same[1:] = grams[1:] == grams[:-1]
        same[0] = gram is not None and grams[0] == gram
        several = same.copy()
        several[:-1] |= same[1:]
        if same[0] and pending is not None:
            yield opened(*(np.array([x]) for x in pending))
        if several.any():
            yield opened(blocks[several], hulls[several])
        gram = grams[-1]
        pending = None if several[-1] else (blocks[-1], hulls[-1])


class _Answers:
    """What a block was told, of one kind, by hash."""

    def __init__(self, table: pa.Table, kind: int):
        some = table["kind"].to_numpy() == kind
        self.hash = table["hash"].to_numpy()[some].view(np.uint64)
        order = np.argsort(self.hash, kind="stable")
        self.hash = self.hash[order]
        self.check, self.first, self.last = (table[c].to_numpy()[some][order] for c in ("check", "first", "last"))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and their rows."""
        if not len(self.hash):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return self.hash[at] == hashes, at


WINDOWS = "hash long, check int, block long, places long"


def _each(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of some runs, and their distance from the run's first."""
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + step, step


def _rows(table: pa.Table) -> pa.Table:
    return table.sort_by("place").combine_chunks()


def _windows(texts: pa.Table, answers: pa.Table, column: str, window: int, gram: int) -> pa.Table:
    """The windows of a block's open runs."""
    names = [c.split()[0] for c in WINDOWS.split(", ")]
    if not texts.num_rows or not answers.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())], names)
    words, block = Words(_rows(texts)[column]), texts["block"][0].as_py()
    first, count, _, hulls = words.runs(window, gram)
    _, one = np.unique(hulls, return_index=True)  # one run of each hull
    one = np.sort(one)
    one = one[_Answers(answers, 1).find(hulls[one])[0]]
    at, _ = _each(first[one], count[one])
    hashes, check = words.spans(at, at + window), words.spans(at, at + window, 1)
    hashed, one, places = _first_and_last(hashes, at)
    return pa.table([_signed(hashed), _check(check[one]), pa.array(np.full(len(one), block)), pa.array(places)], names)


def _meet_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows sorted by hash: those that stand at two places, for all their blocks."""
    for rows, starts in _Groups(batches, ["hash", "check"]):
        first, last, group = _places(rows, starts)
        met = (first != last)[group]
        if met.any():
            columns = (rows[c][met] for c in ("hash", "check", "block"))
            yield _answers(*columns, 2, first[group][met], last[group][met])


def _going_on(refs: np.ndarray, known: np.ndarray) -> np.ndarray:
    """From each window, how many windows in a row have consecutive references; 0 for none."""
    if not len(refs):
        return np.zeros(0, np.int64)
    joined = known[:-1] & known[1:] & (refs[1:] == refs[:-1] + 1)
    ends = np.append(np.flatnonzero(~joined), len(refs) - 1)
    return np.where(known, ends[np.searchsorted(ends, np.arange(len(refs)))] - np.arange(len(refs)) + 1, 0)


def parse(hits: np.ndarray, first: np.ndarray, last: np.ndarray, own: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy factors (window, windows, reference) from the windows in ``hits``, their first and last places and their own.

    A window refers to its first place or its last, whichever is not its own and goes on longer.
    """
    place = [first, last]
    runs = np.zeros((2, len(hits)), np.int64)
    for side in (0, 1):  # the neighbours in hits may not be neighbours in the text
        step = np.append(0, np.cumsum(np.diff(hits) != 1)) * (1 << 40)
        runs[side] = _going_on(place[side] + step, place[side] != own)
    out, i = [], 0
    while i < len(hits):
        side = int(runs[1, i] > runs[0, i])
        n = max(1, int(runs[side, i]))
        out.append((int(hits[i]), n, int(place[side][i])))
        i += n
    return out


FACTOR = S.ArrayType(
    S.StructType([
        S.StructField("start", S.LongType()), S.StructField("stop", S.LongType()), S.StructField("block", S.LongType()),
        S.StructField("at", S.LongType()),
    ])
)
_FACTOR = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "stop", "block", "at")]))


def _factors(texts: pa.Table, answers: pa.Table, column: str, window: int, gram: int) -> pa.Table:
    """The rows of a block with their factors."""
    if not texts.num_rows:
        return texts.append_column("factors", pa.array([], _FACTOR)).drop_columns(["block", "place"])
    texts, block = _rows(texts), texts["block"][0].as_py()
    found: list[list[dict]] = [[] for _ in range(texts.num_rows)]
    if answers.num_rows:
        words, met, windows = Words(texts[column]), _Answers(answers, 0), _Answers(answers, 2)
        first, count, _, hulls = words.runs(window, gram)
        known, row = met.find(hulls)
        at, step = _each(first[known], count[known])
        ahead = np.repeat(row[known], count[known])
        alone, _ = _each(first[~known], count[~known])
        hit, row = windows.find(words.spans(alone, alone + window))
        hit &= windows.check[row] == _check(words.spans(alone, alone + window, 1)).to_numpy() if len(windows.hash) else False
        at = np.append(at, alone[hit])
        order = np.argsort(at)
        at = at[order]
        refs = [
            np.append(getattr(met, side)[ahead] + step, getattr(windows, side)[row[hit]])[order] for side in ("first", "last")
        ]
        own = at.astype(np.int64) | block << WORDS
        doc = np.searchsorted(words.first, at, side="right") - 1
        for d in np.unique(doc):
            some = slice(*np.searchsorted(doc, [d, d + 1]))
            begin = int(words.first[d])
            found[d] = [
                {"start": i - begin, "stop": i - begin + n - 1 + window, "block": ref >> WORDS, "at": ref & _PLACE}
                for i, n, ref in parse(at[some], refs[0][some], refs[1][some], own[some])
            ]
    return texts.append_column("factors", pa.array(found, _FACTOR)).drop_columns(["block", "place"])


def with_factors(
    docs: DataFrame, window: int = 35, text: str = "text", factors: str = "factors", gram: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs`` with the column ``factors``, whose name none of theirs may have.

    factors: array of (start, stop, block, at), in order: words start to stop - 1 are those from word ``at`` of reference
    block ``block`` on.  They may overlap.

    A null or short text has none.  Repeated rows are repeated texts; other columns are kept and not looked at.  No rows
    give no rows.  Blocks are numbered anew by each call.
    """
    gram = gram or max(1, window // 3)
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}  # so that no name can clash
    safe = {c: n for n, c in names.items()}[text]
    docs = docs.select(*(F.col(f"`{c}`").alias(n) for n, c in names.items()))
    numbers = [S.StructField("block", S.LongType()), S.StructField("place", S.IntegerType())]
    schema = S.StructType([*docs.schema.fields, *numbers])
    blocks = stage(docs.mapInArrow(partial(_numbered, column=safe, size=block), schema), "blocks")
    runs = blocks.select(safe, "block").mapInArrow(partial(_runs, column=safe, window=window, gram=gram), RUNS)
    runs = runs.repartition("gram").sortWithinPartitions("gram", "hull")
    told = stage(runs.mapInArrow(_meet_runs, ANSWERS), "run-answers")
    texts = blocks.select(safe, "block", "place").groupBy("block")
    found = texts.cogroup(told.filter("kind = 1").groupBy("block")).applyInArrow(
        lambda t, a: _windows(t, a, safe, window, gram), WINDOWS
    )
    found = found.repartition("hash").sortWithinPartitions("hash", "check")
    found = stage(found.mapInArrow(_meet_windows, ANSWERS), "window-answers")
    schema = S.StructType([*docs.schema.fields, S.StructField("factors", FACTOR)])
    found = blocks.groupBy("block").cogroup(told.filter("kind = 0").unionByName(found).groupBy("block")).applyInArrow(
        lambda t, a: _factors(t, a, safe, window, gram), schema
    )
    return found.select(*(F.col(n).alias(c) for n, c in names.items()), F.col("factors").alias(factors))


def removed(factors: list[dict] | None) -> list[tuple[int, int]]:
    """The spans of words that factors cover, without overlaps."""
    spans: list[tuple[int, int]] = []
    for factor in factors or []:
        if spans and factor["start"] <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], factor["stop"])
        else:
            spans.append((factor["start"], factor["stop"]))
    return spans


def kept_words(text: str | None, factors: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = (text or "").encode().split()
    edges = [0, *(x for span in removed(factors) for x in span), len(words)]
    return [w for i, j in zip(edges[::2], edges[1::2], strict=True) for w in words[i:j]], len(words)


def _digests(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, factors in zip(batch.column(column), batch.column("factors"), strict=True):
            kept, n = kept_words(text.as_py(), factors.as_py())
            out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, gone, digest = zip(*out, strict=True) if out else ((), (), ())
        columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])


def digests(docs: DataFrame, window: int = 35, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): what is left of each text's words, joined by one space."""
    found = with_factors(docs.select("doc_id", "text"), window, block=block)
    return found.mapInArrow(partial(_digests, column="text"), "doc_id long, n_words long, n_removed long, kept_sha256 string")
