"""Removal of repeated passages by suffix sorting with external induction.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.  The work follows induced
suffix sorting: sort a sample of suffixes, then derive the order of all others from it, right to left, with the
lengths of common prefixes carried along.

* The sample.  Of the k-grams in a window of ``length`` bytes the one with the least hash (the last of equals)
  is the window's anchor.  Equal windows have equal anchors, so a repeated window's anchor k-gram is repeated.
  Neighbouring windows with one anchor form a run; a run's bytes are its hull.
* Spark's external sort brings the runs together by k-gram and hull.  k-grams that occur once are done; so are
  runs whose whole hull occurs twice: all their windows are repeated.  What is left are runs at the ends of
  repeated passages, with one run of each other hull of the same k-gram.
* The induction.  In a shard of k-grams, the suffixes at the anchors are sorted, each with the length of the
  prefix it shares with the one before.  Then the queue of suffixes is emptied in order and refilled one byte to
  the left: ordered by (k-gram, byte, rank so far), and what two new neighbours share is one byte more than the
  least shared length between them.  A window is repeated if it shares ``length`` bytes with a neighbour.
  Suffixes that can't come to that any more leave the queue.

A shard is worked off in pieces of whole k-grams; the bytes of a piece beyond MEMORY go to a scratch file, and
only ranks and shared lengths stay in memory.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from stmtlog.llm import text as T
from stmtlog.plans.stage import stage

#: Suffixes whose bytes are copied or compared at a time.
ROWS = 5_000
#: Bytes of suffixes that a piece keeps in memory; positions told apart when anchors are chosen.
MEMORY, PLACES = 32 << 20, 24
_PLACE = np.uint64((1 << PLACES) - 1)


def _key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """The runs of all texts: text, first window, windows, anchor's distance, hashes of the k-gram and the hull."""
    sums = T.prefix_hashes(data)
    n = len(data) - gram + 1
    at = np.arange(n)
    hashed = T.span_hashes(sums, at, at + gram)
    least = (hashed & ~_PLACE) | (_PLACE - at.astype(np.uint64))
    span, done = length - gram + 1, 1
    while 2 * done <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < span:
        least = np.minimum(least[: len(least) - (span - done)], least[span - done :])
    doc = np.searchsorted(offsets, np.arange(len(least)), side="right") - 1
    valid = np.arange(len(least)) + length <= offsets[doc + 1]
    anchor = (_PLACE - (least & _PLACE)).astype(np.int64)
    begins = valid.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, len(valid)))
    total = np.append(0, np.cumsum(valid))
    count = total[first + count] - total[first]
    a = anchor[first]
    hull = T.span_hashes(sums, first, first + count - 1 + length)
    shape = (a - first).astype(np.uint64) * np.uint64(length) + count.astype(np.uint64)
    return doc[first], first, count, a - first, hashed[a], T.mix(hull + shape * np.uint64(0x9E3779B97F4A7C15))


RUNS = "gram long, hull long, key long, size long, first long, windows int, before int, copies int"


def _runs(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The runs of all texts.  Of runs with one hull in a slice the first stands for all (copies: 1, or 2 for more); the
    others, copies 0, are known to be repeated and need not meet the rest, however common their k-gram is."""
    names = [c.split()[0] for c in RUNS.split(", ")]
    most = 1 << (PLACES - 1)
    for part in T.slices(batches, "text"):
        data, offsets = T.utf8(part.column("text"))
        sizes = np.diff(offsets)
        some = np.flatnonzero(sizes >= length)
        if not len(some):
            continue
        key = np.zeros(len(sizes), np.int64)
        whole = data.tobytes()
        for d in some:
            key[d] = _key(whole[offsets[d] : offsets[d + 1]])
        for begin in range(0, max(1, len(data) - length + 1), most - length + 1):  # more than once for a long text only
            end = min(begin + most, len(data))
            cut = np.clip(offsets, begin, end) - begin
            if end - begin < length:
                continue
            doc, first, count, before, grams, hull = runs(data[begin:end], cut, length, gram)
            _, one, many = np.unique(hull, return_index=True, return_counts=True)
            copies = np.zeros(len(hull), np.int32)
            copies[one] = np.minimum(many, 2)
            columns = [
                grams.view(np.int64), hull.view(np.int64), key[doc], sizes[doc], first + begin - offsets[doc],
                count.astype(np.int32), before.astype(np.int32), copies,
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


FOUND = "met boolean, gram long, key long, size long, first long, windows int, before int, whole boolean"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by k-gram, hull, key and place: those whose hull is repeated (met), and one run of each hull
    of a k-gram with several hulls (not met; whole: its hull is repeated).  Keeps back one run."""
    names = ["gram", "hull", "key", "size", "first", "windows", "before"]
    fields = [c.split()[0] for c in FOUND.split(", ")]
    held, held_count, held_met, earlier = None, 0, False, False
    for batch in _with_end(batches):
        last = batch is None
        if last and held is None:
            return
        rows, copies = [], np.zeros(0, np.int64)
        if not last:
            copies = batch.column("copies").to_numpy().astype(np.int64)
            rows = [batch.column(c).to_numpy() for c in names]
            known = copies == 0
            if known.any():
                yes = pa.array(np.ones(int(known.sum()), bool))
                yield pa.RecordBatch.from_arrays([yes, *(pa.array(rows[i][known]) for i in (0, 2, 3, 4, 5, 6)), yes], fields)
                rows, copies = [r[~known] for r in rows], copies[~known]
            if not len(copies):
                continue
        if held is not None:
            rows = [np.array([h]) for h in held] if last else [np.append(h, r) for h, r in zip(held, rows, strict=True)]
        many = copies if held is None else np.append(held_count, copies)
        change = np.ones(len(many), bool)
        change[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        start = np.flatnonzero(change)
        count = np.add.reduceat(many, start)
        run = np.cumsum(change) - 1
        new_gram = np.ones(len(start), bool)
        new_gram[1:] = rows[0][start[1:]] != rows[0][start[:-1]]
        group = np.cumsum(new_gram) - 1
        hulls = np.bincount(group)
        hulls[0] += earlier
        again = np.zeros(len(many), bool)
        again[1:] = ~change[1:] & (rows[2][1:] == rows[2][:-1]) & (rows[4][1:] == rows[4][:-1]) & (rows[3][1:] == rows[3][:-1])
        met = (count[run] > 1) & ~again
        if held is not None and held_met:
            met[0] = False
        complete = np.ones(len(start), bool)
        complete[-1] = last
        told = start[complete & (hulls[group] > 1)]
        at = np.append(np.flatnonzero(met), told)
        columns = [pa.array(rows[i][at]) for i in (0, 2, 3, 4, 5, 6)]
        kind = pa.array(np.append(np.ones(int(met.sum()), bool), np.zeros(len(told), bool)))
        yield pa.RecordBatch.from_arrays([kind, *columns, pa.array(count[run[at]] > 1)], fields)
        held, held_count = [r[start[-1]] for r in rows], int(count[-1])
        held_met = held_count > 1
        earlier = bool(hulls[group[-1]] > 1)


def _with_end(batches):
    yield from batches
    yield None


CONTEXT = "gram long, key long, size long, first long, windows int, before int, whole boolean, hull binary"


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs listed with each text."""
    names = [c.split()[0] for c in CONTEXT.split(", ")]
    for part in T.slices(batches, "text"):
        listed = part.column("runs")
        flat, lists = listed.flatten(), np.asarray(listed.offsets)
        owner = np.repeat(np.arange(part.num_rows), np.diff(lists))
        data, offsets = T.utf8(part.column("text"))
        whole = data.tobytes()
        first, windows = flat.field("first").to_numpy(), flat.field("windows").to_numpy()
        begin = offsets[owner] + first
        end = begin + windows + length - 1
        for c in range(0, len(begin), 50_000):
            some = slice(c, c + 50_000)
            hulls = pa.array([whole[i:j] for i, j in zip(begin[some], end[some], strict=True)], pa.binary())
            own = pa.array(owner[some])
            columns = [
                flat.field("gram")[c : c + 50_000], part.column("key").take(own), part.column("size").take(own),
                *(flat.field(x)[c : c + 50_000] for x in ("first", "windows", "before", "whole")), hulls,
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


class Queue:
    """Suffixes at anchors, to be sorted and induced to the left."""

    def __init__(self, length: int, span: int):
        self.length, self.span = length, span
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.parts: list[np.ndarray] = []
        self.bytes, self.file = 0, None

    def __len__(self) -> int:
        return sum(len(c[0]) for c in self.columns)

    def push(self, batch: pa.RecordBatch) -> None:
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        self.columns.append(tuple(get(c) for c in ("gram", "key", "size", "first", "windows", "before", "whole")))
        before = self.columns[-1][5].astype(np.int64)
        hull = batch.column("hull")
        flat = np.frombuffer(hull.buffers()[2] or b"", np.uint8)
        offsets = np.frombuffer(hull.buffers()[1], np.int32)[hull.offset : hull.offset + len(hull) + 1].astype(np.int64)
        rows = np.zeros((len(hull), self.span + self.length), np.uint8)  # the anchor stands at column span
        sizes = np.diff(offsets)
        column = np.arange(sizes.sum()) - np.repeat(offsets[:-1] - offsets[0], sizes) + np.repeat(self.span - before, sizes)
        inside = column < rows.shape[1]
        rows[np.repeat(np.arange(len(hull)), sizes)[inside], column[inside]] = flat[offsets[0] : offsets[-1]][inside]
        self.bytes += rows.nbytes
        if self.file is not None:
            rows.tofile(self.file)
        else:
            self.parts.append(rows)
            if self.bytes > MEMORY:
                self.file = tempfile.TemporaryFile()
                for r in self.parts:
                    r.tofile(self.file)
                self.parts = []

    def matrix(self) -> np.ndarray:
        width = self.span + self.length
        if self.file is None:
            return np.concatenate(self.parts)
        self.file.flush()
        return np.memmap(self.file, np.uint8, "r").reshape(-1, width)

    def repeated(self) -> tuple[np.ndarray, ...]:
        """(key, size, first, windows) of the repeated windows of runs that weren't known to be repeated."""
        gram, key, size, first, windows, before, whole = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        windows, before, matrix = windows.astype(np.int64), before.astype(np.int64), self.matrix()
        same = np.zeros(len(gram), bool)  # a text read twice
        same[1:] = (gram[1:] == gram[:-1]) & (key[1:] == key[:-1]) & (size[1:] == size[:-1]) & (first[1:] == first[:-1])
        queue = np.flatnonzero(~same)
        order = np.arange(len(queue))
        for c in range(self.span + self.length - 8, self.span - 8, -8):
            low = max(c, self.span)
            word = np.zeros((len(queue), 8), np.uint8)
            word[:, low - c :] = matrix[queue, low : c + 8]
            word = word.view(">u8").ravel().astype(np.uint64)
            order = order[np.argsort(word[order], kind="stable")]
        queue = queue[order[np.argsort(gram[queue][order], kind="stable")]]
        reach = self.length + windows - 1 - before  # bytes from the anchor on
        shared = np.zeros(len(queue), np.int64)
        for c in range(1, len(queue), ROWS):
            one, other = queue[c - 1 : c - 1 + ROWS], queue[c : c + ROWS]
            one = one[: len(other)]
            differ = matrix[one, self.span :] != matrix[other, self.span :]
            equal = np.where(differ.any(1), differ.argmax(1), self.length)
            equal = np.minimum(equal, np.minimum(reach[one], reach[other]))
            shared[c : c + len(other)] = np.where(gram[one] == gram[other], equal, 0)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for left in range(int(before.max(initial=0)) + 1):
            if left:
                stay = np.flatnonzero(before[queue] >= left)
                byte = matrix[queue[stay], self.span - left]
                place = np.lexsort((byte, gram[queue[stay]]))
                stay, byte = stay[place], byte[place]
                joined = (byte[1:] == byte[:-1]) & (gram[queue[stay[1:]]] == gram[queue[stay[:-1]]])
                new = np.zeros(len(stay), np.int64)
                x, y = stay[:-1][joined], stay[1:][joined]
                if len(x):
                    cuts = np.stack([x + 1, y + 1], 1).ravel()
                    new[1:][joined] = np.minimum.reduceat(np.append(shared, 0), cuts)[::2] + 1
                queue, shared = queue[stay], new
            if not len(queue):
                break
            best = np.maximum(shared, np.append(shared[1:], 0))
            own = (before[queue] - windows[queue] < left) & ~whole[queue] & (best >= self.length)
            hits.append((queue[own], np.full(int(own.sum()), left)))
            alive = best + before[queue] - left >= self.length
            if not alive.all():  # what two that stay share is the least between them
                keep = np.flatnonzero(alive)
                if not len(keep):
                    break
                cuts = np.append(0, keep[:-1] + 1)
                queue, shared = queue[keep], np.minimum.reduceat(shared[: keep[-1] + 1], cuts)
        row, left = (np.concatenate([h[i] for h in hits] or [np.zeros(0, np.int64)]) for i in (0, 1))
        place = np.lexsort((-left, row))
        row, window = row[place], (first[row] + before[row] - left)[place]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
        start = np.flatnonzero(new)
        return key[row[start]], size[row[start]], window[start], np.diff(np.append(start, len(row)))


def _induce(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows from contexts sorted by k-gram, key and place."""
    queue = Queue(length, length - gram)

    def spans() -> pa.RecordBatch:
        key, size, first, windows = queue.repeated()
        columns = [pa.array(x) for x in (key, size, first, first + windows - 1 + length)]
        return pa.RecordBatch.from_arrays(columns, ["key", "size", "start", "stop"])

    last = None
    for whole in batches:
        for c in range(0, whole.num_rows, ROWS):
            batch = whole.slice(c, ROWS)
            grams = batch.column("gram").to_numpy()
            cut = 0
            if last is not None and queue.bytes > MEMORY // 2:  # at the end of a k-gram, once there is enough
                other = np.flatnonzero(grams != last)
                if len(other):
                    cut = int(other[0])
                    if cut:
                        queue.push(batch.slice(0, cut))
                    yield spans()
                    queue = Queue(length, length - gram)
            if cut < batch.num_rows:
                queue.push(batch.slice(cut))
            last = grams[-1]
    if len(queue):
        yield spans()


def _keyed(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for part in T.slices(batches, column):
        data, offsets = T.utf8(part.column(column))
        whole = data.tobytes()
        keys = [_key(whole[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
        new = [pa.array(keys, pa.int64()), pa.array(np.diff(offsets), pa.int64())]
        yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "__key", "__size"])


def _with_key(docs: DataFrame, text: str) -> DataFrame:
    schema = S.StructType([*docs.schema.fields, S.StructField("__key", S.LongType()), S.StructField("__size", S.LongType())])
    return docs.mapInArrow(partial(_keyed, column=text), schema)


def repeated_spans(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, spans): for each different text with repeated bytes, the spans [start, stop) to remove, in order.

    A text is named by a 64-bit hash and its number of bytes; see cut().  Spans do not touch each other.
    """
    gram = length // 2
    docs = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    met = docs.select("text").mapInArrow(partial(_runs, length=length, gram=gram), RUNS)
    deal = F.when(F.col("copies") > 0, F.col("gram")).otherwise(F.xxhash64("key", "first"))
    met = met.repartition(deal).sortWithinPartitions("gram", "hull", "key", "size", "first")
    met = stage(met.mapInArrow(_meet, FOUND), "runs")
    listed = met.filter("not met").select("key", "size", F.struct("gram", "first", "windows", "before", "whole").alias("run"))
    listed = listed.groupBy("key", "size").agg(F.collect_list("run").alias("runs"))
    # one document of each text
    keyed = _with_key(docs, "text").filter(F.col("__size") >= length)
    first = keyed.groupBy("__key", "__size").agg(F.min("doc_id").alias("id"))
    listed = listed.join(first, (F.col("key") == F.col("__key")) & (F.col("size") == F.col("__size"))).drop("__key", "__size")
    same = (keyed["__key"] == listed["key"]) & (keyed["__size"] == listed["size"]) & keyed["doc_id"].eqNullSafe(listed["id"])
    context = keyed.join(listed, same).select("key", "size", "runs", "text")
    context = context.mapInArrow(partial(_contexts, length=length), CONTEXT)
    context = context.repartition("gram").sortWithinPartitions("gram", "key", "size", "first")
    induced = context.mapInArrow(partial(_induce, length=length, gram=gram), "key long, size long, start long, stop long")
    stop = F.col("first") + F.col("windows") - 1 + length
    spans = met.filter("met").select("key", "size", F.col("first").alias("start"), stop.alias("stop")).union(induced)
    spans = stage(spans, "spans").groupBy("key", "size").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return spans.mapInArrow(_joined, "key long, size long, spans array<struct<start: long, stop: long>>")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that overlap or touch as one."""
    for batch in batches:
        listed = batch.column("spans")
        flat, lists = listed.flatten(), np.asarray(listed.offsets)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists))
        start, stop = flat.field("start").to_numpy(), flat.field("stop").to_numpy()
        order = np.lexsort((start, owner))
        owner, start, stop = owner[order], start[order], stop[order]
        if len(owner):
            step = int(stop.max()) + 1
            reach = np.maximum.accumulate(stop + owner * step)
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (start[1:] + owner[1:] * step > reach[:-1])
            first = np.flatnonzero(new)
            ends = np.append(first[1:], len(owner)) - 1
            owner, start, stop = owner[first], start[first], reach[ends] - owner[first] * step
        lists = np.append(0, np.cumsum(np.bincount(owner, minlength=batch.num_rows)))
        items = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["start", "stop"])
        spans = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), items)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("size"), spans], ["key", "size", "spans"])


def with_spans(
    docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", spans: str = "spans"
) -> DataFrame:
    """The rows of ``docs`` with the column ``spans``, whose name none of theirs may have: the bytes of the text to remove, in
    order, null if none.

    A byte is removed if a string of ``length`` bytes that covers it also starts at another place of any text,
    the same one included; matches do not cross texts, and are judged on the input.  A null or short text has
    no spans, a text that occurs twice is removed whole.  Ids may be null or repeated; other columns are kept
    and not looked at.  No rows give no rows.  Texts are told apart by 64-bit hashes and their sizes, k-grams
    and hulls by 64-bit hashes; windows are compared byte by byte.
    """
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}  # so that no name can clash
    safe = {c: n for n, c in names.items()}
    keyed = _with_key(docs.select(*(F.col(f"`{c}`").alias(n) for n, c in names.items())), safe[text])
    found = repeated_spans(docs, length, doc_id, text)
    same = (keyed["__key"] == found["key"]) & (keyed["__size"] == found["size"])
    joined = keyed.join(found, same, "left")
    return joined.select(*(keyed[n].alias(c) for n, c in names.items()), found["spans"].alias(spans))


def kept_parts(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    """What is left of a text's bytes."""
    edges = [0, *(x for s in spans for x in s), len(text)]
    return [text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)]


def _listed(column: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    for item in column:
        yield [(s["start"].as_py(), s["stop"].as_py()) for s in item] if item.is_valid else []


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in T.slices(batches, "text"):
        data, offsets = T.utf8(part.column("text"))
        whole, rows = data.tobytes(), []
        for d, spans in enumerate(_listed(part.column("spans"))):
            kept = kept_parts(whole[offsets[d] : offsets[d + 1]], spans)
            rows.append((sum(j - i for i, j in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()))
        removed, n, digest = zip(*rows, strict=True) if rows else ((), (), ())
        columns = [
            part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()),
            pa.array(n, pa.int64()), pa.array(digest, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(marked: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of rows with spans."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return marked.select("doc_id", "text", "spans").mapInArrow(_digests, schema)


def _cut(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for part in T.slices(batches, column):
        names = [c for c in part.schema.names if c != "spans"]
        at, texts = part.schema.get_field_index(column), part.column(column)
        cut = []
        for text, spans in zip(texts.to_pylist(), _listed(part.column("spans")), strict=True):
            if spans and text is not None:  # what is left of a character cut apart goes too
                text = "".join(p.decode(errors="ignore") for p in kept_parts(text.encode(), spans))
            cut.append(text)
        columns = [pa.array(cut, texts.type) if i == at else part.column(i) for i, c in enumerate(part.schema.names) if c in names]
        yield pa.RecordBatch.from_arrays(columns, names)


def cut(marked: DataFrame, text: str = "text") -> DataFrame:
    """Rows of with_spans() with their texts cut, without ``spans``."""
    fields = [f for f in marked.schema.fields if f.name != "spans"]
    return marked.mapInArrow(partial(_cut, column=text), S.StructType(fields))
