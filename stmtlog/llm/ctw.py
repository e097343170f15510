"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, so each context of bytes has 255 decision nodes.  At every node and every depth of
context, from none to DEPTH bytes, a Krichevsky-Trofimov estimate is kept; context-tree weighting mixes them
over all depths: with P the block probability of a node's own estimate and Q the product of its children's,

    W = (P + Q) / 2,

and w = P / 2 / W is the weight with which the node's own estimate is used instead of the longer contexts'.
Contexts that were never seen in training use the longest seen part.  A text is its bytes and an end symbol, so the
probabilities of all texts add up to one.

The counts of all contexts follow from those of the strings of DEPTH + 1 bytes, which are counted over the whole
corpus.  Each input partition asks for the strings and words it has, a packed row for each bucket of them; answers come
back to it, packed alike, and its texts are scored by lookups.  What is passed around are different strings and words of
partitions, not texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlog.llm import text as T
from stmtlog.plans.stage import stage

DEPTH, END = 5, 0xFF
#: Bytes of text worked on at a time; strings and words added before they are summed, and kept before they are handed on.
SLICE, ADDED, KEPT = 1 << 18, 500_000, 4_000_000
_LN2 = np.log(2.0)
_HALVES = np.append(0.0, np.cumsum(np.log(np.arange(1, 4097) - 0.5)))  # ln gamma(n + 1/2) - ln gamma(1/2)
_WHOLES = np.append(0.0, np.cumsum(np.log(np.arange(1, 8193))))  # ln n!


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov block probability."""

    def half(n):
        small = np.minimum(n, 4096).astype(np.int64)
        return np.where(n <= 4096, _HALVES[small], _stirling(np.maximum(n, 1) + 0.5) - 0.5 * np.log(np.pi))

    n = zeros + ones
    small = np.minimum(n, 8192).astype(np.int64)
    whole = np.where(n <= 8192, _WHOLES[small], _stirling(np.maximum(n, 1) + 1.0))
    return half(zeros) + half(ones) - whole


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 decision nodes, in columns 1 to 255, for rows of 256 byte counts."""
    zeros, ones = np.zeros(counts.shape), np.zeros(counts.shape)
    sums = counts.astype(float)
    for level in range(7, -1, -1):
        zeros[:, 1 << level : 2 << level], ones[:, 1 << level : 2 << level] = sums[:, ::2], sums[:, 1::2]
        sums = sums[:, ::2] + sums[:, 1::2]
    return zeros, ones


def weigh(zeros, ones, children) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A node's estimate for one, its weight, and the logarithm of its weighted probability."""
    own = log_kt(zeros, ones)
    both = np.logaddexp(own, children) - _LN2
    return (ones + 0.5) / (zeros + ones + 1), np.exp(own - _LN2 - both), both


def _codes(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end of all texts: the string of the bytes before and itself, as a number; where texts begin."""
    n = len(offsets) - 1
    step = depth + 1
    padded = np.zeros(len(data) + n * step + depth, np.uint8)
    begin = offsets + np.arange(n + 1) * step
    padded[np.arange(len(data)) + np.repeat(np.arange(n) * step + depth, np.diff(offsets))] = data
    padded[begin[1:] - 1] = END
    codes = np.zeros(len(padded) - depth, np.int64)
    for i in range(step):
        codes = (codes << 8) | padded[i : i + len(codes)]
    own = np.ones(begin[-1], bool)
    for i in range(depth):
        own[begin[:-1] + i] = False
    places = np.flatnonzero(own)
    return codes[places - depth], offsets + np.arange(n + 1)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in lower case, as negative numbers; each text's first."""
    lower = T.LOWER[data]
    starts, stops, first = T.words(lower, offsets)
    return (T.span_hashes(T.prefix_hashes(lower), starts, stops) | np.uint64(1 << 63)).view(np.int64), first


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, with the sums of their counts.  Both lists are emptied: their arrays go as they are joined."""
    key = np.concatenate(keys)
    keys.clear()
    order = np.argsort(key, kind="stable")
    key = key[order]
    n = np.concatenate(counts)
    counts.clear()
    n = n[order]
    del order
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers of 8 bytes, compressed, after their number; their first bytes together, then their second ones and so on."""
    data = numbers.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes | pa.Buffer, kind: type = np.int64) -> np.ndarray:
    data = pa.py_buffer(data)
    size = 8 * int.from_bytes(data[:8].to_pybytes(), "little")
    data = pa.decompress(data[8:], decompressed_size=size, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, packed by their distances."""
    return _packed(np.diff(keys, prepend=np.int64(0)))


def _unpacked_keys(data: bytes | pa.Buffer) -> np.ndarray:
    return np.cumsum(_unpacked(data))


def _buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each string and word.  Strings that differ in their last two bytes only share one: they are close."""
    return (T.mix(np.where(keys < 0, keys, keys >> 16).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


ASKED = "bundle long, bucket int, keys binary, counts binary, words long"


def _asked(batches: Iterator[pa.RecordBatch], depth: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The different strings and words of a partition, with their numbers in training texts: a row for each bucket of them.

    ``words`` is the sum of the words' numbers.
    """
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    bundle = None

    def out() -> pa.RecordBatch:
        key, n = _summed(keys, counts)
        bucket = _buckets(key, buckets)
        order = np.argsort(bucket, kind="stable")
        key, n, bucket = key[order], n[order], bucket[order]
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.zeros(0, np.int64)
        spans = list(zip(edges, np.append(edges[1:], len(key)), strict=True))
        columns = [
            pa.array(np.full(len(spans), bundle, np.int64)),
            pa.array(bucket[edges]),
            pa.array([_packed_keys(key[i:j]) for i, j in spans], pa.binary()),
            pa.array([_packed(n[i:j]) for i, j in spans], pa.binary()),
            pa.array([int(n[i:j][key[i:j] < 0].sum()) for i, j in spans], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ASKED.split(", ")])

    fresh = 0
    for part in T.slices(batches, "text", SLICE):
        data, offsets = T.utf8(part.column("text"))
        bundle = int(part.column("bundle")[0].as_py())
        train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
        for found, begin in (_codes(data, offsets, depth), _words(data, offsets)):
            trained = np.repeat(train, np.diff(begin))
            for own, weight in ((trained, 1), (~trained, 0)):
                key, n = np.unique(found[own], return_counts=True)
                keys.append(key)
                counts.append(n * weight)
                fresh += len(key)
        if fresh > ADDED:
            key, n = _summed(keys, counts)
            keys[:], counts[:], fresh, kept = [key], [n], 0, len(key)
            del key, n
            if kept > KEPT:
                yield out()
    if keys:
        yield out()


def _totals(requests: pa.Table, words_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The different strings and words of a bucket, sorted, and their numbers in training texts."""
    keys: list[np.ndarray] = [np.zeros(0, np.int64)]
    counts: list[np.ndarray] = [np.zeros(0, np.int64)]
    fresh = 0
    for packed, n in zip(requests.column("keys"), requests.column("counts"), strict=True):
        key, n = _unpacked_keys(packed.as_buffer()), _unpacked(n.as_buffer())
        upto = np.searchsorted(key, 0) if words_only else len(key)
        keys.append(key[:upto])
        counts.append(n[:upto])
        fresh += upto
        if fresh > ADDED:
            key, n = _summed(keys, counts)
            keys[:], counts[:], fresh = [key], [n], 0
    return _summed(keys, counts)


def _counted(requests: pa.Table) -> pa.Table:
    """A bucket's different strings with their numbers; at key -1 how many words were seen in training."""
    key, n = _totals(requests)
    first = int(np.searchsorted(key, 0))
    kinds = np.count_nonzero(n[:first])
    return pa.table({"key": pa.array(np.append(-1, key[first:])), "n": pa.array(np.append(kinds, n[first:]))})


ANSWERS = "bundle long, keys binary, vals binary"


def _answered(table: pa.Table) -> pa.Table:
    """From a bucket's requests and its strings' values: each request with its values, a word's being its number."""
    requests, model = table.filter(table.column("keys").is_valid()), table.filter(table.column("keys").is_null())
    key, value = model.column("key").to_numpy(), model.column("value").to_numpy()
    order = np.argsort(key)
    word, n = _totals(requests, words_only=True)
    key, value = np.append(word, key[order]), np.append(n.astype(np.float64), value[order])
    values = [_packed(value[np.searchsorted(key, _unpacked_keys(k.as_buffer()))]) for k in requests.column("keys")]
    return pa.table({"bundle": requests.column("bundle"), "keys": requests.column("keys"), "vals": pa.array(values, pa.binary())})


#: Bytes of context above which contexts are few enough to be tables; strings of a shared context worked off at a time.
TOP, PIECE = 2, 200_000


class Weighting:
    """Context trees of strings that share their last TOP bytes of context, from ``depth`` up to TOP.

    A decision node is a context and a place in the byte's binary tree, (context << 8) | node; only nodes that
    occur are held.  ``counts`` and ``children`` are the byte counts and the children's logarithms of the shared context.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int):
        symbol, context = codes & 0xFF, codes >> 8
        self.bits = [(symbol >> (7 - i)) & 1 for i in range(8)]
        nodes = np.concatenate([(context << 8) | ((1 << i) + (symbol >> (8 - i))) for i in range(8)])
        ones = np.concatenate([counts * b for b in self.bits])
        key, self.place = np.unique(nodes, return_inverse=True)
        zeros = np.bincount(self.place, weights=np.tile(counts, 8) - ones, minlength=len(key))
        ones = np.bincount(self.place, weights=ones, minlength=len(key))
        self.levels = [(zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1), np.zeros(len(key)))]  # a leaf's rest has weight 0
        log, self.parents = log_kt(zeros, ones), []
        for d in range(depth - 1, TOP - 1, -1):
            up, parent = np.unique(key & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
            zeros, ones, log = (np.bincount(parent, weights=x, minlength=len(up)) for x in (zeros, ones, log))
            self.parents.append(parent)
            key = up
            if d > TOP:
                estimate, weight, log = weigh(zeros, ones, log)
                self.levels.append((zeros + ones > 0, estimate, weight))
        self.nodes = key & 0xFF
        self.counts = np.bincount(symbol, weights=counts, minlength=256)
        self.children = np.bincount(self.nodes, weights=log, minlength=256)

    def scores(self, a: np.ndarray, b: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """log10 probabilities of the strings' last bytes, from what holds at the shared context's nodes:
        a + b * the longer contexts' estimate, or ``stop`` where they have none."""
        a, b, stop = a[self.nodes], b[self.nodes], stop[self.nodes]
        for level in range(len(self.levels) - 1, -1, -1):
            parent, (seen, estimate, weight) = self.parents[level], self.levels[level]
            a, b, stop = a[parent], b[parent], stop[parent]
            stop = np.where(seen, a + b * estimate, stop)
            a, b = np.where(seen, a + b * weight * estimate, a), np.where(seen, b * (1 - weight), b)
        one = stop[self.place].reshape(8, -1)
        return sum(np.log10(np.where(bit, p, 1 - p)) for bit, p in zip(self.bits, one, strict=True))


def _pieces(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The strings of a shared context and their counts, in pieces that don't cut the next longer contexts."""
    codes, counts = table.column("key").to_numpy(), table.column("n").to_numpy()
    longer = (codes >> 8 * (TOP + 1)) & 0xFF
    order = np.argsort(longer, kind="stable")
    ends = np.searchsorted(longer[order], np.arange(256), side="right")
    start = 0
    for end in ends:
        if end - start >= PIECE or (end == len(codes) and end > start):
            yield codes[order[start:end]], counts[order[start:end]]
            start = end


def _summary(key: tuple[pa.Scalar, ...], table: pa.Table, depth: int) -> pa.Table:
    counts, children = np.zeros(256), np.zeros(256)
    for codes, n in _pieces(table):
        trees = Weighting(codes, n, depth)
        counts, children = counts + trees.counts, children + trees.children
    return pa.table(
        {"suffix": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([counts.tolist()]), "children": pa.array([children.tolist()])}
    )


def _upper_rows(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The contexts of one byte: sums over the contexts of TOP bytes that end in it."""
    n = np.array(table.column("counts").to_pylist())
    children = np.array(table.column("children").to_pylist())
    logs = np.array([weigh(*(x[0] for x in decisions(r[None])), c)[2] for r, c in zip(n, children, strict=True)])
    return pa.table({"last": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([n.sum(0).tolist()]), "children": pa.array([logs.sum(0).tolist()])})


def _scored(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table, depth: int, short: dict) -> pa.Table:
    own = np.array(right.column("counts")[0].as_py())
    children = np.array(right.column("children")[0].as_py())
    a, b, stop = short[key[0].as_py() & 0xFF]
    zeros, ones = (x[0] for x in decisions(own[None]))
    estimate, weight, _ = weigh(zeros, ones, children)
    has = zeros + ones > 0
    stop = np.where(has, a + b * estimate, stop)
    a, b = np.where(has, a + b * weight * estimate, a), np.where(has, b * (1 - weight), b)
    found = [(codes, Weighting(codes, n, depth).scores(a, b, stop)) for codes, n in _pieces(left)]
    codes, value = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    return pa.table({"key": pa.array(codes), "value": pa.array(value)})


class Lookup:
    """Values by key: one slot by hash, and binary search for keys whose slot holds another."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.values = values[order]
        del order
        if (self.keys[1:] == self.keys[:-1]).any():
            first = np.append(True, self.keys[1:] != self.keys[:-1])
            self.keys, self.values = self.keys[first], self.values[first]
        bits = max(10, int(len(self.keys)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        for at in range(0, len(self.keys), SLICE):
            some = self.keys[at : at + SLICE]
            self.slots[self._slot(some)] = np.arange(at, at + len(some))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0)
        at = self.slots[self._slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.keys, keys[other]), len(self.keys) - 1)
            if (self.keys[at[other]] != keys[other]).any():
                raise RuntimeError("a partition's texts aren't those it asked for: the input's partitions changed between two reads")
        return self.values[at]


SCORES = "doc_id long, held_out boolean, n_words long, n_known long, log_counts double, score double, n_bytes long"


def _scores(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Scores of the texts of bundles; a bundle's answers come before its texts."""
    current, keys, values, lookup = None, [], [], None
    for whole in batches:
        bundles, text = whole.column("bundle").to_numpy(), whole.column("keys").is_null().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.append(True, (bundles[1:] != bundles[:-1]) | (text[1:] != text[:-1]))) if len(bundles) else np.zeros(0, np.int64)
        for start, stop in zip(edges, np.append(edges[1:], len(bundles)), strict=True):
            if bundles[start] != current:
                current, keys, values, lookup = bundles[start], [], [], None
            rows = whole.slice(start, stop - start)
            if not text[start]:
                keys += [_unpacked_keys(k.as_buffer()) for k in rows.column("keys")]
                values += [_unpacked(v.as_buffer(), np.float64) for v in rows.column("vals")]
                continue
            if lookup is None:
                key, value = np.concatenate(keys), np.concatenate(values)
                keys, values = [], []
                lookup = Lookup(key, value)
                del key, value
            for part in T.slices(iter([rows]), "text", SLICE):
                data, offsets = T.utf8(part.column("text"))
                codes, begin = _codes(data, offsets, depth)
                owner = np.repeat(np.arange(part.num_rows), np.diff(begin))
                score = np.bincount(owner, weights=lookup.get(codes), minlength=part.num_rows)
                found, first = _words(data, offsets)
                n = np.diff(first)
                owner, count = np.repeat(np.arange(part.num_rows), n), lookup.get(found)
                known = np.bincount(owner, weights=count > 0, minlength=part.num_rows).astype(np.int64)
                logs = np.bincount(owner, weights=np.log10(count + 0.1), minlength=part.num_rows)
                columns = [part.column("doc_id"), part.column("held_out"), *map(pa.array, (n, known, logs, score, np.diff(offsets)))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORES.split(", ")])
        whole = rows = part = None  # before the next batch is read


def score(docs: DataFrame, train: Column, held_out: Column, depth: int = DEPTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of ``docs``.

    The model learns from the rows where ``train`` is true.  score is the log10 probability of the text, its end
    included; bits_per_byte the code length by it over bytes and end.  base_score is a unigram model's: words in
    lower case (A-Z) and one end, c of N training tokens of V kinds having (c + 0.1) / (N + 0.1 (V + 1)); n_known
    counts the text's tokens with c > 0.

    A null text is empty: an end only.  A null ``train`` is false.  Repeated rows count as often as they occur,
    ids may be null or repeated.  Without training texts all decisions are even.  No rows give no rows; other
    columns are not looked at.  ``docs`` is read twice and must come in the same partitions, as tables read
    from files do; if it doesn't, the scoring fails.  Words are told apart by 63-bit hashes.
    """
    if not 3 <= depth <= 6:
        raise ValueError("depth is 3 to 6")
    docs = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"), F.spark_partition_id().cast("bigint").alias("bundle"),
    )
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = docs.select("text", "train", "bundle").mapInArrow(partial(_asked, depth=depth, buckets=buckets), ASKED)
    asked = stage(asked, "asked")
    totals = asked.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    trained = docs.filter("train").count()

    suffix = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * TOP) - 1)).cast("int")
    counted = asked.select("bucket", "keys", "counts").groupBy("bucket").applyInArrow(_counted, "key long, n long")
    counted = stage(counted.withColumn("suffix", suffix), "strings")
    kinds = counted.filter("key < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] + (trained > 0)
    strings = counted.filter("key >= 0")
    rows = "counts array<double>, children array<double>"

    def summary(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _summary(key, table, depth)

    of = strings.groupBy("suffix").applyInArrow(summary, f"suffix int, {rows}")
    of = stage(of, "contexts")
    last = of.groupBy(F.col("suffix").bitwiseAND(F.lit(0xFF)).alias("last")).applyInArrow(_upper_rows, f"last int, {rows}")
    short = _short({r["last"]: (np.array(r["counts"]), np.array(r["children"])) for r in last.collect()})
    model = strings.groupBy("suffix").cogroup(of.groupBy("suffix"))

    def scored_strings(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        found = _scored(key, left, right, depth, short)
        return found.append_column("bucket", pa.array(_buckets(found.column("key").to_numpy(), buckets)))

    model = model.applyInArrow(scored_strings, "key long, value double, bucket int")

    null = lambda kind: F.lit(None).cast(kind)
    both = asked.drop("words").unionByName(model, allowMissingColumns=True)
    answers = both.groupBy("bucket").applyInArrow(_answered, ANSWERS)
    train_tokens = totals["words"] + trained

    answers = answers.select(
        "bundle", "keys", "vals", null("long").alias("doc_id"), null("string").alias("text"), null("boolean").alias("held_out")
    )
    texts = docs.select("bundle", null("binary").alias("keys"), null("binary").alias("vals"), "doc_id", "text", "held_out")
    both = answers.unionByName(texts).withColumn("tag", F.col("keys").isNull())
    both = both.repartition("bundle").sortWithinPartitions("bundle", "tag").drop("tag")
    scored = both.mapInArrow(partial(_scores, depth=depth), SCORES)
    level = float(np.log10(train_tokens + 0.1 * (kinds + 1)))
    n_tokens = F.col("n_words") + 1
    base = F.col("log_counts") + F.lit(float(np.log10(trained + 0.1))) - n_tokens * F.lit(level)
    return scored.select(
        "doc_id", "held_out", n_tokens.alias("n_tokens"), (F.col("n_known") + F.lit(int(trained > 0))).alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") / F.lit(float(np.log10(2.0))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def _short(rows: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[np.ndarray, ...]]:
    """a, b and stop below each context of one byte, from the byte counts and children's logarithms of all."""
    nodes = {s: (n, *weigh(*(x[0] for x in decisions(n[None])), children)) for s, (n, children) in rows.items()}
    every = sum((n for n, *_ in nodes.values()), np.zeros(256))
    root = (every, *weigh(*(x[0] for x in decisions(every[None])), sum((x[3] for x in nodes.values()), np.zeros(256))))
    out = {}
    for s, node in nodes.items():
        a, b, stop = np.zeros(256), np.ones(256), np.full(256, 0.5)
        for n, estimate, weight, _ in (root, node):
            zeros, ones = (x[0] for x in decisions(n[None]))
            has = zeros + ones > 0
            stop = np.where(has, a + b * estimate, stop)
            a, b = np.where(has, a + b * weight * estimate, a), np.where(has, b * (1 - weight), b)
        out[s] = (a, b, stop)
    return out
