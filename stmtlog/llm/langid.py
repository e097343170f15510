"""Language identification by language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: a slot holds a bit for each language, an n-gram sets its
languages' bits in a few slots, and the AND of an n-gram's slots gives all languages that contain it at once.
For a text, the bits of its n-grams are counted per language and corrected for false positives: with a share f
of wrong answers, c of n n-grams stand for (c / n - f) / (1 - f).  The language with the largest share is it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stmtlog.llm import text as T

#: Slots are 2**SLOT_BITS; hash functions; bytes of an n-gram.
SLOT_BITS, HASHES, GRAM = 20, 2, 4
#: Bytes of text worked on at a time.
SLICE = 1 << 20
#: Documents per language to learn from, about; an n-gram's least documents, and least share against its best language.
SAMPLE, LEAST, SHARE = 4_000, 2, 0.2

_TIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The byte n-grams of lower-cased texts and the text each belongs to.

    What is no letter counts as a space; n-grams with two spaces in a row are left out.
    """
    data, offsets = T.utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    lengths = np.diff(offsets)
    padded = np.full(len(data) + 2 * len(lengths) + 2, 0x20, np.uint8)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    padded[np.arange(len(data)) + 2 * owner + 2] = _LETTERS[data]
    codes = np.zeros(len(padded) - GRAM + 1, np.uint64)
    blank = padded == 0x20
    twice = blank[1:] & blank[:-1]
    keep = np.ones(len(codes), bool)
    for i in range(GRAM):
        codes = (codes << np.uint64(8)) | padded[i : i + len(codes)]
        if i + 1 < GRAM:
            keep &= ~twice[i : i + len(codes)]
    starts = offsets[:-1] + 2 * np.arange(len(lengths))
    keep = np.flatnonzero(keep)
    return codes[keep], np.searchsorted(starts, keep, side="right") - 1


def slots(codes: np.ndarray) -> np.ndarray:
    return np.stack([((codes + np.uint64(1)) * _TIMES[h]) >> np.uint64(64 - SLOT_BITS) for h in range(HASHES)]).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by language and n-gram."""
    for part in T.slices(batches, "text", SLICE):
        codes, owner = ngrams(part.column("text"))
        pairs = np.unique(owner.astype(np.uint64) << np.uint64(32) | codes)
        lang = part.column("lang").to_numpy().astype(np.uint64)[(pairs >> np.uint64(32)).astype(np.int64)]
        pairs, n = np.unique(lang << np.uint64(32) | (pairs & np.uint64(0xFFFFFFFF)), return_counts=True)
        gram = (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lang = (pairs >> np.uint64(32)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])


def _slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram, lang = batch.column("gram").to_numpy().astype(np.uint64), batch.column("lang").to_numpy()
        at = slots(gram).ravel()
        lang = np.tile(lang, HASHES)
        bits = np.left_shift(np.int64(1), (lang % 62).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang // 62, pa.int32()), pa.array(bits)], ["slot", "word", "bits"])


class Filters:
    """The filled slots of all languages."""

    def __init__(self, languages: list[str], usual: str | None, filled: list[tuple[int, int, int]]):
        self.languages, self.usual, self.filled = languages, usual, np.array(filled, np.int64).reshape(-1, 3)
        self.table = None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.languages)
        if self.table is None:
            self.table = np.zeros((-(-k // 62), 2**SLOT_BITS), np.int64)
            self.table[self.filled[:, 1], self.filled[:, 0]] = self.filled[:, 2]
            bits = [(self.table[i // 62] >> (i % 62)) & 1 for i in range(k)]
            self.wrong = np.array([b.mean() ** HASHES for b in bits])
        lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        codes, owner = ngrams(texts)
        at = slots(codes)
        masks = np.bitwise_and.reduce(self.table[:, at], axis=1)
        contained = np.array([(masks[i // 62] >> (i % 62)) & 1 for i in range(k)]).reshape(k, len(owner))
        total = np.maximum(np.bincount(owner, minlength=n), 1)
        count = np.array([np.bincount(owner, weights=c, minlength=n) for c in contained]).reshape(k, n)
        right = np.maximum(1 - self.wrong, 0.05)  # a filter that is all but full says little
        share = np.clip((count / total - self.wrong[:, None]) / right[:, None], 0, 1)
        best = share.argmax(0) if k else np.zeros(n, int)
        every = np.sort(share, 0)[-2:].sum(0) if k else np.zeros(n)
        score = np.where(every > 0, share.max(0, initial=0) / np.maximum(every if k > 1 else 1.0, 1e-12), 0.0)
        names = [
            "und" if not lettered[d] or not k else self.languages[best[d]] if every[d] > 0 else self.usual for d in range(n)
        ]
        return names, np.where([x == "und" for x in names], 0.0, score)


def fit(labelled: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Filters:
    """Filters from rows with a language; null languages and texts are left out.

    About ``sample`` rows per language are used, drawn by a hash of the id, so the driver gets the filled slots,
    at most 2**SLOT_BITS for each 62 languages.  An n-gram counts for a language if at least two of its documents
    have it and its share of documents is not far below that of the language where it is most common.
    """
    labelled = labelled.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Filters([], None, [])
    spark = labelled.sparkSession
    known = [(x, i, min(1.0, sample / counts[x])) for i, x in enumerate(languages)]
    known = spark.createDataFrame(known, "lang string, number int, share double")
    place = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = labelled.join(F.broadcast(known), "lang").filter(place < F.col("share"))
    rows = rows.select(F.col("number").alias("lang"), "text")
    grams = rows.mapInArrow(_counted, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    used = F.create_map(*(F.lit(x) for i, l in enumerate(languages) for x in (i, min(counts[l], sample))))
    grams = grams.withColumn("share", F.col("n") / used[F.col("lang")])
    best = grams.groupBy("gram").agg(F.max("share").alias("most"))
    kept = grams.join(best, "gram").filter((F.col("n") >= LEAST) & (F.col("share") >= SHARE * F.col("most")))
    filled = kept.select("lang", "gram").mapInArrow(_slotted, "slot long, word int, bits long")
    filled = filled.groupBy("slot", "word").agg(F.bit_or("bits").alias("bits")).collect()
    usual = max(languages, key=lambda x: (counts[x], x))
    return Filters(languages, usual, [(r.slot, r.word, r.bits) for r in filled])


def _predicted(batches: Iterator[pa.RecordBatch], filters: Filters, text: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    for part in T.slices(batches, text, SLICE):
        names, score = filters.predict(part.column(text))
        columns = [part.column(c) for c in kept]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])


def identify(docs: DataFrame, filters: Filters, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` of each row, by default all, with lang_pred and score: the best language's share
    over its sum with the second's, 0.5 to 1 (of a single language, its share).

    ``und`` with score 0 is for null texts, texts without letters, and when nothing was learned.  A text with letters none of whose
    n-grams are known gets the most frequent language with score 0.  Prediction looks at the text alone.
    """
    if keep is None:
        rows, names = docs, docs.columns
    else:
        rows, names = docs.select(*(c.alias(name) for name, c in keep.items()), F.col(text).alias("__text")), list(keep)
        text = "__text"
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names]
    schema = ", ".join([*fields, "lang_pred string", "score double"])
    return rows.mapInArrow(partial(_predicted, filters=filters, text=text, kept=names), schema)
