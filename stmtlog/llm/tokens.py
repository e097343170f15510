"""Token counts of sections, by offsets.

A document is encoded once, as a whole, so its tokens are those a model sees.  Each token's span of code points is
then joined with the sections' intervals: between two boundaries by binary search, and for a token that crosses
a boundary by a rule.  Byte-level tokens cover the text without gaps, so spans come from the tokens' lengths.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlog.llm import text as T

RULES = ("first", "last", "most")


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a file of ranks, and the number of bytes of each id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First code point and end of each token; tokens that share a code point both have it."""
    encoding, lengths = _encoding(path, pattern)
    ids = encoding.encode_to_numpy(text, disallowed_special=())
    stop = np.cumsum(lengths[ids])
    start = stop - lengths[ids]
    data = np.frombuffer(text.encode(), np.uint8)
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points that begin before each byte
    return lead[np.minimum(start + 1, len(data))] - 1 if len(ids) else start, lead[stop]


def sentences(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The sentences of a text as sections: each ends with a line end, or with a space after ``.``, ``!`` or ``?``."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = points == 10
    ends[1:] |= (points[1:] == 32) & np.isin(points[:-1], [33, 46, 63])
    edges = np.unique(np.concatenate([[0], np.flatnonzero(ends) + 1, [len(points)]]))
    return edges[:-1], edges[1:]


def attribute(start, stop, low, high, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For sections [low, high): the tokens that belong to each, and those that cross one of its boundaries."""
    if rule == "first":
        tokens = np.searchsorted(start, high) - np.searchsorted(start, low)
    elif rule == "last":
        tokens = np.searchsorted(stop, high, side="right") - np.searchsorted(stop, low, side="right")
    else:
        twice = start + stop
        # a token half in a section is its own if it begins there: ties go to the section of the first half
        tokens = np.searchsorted(twice, 2 * high, side="right") - np.searchsorted(twice, 2 * low, side="right")
    tokens = np.where(high > low, tokens, 0)
    at = lambda edge: np.searchsorted(start, edge) - np.searchsorted(stop, edge, side="right")
    inside = (np.searchsorted(start, low, side="right") - 1).clip(0)
    both = np.zeros(len(low), np.int64)
    if len(start):  # a token around the whole section crosses both boundaries, and counts once
        both = ((start[inside] < low) & (stop[inside] > high)).astype(np.int64)
    return tokens, at(low) + at(high) - both


COUNTS = "doc_id long, section int, name string, start long, stop long, tokens long, crossing long, doc_tokens long"


def _counts(batches: Iterator[pa.RecordBatch], path: str, pattern: str, rule: str, listed: bool) -> Iterator[pa.RecordBatch]:
    for part in T.slices(batches, "text"):
        out: list[list] = [[] for _ in range(7)]
        texts, names = part.column("text").to_pylist(), []
        sections = part.column("sections").to_pylist() if listed else [None] * len(texts)
        for d, (text, given) in enumerate(zip(texts, sections, strict=True)):
            text = text or ""
            start, stop = spans(text, path, pattern)
            if listed:
                given = [s for s in given or [] if s and s["start"] is not None and s["stop"] is not None]
                low = np.array([s["start"] for s in given], np.int64).clip(0, len(text))
                high = np.array([s["stop"] for s in given], np.int64).clip(0, len(text))
                names += [s["name"] for s in given]
            else:
                low, high = sentences(text)
                names += [None] * len(low)
            tokens, crossing = attribute(start, stop, low, high, rule)
            for column, values in zip(out, (np.full(len(low), d), np.arange(len(low)), low, high, tokens, crossing), strict=False):
                column.append(values)
            out[6].append(np.full(len(low), len(start)))
        row, section, *rest = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(section, pa.int32()), pa.array(names, pa.string())]
        columns += [pa.array(c, pa.int64()) for c in rest]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COUNTS.split(", ")])


def token_counts(
    docs: DataFrame, ranks: str, pattern: str, rule: str = "first", sections: str | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, section, name, start, stop, tokens, crossing, doc_tokens): one row for each section of each document.

    ``sections`` names a column of array<struct<name, start, stop>> in code points; without it the sections are
    the sentences and lines, see sentences(), which cover the text.  Sections may overlap or leave gaps; ends beyond
    the text are cut, null sections are left out, and an empty section has no tokens.

    A token within a section counts for it.  One that crosses a boundary counts, by ``rule``, for the sections that
    hold its first code point, its last one, or the most of it (half and half: its first half).  crossing is
    the number of tokens across the section's boundaries, doc_tokens the document's tokens.  So over
    sections that cover a text without overlaps, tokens add up to doc_tokens.

    A null or empty text has no sentences and so no rows.  Rows with a null or repeated id are documents of their
    own.  Special tokens are ordinary text.  Other columns are not looked at.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    columns = [F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")]
    if sections:
        kind = "array<struct<name: string, start: bigint, stop: bigint>>"
        columns.append(F.col(sections).cast(kind).alias("sections"))
    counted = partial(_counts, path=ranks, pattern=pattern, rule=rule, listed=bool(sections))
    return docs.select(*columns).mapInArrow(counted, COUNTS)
