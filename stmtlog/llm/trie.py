r"""The prefix trie of conversations, by vertical bitmaps.

A node is a distinct sequence of first turns; its members are the conversations that start with it.

* A turn is known by a digest of its role and text; texts are read once and not exchanged.  Places within a conversation
  are numbered in spans of SPAN turn numbers, whose sizes are then summed up, so a conversation may hold any share of the rows.
* A shard is SHARD neighbouring conversation ids.  Its index maps (place, turn) to the bitset of its conversations with that
  turn there.  Depth first, a parent's bitset and the postings of the next place are intersected: each intersection that
  is not empty is a child, its popcount the shard's members, and the members without a next turn are its end list.
  Places are read LEVELS at a time, with the nodes that the levels before left open, so the index of a shard is bounded.
* Nodes are named by chained digests of their turns, so the shards' counts, least members and end lists of a node meet by
  name; a node has at most one row for each shard, however many its members are.
* Sums over subtrees take the nodes with several members only, by doubling: what lies less than 2, 4, 8 ... levels below.
  A node with one member is a chain without branches.
* The longest conversation, as far as it is longer than all others, is such a chain too and takes no part in the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stmtlog.plans.stage import stage

SPAN, SHARD, LEVELS = 1024, 1024, 64
ROOT = bytes(16)
WORD = r"[^\x20\x09-\x0D]+"


def turn_digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def places(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, place, key, words): the turns of each conversation in order, from place 1.

    In order of turn, nulls first; turns of one number by the digest of role and text, which is their ``key``.  A null role
    or text is empty.  Rows without conv_id take no part.
    """
    turns = turns.filter(F.col(conv_id).isNotNull())
    none = F.lit(-(1 << 60))
    span = F.coalesce(F.floor(F.col(turn) / SPAN).cast("bigint"), none).alias("span")
    rows = turns.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), span, F.col(turn).alias("turn"),
        turn_digest(F.col(role), F.col(text)).alias("key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("words"),
    )
    sizes = turns.select(F.col(conv_id).cast("bigint").alias("conv_id"), span).groupBy("conv_id", "span").count()
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    later = sizes.select("conv_id", "span", F.sum("count").over(before).alias("before")).filter("before > 0")
    within = F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(F.asc_nulls_first("turn"), "key"))
    placed = rows.withColumn("within", within).join(later, ["conv_id", "span"], "left")
    return placed.select("conv_id", (F.col("within") + F.coalesce("before", F.lit(0))).alias("place"), "key", "words")


def with_heads(placed: DataFrame, every: int = 20, kinds: int = 4) -> DataFrame:
    """Conversations whose first turns are those of another one, with a row of place 0 for each.

    Conversation c takes the first h turns of conversation c - c % every (all if fewer, none if there is none), then its own
    after its first h; h = crc32 of c in decimal modulo ``kinds``.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % kinds
    ids = placed.filter("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("head"), h.alias("h"))
    heads = placed.filter(F.col("place") < kinds).withColumnRenamed("conv_id", "head")
    first = ids.join(heads, "head").filter("place <= h").select("conv_id", "place", "key", "words")
    sizes = heads.groupBy("head").agg(F.count("*").alias("size"))
    missing = ids.join(sizes, "head", "left").select("conv_id", (F.col("h") - F.coalesce("size", F.lit(0))).alias("missing"))
    own = placed.filter(F.col("place") > h).join(missing.filter("missing > 0"), "conv_id", "left")
    own = own.select("conv_id", (F.col("place") - F.coalesce("missing", F.lit(0))).alias("place"), "key", "words")
    return first.unionByName(own).unionByName(members(placed))


def members(placed: DataFrame) -> DataFrame:
    """A row of place 0 for each conversation that has turns."""
    ids = placed.filter("place = 1").select("conv_id", F.lit(0).cast("bigint").alias("place"))
    return ids.select("*", F.lit(None).cast("binary").alias("key"), F.lit(0).cast("bigint").alias("words"))


PART = "shard long, node binary, parent binary, depth long, n long, least long, words long, ends string, up array<binary>, more int"
_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
          pa.list_(pa.binary()), pa.int32()]


def _set_bits(bits: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8), bitorder="little"))


class Shard:
    """The trie of a shard's conversations, built from their turns LEVELS places at a time."""

    def __init__(self, number: int, longest: tuple[int, int] | None):
        self.number, self.base, self.longest = number, number * SHARD, longest
        self.open: list[tuple[bytes, bytes | None, int, int, list[bytes]]] = []
        self.out: list[tuple] = []

    def read(self, level: int, conv: list[int], place: list[int], key: list[bytes], words: list[int]) -> None:
        """The turns at the places of one level, with which the members of open nodes go on."""
        postings: dict[int, dict[bytes, int]] = {}
        turn_at: dict[int, dict[int, bytes]] = {}
        going: dict[int, int] = {}
        words_of = dict(zip(key, words, strict=True))
        for c, p, k in zip(conv, place, key, strict=True):
            c -= self.base
            going[p] = going.get(p, 0) | 1 << c
            if p:
                at = postings.setdefault(p, {})
                at[k] = at.get(k, 0) | 1 << c
                turn_at.setdefault(p, {})[c] = k
        if level == 0:
            self.open = [(ROOT, None, going[0], 0, [])]
        todo, self.open = self.open, []
        for node, parent, bits, weight, above in todo:
            stack, path = [(node, parent, bits, weight, len(above))], list(above)
            while stack:
                node, parent, bits, weight, depth = stack.pop()
                del path[depth:]
                if depth == (level + 1) * LEVELS:
                    self.open.append((node, parent, bits, weight, list(path)))
                    continue
                path.append(node)
                rest = bits & going.get(depth + 1, 0)
                self._found(node, parent, bits, weight, depth, bits & ~rest, path)
                while rest:
                    turn = turn_at[depth + 1][(rest & -rest).bit_length() - 1]
                    child = rest & postings[depth + 1][turn]
                    rest &= ~child
                    name = hashlib.blake2b(node + turn, digest_size=16).digest()
                    stack.append((name, node, child, words_of[turn], depth + 1))

    def close(self) -> None:
        """No turns are left: the members of open nodes end there."""
        for node, parent, bits, weight, path in self.open:
            self._found(node, parent, bits, weight, len(path), bits, [*path, node])
        self.open = []

    def _found(self, node, parent, bits, weight, depth, ends, path) -> None:
        more = 0
        if ends and self.longest and depth == self.longest[1] and ends >> (self.longest[0] - self.base) == 1:
            ends, more = 0, 1  # its turns beyond the second longest conversation are not here
        ids = ",".join(map(str, (_set_bits(ends) + self.base).tolist())) if ends else None
        least = self.base + (bits & -bits).bit_length() - 1
        up = [path[depth - (1 << j)] for j in range(depth.bit_length())]
        self.out.append((self.number, node, parent, depth, bits.bit_count(), least, weight, ids, up, more))

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [[]] * len(_TYPES)
        self.out = []
        arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PART.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch], longest: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    """From turns sorted by shard, level and place: the rows of each shard's nodes."""
    shard, held, at = None, [], None

    def take() -> None:
        table = pa.Table.from_batches(held)
        shard.read(at[1], *(table[c].to_pylist() for c in ("conv_id", "place", "key", "words")))
        held.clear()

    for batch in batches:
        numbers, levels = batch.column("shard").to_numpy(), batch.column("level").to_numpy()
        new = np.flatnonzero((numbers[1:] != numbers[:-1]) | (levels[1:] != levels[:-1])) + 1
        for i, j in zip([0, *new], [*new, batch.num_rows], strict=True):
            if i == j:
                continue
            key = int(numbers[i]), int(levels[i])
            if held and key != at:
                take()
                yield shard.rows()
            if shard is None or shard.number != key[0]:
                if shard is not None:
                    shard.close()
                    yield shard.rows()
                mine = longest is not None and longest[0] // SHARD == key[0]
                shard = Shard(key[0], longest if mine else None)
            at = key
            held.append(batch.slice(i, j - i))
    if shard is not None:
        if held:
            take()
        shard.close()
        yield shard.rows()


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's end lists, joined, from rows sorted by node and shard; one list at a time."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    for batch in batches:
        done: list[pa.RecordBatch] = []
        for n, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if n != node:
                if digest is not None:
                    done.append(row())
                node, digest = n, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if digest is not None:
        yield row()


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(node, leaves, saved) summed over the subtrees of the nodes with several members."""
    shared = nodes.filter("n > 1")
    own = F.col("singles") + F.when(F.col("children") == 0, 1).otherwise(0)
    shared = stage(
        shared.select("node", "depth", "up", own.alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved")), "subtrees"
    )
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    for j in range(int(deepest).bit_length()):
        below = shared.filter(F.col("depth") >= 1 << j).groupBy(F.col("up")[j].alias("node"))
        below = below.agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        more = {c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")}
        shared = stage(shared.join(below, "node", "left").select("node", "depth", "up", *more.values()), "subtrees")
    return shared.select("node", "leaves", "saved")


def prefix_trie(rebuilt: DataFrame) -> DataFrame:
    """The nodes of conversations given as (conv_id, place, key, words), with a row of place 0 for each.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member, the
    number of turns, the parent's smallest member (root: null), members, children, nodes without children in the subtree,
    the words saved there by writing each node's last turn once, and the digest of the ids of the conversations that end
    here, ascending, joined by commas.  No conversations give no nodes.

    A task holds the turns of SHARD conversation ids at LEVELS places, and the names of the open nodes' ancestors.
    """
    rebuilt = stage(rebuilt, "turns")
    longest = rebuilt.groupBy("conv_id").agg(F.max("place").alias("size")).orderBy(F.desc("size"), "conv_id").limit(2).collect()
    if not longest:
        longest = [(None, 0)]
    (alone, size), second = longest[0], longest[1][1] if len(longest) > 1 else 0
    cut = second + 1
    level = F.floor((F.greatest("place", F.lit(1)) - 1) / LEVELS).alias("level")
    shard_of = F.floor(F.col("conv_id") / SHARD).cast("bigint")
    rows = rebuilt.filter(F.col("place") <= cut).select(shard_of.alias("shard"), level, "conv_id", "place", "key", "words")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "level", "conv_id", "place")
    parts = stage(rows.mapInArrow(partial(_shards, longest=(alone, cut) if size > cut else None), PART), "shards")

    one = {c: F.first(c).alias(c) for c in ("parent", "depth", "words", "up")}
    nodes = parts.groupBy("node").agg(
        F.sum("n").alias("n"), F.min("least").alias("conv_id"), F.max("more").alias("more"), *one.values()
    )
    nodes = stage(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent").alias("node"))
    children = children.agg(F.count("*").alias("children"), F.count_if(F.col("n") == 1).alias("singles"))
    nodes = stage(nodes.join(children, "node", "left").fillna(0, ["children", "singles"]), "nodes")
    ends = parts.filter("ends IS NOT NULL").select("node", "shard", "ends").repartition("node")
    ends = ends.sortWithinPartitions("node", "shard").mapInArrow(_end_digests, "node binary, ends_sha256 string")
    # a parent with several members, by the shard of a child's smallest member
    links = parts.select("node", "shard").join(nodes.filter("n > 1").select("node", F.col("conv_id").alias("link")), "node")
    links = links.withColumnRenamed("node", "parent")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    found = (
        nodes.withColumn("shard", shard_of)
        .join(links, ["parent", "shard"], "left")
        .join(_subtrees(nodes), "node", "left")
        .join(ends, "node", "left")
        .select(
            "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("link", "conv_id")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), (F.col("children") + F.col("more")).alias("n_children"),
            F.coalesce("leaves", F.lit(1)).cast("bigint").alias("n_leaves"),
            F.coalesce("saved", F.lit(0)).cast("bigint").alias("saved_tokens"),
            F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )
    last, one = F.col("place") == size, F.lit(1).cast("bigint")
    chain = rebuilt.filter(F.col("place") > cut).select(
        "conv_id", F.col("place").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    )
    return found.unionByName(chain)
