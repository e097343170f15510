"""Prefix trie, divergence audit and relative parsing against brute force, with odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stmtlog.llm import divergence, relative, trie

CLASH = ("block", "place", "factors_", "hash", "n", "shard", "c0", "term")


def _clashing(data):
    return data.withColumns({c: F.lit("x") for c in CLASH})


# ---- relative parsing ----------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string"


def _removed_by_force(texts, window):
    words = [(t or "").encode().split() for t in texts]
    places = defaultdict(list)
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places[tuple(w[i : i + window])].append((d, i))
    gone = [set() for _ in texts]
    for found in places.values():
        for d, i in found if len(found) > 1 else ():
            gone[d].update(range(i, i + window))
    return [(len(w), len(g), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in g)).hexdigest()) for w, g in zip(words, gone)]


def _texts(seed=3):
    rng = random.Random(seed)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passage, copy = prose(50), prose(80)
    texts = [prose(rng.randrange(120)) for _ in range(30)]
    texts += [f"{prose(rng.randrange(40))} {passage}\n\t{prose(rng.randrange(40))}" for _ in range(25)]
    texts += [copy] * 6 + [copy.replace(" ", "  "), copy + " end"]
    edited = copy.split()
    for i in range(8):
        edited[i * 9] = "new"
        texts.append(" ".join(edited))
    half = passage.split()
    texts += [" ".join(half[:35]), " ".join(half[:34]), " ".join(half[10:45] + half[:36]), " ".join(half * 3)]
    texts += [None, "", " \n", "one", "a b " * 200, "é " * 40, prose(35), prose(3000) + " " + passage + " " + prose(2000)]
    return texts


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_relative_parsing_equals_brute_force(spark, tmp_path, block):
    texts = _texts()
    rows = [(None if i % 11 == 5 else i // 2, t, None, None) for i, t in enumerate(texts)]
    path = str(tmp_path / "docs")
    _clashing(spark.createDataFrame(rows, DOCS)).repartition(5).write.parquet(path)
    found = relative.digests(spark.read.parquet(path), 35, block).collect()
    want = [(r[0], *x) for r, x in zip(rows, _removed_by_force(texts, 35))]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert sum(w[2] for w in want) > 3000


def test_factors_point_at_equal_words(spark):
    texts = _texts(5)
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    found = {r["doc_id"]: r["factors"] for r in relative.with_factors(docs).collect()}
    in_block = [w for t in texts for w in (t or "").split()]  # one block holds all texts
    pointed = 0
    for d, text in enumerate(texts):
        words = (text or "").split()
        for f in found[d]:
            assert f["stop"] - f["start"] >= 35
            assert words[f["start"] : f["stop"]] == in_block[f["at"] : f["at"] + f["stop"] - f["start"]]
            pointed += 1
    assert pointed > 20


def test_a_passage_in_many_texts_asks_once_per_block(spark):
    """The rows that a passage or a copied text gives grow with blocks and not with texts."""
    rng = random.Random(1)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} {rng.random()}" for _ in range(400)] + [passage] * 400
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS).coalesce(1)
    table = pa.table({"text": texts, "block": np.zeros(800, np.int64)})
    runs = pa.Table.from_batches(relative._runs(iter(table.to_batches(max_chunksize=100)), "text", 35, 11))
    assert runs.num_rows < 900  # those of the passage once, and one or two at the end of each text
    out = relative.digests(docs).collect()
    assert all(r["n_removed"] == 60 for r in out)


def test_parse_follows_the_reference_that_goes_on():
    hits = np.array([0, 1, 2, 3, 7, 8])
    first = np.array([100, 101, 300, 301, 7, 8])  # 7 and 8 are their own first places
    last = np.array([500, 501, 502, 503, 900, 901])
    assert relative.parse(hits, first, last, hits) == [(0, 4, 500), (7, 2, 900)]


def test_relative_parsing_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert relative.digests(empty).collect() == []
    assert relative.with_factors(empty).columns == ["doc_id", "text", "lang", "source", "factors"]


# ---- divergence audit ----------------------------------------------------------------------


def _audit_by_force(rows, least, most):
    counts, docs, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if c.isascii() else c for c in text)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts[lang, source].update(found)
        docs.update({(lang, w) for w in found})
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (one, w), n in docs.items() if one == lang and n >= least]
        sources = sorted(s for one, s in groups if one == lang)
        whole = Counter()
        for s in sources:
            whole.update({w: counts[lang, s][w] for w in kept})

        def share(c, kept=kept):
            total = sum(c[w] for w in kept) + 5 * len(kept)
            return {w: 1 + Fraction(10**9 * (c[w] + 5), total).__floor__() for w in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in sources if o != s]
            term = [(q[w] - p[s][w], w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:most])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(items, 1)]
    return out


@pytest.mark.parametrize("tile", [2, 64])
def test_audit_equals_brute_force(spark, tmp_path, tile):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefghij" for b in ("x", "Y", "é", "日", "ß")]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else rng.choice(["s1", "s2", "é", None, "", "s3", "S1"])
        some = words[: 10 + hash(source or "") % 20] if i % 7 else words
        rows.append((" ".join(rng.choices(some, k=rng.randrange(30))) + "12-É_Z", rng.choice(["en", "fr", None]), source))
    rows += [(None, "en", "null text"), ("", "zz", "only"), ("x1y", "zz", None), ("A" * 50_000 + " ax", "en", "long"), (rows[0])] * 2
    path = str(tmp_path / "docs")
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS)
    _clashing(docs).repartition(4).write.parquet(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # several blocks
    try:
        found = divergence.audit(spark.read.parquet(path), 20, 6, tile=tile).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == sorted(_audit_by_force(rows, 20, 6))


def test_run_lengths_and_distance():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        a, b = (np.sort(rng.integers(0, 3, n)) * rng.integers(0, 2, n) for _ in range(2))
        columns = [divergence.run_lengths(np.flatnonzero(x), x[x > 0], n) for x in (a, b)]
        assert divergence.distance(*columns, n) == np.abs(a - b).sum()
    starts, counts = divergence.run_lengths(np.array([3, 4, 5]), np.array([2, 2, 9]), 10)
    assert starts.tolist() == [0, 3, 5, 6] and counts.tolist() == [0, 2, 9, 0]


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([10**13, 0, 10**13])
    assert divergence.shares(counts, 3 * 10**13, 7).tolist() == [1 + 10**9 * (c + 5) // (3 * 10**13 + 35) for c in counts.tolist()]


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


# ---- prefix trie ---------------------------------------------------------------------------

TURNS = "conv_id long, turn int, role string, text string"


def _crc(c):
    import zlib

    return zlib.crc32(str(c).encode())


def _trie_by_force(rows, heads=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = _crc(c) % 4 if heads else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        own_saved = (len(nodes[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = own_saved + sum(saved[x] for x in children[node])
    return [
        (
            min(m), len(node), min(nodes[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(node)).encode()).hexdigest(),
        )
        for node, m in nodes.items()
    ]


def _query(turns):
    return trie.prefix_trie(trie.with_heads(trie.places(turns)))


def _conversations(seed=9):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi there  you", "", None, "ok é", "a:b"]))
    rows = []
    for c in [*range(0, 130), *range(1015, 1030), -7, -20, -21, 10**15, 10**15 + 1]:
        if c in (40, 63):
            continue  # no such conversation to take turns from
        first = [("user", "hello there")] if c % 3 == 0 else []
        turns = first + [turn() for _ in range(rng.choice([0, 1, 2, 3, 5, 8]))]
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rows += [(c, t, "user", f"same {t}") for c in (300, 301, 2300) for t in range(150)]  # deep, equal
    rows += [(303, t, "user", f"same {t}" if t < 90 else "else") for t in range(140)]
    rows += [(c, 3, "user", "same turn") for c in (400, 401)] * 3 + [(402, t, "u", "x") for t in (None, 2, None, -5, 3000, 1024)]
    rows += [(None, 1, "user", "lost"), (420, 1, None, None), (421, 1, "", "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("more", [0, 400])
def test_trie_equals_brute_force(spark, tmp_path, more):
    """With a conversation longer than all others, and without."""
    rows = _conversations() + [(300, 150 + t, "user", f"tail {t}") for t in range(more)]
    path = str(tmp_path / "turns")
    _clashing(spark.createDataFrame(rows, TURNS)).repartition(4).write.parquet(path)
    found = _query(spark.read.parquet(path)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, _trie_by_force(rows)))


def test_trie_of_few_and_of_none(spark):
    for rows in ([(7, 1, "user", "a b"), (7, 2, "user", "c")], [(5, 1, "user", "x"), (6, 1, "user", "x")], [(None, 1, "u", "x")], []):
        placed = trie.places(spark.createDataFrame(rows, TURNS))
        found = trie.prefix_trie(placed.unionByName(trie.members(placed))).collect()
        want = _trie_by_force(rows, heads=False) if any(r[0] is not None for r in rows) else []
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_places_are_numbered_over_spans(spark):
    rows = [(1, t, "user", str(t)) for t in range(-1500, 3000, 7)] + [(1, None, "user", "first")]
    placed = trie.places(spark.createDataFrame(rows, TURNS)).orderBy("place").collect()
    assert [p["place"] for p in placed] == list(range(1, len(rows) + 1))
    keys = [hashlib.md5(f"4:user{t}".encode()).digest() for t in ["first", *range(-1500, 3000, 7)]]
    assert [bytes(p["key"]) for p in placed] == keys


def test_a_node_has_a_row_for_each_shard(spark):
    """A first turn that all conversations share gives as many rows as there are shards."""
    turns = [(c, 1, "user", "hello") for c in range(3 * trie.SHARD)]
    held = [trie.Shard(s, None) for s in range(3)]
    key = bytes([7] * 16)
    for shard in held:
        ids = list(range(shard.base, shard.base + trie.SHARD))
        shard.read(0, ids + ids, [0] * len(ids) + [1] * len(ids), [None] * len(ids) + [key] * len(ids), [0] * len(ids) + [1] * len(ids))
        shard.close()
        assert shard.rows().num_rows == 2
    placed = trie.places(spark.createDataFrame(turns, TURNS))
    found = trie.prefix_trie(placed.unionByName(trie.members(placed))).collect()
    assert sorted(r["n_convs"] for r in found) == [3 * trie.SHARD] * 2
