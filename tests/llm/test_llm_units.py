"""Parts that need no session: reductions, trees, estimates, encodings."""

import base64
import itertools
import math
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from tokenizers import Tokenizer

from stmtlog.llm import ctw, langid, minhash, mixing, packing, suffix, text, tokens, topk

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
HARD = [
    "It's a dog's .'s ,'t foo.'re  BAR_baz a1b2 <|endoftext|>x <|ENDOFTEXT|> İΣς é. …a.b…c Å.", "", None, "...",
    "''s 's's don't.'Tis", "a b c.d\x0be\x1cf", "x" * 5000, "日本語。テスト", "<| a.b", "Straße.ÉTÉ,Ça", "K.ﬁ", "`a`b^c~",
    "\n\n a \n\n  b.\t\tc ", "🙂🙂 é́ 🙂", " ", "\x00a\x00",
]


def test_words_and_shingles_against_plain_python():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abC é\t\n\x0b\x0c\r ") for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", " "]
    data, offsets = text.utf8(pa.array(texts))
    starts, stops, first = text.words(data, offsets)
    for i, t in enumerate(texts):
        expected = (t or "").encode().split()
        own = range(first[i], first[i + 1])
        assert [bytes(data[starts[w] : stops[w]]) for w in own] == expected
    for size in (1, 2, 5):
        hashed, begin = text.shingles(data, offsets, size)
        seen = {}
        for i, t in enumerate(texts):
            w = (t or "").encode().lower().split()
            plain = [tuple(w[j : j + size]) for j in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []
            own = hashed[begin[i] : begin[i + 1]].tolist()
            assert len(own) == len(plain)
            for h, p in zip(own, plain, strict=True):
                assert seen.setdefault(h, p) == p
        assert len(seen) == len(set(seen.values()))


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_pydict({"t": pa.array(["ab" * 10, None, "", "c" * 100, "d"])})
    parts = list(text.slices(iter([batch, batch.slice(0, 0)]), "t", limit=30))
    assert [x for p in parts for x in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    assert max(sum(len(x or "") for x in p.column("t").to_pylist()) for p in parts if p.num_rows > 1) <= 30


def test_registers_merge_and_agree_like_the_model():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for shared in (0.3, 0.85):
        equal = []
        for k in range(20):
            own = rng.integers(0, 2**63, 4000, dtype=np.uint64)
            n = int(1000 * shared)
            one = np.concatenate([base[:n], own[: 1000 - n]])
            other = np.concatenate([base[:n], own[1000 : 2000 - n]])
            rows = minhash.registers(np.concatenate([one, other]), np.array([0, len(one)]))
            parts = minhash.registers(one, np.array([0, 500]))
            assert (parts.max(0) == rows[0]).all()  # merging is the maximum
            equal.append((rows[0] == rows[1]).mean())
        j = shared / (2 - shared)
        x = (1 - j) / 2
        expected = 1 - 2 * -math.log1p(-x * (minhash.BASE - 1) / minhash.BASE) / math.log(minhash.BASE)
        assert abs(np.mean(equal) - expected) < 0.03


def test_likelihood_keeps_pairs_at_the_limit_and_drops_far_ones():
    rng = np.random.default_rng(5)
    near, far = [], []
    for _ in range(200):
        x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
        n = 850
        one, other = x[: n + 75], np.concatenate([x[:n], x[2000:2075]])  # 850 / 1000
        third = np.concatenate([x[:400], x[1000:1525]])
        rows = minhash.registers(np.concatenate([one, other, third]), np.array([0, 925, 1850]))
        size = np.array([925.0])
        near.append(minhash.may_link(rows[:1], rows[1:2], size, size, 0.85)[0])
        far.append(minhash.may_link(rows[:1], rows[2:3], size, size, 0.85)[0])
    assert all(near) and sum(far) <= 2


def test_shared_sizes_against_sets():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    found = minhash.shared(sets)
    for i, j in itertools.combinations(range(40), 2):
        assert found[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))


def test_search_against_all_scores():
    rng = np.random.default_rng(7)
    for n, dims, k in ((300, 40, 5), (3, 4, 5), (1, 1, 5), (200, 17, 3)):
        found = np.floor(rng.normal(size=(n, dims)) * 3)
        ids = rng.integers(0, n, n)
        queries, own = found[: min(n, 20)], ids[: min(n, 20)]
        for search in (topk.search, topk._exactly):
            for q, (places, scores) in enumerate(search(queries, own, found, ids, k)):
                every = sorted((-int(found[c] @ queries[q]), int(ids[c])) for c in range(n) if ids[c] != own[q])[:k]
                assert [(-int(s), int(ids[p])) for p, s in zip(places, scores, strict=True)] == every


def _fewest(sizes, capacity):
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for b in sorted({r for r in rooms if r >= sizes[i]}):
            at = rooms.index(b)
            place(i + 1, [*rooms[:at], b - sizes[i], *rooms[at + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_dominance_keeps_a_best_packing():
    rng = random.Random(8)
    for _ in range(400):
        capacity = rng.choice([10, 20, 31])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = {s: sizes.count(s) for s in sizes}
        fixed, left = packing.reduce_by_dominance(counts, capacity)
        used = [x for p in fixed for length, n in p.parts for x in [length] * (n * p.times)]
        rest = [x for length, n in left.items() for x in [length] * n]
        assert sorted(used + rest) == sorted(sizes)
        assert all(sum(length * n for length, n in p.parts) <= capacity for p in fixed)
        assert sum(p.times for p in fixed) + _fewest(rest, capacity) == _fewest(sizes, capacity)


def _best_fit_one_by_one(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


def test_best_fit_by_counts_equals_best_fit_one_by_one():
    rng = random.Random(9)
    for _ in range(200):
        capacity = rng.choice([10, 50, 200])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        counts = {s: sizes.count(s) for s in sizes}
        patterns = packing.best_fit(counts, capacity)
        assert sum(p.times for p in patterns) == _best_fit_one_by_one(sizes, capacity)
        held = {}
        for p in packing.plan(counts, capacity):
            assert sum(length * n for length, n in p.parts) <= capacity and p.times > 0
            for length, n in p.parts:
                held[length] = held.get(length, 0) + n * p.times
        assert held == counts


def test_encoding_by_pieces_equals_the_tokenizer():
    plain = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(10)
    alphabet = "abAB'.,<|>1é \n\té́ßİ_-…日 "
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(500)]
    got = list(packing.encode(pa.array(texts), WORD_BPE))
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_word_cache_may_overflow(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    plain = Tokenizer.from_file(WORD_BPE)
    for t in ("one two three four five", "six one", "two"):
        (ids,) = packing.encode(pa.array([t]), WORD_BPE)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_weighting_is_a_probability_and_mixes_depths():
    """All texts over a small alphabet of one length, ended, and all longer ones add up to one."""
    codes, counts = np.unique(ctw._codes(*text.utf8(pa.array(["abab", "abba", "b"])), 3)[0], return_counts=True)
    every = {}
    for code, n in zip(codes, counts, strict=True):
        every.setdefault(int(code >> 8), {})[int(code & 0xFF)] = int(n)
    for context in every:  # a context's 256 strings, whatever was counted
        own = np.array([(context << 8) | s for s in range(256)])
        n = np.array([every[context].get(s, 0) for s in range(256)])
        trees = ctw.Weighting(own, n, 3)
        for a, b, stop in ((0.0, 1.0, 0.5), (0.1, 0.7, 0.3)):
            full = [np.full(256, x) for x in (a, b, stop)]
            assert abs((10 ** trees.scores(*full)).sum() - 1) < 1e-9


def test_weighting_against_plain_recursion():
    depth, rng = 4, random.Random(11)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(8)]
    codes, _ = ctw._codes(*text.utf8(pa.array(texts)), depth)
    kt = lambda a, b: float(ctw.log_kt(np.array([a]), np.array([b]))[0])
    counted = {}
    for c in codes.tolist():
        for i in range(8):
            node, bit = (1 << i) + ((c & 0xFF) >> (8 - i)), ((c & 0xFF) >> (7 - i)) & 1
            for d in range(depth + 1):
                key = (d, (c >> 8) & ((1 << 8 * d) - 1), node)
                counted.setdefault(key, [0, 0])[bit] += 1

    def weighted(d, context, node):
        own = kt(*counted[(d, context, node)])
        if d == depth:
            return own
        children = sum(weighted(d + 1, x, node) for e, x, m in list(counted) if e == d + 1 and m == node and x & ((1 << 8 * d) - 1) == context)
        return np.logaddexp(own, children) - math.log(2)

    def chance(d, context, node):  # of a one
        zeros, ones = counted[(d, context & ((1 << 8 * d) - 1), node)]
        estimate = (ones + 0.5) / (zeros + ones + 1)
        if d == depth or (d + 1, context & ((1 << 8 * (d + 1)) - 1), node) not in counted:
            return estimate
        w = math.exp(kt(zeros, ones) - math.log(2) - weighted(d, context & ((1 << 8 * d) - 1), node))
        return w * estimate + (1 - w) * chance(d + 1, context, node)

    unique, n = np.unique(codes, return_counts=True)
    suffixes = (unique >> 8) & 0xFFFF
    tables = {s: pa.table({"key": unique[suffixes == s], "n": n[suffixes == s]}) for s in np.unique(suffixes)}
    summaries = {s: ctw._summary((pa.scalar(int(s)),), t, depth) for s, t in tables.items()}
    last = {}
    for low in {int(s) & 0xFF for s in tables}:
        rows = pa.concat_tables([x for s, x in summaries.items() if int(s) & 0xFF == low])
        one = ctw._upper_rows((pa.scalar(low),), rows)
        last[low] = (np.array(one["counts"][0].as_py()), np.array(one["children"][0].as_py()))
    short = ctw._short(last)
    for s, t in tables.items():
        out = ctw._scored((pa.scalar(int(s)),), t, summaries[s], depth, short)
        for code, value in zip(out["key"].to_pylist(), out["value"].to_pylist(), strict=True):
            expected = 0.0
            for i in range(8):
                p = chance(0, code >> 8, (1 << i) + ((code & 0xFF) >> (8 - i)))
                expected += math.log10(p if (code & 0xFF) >> (7 - i) & 1 else 1 - p)
            assert abs(value - expected) < 1e-9


def test_log_kt_against_products():
    for a, b in ((0, 0), (3, 2), (0, 7), (5000, 4999), (20000, 1)):
        got = float(ctw.log_kt(np.array([a]), np.array([b]))[0])
        exact = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        assert abs(got - exact) < 1e-6 * max(1, abs(exact))


def test_lookup_finds_all_keys_and_refuses_others():
    rng = np.random.default_rng(12)
    keys = np.unique(rng.integers(-(2**62), 2**62, 5000))
    values = rng.random(len(keys))
    table = ctw.Lookup(keys, values)
    ask = rng.integers(0, len(keys), 20000)
    assert (table.get(keys[ask]) == values[ask]).all()
    with pytest.raises(RuntimeError):
        table.get(np.array([keys[0] + 1 if keys[0] + 1 not in keys else keys[0] + 2]))


def test_requests_and_answers_come_back_as_they_were_packed():
    rng = np.random.default_rng(13)
    ends = np.array([-(2**63), -1, 0, 2**56 - 1])
    keys = np.unique(np.append(ends, rng.integers(-(2**63), 2**56, 1000)))
    for k in (keys, keys[:1], keys[:0]):
        assert (ctw._unpacked_keys(ctw._packed_keys(k)) == k).all()
    values = rng.standard_normal(100)
    assert (ctw._unpacked(ctw._packed(values), np.float64) == values).all()
    docs = pa.RecordBatch.from_pydict({"text": ["one two", None, "two"], "train": [True, True, False], "bundle": [4, 4, 4]})
    asked = pa.Table.from_batches(ctw._asked(iter([docs]), depth=3, buckets=5))
    assert asked.num_rows <= 5 and sum(asked.column("words").to_pylist()) == 2
    key, n = ctw._totals(asked)
    assert (np.diff(key.astype(float)) > 0).all() and n[key < 0].tolist() == [1, 1] and n[key >= 0].sum() == 9
    parts = [asked.slice(i, 1) for i in range(asked.num_rows)]
    assert {int(b) for p in parts for b in ctw._buckets(ctw._totals(p)[0], 5)} == set(asked.column("bucket").to_pylist())
    counted = ctw._counted(asked)
    assert counted.filter(pc.equal(counted.column("key"), -1)).column("n").to_pylist() == [2]


def test_a_partition_is_asked_for_and_scored_in_little_memory():
    rng = np.random.default_rng(17)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(20_000)])
    texts = [" ".join(words[rng.integers(0, len(words), 300)]) for _ in range(2000)]
    ids = np.arange(len(texts))
    asking = pa.RecordBatch.from_pydict({"text": texts, "train": ids % 10 > 0, "bundle": ids * 0})
    tracemalloc.start()
    asked = pa.Table.from_batches(ctw._asked(iter([asking]), depth=5, buckets=3))
    peak_asked = tracemalloc.get_traced_memory()[1]
    key, _ = ctw._totals(asked)
    packed = sum(pc.sum(pc.binary_length(asked.column(c))).as_py() for c in ("keys", "counts"))
    model = pa.table({"key": key[key >= 0], "value": np.full(np.count_nonzero(key >= 0), -1.0)})
    answers = ctw._answered(pa.concat_tables([asked.drop_columns("words"), model], promote_options="default"))
    rows = pa.table({"bundle": ids * 0, "doc_id": ids, "text": texts, "held_out": ids % 10 == 0})
    scoring = pa.concat_tables([answers, rows], promote_options="default").to_batches()
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    scores = pa.Table.from_batches(ctw._scores(iter(scoring), depth=5))
    peak_scored = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert scores.column("score").to_pylist() == [-1.0 - len(t) for t in texts]
    assert packed < 8 * len(key) and peak_asked < 60e6 and peak_scored < 45e6, (len(key), packed, peak_asked, peak_scored)


def test_splitting_tree_deals_exact_quotas_at_random():
    quotas = np.array([1000, 10, 0, 333])
    source = np.repeat(np.arange(4), quotas)
    block = np.concatenate([np.arange(q) for q in quotas])
    shard = mixing.Tree(quotas, 7, 1).shard(source, block)
    assert abs(np.bincount(shard, minlength=7) - len(source) / 7).max() <= 3
    assert (shard == mixing.Tree(quotas, 7, 1).shard(source, block)).all()
    some = np.array([5, 700, 1200])
    assert (mixing.Tree(quotas, 7, 1).shard(source[some], block[some]) == shard[some]).all()  # a part alone is dealt alike
    assert (mixing.Tree(quotas, 7, 2).shard(source, block) != shard).any()


def test_ngrams_stay_within_texts_and_words():
    codes, owner = langid.ngrams(pa.array(["ab", "Abc d", None, "1 2", "é"]))
    grams = [(int(o), int(c).to_bytes(4, "big").decode("latin1")) for o, c in zip(owner, codes, strict=True)]
    assert grams == [(0, " ab "), (1, " abc"), (1, "abc "), (1, "bc d"), (1, "c d "), (4, " \xc3\xa9 ")]


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(13)
    passage = rng.integers(97, 101, 400).astype(np.uint8)
    data = np.concatenate([rng.integers(97, 101, 300), passage, rng.integers(97, 101, 200), passage]).astype(np.uint8)
    doc, first, windows, before, gram, _ = suffix.runs(data, np.array([0, len(data)]), 50, 25)
    assert windows.sum() == len(data) - 49 and (doc == 0).all()
    anchor = {}
    for f, n, b, g in zip(first, windows, before, gram, strict=True):
        for p in range(f, f + n):
            window = data[p : p + 50].tobytes()
            assert anchor.setdefault(window, (f + b - p, g)) == (f + b - p, g)


@pytest.mark.parametrize("rule", tokens.RULES)
def test_attribution_against_each_token(rule):
    rng = random.Random(14)
    texts = ["".join(rng.choice("ab. !\né🙂") for _ in range(rng.randrange(80))) for _ in range(150)] + ["a" * 3000, "🙂" * 50]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    for t in texts:
        start, stop = tokens.spans(t, RANKS, public_tokenizers.PATTERN)
        encoding, _ = tokens._encoding(RANKS, public_tokenizers.PATTERN)
        at, plain = 0, []
        for i in encoding.encode_ordinary(t):
            piece = encoding.decode_single_token_bytes(i)
            assert piece in ranks
            low = len(t.encode()[: at + 1].decode(errors="ignore")) if t.encode()[at] < 0x80 else None
            plain.append((at, at + len(piece), low))
            at += len(piece)
        edges = [len(c.encode()) for c in t]
        begin = np.append(0, np.cumsum(edges))
        points = [(int(np.searchsorted(begin, i, side="right") - 1), int(np.searchsorted(begin, j))) for i, j, _ in plain]
        assert points == list(zip(start.tolist(), stop.tolist(), strict=True))
        cuts = sorted(rng.sample(range(len(t) + 1), min(3, len(t) + 1)))
        low = np.array([0, *cuts], np.int64)
        high = np.array([*cuts, len(t)], np.int64)
        got, crossing = tokens.attribute(start, stop, low, high, rule)
        for k, (a, b) in enumerate(zip(low, high, strict=True)):
            own = cross = 0
            for i, j in points:
                if rule == "first":
                    own += a <= i < b
                elif rule == "last":
                    own += a < j <= b
                else:
                    own += 2 * a < i + j <= 2 * b
                cross += i < a < j or i < b < j
            assert (got[k], crossing[k]) == (own if b > a else 0, cross)
        assert got.sum() == len(start)
