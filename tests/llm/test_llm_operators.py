"""The operators on small tables: brute force, and the odd rows that each must bear."""

import bisect
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stmtlog.llm import chat, ctw, fingerprints, graph, langid, minhash, mixing, packing, suffix, tokens, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside.
CLASH = ["row", "node", "key", "size", "uid", "h", "bundle", "task", "spans", "score", "lang_pred", "id", "__key", "a", "b", "n"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(20)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120), prose(60)
    out = [(i, prose(rng.randint(1, 80)), "en", f"s{i % 3}") for i in range(30)]
    for i in range(30, 60):  # near copies, some too far from the first but not from each other
        w = base.split()
        for _ in range(i % 6):
            w[rng.randrange(len(w))] = "zz"
        out.append((i, " ".join(w), "fr" if i % 2 else None, None))
    out += [(i, prose(10) + " " + passage + "\n" + prose(5), "fr", "hot") for i in range(60, 70)]
    out += [(i, base.upper() if i % 2 else base, "en", "hot") for i in range(70, 80)]
    out += [
        (80, None, None, None), (81, "", "en", "s1"), (82, " \n\t ", None, ""), (83, "one", "en", "s1"), (84, "ONE", "en", "s1"),
        (85, "z" * 30_000, "en", "s2"), (86, "ab " * 400, "en", "s2"), (None, base, "en", "s2"), (None, None, None, None),
        (5, "one two three four", "en", "s1"), (5, "one two three four", "en", "s1"), (5, "other words here", "en", "s0"),
        (-3, "日本語 🙂 é́ text", "fr", "é"), (87, "12 !? 34", None, "s1"), (88, "\x00\x01 a", "en", "s1"),
    ]
    return [(d, t, lang, source, None if t is None else len(t)) for d, t, lang, source in out]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    """Written in three files, with columns whose names clash with the operators' own."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    data = spark.createDataFrame(rows, DOCS)
    data = data.withColumns({c: F.lit(7).cast("string") for c in CLASH if c not in data.columns})
    data.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.limit(0)


def _words(text):
    return (text or "").encode().lower().split()


def _shingles(text):
    w = _words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _near(rows, percent=85):
    sets = [_shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return [(r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def _sorted(values):
    return sorted(values, key=repr)


def test_near_duplicates_against_all_pairs(docs, rows, none):
    found = minhash.near_duplicates(docs)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()]
    assert _sorted(got) == _sorted(_near(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("setting", [("BUCKET", 2), ("BLOCK_ROWS", 4), ("BLOCK_SHINGLES", 300)])
def test_near_duplicates_with_large_buckets_and_many_blocks(docs, rows, monkeypatch, setting):
    monkeypatch.setattr(minhash, *setting)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()]
    assert _sorted(got) == _sorted(_near(rows))


def test_one_of_each_keeps_one_row_of_a_component(docs, rows):
    kept = minhash.one_of_each(docs, minhash.near_duplicates(docs)).collect()
    groups = defaultdict(list)
    for r, (doc_id, n, component) in zip(rows, _near(rows), strict=True):
        groups[component if n else ("empty", doc_id)].append(r)
    blank = sum(1 for t in rows if not _words(t[1]))
    named = {c for c, g in groups.items() if isinstance(c, int)}
    texts = Counter()
    for r in kept:
        texts[r.doc_id] += 1
    assert len([r for r in kept if not _words(r.text)]) == blank
    assert named <= set(texts)
    assert len([r for r in kept if r.doc_id == 5]) == 3  # three texts of one id, one of them twice


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(20)} | {200: 200, 201: 200}
    assert got == expected
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, g string, b string, vector string"


def test_top_k_against_all_pairs(spark):
    rng = random.Random(21)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(20)]) for i in range(120)]
    rows += [(i, [0.5] * 20) for i in range(200, 260)]  # one very common vector: ties
    rows += [
        (300, None), (301, [None] * 20), (302, [float("nan")] * 20), (303, [float("inf")] * 20), (None, [1.0] * 20),
        (304, []), (305, [0.3]), (0, [0.4] * 20), (50, rows[50][1]), (350, [3e38] * 20), (400, [-3e38] * 20),
    ]
    data = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], VECTORS)
    got = topk.top_k(data, data.filter("vec_id % 50 = 0")).collect()
    real = data.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).collect()
    usable = [(r.vec_id, [math.floor(x * 256) for x in r.v]) for r in real if r.vec_id is not None and r.v is not None
              and all(x is not None and math.isfinite(x) for x in r.v)]
    clamp = lambda s: max(-(2**63), min(s, 2**63 - 1))
    expected = []
    for q, v in usable:
        if q % 50 == 0:
            every = sorted((-clamp(sum(x * y for x, y in zip(v, w, strict=False))), c) for c, w in usable if c != q)[:5]
            expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(every)]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert topk.top_k(data.limit(0), data.limit(0)).count() == 0
    assert topk.top_k(data.filter("vec_id = 0").limit(1), data.filter("vec_id = 0")).count() == 0


def test_scores_against_word_counts(docs, rows, none):
    fold = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 10
    c = F.crc32(F.col("doc_id").cast("string")) % 10
    out = ctw.score(docs, c != 0, c == 0).collect()
    counts, trained = Counter(), 0
    for d, t, *_ in rows:
        if fold(d) not in (None, 0):
            counts.update(_words(t))
            trained += 1
    n, kinds = sum(counts.values()) + trained, len(counts) + 1
    expected = []
    for d, t, *_ in rows:
        each = [counts[w] for w in _words(t)] + [trained]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (kinds + 1))) for x in each)
        expected.append((d, fold(d) == 0, len(each), sum(x > 0 for x in each), n, round(base, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]
    assert _sorted(got) == _sorted(expected)
    assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert ctw.score(none, c != 0, c == 0).count() == 0
    unlearned = ctw.score(docs, F.lit(False), F.lit(None).cast("boolean")).collect()
    assert all(abs(r.score - -8 * math.log10(2) * (len((t or "").encode()) + 1)) < 1e-6 for r, t in
               zip(sorted(unlearned, key=lambda r: r.score), sorted((x[1] for x in rows), key=lambda t: -len((t or "").encode())), strict=True))


def test_equal_texts_score_alike_whatever_the_partitions(docs, spark, tmp_path):
    c = F.crc32(F.col("doc_id").cast("string")) % 10
    path = str(tmp_path / "other.parquet")
    docs.coalesce(1).write.parquet(path)
    one, other = (ctw.score(d, c != 0, c == 0).select("doc_id", F.round("score", 9).alias("s")) for d in (docs, spark.read.parquet(path)))
    assert _sorted(map(tuple, one.collect())) == _sorted(map(tuple, other.collect()))


def test_scores_pass_a_row_for_each_bucket_of_a_partition(docs, spark, monkeypatch):
    staged, write = {}, ctw.stage

    def kept(data, name):
        staged[name] = write(data, name)
        return staged[name]

    monkeypatch.setattr(ctw, "stage", kept)
    c = F.crc32(F.col("doc_id").cast("string")) % 10
    assert ctw.score(docs, c != 0, c == 0).count() == docs.count()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < staged["asked"].count() <= buckets * docs.select(F.spark_partition_id()).distinct().count()


def _targets(sizes, weights, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, rest, free = {}, sum(sizes.values()), list(names)
    while free:
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            rest -= most * sizes[s]
            free.remove(s)
    return target


def test_mix_meets_targets_and_reruns_agree(docs, rows, none, spark, tmp_path):
    mixed = mixing.mix(docs)
    out = mixed.collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(_words(t))
    target = _targets(sizes, (1, 2, 3), 3)
    given, own = Counter(), defaultdict(list)
    source = {(r.doc_id, r.size): r for r in out}
    assert len(out) == len(rows) and source
    by_uid = {r.uid: r for r in out}
    for r in docs.withColumn("u", F.monotonically_increasing_id()).select("u", "source", "text").collect():
        m = by_uid[r.u]
        assert m.size == len(_words(r.text)) and m.source_size == sizes[r.source]
        assert abs(m.target - target[r.source]) < 1e-6 and len(m.drawn) <= 3
        given[r.source] += m.size * len(m.drawn)
        own[r.source].append(m.size)
    for s in sizes:
        smallest = min((x for x in own[s] if x), default=0)
        assert given[s] <= target[s] + 1 and target[s] - given[s] < max(smallest, 0.02 * target[s]) + 1
    path = str(tmp_path / "again.parquet")
    docs.coalesce(1).write.parquet(path)
    again = mixing.mix(spark.read.parquet(path)).collect()
    key = lambda r: (r.doc_id, r.size, sorted((d.round, d.shard, d.place) for d in r.drawn))
    assert _sorted(map(key, out)) == _sorted(map(key, again))
    taken = mixing.take(docs, mixed)
    assert taken.columns == docs.columns and taken.count() == sum(len(r.drawn) for r in out)
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("rest", [450_000, 790_000])
def test_mix_fills_the_room_that_a_long_document_leaves(spark, tmp_path, rest):
    """1000 documents of 500 words and one of 300000 over the cut: passed over, or taken where the others can't fill."""
    h = lambda d, t: F.xxhash64(F.lit(0), d.cast("bigint"), t)
    small, large = F.repeat(F.lit("w "), 500), F.repeat(F.lit("v "), 300_000)
    below = sorted(r[0] for r in spark.range(1000).select(h(F.col("id"), small)).collect())
    at = {r[0]: 500 * bisect.bisect(below, r[1]) for r in spark.range(5000, 5200).select("id", h(F.col("id"), large)).collect()}
    over = next(d for d, start in at.items() if rest - 250_000 < start < rest - 50_000 or start == 500_000 and rest > 750_000)
    other = 1_200_000 - 800_000
    docs = spark.range(1000).select("id", small.alias("text"), F.lit("a").alias("source"))
    docs = docs.union(spark.range(1).select(F.lit(over), large, F.lit("a")))
    docs = docs.union(spark.range(2000, 2000 + other // 500).select("id", small, F.lit("b")))
    docs.withColumnRenamed("id", "doc_id").write.parquet(str(tmp_path / "d"))
    out = mixing.mix(spark.read.parquet(str(tmp_path / "d")), weights=(rest, 1_200_000 - rest)).collect()
    for target in {r.target for r in out}:
        given = sum(r.size * len(r.drawn) for r in out if r.target == target)
        assert 0 <= round(target) - given < 500


def test_mix_leaves_no_room_for_a_document_whatever_the_sizes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "AROUND", 16)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    rng = random.Random(5)
    rows = []
    for s in range(24):
        kind = [(1, 40), (17, 33), (30, 300), (1, 1000), (200, 1000), (5, 17)][s % 6]
        sizes = [rng.randint(*kind) for _ in range(rng.randint(1, 30))]
        rows += [(1000 * s + i, "x " * n, f"s{s:02}") for i, n in enumerate(sizes)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    seen = defaultdict(list)
    for r in mixing.mix(spark.read.parquet(path), weights=tuple(range(1, 8))).collect():
        seen[f"s{r.doc_id // 1000:02}"].append(r)
    assert sum(map(len, seen.values())) == len(rows)
    for group in seen.values():
        room = round(group[0].target) - sum(r.size * len(r.drawn) for r in group)
        fewest = min(len(r.drawn) for r in group)
        assert room >= 0 and max(len(r.drawn) for r in group) <= 3
        assert fewest == 3 or room < min(r.size for r in group if len(r.drawn) == fewest)


def test_mix_deals_shards_evenly(docs, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 3000)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 50)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    out = mixing.mix(docs).collect()
    shards = Counter(d.shard for r in out for d in r.drawn)
    assert len(shards) == max(shards) + 1 > 2


def test_pack_is_gapless_whole_and_close_to_the_bound(docs, rows, none):
    plain, capacity = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 64
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity, keep_ids=True).collect()
    by_doc = defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
    expected = Counter()
    for d, t, *_ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            piece = b"".join(i.to_bytes(4, "little") for i in ids[at : at + capacity])
            expected[(d, k, at, len(piece) // 4, zlib.crc32(piece))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    rooms = []
    for n in sorted((r.length for r in out), reverse=True):
        fit = min((r for r in rooms if r >= n), default=capacity)
        if fit in rooms and fit >= n:
            rooms.remove(fit)
        rooms.append(fit - n)
    assert len(sequences) <= len(rooms)
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


TURNS = "conv_id long, turn long, role string, text string, head string, piece string, number string"


def test_chat_round_trip(spark):
    hard = ["a", None, "", "\\### Assistant: </turn> ok", '\n</turn>\n<turn role="assistant">\nx', "\\", "\\\\<", "é🙂\n", "<", "x" * 50_000]
    rows = [(c, t, "assistant" if t % 2 else "user", hard[(c + t) % len(hard)]) for c in range(10) for t in range(6)]
    rows += [(20, 0, None, "no role"), (20, 1, 'ro"le\\<">\n', "odd"), (21, None, "user", "null turn"), (21, 3, "user", "x"),
             (21, 3, "user", "x"), (None, 0, "assistant", "null id"), (22, 5, "assistant", "b"), (22, 5, "assistant", "a")]
    data = spark.createDataFrame([(*r, "1", "2", "3") for r in rows], TURNS)
    done = chat.format_turns(data.withColumn("parts", chat.text_parts(F.col("text"))))
    out = done.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("mask")).alias("loss"))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    seen = {r.conv_id: r for r in out.collect()}
    assert len(seen) == len({r[0] for r in rows})
    for c, r in seen.items():
        own = sorted((x for x in rows if x[0] == c), key=order)
        assert [tuple(t) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == [x[3] or "" for x in own if x[2] == "assistant"] and r.n_turns == len(own)
        for m, text in zip(r.mask, r.loss, strict=True):
            assert r.formatted[m.start : m.start + m.length] == text.replace("\\", "\\\\").replace("<", "\\<")
    assert chat.format_turns(data.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_chat_parts_become_placeholders(spark):
    schema = f"conv_id long, turn long, role string, parts {chat.PARTS}"
    parts = [("text", "see <this> ", None, None), ("image", None, "i.png", 4), (None, " and ", None, None), ("audio", "x", "a.wav", None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("document", None, None, 2), ("film", None, "f", 9), None]), (1, 2, "user", None)]
    r = chat.format_turns(spark.createDataFrame(rows, schema)).first()
    assert r.formatted == (
        '<turn role="user">\nsee \\<this> <image 0/> and <audio 1/>\n</turn>\n'
        '<turn role="assistant">\n<document 2/><film 3/>\n</turn>\n<turn role="user">\n\n</turn>\n'
    )
    assert [tuple(a) for a in r.attachments] == [
        (0, 0, "image", "i.png", 85 + 4 * 170), (1, 0, "audio", "a.wav", 2 + 25), (2, 1, "document", None, 8 + 2 * 600), (3, 1, "film", "f", 0)
    ]
    assert [r.formatted[m.start : m.start + m.length] for m in r.mask] == ["<document 2/><film 3/>"]


def test_language_by_filters(spark, none):
    rng = random.Random(22)
    syllables = {"xx": ["tor", "ven", "ka", "mil"], "yy": ["schu", "öt", "berg"], "zz": ["oui", "eau", "ché", "ra"]}
    word = lambda lang: "".join(rng.choice(syllables[lang]) for _ in range(3))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randint(3, 60))), lang) for i, lang in enumerate(["xx", "yy", "zz", "xx"] * 100)]
    odd = [(1000, None, "xx"), (1001, "", "yy"), (1002, "12 —€ !", None), (1003, "qqqqqqqq", None), (1004, "Öt", None),
           (None, rows[1][1].upper(), None), (5, rows[1][1], "xx"), (5, rows[1][1], "xx"), (1005, "x" * 200_000, None)]
    data = spark.createDataFrame([(*r, "1", "2") for r in rows + odd], "doc_id long, text string, lang string, score string, lang_pred string")
    filters = langid.fit(data.filter("doc_id % 5 <> 2 and doc_id < 1000"))
    out = langid.identify(data, filters, keep={"doc_id": F.col("doc_id"), "truth": F.col("lang"), "t": F.col("text")}).collect()
    assert len(out) == len(rows) + len(odd)
    for r in out:
        assert 0 <= r.score <= 1
        if r.t is None or not any(c.isalpha() for c in r.t):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 1000 and r.doc_id != 5:
            assert r.lang_pred == r.truth
    one = {r.doc_id: r for r in out}
    assert one[None].lang_pred == one[5].lang_pred == "yy"
    assert one[1003].lang_pred == "xx" and one[1003].score == 0
    again = langid.identify(data.select("doc_id", "text"), filters).collect()
    assert _sorted((r.doc_id, r.lang_pred, r.score) for r in again) == _sorted((r.doc_id, r.lang_pred, r.score) for r in out)
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.identify(data.select("text"), empty).collect()} == {"und"}
    assert langid.identify(none.select("doc_id", "text"), filters).count() == 0


def test_more_languages_than_a_word_has_bits(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}qu{chr(97 + i // 26)}{chr(97 + i % 26)} " * 5, f"l{i:02}") for i in range(70) for _ in range(3)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify(data, langid.fit(data)).collect()
    assert all(r.lang == r.lang_pred for r in out)


def test_wrong_answers_of_filters_are_corrected():
    """A language whose bits are set everywhere gets no votes from them."""
    import pyarrow as pa

    filled = [(s, 0, 1 | (2 if s % 50 == 0 else 0)) for s in range(2**langid.SLOT_BITS)]
    codes, _ = langid.ngrams(pa.array(["abcde"]))
    own = {int(x) for x in langid.slots(codes).ravel()}
    filled = [(s, w, b | 2 if s in own else b) for s, w, b in filled]
    names, score = langid.Filters(["full", "right"], "full", filled).predict(pa.array(["abcde fghij"]))
    assert names == ["right"] and score[0] > 0.5


def test_token_counts_add_up(docs, rows, none):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for rule in tokens.RULES:
        out = tokens.token_counts(docs, ranks, public_tokenizers.PATTERN, rule).collect()
        assert len({r.doc_id for r in out}) == len({d for d, t, *_ in rows if t})
        total, whole = Counter(), defaultdict(set)
        for r in out:
            total[r.doc_id] += r.tokens
            whole[r.doc_id].add(r.doc_tokens)
        once = [d for d, n in Counter(r[0] for r in rows).items() if n == 1 and d in total]
        assert all({total[d]} == whole[d] for d in once)
    assert tokens.token_counts(none, ranks, public_tokenizers.PATTERN).count() == 0


def test_token_counts_of_given_sections(spark):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = "array<struct<name: string, start: long, stop: long>>"
    rows = [(1, "hello world", [("a", 0, 5), ("b", 5, 11), ("all", 0, 99), ("in", 7, 8), ("none", 4, 4), None, ("x", None, 3)]), (2, "é🙂", None), (3, None, [("a", 0, 4)])]
    data = spark.createDataFrame(rows, f"doc_id long, text string, s {kind}")
    out = tokens.token_counts(data, ranks, public_tokenizers.PATTERN, "first", sections="s").collect()
    assert [(r.doc_id, r.name, r.tokens, r.crossing) for r in sorted(out, key=lambda r: (r.doc_id, r.section))] == [
        (1, "a", 1, 0), (1, "b", 1, 0), (1, "all", 2, 0), (1, "in", 0, 1), (1, "none", 0, 1), (3, "a", 0, 0)
    ]
    with pytest.raises(ValueError):
        tokens.token_counts(data, ranks, public_tokenizers.PATTERN, "middle")


def _removed(texts, length):
    windows = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if windows[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        runs = sum(1 for i in range(len(mask)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((len(b), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("memory", [64 << 20, 1])
def test_repeated_passages_against_all_windows(docs, rows, none, monkeypatch, memory):
    monkeypatch.setattr(suffix, "MEMORY", memory)
    for length in (40, 200):
        expected = _removed([(r[1] or "").encode() for r in rows], length)
        marked = suffix.with_spans(docs.drop("spans"), length)
        got = suffix.digests(marked).collect()
        assert _sorted(map(tuple, got)) == _sorted((r[0], *e) for r, e in zip(rows, expected, strict=True))
    assert suffix.digests(suffix.with_spans(none.drop("spans"))).count() == 0


def test_repeated_passages_of_periodic_and_shifted_texts(spark):
    rng = random.Random(23)
    noise = lambda n: "".join(rng.choice("ab") for _ in range(n))
    core = noise(90)
    texts = ["a" * 300, "ab" * 150, "aab" * 80 + noise(30), *(noise(i % 7) + core[i % 5 : 60 + i % 23] + noise(9) for i in range(80)), noise(2000)]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    for length in (20, 50):
        expected = _removed([t.encode() for t in texts], length)
        got = {r.doc_id: tuple(r)[1:] for r in suffix.digests(suffix.with_spans(data, length)).collect()}
        assert [got[i] for i in range(len(texts))] == expected


def test_long_texts_are_cut_into_places(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PLACES", 12)
    monkeypatch.setattr(suffix, "_PLACE", suffix.np.uint64((1 << 12) - 1))
    rng = random.Random(24)
    long = "".join(rng.choice("abcd") for _ in range(9000))
    texts = [long[:6000] + long[1000:3000] + long[6000:], long[3500:5000], "x"]
    batch = suffix.pa.RecordBatch.from_pydict({"text": texts})
    found = suffix.pa.Table.from_batches(list(suffix._runs(iter([batch]), 50, 25))).to_pylist()
    anchors = {}
    for r in found:
        text = next(t for t in texts if len(t) == r["size"])
        for p in range(r["first"], r["first"] + r["windows"]):
            place = r["first"] + r["before"] - p
            assert anchors.setdefault(text[p : p + 50], (place, r["gram"])) == (place, r["gram"])
    assert sum(r["windows"] for r in found) == sum(max(0, len(t) - 49) for t in texts)


def test_cut_texts_stay_text(docs, rows):
    out = suffix.cut(suffix.with_spans(docs.drop("spans"), 40))
    assert out.columns == [c for c in docs.columns if c != "spans"]
    assert all("�" not in (r.text or "") for r in out.collect())


def _jaccard(one, other):
    a, b = Counter((one or "").encode().split()), Counter((other or "").encode().split())
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints_estimate_weighted_similarity(docs, rows, none):
    out = fingerprints.with_edits(docs).collect()
    assert len(out) == len(rows)
    order = sorted({(r[0] if r[0] is not None else -(2**63)) for r in rows})
    single = {d: t for d, t, *_ in rows if sum(r[0] == d for r in rows) == 1}
    errors = []
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in single and (following := order[(order.index(r.doc_id) + 1) % len(order)]) in single:
            text, after = single[r.doc_id] or "", single[following] or ""
            n = len(text) // 4
            edited = text[: len(text) - n] + after[:n]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
            if len(text.split()) > 15:
                errors.append(r.near_edited - _jaccard(text, edited))
            if text == edited:
                assert r.fingerprint == r.edited_fingerprint and r.near_edited == 1
    assert errors and abs(sum(errors) / len(errors)) < 0.05 and max(map(abs, errors)) < 0.35
    texts = {(r[0], len(r[1] or "")): r[1] or "" for r in rows}
    seen = {}
    for r in out:
        text = texts[(r.doc_id, r.n_chars)]
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == "") == (not text.encode().split())
    assert fingerprints.with_edits(none).count() == 0


def test_samples_collide_as_often_as_the_weighted_similarity(spark):
    """Pairs of weighted sets, each of words of its own."""
    rows = []
    for pair in range(200):
        for word in range(60):
            a, b = (3, 1) if word < 20 else (2, 2) if word < 40 else (0, 4)
            rows.append((pair, pair * 1000 + word, a, b))
    data = spark.createDataFrame(rows, "pair long, word long, x long, y long").withColumn("word", F.xxhash64("word"))
    drawn = fingerprints.samples(data, ["pair"], ["x", "y"])
    mean = drawn.select(F.avg(fingerprints.likeness(F.col("x"), F.col("y")))).first()[0]
    assert abs(mean - (20 + 40) / (60 + 40 + 80)) < 0.02
    (alone,) = fingerprints.samples(data.filter("pair = 3"), ["pair"], ["x"]).collect()
    (pair,) = drawn.filter("pair = 3").collect()
    assert alone.x == pair.x


def test_a_single_document_is_its_own_next(spark):
    (r,) = fingerprints.with_edits(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1
