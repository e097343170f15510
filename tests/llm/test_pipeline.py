"""The pipeline against its stages' own rules, on a small table with odd rows."""

import math
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, row string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(30)
    words = {"en": [f"th{a}{b}ing" for a in "aeiou" for b in "rstln"], "fr": [f"{a}eau{b}é" for a in "bcdlm" for b in "rstln"]}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice("xyzqwv") for _ in range(n))
    passage = prose("en", 60)
    rows = [(i, prose(lang, rng.randint(20, 90)), lang, f"s{i % 4}") for i, lang in enumerate(["en", "fr"] * 30)]
    rows += [(100 + i, rows[0][1], "en", "s0") for i in range(5)]
    rows += [(110 + i, rows[2][1] + " more", None, "s1") for i in range(3)]
    rows += [(120 + i, prose("en", 12) + " " + passage + " " + prose("en", 12), "en", None) for i in range(4)]
    rows += [(130, None, "en", "s0"), (131, "", None, None), (132, "123 456 !!", "fr", "s2"), (None, prose("fr", 40), "fr", "s2")]
    path = tmp_path_factory.mktemp("pipeline")
    data = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "1", "2", "3") for r in rows], DOCS)
    data.repartition(2).write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_each_stage_does_its_work(spark, folder, tmp_path):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, function in P.STAGES:
        function(spark, docs, path).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == list(P.COLUMNS)
    language = {r.doc_id: r for r in kept["language"].collect()}
    assert set(language) == {r[0] for r in rows} - {130, 131, 132} and language[110].lang == "en"
    near = sorted((r.doc_id for r in kept["near_duplicates"].collect()), key=str)
    assert near == sorted((d for d in language if d not in {100, 101, 102, 103, 104, 110, 111, 112}), key=str)
    passages = kept["repeated_passages"].collect()
    assert sorted((r.doc_id for r in passages), key=str) == near
    before = {r[0]: r[1] for r in rows}
    for r in passages:
        assert r.n_chars == len(r.text)
        assert (len(r.text) < 300) if r.doc_id in {120, 121, 122, 123} else r.text == before[r.doc_id]
    text = {r.doc_id: r.text for r in passages}
    mixed = kept["mixture"].collect()
    assert all(r.text == text[r.doc_id] for r in mixed) and max(Counter(r.doc_id for r in mixed).values()) <= 3
    whole, given = (sum(len(r.text.split()) for r in x) for x in (passages, mixed))
    assert abs(given / whole - 1) < 0.05
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = kept["packing"].collect()
    expected = Counter((r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed)
    assert Counter((r.doc_id, r.length) for r in pieces) == expected
    used = defaultdict(int)
    for r in pieces:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= P.CAPACITY and len(used) <= math.ceil(sum(used.values()) / P.CAPACITY) + 1


def test_run_equals_the_stages_and_bears_an_empty_table(spark, folder, tmp_path):
    path, _ = folder
    assert P.run(spark, path).count() == P.run(spark, path).select("doc_id", "piece", "sequence_id", "offset").distinct().count()
    spark.read.parquet(f"{path}/documents.parquet").filter(F.lit(False)).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("step", [P.drop_near_duplicates, P.mix_sources])
def test_rows_are_matched_though_the_input_is_cut_anew_between_two_scans(spark, folder, tmp_path, step):
    """As with executors lost or gained in between: more partitions at the second scan."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").filter("doc_id is not null")
    docs.repartitionByRange(12, "doc_id").write.parquet(str(tmp_path / "d.parquet"))
    docs = spark.read.parquet(str(tmp_path / "d.parquet"))
    key = lambda r: (r.doc_id, r.text, r.lang, r.source)
    expected = Counter(map(key, step(spark, docs, "").collect()))
    keep = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    try:
        for conf in keep:
            spark.conf.set(conf, "64m")
        pending = step(spark, docs, "")
        for conf in keep:
            spark.conf.set(conf, "2k")
        assert Counter(map(key, pending.collect())) == expected
    finally:
        for conf in keep:
            spark.conf.unset(conf)


def test_texts_without_known_ngrams_stay(spark, tmp_path):
    rows = [(i, f"the thing number {i} is here again", "en", "s", 1) for i in range(20)]
    rows += [(20, "A.", "en", "s", 2), (21, "A.", None, "s", 2), (22, "καλημέρα κόσμε", "el", "s", 14), (23, "日本語", None, "s", 3)]
    rows += [(24, "12 .", "en", "s", 4), (25, None, "en", "s", None), (26, "the thing is here", None, "s", 17)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    out = {r.doc_id: r.lang for r in P.identify_language(spark, spark.read.parquet(path), "").collect()}
    assert out == {i: "en" for i in range(20)} | {20: "en", 21: None, 22: "el", 23: None, 26: "en"}
