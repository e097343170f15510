"""The registered queries: all run, and equal their DuckDB SQL where they have one."""

import duckdb
import pytest

import __spark_entry__ as entry
from stmtlog.llm import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "labels", "conversations", "pages")
CONTRACT = {
    "op1_top_k": "query_id long, rank int, vec_id long, score long",
    "op2_near_duplicates": "doc_id long, n_shingles long, component_id long, kept boolean",
    "op3_lm_score": "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    "op4_mixing": "doc_id long, size long, source_size long, target double, taken long",
    "op5_packing": "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    "op6_chat_format": "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    "op7_language": "doc_id long, held_out boolean, lang_pred string, score double",
    "op8_token_counts": "doc_id long, section int, tokens long",
    "op9_suffix_dedup": "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
    "op10_fingerprints": "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op11_prefix_trie": "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string",
    "op12_divergence": "lang string, source string, part string, item string, value long, rank int",
    "op13_substring_dedup": "doc_id long, n_words long, n_removed long, kept_sha256 string",
}


def test_all_are_registered():
    assert set(CONTRACT) == set(Q.queries()) and set(Q.queries()) | {"pipeline"} <= set(entry.queries())
    assert set(Q.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", CONTRACT)
def test_columns_and_rows(spark, name):
    out = Q.queries()[name](spark, SF)
    kinds = dict(out.dtypes)
    for column in CONTRACT[name].split(", "):
        c, kind = column.split()
        assert kinds[c] == kind.replace("long", "bigint")
    rows = out.collect()
    if name not in ("op1_top_k", "op5_packing", "op6_chat_format", "op8_token_counts", "op11_prefix_trie", "op12_divergence"):
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", Q.oracle_sql())
def test_equal_to_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = duck.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    out = Q.queries()[name](spark, SF)
    assert sorted(out.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, out.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_native_queries_run_no_python(spark):
    for name in ("op6_chat_format", "op10_fingerprints"):
        plan = Q.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = Q.op7_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out and lang is not null")
    assert found.filter("lang = lang_pred").count() >= 0.98 * found.count() > 0
