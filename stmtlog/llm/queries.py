"""The registered queries: each operator over its whole table, with its production parameters, as digests."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stmtlog.llm import (
    chat, cluster, ctw, divergence, fingerprints, langid, minhash, mixing, packing, relative, suffix, tokens, topk, trie,
)
from stmtlog.plans.stage import stage


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    cluster.ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256)


OP1_SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
        CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
FROM scored
QUALIFY rank <= 5
"""


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, folder, "documents")).drop("row", "component")


#: Brute force on all pairs that share a shingle.
OP2_SQL = r"""
WITH RECURSIVE word AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'),
        lambda x: x <> '') AS w
    FROM documents
), listed AS (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s
    FROM word
), shingle AS (SELECT DISTINCT doc_id, s FROM listed
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), pair AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
    SELECT a, b FROM pair JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id
    WHERE 100 * pair.n >= 85 * (x.n + y.n - pair.n)
), reach(a, b) AS (
    SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id,
    d.doc_id = least(d.doc_id, coalesce(least.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN size ON d.doc_id = size.doc_id LEFT JOIN least ON d.doc_id = least.a
"""


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    fold = _remainder(10)
    return ctw.score(_table(spark, folder, "documents"), train=fold != 0, held_out=fold == 0)


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, folder, "documents"), weights=(1, 2, 3), most=3)
    taken = F.col("size") * F.size("drawn")
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    documents = _table(spark, folder, "documents")
    return packing.pack(documents, tokenizer, capacity=2048, remembered=1_000_000, slice_bytes=4 << 20, forget=False)


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    added = spark.range(1).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.explode(F.array(*(F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text"))
            for i, r in enumerate(("user", "assistant"))))).alias("x"),
    )
    rows = rows.unionByName(added.select("conv_id", "x.*"))
    done = chat.format_turns(rows.withColumn("parts", chat.text_parts(F.col("text"))))
    read = done.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat.masked_texts(F.col("formatted"), F.col("mask")), "").alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH every AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), one AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(24 + length(regexp_replace(role, '([\\<"])', '\\\1', 'g'))
            + length(regexp_replace(text, '([\\<])', '\\\1', 'g'))) AS formatted_chars
    FROM every GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM one
"""


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    filters = langid.fit(documents.filter(_remainder(4) != 2))
    keep = {"doc_id": F.col("doc_id"), "held_out": F.coalesce(_remainder(4) == 2, F.lit(False))}
    return langid.identify(documents, filters, keep=keep)


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return tokens.token_counts(_table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN, rule="most").drop("name")


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return suffix.digests(suffix.with_spans(documents, length=200))


OP9_SQL = """
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), place AS (
    SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM doc
), coded AS (SELECT r, p, md5_number(substr(h, 2 * p + 1, 400)) AS w FROM place
), again AS (SELECT w FROM coded GROUP BY w HAVING count(*) > 1
), hit AS (SELECT r, p FROM coded WHERE w IN (SELECT w FROM again)
), edge AS (SELECT r, p, CASE WHEN p > 200 + lag(p) OVER (PARTITION BY r ORDER BY p) THEN 1 ELSE 0 END AS gap FROM hit
), numbered AS (SELECT r, p, sum(gap) OVER (PARTITION BY r ORDER BY p) AS span FROM edge
), span AS (SELECT r, min(p) AS low, max(p) + 200 AS high FROM numbered GROUP BY r, span
), before AS (
    SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS done FROM span
), cut AS (
    SELECT r, doc.doc_id, any_value(h) AS h, count(*) AS n, sum(high - low) AS removed, max(high) AS last,
        string_agg(substr(h, 2 * done + 1, 2 * (low - done)), '' ORDER BY low) AS kept
    FROM before JOIN doc USING (r) GROUP BY r, doc.doc_id
)
SELECT doc.doc_id, CAST(len(doc.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
    coalesce(n, 0) AS n_spans,
    sha256(unhex(CASE WHEN n IS NULL THEN doc.h ELSE kept || substr(doc.h, 2 * last + 1) END)) AS kept_sha256
FROM doc LEFT JOIN cut USING (r)
"""


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_edits(_table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    placed = trie.places(_table(spark, folder, "conversations"))
    return trie.prefix_trie(trie.with_heads(stage(placed, "places")))


#: crc32 by its table; nodes are prefixes of digests.
OP11_SQL = r"""
WITH bit AS (
    SELECT list_transform(range(0, 256), lambda x: list_reduce(list_concat([x], range(0, 8)),
            lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), turned AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS p, key, words
    FROM (
        SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
            len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL
    )
), own AS (
    SELECT c, list(struct_pack(k := key, w := words) ORDER BY p) AS turns FROM turned GROUP BY c
), headed AS (
    SELECT c, turns, c - c % 20 AS b, xor(4294967295, list_reduce(
        list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) % 4 AS h
    FROM own, bit
), built AS (
    SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS l FROM headed a LEFT JOIN own b ON b.c = a.b
), prefix AS (
    SELECT c, len(l) AS size, d, md5(array_to_string(list_transform(l[1:d], lambda x: x.k), ',')) AS node,
        CASE WHEN d > 0 THEN md5(array_to_string(list_transform(l[1:d - 1], lambda x: x.k), ',')) END AS parent,
        CASE WHEN d > 0 THEN l[d].w ELSE 0 END AS w
    FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM built)
), node AS (
    SELECT node, d, any_value(parent) AS parent, any_value(w) AS w, min(c) AS c, count(*) AS n,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), '')) AS ends
    FROM prefix GROUP BY node, d
), child AS (SELECT parent, d - 1 AS d, count(*) AS children FROM node GROUP BY parent, d
), each AS (
    SELECT n.*, coalesce(children, 0) AS children FROM node n LEFT JOIN child ON child.parent = n.node AND child.d = n.d
), below AS (
    SELECT p.node, p.d, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * e.w) AS saved
    FROM each e JOIN prefix p ON p.c = e.c AND p.d <= e.d GROUP BY p.node, p.d
)
SELECT e.c AS conv_id, e.d AS depth, p.c AS parent_conv_id, e.n AS n_convs, e.children AS n_children,
    CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, e.ends AS ends_sha256
FROM each e JOIN below USING (node, d) LEFT JOIN node p ON p.node = e.parent AND p.d = e.d - 1
"""


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"), least_docs=30, most_terms=50)


OP12_SQL = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), hit AS (SELECT r, lang, source, unnest(w) AS term FROM doc
), kept AS (SELECT lang, term FROM hit GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), kinds AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), grp AS (SELECT DISTINCT lang, source FROM doc
), counted AS (SELECT lang, source, term, count(*) AS n FROM hit JOIN kept USING (lang, term) GROUP BY lang, source, term
), cell AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
    FROM grp g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), own AS (
    SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5))
        // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS BIGINT) AS p
    FROM cell JOIN kinds USING (lang)
), total AS (SELECT lang, term, sum(n) AS n FROM cell GROUP BY lang, term
), whole AS (
    SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5))
        // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS BIGINT) AS q
    FROM total JOIN kinds USING (lang)
), apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM own a JOIN own b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source
), pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM grp a JOIN grp b USING (lang) LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    WHERE a.source <> b.source
), term AS (
    SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
    CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 50
"""


def op13_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return relative.digests(_table(spark, folder, "documents"), window=35)


OP13_SQL = r"""
WITH doc AS (
    SELECT row_number() OVER () AS r, doc_id,
        list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), place AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM doc
), coded AS (SELECT r, p, md5_number(array_to_string(w[p:p + 34], ' ')) AS c FROM place
), again AS (SELECT c FROM coded GROUP BY c HAVING count(*) > 1
), hit AS (SELECT r, p FROM coded WHERE c IN (SELECT c FROM again)
), edge AS (SELECT r, p, CASE WHEN p > 35 + lag(p) OVER (PARTITION BY r ORDER BY p) THEN 1 ELSE 0 END AS gap FROM hit
), numbered AS (SELECT r, p, sum(gap) OVER (PARTITION BY r ORDER BY p) AS span FROM edge
), span AS (SELECT r, min(p) AS low, max(p) + 35 AS high FROM numbered GROUP BY r, span
), before AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 1) AS done FROM span
), cut AS (
    SELECT r, sum(high - low) AS removed, max(high) AS last, flatten(list(w[done:low - 1] ORDER BY low)) AS kept
    FROM before JOIN doc USING (r) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(array_to_string(CASE WHEN removed IS NULL THEN w ELSE list_concat(kept, w[last:]) END, ' '), '')) AS kept_sha256
FROM doc LEFT JOIN cut USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": op1_top_k,
        "op2_near_duplicates": op2_near_duplicates,
        "op3_lm_score": op3_lm_score,
        "op4_mixing": op4_mixing,
        "op5_packing": op5_packing,
        "op6_chat_format": op6_chat_format,
        "op7_language": op7_language,
        "op8_token_counts": op8_token_counts,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_fingerprints": op10_fingerprints,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_divergence": op12_divergence,
        "op13_substring_dedup": op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k": OP1_SQL,
        "op2_near_duplicates": OP2_SQL,
        "op6_chat_format": OP6_SQL,
        "op9_suffix_dedup": OP9_SQL,
        "op11_prefix_trie": OP11_SQL,
        "op12_divergence": OP12_SQL,
        "op13_substring_dedup": OP13_SQL,
    }
