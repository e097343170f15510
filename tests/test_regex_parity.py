"""The Spark expressions give what the plain patterns give under Python's ``re``."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stmtlog.functions import extract as X
from stmtlog.functions import patterns as P
from stmtlog.functions.classify import rule_number
from stmtlog.functions.regex import ASCII, UNICODE, found_sql

SPACES = [" ", "  ", "\n", " \n ", "\n\n", "\t", "\r\n", "\r", "\x1d", " ", "\x85", ""]


def expected_rule(text):
    folded = text.upper().strip()
    for number, (_, _, _, pattern) in enumerate(P.PURPOSE_RULES, 1):
        if re.search(pattern, folded):
            return number
    return 0


def random_texts(words, count, seed, longest=14):
    rng = random.Random(seed)
    out = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(1, longest)):
            parts.append(rng.choice(words))
            parts.append(rng.choice(SPACES) if rng.random() < 0.5 else " ")
        out.append("".join(parts))
    return out


def chain_texts(patterns, per_pattern, seed):
    """Texts near a match: the words of one pattern in order, with noise and line ends."""
    rng = random.Random(seed)
    out = []
    for pattern in patterns:
        for alternative in pattern.split("|"):
            for _ in range(per_pattern):
                text = ""
                for token in alternative.strip("^$").split(".*"):
                    token = re.sub(r"\(?\\w\+\)?", lambda m: rng.choice(["ab", "x1", "É", "½"]), token)
                    token = re.sub(r"\\d\+", lambda m: rng.choice(["1", "42", "٣"]), token)
                    token = re.sub(r"\\s[+*]", lambda m: rng.choice(SPACES), token)
                    token = token.replace("\\", "")
                    if rng.random() < 0.05:
                        continue
                    text += token + rng.choice(["", " ", "\n", " x ", token, " " + token + " ", "NOT IN", " IS\nNULL "])
                text = rng.choice(["", " ", "\n", "x "]) + text + rng.choice(["", " \n", "\x1e"])
                out.append(text if rng.random() < 0.5 else text.lower())
    return out


WORDS = (
    "SELECT COUNT HAVING COUNT > NOT IN NOT IN LEFT JOIN WHERE IS NULL EXISTS WITH RECURSIVE GROUP BY MINUS EXCEPT "
    "DELETE UPDATE SET = ( MERGE INTO WHEN MATCHED INSERT ON CONFLICT USING FROM :id 42 VALUES ROWNUM < LIMIT FETCH "
    "FIRST select where from not in a.b COUNT(*) ROW_NUMBER() OVER PARTITION CASE THEN ELSE END <> UNION ALL AS CONNECT"
).split()


def test_purpose_rules(spark):
    patterns = [r[3] for r in P.PURPOSE_RULES]
    texts = chain_texts(patterns, 60, 1) + random_texts(WORDS, 3000, 2)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in rows.select("i", F.upper("t").alias("u")).select("i", rule_number("u").alias("n")).collect()}
    wrong = [(t, expected_rule(t), got[i]) for i, t in enumerate(texts) if got[i] != expected_rule(t)]
    assert not wrong, wrong[:5]
    assert set(got.values()) >= set(range(20)) - {14}


def test_each_pattern_alone(spark):
    patterns = [r[3] for r in P.PURPOSE_RULES] + [r[1] for r in P.CATEGORY_RULES]
    texts = chain_texts(patterns, 40, 3) + random_texts(WORDS, 1500, 4)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    tests = [F.expr(found_sql("u", p)).alias(f"p{k}") for k, p in enumerate(patterns)]
    got = rows.select("i", F.upper("t").alias("u")).select("i", *tests).collect()
    wrong = []
    hits = [0] * len(patterns)
    for r in got:
        for k, p in enumerate(patterns):
            want = re.search(p, texts[r.i].upper().strip()) is not None
            hits[k] += want
            if r[f"p{k}"] != want:
                wrong.append((p, texts[r.i], want))
    assert not wrong, wrong[:5]
    assert min(hits) > 0


NAMES = "A AB T B.C A.B AB.T T.T.X A.B.C.D 1.5 = JOIN FROM INTO UPDATE SET ( ) , a b.c JOINED xJOIN É.ü INSERT INSERT_INTO t JOIN FROM =".split()


def pull(pattern, text):
    return re.findall(pattern, text, re.IGNORECASE)


def expected_tables(text):
    words = set()
    for word in ["FROM", "JOIN", "INTO", "UPDATE", r"DELETE\s+FROM"]:
        words |= {m.upper() for m in pull(word + r"\s+(\w+)", text)}
    return sorted(words)


@pytest.mark.parametrize("classes", [UNICODE, ASCII])
def test_extraction(spark, classes):
    texts = random_texts(NAMES, 4000, 5, 16) + [
        "insert into t (a, b ,\n c) values (1)", "INSERT INTO t (SELECT a, b FROM x)", "x JOIN ORDERS y JOIN ORD",
        "FROM ORD, x JOIN ORDERS y JOIN ORD", "SELECT 1 FROM orders JOIN part ON 1 = 1",
    ]
    if classes is ASCII:
        texts = [t for t in texts if t.isascii()]
        assert len(texts) > 500
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("u", F.upper("t"))
    u = F.col("u")
    tables = X.statement_tables(u, classes=classes)

    def per_table(f):
        return F.transform(tables, lambda t: F.struct(t.alias("t"), f(u, t, classes).alias("v")))

    got = rows.select(
        "i",
        tables.alias("tables"),
        per_table(X.columns_of_table).alias("columns"),
        per_table(X.related_tables).alias("related"),
        per_table(X.join_columns).alias("joins"),
        X.qualified_columns(u, classes).alias("qualified"),
        X.insert_columns(u, classes).alias("inserted"),
        X.relationship_edges(u, classes).alias("edges"),
    ).collect()
    for r in got:
        text = texts[r.i]
        tables = expected_tables(text)
        assert r.tables == tables, text
        for t, v in r.columns:
            assert sorted(v) == sorted({m.upper() for m in pull(rf"{t}\.(\w+)", text)}), (text, t)
        for t, v in r.related:
            want = {g.upper() for m in pull(rf"{t}\s+\w*\s*JOIN\s+(\w+)|(\w+)\s+\w*\s*JOIN\s+{t}", text) for g in m if g}
            assert sorted(v) == sorted(want), (text, t)
        for t, v in r.joins:
            want = [g.upper() for m in pull(rf"{t}\.(\w+)\s*=\s*\w+\.\w+|\w+\.\w+\s*=\s*{t}\.(\w+)", text) for g in m if g]
            assert sorted(v) == sorted(want), (text, t)
        assert {tuple(x) for x in r.qualified} == {(a.upper(), b.upper()) for a, b in pull(r"(\w+)\.(\w+)", text)}, text
        want = {
            (t.upper(), c.strip().upper())
            for t, cs in pull(r"INSERT\s+INTO\s+(\w+)\s*\(([^)]+)\)", text) for c in cs.split(",")
        }
        assert {tuple(x) for x in r.inserted} == want, text
        want = set()
        for a, b, c, d in pull(r"(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)", text):
            a, b, c, d = a.upper(), b.upper(), c.upper(), d.upper()
            if a != c:
                want |= {(a, b, c, d), (c, d, a, b)}
        assert {tuple(x) for x in r.edges or []} == want, text


DENSE = ["ORD", "SUBORD", "ORDJOIN", "JOIN", "LEFTJOIN", "x", "ORDORD", "é", "1"]


@pytest.mark.parametrize("glue", [[" ", " ", "\n", ".", ", "], [".", ".", " = ", "=", " "]])
def test_names_of_one_table_in_dense_texts(spark, glue):
    """Chains, equations and joins that overlap, so that what a match uses up decides the next."""
    rng = random.Random(len(glue[0]) + ord(glue[3][0]))
    texts = []
    for _ in range(6000):
        texts.append("".join(rng.choice(DENSE) + rng.choice(glue) for _ in range(rng.randint(2, 12))))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("u", F.upper("t"))
    u, tables = F.col("u"), ["ORD", "ORDJOIN", "JOIN", "X"]
    reads = [f(u, F.lit(t)) for t in tables for f in (X.columns_of_table, X.related_tables, X.join_columns)]
    got = rows.select("i", F.array(*[F.array_sort(r) for r in reads]).alias("v")).collect()
    for r in got:
        text, want = texts[r.i].upper(), []
        for t in tables:
            related = re.findall(rf"{t}\s+\w*\s*JOIN\s+(\w+)|(\w+)\s+\w*\s*JOIN\s+{t}", text)
            joined = re.findall(rf"{t}\.(\w+)\s*=\s*\w+\.\w+|\w+\.\w+\s*=\s*{t}\.(\w+)", text)
            want += [
                sorted(set(re.findall(rf"{t}\.(\w+)", text))), sorted({g for m in related for g in m if g}),
                sorted(g for m in joined for g in m if g),
            ]
        assert r.v == want, text


def test_long_texts_stay_linear(spark):
    """Texts on which the plain patterns backtrack for hours."""
    blob = "SELECT 1 FROM t WHERE c = '" + "abcdef0123" * 30000 + "'"
    texts = [
        "SELECT COUNT(*) FROM t UNION ALL " * 4000,
        "SELECT COUNT HAVING " * 4000,
        "SELECT LEFT JOIN x WHERE " * 4000,
        "UPDATE SET = ( " * 4000,
        "x" + " " * 50000 + "JOIN",
        blob,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("u", F.upper("t"))
    u = F.col("u")
    started = time.time()
    rows.select(
        rule_number("u"),
        X.statement_tables(u),
        F.transform(X.statement_tables(u), lambda t: F.struct(X.columns_of_table(u, t), X.related_tables(u, t), X.join_columns(u, t))),
        X.schema_columns(u),
        X.relationship_edges(u),
        X.real_table_names(u),
    ).collect()
    assert time.time() - started < 60
