"""The walk over tokens against a plain one, character by character."""

import random
import time

import pytest
from pyspark.sql import functions as F

from stmtlog.functions import patterns as P
from stmtlog.functions import tokens as T
from stmtlog.functions.regex import ASCII, UNICODE
from stmtlog.operators import facts as K
from stmtlog.operators import labels, schema

from helpers import make_log, at  # noqa: I001


def _lex(text):
    out, i = [], 0
    word = lambda c: c == "_" or c.isalnum()

    def part(i):
        if i < len(text) and text[i] in "\"`":
            end = text.find(text[i], i + 1)
            return len(text) if end < 0 else end + 1
        while i < len(text) and word(text[i]):
            i += 1
        return i

    while i < len(text):
        c, j = text[i], i
        if c.isspace():
            i += 1
        elif c == "'":
            end = text.find("'", i + 1)
            i = len(text) if end < 0 else end + 1
            out.append(text[j:i])
        elif text.startswith("--", i):
            end = text.find("\n", i)
            i = len(text) if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
        elif part(i) > i:
            parts = [text[i : part(i)]]
            i = part(i)
            while True:
                k = i
                while k < len(text) and text[k].isspace():
                    k += 1
                if k == len(text) or text[k] != ".":
                    break
                k += 1
                while k < len(text) and text[k].isspace():
                    k += 1
                if part(k) == k:
                    break
                parts.append(text[k : part(k)])
                i = part(k)
            out.append(tuple(parts))
        else:
            out.append(c)
            i += 1
    return out


def _unquoted(name):
    if name[0] not in "\"`":
        return name
    return name[1:].removesuffix(name[0])


def plain_walk(text):
    depth, want, listing, names, operation = 0, False, False, [], None
    for token in _lex(text):
        one = token[0] if isinstance(token, tuple) and len(token) == 1 else token
        if token == "(":
            want = want and depth > 0
            depth += 1
        elif token == ")":
            depth = max(0, depth - 1)
        elif depth == 0:
            if operation is None and one in P.OPERATIONS:
                operation = one
            if one in P.REAL_NAME_KEYWORDS:
                want = True
            elif token == ",":
                want = listing
            elif one in P.PASSED_OVER:
                pass
            else:
                if want and isinstance(token, tuple) and one not in P.LIST_ENDS and not token[0][0].isdecimal():
                    names.append(_unquoted(token[-1]))
                    listing = True
                if one in P.LIST_ENDS or token == ";":
                    listing = False
                want = False
    return sorted({n for n in names if n}), operation or "OTHER"


def _read(spark, texts, classes=UNICODE):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    walked = T.walk(F.col("t"), classes)
    got = rows.select("i", F.array_sort(walked["tables"]).alias("tables"), walked["operation"].alias("operation")).collect()
    return {r.i: (r.tables, r.operation) for r in got}


def test_statements(spark):
    cases = {
        "SELECT A FROM OWN.T1 X, T2 Y JOIN T3 ON F(X.A, 1) = Y.B, T4 WHERE X.C IN (SELECT 1 FROM HIDDEN)": (["T1", "T2", "T3", "T4"], "SELECT"),
        "SELECT ' FROM S ', \"FROM\" FROM /* FROM C */ T -- FROM D\n, U": (["T", "U"], "SELECT"),
        "SELECT EXTRACT(YEAR FROM D) FROM ORDERS": (["ORDERS"], "SELECT"),
        "WITH C AS (SELECT 1 FROM INNER_T) DELETE FROM ONLY `a b`.\"C D\" USING X": (["C D"], "DELETE"),
        "UPDATE SET A = 1": ([], "UPDATE"),
        "MERGE INTO T USING S ON (A = B) WHEN MATCHED THEN UPDATE SET A = 1": (["T"], "MERGE"),
        "CREATE TABLE IF NOT EXISTS NEW . T (A INT)": (["T"], "OTHER"),
        "SELECT 1 FROM (SELECT 2 FROM U) V": ([], "SELECT"),
        "SELECT 'OPEN FROM T": ([], "SELECT"),
        "INSERT INTO T (A, B) SELECT C, D FROM U; UPDATE W SET X = 1, Y = 2": (["T", "U", "W"], "INSERT"),
        "SELECT 1 FROM :P, T": ([], "SELECT"),
        "": ([], "OTHER"),
    }
    got = _read(spark, list(cases))
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert [plain_walk(t) for t in cases] == list(cases.values())


WORDS = [
    "FROM", "FROM", "JOIN", "INTO", "UPDATE", "TABLE", "SELECT", "DELETE", "MERGE", "WHERE", "SET", "ONLY", "IF", "NOT", "EXISTS",
    "T1", "OWN", "É", "1", "1.5", "'", "'FROM T9'", "\"", "\"Q U\"", "`", "--", "/*", "*/", "*", "/", "-", "(", "(", ")", ")", ",", ",",
    ".", ".", ";", "=", ":P", "X.Y", "\n", "AS", "ON", "OF", "'' FROM", "\\", "🙂",
]


@pytest.mark.parametrize("classes", [UNICODE, ASCII])
def test_random_texts_equal_a_plain_walk(spark, classes):
    rng = random.Random(8)
    texts = []
    for _ in range(12000):
        parts = [rng.choice(WORDS) + rng.choice([" ", " ", "", "\n", "\t"]) for _ in range(rng.randint(1, 16))]
        texts.append("".join(parts))
    if classes is ASCII:
        texts = [t for t in texts if t.isascii()]
    got = _read(spark, texts, classes)
    for i, text in enumerate(texts):
        assert got[i] == plain_walk(text), text
    assert sum(bool(plain_walk(t)[0]) for t in texts) > 800


def test_long_texts(spark):
    long = ["'" * 60001, "(" * 60000, "/*" + "*" * 60000, "FROM " + "a." * 30000, "x" * 200000, "FROM t, " * 5000, '"' * 60001]
    started = time.time()
    got = _read(spark, [t.upper() for t in long])
    assert time.time() - started < 60
    assert got[5][0] == ["T"] and got[1][0] == []


def test_null_text(spark):
    row = spark.createDataFrame([(None,)], "t string").select(T.table_names(F.col("t")).alias("n")).first()
    assert row.n is None


def test_facts_by_tokens(spark):
    log = make_log(spark, [
        ("a", "select * from t1 where x = ' from t2 '", "S", at()), ("b", "select * from t1, own.t3 -- from t4", "S", at(1)),
        ("c", "with w as (select 1 from t5) update t1 set a = 1", "S", at(2)), ("d", None, "S", at(3)),
    ])
    facts = K.statement_facts(labels.label_statements(log), K.SCHEMA_KINDS, names="tokens")
    usage = {(r.table_name, r.usage_count) for r in schema.table_usage(facts).collect()}
    assert usage == {("T1", 3), ("T3", 1)}
    kinds = {(r.table_name, r.operation_type, r.n) for r in schema.table_operations(facts, by="operation").collect()}
    assert kinds == {("T1", "SELECT", 2), ("T3", "SELECT", 1), ("T1", "UPDATE", 1)}
