"""Tables, columns and relationships read from statement text, as column expressions.

All functions take the *upper-cased* text, and character classes that hold for it.  Possessive
quantifiers, and a start only where a word starts, keep the scans linear on long unbroken words
(hex or base64 literals); the matches are those of the plain patterns named in each function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stmtlog.functions import patterns as P
from stmtlog.functions.regex import UNICODE, Classes

_NO_STRINGS = "array<string>"


def _all(text: Column, regex: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(regex), F.lit(group))


def _equals(classes: Classes) -> str:
    return f"{classes.space}*+={classes.space}*+"


def _empty() -> Column:
    return F.array().cast(_NO_STRINGS)


def statement_tables(upper: Column, strict: bool = False, classes: Classes = UNICODE) -> Column:
    r"""Sorted distinct words after FROM, JOIN, INTO and UPDATE (``FROM\s+(\w+)`` and so on).

    A search for DELETE FROM would add nothing: its FROM is always found by the first search.
    By default neither the keyword nor the name has to stand alone, so ``UPDATE SET`` gives
    SET and ``EXTRACT(YEAR FROM d)`` gives D.  ``strict`` asks for whole keywords and leaves
    out words that cannot name a table.

    (``array_sort`` and not ``sort_array``: it keeps the projection out of whole-stage code, where
    all of it would be one method, too long for the JVM to compile.)
    """
    start = classes.word_start if strict else ""
    per_keyword = [
        F.when(
            F.contains(upper, F.lit(word)),
            _all(upper, rf"(?d){start}{word}{classes.space}++({classes.word}++)", 1),
        ).otherwise(_empty())
        for word in P.TABLE_KEYWORDS
    ]
    tables = F.array_sort(F.array_distinct(F.concat(*per_keyword)))
    if strict:
        tables = F.array_except(tables, F.array(*[F.lit(w) for w in P.NOT_A_TABLE]))
    return F.coalesce(tables, _empty())


def operation(upper: Column) -> Column:
    """SELECT, INSERT, UPDATE, DELETE or MERGE by the first word's prefix, else OTHER."""
    head = F.regexp_extract(upper, rf"\A{UNICODE.space}*+([A-Z]{{5,6}})", 1)
    chain = None
    for word in P.OPERATIONS:
        test = head.startswith(word)
        chain = F.when(test, word) if chain is None else chain.when(test, word)
    return chain.otherwise("OTHER")


# Tables' columns and partners come from three scans with fixed patterns; what belongs to one table is then found by
# comparing names.  The comparisons take the words in the order, and use them up, as a scan for that table would.


def dotted_chains(upper: Column, classes: Classes = UNICODE) -> Column:
    """The names joined by dots as arrays of their parts: ``two`` of two parts, ``more`` of more."""
    chains = _all(upper, rf"{classes.word_start}{classes.word}++(?:\.{classes.word}++)++", 0)
    return _once(F.transform(F.array_distinct(chains), lambda c: F.split(c, r"\.")), F.contains(upper, F.lit(".")), 2)


def equations(upper: Column, classes: Classes = UNICODE) -> Column:
    """Names joined by dots with equality signs between them, as arrays of arrays of parts: ``two`` of four names, ``more``."""
    chain = rf"{classes.word}++(?:\.{classes.word}++)*+"
    equals = _equals(classes)
    found = _all(upper, rf"{classes.word_start}{chain}(?:{equals}{chain})++", 0)
    parted = F.transform(
        F.filter(found, lambda e: F.contains(e, F.lit("."))),
        lambda e: F.transform(F.split(e, equals.replace("*+", "*")), lambda c: F.split(c, r"\.")),
    )
    return _once(parted, F.contains(upper, F.lit("=")) & F.contains(upper, F.lit(".")), 2, 2)


def _once(items: Column, wanted: Column, *sizes: int) -> Column:
    """struct(two, more): the items of the usual sizes and the others, looked at once for all tables."""

    def usual(item):
        test = F.size(item) == sizes[0]
        return test if len(sizes) == 1 else test & (F.size(item[0]) == sizes[1]) & (F.size(item[1]) == sizes[1])

    split = F.transform(
        F.array(items), lambda i: F.struct(F.filter(i, usual).alias("two"), F.filter(i, lambda x: ~usual(x)).alias("more"))
    )
    return F.when(wanted, split[0])


def join_sites(upper: Column, classes: Classes = UNICODE) -> Column:
    """For each stretch of words with nothing but white space between them: the words that a JOIN follows, directly or after
    one more word, as struct(i, word, far, near, joined, at); i: number of the word, far and near: the word behind the JOIN,
    joined: the one of them that counts for the word itself, at: its number."""
    word, space = classes.word, classes.space
    phrases = F.filter(
        _all(upper, rf"{classes.word_start}{word}++(?:{space}++{word}++)++", 0), lambda p: F.contains(p, F.lit("JOIN"))
    )

    def sites(words):
        each = F.transform(
            words,
            lambda w, i: F.struct(
                i.alias("i"), w.alias("word"),
                F.when(F.get(words, i + 2) == "JOIN", F.get(words, i + 3)).alias("far"),
                F.when(F.endswith(F.get(words, i + 1), F.lit("JOIN")), F.get(words, i + 2)).alias("near"),
            ),
        )
        return F.transform(
            F.filter(each, lambda s: s["far"].isNotNull() | s["near"].isNotNull()),
            lambda s: F.struct(
                s["i"].alias("i"), s["word"].alias("word"), s["far"].alias("far"), s["near"].alias("near"),
                F.coalesce(s["far"], s["near"]).alias("joined"),
                F.when(s["far"].isNotNull(), s["i"] + 3).otherwise(s["i"] + 2).alias("at"),
            ),
        )

    found = F.transform(F.transform(phrases, lambda p: F.split(p, f"{space}+")), sites)
    return F.when(F.contains(upper, F.lit("JOIN")), found)


def _folded(items: Column, merge, result: str, **state: Column) -> Column:
    first = F.struct(*[v.alias(k) for k, v in state.items()])
    return F.aggregate(items, first, merge, lambda acc: acc[result])


def _each(items: Column, read) -> Column:
    return F.coalesce(F.flatten(F.transform(items, read)), _empty())


def columns_in(chains: Column, table: Column) -> Column:
    r"""Distinct words after ``TABLE.`` (``TABLE\.(\w+)``); any word ending in TABLE counts."""

    def merge(acc, part):
        after = acc["after"]
        return F.struct(
            (~after & F.endswith(part, table)).alias("after"),
            F.when(after, F.array_append(acc["found"], part)).otherwise(acc["found"]).alias("found"),
        )

    two = F.transform(F.filter(chains["two"], lambda c: F.endswith(c[0], table)), lambda c: c[1])
    more = _each(chains["more"], lambda c: _folded(c, merge, "found", after=F.lit(False), found=_empty()))
    return F.array_distinct(F.coalesce(F.concat(two, more), _empty()))


def join_columns_in(equations: Column, table: Column) -> Column:
    r"""Columns of one table on either side of an equality, duplicates kept.

    ``T\.(\w+)\s*=\s*\w+\.\w+|\w+\.\w+\s*=\s*T\.(\w+)``
    """

    def column_of(owner, column, right):
        return F.when(owner == table, column).when(right[0] == table, right[1]).when(F.endswith(owner, table), column)

    def merge(acc, right):
        left = acc["left"]
        whole = acc["free"] & (F.size(left) > 1) & (F.size(right) > 1)
        column = F.when(whole, column_of(F.element_at(left, -2), F.element_at(left, -1), right))
        return F.struct(
            right.alias("left"),
            # a match uses up the first two parts of its right side
            (column.isNull() | (F.size(right) > 3)).alias("free"),
            F.when(column.isNotNull(), F.array_append(acc["found"], column)).otherwise(acc["found"]).alias("found"),
        )

    none = F.array(F.lit("")).cast(_NO_STRINGS)
    two = F.filter(F.transform(equations["two"], lambda e: column_of(e[0][0], e[0][1], e[1])), lambda c: c.isNotNull())
    more = _each(equations["more"], lambda e: _folded(e, merge, "found", left=none, free=F.lit(False), found=_empty()))
    return F.coalesce(F.concat(two, more), _empty())


def related_in(sites: Column, table: Column) -> Column:
    r"""Distinct tables joined to one table.

    ``T\s+\w*\s*JOIN\s+(\w+)|(\w+)\s+\w*\s*JOIN\s+T``: one optional word between table and JOIN, aliases included.
    """

    def merge(acc, site):
        i = site["i"]
        word = F.when((i == acc["next"]) & acc["rest"].isNotNull(), acc["rest"]).otherwise(site["word"])

        def state(following, rest, found):
            return F.struct(following.alias("next"), rest.alias("rest"), F.array_append(acc["found"], found).alias("found"))

        def after(name):
            return F.substring(name, F.length(table) + 1, F.length(name))

        to_joined = state(site["at"] + 1, F.lit(None).cast("string"), site["joined"])
        return (
            F.when(i < acc["next"], acc)
            .when(word == table, to_joined)
            .when((word != "") & F.startswith(site["far"], table), state(i + 3, after(site["far"]), word))
            .when((word != "") & F.startswith(site["near"], table), state(i + 2, after(site["near"]), word))
            .when(F.endswith(word, table), to_joined)
            .otherwise(acc)
        )

    zero = {"next": F.lit(0), "rest": F.lit(None).cast("string"), "found": _empty()}
    return F.array_distinct(_each(sites, lambda s: _folded(s, merge, "found", **zero)))


def columns_of_table(upper: Column, table: Column, classes: Classes = UNICODE) -> Column:
    return columns_in(dotted_chains(upper, classes), table)


def related_tables(upper: Column, table: Column, classes: Classes = UNICODE) -> Column:
    return related_in(join_sites(upper, classes), table)


def join_columns(upper: Column, table: Column, classes: Classes = UNICODE) -> Column:
    return join_columns_in(equations(upper, classes), table)


def qualified_columns(upper: Column, classes: Classes = UNICODE) -> Column:
    r"""Distinct (qualifier, column) of every ``(\w+)\.(\w+)``; aliases and numbers included."""
    pairs = _all(upper, rf"{classes.word_start}({classes.word}++\.{classes.word}++)", 1)
    return F.transform(
        F.array_distinct(pairs),
        lambda p: F.struct(
            F.substring_index(p, ".", 1).alias("table_name"),
            F.substring_index(p, ".", -1).alias("column_name"),
        ),
    )


def insert_columns(upper: Column, classes: Classes = UNICODE) -> Column:
    r"""(table, column) of every ``INSERT\s+INTO\s+(\w+)\s*\(([^)]+)\)``, split at commas."""
    regex = rf"INSERT{classes.space}++INTO{classes.space}++({classes.word}++){classes.space}*+\(([^)]++)\)"
    edge = rf"\A{classes.space}++|(?<!{classes.space}){classes.space}++\z"
    named = F.transform(
        _all(upper, regex, 0),
        lambda whole: F.transform(
            F.split(F.regexp_extract(whole, regex, 2), ","),
            lambda column: F.struct(
                F.regexp_extract(whole, regex, 1).alias("table_name"),
                F.regexp_replace(column, edge, "").alias("column_name"),
            ),
        ),
    )
    return F.array_distinct(F.flatten(named))


def schema_columns(upper: Column, classes: Classes = UNICODE) -> Column:
    """(table, column) pairs by qualification and by INSERT column lists."""
    return F.array_union(qualified_columns(upper, classes), insert_columns(upper, classes))


def relationship_edges(upper: Column, classes: Classes = UNICODE) -> Column:
    r"""Both directions of every ``(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)`` between two names."""
    equals = _equals(classes)
    name = rf"{classes.word}++\.{classes.word}++"
    whole = F.array_distinct(_all(upper, rf"{classes.word_start}{name}{equals}{name}", 0))
    parts = F.transform(whole, lambda w: F.split(w, rf"\.|{classes.space}*+={classes.space}*+"))
    other = F.filter(parts, lambda e: e[0] != e[2])

    def edge(parts, t1, c1, t2, c2):
        return F.struct(
            parts[t1].alias("table_name"), parts[c1].alias("column_name"),
            parts[t2].alias("other_table"), parts[c2].alias("other_column"),
        )

    return F.when(
        F.contains(upper, F.lit("=")),
        F.array_distinct(
            F.concat(
                F.transform(other, lambda e: edge(e, 0, 1, 2, 3)),
                F.transform(other, lambda e: edge(e, 2, 3, 0, 1)),
            )
        ),
    )


def real_table_names(upper: Column, classes: Classes = UNICODE) -> Column:
    """Sorted distinct last name parts after FROM, JOIN, INTO, UPDATE and TABLE."""
    words = "|".join(P.REAL_NAME_KEYWORDS)
    dotted = _all(upper, rf"(?:{words}){classes.space}++({classes.word}++(?:\.{classes.word}++)*+)", 1)
    return F.array_sort(F.array_distinct(F.transform(dotted, lambda n: F.substring_index(n, ".", -1))))
