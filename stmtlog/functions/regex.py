"""Turn the plain patterns into Java regexes that give the same answer in linear time.

A chain such as ``SELECT.*COUNT.*HAVING`` backtracks polynomially when a long one-line text
repeats the early words and lacks a later one, and one such statement would hold up a whole
stage.  Whether a chain matches can be decided without going back: on one line, taking each
word at its earliest place is never worse than taking it later.  Each step therefore becomes
an atomic group ``(?>.*?WORD)`` tried once per line.  The one way out of a line is a ``\\s+``
that holds a newline; there the place of the word is forced (line end, then line start), so a
step with ``\\s+`` is written out as two alternatives, *within the line* and *over the line
end*, and the whole chain as their combinations.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Classes(NamedTuple):
    """Character classes spelled out for Java."""

    space: str
    space_in_line: str
    word: str
    digit: str

    @property
    def word_start(self) -> str:
        return f"(?<!{self.word})"


# \s, \s without newline, \w and \d as Python's re has them for str.
_WIDE = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNICODE = Classes(
    rf"[\t-\r\x1c-\x20{_WIDE}]", rf"[\t\x0b-\r\x1c-\x20{_WIDE}]", r"[\w\p{L}\p{N}]", r"\p{Nd}"
)
# The same on texts that are all ASCII; patterns compile and run about twice as fast.
ASCII = Classes(r"[\t-\r\x1c-\x20]", r"[\t\x0b-\r\x1c-\x20]", r"\w", r"\d")

# (?d): only \n ends a line, as in Python.
_WHOLE_TEXT = "(?d)"
_EACH_LINE = "(?dm)^"


def java_regex(pattern: str) -> str:
    """Spell Python's character classes out for Java; no other change."""
    return pattern.replace(r"\s", UNICODE.space).replace(r"\w", UNICODE.word).replace(r"\d", UNICODE.digit)


def _choices(token: str, position_is_forced: bool) -> list[str]:
    if position_is_forced or r"\s" not in token:
        return [java_regex(token)]
    if token.count(r"\s") != 1 or r"\s+" not in token:
        raise ValueError(f"step {token!r} needs exactly one \\s+")
    return [
        java_regex(token.replace(r"\s+", UNICODE.space_in_line + "++")),
        java_regex(token.replace(r"\s+", rf"{UNICODE.space_in_line}*+\n{UNICODE.space}*+")),
    ]


def _linear_alternative(pattern: str) -> str:
    anchored = pattern.startswith("^")
    tokens = pattern.removeprefix("^").split(".*")
    last = len(tokens) - 1
    steps = []
    for i, token in enumerate(tokens):
        if i < last:
            # a word that runs into ".*" is there as soon as its first character is
            token = token.replace(r"(\w+)", r"\w")
        steps.append(_choices(token, i == last or (i == 0 and anchored)))
    chains = []
    for chain in itertools.product(*steps):
        first = rf"\A{UNICODE.space}*+{chain[0]}" if anchored else rf"(?>.*?{chain[0]})"
        body = first + "".join(rf"(?>.*?{step})" for step in chain[1:])
        if body.endswith("$)"):
            body = body[:-2] + rf"{UNICODE.space}*+\z)"
        chains.append(body)
    joined = chains[0] if len(chains) == 1 else "(?:" + "|".join(chains) + ")"
    return (_WHOLE_TEXT if anchored else _EACH_LINE) + joined


def linear_forms(pattern: str) -> list[str]:
    """One linear Java regex per top-level alternative; ``^``/``$`` also absorb the strip."""
    return [_linear_alternative(alternative) for alternative in pattern.split("|")]


# Words most statements have; looking for them first would not spare many regexes.
_COMMON = {"SELECT", "FROM", "WHERE", "SET", "IN", "BY", "ON", "IS", "AS"}


def required_words(pattern: str) -> list[str]:
    """Telling words that every match of one alternative contains, the later ones first."""
    words = list(dict.fromkeys(reversed(re.findall(r"[A-Z_]{2,}", re.sub(r"\\.", " ", pattern)))))
    return [w for w in words if w not in _COMMON] or words


def found_sql(text: str, pattern: str) -> str:
    """SQL condition: does ``pattern`` occur in ``text``?  Words are looked for before any regex.

    Text and not Column, because the rules make hundreds of nodes and each would cost a call to
    the JVM.
    """
    tests = []
    for plain, linear in zip(pattern.split("|"), linear_forms(pattern)):
        words = [f"contains({text}, '{word}')" for word in required_words(plain)]
        tests.append(" AND ".join([*words, f"{text} RLIKE r'{linear}'"]))
    return " OR ".join(f"({test})" for test in tests)


def first_found_sql(text: str, patterns: list[str], values: list[str], default: str) -> str:
    """SQL expression: the value of the first pattern that occurs in ``text``."""
    cases = " ".join(f"WHEN {found_sql(text, p)} THEN {v}" for p, v in zip(patterns, values))
    return f"CASE {cases} ELSE {default} END"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)
