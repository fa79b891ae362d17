"""Whole-token, case-insensitive full-text search: all terms, in any order, over all given columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = r"[^\p{L}\p{Nd}]+"


def query_terms(query: str) -> list[str]:
    """Lower-cased runs of letters and digits, each once."""
    out, word = [], ""
    for c in query + " ":
        if c.isalpha() or c.isdecimal():
            word += c
        elif word:
            out.append(word.lower())
            word = ""
    return list(dict.fromkeys(out))


def tokens(columns: list[Column]) -> Column:
    return F.array_remove(F.split(F.lower(F.concat_ws(" ", *columns)), SPLIT), "")


def matches_all(columns: list[Column], terms: list[str]) -> Column:
    """True where every term is a token of some column; no term matches nothing.

    The substring test is cheaper than splitting and rules out most rows first.
    """
    if not terms or not columns:
        return F.lit(False)
    text = F.lower(F.concat_ws(" ", *columns))
    test = F.lit(True)
    for t in terms:
        test = test & text.contains(t)
    found = tokens(columns)
    for t in terms:
        test = test & F.array_contains(found, t)
    return test
