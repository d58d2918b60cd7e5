"""String helpers mirroring the reference's R/pandas string calls with native Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_flag(c: Column | str, needle: str) -> Column:
    """1/0 flag for a literal substring; a null input stays null (R ``ifelse(str_detect())``)."""
    return _c(c).contains(needle).cast("int")


def remove_words(c: Column | str, words: list[str]) -> Column:
    """Remove whole words/phrases bounded by word boundaries (tm ``removeWords``)."""
    alts = "|".join(re.escape(w).replace("\\ ", " ") for w in sorted(words, reverse=True))
    return F.regexp_replace(_c(c), rf"\b({alts})\b", "")


def remove_first(c: Column | str, needle: str) -> Column:
    """Remove the first literal occurrence of ``needle`` (stringr ``str_remove``)."""
    col = _c(c)
    pos = F.instr(col, needle)
    head = col.substr(F.lit(1), pos - 1)
    tail = col.substr(pos + len(needle), F.lit(1 << 30))
    return F.when(pos > 0, F.concat(head, tail)).otherwise(col)


def first_char_is(c: Column | str, ch: str) -> Column:
    """1/0 flag: first character equals ``ch`` (R ``str_sub(x, 1, 1) == ch``)."""
    return (F.substring(_c(c), 1, 1) == ch).cast("int")


def text_before(c: Column | str, sep: str) -> Column:
    """Text before the first ``sep`` (Python ``s.split(sep, 1)[0]``)."""
    return F.substring_index(_c(c), sep, 1)


def join_nonempty(arr: Column, sep: str = " ") -> Column:
    """Drop empty strings from an array and join the rest (``' '.join(p for p in ps if p != '')``)."""
    return F.array_join(F.filter(arr, lambda x: x != F.lit("")), sep)


# Word tokens for matching: letters and digits of any script, lower-cased.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def word_tokens(c: Column | str) -> Column:
    """Distinct lower-case word tokens (empty strings removed)."""
    toks = F.split(F.lower(_c(c)), TOKEN_SPLIT)
    return F.array_distinct(F.array_remove(toks, ""))
