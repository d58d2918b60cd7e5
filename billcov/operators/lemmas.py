"""Lemma rules: suffix rewrites learned from (form, lemma) pairs, applied by the longest suffix.

A pair's rewrite is what follows the common beginning of form and lemma: strip so many characters,
add an ending.  Each suffix of a form (up to ``MAX_SUFFIX`` characters, at least what is stripped and
one more than nothing) votes for its pair's rewrite; a suffix with ``MIN_PAIRS`` pairs keeps the rewrite
with the most votes (ties: the shorter strip, then the smaller ending).  Words that the table has take
its lemma; other words take the rewrite of their longest known suffix, and stay as they are without
one.

Everything is joins and aggregations on terms and suffixes: the distinct terms are looked up once,
however often they occur, with one row for each of their suffixes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billcov.functions.sizing import sized_broadcast

MAX_SUFFIX = 5
MIN_PAIRS = 3


def _common(a: Column, b: Column) -> Column:
    """Length of the common beginning."""
    steps = F.sequence(F.lit(0), F.least(F.char_length(a), F.char_length(b)))
    return F.array_max(F.filter(steps, lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)))


def suffixes(term: Column, least: Column | int = 1, longest: int = MAX_SUFFIX) -> Column:
    """The term's endings of ``least`` to ``longest`` characters (an empty array without any)."""
    least = F.lit(least) if isinstance(least, int) else least
    most = F.least(F.char_length(term), F.lit(longest))
    steps = F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.right(term, k))


def learned(lemmas: DataFrame, min_pairs: int = MIN_PAIRS, max_suffix: int = MAX_SUFFIX) -> DataFrame:
    """suffix, strip, ending: the rewrite of each suffix that ``min_pairs`` pairs (form, lemma) have."""
    pairs = lemmas.where("form is not null and lemma is not null").groupBy("form").agg(F.min("lemma").alias("lemma"))
    same = _common(F.col("form"), F.col("lemma"))
    rewrites = pairs.select("form", (F.char_length("form") - same).alias("strip"), F.expr("lemma").alias("lemma"), same.alias("same"))
    rewrites = rewrites.select("form", "strip", F.substring(F.col("lemma"), F.col("same") + 1, F.char_length("lemma")).alias("ending"))
    each = rewrites.select("strip", "ending", F.explode(suffixes(F.col("form"), F.greatest(F.col("strip"), F.lit(1)), max_suffix)).alias("suffix"))
    votes = each.groupBy("suffix", "strip", "ending").agg(F.count(F.lit(1)).alias("votes"))
    best = F.min(F.struct((-F.col("votes")).alias("rank"), "strip", "ending"))
    return votes.groupBy("suffix").agg(F.sum("votes").alias("pairs"), best.alias("b")).where(F.col("pairs") >= min_pairs).select("suffix", "b.strip", "b.ending")


def lemma_table(terms: DataFrame, lemmas: DataFrame, rules: DataFrame) -> DataFrame:
    """form, lemma for every distinct ``term``: the table's lemma, else the rewrite of the longest known suffix."""
    known = lemmas.where("form is not null and lemma is not null").groupBy(F.col("form").alias("f")).agg(F.min("lemma").alias("known"))
    every = terms.select("term").distinct().join(sized_broadcast(known), F.col("term") == F.col("f"), "left").select("term", "known")
    ends = every.where("known is null").select("term", F.explode(suffixes(F.col("term"))).alias("end"))
    hit = ends.join(sized_broadcast(rules), F.col("end") == F.col("suffix")).where(F.col("strip") < F.char_length("term"))
    longest = hit.groupBy(F.col("term").alias("t")).agg(F.max_by(F.struct("strip", "ending"), F.char_length("end")).alias("r"))
    both = every.join(longest, F.col("term") == F.col("t"), "left")
    rewritten = F.concat(F.substring(F.col("term"), F.lit(1), F.char_length("term") - F.col("r.strip")), F.col("r.ending"))
    return both.select(F.col("term").alias("form"), F.coalesce("known", rewritten, "term").alias("lemma"))


def lemmatised(tokens: DataFrame, lemmas: DataFrame, keys: Sequence[str] = ("bill_number", "year"), min_pairs: int = MIN_PAIRS) -> DataFrame:
    """keys, title_lemmas: each title's tokens replaced by their lemmas, in order."""
    each = tokens.select(*keys, F.posexplode_outer("tokens").alias("pos", "term"))
    table = lemma_table(each.where("term is not null"), lemmas, learned(lemmas, min_pairs))
    words = each.join(sized_broadcast(table), F.col("term") == F.col("form"), "left")
    back = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "lemma")))).alias("w"))
    return back.select(*keys, F.array_join(F.transform("w", lambda x: x["lemma"]), " ").alias("title_lemmas"))
