"""Bill features: passed flag, committee chain, sponsor share, bill spine.

Committee chain semantics (literal reading of the reference's dplyr chain, per bill):

1. keep actions containing ``Assigned``; ``n_assigned`` = their count (includes rows with no chamber);
2. drop ``RULES`` rows unless ``n_assigned == 1``;
3. remove the words ``Assigned to `` / `` Committee`` at word boundaries;
4. keep rows naming a chamber (``Senate`` or, failing that, ``House``) – per row, so both chambers stay;
5. remove the first ``Senate`` then the first ``House`` (a leading space remains);
6. ``Committee_Intro_Count`` = surviving rows, ``Committees_Concat`` = distinct names in order of first
   appearance joined by ``,``, ``sen_intro`` = Senate flag of the first surviving row.

Spark plan: the chain only needs per-bill counts and per-(bill, committee) first positions, so it is
written as two aggregations instead of windows.  Actions are shuffled once, by bill, for both.  Bills with
more than ``MANY_ACTIONS`` of them go another way: partial (map-side) aggregation collapses such a bill
to one row per committee name before any shuffle, and the second aggregation sees at most a few rows per
bill.  No window ever holds a whole bill, which keeps a bill holding a third of all actions safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billcov.functions.sizing import sized_broadcast
from billcov.functions.text import contains_flag, first_char_is, remove_first, remove_words
from billcov.session import stored

# Fixed values from the reference's feature script.
ASSIGNED = "Assigned"
RULES = "RULES"
SENATE = "Senate"
HOUSE = "House"
REMOVED_WORDS = ["Assigned to ", " Committee"]
PASSED_MARKER = "Chapter"
REPUBLICAN = "R"


def passed_flag(bills: DataFrame) -> Column:
    """``passed`` = last_action contains ``Chapter``; null stays null (C6)."""
    return contains_flag("last_action", PASSED_MARKER)


def bill_passed(bills: DataFrame) -> DataFrame:
    return bills.select("bill_id", "bill_number", "year", passed_flag(bills).alias("passed"))


def committee_name(action: Column) -> Column:
    """Steps 3 and 5: strip the assignment words, then the first chamber word."""
    stripped = remove_words(action, REMOVED_WORDS)
    return remove_first(remove_first(stripped, SENATE), HOUSE)


#: Actions of a bill above which they are not gathered in one task.
MANY_ACTIONS = 10_000


def committee_features(
    history: DataFrame,
    order_cols: Sequence[str] = ("sequence",),
    within_first: int | None = None,
    key: Sequence[str] = ("bill_id",),
    first_chamber_only: bool = False,
) -> DataFrame:
    """bill_id, Committee_Intro_Count, Committees_Concat, sen_intro (one row per bill with a
    surviving assignment).

    ``order_cols`` is the total order standing in for file order.  ``within_first`` enables the
    intended "within N of the first sequence" filter (the literal script makes it a no-op);
    ``first_chamber_only`` keeps only assignments in the chamber of the bill's first surviving
    assignment (the intended chamber filter; the literal one is per row, Q7).
    """
    key = list(key)
    act = F.col("action")
    assigned = history.where(act.contains(ASSIGNED))
    if within_first is not None:
        assigned = _within_first(assigned, key, within_first)
    if first_chamber_only:
        assigned = _first_chamber(assigned, key, order_cols)
    # a bill's actions are dealt out once, unless they are so many that names are collapsed before bills meet
    many = stored(assigned.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MANY_ACTIONS).select(*key), "many-actions")
    has_chamber = act.contains(SENATE) | act.contains(HOUSE)
    rows = assigned.select(*key, *order_cols, act.contains(SENATE).cast("int").alias("sen"), has_chamber.alias("has_chamber"), committee_name(act).alias("name"))
    if many.isEmpty():
        return _committees(rows.repartition(*key), key, order_cols)
    hot = sized_broadcast(many)
    few = rows.join(hot, key, "left_anti").repartition(*key)
    return _committees(few, key, order_cols).unionByName(_committees(rows.join(hot, key, "left_semi"), key, order_cols))


def _committees(rows: DataFrame, key: list[str], order_cols: Sequence[str]) -> DataFrame:
    """Two aggregations, by bill and committee name and by bill; of rows dealt by bill, both run where they are."""
    pos = F.struct(*order_cols, "sen")
    per_name = rows.groupBy(*key, "has_chamber", "name").agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))

    is_rules = F.col("name").contains(RULES)
    keep_plain = F.col("has_chamber") & ~is_rules
    keep_rules = F.col("has_chamber") & is_rules
    entry = F.struct(F.col("first").alias("first"), F.col("name").alias("name"))
    per_bill = per_name.groupBy(*key).agg(
        F.sum("n").alias("n_assigned"),
        F.sum(F.when(keep_plain, F.col("n")).otherwise(0)).alias("c_plain"),
        F.sum(F.when(keep_rules, F.col("n")).otherwise(0)).alias("c_rules"),
        F.collect_list(F.when(keep_plain, entry)).alias("plain"),
        F.collect_list(F.when(keep_rules, entry)).alias("rules"),
    )
    only_one = F.col("n_assigned") == 1
    survivors = F.array_sort(
        F.when(only_one, F.concat("plain", "rules")).otherwise(F.col("plain"))
    )
    count = F.col("c_plain") + F.when(only_one, F.col("c_rules")).otherwise(F.lit(0))
    return (
        per_bill.select(*key, count.alias("Committee_Intro_Count"), survivors.alias("s"))
        .where(F.col("Committee_Intro_Count") > 0)
        .select(
            *key,
            F.col("Committee_Intro_Count"),
            F.array_join(F.array_distinct(F.transform("s", lambda e: e["name"])), ",").alias("Committees_Concat"),
            F.col("s")[0]["first"]["sen"].alias("sen_intro"),
        )
    )


def _within_first(assigned: DataFrame, key: list[str], n: int) -> DataFrame:
    """Keep rows whose sequence is < n after the first sequence that survives the RULES filter."""
    is_rules = F.col("action").contains(RULES)
    first = assigned.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("sequence").alias("_min_all"),
        F.min(F.when(~is_rules, F.col("sequence"))).alias("_min_plain"),
    ).select(*key, F.when(F.col("_n") == 1, F.col("_min_all")).otherwise(F.col("_min_plain")).alias("_min_seq"))
    return (
        assigned.join(first, key)
        .where(F.col("_min_seq").isNull() | (F.col("sequence") - F.col("_min_seq") < n))
        .drop("_min_seq")
    )


def _first_chamber(assigned: DataFrame, key: list[str], order_cols: Sequence[str]) -> DataFrame:
    """Keep rows of the chamber (Senate/House) of the first row that survives the RULES filter."""
    act = F.col("action")
    counts = assigned.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    cand = assigned.join(counts, key).where(~act.contains(RULES) | (F.col("_n") == 1))
    cand = cand.where(act.contains(SENATE) | act.contains(HOUSE))
    first = cand.groupBy(*key).agg(
        F.min(F.struct(*[F.col(c) for c in order_cols], act.contains(SENATE).alias("_sen")))["_sen"].alias("_first_sen")
    )
    same = F.when(F.col("_first_sen"), act.contains(SENATE)).otherwise(act.contains(HOUSE) & ~act.contains(SENATE))
    return assigned.join(first, key, "left").where(F.col("_first_sen").isNull() | same).drop("_first_sen")


def sponsor_features(sponsors: DataFrame, people: DataFrame, key: Sequence[str] = ("bill_id",)) -> DataFrame:
    """bill_id, SponsorCount, RepubSponsorPct (3 digits, half-even).

    A sponsor with unknown party makes the share null, as R's ``sum`` without ``na.rm`` does.
    ``people`` is a legislator list; it is broadcast only after a row-count check.
    """
    flag = (F.col("party") == REPUBLICAN).cast("int")
    p = sized_broadcast(people.select("people_id", flag.alias("RepublicanSponsor")))
    m = sponsors.join(p, "people_id")
    n = F.count(F.lit(1))
    share = F.bround(F.sum("RepublicanSponsor") / n, 3)
    return m.groupBy(*key).agg(
        n.alias("SponsorCount"),
        F.when(F.count("RepublicanSponsor") == n, share).alias("RepubSponsorPct"),
    )


def bill_features(
    bills: DataFrame,
    history: DataFrame,
    sponsors: DataFrame,
    people: DataFrame,
    order_cols: Sequence[str] = ("sequence",),
    within_first: int | None = None,
) -> DataFrame:
    """The bill spine with committee and sponsor features and the reference's fills.

    Sponsor features hang off the committee rows (a left join), so a bill with sponsors but no
    surviving committee assignment gets null sponsor features (literal behaviour, filled with 0 in
    the model table).  ``sen_intro`` is finally taken from the bill number's first letter.
    """
    cf = committee_features(history, order_cols=order_cols, within_first=within_first)
    sf = sponsor_features(sponsors, people)
    hs = cf.join(sf, "bill_id", "left")
    spine = bills.select("bill_number", passed_flag(bills).alias("passed"), "bill_id", "year")
    out = spine.join(hs, "bill_id", "left")
    return out.select(
        "bill_number",
        "passed",
        "bill_id",
        "year",
        F.coalesce("Committee_Intro_Count", F.lit(0).cast("long")).alias("Committee_Intro_Count"),
        F.coalesce("Committees_Concat", F.lit(RULES)).alias("Committees_Concat"),
        first_char_is("bill_number", "S").alias("sen_intro"),
        "SponsorCount",
        "RepubSponsorPct",
    )


def latest_document(bills: DataFrame, documents: DataFrame) -> DataFrame:
    """bill_id, bill_number, year, document_id, url: one document per bill (J1, G7).

    The reference sorts by last_action_date – a bill column, so every document of a bill ties – and
    keeps the last; the tie is broken by the larger document id.  ``max(struct)`` is a partial
    aggregate (safe for a bill with very many documents).
    """
    b = bills.select("bill_id", "bill_number", "year", "last_action_date")
    j = b.join(documents.select("bill_id", "document_id", "url"), "bill_id")
    best = F.max(F.struct("last_action_date", "document_id", "url")).alias("d")
    return j.groupBy("bill_id", "bill_number", "year").agg(best).select(
        "bill_id", "bill_number", "year", F.col("d.document_id").alias("document_id"), F.col("d.url").alias("url")
    )
