"""URL filters by temporal list join (operator 3), DataFrame operations only.

Method: dated entries of a list (an entry is added or removed on a day) become validity intervals;
an as-of join evaluates every capture against the entries that were active when it was fetched.

A capture is looked up by its host and all parent domains.  Intervals are clipped to the days of the
captures and cut by calendar month, so that the join is an equi-join on (domain, month) with the day
compared inside: a domain that holds a third of all captures is dealt out by month, each side keeps
few rows of a key, and Spark can split what is left.

Defined cases: null or unparsable URLs and null fetch days match nothing and are kept; entries with
null domain or day, or an unknown action, are ignored; of entries on one day for the same domain and
list the last in the order add < remove holds; repeated captures each get a row; an empty list keeps
everything; extra columns of both tables are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billcov.llm.common import table, written

LABEL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def host(url: Column) -> Column:
    """Lower-case host of a URL, or null."""
    return F.nullif(F.lower(F.regexp_extract(url, LABEL, 1)), F.lit(""))


def domains(name: Column) -> Column:
    """The host and its parent domains with two labels or more (the host alone if it has one)."""
    parts = F.split(name, r"\.")
    last = F.greatest(F.size(parts) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, from_day, to_day): from the day an entry is added to the day before it is removed (null: open)."""
    rank = F.when(F.col("action") == "add", 0).when(F.col("action") == "remove", 1)
    good = entries.select("list", F.lower("domain").alias("domain"), "day", rank.alias("r")).where("domain is not null and day is not null and r is not null")
    days = good.groupBy("list", "domain", "day").agg(F.max("r").alias("r"))
    w = Window.partitionBy("list", "domain").orderBy("day")
    # Consecutive additions are one; only changes bound an interval.
    change = days.withColumn("before", F.lag("r", 1, 1).over(w)).where("r != before")
    return change.withColumn("to_day", F.date_sub(F.lead("day").over(w), 1)).where("r = 0").select("list", "domain", F.col("day").alias("from_day"), "to_day")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture: page_id, host, fetched, n_active (entries active then), lists, matched, keep.

    ``captures`` has page_id, url, fetched (date); ``entries`` has list, domain, day, action.
    """
    # Written once: row numbers must be the same for every later reader.
    rows = written(captures.select(F.monotonically_increasing_id().alias("rid"), "page_id", host(F.col("url")).alias("host"), "fetched"), "captures")
    lo, hi = (F.lit(x).cast("date") for x in rows.agg(F.min("fetched"), F.max("fetched")).first())
    valid = intervals(entries)
    clipped = valid.select("list", "domain", F.greatest("from_day", lo).alias("from_day"), F.least(F.coalesce("to_day", hi), hi).alias("to_day")).where("from_day <= to_day")
    monthly = clipped.select("list", "domain", "from_day", "to_day", F.explode(F.sequence(F.trunc("from_day", "month"), F.trunc("to_day", "month"), F.expr("interval 1 month"))).alias("month"))
    keys = rows.where("host is not null and fetched is not null").select("rid", "fetched", F.explode(domains(F.col("host"))).alias("k_domain"), F.trunc("fetched", "month").alias("k_month"))
    hits = (
        keys.join(monthly, (F.col("k_domain") == F.col("domain")) & (F.col("k_month") == F.col("month")) & F.col("fetched").between(F.col("from_day"), F.col("to_day")))
        .groupBy("rid")
        .agg(F.count(F.lit(1)).alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.max_by("domain", F.struct(F.char_length("domain"), "domain")).alias("matched"))
    )
    return rows.join(hits, "rid", "left").select(
        "page_id", "host", "fetched", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), "matched", F.col("n_active").isNull().alias("keep")
    )


# ---- a dated list over the given pages ---------------------------------------------------------

START = "2023-01-01"


def dated_captures(pages: DataFrame) -> DataFrame:
    """Captures of the given pages; pages carry no fetch day, so it follows from the identifier."""
    day = F.date_add(F.lit(START).cast("date"), F.pmod(F.col("page_id") * 37, F.lit(730)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched"))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A list history over the domains of the given pages.

    Each host and each of its parent domains whose smallest page identifier is divisible by three
    was added once, removed later, and (every other one) added again.
    """
    name = pages.select("page_id", F.explode(domains(host(F.col("url")))).alias("domain"))
    first = name.groupBy("domain").agg(F.min("page_id").alias("m")).where("m % 3 = 0")
    kind = F.when(F.col("m") % 2 == 0, "spam").otherwise("adult").alias("list")
    start = F.pmod(F.col("m") * 11, F.lit(400))
    event = lambda offset, action: F.struct(F.date_add(F.lit(START).cast("date"), offset.cast("int")).alias("day"), F.lit(action).alias("action"))
    events = F.array(event(start, "add"), event(start + 60 + F.col("m") % 90, "remove"))
    again = F.array(event(start + 300, "add"))
    all_events = F.when(F.col("m") % 4 == 0, F.concat(events, again)).otherwise(events)
    return first.select(kind, "domain", F.explode(all_events).alias("e")).select("list", "domain", "e.day", "e.action")


def filtered_pages(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return evaluate(dated_captures(pages), dated_entries(pages))
