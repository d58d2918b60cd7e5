"""Article tables: site registry, URL rule sets, cleaning filters, dedup and per-bill counts.

Sites are data (a small registry), not modules: every per-site operation is one expression over a
``site`` column, so all sites run in one plan instead of one script per site.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SiteSpec:
    site: str                # value of the ``site`` column in article tables
    label: str               # display name
    count_col: str | None    # model-table column (None: collected but not modelled)
    dedup: bool              # distinct on (Author, Bill, Text, Title, Year) before counting
    swap_author_title: bool  # the site's writer stored Author and Title swapped
    search: str              # 'news' (news search with a source filter) or 'own' (site search)
    source: str | None       # source filter / url check string for news search
    plot_label: str | None = None


# The reference's news sites, model column names and per-site handling.
SITES: tuple[SiteSpec, ...] = (
    SiteSpec("azcentral", "AZ Republic", "AZCen_Count", True, False, "news", "azcentral", "AZ Republic"),
    SiteSpec("azdailystar", "AZ Daily Star", "AZDS_Count", True, False, "news", "tucson.com", "AZ Daily Star"),
    SiteSpec("phoenixnewtimes", "Phoenix New Times", "PNT_Count", True, False, "news", "phoenixnewtimes", "PHX New Times"),
    SiteSpec("azcapitoltimes", "AZ Capitol Times", "AZCap_Count", False, True, "own", None, "AZ Capitol Times"),
    SiteSpec("cronkitepbs", "Cronkite News", None, True, False, "news", "cronkite"),
    SiteSpec("foxphoenix", "FOX 10 Phoenix", None, True, False, "own", None),
)

# Fixture article tables name their sites site_0..site_3.
FIXTURE_SITE_KEYS = {"azcentral": "site_0", "azdailystar": "site_1", "azcapitoltimes": "site_2", "phoenixnewtimes": "site_3"}

MODEL_COUNT_COLS = ("AZCen_Count", "AZDS_Count", "AZCap_Count", "PNT_Count")


def fixture_sites() -> tuple[SiteSpec, ...]:
    return tuple(
        replace(s, site=FIXTURE_SITE_KEYS[s.site], source=FIXTURE_SITE_KEYS[s.site])
        for s in SITES if s.site in FIXTURE_SITE_KEYS
    )


def site_spec(sites: Sequence[SiteSpec], site: str) -> SiteSpec:
    return next(s for s in sites if s.site == site)


# URL rule sets.  'skip' sets turn a url into a placeholder row without fetching it;
# 'drop' sets remove the row after extraction.  The two AZ Republic sets differ on purpose
# (``podcast`` vs ``-podcast/``, ``/picture-gallery/`` vs ``/picture_gallery/``).
URL_RULES: dict[str, tuple[str, tuple[str, ...]]] = {
    "azcentral_pre": ("skip", ("podcast", "amp", "/picture-gallery/", "/videos/", "/interactives/", "/restricted/")),
    "azcentral_post": ("drop", ("-podcast/", "/videos/", "amp", "/picture_gallery/", "/interactives/", "/restricted/")),
    "azcapitoltimes": ("drop", (".pdf",)),
    "foxphoenix": ("drop", ("/video/",)),
    "phoenixnewtimes": ("skip", ("best-of", "slideshow")),
}

# The subscriber wall paragraph dropped from Capitol Times results.
PAYWALL_TEXT = (
    "Enter your user name and password in the fields above to gain access to the subscriber content on this site."
)
FAILED = "N/A"          # placeholder for a page that failed to parse
SKIPPED = "N/a"         # placeholder for a url skipped by a 'skip' rule set


def url_matches(url: Column | str, rule_set: str) -> Column:
    """True when the url contains any literal pattern of ``rule_set``."""
    u = F.col(url) if isinstance(url, str) else url
    pats = URL_RULES[rule_set][1]
    cond = F.lit(False)
    for p in pats:
        cond = cond | u.contains(p)
    return cond


def apply_url_rules(df: DataFrame, rule_sets: Sequence[str], url_col: str = "URL") -> DataFrame:
    """Apply rule sets in order: 'drop' sets remove rows, 'skip' sets blank the extracted fields
    with the ``N/a`` placeholder (the reference's pre-fetch skip) and set ``status='skipped'``."""
    if "status" not in df.columns:
        df = df.withColumn("status", F.lit("ok"))
    for rs in rule_sets:
        kind = URL_RULES[rs][0]
        hit = url_matches(url_col, rs)
        if kind == "drop":
            df = df.where(~hit)
        else:
            repl = {c: F.when(hit, F.lit(SKIPPED)).otherwise(F.col(c)) for c in ("Author", "Title", "Text") if c in df.columns}
            repl["status"] = F.when(hit, F.lit("skipped")).otherwise(F.col("status"))
            df = df.withColumns(repl)
    return df


def drop_paywall(df: DataFrame) -> DataFrame:
    """Remove rows whose body is the subscriber wall (literal substring match)."""
    return df.where(~F.coalesce(F.col("Text").contains(PAYWALL_TEXT), F.lit(False)))


def drop_empty_text(df: DataFrame) -> DataFrame:
    return df.where(F.length("Text") > 0)


def drop_failed(df: DataFrame) -> DataFrame:
    """Remove placeholder rows of failed pages (``Author == 'N/A'``)."""
    return df.where(~F.coalesce(F.col("Author") == FAILED, F.lit(False)))


def normalise_columns(articles: DataFrame, sites: Sequence[SiteSpec]) -> DataFrame:
    """Undo the Author/Title swap for the sites whose writer stored them swapped (C3).

    Both columns are selected at once, so the swap is a true exchange, not a chained rename.
    """
    swapped = [s.site for s in sites if s.swap_author_title]
    if not swapped:
        return articles
    is_sw = F.col("site").isin(swapped)
    return articles.withColumns({
        "Author": F.when(is_sw, F.col("Title")).otherwise(F.col("Author")),
        "Title": F.when(is_sw, F.col("Author")).otherwise(F.col("Title")),
    })


def article_counts(articles: DataFrame, sites: Sequence[SiteSpec]) -> DataFrame:
    """site, Bill, Year, article_count.

    Dedup sites count distinct (Author, Bill, Text, Title, Year); the others count rows.  The
    distinct key carries a SHA-256 digest of the article text instead of the whole text, so the
    shuffle moves 32 bytes per article rather than the body.  The first aggregation groups on the
    full article key (a hot bill spreads over all partitions); the second is a partial count.
    """
    a = normalise_columns(articles, sites)
    dedup_sites = [s.site for s in sites if s.dedup]
    a = a.where(F.col("site").isin([s.site for s in sites]))
    per_article = a.groupBy(
        "site", "Bill", "Year", "Author", "Title", F.sha2(F.col("Text"), 256).alias("text_sha")
    ).agg(F.count(F.lit(1)).alias("n"))
    weight = F.when(F.col("site").isin(dedup_sites), F.lit(1).cast("long")).otherwise(F.col("n"))
    return per_article.groupBy("site", "Bill", "Year").agg(F.sum(weight).alias("article_count"))


def article_counts_wide(counts: DataFrame, sites: Sequence[SiteSpec]) -> DataFrame:
    """Bill, Year, one count column per modelled site (0 when absent)."""
    modelled = [s for s in sites if s.count_col]
    col_of = F.lit(None).cast("string")
    for s in modelled:
        col_of = F.when(F.col("site") == s.site, F.lit(s.count_col)).otherwise(col_of)
    names = [s.count_col for s in modelled]
    wide = (
        counts.withColumn("count_col", col_of)
        .where(F.col("count_col").isNotNull())
        .groupBy("Bill", "Year")
        .pivot("count_col", names)
        .agg(F.sum("article_count"))
    )
    return wide.fillna(0, subset=names)


def dedup_rows(df: DataFrame) -> DataFrame:
    """Full-row dedup of a collected article table (G5)."""
    return df.distinct()
