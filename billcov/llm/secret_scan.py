"""Secret scans with corpus-wide ownership frequency (operator 2), DataFrame operations only.

Method: patterns find candidate secrets; a candidate's hash is counted over the corpus by distinct
repositories (documents) and distinct owners (sources).  A value of more than ``MAX_OWNERS`` owners
or more than ``MAX_REPOSITORIES`` repositories is a widely copied example; one that stays with its
owner, in few repositories, and looks live (no placeholder, mixed and varied characters) is reported
as ``live``, over the value alone.  Pattern spans stay in any case, each with both counts of its value.

Offsets are code points.  A text's matches and the pieces between them alternate, so a match starts
after the lengths of all pieces and matches before it: a running sum over the document's rows.

Scale: texts are scanned once where they lie; only texts with a match are split.  What is written
and shuffled is a row of lengths and hashes for each candidate.  Counting runs in three steps of
partial sums (value, owner and repository; value and owner; value), so a value that a third of all
documents hold is no bottleneck; counts meet candidates in a join that Spark can split.

Defined cases: null texts are empty and give zero counts; a null owner is an owner of its own;
repeated rows each get a row (rows are told apart by position; equal identifiers are one
repository); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billcov.llm.common import written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
PROVIDER = (
    r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----)"
)
#: kind, pattern, group of the value, least length of the value; in the order of kinds.
KINDS = [("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("provider", PROVIDER, 0, 1)]
BASE = ["assign", "access", "hex"]

#: A value of more owners, or of more repositories, than this is an example.
MAX_OWNERS = 2
MAX_REPOSITORIES = 20
MIN_DISTINCT_CHARS = 6
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|redacted|xxxx|your"


def _found(text: Column, pattern: str, group: int) -> Column:
    """Array of (gap, size, value): lengths of the piece before a match and of the match, and its value."""
    p = F.lit(pattern)
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.regexp_extract_all(text, p, F.lit(group)).alias("value")
    )
    each = F.transform(zipped, lambda m: F.struct(F.char_length(m["piece"]).alias("gap"), F.char_length(m["whole"]).alias("size"), m["value"].alias("value")))
    # The last piece has no match after it.
    return F.when(text.rlike(pattern), F.slice(each, F.lit(1), F.size(each) - 1))


def _looks_live(value: Column) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT_CHARS
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & varied & ~value.rlike(PLACEHOLDER)) | value.startswith("-----BEGIN")


def _described(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """All matches of a kind in ``text``, those with too short a value marked."""

    def one(m: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            F.lit(rank).alias("rank"),
            i.alias("i"),
            m["gap"].alias("gap"),
            m["size"].alias("size"),
            F.char_length(m["value"]).alias("value_size"),
            (F.char_length(m["value"]) >= least).alias("valid"),
            F.sha2(m["value"].cast("binary"), 256).alias("value_hash"),
            _looks_live(m["value"]).alias("looks_live"),
        )

    return F.transform(_found(F.col("text"), pattern, group), one)


def candidates(docs: DataFrame, *, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: rid, doc_id; candidates: rid, repo, owner, kind, rank, start, end, value_start, value_hash, looks_live)."""
    none = F.array().cast("array<struct<kind:string,rank:int,i:int,gap:int,size:int,value_size:int,valid:boolean,value_hash:string,looks_live:boolean>>")
    kinds = F.concat(*[F.coalesce(_described(rank, *kind), none) for rank, kind in enumerate(KINDS)])
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).cast("string").alias("text"))
    scan = written(rows.select("rid", "doc_id", "owner", kinds.alias("found")), "secret-scan")
    w = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = scan.where(F.size("found") > 0).select("rid", F.col("doc_id").alias("repo"), "owner", F.explode("found").alias("f")).select("rid", "repo", "owner", "f.*")
    end = F.sum(F.col("gap") + F.col("size")).over(w)
    # Failing matches take part in the running sum and go afterwards.
    each = each.repartition("rid").withColumn("end", end.cast("long")).where("valid")
    return scan.select("rid", "doc_id"), each.select(
        "rid", "repo", "owner", "kind", "rank", (F.col("end") - F.col("size")).alias("start"), "end", (F.col("end") - F.col("value_size")).alias("value_start"), "value_hash", "looks_live"
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owners, repositories): how far each candidate has spread."""
    return (
        found.groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("one"))
        .groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
        .groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repositories"))
    )


def secret_spans(
    docs: DataFrame, *, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES
) -> DataFrame:
    """One row per document: doc_id, spans array<(start, rank, kind, end)> in order, spread array<(start, rank, kind, end, owners, repositories)>, n_live, n_example."""
    rows, found = candidates(docs, id_col=id_col, owner_col=owner_col, text_col=text_col)
    found = written(found, "secret-candidates")
    spread = ownership(found).select(F.col("value_hash").alias("h"), "owners", "repositories")
    example = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    judged = found.join(spread, F.col("value_hash") == F.col("h")).withColumn("example", example).withColumn("live", F.col("looks_live") & ~F.col("example"))
    span = lambda start, rank, kind: F.struct(start.alias("start"), F.lit(rank).alias("rank") if isinstance(rank, int) else rank.alias("rank"), kind.alias("kind"), F.col("end").alias("end"))
    spans = F.array_append(F.array(span(F.col("start"), F.col("rank"), F.col("kind"))), F.when(F.col("live"), span(F.col("value_start"), len(KINDS), F.lit("live"))))
    of_doc = judged.groupBy("rid").agg(
        F.array_sort(F.flatten(F.collect_list(F.array_compact(spans)))).alias("spans"),
        F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "owners", "repositories"))).alias("spread"),
        F.count_if("live").alias("n_live"),
        F.count_if("example").alias("n_example"),
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    unknown = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint,owners:bigint,repositories:bigint>>")
    # A value that two kinds find is live once.
    return rows.join(of_doc.withColumn("spans", F.array_distinct("spans")), "rid", "left").select(
        "doc_id", F.coalesce("spans", none).alias("spans"), F.coalesce("spread", unknown).alias("spread"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"),
    )


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"].isin(BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    spread = F.array_join(F.transform("spread", lambda s: F.concat_ws(":", *[s[c].cast("string") for c in ("kind", "start", "end", "owners", "repositories")])), ",")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), spread.alias("spread"), "n_live", "n_example",
    )
