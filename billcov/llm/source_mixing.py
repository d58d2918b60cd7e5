"""Mixing sources to target weights by Poisson replication (operator 4), DataFrame operations only.

Method: a source's mean repetition rate is the share of characters that it shall have, over the
share that it has.  Every document draws its number of copies from a Poisson distribution with its
source's rate, by inverting the distribution at a uniform number hashed from seed and identifier;
it is exploded by that count, and the copies are shuffled globally by another hash.

A rate above ``PART`` is split into equal parts, whose counts add up (a sum of independent Poisson
counts is one of their sum), so the table of a distribution stays short at any rate.

Scale: the sources' sizes are partial sums; the rates are joined by broadcast only if the sources
are few, else by a join that Spark can split at a hot source.  The counts need no shuffle; the one
shuffle of texts is the global shuffle that is asked for, and it is even, since its key is a hash of
identifier and copy.

Defined cases: a null source is a source of its own; sources without text (or without a positive
weight) have rate 0; null texts count as empty; rows with a null identifier draw by their place in
the input, each on its own (so their draw depends on how the input is dealt), and repeated identifiers
draw the same count; extra columns stay, but for ones named mix_copy, mix_copies or
mix_order, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billcov.functions.sizing import sized_broadcast
from billcov.llm.common import fresh_names, written

SEED = 20_240
#: Target share of a source: its characters to this power, over the sum of all (1: as is; 0: uniform).
TEMPERATURE = 0.5
#: Rates above this are split; the table of a distribution has ``LAST`` + 1 entries.
PART = 16.0
LAST = 100
MAX_BROADCAST_SOURCES = 100_000


def uniform(*key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 of the key."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *key).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def rates(docs: DataFrame, *, source_col: str = "source", text_col: str = "text", weights: DataFrame | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(src, chars, rate): mean copies of a document of each source.

    ``weights`` (src, weight) gives target weights, in any unit; without it they follow from
    ``temperature``.
    """
    have = docs.groupBy(F.col(source_col).alias("src")).agg(F.sum(F.coalesce(F.char_length(text_col), F.lit(0)).cast("long")).alias("chars"))
    if weights is None:
        have = have.withColumn("weight", F.when(F.col("chars") > 0, F.pow(F.col("chars").cast("double"), F.lit(temperature))).otherwise(0.0))
    else:
        want = weights.select(F.col("src").alias("w_src"), F.col("weight").cast("double").alias("weight"))
        have = have.join(want, F.col("src").eqNullSafe(F.col("w_src")), "left").drop("w_src").withColumn("weight", F.when((F.col("weight") > 0) & (F.col("chars") > 0), F.col("weight")).otherwise(0.0))
    have = written(have, "source-sizes")
    all_chars, all_weight = have.agg(F.sum("chars"), F.sum("weight")).first()
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.lit(all_weight) * F.lit(all_chars) / F.col("chars")).otherwise(0.0)
    return have.select("src", "chars", F.round(rate, 9).alias("rate"))


def _distribution(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. LAST of a Poisson variable with mean ``rate``."""
    step = lambda a, k: F.struct((a["p"] * rate / F.greatest(k, F.lit(1)).cast("double")).alias("p"), a["c"].alias("c"))
    first = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(LAST)),
        first,
        lambda a, k: F.struct(step(a, k)["p"].alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + step(a, k)["p"])).alias("c")),
    )
    return grown["c"]


def mixed(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: DataFrame | None = None,
    temperature: float = TEMPERATURE,
    seed: int = SEED,
    shuffle: bool = True,
) -> DataFrame:
    """The rows of ``docs`` repeated to the target weights and shuffled, with mix_copy, mix_copies, mix_order."""
    rate = rates(docs, source_col=source_col, text_col=text_col, weights=weights, temperature=temperature)
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    src, n_parts, cdf, name = fresh_names(docs, "mix_src", "mix_parts", "mix_cdf", "mix_name")
    table = rate.where("rate > 0").select(F.col("src").alias(src), parts.alias(n_parts), _distribution(F.col("rate") / parts).alias(cdf))
    # Rows without an identifier draw by their place in the input, so that each has a draw of its own.
    named = docs.withColumn(name, F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.monotonically_increasing_id().cast("string"))))
    known = named.join(sized_broadcast(table, MAX_BROADCAST_SOURCES), F.col(source_col).eqNullSafe(F.col(src)))

    def draw(j: Column) -> Column:
        u = uniform(F.lit(str(seed)), F.col(name), j.cast("string"))
        return F.size(F.filter(cdf, lambda c: c <= u))

    count = F.when(F.col(n_parts) == 1, draw(F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(0), F.col(n_parts) - 1), F.lit(0), lambda a, j: a + draw(j)))
    many = known.withColumn("mix_copies", count).where("mix_copies > 0").drop(src, n_parts, cdf)
    many = many.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.col(name), F.col("mix_copy").cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    many = many.withColumn("mix_order", order).drop(name)
    # A hash-dealt, hash-sorted table: partitions are random samples in random order.
    return many.repartition("mix_order").sortWithinPartitions("mix_order") if shuffle else many
