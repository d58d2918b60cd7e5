"""Quality rules with cross-document line frequency (operator 7).

Method: lines are normalised (A-Z lower-cased, white space collapsed) and hashed; for each host the
distinct documents that hold a line are counted; lines above the limit are removed, and a document
is rejected when too little of it remains.  Base rules on the single text come first.

What counts as one document: equal texts, and near copies by operator 1 at its own setting (word
4-grams of the whole text, a Jaccard similarity of 85 % or more, and what such links connect); a crawl
holds a page many times with small edits, and each of its lines would be frequent otherwise.  Pages
that differ in less than that, however many, are therefore one document (say ten shared lines and one
word of their own), and don't make their lines frequent; pages that share lines but differ in a sixth
of their text or more count each.  Only texts that hold a line above the limit are compared.

Scale: texts are read once for the counts and never shuffled; what moves is a row (host, line, text
hash) for each distinct line of a document, first grouped by all three, so neither a hot host nor a
hot line lands in one task, then counted with partial sums.  Texts with a frequent line are read
again by operator 1.  Frequent lines meet the documents' in equi-joins that Spark can split.

Defined cases: null texts have no words (n_words 0, base_failed); a null host is a host of its own;
rows are told apart by position, so repeated rows and null identifiers each get a row (and the same
verdict); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billcov.functions.sizing import sized_broadcast
from billcov.llm import ngram_join
from billcov.llm import words as W
from billcov.llm.common import fresh_names, written

#: A line that stands in more distinct documents of a host than this is boilerplate.
MAX_DOCS_PER_HOST = 20
#: Shorter lines (in words) are left alone by default; the query and the pipeline count lines of any length.
MIN_LINE_WORDS = 3
#: A document is depleted when less than this share (percent) of its words remains.
MIN_REMAINING_PERCENT = 20
#: Base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SCAN = (
    "rid long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, "
    "lines array<struct<line: long, words: long>>"
)

#: Texts with a frequent line whose hashes may be broadcast.
MAX_BROADCAST = 1_000_000

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _lines(raw: np.ndarray, offsets: np.ndarray, w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, index of first word, end of words) of every line that has a word."""
    first = np.searchsorted(offsets, w.start, side="right")
    breaks = np.cumsum(raw == 10)
    line = breaks[w.start] + first  # grows by one at least with each line and each document
    at = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    end = np.append(at[1:], len(line))
    newline = np.flatnonzero(raw == 10)
    starts, ends = w.start[at], w.end[end - 1] if len(at) else np.zeros(0, np.int64)
    padded = np.concatenate([[-1], newline, [len(raw)]])
    k = np.searchsorted(newline, starts)
    begin = np.maximum(padded[k] + 1, offsets[w.doc[at]])
    stop = np.minimum(padded[np.searchsorted(newline, ends) + 1], offsets[w.doc[at] + 1])
    return begin, stop, at, end


def line_hashes(low: W.Words, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each line's words in order (signed, as Spark's long)."""
    if not len(at):
        return np.zeros(0, np.int64)
    place = np.arange(len(low.hash)) - np.repeat(at, end - at)
    weight = W.powers(W.STEP, int(place.max()) + 1)[place]
    return W.mix(np.add.reduceat(low.hash * weight, at)).view(np.int64)


def _distinct_lines(doc: np.ndarray, norm: np.ndarray, size: np.ndarray, n: int) -> pa.Array:
    """For each document its different lines, by hash, with all their words."""
    order = np.lexsort((norm, doc))
    d, h = doc[order], norm[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    words = np.add.reduceat(size[order], at) if len(at) else np.zeros(0, np.int64)
    lines = pa.StructArray.from_arrays([pa.array(h[at], pa.int64()), pa.array(words, pa.int64())], names=["line", "words"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(d[at], np.arange(n + 1)), pa.int32()), lines)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rid = TaskContext.get().partitionId() << 40
    for batch in batches:
        for i, raw, offsets in W.slices(batch.column(2)):
            n = len(offsets) - 1
            prefix = W.Prefix(raw)
            w = W.words_of(raw, offsets, prefix=prefix)
            n_words = np.bincount(w.doc, minlength=n)
            begins = (raw & 0xC0) != 0x80
            chars = W.per_doc_sum(begins & ~W.SPACE[raw], offsets)
            symbols = W.per_doc_sum(_SYMBOL[raw], offsets)
            first, h = W.windows(w, 3)
            key = W.mix(h + w.doc[first].astype(np.uint64) * np.uint64(W.BASE))
            _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
            again = first[count[inverse] > 1] if len(first) else first
            marked = np.zeros(len(w.doc), dtype=bool)
            for k in range(3):
                marked[again + k] = True
            repeat = np.bincount(w.doc[marked], minlength=n)
            begin, stop, at, end = _lines(raw, offsets, w)
            doc = w.doc[at]
            same = W.mix(prefix.hash(begin, stop) + doc.astype(np.uint64) * np.uint64(W.BASE))
            fresh = np.unique(same, return_index=True)[1]
            dup = np.bincount(doc, minlength=n) - np.bincount(doc[fresh], minlength=n)
            low = W.words_of(W.LOWER[raw], offsets)
            norm, size = line_hashes(low, at, end), end - at
            lines = _distinct_lines(doc, norm, size, n)
            part = batch.slice(i, n)
            yield pa.record_batch(
                [
                    pa.array(range(rid, rid + n), pa.int64()),
                    part.column(0),
                    part.column(1),
                    pa.array(n_words, pa.int64()),
                    pa.array(chars, pa.int64()),
                    pa.array(symbols, pa.int64()),
                    pa.array(dup, pa.int64()),
                    pa.array(repeat, pa.int64()),
                    part.column(3),
                    lines,
                ],
                names=["rid", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_hash", "lines"],
            )
            rid += n


def _on(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Null-safe join on ``names``, which stay once."""
    other = right.select(*[F.col(c).alias(f"_{c}" if c in names else c) for c in right.columns])
    return left.join(other, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]), how).drop(*[f"_{c}" for c in names])


def _near_copies(docs: DataFrame, id_col: str, host_col: str, text_col: str, hits: DataFrame, scan: DataFrame) -> DataFrame:
    """(text_hash, document) of each text in ``hits``: near copies are one document."""
    # One row stands for equal texts: the one of the smallest identifier and host (and rows that repeat these).
    named = hits.select("rid").distinct().join(scan.select("rid", "doc_id", "host", "text_hash"), "rid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col("host").isNull().alias("nowhere"), "host"))
    wanted = written(named.groupBy(F.col("text_hash").alias("w_text")).agg(first.alias("w")).select("w_text", F.col("w.doc_id").alias("w_id"), F.col("w.host").alias("w_host")), "line-texts")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), _text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    chosen = (F.col("text_hash") == F.col("w_text")) & F.col("id").eqNullSafe(F.col("w_id")) & F.col("host").eqNullSafe(F.col("w_host"))
    held = texts.join(sized_broadcast(wanted, MAX_BROADCAST), chosen, "left_semi").select("text_hash", "text")
    return ngram_join.ngram_components(held, id_col="text_hash", element="<u4").select(F.col("doc_id").alias("text_hash"), F.col("component_id").alias("document")).distinct()


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("binary"))


def quality_rules(docs: DataFrame, **options: object) -> DataFrame:
    """One row per document: the counts, base_failed, n_removed_words, removed_lines (hashes), kept."""
    return _verdicts(docs, **options).drop("host", "text_hash")


def _verdicts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    max_docs_per_host: int = MAX_DOCS_PER_HOST,
    min_line_words: int = MIN_LINE_WORDS,
    min_remaining_percent: int = MIN_REMAINING_PERCENT,
) -> DataFrame:
    """The rows of ``quality_rules`` with host and text_hash, which a verdict depends on."""
    scan = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("binary").alias("text"), _text_hash(text_col).alias("text_hash")).mapInArrow(
            W.tidied(_scan), SCAN
        ),
        "line-scan",
    )
    lines = scan.select("rid", "host", "text_hash", F.explode("lines").alias("l")).select("rid", "host", "text_hash", "l.line", "l.words").where(F.col("words") >= min_line_words)
    # Before copies are folded: no other line can be above the limit.  Small tables are written, so that Spark knows their size before it moves the lines.
    common = written(
        lines.groupBy("host", "line", "text_hash")
        .agg(F.lit(1).alias("one"))
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("texts"))
        .where(F.col("texts") > max_docs_per_host),
        "common-lines",
    )
    hits = written(_on(lines, common, "host", "line"), "line-hits")
    if hits.isEmpty():
        frequent = common.select("host", "line")
    else:
        holding = hits.groupBy("host", "line", "text_hash").agg(F.lit(1).alias("one")).drop("one")
        near = written(_near_copies(docs, id_col, host_col, text_col, hits, scan), "line-documents")
        frequent = written(
            _on(holding, near, "text_hash")
            .groupBy("host", "line", "document")
            .agg(F.lit(1).alias("one"))
            .groupBy("host", "line")
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > max_docs_per_host)
            .select("host", "line"),
            "frequent-lines",
        )
    removed = (
        _on(hits, frequent, "host", "line")
        .groupBy("rid")
        .agg(F.sum("words").alias("n_removed_words"), F.sort_array(F.collect_list("line")).alias("removed_lines"))
    )
    out = scan.drop("lines").join(removed, "rid", "left")
    gone = F.coalesce("n_removed_words", F.lit(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - gone) < min_remaining_percent * F.col("n_words")
    return out.select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        gone.alias("n_removed_words"), F.coalesce("removed_lines", F.array().cast("array<long>")).alias("removed_lines"),
        (~failed & ~depleted).alias("kept"),
    )


def without_lines(docs: DataFrame, verdicts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines in ``verdicts.removed_lines`` taken out of ``text_col`` (by identifier)."""
    ident, lost = fresh_names(docs, "verdict_id", "lost_lines")
    v = verdicts.select(F.col("doc_id").alias(ident), F.col("removed_lines").alias(lost))
    both = docs.join(v, docs[id_col].eqNullSafe(v[ident]), "left").drop(ident)
    kind = both.schema[text_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            k, g = names.index(text_col), names.index(lost)
            out = [None if t is None else cut(t, set(gone or ())) for t, gone in zip(batch.column(k).to_pylist(), batch.column(g).to_pylist())]
            cols = [pa.array(out, batch.column(k).type) if j == k else c for j, c in enumerate(batch.columns) if j != g]
            yield pa.record_batch(cols, names=[x for x in names if x != lost])

    def cut(text: str, gone: set[int]) -> str:
        if not gone:
            return text
        lines = text.split("\n")
        raw = [x.encode() for x in lines]
        data = W.LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        w = W.words_of(data, offsets)
        at = np.flatnonzero(np.concatenate([[True], w.doc[1:] != w.doc[:-1]])) if len(w.doc) else np.zeros(0, np.int64)
        h = line_hashes(w, at, np.append(at[1:], len(w.doc)))
        drop = {int(d) for d, x in zip(w.doc[at], h) if int(x) in gone}
        return "\n".join(x for i, x in enumerate(lines) if i not in drop)

    schema = both.drop(lost).schema
    assert kind.simpleString() == "string"
    return both.mapInArrow(W.tidied(run), schema)


def kept_documents(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` that pass, texts unchanged (copies stay equal for the deduplication after it).

    Rows meet their verdicts by identifier, host and text: rows that agree in these have one verdict.
    """
    ident, host, text = fresh_names(docs, "verdict_id", "verdict_host", "verdict_text")
    verdicts = _verdicts(docs, id_col=id_col, host_col=host_col, text_col=text_col, **options)
    keep = verdicts.where("kept").select(F.col("doc_id").alias(ident), F.col("host").alias(host), F.col("text_hash").alias(text))
    same = F.col(id_col).cast("long").eqNullSafe(F.col(ident)) & F.col(host_col).cast("string").eqNullSafe(F.col(host)) & (_text_hash(text_col) == F.col(text))
    return docs.join(keep, same, "left_semi")
