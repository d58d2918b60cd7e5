"""Near-duplicate documents by MinHash with tensored banding (operator 12).

Method: a document's set of word shingles gives two small collections of band keys, A and B, of
``ROWS`` minhashes each.  A table is a pair (A_i, B_j): ``BANDS`` keys of each collection make
``BANDS`` squared tables from 2 * BANDS * ROWS minhashes, where separate tables would need the square
of that.  Documents that share a table key are candidates; what is linked is decided on full sets.

A pair of similarity s shares some A_i with probability 1 - (1 - s**ROWS)**BANDS, and some B_j alike,
so at the threshold of 0.8 about 1 pair in 50,000 has no common table (at 0.85 fewer than one in a
million); in a group of copies a link that is missed this way hardly matters, as others connect it.

1. Documents with equal sets are one class; from here on classes stand for documents.
2. Entries (A_i, class, size, all B_j) are dealt by A_i.  Within an A_i, members are sorted by each B_j:
   runs of up to ``RUN`` classes give their pairs of compatible size, which bitmap signatures thin
   out; larger runs are only grouped (each member with the run's first).
3. An A_i that very many classes have (``HOT``) is dealt to several tasks; each groups its members and
   sends one of each run on, which are joined by the run's key.
4. Classes that a remaining pair or a run connects are a family; a family's sets are compared exactly
   in tiles of bounded size, which skip what they have joined already.  Links give components.

No pairs are listed inside large groups, nothing is capped, and every candidate is tested or connected
by tested links.

Scale: texts are read twice (keys, then the sets of classes that have candidates) and never shuffled;
what moves is ``BANDS`` rows of about 70 bytes for each class.

Defined cases: null or empty texts and texts without words have no shingles and stay alone; rows with
a null identifier take the component of their identified copies (and aren't kept), and stay alone
(component_id null, kept) without such; repeated rows are copies, and all rows of the smallest
identifier are kept; extra columns are ignored; an empty table gives no rows.  Shingles and sets are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billcov.functions.sizing import sized_broadcast
from billcov.llm import ngram_join as J
from billcov.llm import words as W
from billcov.llm.common import written
from billcov.llm.components import components

SHINGLE = 2
THRESHOLD = 80
#: Minhashes in a band key, and band keys in each of the two collections.
ROWS = 2
BANDS = 12
#: Largest number of classes of a table key whose pairs are listed.
RUN = 12
#: Classes with one A_i from which on it is dealt to several tasks, by so many classes each.
HOT = 1 << 14
#: Entries of a bucket that one task sorts at a time, on average.
BUCKET_ENTRIES = 1 << 17
#: Classes to verify, or tile places, that may be broadcast.
MAX_BROADCAST = 1_000_000

U64 = np.uint64
SEED = 0x2545F4914F6CDD1D


def minhashes(sets: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """(documents, n) smallest values of ``n`` hash functions over each set; empty sets have zeros."""
    out = np.zeros((len(bounds) - 1, n), dtype=U64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out
    at = bounds[:-1][full]  # empty sets take no room, so these are the bounds of the others
    for i in range(n):
        add = W.mix(np.array([SEED + i], dtype=U64))[0]
        x = (sets ^ add) * U64(W.MIX1)
        x = (x ^ (x >> U64(32))) * U64(W.MIX2)
        out[full, i] = np.minimum.reduceat(x, at)
    return out


def band_keys(sets: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A (64-bit, different for each band) and B (32-bit) keys of each set."""
    m = minhashes(sets, bounds, 2 * bands * rows).reshape(len(bounds) - 1, 2 * bands, rows)
    key = np.zeros(m.shape[:2], dtype=U64) + np.arange(2 * bands, dtype=U64)
    for r in range(rows):
        key = W.mix(key * U64(W.STEP) + m[:, :, r])
    return key[:, :bands], (key[:, bands:] >> U64(32)).astype(np.uint32)


def _scan(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw, offsets in W.slices(batch.column(1)):
                sets, bounds = J.shingle_sets(raw, offsets, k)
                a, b = band_keys(sets, bounds, bands, rows)
                n = len(offsets) - 1
                yield pa.record_batch(
                    [
                        batch.column(0).slice(i, n),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(J.set_keys(sets, bounds), pa.int64()),
                        pa.array([x.tobytes() for x in a.astype("<u8")], pa.binary()),
                        pa.array([x.tobytes() for x in b.astype("<u4")], pa.binary()),
                    ],
                    names=["doc_id", "n", "key", "a", "b"],
                )

    return run


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def _frequent(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A keys that the task saw again, with counts."""
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(v[c > 1].view(np.int64), pa.int64()), pa.array(c[c > 1], pa.int64())], names=["a", "count"])

        for batch in batches:
            held.append(_matrix(batch.column(0), "<u8", bands).ravel())
            size += len(held[-1])
            if size > 4 << 20:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _deal(bands: int, buckets: int, hot: dict[int, int]):
    """Packed entries by bucket; those of a hot A_i (value: its parts) go to buckets below zero."""
    shift = U64(64 - buckets.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.sort(np.array(list(hot), dtype=np.int64).view(U64))
        parts = np.array([hot[int(x)] for x in often.view(np.int64)], dtype=np.int64)
        for batch in batches:
            a, b = _matrix(batch.column("a"), "<u8", bands), _matrix(batch.column("b"), "<u4", bands)
            h = a.ravel()
            row = np.repeat(np.arange(len(a)), bands)
            bucket = (h >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, h), len(often) - 1)
                is_hot = often[at] == h
                # A hot key's entries take its parts in turn, by class.
                key = batch.column("key").to_numpy().view(U64)[row[is_hot]]
                part = (W.mix(key) % parts[at[is_hot]].astype(U64)).astype(np.int64)
                bucket[is_hot] = -1 - (W.mix(h[is_hot] + part.astype(U64) * U64(W.STEP)) >> U64(2)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(order))
            key, n = batch.column("key").to_numpy(), batch.column("n").to_numpy().astype(np.int32)
            blob = lambda x: pa.array([x[order[s:e]].tobytes() for s, e in zip(cut, ends)], pa.binary())
            yield pa.record_batch([pa.array(bucket[order[cut]], pa.int64()), blob(h), blob(key[row]), blob(n[row]), blob(b[row])], names=["bucket", "h", "key", "n", "b"])

    return run


FOUND = "u long, v long, tested boolean, run long"


def _candidates(t: int, bands: int, run_limit: int):
    def run(group: pa.Table) -> pa.Table:
        """Pairs (u, v) to test; untested links (u, v) of large runs; (run, u) of each run of a hot key."""
        read = lambda c, kind: np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=kind)
        hot = group.column("bucket")[0].as_py() < 0
        h, key, n = read("h", "<u8"), read("key", "<i8"), read("n", "<i4").astype(np.int64)
        b = read("b", "<u4").reshape(-1, bands)
        parts: list[tuple[np.ndarray, np.ndarray, bool]] = []
        heads: list[tuple[np.ndarray, np.ndarray]] = []
        for j in range(bands):
            order = np.lexsort((key, n, b[:, j], h))
            hj, bj, kj, nj = h[order], b[order, j], key[order], n[order]
            first = np.concatenate([[True], (hj[1:] != hj[:-1]) | (bj[1:] != bj[:-1])])
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, len(hj)))
            large = np.repeat(hot | (size > run_limit), size)
            place = np.arange(len(hj)) - np.repeat(at, size)
            hub = np.repeat(kj[at], size)
            away = large & (hub != kj)
            parts.append((np.minimum(hub, kj)[away], np.maximum(hub, kj)[away], False))
            if hot:
                heads.append(((W.mix(hj[at] + U64(j + 1) * U64(W.STEP)) ^ W.mix(bj[at].astype(U64))).view(np.int64), kj[at]))
                continue
            for d in range(1, int(min(size.max(initial=1), run_limit))):
                i = np.flatnonzero((place >= d) & ~large)
                i = i[t * nj[i] <= 100 * nj[i - d]]  # members are in order of size
                parts.append((np.minimum(kj[i], kj[i - d]), np.maximum(kj[i], kj[i - d]), True))
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for tested in (False, True):
            u, v = (np.concatenate([p[x] for p in parts if p[2] is tested] or [np.zeros(0, np.int64)]) for x in (0, 1))
            order = np.lexsort((v, u))
            u, v = u[order], v[order]
            new = np.ones(len(u), bool)
            new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            u, v = u[new], v[new]
            for c, x in zip(cols, (u, v, np.full(len(u), tested), np.zeros(len(u), np.int64))):
                c.append(x)
        for r, u in heads:
            for c, x in zip(cols, (u, u, np.zeros(len(u), bool), r)):
                c.append(x)
        u, v, tested, r = (np.concatenate(c) for c in cols)
        same = u == v  # the head of a hot run
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "tested": pa.array(tested, pa.bool_()), "run": pa.array(r, pa.int64(), mask=~same)})

    return run


def minhash_links(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS, run_limit: int = RUN, tile: int = J.TILE, hot_from: int = HOT
) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n, key; links: u, v between keys of classes) with 100 * overlap >= threshold * union."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    scan = written(texts.mapInArrow(W.tidied(_scan(shingle, bands, rows)), "doc_id long, n long, key long, a binary, b binary"), "minhash-scan")
    documents = scan.select("doc_id", "n", "key")
    classes = written(scan.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")), "minhash-classes")
    # The list is bounded: a hot key takes hot_from entries, so there are at most entries / hot_from of them.
    often = classes.select("a").mapInArrow(W.tidied(_frequent(bands)), "a long, count long").groupBy("a").agg(F.sum("count").alias("c")).where(F.col("c") >= hot_from)
    hot = {r["a"]: -(-r["c"] // hot_from) + 1 for r in often.collect()}
    entries = classes.count() * bands
    buckets = 1 << max(6, (entries // BUCKET_ENTRIES).bit_length())
    dealt = classes.select("key", "n", "a", "b").mapInArrow(W.tidied(_deal(bands, buckets, hot)), "bucket long, h binary, key binary, n binary, b binary")
    found = written(dealt.groupBy("bucket").applyInArrow(_candidates(threshold, bands, run_limit), FOUND), "minhash-candidates")
    pairs = found.where("tested").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    heads = found.where("run is not null").select("run", F.col("u").alias("key"))
    grouped = found.where("not tested and run is null").select("u", "v").unionByName(J._stars(heads)).distinct()
    grouped = written(grouped, "minhash-runs")
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).union(grouped.select("u")).union(grouped.select("v")).distinct()
    wanted = written(classes.where("rep is not null").select("key", "rep").join(wanted, F.col("key") == F.col("w")).select("rep", F.col("key").alias("rep_key")), "minhash-wanted")
    again = texts.join(sized_broadcast(wanted, MAX_BROADCAST), texts["doc_id"] == wanted["rep"]).select("text", "rep_key")
    # A repeated identifier may bring another text, and rows repeated with their identifier the same one.
    sets = again.mapInArrow(W.tidied(_sets(shingle)), "key long, n long, bits binary, elements binary")
    sets = written(sets.dropDuplicates(["key"]) if _repeats(documents) else sets, "minhash-sets")
    small = lambda x: sets.select(F.col("key").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    both = pairs.join(small("a"), "a").join(small("b"), "b").select("a", "b", "a_n", "a_bits", "b_n", "b_bits")
    likely = both.mapInArrow(W.tidied(J._bounded(threshold)), "u long, v long")
    families = components(likely.unionByName(grouped)).select(F.col("node").alias("key"), F.col("component").alias("family"))
    spots = written(J._spots(sets.select("key", "n").join(families, "key"), threshold, tile), "minhash-tiles")
    placed = sets.select("key", "elements").join(sized_broadcast(spots, MAX_BROADCAST), "key")
    return documents, placed.groupBy("family", "low", "i", "high", "j").applyInArrow(J._tile(threshold), "u long, v long")


def _repeats(documents: DataFrame) -> bool:
    return bool(documents.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count())


def _sets(k: int):
    inner = J._sets_pass(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets of the classes that are asked for."""
        for batch in batches:
            at, asked = 0, batch.column(1).to_numpy()
            for found in inner(iter([batch])):
                mine = asked[at : at + len(found)]
                at += len(found)
                yield found.filter(pa.array(found.column(0).to_numpy() == mine))

    return run


def minhash_components(docs: DataFrame, **options: object) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    documents, links = minhash_links(docs, **options)
    nodes = components(links).select(F.col("node").alias("key"), "component")
    classes = documents.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low")).join(nodes, "key", "left")
    group = F.coalesce("component", "key")
    least = classes.groupBy(group.alias("g")).agg(F.min("low").alias("component_id"))
    of_class = classes.select("key", group.alias("g")).join(least, "g").select(F.col("key").alias("k"), F.col("component_id").alias("c"))
    joined = documents.join(of_class, (F.col("key") == F.col("k")) & (F.col("n") > 0), "left")
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
