"""N-gram Jaccard join (operator 1): exact links of documents by their word shingles, and components.

Method: size-banded tiles with hashed bitmap signatures.  Bit counts of two signatures bound the
overlap from above; only pairs that the bound lets through are intersected exactly, as sorted
arrays.

1. Documents with equal shingle sets are one class; from here on classes stand for documents.
2. Two linked sets share a shingle among the first ``n - ceil(t * n) + 1`` of each, in any common
   order.  The order is: rare shingles first, by hash, frequent ones last, so that passages which
   many documents share bring nobody together.  Which shingles count as frequent only changes the
   order, never the result; their list has a fixed bound and is broadcast.
3. Entries (shingle, class, size) are dealt by shingle in packed arrays.  A shingle with at most
   ``RUN`` classes gives its pairs of compatible size, which signatures thin out.  Larger runs, and
   frequent shingles, are only grouped.  Classes that a remaining pair or a large run connects are
   a family; linked classes are always of one family.
4. A family of up to ``TILE`` classes is one tile.  Larger ones are cut into size bands, and bands
   into blocks; a tile compares two blocks of the same or of neighbouring bands by signatures, then
   exactly, and skips what it has already joined.  It gives at most one link for each class, which
   is enough for components.
5. Links give components by alternating stars.

No step sends all pairs of a group: copies are one class, families give spanning links.  Nothing is
capped: every linked pair is tested or already connected by tested links.

Scale: texts are read three times and never shuffled unless the classes to verify are too many to
broadcast; what moves is about 15 % of the shingles (20 bytes each), then the sets of the classes
that have candidates.

Defined cases: null or empty texts and texts without words have no shingles and stay alone; rows
with a null identifier take the component of their identified copies, and stay alone (component_id
null) without such; repeated rows are copies; extra columns are ignored; an empty table gives no
rows.  Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billcov.functions.sizing import sized_broadcast
from billcov.llm import words as W
from billcov.llm.common import fresh_names, written
from billcov.llm.components import components, stars

SHINGLE = 4
THRESHOLD = 85
#: Largest number of classes of a shingle whose pairs are listed.
RUN = 64
#: Classes, and shingles of these, in a block of a tile, on average.
TILE = 2048
TILE_SHINGLES = 4 << 20
#: A shingle is frequent from so many prefix entries on; the list keeps the most frequent ones.
FREQUENT = 16
MAX_FREQUENT = 1 << 20
#: Entries of a bucket that one task sorts at a time, on average.
BUCKET_ENTRIES = 1 << 20
#: Classes to verify that may be broadcast (identifiers only).
MAX_BROADCAST = 1_000_000

U64 = np.uint64


def needed(n: np.ndarray | int, t: int) -> np.ndarray | int:
    """Smallest overlap that a set of ``n`` must have with a linked one: ceil(t / 100 * n)."""
    return (t * n + 99) // 100


def linked(overlap: int, a: int, b: int, t: int) -> bool:
    return 100 * overlap >= t * (a + b - overlap)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document, sorted, back to back; bounds by document."""
    n = len(offsets) - 1
    w = W.words_of(W.LOWER[raw], offsets)
    first, h = W.windows(w, k)
    cut = np.searchsorted(w.doc[first], np.arange(n + 1))
    word = np.searchsorted(w.doc, np.arange(n + 1))
    parts = []
    for d in range(n):
        a, b = cut[d], cut[d + 1]
        if b > a:
            parts.append(np.unique(h[a:b]))
        elif word[d + 1] > word[d]:  # fewer than k words: the whole sequence is one shingle
            x = np.array([word[d + 1] - word[d]], dtype=U64)
            for v in w.hash[word[d] : word[d + 1]]:
                x = W.mix(x * U64(W.STEP) + v)
            parts.append(x)
        else:
            parts.append(np.zeros(0, U64))
    size = np.array([len(p) for p in parts])
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(size)])


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit key of every set, whatever its order, as Spark's long."""
    sums = np.zeros(len(sets) + 1, dtype=U64)
    np.cumsum(W.mix(sets ^ U64(W.BASE)), out=sums[1:])
    n = np.diff(bounds).astype(U64)
    return W.mix(sums[bounds[1:]] - sums[bounds[:-1]] + n * U64(W.STEP)).view(np.int64)


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def _prefixes(sets: np.ndarray, bounds: np.ndarray, t: int, which: np.ndarray, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, document, is frequent) of the prefix of each document in ``which``."""
    rare_last = None
    if frequent is not None and len(frequent):
        at = np.searchsorted(frequent, sets)
        at[at == len(frequent)] = 0
        rare_last = frequent[at] == sets
    shingles, doc, hot = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for d in which:
        a, b = bounds[d], bounds[d + 1]
        p = b - a - needed(int(b - a), t) + 1
        x = sets[a:b]
        f = rare_last[a:b] if rare_last is not None else None
        if f is not None and f.any():
            order = np.argsort(f, kind="stable")[:p]
            shingles.append(x[order])
            hot.append(f[order])
        else:
            shingles.append(x[:p])
            hot.append(np.zeros(p, bool))
        doc.append(np.full(p, d))
    return np.concatenate(shingles), np.concatenate(doc), np.concatenate(hot)


def _first_pass(k: int, t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, n, key), and rows (shingle, count) of prefix shingles that the task saw again."""
        seen: set[int] = set()
        held: list[np.ndarray] = []
        total = 0

        def out(doc=(), n=(), key=(), shingle=(), count=()) -> pa.RecordBatch:
            size = max(len(doc), len(shingle))
            none = pa.nulls(size, pa.int64())
            cols = [pa.array(c, pa.int64()) if len(c) else none for c in (n, key, shingle, count)]
            return pa.record_batch([doc if len(doc) else none, *cols], names=["doc_id", "n", "key", "shingle", "count"])

        def flush() -> pa.RecordBatch:
            nonlocal total
            v, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            total = 0
            return out(shingle=v[c > 1].view(np.int64), count=c[c > 1])

        for batch in batches:
            for i, raw, offsets in W.slices(batch.column(1)):
                sets, bounds = shingle_sets(raw, offsets, k)
                keys, n = set_keys(sets, bounds), np.diff(bounds)
                yield out(batch.column(0).slice(i, len(n)), n, keys)
                fresh = [d for d, key in enumerate(keys.tolist()) if n[d] and key not in seen and not seen.add(key)]
                h, _, _ = _prefixes(sets, bounds, t, fresh)
                held.append(h)
                total += len(h)
                if total > 4 << 20:
                    yield flush()
        if held:
            yield flush()

    return run


def _second_pass(k: int, t: int, buckets: int, frequent):
    shift = U64(64 - buckets.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed prefix entries by bucket; those of frequent shingles go to buckets below zero, in turn."""
        often = frequent.value
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal total
            h, key, n, hot = (np.concatenate(x) for x in zip(*held))
            held.clear()
            total = 0
            bucket = (h >> shift).astype(np.int64) if buckets > 1 else np.zeros(len(h), np.int64)
            bucket[hot] = -1 - (W.mix(key[hot].view(U64)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else np.zeros(0, np.int64)
            ends = np.append(at[1:], len(order))
            blob = lambda x: pa.array([x[order[a:b]].tobytes() for a, b in zip(at, ends)], pa.binary())
            return pa.record_batch([pa.array(bucket[order[at]], pa.int64()), blob(h), blob(key), blob(n.astype(np.int32))], names=["bucket", "h", "key", "n"])

        for batch in batches:
            for _, raw, offsets in W.slices(batch.column(1)):
                sets, bounds = shingle_sets(raw, offsets, k)
                keys, n = set_keys(sets, bounds), np.diff(bounds)
                fresh = [d for d, key in enumerate(keys.tolist()) if n[d] and key not in seen and not seen.add(key)]
                h, d, hot = _prefixes(sets, bounds, t, fresh, often)
                held.append((h, keys[d], n[d], hot))
                total += len(h)
                if total > 1 << 20:
                    yield flush()
        if total:
            yield flush()

    return run


CANDIDATES = "a long, b long, run long, key long, n long"


def _bucket(t: int, run_limit: int):
    def pairs(group: pa.Table) -> pa.Table:
        """Candidate pairs (a, b) of small runs; members (run, key, n) of large ones."""
        read = lambda c, kind: np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=kind)
        bucket = group.column("bucket")[0].as_py()
        h, key, n = read("h", "<u8"), read("key", "<i8"), read("n", "<i4").astype(np.int64)
        order = np.lexsort((key, n, h))
        h, key, n = h[order], key[order], n[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
        h, key, n = h[fresh], key[fresh], n[fresh]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(at, len(h)))
        if bucket >= 0:
            several = np.repeat(size > 1, size)
            h, key, n, size = h[several], key[several], n[several], size[size > 1]
            at = np.cumsum(size) - size
        large = np.ones(len(h), bool) if bucket < 0 else np.repeat(size > run_limit, size)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if bucket >= 0:
            # Members of a run are in order of size: at distance k in the run, for all runs at once.
            place = np.arange(len(h)) - np.repeat(at, size)
            for k in range(1, int(min(size.max(initial=1), run_limit))):
                i = np.flatnonzero((place >= k) & ~large)
                i = i[t * n[i] <= 100 * n[i - k]]
                left.append(np.minimum(key[i], key[i - k]))
                right.append(np.maximum(key[i], key[i - k]))
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
        m = int(large.sum())
        p = len(both)
        pad = lambda x, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(x, pa.int64()), pa.nulls(after, pa.int64())])
        return pa.table(
            {
                "a": pad(both[:, 0], 0, m),
                "b": pad(both[:, 1], 0, m),
                "run": pad(h[large].view(np.int64), p, 0),
                "key": pad(key[large], p, 0),
                "n": pad(n[large], p, 0),
            }
        )

    return pairs


def signature(x: np.ndarray) -> tuple[int, int]:
    """(width, bits): a bit for the low bits of each hash; about four bits of room for each element."""
    width = 1 << max(6, min(13, int(4 * len(x) - 1).bit_length()))
    flags = np.zeros(width, bool)
    flags[(x & U64(width - 1)).astype(np.int64)] = True
    return width, int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")


def folded(width: int, bits: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


def bound(a: tuple[int, int, int], b: tuple[int, int, int]) -> int:
    """Upper bound of the overlap of two sets given (size, width, bits): a bit of one that the other lacks is an element outside."""
    to = min(a[1], b[1])
    x, y = folded(a[1], a[2], to), folded(b[1], b[2], to)
    return min(a[0] - (x & ~y).bit_count(), b[0] - (y & ~x).bit_count())


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _sets_pass(k: int, element: str = "<u8"):
    """Rows (key, n, bits, elements); ``element``: type of an element, ``<u4`` keeps half of each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, offsets in W.slices(batch.column(0)):
                sets, bounds = shingle_sets(raw, offsets, k)
                keys = set_keys(sets, bounds).tolist()
                parts = [sets[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
                sig = [signature(x) for x in parts]
                yield pa.record_batch(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array([len(x) for x in parts], pa.int64()),
                        pa.array([bits.to_bytes(width // 8, "little") for width, bits in sig], pa.binary()),
                        pa.array([(x if element == "<u8" else np.unique((x >> U64(32)).astype(element))).tobytes() for x in parts], pa.binary()),
                    ],
                    names=["key", "n", "bits", "elements"],
                )

    return run


def _once(run):
    """The rows of ``run`` without those whose key the task has given before."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in run(batches):
            yield batch.filter(pa.array([k not in seen and not seen.add(k) for k in batch.column(0).to_pylist()], pa.bool_()))

    return inner


def _bounded(t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that the signatures let through."""
        for batch in batches:
            c = batch.to_pydict()
            sig = lambda n, b: (n, 8 * len(b), int.from_bytes(b, "little"))
            ok = [linked(bound(sig(m, x), sig(n, y)), m, n, t) for m, x, n, y in zip(c["a_n"], c["a_bits"], c["b_n"], c["b_bits"])]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def tile_links(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, t: int) -> list[tuple[int, int]]:
    """Spanning links of a tile.  side: 0 and 1 for its two blocks, compared with each other; 2 for one block with itself."""
    m = len(sets)
    n = np.array([len(x) for x in sets])
    width = 1 << max(6, min(12, int(4 * int(np.median(n)) - 1).bit_length()))
    bits = np.zeros((m, width // 64), U64)
    for i, x in enumerate(sets):
        low = x & U64(width - 1)
        np.bitwise_or.at(bits[i], (low >> U64(6)).astype(np.int64), U64(1) << (low & U64(63)))
    order = np.lexsort((keys, n))
    n, bits, side, keys, sets = n[order], bits[order], side[order], keys[order], [sets[i] for i in order]
    group = np.arange(m)
    links = []
    for i in range(m):
        hi = int(np.searchsorted(n, 100 * n[i] // t, side="right"))
        j = np.arange(i + 1, hi)
        j = j[(group[j] != group[i]) & ((side[j] != side[i]) | (side[i] == 2))]
        if not len(j):
            continue
        x, y = bits[i], bits[j]
        most = np.minimum(n[i] - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), n[j] - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
        ok = 100 * most >= t * (n[i] + n[j] - most)
        for c in j[ok][np.argsort(-most[ok], kind="stable")].tolist():
            if group[c] != group[i] and linked(overlap(sets[i], sets[c]), int(n[i]), int(n[c]), t):
                links.append((int(keys[i]), int(keys[c])))
                group[group == group[c]] = group[i]
    return links


def _tile(t: int, element: str = "<u8"):
    def run(group: pa.Table) -> pa.Table:
        keys, one = np.unique(group.column("key").to_numpy(), return_index=True)  # copies with one identifier come once from each task
        elements = group.column("elements").to_pylist()
        links = stars(iter(tile_links(keys, [np.frombuffer(elements[i], dtype=element).astype(U64) for i in one], group.column("side").to_numpy()[one], t)))
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return run


def _frequent_shingles(scan: DataFrame, at_least: int, most: int) -> np.ndarray:
    """The most frequent prefix shingles, at most ``most``: from the smallest power of two on that keeps to it."""
    counts = scan.where("shingle is not null").groupBy("shingle").agg(F.sum("count").alias("c")).where(F.col("c") >= at_least)
    counts = written(counts, "frequent")
    floor = at_least
    steps = {int(r[0]): r[1] for r in counts.groupBy(F.floor(F.log2(F.col("c") / at_least)).alias("s")).count().collect()}
    while sum(steps.values()) > most:
        steps.pop(min(steps))
        floor = at_least << min(steps, default=62)
    got = counts.where(F.col("c") >= floor).select("shingle").toArrow().column(0).to_numpy()
    return np.sort(got.astype(np.int64).view(U64))


def _stars(members: DataFrame) -> DataFrame:
    """(u, v) between the classes of a large run and the first of them."""
    hub = members.groupBy("run").agg(F.min("key").alias("hub"), F.max("key").alias("far")).where("hub != far").select(F.col("run").alias("r"), "hub")
    return members.join(hub, F.col("run") == F.col("r")).select(F.col("key").alias("u"), F.col("hub").alias("v"))


def _spots(classes: DataFrame, t: int, tile: int) -> DataFrame:
    """(key, family, low, i, high, j, side): the tiles that a class (key, n, family) goes to.

    A family of at most ``tile`` classes is one tile.  Larger ones are cut into size bands, bands
    into blocks; blocks meet within a band and with those of the next band.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / t)) + 1e-9).cast("int")
    rows = classes.withColumn("band", band)
    load = F.greatest(F.count(F.lit(1)) / tile, F.sum("n") / TILE_SHINGLES)  # in blocks
    size = rows.groupBy("family", "band").agg(load.alias("load"))
    whole = size.groupBy("family").agg(F.sum("load").alias("all"))
    count = size.join(whole, "family").select("family", "band", "all", F.ceil("load").cast("int").alias("blocks"))
    near = lambda step, name: count.select("family", (F.col("band") - step).alias("band"), F.col("blocks").alias(name))
    blocks = count.join(near(1, "above"), ["family", "band"], "left").join(near(-1, "below"), ["family", "band"], "left").fillna(0, ["above", "below"])
    rows = rows.join(blocks, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    spot = lambda low, i, high, j, side: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), side.alias("side"))
    b, me, zero, one, two = F.col("band"), F.col("block"), F.lit(0), F.lit(1), F.lit(2)
    upto = lambda c: F.when(c > 0, F.sequence(zero, c - 1)).otherwise(F.array().cast("array<int>"))

    def same(j: Column) -> Column:
        return spot(b, F.least(me, j), b, F.greatest(me, j), F.when(me == j, two).when(me < j, zero).otherwise(one))

    many = F.concat(
        F.transform(upto(F.col("blocks")), same),
        F.transform(upto(F.col("above")), lambda j: spot(b, me, b + 1, j, zero)),
        F.transform(upto(F.col("below")), lambda j: spot(b - 1, j, b, me, one)),
    )
    single = F.array(spot(F.lit(-1), zero, F.lit(-1), zero, two))
    return rows.select("key", "family", F.explode(F.when(F.col("all") <= 1, single).otherwise(many)).alias("s")).select(
        "key", "family", "s.low", "s.i", "s.high", "s.j", F.col("s.side").cast("long").alias("side")
    )


def ngram_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD, run_limit: int = RUN, tile: int = TILE, frequent_from: int = FREQUENT, element: str = "<u8") -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n, key; links: u, v between keys of classes) with 100 * overlap >= threshold * union."""
    spark = docs.sparkSession
    texts = _docs(docs, id_col, text_col)
    scan = written(texts.mapInArrow(W.tidied(_first_pass(shingle, threshold)), "doc_id long, n long, key long, shingle long, count long"), "shingle-scan")
    documents = scan.where("n is not null").select("doc_id", "n", "key")
    frequent = spark.sparkContext.broadcast(_frequent_shingles(scan, frequent_from, MAX_FREQUENT))
    total = documents.agg(F.sum("n")).first()[0] or 0
    entries = total * (100 - threshold) // 100 + 1
    buckets = 1 << max(6, (entries // BUCKET_ENTRIES).bit_length())
    packed = texts.mapInArrow(W.tidied(_second_pass(shingle, threshold, buckets, frequent)), "bucket long, h binary, key binary, n binary")
    found = written(packed.groupBy("bucket").applyInArrow(_bucket(threshold, run_limit), CANDIDATES), "candidates")
    pairs = found.where("a is not null").select("a", "b").distinct()
    members = found.where("run is not null").select("run", "key")
    wanted = written(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(members.select("key")).distinct(), "wanted")
    # One document stands for its class; its text gives the set again.
    named = documents.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    chosen = sized_broadcast(named.join(wanted, "key").select(F.col("doc_id").alias("rep"), F.col("key").alias("rep_key")), MAX_BROADCAST)
    again = texts.join(chosen, texts["doc_id"] == chosen["rep"]).select("text", "rep_key")
    sets = written(again.select("text").mapInArrow(W.tidied(_once(_sets_pass(shingle, element))), "key long, n long, bits binary, elements binary"), "sets")
    one = sets.select("key", "n", "bits")
    if sets.groupBy("key").count().where("count > 1").limit(1).count():  # only rows repeated with their identifier
        one = one.dropDuplicates(["key"])
    small = lambda x: one.select(F.col("key").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    both = pairs.join(small("a"), "a").join(small("b"), "b").select("a", "b", "a_n", "a_bits", "b_n", "b_bits")
    likely = both.mapInArrow(W.tidied(_bounded(threshold)), "u long, v long")
    families = components(likely.unionByName(_stars(members))).select(F.col("node").alias("key"), F.col("component").alias("family"))
    spots = written(_spots(one.select("key", "n").join(families, "key"), threshold, tile), "tiles")
    placed = sets.select("key", "elements").join(sized_broadcast(spots, MAX_BROADCAST), "key")
    return documents, placed.groupBy("family", "low", "i", "high", "j").applyInArrow(_tile(threshold, element), "u long, v long")


def ngram_components(docs: DataFrame, **options: object) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    documents, links = ngram_links(docs, **options)
    nodes = components(links).select(F.col("node").alias("key"), "component")
    classes = documents.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("low")).join(nodes, "key", "left")
    group = F.coalesce("component", "key")
    least = classes.groupBy(group.alias("g")).agg(F.min("low").alias("component_id"))
    of_class = classes.select("key", group.alias("g")).join(least, "g").select(F.col("key").alias("k"), "component_id")
    return documents.join(of_class, (F.col("key") == F.col("k")) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows of ``docs`` whose identifier is the smallest of its component (rows without one stay)."""
    (kept,) = fresh_names(docs, "kept_id")
    keep = ngram_components(docs, id_col=id_col, **options).where("component_id is null or doc_id is null or doc_id = component_id").select(F.col("doc_id").alias(kept))
    return docs.join(keep, docs[id_col].eqNullSafe(keep[kept]), "left_semi")
