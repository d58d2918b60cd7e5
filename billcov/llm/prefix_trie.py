"""Conversation prefix trie (operator 11).

Method: conversations are sorted by their turns; the longest common prefix (LCP) of neighbours gives
an edge between them.  Edges are joined by union-find in descending depth: each merge of components
creates a branching node (or adds a child to the one that the last merge at this depth created), and
what lies between a component's top and the new node is a path of nodes with one child.  A node that
ends at the border of its chunk of sorted rows is contracted to its sums; the chunks' forests are
merged by adding up the sums of equal nodes.  Every sum is additive: a node's own tokens are counted
off once, in the chunk where it begins.

A conversation of any length: turns are cut into pieces of ``SPAN`` turns (16 bytes each).  Pieces
of a layer are sorted after what precedes them, so a layer is a forest below the nodes of the layer
before; its roots' sums are carried there.  A tail that no other conversation shares from its piece
on is a path and takes no part.

Scale: texts are read once and never shuffled; turns get their places from a global range sort, not
from a window by conversation.  Equal pieces are one row, by partial aggregation, so a group of copies
sends a row for each task.  Memory is a chunk of pieces.  What meets at the driver is two pieces for
each range partition.  The digest of the conversations that end at a node is serial by nature; they
are packed in ranges first and streamed.

Defined cases: rows with a null conv_id belong to no conversation and are left out; null role or
text is empty; a null turn is the first; turns of the same number follow role, then the digest of
the text; repeated rows are turns of their own; extra columns are ignored; without conversations
there are no nodes, not even a root.  Turns are compared by a 128-bit digest of role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billcov.functions.numbering import numbered
from billcov.functions.sizing import sized_broadcast
from billcov.llm import words as W
from billcov.llm.common import written

#: Turns in a piece, and bytes of a turn's digest.
SPAN = 4096
UNIT = 16
#: Pieces and bytes of them that are joined at a time.
CHUNK_ROWS = 16384
CHUNK_BYTES = 8 << 20
#: Identifiers that are packed before the digest.
PACK = 256
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

NODES = "open boolean, id string, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, parent_conv_id long, parent string, root boolean, start string"


def turn_digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 0), digest (hex), words: the turns of each conversation in order."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    )
    rows = numbered(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], "at").drop("turn", "role")
    first = rows.groupBy("conv_id").agg(F.min("at").alias("first")).withColumnRenamed("conv_id", "c")
    return rows.join(first, F.col("conv_id") == F.col("c")).select("conv_id", (F.col("at") - F.col("first")).alias("place"), "digest", "words")


def with_shared_heads(own: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id; turns) in which the first h = crc32(conv_id) % heads turns are those of conversation conv_id - conv_id % block."""
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = sizes.select(F.col("conv_id").alias("b"), F.col("n").alias("base_n"))
    convs = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base")).join(base, F.col("base") == F.col("b"), "left")
    convs = written(convs.select("conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("m")), "heads")
    first = own.where(F.col("place") < heads - 1).select(F.col("conv_id").alias("b"), "place", "digest", "words")
    head = convs.join(first, (F.col("base") == F.col("b")) & (F.col("place") < F.col("h"))).select("conv_id", "place", "digest", "words")
    mine = convs.select(F.col("conv_id").alias("c"), "h", "m")
    tail = own.join(mine, F.col("conv_id") == F.col("c")).where("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "digest", "words")
    return convs.select("conv_id"), head.unionByName(tail)


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two pieces have in common from the start."""
    lo, hi = 0, min(len(a), len(b)) // UNIT
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * UNIT : mid * UNIT] == b[lo * UNIT : mid * UNIT]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _ident(row: dict, depth: int) -> str:
    """Identity of a node within its layer."""
    return hashlib.md5(f"{row['start']}:".encode() + row["key"][: depth * UNIT]).hexdigest()


class Chunk:
    """Sorted distinct pieces and the forest that their LCP edges give."""

    def __init__(self, rows: list[dict], left: int, right: int) -> None:
        """left, right: LCP with the row before and after the chunk; -1 if these have another start, or there are none."""
        self.rows, m = rows, len(rows)
        self.size = [len(r["key"]) // UNIT for r in rows]
        self.edge = [left, *(lcp(a["key"], b["key"]) if a["start"] == b["start"] else -1 for a, b in zip(rows, rows[1:])), right]
        self.sums = [np.concatenate([[0], np.cumsum(np.asarray(r["words"], dtype=np.int64))]) for r in rows]
        self.segments: list[tuple] = []
        self._join(m)

    def _left(self, lo: int) -> int:
        """Depth to which nodes at row ``lo`` began before the chunk."""
        return self.edge[0] if lo == 0 else -1

    def _lift(self, comp: list, to: int, parent: int) -> tuple[int, int]:
        """End the component's node and the path above it, down to depth ``to`` + 1; (child begun, tokens saved below ``to``)."""
        lo, hi, top, n, low, leaves, children, below, nid = comp
        self.segments.append((lo, hi, top, to + 1, n, low, leaves, children, below, nid, parent))
        p, began = self.sums[lo], self._left(lo)
        own = int(p[top] - p[max(to, 0)])
        fresh = int(p[top] - p[max(to, min(top, began), 0)])
        return int(to + 1 > began), below + n * own - fresh

    def _join(self, m: int) -> None:
        owner = list(range(m))

        def find(i: int) -> int:
            while owner[i] != i:
                owner[i] = owner[owner[i]]
                i = owner[i]
            return i

        comps: list[list] = []
        for i, r in enumerate(self.rows):
            leaves = r["sub_leaves"] if r["sub_leaves"] is not None else int(self.edge[i + 1] != self.size[i])
            comps.append([i, i, self.size[i], r["n"], r["low"], leaves, r["sub_children"] or 0, r["sub_saved"] or 0, i])
        n_ids = m
        # Of equal depth, edges go from left to right: then the right component always lies deeper.
        for i in sorted((i for i in range(1, m) if self.edge[i] >= 0), key=lambda i: (-self.edge[i], i)):
            d, a, b = self.edge[i], comps[find(i - 1)], comps[find(i)]
            if a[2] > d:
                nid, n_ids = n_ids, n_ids + 1
                child, below = self._lift(a, d, nid)
                a = [a[0], a[1], d, a[3], a[4], a[5], child, below, nid]
            child, below = self._lift(b, d, a[8])
            owner[find(i)] = root = find(i - 1)
            comps[root] = [a[0], b[1], d, a[3] + b[3], min(a[4], b[4]), a[5] + b[5], a[6] + child, a[7] + below, a[8]]
        for i in range(m):
            if owner[i] == i:
                self._lift(comps[i], -1, -1)

    def nodes(self, base: int) -> pa.RecordBatch:
        """All nodes of the chunk; open ones, which reach over its border, with their part of the sums."""
        s = [np.array(c, dtype=np.int64) for c in zip(*self.segments)]
        lo, hi, deep, shallow, n, low, leaves, children, below, nid, parent = s
        m = len(self.rows)
        at = np.repeat(np.arange(len(lo)), deep - shallow + 1)
        first = np.cumsum(deep - shallow + 1) - (deep - shallow + 1)
        e = shallow[at] + np.arange(len(at)) - first[at]  # depth in the piece
        left = np.where(lo == 0, self.edge[0], -1)
        right = np.where(hi == m - 1, self.edge[m], -1)
        is_open = e <= np.maximum(left, right)[at]
        offset = np.concatenate([[0], np.cumsum([len(x) for x in self.sums])])
        sums = np.concatenate(self.sums)
        p = lambda depth: sums[offset[lo[at]] + depth]
        own_from = np.maximum(e - 1, 0)
        saved = below[at] + n[at] * (p(deep[at]) - p(own_from)) - (p(deep[at]) - p(np.maximum(own_from, np.minimum(deep, left)[at])))
        kids = np.where(e == deep[at], children[at], (e + 1 > left[at]).astype(np.int64))
        # The parent of a segment's top node is the node that its component was merged into.
        seg_of = np.full(int(nid.max()) + 1, -1, dtype=np.int64)
        seg_of[nid] = np.arange(len(nid))
        up = np.where(parent >= 0, seg_of[parent], -1)
        top = e == shallow[at]
        parent_conv = np.where(top, np.where(up[at] >= 0, low[up[at]], -1), low[at])
        has_parent = e > 0
        up_left, up_right = np.where(up >= 0, left[up], -1), np.where(up >= 0, right[up], -1)
        parent_open = has_parent & np.where(top, (e - 1) <= np.maximum(up_left, up_right)[at], (e - 1) <= np.maximum(left, right)[at])
        sizes = np.array(self.size)
        ends = (e == deep[at]) & (sizes[lo[at]] == e)
        rows_at, depths, opens, parents = lo[at].tolist(), e.tolist(), is_open.tolist(), parent_open.tolist()
        return pa.record_batch(
            [
                pa.array(opens, pa.bool_()),
                pa.array([_ident(self.rows[r], d) if o else None for r, d, o in zip(rows_at, depths, opens)], pa.string()),
                pa.array(e + base, pa.int64()),
                pa.array(low[at], pa.int64()),
                pa.array(n[at], pa.int64()),
                pa.array(kids, pa.int64()),
                pa.array(leaves[at], pa.int64()),
                pa.array(saved, pa.int64()),
                pa.array([_ident(self.rows[r], d) if x else None for r, d, x in zip(rows_at, depths, ends.tolist())], pa.string()),
                pa.array(parent_conv, pa.int64(), mask=~has_parent | parent_open),
                pa.array([_ident(self.rows[r], d - 1) if o else None for r, d, o in zip(rows_at, depths, parents)], pa.string()),
                pa.array(e == 0, pa.bool_()),
                pa.array([self.rows[r]["start"] if d == 0 else None for r, d in zip(rows_at, depths)], pa.string()),
            ],
            names=[f.split()[0] for f in NODES.split(", ")],
        )


def _forests(base: int, borders: dict[int, tuple[int, int]], chunk_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        part, before = None, -1

        def joined(after: int) -> pa.RecordBatch:
            return Chunk(held, before, after).nodes(base)

        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if held:
                        yield joined(borders[part][1])
                    held, size, part, before = [], 0, row["part"], borders[row["part"]][0]
                elif len(held) >= chunk_rows or size >= CHUNK_BYTES:
                    between = lcp(held[-1]["key"], row["key"]) if held[-1]["start"] == row["start"] else -1
                    yield joined(between)
                    held, size, before = [], 0, between
                held.append(row)
                size += len(row["key"])
        if held:
            yield joined(borders[part][1])

    return run


def _layer(pieces: DataFrame, base: int, chunk_rows: int) -> DataFrame:
    """Nodes of one layer, open ones summed up; pieces: start, key, words, n, low, sub_children, sub_leaves, sub_saved."""
    order = ["start", "key"]
    ranged = written(pieces.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged-pieces")
    spans = ranged.groupBy("part").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last")).orderBy("first").collect()  # a row for each range
    common = [lcp(bytes(a["last"]["key"]), bytes(b["first"]["key"])) if a["last"]["start"] == b["first"]["start"] else -1 for a, b in zip(spans, spans[1:])]
    borders = {r["part"]: (x, y) for r, x, y in zip(spans, [-1, *common], [*common, -1])}
    dealt = ranged.repartition(max(len(spans), 1), "part").sortWithinPartitions("part", *order)
    found = written(dealt.mapInArrow(W.tidied(_forests(base, borders, chunk_rows)), NODES), "forests")
    whole = (
        found.where("open")
        .groupBy("id")
        .agg(
            F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
            F.max("ends").alias("ends"), F.first("parent").alias("parent"), F.first("root").alias("root"), F.first("start").alias("start"),
        )
    )
    whole = written(whole, "open-nodes")
    up = sized_broadcast(whole.select(F.col("id").alias("up"), F.col("conv_id").alias("up_conv")))
    names = ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "root", "start"]
    known = found.where(~F.col("open") & F.col("parent").isNull()).select(*names, "parent_conv_id")
    below_open = found.where(~F.col("open") & F.col("parent").isNotNull()).select(*names, "parent").unionByName(whole.where("parent is not null").select(*names, "parent"))
    roots = whole.where("parent is null").select(*names, F.lit(None).cast("long").alias("parent_conv_id"))
    return known.unionByName(roots).unionByName(below_open.join(up, F.col("parent") == F.col("up")).select(*names, F.col("up_conv").alias("parent_conv_id")))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of identifiers of a node, joined by commas."""
    for batch in batches:
        ids, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out: list[tuple[str, int, str]] = []
        i = 0
        while i < len(ids):
            j = i + 1
            while j < len(ids) and ids[j] == ids[i] and j - i < PACK:
                j += 1
            out.append((ids[i], convs[i], ",".join(map(str, convs[i:j]))))
            i = j
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))] if out else [pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.string())], names=["ends", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's identifiers, streamed in order."""
    node, state = None, None
    for batch in batches:
        out = []
        for ends, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if ends != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = ends, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.record_batch([pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.string())], names=["ends", "sha"])
    if node is not None:
        yield pa.record_batch([pa.array([node], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["ends", "sha"])


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(ends, sha) from (ends, conv_id): ranges are packed first, so that a group of copies meets in few rows."""
    packed = ends.repartitionByRange("ends", "conv_id").sortWithinPartitions("ends", "conv_id").mapInArrow(W.tidied(_pack), "ends string, first long, ids string")
    return packed.repartition("ends").sortWithinPartitions("ends", "first").mapInArrow(W.tidied(_digests), "ends string, sha string")


def prefix_trie(convs: DataFrame, rows: DataFrame, *, span: int = SPAN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Nodes of the trie of all conversations (``convs``: conv_id; ``rows``: conv_id, place from 0, digest, words).

    depth, conv_id (smallest member), parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens (of the subtree) and ends_sha256 (members that end here).
    """
    piece = F.floor(F.col("place") / span).cast("long")
    inside = F.sort_array(F.collect_list(F.struct("place", "digest", "words")))
    pieces = rows.groupBy("conv_id", piece.alias("layer")).agg(inside.alias("t"))
    pieces = pieces.select("conv_id", "layer", F.unhex(F.array_join(F.col("t.digest"), "")).alias("key"), F.col("t.words").alias("words"))
    # A conversation without turns is an empty piece: it ends at the root.
    have = pieces.where("layer = 0").select(F.col("conv_id").alias("c"))
    none = convs.select(F.col("conv_id").cast("long")).distinct().join(have, F.col("conv_id") == F.col("c"), "left_anti")
    pieces = written(pieces.unionByName(none.select("conv_id", F.lit(0).cast("long").alias("layer"), F.lit(b"").alias("key"), F.array().cast("array<long>").alias("words"))), "pieces")
    deepest = pieces.agg(F.max("layer")).first()[0]
    if deepest is None:
        return convs.sparkSession.createDataFrame([], "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    tails = None
    if deepest:
        by_layer = Window.partitionBy("conv_id").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
        chain = F.aggregate(F.collect_list(F.md5("key")).over(by_layer), F.lit(""), lambda a, x: F.md5(F.concat(a, x).cast("binary")))
        last = F.max("layer").over(Window.partitionBy("conv_id"))
        pieces = written(pieces.select("*", chain.alias("start"), (F.col("layer") < last).alias("goes_on"), F.lit(False).alias("ended")), "started-pieces")
        # Who ends with a full piece is a member of the next layer's root, without turns there.
        ended = pieces.where(~F.col("goes_on") & (F.size("words") == span) & (F.col("layer") < deepest))
        pieces = pieces.unionByName(
            ended.select(
                "conv_id", (F.col("layer") + 1).alias("layer"), F.lit(b"").alias("key"), F.array().cast("array<long>").alias("words"),
                F.md5(F.concat(F.col("start"), F.md5("key")).cast("binary")).alias("start"), "goes_on", F.lit(True).alias("ended"),
            )
        )
        lone = pieces.where("layer > 0").groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.max("ended").alias("ended"), F.min("conv_id").alias("lone"), F.min("layer").alias("from")).where("n = 1 and not ended")
        tails = written(lone.groupBy("lone").agg(F.min("from").alias("from")), "tails")
        pieces = written(pieces.join(tails, F.col("conv_id") == F.col("lone"), "left").where("from is null or layer < from").withColumn("tail", F.coalesce(F.col("goes_on") & (F.col("layer") + 1 == F.col("from")), F.lit(False))).drop("lone", "from"), "shared-pieces")
        deepest = pieces.agg(F.max("layer")).first()[0]
    else:
        pieces = pieces.select("*", F.lit("").alias("start"), F.lit(False).alias("goes_on"), F.lit(False).alias("ended"), F.lit(False).alias("tail"))
    key = F.md5(F.concat(F.concat(F.col("start"), F.lit(":")).cast("binary"), F.col("key")))
    ends = pieces.where("not goes_on and not ended").select(F.concat(F.col("layer").cast("string"), F.lit(":"), key).alias("ends"), "conv_id")
    same = (
        pieces.groupBy("layer", "start", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"), F.first("words").alias("words"), F.max("goes_on").alias("goes_on"), F.max("tail").alias("tail"))
        .withColumn("next", F.md5(F.concat(F.col("start"), F.md5("key")).cast("binary")))
    )
    same = written(same, "distinct-pieces")
    none_yet = [F.lit(None).cast("long").alias(c) for c in ("sub_children", "sub_leaves", "sub_saved")]
    out, carried = None, None
    for layer in range(deepest, -1, -1):
        here = same.where(F.col("layer") == layer)
        if carried is None:
            here = here.select("*", *none_yet)
        else:
            here = here.join(carried, here["next"] == carried["root_start"], "left").drop("root_start")
        if tails is not None:
            here = here.withColumns({"sub_children": F.when(F.col("tail"), 1).otherwise(F.col("sub_children")), "sub_leaves": F.when(F.col("tail"), 1).otherwise(F.col("sub_leaves")), "sub_saved": F.when(F.col("tail"), 0).otherwise(F.col("sub_saved"))})
        found = _layer(here.select("start", "key", "words", "n", "low", "sub_children", "sub_leaves", "sub_saved"), layer * span, chunk_rows)
        found = found.withColumn("ends", F.concat(F.lit(f"{layer}:"), F.col("ends")))
        if layer:
            found = written(found, "layer-nodes")
            carried = found.where("root").select(F.col("start").alias("root_start"), F.col("n_children").alias("sub_children"), F.col("n_leaves").alias("sub_leaves"), F.col("saved_tokens").alias("sub_saved"))
            found = found.where("not root")
        found = found.drop("root", "start")
        out = found if out is None else out.unionByName(found)
    digests = written(_ends_digests(ends), "ends").withColumnRenamed("ends", "e")
    nodes = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ended = out.where("ends is not null").join(digests, F.col("ends") == F.col("e"), "left").select(*nodes, F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    every = ended.unionByName(out.where("ends is null").select(*nodes, F.lit(EMPTY_SHA).alias("ends_sha256")))
    if tails is None:
        return every
    tail_rows = rows.join(tails, F.col("conv_id") == F.col("lone")).where(F.col("place") >= F.col("from") * span)
    size = rows.groupBy("conv_id").agg(F.max("place").alias("last")).withColumnRenamed("conv_id", "c")
    own = tail_rows.join(size, F.col("conv_id") == F.col("c")).select(
        (F.col("place") + 1).alias("depth"), "conv_id", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(F.col("place") < F.col("last"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("place") < F.col("last"), F.lit(EMPTY_SHA)).otherwise(F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_sha256"),
    )
    return every.unionByName(own)


def conversation_trie(conversations: DataFrame, *, block: int = 20, heads: int = 4, span: int = SPAN, chunk_rows: int = CHUNK_ROWS, **columns: str) -> DataFrame:
    """Trie of the conversations rebuilt on shared heads (``with_shared_heads``)."""
    own = written(turns(conversations, **columns), "turns")
    convs, rows = with_shared_heads(own, block, heads)
    return prefix_trie(convs, written(rows, "rebuilt"), span=span, chunk_rows=chunk_rows)
