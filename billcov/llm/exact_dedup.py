"""Exact deduplication with Patricia-trie owners (operator 8).

Method: texts are dealt out by length and content hash; every partition inserts the full byte
strings into a compressed radix trie whose terminal nodes hold the smallest identifier seen.  The
hash only chooses the partition: equality is decided by the bytes on the path.  A trie that grows
beyond its budget spills its largest subtree to a file, and the rest of that subtree follows it
there; spilled subtrees are built one after the other once the input has ended.

Scale: every task first collapses the copies in the blocks it reads (the same trie, before the
shuffle), so a group that holds a third of all rows sends one string for each block, not for each
row.  Members travel as lists of identifiers of one block; the trie answers a list with a handle at
once and gives a handle's owner at the end, so no task gathers a group.  Handles and owners meet in
an equi-join that Spark can split.

Defined cases: a null text is empty; rows with null identifiers take part, and a group of only such
rows has a null keep_id; of repeated rows with the same smallest identifier exactly one is kept;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billcov.llm import words as W
from billcov.llm.common import fresh_names, written

#: Bytes of text of a block that is collapsed before the shuffle.
BLOCK_BYTES = 12 << 20
#: Bytes that a partition's trie holds in memory: edge labels, and so many for each node.
TRIE_BYTES = 160 << 20
NODE_BYTES = 450

_SPACES = b" \t\n\v\f\r"

LOCAL = "n_bytes long, sha binary, norm binary, uid long, owner long, owner_pos long, members array<long>, raws array<long>"
OWNED = "handle long, sha binary, uid long, members array<long>, raws array<long>, owner long, owner_uid long, owner_pos long, size long"


def normalised(text: bytes) -> bytes:
    """Each run of [\\x20\\x09-\\x0D] becomes one space."""
    out = b" ".join(text.split())
    if not out:
        return b" " if text else b""
    return (b" " if text[:1] in _SPACES else b"") + out + (b" " if text[-1:] in _SPACES else b"")


class _Node:
    __slots__ = ("edges", "terminal")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, _Node]] = {}
        self.terminal = -1


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    lo, hi = 0, min(len(a), len(b) - at)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class RadixTrie:
    """Compressed trie over byte strings; ``find_or_add`` gives the terminal number of a string."""

    def __init__(self, budget: int | None = None, depth: int = 0) -> None:
        self.root, self.count, self.held = _Node(), 0, 0
        self.budget, self.depth = budget, depth
        self.bytes_below: dict[int, int] = {}
        self.spilled: dict[int, _Spill] = {}

    def find_or_add(self, b: bytes, new: Callable[[], int]) -> int:
        """Terminal of ``b``, made by ``new`` if absent; -1 if ``b`` belongs to a spilled subtree."""
        at, node = self.depth, self.root
        top = b[at] if at < len(b) else -1
        if top in self.spilled:
            return -1
        while at < len(b):
            edge = node.edges.get(b[at])
            if edge is None:
                leaf = _Node()
                node.edges[b[at]] = (b[at:], leaf)
                self._grow(top, len(b) - at + NODE_BYTES)
                node = leaf
                break
            label, child = edge
            if b.startswith(label, at):
                at, node = at + len(label), child
                continue
            k = _common(label, b, at)
            mid = _Node()
            mid.edges[label[k]] = (label[k:], child)
            node.edges[b[at]] = (label[:k], mid)
            self._grow(top, NODE_BYTES)
            at, node = at + k, mid
        if node.terminal < 0:
            node.terminal = new()
        return node.terminal

    def _grow(self, top: int, size: int) -> None:
        self.held += size
        self.bytes_below[top] = self.bytes_below.get(top, 0) + size

    def spill_largest(self) -> None:
        """Move the largest subtree of the root to a file."""
        top = max(self.bytes_below, key=self.bytes_below.__getitem__)
        spill = self.spilled[top] = _Spill()
        label, node = self.root.edges.pop(top)
        path = [(label, node)]
        while path:
            prefix, n = path.pop()
            if n.terminal >= 0:
                spill.add(prefix, n.terminal, None)
            path += [(prefix + lab, child) for lab, child in n.edges.values()]
        self.held -= self.bytes_below.pop(top)


class _Spill:
    """Strings (from the trie's depth on) of one subtree: known terminals first, then later rows.

    The file is scratch of this task alone, without a name: it is gone when the task is, however that
    ends, and a task that runs again makes its own.
    """

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.common: bytes | None = None

    def add(self, b: bytes, terminal: int, row: tuple | None) -> None:
        if self.common is None:
            self.common = b
        else:
            self.common = self.common[: _common(self.common, b, 0)]
        pickle.dump((b, terminal, row), self.file, pickle.HIGHEST_PROTOCOL)

    def rows(self) -> Iterator[tuple[bytes, int, tuple | None]]:
        self.file.seek(0)
        with self.file as f:
            while True:
                try:
                    yield pickle.load(f)
                except EOFError:
                    return


def answer(rows: Iterator[tuple[bytes, tuple]], new: Callable[[], int], budget: int) -> Iterator[tuple[int, tuple]]:
    """(terminal, row) for each (string, row), in any order; at most about ``budget`` bytes are held."""

    def build(source: Iterator[tuple[bytes, int, tuple | None]], depth: int) -> Iterator[tuple[int, tuple]]:
        trie = RadixTrie(budget, depth)
        for b, known, row in source:
            t = trie.find_or_add(b, new if known < 0 else lambda known=known: known)
            if t < 0:
                trie.spilled[b[depth]].add(b[depth:], known, row)
            elif row is not None:
                yield t, row
            while trie.held > budget and len(trie.bytes_below):
                trie.spill_largest()
        del trie.root
        for spill in trie.spilled.values():
            # Strings are kept from this depth on; what all of them share is passed over.
            yield from build(spill.rows(), len(spill.common or b""))

    yield from build(((b, -1, row) for b, row in rows), 0)


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct normalised texts of each block, with the identifiers of the rows that have them."""
    uid = TaskContext.get().partitionId() << 40
    trie, held = RadixTrie(), 0
    texts: list[bytes] = []
    members: list[list[int | None]] = []
    raws: list[list[int]] = []

    def flush() -> pa.RecordBatch:
        nonlocal uid, held, trie
        best = [min(range(len(m)), key=lambda i: (m[i] is None, m[i] or 0)) for m in members]
        out = pa.record_batch(
            [
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array(texts, pa.binary()),
                pa.array(range(uid, uid + len(texts)), pa.int64()),
                pa.array([m[i] for m, i in zip(members, best)], pa.int64()),
                pa.array(best, pa.int64()),
                pa.array(members, pa.list_(pa.int64())),
                pa.array(raws, pa.list_(pa.int64())),
            ],
            names=["n_bytes", "sha", "norm", "uid", "owner", "owner_pos", "members", "raws"],
        )
        uid += len(texts)
        trie, held = RadixTrie(), 0
        texts.clear()
        members.clear()
        raws.clear()
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for doc, raw, raw_hash in zip(*(part.column(k) for k in range(3))):
                text = normalised(raw.as_py() or b"")
                t = trie.find_or_add(text, lambda: len(texts))
                if t == len(texts):
                    texts.append(text)
                    members.append([])
                    raws.append([])
                    held += len(text)
                members[t].append(doc.as_py())
                raws[t].append(raw_hash.as_py())
                held += 24
                if held >= BLOCK_BYTES:
                    yield flush()
    if texts:
        yield flush()


def _owners(budget: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (handle, uid, members) as they come, then rows (handle, owner, size) for every terminal."""
        first = TaskContext.get().partitionId() << 40
        shas: list[bytes] = []
        best: list[tuple] = []
        size: list[int] = []
        names = ["handle", "sha", "uid", "members", "raws", "owner", "owner_uid", "owner_pos", "size"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

        def source() -> Iterator[tuple[bytes, tuple]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    c = batch.slice(at, 256).to_pydict()
                    yield from zip(c["norm"], zip(c["sha"], c["uid"], c["owner"], c["owner_pos"], c["members"], c["raws"]))

        def new() -> int:
            shas.append(b"")
            best.append((True, 0, 0, 0))
            size.append(0)
            return len(size) - 1

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows: list[tuple] = []
        for t, (sha, uid, owner, pos, members, raws) in answer(source(), new, budget):
            mine = (owner is None, owner or 0, uid, pos)
            if not size[t] or mine < best[t]:
                best[t] = mine
            shas[t] = sha
            size[t] += len(members)
            rows.append((first + t, None, uid, members, raws, None, None, None, None))
            if len(rows) >= 4096:
                yield out(rows)
                rows = []
        for t, (none, owner, uid, pos) in enumerate(best):
            rows.append((first + t, shas[t], None, None, None, None if none else owner, uid, pos, size[t]))
            if len(rows) >= 4096:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)

    return run


def _raw_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("binary"))


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    return _decisions(docs, id_col, text_col, trie_bytes).drop("raw")


def _decisions(docs: DataFrame, id_col: str, text_col: str, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of ``exact_duplicates`` with the hash of the text as it came."""
    local = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), _raw_hash(text_col).alias("raw")).mapInArrow(W.tidied(_local), LOCAL)
    owned = written(local.repartition("n_bytes", "sha").mapInArrow(W.tidied(_owners(trie_bytes)), OWNED), "trie-owners")
    rows = owned.where("members is not null").select("handle", "uid", "members", "raws")
    owners = owned.where("members is null").select("handle", "owner", "owner_uid", "owner_pos", "size", F.lower(F.hex("sha")).alias("text_sha256"))
    return (
        rows.join(owners, "handle")
        .select("owner", "owner_uid", "owner_pos", "size", "text_sha256", "uid", F.posexplode(F.arrays_zip("members", "raws")).alias("pos", "row"))
        .select(
            F.col("row.members").alias("doc_id"),
            F.col("owner").alias("keep_id"),
            F.col("size").alias("group_size"),
            ((F.col("uid") == F.col("owner_uid")) & (F.col("pos") == F.col("owner_pos"))).alias("kept"),
            "text_sha256",
            F.col("row.raws").alias("raw"),
        )
    )


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay.

    Rows are told apart by identifier and text (as it came): of equal texts the row decided on stays,
    and one of the rows that repeat it byte for byte.
    """
    from pyspark.sql import Window

    ident, text, place = fresh_names(docs, "kept_id", "kept_text", "kept_place")
    kept = _decisions(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias(ident), F.col("raw").alias(text))
    stay = docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(ident)) & (_raw_hash(text_col) == F.col(text)), "left_semi")
    again = Window.partitionBy(id_col, _raw_hash(text_col)).orderBy(F.lit(0))
    return stay.withColumn(place, F.row_number().over(again)).where(F.col(place) == 1).drop(place)
