"""Cost-balanced packing of documents into fixed-length token sequences (operator 6).

Method: the cost of a piece of ``L`` tokens is ``linear * L + quadratic * L**2`` (projections and
feed-forward grow with L, attention with its square).  Documents go, longest first, to the sequence
of lowest cost that still has room for them.

Scale: tasks tokenise and pack what they read, in blocks of about ``block_tokens`` tokens; nothing
is shuffled, no task holds more than a block, and a hot source or a very long document is just more
blocks.  Packing quality does not depend on the number of blocks, since no block pads: a block's
tokens fill whole sequences, and what remains (fewer than ``seq_len`` tokens) is cut into sequences
whose lengths are powers of two, which need no padding either.

Defined cases: a null or empty text is the end-of-document id alone; documents longer than a
sequence are cut into full sequences and a rest; repeated rows and null ids are packed like any
other row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billcov.llm import words as W

SEQ_LEN = 4096
EOS_ID = 2
BLOCK_TOKENS = 1 << 20
#: Relative weights of the cost: at 4096 tokens attention costs as much as the linear layers.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096

#: A worker starts its table of units anew at this size; it only bounds memory, results don't depend on it.
TABLE_UNITS = 1_000_000
RECENT_UNITS = 1 << 15

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

#: Classes of bytes: separators (0), letters (1), marks (2), anything else (3).  Marks exclude the
#: apostrophe, which starts contractions.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[10, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[ord(c) for c in '.,;:!?*$%&#|<>()"-_/+=@[]{}~^']] = 2
#: Second bytes of the letters U+00C0 to U+00FF in UTF-8, without the two signs among them.
_LATIN = np.zeros(256, dtype=bool)
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


class UnitTokenizer:
    """Token ids of whole texts through a table of units.

    The vocabulary's splitter keeps letters and marks apart and never joins characters across white
    space, so the ids of a text are those of its runs of letters and runs of marks in a row.  Words
    (between U+0020 and U+000A) with any other character are units as a whole, left to the
    tokenizer as they are.  Letters are lower-cased first, as the vocabulary does.  Units are found
    and looked up by 64-bit hash with numpy; new runs of letters are encoded many at a time (each
    ends with exactly one word-end token, which separates them again).
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        for token, i in self.tok.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._reset()

    def _reset(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.main, self.recent = none, none  # (hash, place in the pool, number of ids), by hash
        self.pool, self.used = np.zeros(1 << 16, dtype="<u4"), 0

    def _keep(self, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, hashes: np.ndarray, units: list[bytes], letters: np.ndarray) -> None:
        place, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)

        def alone(which: list[int]) -> None:
            texts = [units[i].decode("utf-8", "replace") for i in which]
            for i, e in zip(which, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
                place[i], size[i] = self.used, len(e.ids)
                self._keep(np.array(e.ids, dtype="<u4"))

        plain = np.flatnonzero(letters).tolist()
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        texts = [b" ".join([units[i] for i in g]).decode() for g in groups]
        for g, e in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(g) or cuts[-1] != len(ids):
                alone(g)
                continue
            first = np.concatenate([[0], cuts[:-1]])
            place[g], size[g] = self.used + first, cuts - first
            self._keep(ids)
        alone(np.flatnonzero(~letters).tolist())
        old = self.recent
        at = np.searchsorted(old[0], hashes)
        self.recent = tuple(np.insert(x, at, y) for x, y in zip(old, (hashes, place, size)))
        if len(self.recent[0]) > RECENT_UNITS:
            at = np.searchsorted(self.main[0], self.recent[0])
            self.main = tuple(np.insert(x, at, y) for x, y in zip(self.main, self.recent))
            self.recent = tuple(x[:0] for x in self.recent)

    @staticmethod
    def _find(table: tuple[np.ndarray, ...], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table[0], hashes)
        at[at == len(table[0])] = 0
        return at, (table[0][at] == hashes if len(table[0]) else np.zeros(len(hashes), bool))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents in a slice, back to back, and their bounds by document."""
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        text = raw.tobytes()
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        lead = lead[_LATIN[raw[lead + 1]]]
        kind = _CLASS[raw]
        kind[lead] = kind[lead + 1] = 1
        if any(x in text for x in _SPECIAL):
            kind[np.isin(raw, np.frombuffer(b"<|>", dtype=np.uint8))] = 3
        start, end = W.runs(kind > 0, offsets)
        odd = np.maximum.reduceat(kind, start) == 3 if len(start) else np.zeros(0, bool)
        if odd.any():  # separators between words are 0 already; each odd word becomes one run of 3
            mark = np.zeros(len(kind) + 1, np.int8)
            mark[start[odd]] += 1
            mark[end[odd]] -= 1
            kind[np.cumsum(mark[:-1]) > 0] = 3
        low = W.LOWER[raw]
        upper = lead + 1
        upper = upper[raw[upper] < 0x9F]  # U+00DF is lower case
        low[upper] += 0x20
        low = np.where(kind == 1, low, raw)
        edge = np.zeros(len(kind) + 1, bool)
        edge[offsets] = True
        edge[1:-1] |= kind[1:] != kind[:-1]
        edge[0] = edge[-1] = True
        cut = np.flatnonzero(edge)
        start, end = cut[:-1], cut[1:]
        real = kind[start] > 0
        start, end = start[real], end[real]
        doc = np.searchsorted(offsets, start, side="right") - 1
        hashes, first, inverse = np.unique(W.Prefix(low).hash(start, end), return_index=True, return_inverse=True)
        _, known = self._find(self.main, hashes)
        _, late = self._find(self.recent, hashes)
        new = ~(known | late)
        if new.any():
            if len(self.main[0]) + len(self.recent[0]) > TABLE_UNITS:
                self._reset()
                new = np.ones(len(hashes), bool)
            data = low.tobytes()
            at = first[new]
            self._learn(hashes[new], [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())], kind[start[at]] == 1)
        place, size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for table in (self.main, self.recent):
            at, ok = self._find(table, hashes)
            place[ok], size[ok] = table[1][at[ok]], table[2][at[ok]]
        place, size = place[inverse], size[inverse]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(place - (ends - size), size) + np.arange(total)]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=size, minlength=len(offsets) - 1))]).astype(np.int64)
        return ids, bounds


_tokenizers: dict[str, UnitTokenizer] = {}


def tokenizer(path: str) -> UnitTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = UnitTokenizer(path)
    return _tokenizers[path]


def pack_block(lengths: list[int], seq_len: int = SEQ_LEN, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Place documents of ``lengths`` tokens: ((document, start, length, sequence, offset) ..., sequences).

    Every sequence is filled: all but the last few have ``seq_len`` tokens, those have powers of two.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []
    seqs = 0
    for d, n in enumerate(lengths):
        full = n // seq_len
        for k in range(full):
            pieces.append((d, k * seq_len, seq_len, seqs, 0))
            seqs += 1
        if n % seq_len:
            rest.append((n % seq_len, d, full * seq_len))
    total = sum(n for n, _, _ in rest)
    tail = total % seq_len
    room = np.array([seq_len] * (total // seq_len) + [1 << b for b in reversed(range(seq_len.bit_length())) if tail >> b & 1], dtype=np.int64)
    size = room.copy()
    cost = np.zeros(len(room))
    rest.sort(key=lambda r: (-r[0], r[1]))
    for n, d, start in rest:
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            s = int(np.argmin(np.where(fits, cost, np.inf)))
            take = min(n, int(room[s]))
            pieces.append((d, start, take, seqs + s, int(size[s] - room[s])))
            room[s] -= take
            cost[s] += linear * take + quadratic * take * take
            start += take
            n -= take
    return pieces, seqs + len(room)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = SEQ_LEN,
    eos_id: int = EOS_ID,
    block_tokens: int = BLOCK_TOKENS,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """Pieces of all documents with their place in a sequence.

    Columns: doc_id, start (the document's ids before the piece), length, doc_tokens, sequence_id,
    offset (in the sequence), ids (the piece's ids, little-endian unsigned 32-bit).  ``seq_len`` is
    a power of two.  A sequence's tokens are its pieces' ids in the order of ``offset``.
    """
    if seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    end = np.array([eos_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        first = TaskContext.get().partitionId() << 40
        names: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, held
            lengths = [len(b) // 4 for b in ids]
            pieces, used = pack_block(lengths, seq_len, linear, quadratic)
            pieces.sort()
            d, start, length, seq, offset = zip(*pieces)
            out = pa.record_batch(
                [
                    pa.array([names[i] for i in d], pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([lengths[i] for i in d], pa.int64()),
                    pa.array([first + s for s in seq], pa.int64()),
                    pa.array(offset, pa.int64()),
                    pa.array([ids[i][4 * a : 4 * (a + n)] for i, a, n in zip(d, start, length)], pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )
            first += used
            names.clear()
            ids.clear()
            held = 0
            return out

        for batch in batches:
            rows = batch.column(0).to_pylist()
            for i, raw, offsets in W.slices(batch.column(1)):
                found, bounds = tok.encode(raw, offsets)
                for name, a, b in zip(rows[i:], bounds[:-1].tolist(), bounds[1:].tolist()):
                    names.append(name)
                    ids.append(found[a:b].tobytes() + end)
                    held += b - a + 1
                    if held >= block_tokens:
                        yield flush()
        if names:
            yield flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(W.tidied(run), PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """Token sequences: sequence_id, length, ids (concatenated), n_pieces; groups hold at most one sequence."""
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("n_pieces"))
        .select("sequence_id", "length", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), "n_pieces")
    )
