"""Phrase collocation mining (operator 13).

Method: weighted acyclic automata.  Each task sorts the n-grams of a shard (a bounded run of texts)
and builds a count transducer from them: states for word pairs carry the pair's count, arcs to the
third word carry the triple's; states with equal arcs and weights are one (the automaton is minimal
in its last step).  Words are arcs with counts of their own.  Transducers are cut into prefix ranges,
and a range's transducers of all shards are united, adding up weights.  Part lookups compose: the
candidates' last two words, as queries sorted in the same way, run through the automaton of their
range, which gives the count of the part and, the other way, the largest count of a triple that
contains the pair.

Score: a phrase of count a, cut into parts of counts l and r, has floor(10**6 * a * a / (l * r)); its
lowest-scoring cut counts, of equal ones the first.  Arithmetic is in decimals of 38 digits.

Scale: texts are read once and never shuffled; what moves is a row for each shard and prefix range
with packed arcs (a table of the symbols, two bytes for each use), so a very common pair is one arc of
each shard.  A range holds a bounded number of occurrences, their number follows the corpus.
Words that start very many candidates are join keys that Spark can split, or meet a word table whose
size is checked.  The best phrases come from group-limited windows.

Defined cases: null texts are empty; a null language is ``und`` (together with a language of that
name); repeated rows count; extra columns are ignored; an empty table gives no rows; phrases that tie
in score and count follow their bytes.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billcov.functions.sizing import sized_broadcast
from billcov.llm import words as W
from billcov.llm.common import written

MIN_COUNT = 10
CONTAINED_PERCENT = 50
LIMIT = 2000
#: Words of a shard, and bytes of text of a prefix range.
SHARD_WORDS = 3 << 19
RANGE_BYTES = 16 << 20
MAX_BROADCAST = 1_000_000

U64 = np.uint64

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_INSIDE = ~_BREAK
_INSIDE[[9, 32]] = False

ARCS = "lang string, words boolean, range long, symbols binary, s1 binary, s2 binary, c2 binary, state binary, size binary, s3 binary, c3 binary, text binary"
UNITED = "lang string, range long, h long, word binary, count long, total long, s1 binary, s2 binary, c2 binary, size binary, s3 binary, c3 binary"
QUERIES = "lang string, range long, s1 binary, s2 binary, s3 binary, a binary, l2 binary"
CANDIDATES = "lang string, s1 long, s2 long, s3 long, a long, l2 long, r2 long"


def pair_key(s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """Order of the prefixes: a range is a run of these keys."""
    return W.mix(s1 * U64(W.STEP) + s2)


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return (key >> U64(65 - ranges.bit_length())).astype(np.int64) if ranges > 1 else np.zeros(len(key), np.int64)


def index_kind(n: int) -> str:
    """Type of an index into a table of ``n`` entries."""
    return "<u2" if n <= 1 << 16 else "<u4"


def starts_of(key: np.ndarray) -> np.ndarray:
    """First places of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of the pieces, back to back."""
    ends = np.cumsum(size)
    return raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]


class Transducer:
    """Counts of word pairs (states) and triples (arcs of a state); equal arc lists are stored once."""

    def __init__(self, s1: np.ndarray, s2: np.ndarray, s3: np.ndarray, has3: np.ndarray) -> None:
        """Built from the n-grams of a shard; where ``has3`` is false the piece ends after two words."""
        key = pair_key(s1, s2)
        order = np.lexsort((s3, has3, key))
        key, s1, s2, s3, has3 = key[order], s1[order], s2[order], s3[order], has3[order]
        at = starts_of(key)
        self.key, self.s1, self.s2 = key[at], s1[at], s2[at]
        self.c2 = np.diff(np.append(at, len(key)))
        k3, s3 = key[has3], s3[has3]
        new = np.ones(len(k3), bool)
        new[1:] = (k3[1:] != k3[:-1]) | (s3[1:] != s3[:-1])
        a3 = np.flatnonzero(new)
        self.s3, self.c3 = s3[a3], np.diff(np.append(a3, len(k3)))
        cut = np.searchsorted(k3[a3], self.key)
        self.first, self.size = cut, np.diff(np.append(cut, len(a3)))

    def packed(self, ranges: int) -> Iterator[tuple[int, list[bytes]]]:
        """(range, fields) with the minimal automaton of each range."""
        sums = np.zeros(len(self.s3) + 1, dtype=U64)
        np.cumsum(W.mix(W.mix(self.s3) + self.c3.astype(U64)), out=sums[1:])
        right = W.mix(sums[self.first + self.size] - sums[self.first] + self.size.astype(U64) * U64(W.BASE))
        of = range_of(self.key, ranges)
        at = starts_of(of)
        for a, b in zip(at, np.append(at[1:], len(of))):
            _, one, state = np.unique(right[a:b], return_index=True, return_inverse=True)
            one += a
            size = self.size[one]
            arcs = np.arange(int(size.sum())) + np.repeat(self.first[one] - (np.cumsum(size) - size), size)
            symbols, use = np.unique(np.concatenate([self.s1[a:b], self.s2[a:b], self.s3[arcs]]), return_inverse=True)
            use, m = use.astype(index_kind(len(symbols))), b - a
            cols = (symbols, use[:m], use[m : 2 * m], self.c2[a:b].astype(np.uint32), state.astype(index_kind(len(one))), size.astype(np.uint32), use[2 * m :], self.c3[arcs].astype(np.uint32))
            yield int(of[a]), [c.tobytes() for c in cols]


def _shards(ranges: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        names: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            lang, s1, s2, s3, n = (np.concatenate(x) for x in zip(*held))
            word, first = np.unique(np.concatenate([x[0] for x in names]), return_index=True)
            size = np.concatenate([x[1] for x in names])
            text = np.concatenate([x[2] for x in names])
            start = (np.cumsum(size) - size)[first]
            size = size[first]
            held.clear()
            names.clear()
            for name, code in langs.items():
                mine = lang == code
                if not mine.any():
                    continue
                rows: list[tuple] = []
                h, count = np.unique(s1[mine], return_counts=True)
                spot = np.searchsorted(word, h)
                of = range_of(h, ranges)
                at = starts_of(of)
                for a, b in zip(at, np.append(at[1:], len(h))):
                    z = size[spot[a:b]]
                    rows.append((True, int(of[a]), h[a:b].tobytes(), None, None, count[a:b].astype(np.uint32).tobytes(), None, z.astype(np.uint32).tobytes(), None, None, _gather(text, start[spot[a:b]], z).tobytes()))
                pair = mine & (n >= 2)
                for r, fields in Transducer(s1[pair], s2[pair], s3[pair], n[pair] >= 3).packed(ranges):
                    rows.append((False, r, *fields, None))
                kinds = [pa.bool_(), pa.int64()] + [pa.binary()] * 9
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.record_batch([pa.array([name] * len(rows), pa.string()), *cols], names=[c.split()[0] for c in ARCS.split(", ")])

        for batch in batches:
            code = np.array([langs.setdefault(x, len(langs)) for x in batch.column(0).to_pylist()], dtype=np.int32)
            for i, raw, offsets in W.slices(batch.column(1)):
                raw = W.LOWER[raw]
                w = W.words_of(raw, offsets, mask=_INSIDE[raw])
                if not len(w.hash):
                    continue
                piece = np.cumsum(_BREAK[raw])[w.start]
                near = (piece[1:] == piece[:-1]) & (w.doc[1:] == w.doc[:-1])
                two = np.append(near, False)
                three = two & np.append(two[1:], False)
                pad = np.zeros(2, dtype=U64)
                h = np.concatenate([w.hash, pad])
                held.append((code[i + w.doc], w.hash, h[1:-1], np.where(three, h[2:], U64(0)), 1 + two.astype(np.int8) + three))
                u, first = np.unique(w.hash, return_index=True)
                size = (w.end - w.start)[first]
                names.append((u, size, _gather(raw, w.start[first], size)))
                total += len(w.hash)
                if total >= shard_words:
                    yield from flush()
                    total = 0
        if held:
            yield from flush()

    return run


def _read(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x is not None), dtype=kind)


def _summed(order_keys: tuple[np.ndarray, ...], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of one row for each different key, sums of the weights)."""
    order = np.lexsort(order_keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in order_keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return order[at], np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, np.int64)


def _united_words(group: pa.Table, least: int) -> tuple[np.ndarray, list[bytes], np.ndarray, int]:
    """(hash, bytes, count) of the words with at least ``least`` occurrences, and all words' occurrences."""
    h, count, size = _read(group, "symbols", "<u8"), _read(group, "c2", "<u4").astype(np.int64), _read(group, "size", "<u4").astype(np.int64)
    text = _read(group, "text", "u1")
    start = np.cumsum(size) - size
    one, c = _summed((h,), count)
    one, c = one[c >= least], c[c >= least]
    return h[one], [text[a : a + n].tobytes() for a, n in zip(start[one], size[one])], c, int(count.sum())


def _united_arcs(group: pa.Table, least: int) -> dict[str, np.ndarray]:
    """The automaton of a range: all shards' weights added up, without counts below ``least``."""
    pairs: list[list[np.ndarray]] = [[], [], []]
    arcs: list[list[np.ndarray]] = [[], [], []]
    at = 0
    for symbols, s1, s2, c2, state, size, s3, c3 in zip(*(group.column(c).to_pylist() for c in ("symbols", "s1", "s2", "c2", "state", "size", "s3", "c3"))):
        symbols, size = np.frombuffer(symbols, dtype="<u8"), np.frombuffer(size, dtype="<u4").astype(np.int64)
        use = index_kind(len(symbols))
        s1, s2, s3 = (symbols[np.frombuffer(x, dtype=use)] for x in (s1, s2, s3))
        c2, c3 = (np.frombuffer(x, dtype="<u4").astype(np.int64) for x in (c2, c3))
        state = np.frombuffer(state, dtype=index_kind(len(size)))
        n = size[state]
        each = np.arange(int(n.sum())) + np.repeat((np.cumsum(size) - size)[state] - (np.cumsum(n) - n), n)
        for to, x in zip(pairs, (s1, s2, c2)):
            to.append(x)
        for to, x in zip(arcs, (np.repeat(np.arange(at, at + len(s1)), n), s3[each], c3[each])):
            to.append(x)
        at += len(s1)
    s1, s2, c2 = (np.concatenate(x) for x in pairs)
    owner, s3, c3 = (np.concatenate(x) for x in arcs)
    key = pair_key(s1, s2)
    one, total = _summed((key,), c2)
    one, total = one[total >= least], total[total >= least]
    arc, count = _summed((key[owner], s3), c3)
    arc, count = arc[count >= least], count[count >= least]
    # A triple's pair is at least as frequent, so it is there; both are in order of the key.
    cut = np.searchsorted(key[owner[arc]], key[one])
    return {"s1": s1[one], "s2": s2[one], "c2": total, "size": np.diff(np.append(cut, len(arc))), "s3": s3[arc], "c3": count}


def _united(least: int):
    def run(group: pa.Table) -> pa.Table:
        """Rows of a range's words, a row (total) with their occurrences, and a row with its automaton."""
        is_word = group.column("words").combine_chunks()
        words, arcs = group.filter(is_word), group.filter(pa.compute.invert(is_word))
        h, spelled, count, total = _united_words(words, least)
        m = len(h)
        automaton = {c: [x.tobytes()] for c, x in _united_arcs(arcs, least).items()} if len(arcs) else {}
        after = [None] * (1 + bool(automaton))
        col = lambda x, t: pa.array([*x, *after], t)
        cols = [pa.array(group.column(c)[:1].to_pylist() * (m + len(after)), t) for c, t in (("lang", pa.string()), ("range", pa.int64()))]
        cols += [col(h.view(np.int64).tolist(), pa.int64()), col(spelled, pa.binary()), col(count.tolist(), pa.int64())]
        cols.append(pa.array([None] * m + [total] + after[1:], pa.int64()))
        cols += [pa.array([None] * (m + 1) + automaton.get(c, []), pa.binary()) for c in ("s1", "s2", "c2", "size", "s3", "c3")]
        return pa.table(cols, names=[c.split()[0] for c in UNITED.split(", ")])

    return run


def _arcs(table: pa.Table) -> tuple[np.ndarray, ...]:
    s1, s2, c2, size, s3, c3 = (_read(table, c, t) for c, t in (("s1", "<u8"), ("s2", "<u8"), ("c2", "<i8"), ("size", "<i8"), ("s3", "<u8"), ("c3", "<i8")))
    return s1, s2, c2, size, s3, c3


def _queries(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Triples, sorted by their last two words, for the ranges that hold these."""
        for batch in batches:
            for i in range(len(batch)):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                s1, s2, c2, size, s3, c3 = _arcs(row)
                owner = np.repeat(np.arange(len(s1)), size)
                key = pair_key(s2[owner], s3)
                order = np.argsort(key)
                of = range_of(key[order], ranges)
                at = starts_of(of)
                ends = np.append(at[1:], len(of))
                blob = lambda x: pa.array([x[order[a:b]].tobytes() for a, b in zip(at, ends)], pa.binary())
                lang = pa.array([row.column("lang")[0].as_py()] * len(at), pa.string())
                yield pa.record_batch([lang, pa.array(of[at], pa.int64()), blob(s1[owner]), blob(s2[owner]), blob(s3), blob(c3), blob(c2[owner])], names=["lang", "range", "s1", "s2", "s3", "a", "l2"])

    return run


def _composed(percent: int):
    def run(automaton: pa.Table, queries: pa.Table) -> pa.Table:
        """Candidates: the queries' triples with the count of their last two words, and the range's pairs that no frequent triple contains."""
        s1, s2, c2, size, s3, c3 = _arcs(automaton)
        key = pair_key(s1, s2)
        most = np.zeros(len(key), np.int64)
        np.maximum.at(most, np.repeat(np.arange(len(key)), size), c3)
        q1, q2, q3, a, l2 = (_read(queries, c, t) for c, t in (("s1", "<u8"), ("s2", "<u8"), ("s3", "<u8"), ("a", "<i8"), ("l2", "<i8")))
        at = np.searchsorted(key, pair_key(q2, q3))  # a triple's pair is at least as frequent, so it is there
        np.maximum.at(most, at, a)
        free = 100 * most < percent * c2
        p = int(free.sum())
        lang = (automaton if len(automaton) else queries).column("lang")[0].as_py() if len(automaton) + len(queries) else None
        long = lambda x, y: pa.array(np.concatenate([x, y]).astype(np.int64) if x.dtype != U64 else np.concatenate([x, y]).view(np.int64), pa.int64())
        none = np.zeros(p, np.int64)
        pair = np.concatenate([np.ones(p, bool), np.zeros(len(a), bool)])
        return pa.table(
            {
                "lang": pa.array([lang] * (p + len(a)), pa.string()),
                "s1": long(s1[free], q1),
                "s2": long(s2[free], q2),
                "s3": pa.array(np.concatenate([none, q3.view(np.int64)]), pa.int64(), mask=pair),
                "a": long(c2[free], a),
                "l2": pa.array(np.concatenate([none, l2]), pa.int64(), mask=pair),
                "r2": pa.array(np.concatenate([none, c2[at] if len(at) else np.zeros(0, np.int64)]), pa.int64(), mask=pair),
            }
        )

    return run


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10**6 * a * a / (left * right)), exactly."""
    d = lambda c: c.cast("decimal(19,0)")
    over, under = F.lit(1_000_000).cast("decimal(7,0)") * (d(a) * d(a)), d(left) * d(right)
    return F.call_function("div", over, under)


def phrase_counts(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, contained_percent: int = CONTAINED_PERCENT, shard_words: int = SHARD_WORDS, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(words: lang, h, word, count, total; candidates: lang, s1, s2, s3, a, l2, r2) of all phrases that stay."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(4, (size // range_bytes).bit_length())
    arcs = texts.mapInArrow(W.tidied(_shards(ranges, shard_words)), ARCS)
    united = written(arcs.groupBy("lang", "range").applyInArrow(_united(min_count), UNITED), "automata")
    words = united.where("s1 is null").select("lang", "h", "word", "count", "total")
    automata = united.where("s1 is not null").select("lang", "range", "s1", "s2", "c2", "size", "s3", "c3")
    queries = automata.mapInArrow(W.tidied(_queries(ranges)), QUERIES)
    found = automata.groupBy("lang", "range").cogroup(queries.groupBy("lang", "range")).applyInArrow(_composed(contained_percent), CANDIDATES)
    return words, written(found, "phrases")


def collocations(docs: DataFrame, *, limit: int = LIMIT, **options: object) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``limit`` phrases."""
    words, found = phrase_counts(docs, **options)
    known = words.where("h is not null").select(F.col("lang").alias("wl"), "h", "word", "count")
    part = lambda k: sized_broadcast(known.select(*[F.col(c).alias(f"{c}{k}") for c in known.columns]), MAX_BROADCAST)
    on = lambda c, k: (F.col("lang") == F.col(f"wl{k}")) & (F.col(c) == F.col(f"h{k}"))
    rows = found.withColumn("last", F.coalesce("s3", "s2")).join(part(1), on("s1", 1)).join(part(3), on("last", 3))
    a, one, three = F.col("a"), F.col("count1"), F.col("count3")
    pair = F.col("s3").isNull()
    rows = rows.withColumn("x1", score(a, one, F.when(pair, three).otherwise(F.col("r2")))).withColumn("x2", F.when(~pair, score(a, F.col("l2"), three)))
    second = F.col("x2") < F.col("x1")
    rows = rows.select(
        "lang", "s2", "s3", "a", "word1", "word3", F.when(second, F.col("l2")).otherwise(one).alias("l"), F.when(second | pair, three).otherwise(F.col("r2")).alias("r"), F.when(second, F.col("x2")).otherwise(F.col("x1")).alias("score")
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = rows.withColumn("place", F.rank().over(best)).where(F.col("place") <= limit).drop("place")  # ties at the end stay
    middle = known.select(F.col("wl").alias("wl2"), F.col("h").alias("h2"), F.col("word").alias("word2"))
    near = near.join(middle, (F.col("lang") == F.col("wl2")) & (F.col("s2") == F.col("h2")) & F.col("s3").isNotNull(), "left")
    phrase = F.concat_ws(" ", F.col("word1").cast("string"), F.col("word2").cast("string"), F.col("word3").cast("string"))
    total = sized_broadcast(words.where("h is null").groupBy(F.col("lang").alias("tl")).agg(F.sum("total").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = near.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit)
    return ranked.join(total, F.col("lang") == F.col("tl")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
