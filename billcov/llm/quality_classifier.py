"""Quality classifier: a naive Bayes support vector machine (operator 10).

Method: indicators of n-grams are scaled by the log ratio of their smoothed shares in the two
classes, rows are brought to unit length, and a linear model with hinge loss is fitted by dual
coordinate descent.  A logistic curve, fitted on labelled rows that the machine has not seen, maps
margins to scores.

N-grams are byte trigrams, hashed to ``BUCKETS`` features, and pairs of words: whether a text
repeats a word at once enters by the share of such pairs, in steps.  Only the text is an input.

Scale: class counts cover all labelled training rows (sums of per-task vectors of fixed size); the
machine and the curve are fitted on at most ``FIT_ROWS`` and ``CURVE_ROWS`` training rows, those of
smallest hash, which the driver holds as feature numbers.  Labels join documents by broadcast if
few, else by an even equi-join.  All documents are scored in one pass without a shuffle.

Defined cases: null and empty texts have no features and get the score of the bias; null identifiers
are never held out; labels of unknown documents and null labels are ignored; rows with repeated
identifiers are scored one by one; with labels of one class or none the score is that share (0.5
without any); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billcov.functions.sizing import sized_broadcast
from billcov.llm import words as W

BUCKETS = 1 << 16
#: Upper bounds (percent) of the steps of the share of immediate word repetitions.
REPEAT_STEPS = (0, 1, 5, 20, 50)
DIMS = BUCKETS + len(REPEAT_STEPS) + 1
#: Bounds of the rows that the machine and the curve are fitted on.
FIT_ROWS = 8_000
CURVE_ROWS = 4_000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
SEED = 7
FOLDS = 5
SCORE_THRESHOLD = 0.3
MAX_BROADCAST_LABELS = 2_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each document of a slice."""
    n = len(raw)
    gram = np.zeros(0, np.int64)
    if n > 2:
        x = raw.astype(np.uint32)
        gram = ((((x[:-2] << 16) | (x[1:-1] << 8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    w = W.words_of(raw, offsets)
    same = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]) if len(w.doc) else np.zeros(0, bool)
    repeats = np.bincount(w.doc[1:][same], minlength=len(offsets) - 1)
    words = np.bincount(w.doc, minlength=len(offsets) - 1)
    share = 100 * repeats / np.maximum(words - 1, 1)
    step = BUCKETS + np.searchsorted(REPEAT_STEPS, share, side="left")
    seen = np.zeros(BUCKETS, bool)
    out = []
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if not words[d]:
            out.append(np.zeros(0, np.int64))
            continue
        g = gram[a : max(a, b - 2)]
        seen[g] = True
        f = np.flatnonzero(seen)
        seen[g] = False
        out.append(np.append(f, step[d]))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: documents of each class that have a feature (feature -1: all documents)."""
    count = np.zeros((2, DIMS + 1), np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for i, raw, offsets in W.slices(batch.column(0)):
            for d, f in enumerate(features(raw, offsets), i):
                count[label[d], f] += 1
                count[label[d], DIMS] += 1
    some = np.flatnonzero(count.sum(axis=0))
    if len(some):
        yield pa.record_batch([pa.array(np.where(some == DIMS, -1, some), pa.int64()), pa.array(count[0, some]), pa.array(count[1, some])], names=["feature", "n0", "n1"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, raw, offsets in W.slices(batch.column(0)):
            f = [x.astype(np.int32) for x in features(raw, offsets)]
            yield pa.record_batch(
                [pa.array(f, pa.list_(pa.int32())), batch.column(1).slice(i, len(f)).cast(pa.int64()), batch.column(2).slice(i, len(f))], names=["features", "label", "place"]
            )


def log_ratio(n0: np.ndarray, n1: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    p, q = n1 + smoothing, n0 + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def unit(f: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    x = ratio[f]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise hinge loss with an L2 penalty, by dual coordinate descent.

    Rows are unit vectors over sparse features, with a constant one for the bias; rare-class rows
    weigh more, so that both classes have the same total cost.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    values = [unit(f, ratio) for f in rows]
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    square = np.array([(x * x).sum() + 1.0 for x in values])
    alpha = np.zeros(len(y))
    w, bias = np.zeros(len(ratio)), 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            f, x = rows[i], values[i]
            gradient = y[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), weight[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[f] += step * x
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def margin(f: np.ndarray, ratio: np.ndarray, w: np.ndarray, bias: float) -> float:
    return float(w[f] @ unit(f, ratio)) + bias


def fit_curve(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of the logistic curve, by damped Newton steps on smoothed targets."""
    pos, neg = (labels > 0).sum(), (labels == 0).sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margins * margins).sum(), (v * margins).sum()], [(v * margins).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    def __init__(self, ratio: np.ndarray, w: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.ratio, self.w, self.bias, self.slope, self.offset = ratio, w, bias, slope, offset

    def score(self, f: np.ndarray) -> float:
        z = self.slope * margin(f, self.ratio, self.w, self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def constant(share: float) -> Model:
    z = float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share else -30.0)
    return Model(np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0, z)


def train(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", fit_rows: int = FIT_ROWS, curve_rows: int = CURVE_ROWS
) -> Model:
    """Fit on the labelled documents that are not held out."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(label_id))).groupBy(F.col(label_id).cast("long").alias("l_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = sized_broadcast(known, MAX_BROADCAST_LABELS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).join(known, F.col("doc_id") == F.col("l_id"))
    counts = rows.select("text", "label").mapInArrow(W.tidied(_count), "feature long, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # DIMS + 1 rows at most
    table = np.zeros((2, DIMS + 1))
    at = counts.column("feature").to_numpy()
    table[0, at], table[1, at] = counts.column("n0").to_numpy(), counts.column("n1").to_numpy()
    n0, n1 = table[:, DIMS]
    if not n0 or not n1:
        return constant(n1 / (n0 + n1) if n0 + n1 else 0.5)
    ratio = log_ratio(table[0, :DIMS], table[1, :DIMS])
    # The bound is kept by a hash threshold, with room for chance, then exactly by the order of hashes.
    most = fit_rows + curve_rows
    place = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    share = min(1.0, 1.1 * most / (n0 + n1) + 1e-9)
    some = rows.withColumn("place", place)
    if share < 1:
        some = some.where(F.col("place") < int(-(2**63) + share * 2**64))
    got = some.select("text", "label", "place").mapInArrow(W.tidied(_featured), "features array<int>, label long, place long").orderBy("place").limit(most).toArrow()
    feats = [x.values.to_numpy() for x in got.column("features")]
    y = got.column("label").to_numpy()
    cut = max(1, len(y) * fit_rows // most)
    if len(set(y[:cut].tolist())) < 2 or len(set(y[cut:].tolist())) < 2:
        w, bias = fit_hinge(feats, y, ratio)
        a, b = fit_curve(np.array([margin(f, ratio, w, bias) for f in feats]), y)
    else:
        w, bias = fit_hinge(feats[:cut], y[:cut], ratio)
        a, b = fit_curve(np.array([margin(f, ratio, w, bias) for f in feats[cut:]]), y[cut:])
    return Model(ratio, w, bias, a, b)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for batch in batches:
            for i, raw, offsets in W.slices(batch.column(2)):
                s = [m.score(f) for f in features(raw, offsets)]
                yield pa.record_batch([batch.column(0).slice(i, len(s)), batch.column(1).slice(i, len(s)), pa.array(s, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(W.tidied(run), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= SCORE_THRESHOLD).cast("int"))


def classified(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    return score(docs, train(docs, labels, **options))
