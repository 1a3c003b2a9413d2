"""A quality classifier: random-indexing word vectors, pooled, under a small calibrated network.

Random indexing: each item has a sparse random index vector, derived from its hash; an item's word vector is its index
vector plus the mean of its neighbours' in a bounded sample of texts. Items are words (A-Z lower-cased) and shapes (a
word's classes of characters, runs collapsed: ``Ab,``), hashed to a fixed number of rows, and one item for a word that
repeats the one before. A text is the mean of its words' vectors beside the mean of its shapes' vectors. A two-layer
network in numpy gives a logit, and a temperature, fitted on rows that the network was not fitted on, the probability.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..checkpoint import cut
from ._text import Words, chunks, lower_ascii, mix64, split_words, string_parts

ROWS, DIM, NONZERO, REACH = 1 << 14, 64, 8, 2
REPEAT = 0  # the row of "the same word again"


def index_vectors() -> np.ndarray:
    """A sparse vector of +1 and -1 for each row, scaled to length 1."""
    h = mix64(np.arange(ROWS * NONZERO, dtype=np.uint64)).reshape(ROWS, NONZERO)
    out = np.zeros((ROWS, DIM), np.float32)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(ROWS), (h[:, k] >> np.uint64(8)).astype(np.int64) % DIM), np.where(h[:, k] & np.uint64(1), 1, -1))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def _shape_class() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] = ord("A")
    out[97:123] = out[128:] = ord("a")
    out[48:58] = ord("0")
    return out


SHAPE = _shape_class()


def items(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words and of their shapes (a repeated word's is REPEAT), and each text's first word."""
    words = split_words(lower_ascii(data), at)
    h = words.hashes()[0]
    same = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
    same[words.first[:-1][words.count > 0]] = False
    shape = SHAPE[data]
    begin = np.zeros(len(data), bool)
    begin[words.start] = True
    keep = begin | np.r_[True, shape[1:] != shape[:-1]] if len(data) else begin
    place = np.r_[0, np.cumsum(keep)]
    shapes = Words(shape[keep], at, place[words.start], place[words.end], words.first).hashes()[0]
    row = lambda x: (1 + (x >> np.uint64(20)) % np.uint64(ROWS - 1)).astype(np.int32)
    return row(h), np.where(same, REPEAT, row(shapes ^ np.uint64(0x5BD1E995))), words.first


def pooled(vectors: np.ndarray, rows: np.ndarray, first: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """The mean vector of each text's rows; zeros without any."""
    out = np.zeros((len(first) - 1, DIM), np.float64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for i in range(0, len(rows), block):
        d = doc[i : i + block]
        at = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        out[d[at]] += np.add.reduceat(vectors[rows[i : i + block]], at, axis=0)
    return (out / np.maximum(np.diff(first), 1)[:, None]).astype(np.float32)


def features(vectors: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    words, shapes, first = items(data, at)
    n = np.log1p(np.diff(first))[:, None].astype(np.float32)
    return np.hstack([pooled(vectors, words, first), pooled(vectors, shapes, first), n])


def context_sums(rows: np.ndarray, first: np.ndarray, index: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for step in range(1, REACH + 1):
        pair = np.flatnonzero(doc[step:] == doc[:-step])
        for a, b in ((rows[pair], rows[pair + step]), (rows[pair + step], rows[pair])):
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
            for i in range(0, len(at), 512):  # bounded memory
                lo, hi = at[i], at[i + 512] if i + 512 < len(at) else len(a)
                sums[a[at[i : i + 512]]] += np.add.reduceat(index[b[lo:hi]], at[i : i + 512] - lo, axis=0)
            counts += np.bincount(a, minlength=ROWS)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, seed: int = 1) -> Network:
    """Adam on the log loss over four fifths of the rows; the rest fits the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    z = ((x - mean) / scale).astype(np.float32)
    params = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(epochs):
        rng.shuffle(used)
        for i in range(0, len(used), 256):
            rows = used[i : i + 256]
            a = np.tanh(z[rows] @ params[0] + params[1])
            g = (1 / (1 + np.exp(-np.clip(a @ params[2] + params[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(g, params[2]) * (1 - a * a)
            grads = [z[rows].T @ back + decay * params[0], back.sum(axis=0), a.T @ g + decay * params[2], np.array([g.sum()])]
            step += 1
            for p, d, m in zip(params, grads, moments, strict=True):
                m[0] += 0.1 * (d - m[0])
                m[1] += 0.001 * (d * d - m[1])
                p -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]), 1.0)
    if len(held):
        logits, target = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.mean(np.logaddexp(0, -logits / t) * target + np.logaddexp(0, logits / t) * (1 - target)) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000, context_texts: int = 4_000) -> tuple[np.ndarray, Network] | None:
    """Word vectors and network from labelled rows that are not held out, or None without any.

    At most ``most_labels`` documents are used, those with the smallest hashes of doc_id, and the first
    ``context_texts`` of them give the neighbours; both bound what the driver gathers, as of rows that repeat a doc_id
    one text is used (that with the smallest hash). Null labels and ids are left out; of repeated labels of a document
    the smallest counts.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).collect()
    if not chosen:
        return None
    sample = spark.createDataFrame([(r[0], int(r[1] > 0), i < context_texts) for i, r in enumerate(chosen)], "doc_id long, y int, near boolean")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    # written down: read twice, and of the sample's size; in one order, as sums of floats depend on it
    texts = cut(texts.groupBy("doc_id", "y", "near").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).select("doc_id", "text", "y", "near").sortWithinPartitions("doc_id"))
    index = index_vectors()

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((ROWS, DIM), np.float32), np.zeros(ROWS, np.int64)
        for b in chunks(batches, "text"):
            words, shapes, first = items(*string_parts(b.column(1)))
            for rows in (words, shapes):
                context_sums(rows, first, index, sums, counts)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()]), pa.array([counts.tobytes()])], names=["sums", "counts"])

    sums, counts = np.zeros((ROWS, DIM)), np.zeros(ROWS)
    for r in texts.where("near").repartition(8, "doc_id").sortWithinPartitions("doc_id").mapInArrow(neighbours, "sums binary, counts binary").toLocalIterator():
        sums += np.frombuffer(r["sums"], np.float32).reshape(ROWS, DIM)
        counts += np.frombuffer(r["counts"], np.int64)
    vectors = (index + sums / np.maximum(counts, 1)[:, None]).astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            x = features(shared.value, *string_parts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    rows = texts.mapInArrow(measure, "doc_id long, y int, x binary").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return None
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(rows.num_rows, -1)
    return vectors, fit(x, np.asarray(rows["y"]).astype(np.float64))


def score(docs: DataFrame, labels: DataFrame, also: Sequence[str] = (), **options) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, and the row's columns named in also.

    Only the text is an input of a score. A null text counts as empty; empty texts have the score of a text without
    words. Without usable labels all scores are 0.5. Ids may repeat or be null (a null one is not held out).
    """
    model = train(docs, labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            if shared.value is None:
                s = np.full(b.num_rows, 0.5)
            else:
                vectors, net = shared.value
                s = net.scores(features(vectors, *string_parts(b.column(1)))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), *(b.column(i) for i in extra)], names=["doc_id", "score", *also])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(docs[c] for c in also if c != "text"))
    extra = [1 if c == "text" else rows.columns.index(c, 2) for c in also]
    scored = rows.mapInArrow(run, StructType([*StructType.fromDDL("doc_id long, score double"), *(StructField(c, rows.schema[i].dataType) for c, i in zip(also, extra, strict=True))]))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *also)
