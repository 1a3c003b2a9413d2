"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, normalised and rotated by random orthogonal matrices, side by side; the signs of the D resulting
numbers are packed bits. For a unit vector o and its code c (a vertex of the cube, scaled to length 1) <c, q> / <c, o>
estimates <o, q> without bias, with an error below e * |q| * sqrt((1 - <c, o>^2) / <c, o>^2 / (D - 1)) with high
probability. So <x, q> = <centre, q> + |x - centre| <o, q> is estimated from bits and two numbers a vector. Those
whose upper bound reaches the k-th largest lower bound are compared exactly, in double precision.

All queries meet all codes, in blocks. Both kinds of blocks are written down once, and a task reads a few blocks of
queries and a part of the index: queries are not copied to each block, so the disk follows the input. From block to
block a task keeps each query's k best, whose last is a bound for the next block. The work is queries x rows; only few
rows are compared exactly. A block's vectors stay beside its codes, as fetching those that bounds leave by a join
would move more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import cut

PARTS, PAIRS = 16, 4096  # of the index: so many at least, or as make so many pairs with blocks of queries
TOGETHER = 8  # blocks of queries that a task takes
BLOCK = "block int, ids binary, vectors binary, codes binary, norms binary, aligned binary"


def usable(vector: Column, dim: int) -> Column:
    """Of the given length, without null or non-finite components, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


class Rotation:
    """The index's fixed part: a centre and random orthogonal matrices side by side."""

    def __init__(self, centre: np.ndarray, rotations: int = 1, seed: int = 7):
        d, rng = len(centre), np.random.default_rng(seed)
        turns = []
        for _ in range(rotations):
            q, r = np.linalg.qr(rng.standard_normal((d, d)))
            turns.append(q * np.sign(np.diag(r)))
        self.turn = (np.hstack(turns) / np.sqrt(rotations)).astype(np.float32)
        self.bits = self.turn.shape[1]
        self.centre = centre.astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed sign bits, |x - centre| and <code, unit vector> of each row."""
        y = x.astype(np.float32) - self.centre
        norm = np.linalg.norm(y, axis=1)
        y = (y / np.maximum(norm, 1e-30)[:, None]) @ self.turn
        codes = np.packbits(y > 0, axis=1)
        aligned = np.abs(y).sum(axis=1) / np.sqrt(self.bits)
        return codes, norm.astype(np.float32), np.maximum(aligned, 1e-6).astype(np.float32)


class Best:
    """Of a block of queries, the k best rows of each so far, nearest first, and the bound that a row must reach."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int):
        self.qid, self.q, self.k = qid, q.astype(np.float64), k
        self.ids, self.scores = [np.zeros(0, np.int64)] * len(qid), [np.zeros(0)] * len(qid)
        self.least = np.full(len(qid), -np.inf)

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids[i], ids)), np.concatenate((self.scores[i], scores))
        best = np.lexsort((ids, -scores))[: self.k]
        self.ids[i], self.scores[i] = ids[best], scores[best]
        if len(best) == self.k:
            self.least[i] = scores[best[-1]]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score)."""
        return np.repeat(self.qid, [len(x) for x in self.ids]), np.concatenate(self.ids), np.concatenate(self.scores)


class Codes:
    """A block of the index, unpacked."""

    def __init__(self, rot: Rotation, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, aligned: np.ndarray, eps: float):
        bits = np.unpackbits(codes, axis=1, count=rot.bits).astype(np.float32) * 2 - 1
        self.bits = bits / np.float32(np.sqrt(rot.bits))
        self.slack = norm * eps * np.sqrt((1 - np.minimum(aligned, 1) ** 2) / aligned**2 / max(rot.bits - 1, 1))
        self.scale, self.ids, self.wide = norm / aligned, ids, x.astype(np.float64)


def search_block(rot: Rotation, best: Best, block: Codes) -> None:
    """The block's rows that are among a query's best."""
    ids, k = block.ids, best.k
    for at in range(0, len(best.qid), 256):
        qid, q = best.qid[at : at + 256], best.q[at : at + 256]
        plain = q.astype(np.float32)
        est = (plain @ rot.turn) @ block.bits.T * block.scale + (plain @ rot.centre)[:, None]
        err = np.linalg.norm(plain, axis=1)[:, None] * block.slack
        own = qid[:, None] == ids
        least = best.least[at : at + 256]
        if not np.isfinite(least).all():  # fewer than k so far: the block's k-th lower bound
            most = min(k, len(ids))
            least = np.maximum(least, -np.partition(-np.where(own, -np.inf, est - err), most - 1, axis=1)[:, most - 1])
        est += err
        pick = (est >= least[:, None]) & ~own
        for i in np.flatnonzero(pick.any(axis=1)).tolist():
            c = np.flatnonzero(pick[i])
            if len(c) > 2 * k:  # what is surely not among the best, by a fast product
                near = block.wide[c] @ q[i]
                c = c[near >= -np.partition(-near, k - 1)[k - 1] - 1e-6 * max(1.0, np.abs(near).max())]
            best.add(at + i, ids[c], (block.wide[c] * q[i]).sum(axis=1))


def distinct_rows(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where the first of each group of rows with one id and one vector is; ids are sorted."""
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    if len(first) == len(ids):
        return first
    keep = []
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
        keep += [a] if b - a == 1 else {x[i].tobytes(): i for i in range(b - 1, a - 1, -1)}.values()
    return np.sort(np.array(keep, np.int64))


def nearest(df: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, eps: float = 3.0, rotations: int = 4, sample: int = 10_000, block_rows: int = 4096, query_rows: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row the k rows with the largest inner products among all
    other rows, nearest first, ties to the smaller vec_id.

    The centre is the mean of a sample of ``sample`` vectors (those with the smallest hashes of vec_id); every row is
    indexed. eps widens the error bounds: 3 standard deviations here; rotations are the bits a component. Vectors that
    are null, zero, not of the table's most common length (others have no inner product with it), or that hold null or
    non-finite components take no part. Scores are of the vectors as given: arrays of float, or else of double. Rows with one vec_id and one
    vector count once; a query skips all rows with its own id. Blocks of queries meet blocks of the index, so memory is
    bounded by a few blocks of queries and a block of the index. Blocks are written to the checkpoint folder. An empty table
    gives no rows.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    narrow = df.schema[vector].dataType.simpleString() == "array<float>"
    kind = np.float32 if narrow else np.float64
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if narrow else "array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None or not common["d"]:
        return empty
    d = common["d"]
    rows = rows.where(usable(F.col("v"), d))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    if not n_queries:
        return empty
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    centre = np.asarray(taken["v"].combine_chunks().flatten()).reshape(-1, d).mean(axis=0, dtype=np.float64)
    index = spark.sparkContext.broadcast(Rotation(centre, rotations))
    blocks, query_blocks = -(-n // block_rows), -(-n_queries // query_rows)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids = np.asarray(table["vec_id"]).astype(np.int64)
        x = np.asarray(table["v"].combine_chunks().flatten(), kind).reshape(len(ids), d) + kind(0)  # no -0.0
        keep = distinct_rows(ids, x)
        ids, x = ids[keep], x[keep]
        out = []
        for i in range(0, len(ids), block_rows):
            codes, norm, aligned = index.value.encode(x[i : i + block_rows])
            out.append([table["block"][0].as_py(), *(a.tobytes() for a in (ids[i : i + block_rows], x[i : i + block_rows], codes, norm, aligned))])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

    def bucket(count: int) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias("block")

    data = cut(rows.select(bucket(blocks), "vec_id", "v").groupBy("block").applyInArrow(build, BLOCK))
    asked = rows.where("q").select(bucket(query_blocks), "vec_id", "v").groupBy("block").applyInArrow(build, BLOCK)
    asked = cut(asked.select(F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")))
    parts = min(2 * blocks, max(PARTS, PAIRS // query_blocks))  # empty ones would be paired too
    pairs = data.coalesce(parts).crossJoin(asked.coalesce(-(-query_blocks // TOGETHER)).hint("shuffle_replicate_nl"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, Best] = {}
        block, of = None, b""
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("query_ids", "ids")}
                if r["ids"] != of:
                    of, ids = r["ids"], np.frombuffer(r["ids"], np.int64)
                    x, codes, norm, aligned = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("vectors", kind), ("codes", np.uint8), ("norms", np.float32), ("aligned", np.float32)))
                    block = Codes(index.value, ids, x.reshape(-1, d), codes.reshape(len(ids), -1), norm, aligned, eps)
                q = b.column("query_vectors")[i].as_py()
                key = r["query_ids"] + q
                if key not in best:
                    best[key] = Best(np.frombuffer(r["query_ids"], np.int64), np.frombuffer(q, kind).reshape(-1, d), k)
                search_block(index.value, best[key], block)
        for found in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.rows()], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # what occurs twice has one rank
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").distinct()
