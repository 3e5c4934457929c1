"""Hard negatives by rotated one-bit codes with exact intervals.

A vector's components become whole numbers, floor(scale * x). The index keeps, beside the vector, the
signs of its rotation by a fixed random orthogonal matrix (one bit per dimension), its length and
its alignment: the inner product with the unit vector that the signs stand for. Against an anchor,
whose rotation is cut into eight bit planes, popcounts of planes and codes give the anchor's
product with that unit vector up to a known rounding. What lies beside the unit vector in both
is bounded by Cauchy-Schwarz, so every inner product has an interval that surely holds it. Rows
whose interval can't reach the result are dropped; all others are scored in whole numbers.

Anchors meet all rows in blocks of at most ``ANCHOR_BYTES``: a block is broadcast, one scan of the index
keeps the best few of each anchor per task, and those are merged. First come the positives, whose
scores then bound the scores of the negatives.

Rows with a NULL id, label or vector, or with a component that is NULL or not finite (as
scale * x too), take no part. Vectors of different lengths don't meet. Rows with the
anchor's own id are neither its positives nor its negatives; repeated rows count as often as they
occur, and a repeated anchor has its result repeated. Scores are exact at any size and are
returned clipped to 64 bits. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import table
from keelson.plans.durable import fresh_path, written

SCALE, PLANES, ANCHOR_BYTES, ROWS = 256, 8, 32 * 2**20, 4096
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
_EXACT = 2.0**53


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim + 11).standard_normal((dim, dim)))[0]


def whole(vectors: np.ndarray, scale: float = SCALE) -> np.ndarray:
    return np.floor(scale * vectors.astype(float))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


def code(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of sign bits, alignment with the signs' unit vector, and length of each row."""
    turned = vectors @ rotation(vectors.shape[1])
    aligned = np.abs(turned).sum(1) / np.sqrt(max(1, vectors.shape[1]))
    return packed(turned > 0), aligned, np.linalg.norm(turned, axis=1)


@dataclass
class Asked:
    """Anchors of one dimension, ready for popcounts."""

    number: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def __post_init__(self):
        with np.errstate(all="ignore"):
            turned = self.vectors @ rotation(self.vectors.shape[1])
            self.low = turned.min(1, initial=0.0)
            self.step = np.maximum((turned.max(1, initial=0.0) - self.low) / (2**PLANES - 1), 1e-300)
            levels = np.nan_to_num(np.rint((turned - self.low[:, None]) / self.step[:, None])).astype(np.int64)
            self.planes = [packed(levels >> k & 1) for k in range(PLANES)]
            self.total = self.low * turned.shape[1] + self.step * levels.sum(1)
            self.rounding = np.abs(turned - self.low[:, None] - self.step[:, None] * levels).sum(1)
            self.length = np.linalg.norm(turned, axis=1)


def intervals(a: Asked, i: slice, codes: np.ndarray, aligned: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of the anchors ``i`` with the coded rows."""
    root = np.sqrt(max(1, a.vectors.shape[1]))
    with np.errstate(all="ignore"):
        levels = np.zeros((len(a.low[i]), len(codes)))
        for k, plane in enumerate(a.planes):
            levels += float(2**k) * np.bitwise_count(plane[i][:, None, :] & codes[None]).sum(2)
        signs = np.bitwise_count(codes).sum(1)
        on = a.low[i][:, None] * signs + a.step[i][:, None] * levels
        along = (2 * on - a.total[i][:, None]) / root
        off = (a.rounding[i] / root)[:, None]
        beside = np.sqrt(np.maximum(a.length[i][:, None] ** 2 - np.maximum(np.abs(along) - off, 0) ** 2, 0))
        left = np.sqrt(np.maximum(length**2 - aligned**2, 0))
        # the last term is far above what 64-bit floats round
        width = aligned * off + beside * left + 1e-9 * a.length[i][:, None] * length
        low, high = along * aligned - width, along * aligned + width
        # squares of a length that overflow or vanish say nothing
        bad = ~(np.isfinite(low) & np.isfinite(high) & (length < 1e150) & (a.length[i][:, None] < 1e150))
    low[bad], high[bad] = -np.inf, np.inf
    return low, high


def exact_scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Whole-number inner products, in floats where these are exact, else in Python's integers."""
    largest = np.abs(rows).max(initial=0.0) * np.abs(anchor).max(initial=0.0) * max(1, len(anchor))
    if largest < _EXACT:
        return (rows @ anchor).astype(np.int64)
    other = [int(x) for x in anchor]
    return np.array([sum(int(x) * y for x, y in zip(r, other)) for r in rows], object)


def as_float(score: int, beyond: float) -> float:
    """The score where a float can hold it, else ``beyond``."""
    return float(score) if abs(int(score)) < 2**1000 else beyond


class Best:
    """The first ``k`` of all (score, id) offered: higher scores first, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.score, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> float:
        return as_float(self.score[-1], -np.inf) if len(self.score) == self.k else -np.inf

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        if score.dtype == object:
            at = np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i])), np.int64)[: self.k]
        else:
            at = np.lexsort((ids, -score))[: self.k]
        self.score, self.ids = score[at], ids[at]


def _clipped(score: np.ndarray) -> list[int]:
    return [max(-(2**63), min(2**63 - 1, int(s))) for s in score]


def _floor_of(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest lower bound of each row: nothing whose upper bound is less is among the first k."""
    if low.shape[1] < k:
        return np.full(len(low), -np.inf)
    return -np.partition(-low, k - 1, axis=1)[:, k - 1]


def _blocks(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple]:
    """Ids, labels, whole vectors, codes, alignments and lengths of rows of one dimension."""
    for batch in batches:
        ids, labels, vectors, words, aligned, length = batch.columns
        sizes = np.diff(vectors.offsets.to_numpy())
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            for k in range(0, len(at), ROWS):
                some = pa.array(at[k : k + ROWS])
                flat = vectors.take(some).flatten().to_numpy(zero_copy_only=False)
                bits = np.frombuffer(b"".join(words.take(some).to_pylist()), np.uint64).reshape(len(some), -1)
                numbers = [c.take(some).to_numpy() for c in (ids, labels, aligned, length)]
                yield int(dim), numbers[0], numbers[1], whole(flat, scale).reshape(len(some), dim), bits, numbers[2], numbers[3]


def index_vectors(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """``vec_id, label, vector, code, aligned, length`` of the rows that take part, as a written table."""
    kind = rows.schema["vector"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False)
                with np.errstate(all="ignore"):
                    bits, aligned, length = code(whole(flat, scale).reshape(part.num_rows, dim))
                words = pa.array([b.tobytes() for b in bits], pa.binary())
                yield pa.record_batch([*part.columns, words, pa.array(aligned), pa.array(length)], ["vec_id", "label", "vector", "code", "aligned", "length"])

    fine = F.forall("vector", lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False)))
    known = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").filter(fine)
    schema = f"vec_id long, label long, vector {kind}, code binary, aligned double, length double"
    return written(known.select("vec_id", "label", "vector").mapInArrow(encode, schema), "one-bit-codes")


def _by_dimension(block: list, scale: float) -> dict[int, Asked]:
    of = defaultdict(list)
    for number, r in enumerate(block):
        of[len(r["vector"])].append((number, r))
    out = {}
    for dim, rows in of.items():
        columns = [np.array([n for n, _ in rows]), *[np.array([r[c] for _, r in rows], np.int64) for c in ("vec_id", "label")]]
        out[dim] = Asked(*columns, whole(np.array([r["vector"] for _, r in rows], float).reshape(len(rows), dim), scale))
    return out


def _first_positives(index: DataFrame, asked, k: int, scale: float) -> DataFrame:
    """``number, vec_id, score``: of every task the first ``k`` rows of each anchor's label."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = defaultdict(lambda: Best(k))
        for dim, ids, labels, vectors, *coded in _blocks(batches, scale):
            if (a := asked.value.get(dim)) is None:
                continue
            for at in range(0, len(a.ids), 64):
                i = slice(at, at + 64)
                fits = (labels == a.labels[i][:, None]) & (ids != a.ids[i][:, None])
                low, high = intervals(a, i, *coded)
                least = _floor_of(np.where(fits, low, -np.inf), k)
                for n in range(len(fits)):
                    held = best[int(a.number[at + n])]
                    to = np.flatnonzero(fits[n] & (high[n] >= max(least[n], held.floor())))
                    if len(to):
                        held.offer(exact_scores(vectors[to], a.vectors[at + n]), ids[to])
        for number, b in best.items():
            if len(b.ids):
                yield pa.record_batch([pa.array([number] * len(b.ids), pa.int32()), pa.array(b.ids), pa.array([str(s) for s in b.score])], ["number", "vec_id", "score"])

    return index.mapInArrow(search, "number int, vec_id long, score string")


def _first_negatives(index: DataFrame, asked, ranges, k: int, scale: float) -> DataFrame:
    """``number, nth, vec_id, score``: of every task the first ``k`` rows of other labels in each range of scores."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = defaultdict(lambda: Best(k))
        for dim, ids, labels, vectors, *coded in _blocks(batches, scale):
            if (a := asked.value.get(dim)) is None:
                continue
            for at in range(0, len(a.ids), 64):
                i = slice(at, at + 64)
                fits = (labels != a.labels[i][:, None]) & (ids != a.ids[i][:, None])
                low, high = intervals(a, i, *coded)
                for n in range(len(fits)):
                    number = int(a.number[at + n])
                    wanted = ranges.value.get(number, [])
                    reach = np.zeros(len(ids), bool)
                    for nth, ends in enumerate(wanted):
                        lowest, highest = as_float(ends[0], -np.inf), as_float(ends[1], np.inf)
                        inside = fits[n] & (high[n] >= lowest) & (low[n] <= highest)
                        # rows that surely lie in the range bound what can still be among the first
                        surely = np.where(inside & (low[n] >= lowest) & (high[n] <= highest), low[n], -np.inf)[None]
                        reach |= inside & (high[n] >= max(_floor_of(surely, k)[0], best[number, nth].floor()))
                    to = np.flatnonzero(reach)
                    if not len(to):
                        continue
                    score = exact_scores(vectors[to], a.vectors[at + n])
                    for nth, (lowest, highest) in enumerate(wanted):
                        good = ((score >= lowest) & (score <= highest)).astype(bool)
                        best[number, nth].offer(score[good], ids[to][good])
        for (number, nth), b in best.items():
            if len(b.ids):
                keys = [pa.array([v] * len(b.ids), pa.int32()) for v in (number, nth)]
                yield pa.record_batch([*keys, pa.array(b.ids), pa.array([str(s) for s in b.score])], ["number", "nth", "vec_id", "score"])

    return index.mapInArrow(search, "number int, nth int, vec_id long, score string")


def _merged(rows, k: int) -> dict:
    """The first ``k`` (score, id) of each key of rows (key, id, score as text)."""
    of = defaultdict(list)
    for key, vec_id, score in rows:
        of[key].append((-int(score), vec_id))
    return {key: [(-s, v) for s, v in sorted(found)[:k]] for key, found in of.items()}


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` of each key; scores are texts of integers of any size."""
    negative, digits = F.startswith("score", F.lit("-")), F.ltrim(F.col("score"), F.lit("-"))
    # as numbers: sign, then number of digits, then digits
    high = [F.when(negative, 0).otherwise(1).desc(), F.when(negative, -F.length(digits)).otherwise(F.length(digits)).desc()]
    order = [*high, F.when(negative, digits).asc_nulls_first(), F.when(~negative, digits).desc_nulls_last(), F.col("vec_id").asc()]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
    high: int = HIGH, scale: float = SCALE, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id, label, vector``; ``anchors`` is a filtered part of them. Negatives of an
    anchor and a positive score at least ``low`` and at most ``high`` percent of the positive.
    """
    spark = rows.sparkSession
    index = index_vectors(rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector"), scale)
    once = index_vectors(anchors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector"), scale)
    once = written(once.groupBy("vec_id", "label", "vector").agg(F.count(F.lit(1)).alias("copies")), "anchors")
    # what a block holds of each anchor: vector, turned vector, planes, and its lists of results
    (size,) = once.agg(F.sum(F.size("vector") * (16 + PLANES // 8) + 400)).first()
    n_blocks = -(-(size or 0) // anchor_bytes)
    block = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(max(1, n_blocks)))
    out = fresh_path(spark, "hard-negatives")
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], shape).write.parquet(out)
    for b in range(n_blocks):
        some = once.filter(block == b).collect()
        asked = spark.sparkContext.broadcast(_by_dimension(some, scale))
        found = _first(_first_positives(index, asked, positives, scale), ["number"], positives).select("number", "vec_id", "score")
        near = _merged(((r["number"], r["vec_id"], r["score"]) for r in found.collect()), positives)
        # low * p <= 100 * n <= high * p, in whole numbers
        ranges = {n: [(-(-low * p // 100), high * p // 100) for p, _ in best] for n, best in near.items()}
        limits = spark.sparkContext.broadcast(ranges)
        far = _first(_first_negatives(index, asked, limits, negatives, scale), ["number", "nth"], negatives)
        of = spark.createDataFrame(
            [(n, k, some[n]["vec_id"], v, _clipped([p])[0], some[n]["copies"]) for n, best in near.items() for k, (p, v) in enumerate(best)],
            "number int, nth int, anchor_id long, positive_id long, positive_score long, copies long",
        )
        least, most = F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")
        exact = F.expr("try_cast(score AS decimal(38,0))")
        # beyond 38 digits, the sign says which end
        score = F.coalesce(F.greatest(least, F.least(most, exact)), F.when(F.startswith("score", F.lit("-")), least).otherwise(most)).cast("long")
        result = far.withColumnRenamed("vec_id", "negative_id").withColumn("negative_score", score).join(of, ["number", "nth"])
        result = result.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(out)
        asked.unpersist()
        limits.unpersist()
    return spark.read.schema(shape).parquet(out)


SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id,
    s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND p.nth <= 5
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
"""


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return mine(rows, rows.filter(F.col("vec_id") % 100 == 0))
