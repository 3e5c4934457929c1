"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A document is the set of its character n-grams (lower-cased for A-Z, hashed to a fixed number
of slots). On labelled rows each slot has a log-count ratio: how much likelier documents of
label 1 have it than documents of label 0. Slots whose two shares differ clearly are kept,
each is scaled by its ratio, and a logistic regression with an L2 penalty is fitted on the
scaled features. Scoring reads whole texts: a table from slot to weight, no shuffle.

The fit uses a bounded sample: about ``max_labelled`` labelled rows, chosen by a hash of the
id. Everything that reaches the driver is bounded by that parameter and by the number of slots.
At most ``MAX_COLUMNS`` slots are kept, those whose shares differ most clearly.

NULL and empty texts have no n-grams and get the score of the intercept. A NULL label is no
label; of several labels of one id the highest counts. Without labels, or with one label only,
there is no ratio, and the score is the smoothed share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import id_remainder, table

SIZES, SLOT_BITS = (3, 4, 5, 6), 20
MAX_LABELLED, SAMPLE_TASKS = 12_000, 8
MIN_DOCS, MIN_Z, MAX_COLUMNS, SMOOTHING = 3, 4.0, 2_000, 1.0
PENALTY, STEPS = 0.1, 300
THRESHOLD = 0.7


def slots(text: str | None) -> np.ndarray:
    """Slot of every n-gram, repeats included."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points + np.uint32(32) * ((points >= 65) & (points <= 90)).astype(np.uint32)
    found, mixed = [], np.zeros(len(points), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(points) < n:
            break
        mixed = mixed[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
        if n in SIZES:
            h = mixed * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            found.append((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOT_BITS))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


@dataclass
class Model:
    """``column`` of a slot, -1 for most; ``weight`` by column, its ratio included."""

    column: np.ndarray
    weight: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        have = np.unique(self.column[slots(text)])
        z = self.intercept + float(self.weight[have[have >= 0]].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _counts(sample: DataFrame) -> np.ndarray:
    """Documents of label 0 and 1 by slot, and their numbers in the last place."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 2**SLOT_BITS + 1), np.int32)
        for batch in batches:
            for text, label in zip(*[c.to_pylist() for c in batch.columns]):
                total[label, np.unique(slots(text))] += 1
                total[label, -1] += 1
        if total[:, -1].any():
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["total"])

    out = np.zeros((2, 2**SLOT_BITS + 1), np.int64)
    for row in sample.mapInArrow(count, "total binary").toLocalIterator():
        out += np.frombuffer(row["total"], np.int32).reshape(out.shape)
    return out


def _rows(sample: DataFrame, column: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and the kept columns of every document of the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(column)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = [np.unique(shared.value[slots(t)]) for t in batch.column(0).to_pylist()]
            have = [h[h >= 0].astype("<i4").tobytes() for h in have]
            yield pa.record_batch([batch.column(1), pa.array(have, pa.binary())], ["label", "have"])

    rows = sorted((r["label"], bytes(r["have"])) for r in sample.mapInArrow(pick, "label int, have binary").collect())
    return np.array([label for label, _ in rows], float), [np.frombuffer(have, "<i4") for _, have in rows]


def _regression(labels: np.ndarray, have: list[np.ndarray], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features by gradient steps with adaptive moments."""
    row = np.repeat(np.arange(len(have)), [len(h) for h in have])
    col = np.concatenate(have)
    value = ratio[col]
    k = len(ratio)
    w = np.zeros(k + 1)
    w[k] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        z = w[k] + np.bincount(row, value * w[col], len(labels))
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        g = np.append(np.bincount(col, value * error[row], k) + PENALTY * w[:k], error.sum()) / len(labels)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:k] * ratio, float(w[k])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_labelled: int = MAX_LABELLED,
) -> Model:
    """Learn from ``labels`` (its id column is named as that of ``docs``)."""
    named = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).dropna()
    one_each = named.filter("label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    (known,) = one_each.agg(F.count(F.lit(1))).first()
    share = min(1.0, max_labelled / max(known, 1))
    chosen = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(2**30)) < int(share * 2**30)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter(chosen)
    sample = texts.join(one_each.filter(chosen), "id").select("text", "label").coalesce(SAMPLE_TASKS)

    counts = _counts(sample)
    (n0, n1), (in0, in1) = counts[:, -1], counts[:, :-1]
    share1 = (n1 + 1) / (n0 + n1 + 2)
    nothing = Model(np.full(2**SLOT_BITS, -1, np.int32), np.empty(0), float(np.log(share1 / (1 - share1))))
    if not n0 or not n1:
        return nothing
    p1, p0, both = in1 / n1, in0 / n0, (in0 + in1) / (n0 + n1)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n0 + 1 / n1))
    kept = np.flatnonzero((in0 + in1 >= MIN_DOCS) & (z >= MIN_Z))
    kept = np.sort(kept[np.lexsort((kept, -z[kept]))[:MAX_COLUMNS]])
    if not len(kept):
        return nothing
    a1, a0 = (in1[kept] + SMOOTHING) / (n1 + 2 * SMOOTHING), (in0[kept] + SMOOTHING) / (n0 + 2 * SMOOTHING)
    column = np.full(2**SLOT_BITS, -1, np.int32)
    column[kept] = np.arange(len(kept))
    weight, intercept = _regression(*_rows(sample, column), np.log(a1 / a0))
    return Model(column, weight, intercept)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shared.value.score(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scored, "doc_id long, score double")


def below(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below ``threshold``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [shared.value.score(t) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = id_remainder(F.col("doc_id"), 3, 1) == 1
    scored = score(docs, fit(docs, labels.filter(~held_out)))
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))
