"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen when its minimal inner s-mer lies at one of its edges. The
choice looks at nothing outside the k-mer, so equal passages have equal anchors wherever they
stand, and what is edited elsewhere doesn't move them. The anchors of a text are (position,
hash) of its chosen k-mers; its fingerprint is the set of all its distinct hashes, whatever its
length, as hex digits in ascending order; the sketch is the smallest 64 of them. The likeness of two
texts is the share of anchors that match among all anchors of both: equal hashes are paired in the
order of their positions, and a pair counts where another one has the same offset.

A text shorter than a k-mer, or with no chosen k-mer, is one anchor of all of it. NULL and
empty texts have no anchors and an empty fingerprint; two empty fingerprints are alike (1).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import table
from keelson.llm.ranges import id_ranges

K, S, SKETCH = 16, 9, 64
ROWS_PER_RANGE = 8_000


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _windows(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` code points: a polynomial, by doubling run lengths."""
    base = 0x9E3779B97F4A7C15
    run, length, h, done = points.astype(np.uint64), 1, None, 0
    while n:
        if n & 1:
            piece = run[done:] if h is not None else run
            if h is None:
                h = piece
            else:
                factor = np.uint64(pow(base, length, 2**64))
                size = len(piece)
                h = h[:size] * factor + piece[: len(h)]
            done += length
        n >>= 1
        if n:
            factor = np.uint64(pow(base, length, 2**64))
            run = run[:-length] * factor + run[length:]
            length *= 2
    return _mix(h)


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the closed syncmers; all of a short text is one anchor."""
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(points) >= k:
        inner, width = _windows(points, s), k - s + 1
        low, span = inner, 1
        while span < width:
            step = min(span, width - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        n = len(points) - k + 1
        at = np.flatnonzero((inner[:n] == low) | (inner[width - 1 : width - 1 + n] == low))
        if len(at):
            return at, _windows(points, k)[at]
    whole = int.from_bytes(hashlib.sha256(points.tobytes()).digest()[:8], "little")
    return np.zeros(1, np.int64), np.array([whole], np.uint64)


def sketch(points: np.ndarray, k: int = K, s: int = S, size: int | None = None) -> np.ndarray:
    """The distinct anchor hashes, 32 bits each, ascending; the smallest ``size`` of them if given."""
    return distinct(anchors(points, k, s)[1])[:size]


def distinct(hashes: np.ndarray) -> np.ndarray:
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def as_text(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def keyed(found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and a key of (hash, how many equal hashes stand before), by ascending key."""
    at, hashes = found
    order = np.argsort(hashes, kind="stable")
    at, hashes = at[order], hashes[order]
    n = np.arange(len(at))
    new = np.ones(len(at), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    before = n - np.maximum.accumulate(np.where(new, n, 0))
    key = _mix(hashes + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    return at[order], key[order]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Matched anchors of two keyed texts among all anchors of both."""
    if not len(a[0]) and not len(b[0]):
        return 1.0
    _, i, j = np.intersect1d(a[1], b[1], assume_unique=True, return_indices=True)
    _, times = np.unique(b[0][j] - a[0][i], return_counts=True)
    # one anchor alone has no other to agree with
    matched = int(times[times > 1].sum()) if min(len(a[0]), len(b[0])) > 1 else len(i)
    return matched / (len(a[0]) + len(b[0]) - matched)


def followed(docs: DataFrame, rows_per_range: int) -> tuple[DataFrame, int]:
    """Rows with ``range`` and ``closing``; the closing row of a range is the first one of the next.

    Texts move once, to the range of their id; only one row per range goes a second way.
    """
    ranged, n = id_ranges(docs, "doc_id", rows_per_range)
    firsts = ranged.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"))
    # one row per range, as many as there are borders
    heads = [(r["range"], r["first"]["doc_id"]) for r in firsts.orderBy("range").collect()]
    before = [(at, heads[k - 1][0]) for k, (at, _) in enumerate(heads)]
    is_head = F.col("doc_id").isin([key for _, key in heads if key is not None])
    if any(key is None for _, key in heads):
        is_head = is_head | F.col("doc_id").isNull()
    closing = (
        ranged.filter(is_head)
        .join(docs.sparkSession.createDataFrame(before, "range int, to int"), "range")
        .groupBy(F.col("to").alias("range"), "doc_id")
        .agg(F.min("text").alias("text"))
    )
    rows = ranged.select("range", F.lit(0).alias("closing"), "doc_id", "text").union(
        closing.select("range", F.lit(1), "doc_id", "text")
    )
    return rows, n


def fingerprint_edits(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, s: int = S, size: int = SKETCH,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how alike they are.

    The edited text ends with the first floor(n/4) code points of the next document (by id,
    then text; the last one is followed by the first) in place of as many of its own.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, sketch string, edited_sketch string"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in schema.split(", ")]
        held = None  # the row before: range, id, points, hashes, keyed anchors
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # fingerprints are long
                out = []
                for in_range, closing, key, content in zip(*[c.to_pylist() for c in whole.slice(at, 500).columns]):
                    points = code_points(content)
                    found = anchors(points, k, s)
                    own, own_keyed = distinct(found[1]), keyed(found)
                    if held is not None and held[0] == in_range:
                        _, before_key, before, before_own, before_keyed = held
                        m = len(before) // 4
                        edited = np.concatenate([before[: len(before) - m], points[:m]])
                        found = anchors(edited, k, s)
                        changed = distinct(found[1])
                        digest = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"))
                        out.append(
                            (before_key, len(before), digest.hexdigest(), as_text(before_own), as_text(changed),
                             likeness(before_keyed, keyed(found)), likeness(before_keyed, own_keyed),
                             as_text(before_own[:size]), as_text(changed[:size]))
                        )
                    held = None if closing else (in_range, key, points, own, own_keyed)
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    pairs, n = followed(rows, rows_per_range)
    ordered = pairs.repartition(n, "range").sortWithinPartitions("range", "closing", "doc_id", "text")
    return ordered.mapInArrow(compare, schema)


def op6_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint_edits(table(spark, folder, "documents"))
