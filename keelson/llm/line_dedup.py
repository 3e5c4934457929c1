"""Repeated lines: the first document of a line keeps it, and every document gets a bitmap.

A line's key is the line without ASCII white space at its ends, lower-cased for A-Z. Keys of at
least ``min_chars`` code points travel as 128 bits of a hash with (document, row, position). These
occurrences are range-partitioned by all of that, so a line that stands in a third of all documents
fills many ranges, and sorted within a range; a task streams its range holding one key and the first
document of that key. Only what starts a range can be undecided: the first document of its first
key, as the key may have begun in an earlier range. Those rows are settled afterwards from one
row per range (first key, last key, first document of the last key).

What comes back is positions of dropped lines, folded into one zlib-compressed keep bitmap per
document; texts are not moved for it. ``without_repeats`` applies the bitmaps.

A document is a doc_id: rows that share one keep their lines alike, and a NULL id is the last
document in order. NULL and empty texts are one empty line. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import table
from keelson.plans.durable import written

MIN_CHARS = 10
_ROWS = 50_000
KEYED = "hi long, lo long, doc_id long, of long, pos int"
DECIDED = "kind int, part int, hi long, lo long, doc_id long, of long, pos int, last_hi long, last_lo long, last_doc long"
DROP, OPEN, BORDER = 0, 1, 2


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line in UTF-8, None where it is too short."""
    key = line.strip(b" \t\n\r\x0b\x0c").lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "surrogatepass")) < min_chars):
        return None
    return key


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, of, text``; ``of`` tells apart rows of one id by their text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("of"), "text")


def occurrences(rows: DataFrame, min_chars: int) -> DataFrame:
    """One row per line with a key: its hash, document, row and position."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            keys, at, pos = [], [], []

            def flush() -> pa.RecordBatch:
                h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                take = pa.array(at, pa.int32())
                cols = [pa.array(h[:, 1]), pa.array(h[:, 0]), batch.column(0).take(take), batch.column(1).take(take), pa.array(pos, pa.int32())]
                return pa.record_batch(cols, ["hi", "lo", "doc_id", "of", "pos"])

            for i in range(batch.num_rows):
                for n, line in enumerate(batch.column(2)[i].as_buffer().to_pybytes().split(b"\n")):
                    if (key := line_key(line, min_chars)) is not None:
                        keys.append(digest(key))
                        at.append(i)
                        pos.append(n)
                        if len(keys) == _ROWS:
                            yield flush()
                            keys, at, pos = [], [], []
            if keys:
                yield flush()

    return rows.select("doc_id", "of", "text").mapInArrow(hashed, KEYED)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to drop, rows left open at the start of the range, and one row about the range's ends."""
    part, schema = TaskContext.get().partitionId(), pa.schema(
        [("kind", pa.int32()), ("part", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("of", pa.int64()),
         ("pos", pa.int32()), ("last_hi", pa.int64()), ("last_lo", pa.int64()), ("last_doc", pa.int64())]
    )
    first = last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        hi, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        known = batch.column(2).is_valid().to_numpy(False)
        doc = batch.column(2).fill_null(0).to_numpy()
        new = np.ones(n, bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        if last is not None:
            new[0] = (hi[0], lo[0]) != last[:2]
        if first is None:
            first = (int(hi[0]), int(lo[0]))
        # where the key of each row began; -1: in an earlier batch
        began = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        first_doc, first_known = doc[began], known[began]
        if last is not None:
            first_doc, first_known = np.where(began < 0, last[2], first_doc), np.where(began < 0, last[3], first_known)
        same = (doc == first_doc) & (known == first_known)
        head = same & (hi == first[0]) & (lo == first[1])
        last = (int(hi[-1]), int(lo[-1]), int(first_doc[-1]), bool(first_known[-1]))
        for kind, picked in ((DROP, ~same), (OPEN, head)):
            at = np.flatnonzero(picked)
            if len(at):
                rows = batch.take(pa.array(at))
                fixed = [pa.array(np.full(len(at), v, np.int32)) for v in (kind, part)]
                yield pa.record_batch([*fixed, *rows.columns, *[pa.nulls(len(at), pa.int64())] * 3], schema=schema)
    if first is not None:
        ends = {"kind": BORDER, "part": part, "hi": first[0], "lo": first[1], "last_hi": last[0], "last_lo": last[1]}
        yield pa.RecordBatch.from_pylist([ends | {"last_doc": last[2] if last[3] else None}], schema=schema)


def _carried(borders: list) -> list[tuple[int, int | None]]:
    """(range, first document of its first key) where that key began in an earlier range."""
    out, key, doc = [], None, None
    for b in sorted(borders, key=lambda b: b["part"]):
        first, end = (b["hi"], b["lo"]), (b["last_hi"], b["last_lo"])
        if first == key:
            out.append((b["part"], doc))
        if end != key:
            key, doc = end, b["last_doc"]
    return out


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, of, pos`` of every line that an earlier document has; ``of`` is xxhash64 of the text."""
    order = [F.col("hi"), F.col("lo"), F.col("doc_id").asc_nulls_last(), F.col("of"), F.col("pos")]
    found = written(occurrences(_rows(docs, doc_id, text), min_chars), "line-keys")
    swept = found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_decide, DECIDED)
    swept = written(swept, "line-decisions")
    # one row per range
    carried = _carried(swept.filter(F.col("kind") == BORDER).collect())
    begun = docs.sparkSession.createDataFrame(carried, "part int, first long")
    late = swept.filter(F.col("kind") == OPEN).join(begun, "part").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    picked = ["doc_id", "of", "pos"]
    return swept.filter(F.col("kind") == DROP).select(*picked).union(late.select(*picked))


def keep_bits(n: int, dropped: np.ndarray) -> bytes:
    """``n`` bits, first line in the highest bit of the first byte, 0 for a dropped line; compressed."""
    keep = np.ones(n, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def kept(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n).astype(bool)


def line_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, of, n_lines, n_dropped, keep`` once for each distinct (doc_id, text)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, dropped = batch.column(2).to_pylist(), [np.array(p or [], np.int64) for p in batch.column(3).to_pylist()]
            counts = pa.array([len(p) for p in dropped], pa.int64())
            bits = pa.array([keep_bits(n, p) for n, p in zip(sizes, dropped)], pa.binary())
            yield pa.record_batch([*batch.columns[:3], counts, bits], ["doc_id", "of", "n_lines", "n_dropped", "keep"])

    rows = _rows(docs, doc_id, text)
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    sizes = rows.select("doc_id", "of", lines.alias("n_lines")).distinct()
    # a set, as repeated rows drop the same positions; not longer than the lines of one text
    drops = dropped_lines(docs, doc_id, text, min_chars).groupBy("doc_id", "of").agg(F.collect_set("pos").alias("dropped"))
    drops = drops.withColumnsRenamed({"doc_id": "in_doc", "of": "in_row"})
    same = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("of") == F.col("in_row"))
    joined = sizes.join(drops, same, "left").select("doc_id", "of", "n_lines", "dropped")
    return joined.mapInArrow(fold, "doc_id long, of long, n_lines long, n_dropped long, keep binary")


def _with_bits(docs: DataFrame, bitmaps: DataFrame, doc_id: str, text: str) -> DataFrame:
    renamed = bitmaps.withColumnsRenamed({"doc_id": "in_doc", "of": "in_row"})
    same = F.col("doc_id").eqNullSafe(F.col("in_doc")) & (F.col("of") == F.col("in_row"))
    # every row has its bitmap; a left join lets a document with most of the rows be split
    return _rows(docs, doc_id, text).join(renamed, same, "left").select("doc_id", "text", "n_lines", "n_dropped", "keep")


def _kept_text(text: bytes, n: int, bits: bytes) -> bytes:
    lines = text.split(b"\n")
    return b"\n".join([lines[i] for i in np.flatnonzero(kept(bits, n))])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, text`` of every row, the text without its dropped lines."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            texts = [_kept_text(t.as_buffer().to_pybytes(), n, b) for t, n, b in zip(batch.column(1), sizes, bits)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    bitmaps = line_bitmaps(docs, doc_id, text, min_chars)
    return _with_bits(docs, bitmaps, doc_id, text).mapInArrow(apply, "doc_id long, text string")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            sums = [hashlib.sha256(_kept_text(t.as_buffer().to_pybytes(), n, b)).hexdigest() for t, n, b in zip(batch.column(1), sizes, bits)]
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(sums, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    bitmaps = line_bitmaps(docs, doc_id, text, min_chars)
    return _with_bits(docs, bitmaps, doc_id, text).mapInArrow(apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS docs FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (SELECT k.*, coalesce(m.docs > 1 AND k.doc_id <> m.first_doc, false) AS dropped FROM k LEFT JOIN m USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))
