"""Token ids as flat binary files that are memory-mapped for reading.

The file format, one pair of files per range of documents, numbered in ascending doc_id order:

* ``tokens-NNNNN.bin``: ids, little-endian unsigned, 16 or 32 bits as the vocabulary needs.
* ``tokens-NNNNN.idx``: little-endian 64-bit integers; the number of documents and how many of
  them, the first ones, have a NULL id; the id of each document; the offset of each document
  within the file in ids, and the end offset.

A range's base, the number of ids in all files before it, is the prefix sum over the files'
own totals. Ranges come from quantiles of doc_id over all rows. Files are written under a name
of the attempt and renamed, so an attempt that is lost or repeated leaves the same file.

A NULL or empty text is only its end id. Rows are ordered by doc_id (NULL first), then ids;
repeated rows are written repeatedly. An empty table has no files.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import table
from keelson.llm.ranges import id_ranges
from keelson.llm.tokens import encoded
from keelson.plans.durable import fresh_path

ROWS_PER_FILE = 20_000


def _store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    if urlparse(folder).scheme:
        return pa.fs.FileSystem.from_uri(folder)
    return pa.fs.LocalFileSystem(), os.path.abspath(folder)


class _Output:
    """A file that appears under its name only when it is whole."""

    def __init__(self, folder: str, number: int, kind: str):
        self.fs, root = _store(folder)
        self.attempt = f"{root}/_{kind}-{number}-{uuid.uuid4().hex}"
        self.name = f"{root}/tokens-{number:05d}.{kind}"
        self.out = self.fs.open_output_stream(self.attempt)
        self.write = self.out.write

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.attempt, self.name)


def _mapped(folder: str, number: int, kind: str, dtype: str) -> np.ndarray:
    """The file as an array: mapped from a local or mounted folder, else read."""
    fs, root = _store(folder)
    path = f"{root}/tokens-{number:05d}.{kind}"
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    rows_per_file: int = ROWS_PER_FILE,
) -> DataFrame:
    """Write the files and return one row per file: ``file, docs, tokens, base, width``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    ranged, n_files = id_ranges(rows, "id", rows_per_file)
    fs, root = _store(folder)
    fs.create_dir(root, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, dtype in encoded(batches, tokenizer, "text"):
            end = np.array([end_id], dtype).tobytes()
            width = pa.array([int(dtype[-1])] * len(ids), pa.int32())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([x + end for x in ids], pa.binary()), width],
                ["file", "id", "ids", "width"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, out, keys, sizes, width = None, None, [], [], 0

        def close() -> pa.RecordBatch:
            out.done()
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
            known = np.array([0 if k is None else k for k in keys], "<i8")
            head = np.array([len(keys), sum(k is None for k in keys)], "<i8")
            index = _Output(folder, file, "idx")
            index.write(np.concatenate([head, known, offsets]).tobytes())
            index.done()
            row = {"file": file, "docs": len(keys), "tokens": int(offsets[-1]), "width": width}
            return pa.RecordBatch.from_pylist([row], schema=FILES)

        for batch in batches:
            for number, key, ids, w in zip(*[c.to_pylist() for c in batch.columns]):
                if number != file:
                    if out is not None:
                        yield close()
                    file, out, keys, sizes, width = number, _Output(folder, number, "bin"), [], [], w
                keys.append(key)
                sizes.append(len(ids) // w)
                out.write(ids)
        if out is not None:
            yield close()

    FILES = pa.schema([("file", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("width", pa.int32())])
    ids = ranged.select(F.col("range").cast("long").alias("file"), "id", "text").mapInArrow(
        encode, "file long, id long, ids binary, width int"
    )
    sorted_ids = ids.repartition(n_files, "file").sortWithinPartitions("file", "id", "ids")
    listed = fresh_path(docs.sparkSession, "token-files")
    sorted_ids.mapInArrow(write, "file long, docs long, tokens long, width int").write.parquet(listed)
    files = docs.sparkSession.read.schema("file long, docs long, tokens long, width int").parquet(listed)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file: the window has as many rows as there are files
    return files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the mapped files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = _mapped(folder, row["file"], "idx", "<i8")
                ids = _mapped(folder, row["file"], "bin", f"<u{row['width']}")
                n, nulls = int(index[0]), int(index[1])
                offsets = index[2 + n :]
                for at in range(0, n, 4096):
                    to = min(n, at + 4096)
                    sums = [zlib.crc32(ids[offsets[k] : offsets[k + 1]].astype("<u4").tobytes()) for k in range(at, to)]
                    keys = [None if k < nulls else int(index[2 + k]) for k in range(at, to)]
                    yield pa.record_batch(
                        [
                            pa.array(keys, pa.int64()),
                            pa.array(row["base"] + offsets[at:to].astype("i8")),
                            pa.array(np.diff(offsets[at : to + 1]).astype("i8")),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    spread = files.select("file", "base", "width").repartition("file")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    target = fresh_path(spark, "tokens")
    files = write_token_files(
        table(spark, folder, "documents"), target, public_tokenizers.path("word_bpe_49k.json"), end_id=2
    )
    return read_token_files(files, target)
