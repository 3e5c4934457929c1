"""Packing of tokenized documents into sequences by minimum bin slack.

Every document is cut into whole windows and a rest shorter than a window. How rests share
windows depends only on how many there are of each length, a table of fewer rows than the
window has tokens, whatever the size of the corpus. From it the driver makes a plan: starting
with the longest length left, a subset-sum dynamic program over bit sets finds the reachable
fillings of the window, the one closest to its capacity is traced back to counts per length,
and that multiset is used as often as the counts allow. Lengths with no filling within the
allowed slack are laid end to end and cut where a window ends, which wastes nothing either.

Rests of one length are interchangeable, so the plan is applied by rank: a rest is numbered
within its length, in blocks so that no length is ordered in one task, and its rank says which
copy of which multiset it is in, and where. Only the last sequence may be padded.

NULL and empty texts are one end token. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keelson.llm.common import table
from keelson.llm.tokens import encoded, slices
from keelson.plans.durable import written

CAPACITY, ROWS_PER_BLOCK = 1024, 20_000
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, width int"


def best_filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts per length of the multiset with the sum closest to ``capacity`` from below."""
    reachable, steps = 1, []
    fits = (1 << (capacity + 1)) - 1
    for length in sorted((k for k in counts if counts[k] and k <= capacity), reverse=True):
        left, chunk = min(counts[length], capacity // length), 1
        while left:  # 1, 2, 4, ... copies at once reach every count
            taken = min(chunk, left)
            more = reachable | (reachable << (taken * length)) & fits
            steps.append((length, taken, reachable))
            reachable, left, chunk = more, left - taken, chunk * 2
        if reachable >> capacity & 1:
            break
    total, found = reachable.bit_length() - 1, {}
    for length, taken, before in reversed(steps):
        if not before >> total & 1:
            found[length] = found.get(length, 0) + taken
            total -= taken * length
    return found


@dataclass
class Plan:
    """Where the rest with a given length and rank goes.

    ``runs`` has, per length and ascending, (first rank, copies per sequence, first sequence,
    first offset); after the last run of a length, ranks from ``tail_rank`` lie end to end from
    position ``tail_at`` of the sequences from ``tail_sequence`` on.
    """

    capacity: int
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    tail_rank: dict[int, int] = field(default_factory=dict)
    tail_at: dict[int, int] = field(default_factory=dict)
    tail_sequence: int = 0
    sequences: int = 0


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, slack: int = 0) -> Plan:
    """A plan for ``counts`` pieces per length. A filling may leave ``slack`` tokens empty."""
    plan, left, used, cut = Plan(capacity), dict(counts), dict.fromkeys(counts, 0), set()
    while open_lengths := [k for k, n in left.items() if n and k not in cut]:
        seed = max(open_lengths)
        others = {k: n - (k == seed) for k, n in left.items() if k not in cut}
        filling = best_filling(others, capacity - seed)
        filling[seed] = filling.get(seed, 0) + 1
        if capacity - sum(k * n for k, n in filling.items()) > slack:
            cut.add(seed)
            continue
        copies, offset = min(left[k] // n for k, n in filling.items()), 0
        for length, n in filling.items():
            plan.runs.setdefault(length, []).append((used[length], n, plan.sequences, offset))
            offset += length * n
            used[length] += n * copies
            left[length] -= n * copies
        plan.sequences += copies
    plan.tail_sequence, at = plan.sequences, 0
    for length in sorted(counts):
        plan.tail_rank[length], plan.tail_at[length] = used[length], at
        at += left[length] * length
    plan.sequences += -(-at // capacity)
    return plan


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, doc_id: str, text: str) -> DataFrame:
    """Pieces of at most ``capacity`` tokens with their ids; documents end with ``end_id``."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, dtype in encoded(batches, tokenizer, "text"):
            width, end = int(dtype[-1]), np.array([end_id], dtype).tobytes()
            keys = batch.column(0).to_pylist()
            rows = []
            for key, raw in zip(keys, ids):
                raw += end
                n = len(raw) // width
                for at in range(0, n, capacity):
                    part = raw[at * width : (at + capacity) * width]
                    rows.append((key, at, len(part) // width, n, part, width))
            if rows:
                types = [pa.int64()] * 4 + [pa.binary(), pa.int32()]
                names = [c.split()[0] for c in PIECES.split(", ")]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(pieces, PIECES)


def rank_within_length(pieces: DataFrame, rows_per_block: int) -> DataFrame:
    """``rank`` from 0 among pieces of one length: a block's base plus the rank in the block."""
    (n,) = pieces.agg(F.count(F.lit(1))).first()
    block = F.pmod(F.xxhash64("doc_id", "start", "doc_tokens"), F.lit(-(-n // rows_per_block) or 1))
    blocks = pieces.withColumn("block", block)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        blocks.groupBy("length", "block")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids")
    ranked = blocks.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(bases, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("base"))


def place(ranked: DataFrame, plan: Plan) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids, width`` of the final pieces."""
    capacity = plan.capacity

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_ranks = {k: np.array([r[0] for r in runs]) for k, runs in plan.runs.items()}
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for key, start, n, total, ids, width, rank in zip(*[c.to_pylist() for c in batch.columns]):
                if rank < plan.tail_rank[n]:
                    run = plan.runs[n][int(np.searchsorted(first_ranks[n], rank, "right")) - 1]
                    copy, nth = divmod(rank - run[0], run[1])
                    rows.append((key, start, n, total, run[2] + copy, run[3] + nth * n, ids, width))
                    continue
                at, done = plan.tail_at[n] + (rank - plan.tail_rank[n]) * n, 0
                while done < n:
                    sequence, offset = divmod(at + done, capacity)
                    take = min(n - done, capacity - offset)
                    part = ids[done * width : (done + take) * width]
                    rows.append((key, start + done, take, total, plan.tail_sequence + sequence, offset, part, width))
                    done += take
            if rows:
                types = [pa.int64()] * 6 + [pa.binary(), pa.int32()]
                names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "width"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    wanted = ranked.select("doc_id", "start", "length", "doc_tokens", "ids", "width", "rank")
    return wanted.mapInArrow(
        placed,
        "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, width int",
    )


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    slack: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """One row per piece with its ids and its place; pad each sequence to ``capacity`` when read."""
    pieces = written(cut_documents(docs, tokenizer, end_id, capacity, doc_id, text), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_sequences(counts, capacity, slack)
    return place(rank_within_length(pieces, rows_per_block), plan)


def with_checksums(pieces: DataFrame) -> DataFrame:
    """Pieces with ``ids_crc32`` of their ids as 32-bit integers in place of the ids."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            *kept, ids, widths = batch.columns
            crc = [
                zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes())
                for x, w in zip(ids.to_pylist(), widths.to_pylist())
            ]
            yield pa.record_batch([*kept, pa.array(crc, pa.int64())], [*batch.schema.names[:-2], "ids_crc32"])

    return pieces.mapInArrow(
        sums, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    )


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return with_checksums(packed)
