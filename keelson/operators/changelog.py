"""Change logs: compaction, replay, and checkpoints that prove what they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.hashing import hash_number, row_hash
from keelson.plans.joins import match
from keelson.plans.ordered import Running, plan_chunks, with_running


def _latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row per key, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return newest.select(*key, "__row.*").select(*rows.columns)


def compact_changelog(
    log: DataFrame, key: list[str], ts: str, before: Column, order: list[str] = ()
) -> DataFrame:
    """Fold everything strictly older than ``before`` into the last row per key.

    Folded rows carry the time of the last change that was folded and ``folded = true``.
    Newer rows, and rows without a time, are kept as they are. Fewer than two foldable
    rows are refused.
    """
    old = log.filter(F.col(ts) < before)
    n, last = old.agg(F.count("*"), F.max(ts)).first()
    if n < 2:
        raise ValueError(f"need at least 2 changes before the cutoff, found {n}")
    stamp = F.lit(last).cast(log.schema[ts].dataType)
    folded = _latest(old, key, [ts, *order]).withColumn(ts, stamp).select(*log.columns)
    kept = log.filter(F.col(ts).isNull() | (F.col(ts) >= before))
    return folded.withColumn("folded", F.lit(True)).unionByName(kept.withColumn("folded", F.lit(False)))


def replay(log: DataFrame, key: list[str], order: list[str], deleted: Column | None = None) -> DataFrame:
    """The state after all changes: the last row per key, without deleted keys."""
    state = _latest(log, key, order)
    return state.filter(~deleted) if deleted is not None else state


def replay_from_checkpoint(
    snapshot: DataFrame,
    log: DataFrame,
    key: list[str],
    order: list[str],
    after: Column,
    deleted: Column | None = None,
) -> DataFrame:
    """Apply only the changes for which ``after`` holds to a snapshot of the earlier ones.

    The snapshot keeps the order columns of the rows it holds (deleted ones included), so
    the result equals a full replay.
    """
    later = log.filter(after)
    return replay(snapshot.select(*log.columns).unionByName(later), key, order, deleted)


def prefix_hash(
    log: DataFrame, part: list[str], order: list[str], cols: list[str], chunk: Column | None = None
) -> DataFrame:
    """Add the hash of everything up to and including each row of its part.

    Running sums of hashes of (order columns, row) identify the ordered prefix: moving a
    text to another place changes it. They cost the same for every row and carry over
    chunk borders, so a part may be of any size.
    """
    if chunk is None:
        chunk = plan_chunks(log, order, keys=part)
    hashed = log.withColumn("__h", row_hash([F.col(c) for c in (*order, *cols)]))
    summed = with_running(
        hashed,
        part,
        order,
        {
            "__n": Running("sum", F.lit(1).cast("bigint")),
            "__a": Running("sum", hash_number(F.col("__h"), 1)),
            "__b": Running("sum", hash_number(F.col("__h"), 16)),
        },
        chunk,
    )
    whole = F.concat_ws(":", "__n", "__a", "__b")
    return summed.withColumn("prefix_hash", F.sha2(whole, 256)).drop("__n", "__h", "__a", "__b")


def latest_valid_checkpoint(
    checkpoints: DataFrame, hashed_log: DataFrame, part: list[str], order: list[str]
) -> DataFrame:
    """Per part the newest checkpoint whose content and prefix hashes both still match.

    ``checkpoints`` has the part and order columns, ``content``, ``content_hash`` and
    ``prefix_hash``; ``hashed_log`` is the output of ``prefix_hash``. A part without a row
    in the result starts from scratch.
    """
    intact = checkpoints.filter(F.sha2("content", 256) == F.col("content_hash"))
    on = [*part, *order, "prefix_hash"]
    valid = match(intact, hashed_log.select(*on), on, "left_semi")
    return _latest(valid, part, order)
