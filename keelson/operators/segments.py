"""Splitting ordered logs at markers.

``C`` closes and ``B`` begins. ``C`` directly followed by ``B`` is a boundary; a lone ``C``
opens an outside section and a lone ``B`` (or the end of the log) ends it. A section that a
lone ``C`` opens and another ``C`` ends counts as inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.plans.joins import match
from keelson.plans.ordered import Running, plan_chunks, with_running

# Fixed value: rows per piece of an inside section.
PIECE_ROWS = 50


def _numbered(log: DataFrame, part: list[str], order: list[str], marker: Column, chunk: Column | None) -> DataFrame:
    if chunk is None:
        chunk = plan_chunks(log, order, keys=part)
    is_marker = F.col("__marker").isNotNull()
    return with_running(
        log.withColumn("__marker", marker),
        part,
        order,
        {
            "section": Running("sum", is_marker.cast("bigint")),
            "__row": Running("sum", (~is_marker).cast("bigint")),
        },
        chunk,
    )


def _sections(numbered: DataFrame, part: list[str]) -> DataFrame:
    """One row per non-empty section: its kind, its rows and its first row.

    Between two counted markers lies a section, possibly empty. A non-empty one behind a
    ``C`` was opened by a lone ``C``, and a ``B`` that ends it is a lone ``B``, so the two
    neighbouring markers decide the kind. A marker counts as the opener of its own section
    and as the closer of the one before, in one aggregate without a join.
    """
    marker, section, row = F.col("__marker"), F.col("section"), F.col("__row")

    def seen(at: Column, opened: Column, closed: Column, position: Column) -> Column:
        return F.struct(at.alias("section"), opened.alias("opened"), closed.alias("closed"), position.alias("row"))

    is_c, no, no_row = marker == "C", F.lit(False), F.lit(None).cast("bigint")
    parts = F.when(marker.isNull(), F.array(seen(section, no, no, row))).otherwise(
        F.array(seen(section, is_c, no, no_row), seen(section - 1, no, is_c, no_row))
    )
    grouped = (
        numbered.select(*part, F.inline(parts))
        .groupBy(*part, "section")
        .agg(
            F.bool_or("opened").alias("opened"),
            F.bool_or("closed").alias("closed"),
            F.count("row").alias("n_rows"),
            F.min("row").alias("first_row"),
        )
    )
    kind = F.when(F.expr("opened AND NOT closed"), "outside").otherwise("inside")
    return grouped.filter("n_rows > 0").select(*part, "section", "n_rows", "first_row", kind.alias("kind"))


def log_sections(
    log: DataFrame, part: list[str], order: list[str], marker: Column, chunk: Column | None = None
) -> DataFrame:
    """``(part…, section, n_rows, kind)`` of the non-empty sections."""
    return _sections(_numbered(log, part, order, marker, chunk), part).drop("first_row")


def segment_log(
    log: DataFrame,
    part: list[str],
    order: list[str],
    marker: Column,
    piece_rows: int = PIECE_ROWS,
    chunk: Column | None = None,
) -> DataFrame:
    """The rows between markers with ``section``, ``kind`` and ``piece``.

    ``marker`` is ``'C'``, ``'B'`` or NULL. Inside sections are cut into pieces of
    ``piece_rows``; outside sections are never cut.
    """
    numbered = _numbered(log, part, order, marker, chunk)
    sections = _sections(numbered, part).drop("n_rows")
    piece = F.when(F.col("kind") == "inside", F.expr(f"(__row - first_row) div {piece_rows}")).otherwise(
        F.lit(0).cast("bigint")
    )
    rows = numbered.filter("__marker IS NULL").drop("__marker")
    return match(rows, sections, [*part, "section"]).select(*log.columns, "section", "kind", piece.alias("piece"))


def coalesce_segments(sections: DataFrame, part: list[str], sections_per_chunk: int = 1_000_000) -> DataFrame:
    """Number the non-empty sections and give each the fewest markers that precede it.

    ``markers`` is ``C``, ``B``, ``C,B``, ``B,C`` or empty, by the kinds of this section
    and the one before; nothing follows the last section.
    """
    kept = sections.filter("n_rows > 0")
    chunk = F.floor(F.col("section") / sections_per_chunk)
    seen = with_running(
        kept,
        part,
        ["section"],
        {
            "__prev": Running("last", F.col("kind"), inclusive=False),
            "number": Running("sum", F.lit(1).cast("bigint")),
        },
        chunk,
    )
    prev, kind = F.col("__prev"), F.col("kind")
    markers = (
        F.when(prev.isNull(), F.when(kind == "outside", "C").otherwise(""))
        .when((prev == "inside") & (kind == "inside"), "C,B")
        .when(prev == "inside", "C")
        .when(kind == "inside", "B")
        .otherwise("B,C")
    )
    return seen.withColumn("markers", markers).drop("__prev")
