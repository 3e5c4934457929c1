"""Secrets in texts, with their places in code points.

Three kinds have a fixed form: assignments to a secret's name, access keys and runs of hex
digits. A fourth, ``entropy``, is found by how evenly characters are used: a candidate is a
long run of key characters; a window of fixed width slides over it, the counts of its
characters are updated by the one that enters and the one that leaves, and with them the
window's Shannon entropy. A candidate whose highest window reaches the threshold of its
character class is a secret unless the allow-list names its form.

Everything is a column expression on one row: no shuffle, and texts are never cut. NULL and
empty texts have no spans. The places of all matches of a pattern follow from the lengths of
the matches and of what lies between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import let, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a shorter run can't reach the least length from within, so the length is part of these two
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE_KINDS = ("assign", "access", "hex")
SPANS = "array<struct<start:int,kind:int,end:int>>"
_BLOCK = 256


@dataclass(frozen=True)
class Entropy:
    """The search for evenly used characters. ``bits`` is by character class: hex, mixed."""

    candidate: str = r"[A-Za-z0-9+/_-]{20,}"
    width: int = 20
    hex_bits: float = 2.8
    mixed_bits: float = 3.8
    # forms that are even but not secret: numbers, words, dashed words or paths, UUIDs, samples
    allow: tuple[str, ...] = (
        r"^[0-9_/+-]+$",
        r"^[A-Za-z]?[a-z]+$",
        r"^[A-Z]+$",
        # at least one dash, no digit, and upper case only at the start of a part; no repeated group, which would recurse
        r"^(?!.*[0-9])(?!.*[A-Za-z][A-Z]).*[-_/+]",
        r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
        r"(?i)example|sample|placeholder|dummy",
    )


def _sums_before(lengths: Column) -> Column:
    """Exclusive running sums of an array, in blocks, so that no long array is copied per element."""

    def within(block: Column, start: Column) -> Column:
        begin = F.struct(start.alias("sum"), F.slice(block, 1, 0).alias("out"))
        add = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out"))
        return F.aggregate(block, begin, add, lambda a: a["out"])

    def all_blocks(xs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / _BLOCK).cast("int") - 1, F.lit(0)))
        blocks = F.transform(numbers, lambda b: F.slice(xs, b * _BLOCK + 1, _BLOCK))
        total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x)
        return let(
            blocks,
            lambda bs: let(
                within(F.transform(bs, total), F.lit(0)),
                lambda starts: F.flatten(F.transform(bs, lambda block, i: within(block, F.get(starts, i)))),
            ),
        )

    return let(lengths, all_blocks)


def _pieces(text: Column, pattern: str, keep) -> Column:
    """``gaps`` between the matches of ``pattern``, one more than ``hits``: text and whether it is kept."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(m.alias("text"), keep(m).alias("kept")))
    return F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits"))


def _spans(pieces: Column, kind: int) -> Column:
    def places(p: Column) -> Column:
        steps = F.transform(p["hits"], lambda h, i: F.length(F.get(p["gaps"], i)) + F.length(h["text"]))
        return let(
            _sums_before(steps),
            lambda before: F.filter(
                F.transform(
                    p["hits"],
                    lambda h, i: let(
                        F.get(before, i) + F.length(F.get(p["gaps"], i)),
                        lambda start: F.when(
                            h["kept"],
                            F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(h["text"])).alias("end")),
                        ),
                    ),
                ),
                lambda s: s.isNotNull(),
            ),
        )

    none = F.array().cast(SPANS)
    return let(pieces, lambda p: F.when(F.size(p["hits"]) > 0, places(p)).otherwise(none))


def _joined(pieces: Column, mark: str) -> Column:
    """The text again, with ``mark`` in place of what is kept."""

    def build(p: Column) -> Column:
        parts = F.transform(
            p["gaps"],
            lambda g, i: F.concat(g, F.coalesce(F.when(F.get(p["hits"], i)["kept"], F.lit(mark)).otherwise(F.get(p["hits"], i)["text"]), F.lit(""))),
        )
        return F.when(F.size(p["hits"]) > 0, F.array_join(parts, "")).otherwise(F.get(p["gaps"], F.lit(0)))

    return let(pieces, build)


def highest_entropy(text: Column, width: int) -> Column:
    """Bits of the most even window of ``width`` ASCII characters; of the whole text if shorter.

    With counts c, the entropy of n characters is log2(n) - sum(c * log2(c)) / n. Only that sum
    is carried along; a character that enters or leaves changes one count and one term of it.
    """

    def c_log_c(c: Column) -> Column:
        return F.when(c > 1, c * F.log2(c)).otherwise(0.0)

    def moved(state: Column, code: Column, by: int) -> Column:
        count = F.get(state["counts"], code)
        counts = F.concat(F.slice(state["counts"], F.lit(1), code), F.array(count + by), F.slice(state["counts"], code + 2, 128))
        return F.struct(counts.alias("counts"), (state["sum"] + c_log_c(count + by) - c_log_c(count)).alias("sum"), state["least"].alias("least"))

    def over(chars: Column) -> Column:
        n = F.least(F.size(chars), F.lit(width))
        begin = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"))

        def step(state: Column, i: Column) -> Column:
            entered = moved(state, F.ascii(F.get(chars, i)), 1)
            left = F.when(i >= width, let(entered, lambda s: moved(s, F.ascii(F.get(chars, i - width)), -1))).otherwise(entered)
            full = lambda s: F.when(i >= n - 1, F.least(s["least"], s["sum"])).otherwise(s["least"])
            return let(left, lambda s: F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), full(s).alias("least")))

        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), begin, step, lambda s: F.log2(n) - s["least"] / n)

    return F.when(F.length(text) > 0, let(F.split(text, ""), over)).otherwise(0.0)


def _is_secret(candidate: Column, how: Entropy) -> Column:
    allowed = F.lit(False)
    for pattern in how.allow:
        allowed = allowed | candidate.rlike(pattern)
    bits = F.when(candidate.rlike("^[0-9a-fA-F]+$"), how.hex_bits).otherwise(how.mixed_bits)
    return F.when(allowed, False).otherwise(highest_entropy(candidate, how.width) >= bits)


def _searches(how: Entropy) -> list[tuple[str, object]]:
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    return [
        (ASSIGN, value),
        (ACCESS, lambda m: F.lit(True)),
        (HEX, lambda m: F.lit(True)),
        (how.candidate, lambda m: _is_secret(m, how)),
    ]


def secret_spans(text: Column, how: Entropy = Entropy()) -> Column:
    """All spans ``(start, kind, end)`` by start, then kind; kind 0 to 2 as in BASE_KINDS, 3 is entropy."""
    text = F.coalesce(text, F.lit(""))
    return let(
        text,
        lambda t: F.array_sort(F.concat(*[_spans(_pieces(t, p, keep), k) for k, (p, keep) in enumerate(_searches(how))])),
    )


def redact(text: Column, mark: str = "[SECRET]", how: Entropy = Entropy()) -> Column:
    """``text`` with every secret replaced, kind after kind; NULL stays NULL."""

    def without(text: Column, pattern: str, keep) -> Column:
        return let(text, lambda t: F.when(F.rlike(t, F.lit(pattern)), _joined(_pieces(t, pattern, keep), mark)).otherwise(t))

    for pattern, keep in _searches(how):
        text = without(text, pattern, keep)
    return text


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*BASE_KINDS, "entropy")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", how: Entropy = Entropy()) -> DataFrame:
    """Per row: ``doc_id``, counts of the fixed kinds, a digest of their spans, and all spans as text."""
    found = docs.select(F.col(doc_id), secret_spans(F.col(text), how).alias("found"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE_KINDS))
    return found.select(
        doc_id,
        *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
    )


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents"))
