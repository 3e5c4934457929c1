"""Chat formatting of conversations with typed content parts, and reading it back.

A turn has a role and an array of parts: text, image, audio or document. A visitor walks the
parts in order. Text is escaped; any other part becomes a numbered placeholder, its reference
is recorded with its place, and so is the number of tokens the placeholder expands to. The
template is

    <turn>ROLE\\nCONTENT</turn>\\n

Every control string starts with ``<``. In texts and roles ``\\`` becomes ``\\\\`` and ``<``
becomes ``\\<``, and a line feed in a role becomes ``\\n``, so no text can look like a control
string and each can be restored exactly. The loss mask covers the content of assistant turns.

Turns are formatted row by row and a conversation is their concatenation by turn, then role,
then content. NULL texts, roles and parts are empty, and a NULL turn comes first; an unknown
kind of part is an error. Reading back streams the rows of a partition, ordered by
conversation, and holds one turn and two running digests at a time, so a conversation of any
length fits.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.common import table

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<number:int,kind:string,ref:string,at:long,tokens:long>"
TURN = (
    f"conv_id long, turn long, formatted string, loss_start long, loss_length long, attachments array<{ATTACHMENT}>"
)
PATCH, SOUND_RATE, PAGE_TOKENS = 14, 25, 512
LOSS_ROLE = "assistant"
_TURN = re.compile(r"<turn>((?:\\.|[^\\\n])*)\n((?:\\.|[^\\<]|<(?!/turn>))*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str | None) -> str:
    return (text or "").replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def escape_role(role: str | None) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


class PartVisitor:
    """Flattens the parts of one turn. ``length`` counts the code points written so far."""

    def __init__(self, length: int = 0):
        self.out: list[str] = []
        self.attachments: list[dict] = []
        self.length = length

    def visit(self, part: dict | None) -> None:
        if part is not None:
            kind = part["kind"] or "text"
            if not hasattr(self, f"visit_{kind}"):
                raise ValueError(f"unknown kind of content part: {kind}")
            getattr(self, f"visit_{kind}")(part)

    def write(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def attach(self, part: dict, tokens: int) -> None:
        number = len(self.attachments)
        self.attachments.append(
            {"number": number, "kind": part["kind"], "ref": part["ref"], "at": self.length, "tokens": tokens}
        )
        self.write(f"<{part['kind']}:{number}>")

    def visit_text(self, part: dict) -> None:
        self.write(escape(part["text"]))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part[side] or 0) / PATCH) for side in ("width", "height"))
        self.attach(part, max(1, across * down))

    def visit_audio(self, part: dict) -> None:
        self.attach(part, max(1, math.ceil((part["seconds"] or 0) * SOUND_RATE)))

    def visit_document(self, part: dict) -> None:
        self.attach(part, max(1, part["pages"] or 0) * PAGE_TOKENS)


def text_part(text: Column) -> Column:
    """Parts of a turn that is only text."""
    names = ["ref string", "width int", "height int", "seconds double", "pages int"]
    rest = [F.lit(None).cast(n.split()[1]).alias(n.split()[0]) for n in names]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *rest))


def format_turns(turns: DataFrame) -> DataFrame:
    """One formatted row per row of ``conv_id, turn, role, parts``; places are within the row."""

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, lengths, attached = [], [], [], []
            for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                head = f"<turn>{escape_role(role)}\n"
                visitor = PartVisitor(len(head))
                for part in parts or ():
                    visitor.visit(part)
                texts.append(f"{head}{''.join(visitor.out)}</turn>\n")
                starts.append(len(head))
                lengths.append(visitor.length - len(head) if role == LOSS_ROLE else 0)
                attached.append(visitor.attachments)
            of = pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
            columns = [pa.array(texts, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(attached, pa.list_(of))]
            names = ["conv_id", "turn", "formatted", "loss_start", "loss_length", "attachments"]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names)

    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts").cast(f"array<{PART}>")
    )
    return rows.mapInArrow(formatted, TURN)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and escaped content of one formatted turn."""
    found = _TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not one formatted turn")
    return unescape_role(found[1]), found[2]


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Per conversation, read from the formatted rows: number of turns, digests, lengths."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
             ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        )
        open_one, began = None, False

        def close() -> dict:
            return {
                "conv_id": open_one, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars,
                "loss_sha256": loss.hexdigest(), "formatted_chars": chars,
            }

        for batch in batches:
            done = []
            for conv, text, at, length in zip(*[c.to_pylist() for c in batch.columns]):
                if not began or conv != open_one:
                    if began:
                        done.append(close())
                    open_one, began, n, loss_chars, chars = conv, True, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                role, content = read_turn(text)
                turns.update(f"{role}\n{unescape(content)}\n".encode("utf-8", "surrogatepass"))
                masked = unescape(text[at : at + length])
                loss.update(masked.encode("utf-8", "surrogatepass"))
                n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + len(text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if began:
            yield pa.RecordBatch.from_pylist([close()], schema=schema)

    rows = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_length")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return ordered.drop("turn").mapInArrow(
        digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


MARKS = r"\### Assistant: </turn> ok"

SQL = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  sum(length(role) + length(replace(replace(text, '\', '\\'), '<', '\<')) + 15)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame(
        [(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)], "conv_id long, turn long, role string, text string"
    )
    turns = rows.union(marked).withColumn("parts", text_part(F.col("text")))
    return digest_conversations(format_turns(turns))
