r"""Chat formatting by grammar round trip.

A turn is written as ``<turn ROLE>\nTEXT</turn>\n``.  The grammar:

    conversation := turn*
    turn         := "<turn " role ">\n" body "</turn>\n"
    role         := ( char except \ < > newline | "\\" | "\<" | "\>" | "\n" )*
    body         := ( char except \ < | "\\" | "\<" | lone "\" | "<" not starting a mark )*

Every text is first written as it is and parsed again.  Where the parser does
not give back the source (the text holds a mark, an escape, or ends in a
backslash), its backslashes and marks are escaped and the check is repeated;
with all of them escaped the grammar is unambiguous, so the second reading is
always identical.

Turns are rendered and checked row by row in parallel, so one conversation may
hold any share of all rows; the offsets come from a running sum.  Whoever reads
the output back streams the sorted segments and keeps one turn in memory.

Defined results: null text or role is empty; turns order by (turn, role, text),
null first, so ties and repeated rows each stay a turn; a null conv_id is a
conversation of its own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn ", "</turn>"
_TURN = re.compile(
    r"<turn (?P<role>(?:[^\\<>\n]|\\[\\<>n])*)>\n"
    r"(?P<body>(?:[^\\<]|\\[\\<]?|<(?!turn |/turn>))*+)"
    r"</turn>\n"
)
_ESCAPED = re.compile(r"\\([\\<>n])")


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("<", "\\<").replace(">", "\\>").replace("\n", "\\n")


def escape_text(text: str) -> str:
    return text.replace("\\", "\\\\").replace(OPEN, "\\" + OPEN).replace(CLOSE, "\\" + CLOSE)


def _role_of(raw: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], raw)


def _text_of(raw: str) -> str:
    return re.sub(r"\\([\\<])", r"\1", raw) if "\\" in raw else raw


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered conversation, or None if it doesn't follow the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        found = _TURN.match(rendered, at)
        if not found:
            return None
        turns.append((_role_of(found["role"]), _text_of(found["body"])))
        at = found.end()
    return turns


def render_turn(role: str, text: str) -> tuple[str, int]:
    """A rendered turn that parses back to (role, text), and how often it had to be escaped."""
    head = f"{OPEN}{escape_role(role)}>\n"
    for rounds, body in enumerate((text, escape_text(text))):
        rendered = f"{head}{body}{CLOSE}\n"
        if parse(rendered) == [(role, text)]:
            return rendered, rounds
    raise ValueError(f"a turn doesn't survive escaping: {text[:80]!r}")


def format_turns(
    conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """Rendered segments: their concatenation in order of seq is the conversation's text.

    Returns conv_id, seq (from 0), segment, starts (code points before it in
    the conversation's text), loss_start and loss_end (code points of the
    conversation's text under the loss mask; null for other roles), rounds.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, role, text = (batch.column(i) for i in range(4))
            made = [render_turn(r or "", t or "") for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True)]
            heads = [segment.index(">\n") + 2 for segment, _ in made]
            yield pa.RecordBatch.from_arrays(
                [
                    conv,
                    turn,
                    role,
                    text,
                    pa.array([s for s, _ in made], pa.string()),
                    pa.array([len(s) for s, _ in made], pa.int64()),
                    pa.array(heads, pa.int64()),
                    pa.array([n for _, n in made], pa.int32()),
                ],
                names=["conv_id", "turn", "role", "text", "segment", "chars", "head", "rounds"],
            )

    source = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    made = source.mapInArrow(
        render, "conv_id long, turn long, role string, text string, segment string, chars long, head long, rounds int"
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    ends = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0))
    trained = F.coalesce(F.col("role").isin(*loss_roles), F.lit(False))
    return made.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        "segment",
        (ends - F.col("chars")).alias("starts"),
        F.when(trained, ends - F.col("chars") + F.col("head")).alias("loss_start"),
        F.when(trained, ends - F.lit(len(CLOSE) + 1)).alias("loss_end"),
        "rounds",
    )


def read_back(segments: DataFrame) -> DataFrame:
    """Digest of each conversation, parsed from its rendered segments alone.

    Streams the segments of a partition sorted by (conv_id, seq); the state is
    two running digests, so no conversation is held in memory.
    """
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_escaped long"
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in schema.split(", ")]
        kinds = [pa.string() if part.endswith("string") else pa.int64() for part in schema.split(", ")]
        state: list | None = None

        def row() -> list:
            conv, n, turns, chars, loss, formatted, escaped = state
            return [conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, escaped]

        for batch in batches:
            done = []
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "segment", "starts", "loss_start", "loss_end", "rounds"))
            for conv, segment, starts, loss_start, loss_end, rounds in zip(*columns, strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(segment):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss_start is not None:
                    masked = _text_of(segment[loss_start - starts : loss_end - starts])
                    state[3] += len(masked)
                    state[4].update(masked.encode("utf-8", "surrogatepass"))
                state[5] += len(segment)
                state[6] += rounds > 0
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(row(), kinds, strict=True)], names=names)

    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(digest, schema)


def masked(segment: Column, starts: Column, loss_start: Column, loss_end: Column) -> Column:
    """The part of a segment under the loss mask, still escaped."""
    return F.substring(segment, loss_start - starts + 1, loss_end - loss_start)
