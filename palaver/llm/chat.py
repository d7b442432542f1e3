"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<|im_start|>role LF text<|im_end|>LF`` per turn. Every
rendered turn is parsed again by a deterministic parser and compared with its source; a
turn that does not come back identical has its control strings escaped and is compared
again. Reading back happens on the rendered text alone.

Rows are dealt by conversation, sorted on disk where needed and streamed: state is one
turn and two running digests, so a conversation of any length takes bounded memory. A
digest of a whole conversation is sequential by definition, hence one task per
conversation; rendering needs no more than its turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palaver.llm.common import arrow_schema, ship

ship(__name__)

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"

# A control string, or one already escaped any number of times. Escaping adds one backslash
# after the bracket, unescaping removes one, so the pair is reversible on every text.
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")

RENDERED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn_no", T.LongType()),
        T.StructField("rendered", T.StringType()),
        T.StructField("escaped", T.BooleanType()),
    ]
)
DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
)


class GrammarError(ValueError):
    """Text that is not a sequence of rendered turns."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n])", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and where the escaped text starts and ends in it."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise GrammarError(f"no turn starts at {at}")
        line = formatted.find("\n", at)
        end = formatted.find(END, line + 1)
        if line < 0 or end < 0 or formatted[end + len(END) : end + len(END) + 1] != "\n":
            raise GrammarError(f"the turn at {at} does not end")
        role, text = formatted[at + len(START) : line], formatted[line + 1 : end]
        if START in role or END in role or START in text:
            raise GrammarError(f"a control string inside the turn at {at}")
        yield unescape_role(role), unescape(text), line + 1, end
        at = end + len(END) + 1


def _reads_back(rendered: str, role: str, text: str) -> bool:
    try:
        return [(r, t) for r, t, _, _ in parse(rendered)] == [(role, text)]
    except GrammarError:
        return False


def render_turn(role: str, text: str) -> tuple[str, bool]:
    """The rendered turn and whether its text had to be escaped."""
    plain = f"{START}{escape_role(role)}\n{text}{END}\n"
    if _reads_back(plain, role, text):
        return plain, False
    escaped = f"{START}{escape_role(role)}\n{escape(text)}{END}\n"
    if not _reads_back(escaped, role, text):
        raise GrammarError(f"turn does not read back: {escaped[:200]!r}")
    return escaped, True


def render(conversations: DataFrame) -> DataFrame:
    """Rendered turns ``conv_id, turn_no, rendered, escaped``, in order inside each partition.

    Turns are ordered by ``turn`` (null first), ties by role and text; repeated rows stay
    repeated turns. A null role or text is empty; rows with a null ``conv_id`` are one
    conversation. Other columns are ignored; an empty table gives no rows.
    """
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = arrow_schema(RENDERED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number = object(), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(
                batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()
            ):
                number = number + 1 if conv == current else 0
                current = conv
                out.append((conv, number, *render_turn(role, text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return ordered.mapInArrow(run, RENDERED)


def digests(rendered: DataFrame) -> DataFrame:
    """One row per conversation, read back from rendered turns in the order :func:`render` leaves them."""
    schema = arrow_schema(DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for batch in batches:
            out = []
            for conv, text in zip(batch.column("conv_id").to_pylist(), batch.column("rendered").to_pylist()):
                if conv != current:
                    if state:
                        out.append(_closed(current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content, _, _ in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode())
                    if role == LEARNED_ROLE:
                        state[2] += len(content)
                        state[3].update(content.encode())
                state[4] += len(text)
            if out:
                yield _batch(out, schema)
        if state:
            yield _batch([_closed(current, state)], schema)

    return rendered.mapInArrow(run, DIGESTS)


def _closed(conv, state) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
