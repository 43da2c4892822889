"""Chat formatting whose output a deterministic parser turns back into the same turns.

Each turn is rendered as ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. The parser knows two
control strings, and undoes escapes in what lies between. After rendering, the segment
is parsed again and compared with the source; a turn that does not come back gets its
conflicting content escaped, and this repeats until both are identical. A conversation
is a repetition of such segments, so it parses to the turns of its segments. The escape puts
one backslash into ``<|``, ``<\\|``, ``<\\\\|`` and so on, which is reversible for any text
and leaves no control string in it; line ends within a role are escaped likewise.

Edge cases: a null text or role is empty; a null conversation or turn number is kept as
a value of its own (null sorts first); turns with equal numbers are ordered by role and
text; repeated rows are turns of their own; other columns are ignored; an empty table
gives no rows. Turns go by conversation in one exchange, are formatted one by one in order
and read back as a stream, so even a conversation with a large share of all rows takes
bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_batches

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
TURN_END = END + "\n"
CONTROL = re.compile(re.escape(START) + "|" + re.escape(END))


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def parse(segment: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of the raw text) of each turn, or None where the grammar does not hold.

    segment := (START role "\\n" text END "\\n")*, with no control string in role or text.
    """
    turns, at = [], 0
    while at < len(segment):
        if not segment.startswith(START, at):
            return None
        line = segment.find("\n", at)
        if line < 0 or CONTROL.search(segment, at + len(START), line):
            return None
        stop = CONTROL.search(segment, line + 1)
        if stop is None or not segment.startswith(TURN_END, stop.start()):
            return None
        turns.append((unescape_role(segment[at + len(START) : line]), unescape(segment[line + 1 : stop.start()]), line + 1, stop.start()))
        at = stop.start() + len(TURN_END)
    return turns


def render(role: str, text: str) -> str:
    """One turn that parses back to itself; content is escaped only where it would not."""
    for role_as, text_as in ((role, text), (role, escape(text)), (escape_role(role), escape(text))):
        segment = f"{START}{role_as}\n{text_as}{TURN_END}"
        turns = parse(segment)
        if turns is not None and [t[:2] for t in turns] == [(role, text)]:
            return segment
    raise ValueError("a turn does not survive the round trip")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, turn, place, segment), each conversation in order within one partition.

    The segments of a conversation, by ``place`` from 0, are its formatted text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n = (), 0
        for b in text_batches(batches, 3):
            places = []
            for conv_id in b.column(0).to_pylist():
                now, n = ((conv_id,), 0) if now != (conv_id,) else (now, n + 1)
                places.append(n)
            made = [render(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.int64()), pa.array(made, pa.string())], names=["conv_id", "turn", "place", "segment"])

    empty = F.lit("")
    chosen = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    ordered = chosen.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, turn long, place long, segment string")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss, self.chars = conv_id, 0, 0, 0
        self.turns_sha, self.loss_sha = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str) -> None:
        turns = parse(segment)
        if turns is None:
            raise ValueError(f"conversation {self.conv_id}: formatted text does not parse")
        for role, text, start, end in turns:
            self.n += 1
            self.turns_sha.update(f"{role}\n{text}\n".encode())
            if role == "assistant":  # the loss mask is the span [start, end) of the raw text
                own = unescape(segment[start:end])
                self.loss += len(own)
                self.loss_sha.update(own.encode())
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns_sha.hexdigest(), self.loss, self.loss_sha.hexdigest(), self.chars


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Parse formatted segments (conv_id, turn, place, segment) into one digest row per conversation.

    ``in_order``: the rows lie as ``format_turns`` leaves them and need no further exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now, done = None, []
        for b in text_batches(batches, 3):
            for conv_id, segment in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now is None or now.conv_id != conv_id:
                    done += [now.row()] if now else []
                    now = _Conversation(conv_id)
                now.add(segment)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(now.row(), schema, strict=True)], schema=schema)

    rows = formatted if in_order else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return rows.select("conv_id", "turn", "place", "segment").mapInArrow(run, DIGEST)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = f"{END}{START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(turns.unionByName(extra)), in_order=True)
