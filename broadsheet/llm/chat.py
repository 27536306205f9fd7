"""Training examples from conversations: one for every assistant turn, with all turns before it as context.

A turn is written as

    <turn ROLE>
    TEXT
    </turn>

A backslash stands before every backslash, `<turn` and `</turn` inside texts and roles (in roles also before `>`),
so what marks a turn never occurs inside one and every character comes back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, shuffle_width, slices

#: Code points after which a conversation's text is closed as a block that later examples refer to.
BLOCK_POINTS = 1 << 20
#: Code points that a task holds before it sends its rows on.
SEND_POINTS = 1 << 22

_ESCAPED = re.compile(r"\\(.)", re.S)
_CLOSE = "\n</turn>\n"


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn", "\\<turn").replace("</turn", "\\</turn")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def opening(role: str) -> str:
    return f"<turn {escaped(role).replace('>', '\\>')}>\n"


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        end = text.index(_CLOSE, head.end())
        out.append((unescaped(head[1]), unescaped(text[head.end() : end])))
        at = end + len(_CLOSE)
    return out


_HEAD = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.S)

COLUMNS = "example long, kind string, block long, text string, loss_start long, loss_end long, new_from long"


def chat_examples(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant", block_points: int = BLOCK_POINTS) -> DataFrame:
    """conv_id, example, kind, block, text, loss_start, loss_end, new_from.

    kind `reply`: an example for each turn of the trained role.  text holds all turns before it and the turn; text from
    loss_start to loss_end (code points, from 0, end excluded) is the escaped reply, the only part to be trained on.
    kind `rest`: turns behind the last reply, after the whole context, with nothing to train on (loss_start is null).
    kind `block`: a conversation of more than block_points code points is closed from time to time; the context of a
    later row starts with the texts of all of its conversation's blocks whose number is smaller than the row's `block`.
    So no context is shortened, and work grows with the turns, not with their square.
    A block may stand where a rest would, at the end of a task's rows.
    text from new_from on holds the turns that no earlier row has.  example orders a conversation's rows.

    Turns are ordered by turn, then by role and a hash of the text; null roles and texts count as empty, null turns come
    first, rows without an id are one conversation.  Repeated rows are turns of their own, in the table's order.  Texts of
    any length.  An empty table gives an empty result; other columns are ignored.  Rows are dealt by ranges of that order,
    so a conversation that holds a third of all rows is spread over many tasks, each of which ends with a block; at most
    one block is held at a time.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
    rows = df.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    order = ["conv_id", "turn", "role", "tie", "place"]
    placed = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order)
    kind = dict(rows.dtypes)["conv_id"]
    numbered = dealt.select("conv_id", "role", "text", F.spark_partition_id().alias("task"))

    def format_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        names = ["conv_id", *(x.split()[0] for x in COLUMNS.split(", "))]

        def send(schema: pa.Schema) -> pa.RecordBatch:
            columns = [pa.array([x[k] for x in made], f.type) for k, f in enumerate(schema)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        schema, conv, held, points, known, number, base, size = None, None, [], 0, 0, 0, 0, 0

        def add(what: str, loss: tuple[int | None, int | None] = (None, None)) -> None:
            nonlocal known, number, size
            made.append((conv, number, what, block, "".join(held), *loss, known))
            number += 1
            known = points
            size += points

        for batch in slices(batches):
            if schema is None:
                base = batch.column("task")[0].as_py() << 40
                number, block = base, base
                schema = pa.schema([batch.schema.field("conv_id"), ("example", pa.int64()), ("kind", pa.string()), ("block", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("new_from", pa.int64())])
                assert schema.names == names
            for at, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if at != conv and held:
                    if known < points:
                        add("rest")
                    held, points, known = [], 0, 0
                conv = at
                head, body = opening(role), escaped(text)
                held.append(f"{head}{body}{_CLOSE}")
                start = points + len(head)
                points += len(held[-1])
                if role == trained:
                    add("reply", (start, start + len(body)))
                if points >= block_points:
                    add("block")
                    block += 1
                    held, points, known = [], 0, 0
                if size >= SEND_POINTS:
                    yield send(schema)
                    size = 0
        if held:
            add("block")  # the next task may go on with this conversation
        if made:
            yield send(schema)

    return arrow_map(numbered, format_turns, f"conv_id {kind}, {COLUMNS}")


def chat_digests(examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from chat_examples' rows.

    formatted_chars adds up the conversation's examples, each with its whole context, and its rest if it has one.
    Each row's new turns and its reply travel, in order, to the task of its conversation, which reads them one row at a
    time.  A digest of a whole conversation can only be made in order, so this last step has one task for it.
    """
    new = F.substring("text", F.col("new_from").cast("int") + 1, F.lit(1 << 30))
    reply = F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    rows = examples.select("conv_id", "example", new.alias("new"), reply.alias("reply"))
    dealt = rows.repartition(shuffle_width(examples.sparkSession), "conv_id").sortWithinPartitions("conv_id", "example")
    kind = dict(rows.dtypes)["conv_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        conv, seen, schema = None, False, None

        def fresh() -> dict:
            return {"turns": 0, "all": hashlib.sha256(), "loss": 0, "replies": hashlib.sha256(), "upto": 0, "rest": False, "chars": 0}

        def close() -> None:
            chars = own["chars"] + own["upto"] * own["rest"]
            made.append((conv, own["turns"], own["all"].hexdigest(), own["loss"], own["replies"].hexdigest(), chars))

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], f.type) for k, f in enumerate(schema)], schema=schema)
            made.clear()
            return out

        own = fresh()
        for batch in slices(batches):
            schema = schema or pa.schema([batch.schema.field("conv_id"), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            for at, new_text, reply_text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "new", "reply")), strict=True):
                if seen and at != conv:
                    close()
                    own = fresh()
                conv, seen = at, True
                for role, text in read_turns(new_text):
                    own["turns"] += 1
                    own["all"].update(f"{role}\n{text}\n".encode())
                own["upto"] += len(new_text)
                own["rest"] |= bool(new_text)
                if reply_text is not None:
                    own["chars"], own["rest"] = own["chars"] + own["upto"], False
                    plain = unescaped(reply_text)
                    own["loss"] += len(plain)
                    own["replies"].update(plain.encode())
            if made:
                yield send()
        if seen:
            close()
            yield send()

    return arrow_map(dealt, digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
