"""Conversations rebuilt from event logs and rendered for training."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events in the order in which they take effect when they share a sequence number.
KINDS = ("message", "start", "regenerate", "delta", "edit", "delete")
START, END = "<|im_start|>", "<|im_end|>"
#: Characters of a message that one delta carries where turns are turned into events.
DELTA_CHARS = 256
COLUMNS = ("seq", "kind", "message_id", "role", "text")


class Conversation:
    """The messages of one conversation as its events are applied one after another."""

    def __init__(self) -> None:
        self.messages: dict[str | None, list] = {}
        self.last: tuple | None = None

    def apply(self, event: tuple) -> None:
        """One event (seq, kind, message_id, role, text); one with a number that equals the one before it has been applied already."""
        if event == self.last and event[0] is not None:
            return
        self.last = event
        _, kind, name, role, text = event
        known = self.messages.get(name)
        if kind == "delete":
            self.messages.pop(name, None)
        elif kind in ("message", "start"):
            if known is None:
                self.messages[name] = [role, [text or ""]]
            else:
                known[:] = [role if role is not None else known[0], [text or ""]]
        elif kind == "delta":
            if known is None:
                self.messages[name] = [role, [text or ""]]
            else:
                known[1].append(text or "")
        elif kind == "edit":
            if known is not None:
                known[:] = [role if role is not None else known[0], [text or ""]]
        elif kind == "regenerate" and known is not None:
            names = list(self.messages)
            for later in names[names.index(name) + 1 :]:
                del self.messages[later]
            known[1] = [text or ""]

    def final(self) -> list[tuple[str | None, str]]:
        return [(role, "".join(parts)) for role, parts in self.messages.values()]


def escape(text: str) -> str:
    """Text in which no marker of the template can be read."""
    return text.replace("<|", "< |")


def render(messages: list[tuple[str | None, str]]) -> str:
    return "".join(f"{START}{escape(role or 'unknown')}\n{escape(text)}{END}\n" for role, text in messages)


def reconstruct(events: DataFrame, conv_col: str = "conv_id", seq_col: str = "seq", kind_col: str = "kind", message_col: str = "message_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, n_messages, rendered.

    The log is partitioned by conversation and sorted by sequence, and each task folds its conversations as they
    stream by, with only one conversation's messages in memory. Events: `message` sets a whole message, `start` opens a streamed one, `delta`
    appends to it, `edit` replaces its text, `regenerate` empties it and drops every message after it, `delete` removes it. Messages
    stand in the order in which they first appeared. Rendering gives each as <|im_start|>role, a new line, its text and <|im_end|>, a new
    line; "<|" inside a message is written "< |".

    Null text counts as empty, a null role is rendered `unknown`, a null message id is an id like others, null sequence
    numbers come first, and null conversations form one of their own. Events of one sequence number apply in the order of KINDS, then by message id, text
    and role. An event delivered twice applies once; events without a number can't be told from repeats and each apply. Messages and
    conversations of any length are folded whole, a conversation in one task. A delta for an unknown message opens it; edits, regenerations
    and deletions of unknown messages, and kinds that are null or unknown, change nothing. A conversation left without messages is a row with
    0 and an empty text. Other columns are not read. No rows give no rows.
    """
    kind = events.schema[conv_col].dataType.simpleString()
    named = {"conv_id": conv_col, "seq": seq_col, "kind": kind_col, "message_id": message_col, "role": role_col, "text": text_col}
    picked = events.select(*(F.col(f"`{c}`").cast("string").alias(n) if n not in ("conv_id", "seq") else F.col(f"`{c}`").alias(n) for n, c in named.items()))
    order = F.coalesce(F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")), F.lit(0)).alias("at")
    sent = picked.withColumn("at", order).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "at", "message_id", "text", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        name: object = None
        done: list[tuple] = []
        source = None

        def flush() -> pa.RecordBatch:
            names, counts, texts = zip(*done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, source), pa.array(counts, pa.int32()), pa.array(texts, pa.string())], names=["conv_id", "n_messages", "rendered"])

        for batch in batches:
            source = batch.column("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", *COLUMNS)]
            for conv, *event in zip(*columns):
                if now is None or conv != name:
                    if now is not None:
                        final = now.final()
                        done.append((name, len(final), render(final)))
                    now, name = Conversation(), conv
                now.apply(tuple(event))
            if len(done) >= 1_000:
                yield flush()
        if now is not None:
            final = now.final()
            done.append((name, len(final), render(final)))
        if done:
            yield flush()

    return sent.select("conv_id", *COLUMNS).mapInArrow(run, f"conv_id {kind}, n_messages int, rendered string")


def turns_to_events(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", delta_chars: int = DELTA_CHARS, revised: bool = False) -> DataFrame:
    """The log that a table of turns stands for: assistant turns stream as a start and deltas, others are whole messages.

    With revised, the log is one of a lively conversation that ends in the same messages: by the first digit of md5(role, text), a streamed turn
    is begun, answered, and then regenerated; another message is sent with other words and edited; another one is preceded by a message
    that is deleted. Some events are delivered twice.

    seq is a struct of the turn, md5 of role and text, and the number of the event in its turn. Rows that agree in conversation, turn, role
    and text are one message, delivered more than once; other messages of one turn, also of the null one, follow each other in the order of md5.
    Null texts are empty, null roles are kept null, null turns come first. No rows give no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), text.alias("text"))
    key = F.md5(F.concat(F.coalesce(F.concat(F.length("role"), F.lit("="), F.col("role")), F.lit("-")), F.lit("|"), F.col("text")))
    base = base.withColumn("key", key).withColumn("name", F.concat_ws(".", F.coalesce(F.col("turn").cast("string"), F.lit("-")), "key"))

    def event(kind: str, text: Column | str, suffix: str = "") -> Column:
        name = F.concat(F.col("name"), F.lit(suffix)) if suffix else F.col("name")
        return F.struct(F.lit(kind).alias("kind"), name.alias("message_id"), (F.lit(text) if isinstance(text, str) else text).alias("text"))

    deltas = F.transform(F.expr(f"if(text = '', array(), sequence(1, cast((length(text) + {delta_chars - 1}) div {delta_chars} AS int)))"), lambda i: event("delta", F.col("text").substr((i - 1) * delta_chars + 1, F.lit(delta_chars))))
    streamed = F.concat(F.array(event("start", "")), deltas)
    whole = F.array(event("message", F.col("text")))
    if revised:
        digit = F.substring("key", 1, 1)
        tried = F.array(event("start", ""), event("delta", F.reverse("text")), event("message", "to be dropped", "/later"), event("regenerate", ""))
        streamed = F.when(digit < "8", F.concat(tried, deltas)).otherwise(streamed)
        edited = F.array(event("message", F.reverse("text")), event("edit", F.col("text")))
        gone = F.array(event("message", "said by mistake", "/gone"), event("delete", "", "/gone"), event("message", F.col("text")))
        whole = F.when(digit < "6", edited).when(digit < "9", gone).otherwise(whole)
    told = F.when(F.coalesce(F.col("role") == "assistant", F.lit(False)), streamed).otherwise(whole)
    events = base.select("conv_id", "turn", "key", "role", F.posexplode(told).alias("n", "e"))
    if revised:  # one event in four comes twice
        again = F.when(F.substring("key", 2, 1) < "4", 2).otherwise(1)
        events = events.withColumn("copy", F.explode(F.sequence(F.lit(1), again)))
    return events.select("conv_id", F.struct("turn", "key", "n").alias("seq"), F.col("e.kind").alias("kind"), F.col("e.message_id").alias("message_id"), "role", F.col("e.text").alias("text"))
