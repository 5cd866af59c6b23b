"""Event-sourced reconstruction and formatting of conversations.

An event log holds ``start``, ``delta`` (append), ``edit`` (replace) and
``regenerate`` (begin anew) events. Events are folded per message, so that a
conversation with very many events spreads over tasks; the finished messages are
then gathered per conversation, sorted by sequence and rendered. One formatted
text per conversation is the result, so a conversation's final text has to fit
in a row.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import arrow_schema, column

PIECE = 400  # characters of a streamed delta

# The control strings of the template. Inside roles and texts each
# "<", backslashes, "|" gets one more backslash, so no control string is left.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def event_log(conversations: DataFrame) -> DataFrame:
    """``(conv_id, message, turn, role, seq, kind, text)`` events of finished turns:
    each text streams in pieces; some messages are first drafted and regenerated,
    others are drafted and edited. A null role or text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("t"),
        F.monotonically_increasing_id().alias("message"))
    event = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("text"))
    steps = F.sequence(F.lit(0), F.floor((F.length("t") - 1) / PIECE).cast("int"))
    deltas = F.when(F.col("t") == "", F.array().cast("array<struct<kind:string,text:string>>")).otherwise(
        F.transform(steps, lambda k: event("delta", F.substr(F.col("t"), k * PIECE + 1, F.lit(PIECE)))))
    draft = event("delta", F.substring("t", 1, 20))
    route = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    events = F.concat(
        F.array(event("start", F.lit(""))),
        F.when(route == 0, F.concat(F.array(draft, event("regenerate", F.lit(""))), deltas))
        .when(route == 1, F.array(draft, event("edit", F.col("t"))))
        .otherwise(deltas))
    return rows.select("conv_id", "message", "turn", "role", F.posexplode(events).alias("seq", "e")).select(
        "conv_id", "message", "turn", "role", "seq", "e.kind", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, message, turn, role, text)``: what was appended
    since the last start, edit or regeneration, in sequence. A null text of an
    event is empty; events of equal sequence are taken in the order of their
    kind and text."""
    reset = F.col("kind").isin("start", "edit", "regenerate")
    e = events.select("conv_id", "message", "turn", "role", F.struct(
        "seq", "kind", F.coalesce("text", F.lit("")).alias("text"), reset.alias("reset")).alias("e"))
    grouped = e.groupBy("conv_id", "message", "turn", "role").agg(
        F.max(F.when(F.col("e.reset"), F.struct("e.seq", "e.kind", "e.text"))).alias("last"),
        F.collect_list("e").alias("es"))
    kept = F.filter(F.array_sort("es"), lambda x: F.col("last").isNull() | (
        F.struct(x.seq, x.kind, x.text) >= F.col("last")))
    return grouped.select("conv_id", "message", "turn", "role", F.array_join(
        F.transform(kept, lambda x: x.text), "").alias("text"))


def _formatted(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    out, at, loss = [], 0, []
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    out = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part[len(TURN):].partition(TEXT)
        out.append((unescape(role), unescape(text)))
    return out


def render(messages: DataFrame) -> DataFrame:
    """``(conv_id, formatted string, loss array<struct<start,stop>>)``: turns in the
    order of turn, role, text (a null turn first); loss spans, in code points,
    cover each assistant text. All rows with a null conv_id are one conversation."""
    grouped = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("turn", "role", "text", "message"))).alias("turns"))
    # array_sort puts a null field first, as the order above asks
    rows = grouped.select("conv_id", F.transform(
        "turns", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns"))
    schema = "conv_id bigint, formatted string, loss array<struct<start:bigint,stop:bigint>>"
    arrow = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(
        pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def run(batches):
        for batch in batches:
            out = [_formatted([(x["role"], x["text"]) for x in turns]) for turns in column(batch, "turns")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([o[0] for o in out], pa.string()),
                 pa.array([o[1] for o in out], arrow.field("loss").type)], schema=arrow)

    return rows.mapInArrow(run, schema)


def digests(formatted: DataFrame) -> DataFrame:
    """Read formatted texts back: turns, the text under the loss mask, and sizes."""
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
              "loss_sha256 string, formatted_chars bigint")

    def run(batches):
        for batch in batches:
            out = []
            for text, loss in zip(column(batch, "formatted"), column(batch, "loss")):
                turns = parse(text)
                masked = "".join(unescape(text[x["start"]:x["stop"]]) for x in loss)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogateescape")).hexdigest()
                out.append((len(turns), sha(told), len(masked), sha(masked), len(text)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([o[k] for o in out], pa.string() if k in (1, 3) else pa.int64())
                                    for k in range(5))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, schema)
