"""Chat formatting from an event log: partition by conversation, sort by sequence, fold, render, read back.

Events are rows (conv_id, seq, msg, op, role, text): ``start`` opens message ``msg`` with a role and its first text,
``delta`` appends text, ``edit`` replaces the text, ``regenerate`` empties it (deltas that follow build it anew),
``delete`` drops the message. Messages keep the order in which they were opened.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import count, groupby, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.common import bounded_batches

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
#: A message is BOS OPEN role CLOSE newline text EOS newline.
HEAD, MIDDLE, TAIL = BOS + OPEN, CLOSE + "\n", EOS + "\n"
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"([<\[])(/?(?:s>|INST\]))")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(HEAD) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(TAIL), re.S)

FORMATTED = "conv_id long, part int, formatted string, loss array<struct<start:long,stop:long>>"
#: Messages rendered into one row of output; a longer conversation continues in the next part.
PART_TURNS = 256


def escape(text: str) -> str:
    """A text without control strings: backslashes are doubled, then one splits every control string."""
    return _CONTROL.sub(r"\1\\\2", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold(texts: list[str], op: str, text: str) -> list[str]:
    """Pieces of one message's text after one more event; unknown operations are errors."""
    if op in ("start", "edit"):
        return [text]
    if op == "regenerate":
        return []
    if op == "delta":
        texts.append(text)
        return texts
    raise ValueError(f"unknown operation {op!r}")


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The formatted text and the spans (code points) of it that are under the loss mask."""
    out, loss, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role) + MIDDLE, escape(text)
        if role == LOSS_ROLE:
            loss.append({"start": at + len(head), "stop": at + len(head) + len(body)})
        out.append(head + body + TAIL)
        at += len(out[-1])
    return "".join(out), loss


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted text; the inverse of ``render``."""
    turns, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def turn_events(conversations: DataFrame) -> DataFrame:
    """An event log that leads to the stored turns.

    A user's message opens with a draft, its text backwards, which an edit replaces by the first half; an assistant's opens with the first half, streams a wrong
    rest, is regenerated and streamed anew; others open with the first half. The rest of a text comes as a delta. After every first turn
    of a conversation a message is opened and deleted. Turns are ordered by turn (null first), then role, then text, so ties have a
    defined order and repeated rows are repeated turns. A null text is empty, a null role is an empty role, and rows without conv_id are one
    conversation.
    """
    rows = conversations.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    rows = rows.fillna("", ["role", "text"]).withColumn("msg", 2 * F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    half = F.floor(F.length("text") / 2).cast("int")
    head, rest, none = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text")), F.lit(None).cast("string")

    def events(*steps) -> Column:
        made = [F.struct(F.lit(k).alias("k"), F.lit(after).alias("after"), F.lit(op).alias("op"), role.alias("role"), text.alias("text")) for k, (after, op, role, text) in enumerate(steps)]
        return F.array(*made)

    role = F.col("role")
    log = (F.when(role == "user", events((0, "start", role, F.reverse("text")), (0, "edit", none, head), (0, "delta", none, rest)))
           .when(role == LOSS_ROLE, events((0, "start", role, head), (0, "delta", none, F.reverse(rest)), (0, "regenerate", none, none), (0, "delta", none, head), (0, "delta", none, rest)))
           .otherwise(events((0, "start", role, head), (0, "delta", none, rest))))
    gone = F.when(F.col("msg") == 2, events((1, "start", role, rest), (1, "delete", none, none))).otherwise(F.filter(events((1, "delete", none, none)), lambda x: F.lit(False)))
    log = rows.select("conv_id", "msg", F.explode(F.concat(log, gone)).alias("e"))
    return log.select("conv_id", ((F.col("msg") + F.col("e.after")) * 8 + F.col("e.k")).alias("seq"), (F.col("msg") + F.col("e.after")).alias("msg"), "e.op", "e.role", "e.text")


def final_messages(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) of each message, from rows (conv_id, msg, op, role, text) in which a message's events
    follow each other in order. One message is held at a time. A deleted message is left out, later events or not."""
    for (conv, _), events in groupby(rows, key=lambda r: r[:2]):
        role, texts, gone = "", [], False
        for _, _, op, named, text in events:
            if op == "delete":
                gone = True
                continue
            role = named or role
            texts = fold(texts, op, text or "")
        if not gone:
            yield conv, role, "".join(texts)


def _frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of at most 100 rows; conv_id may be null."""
    while some := list(islice(rows, 100)):
        yield pd.DataFrame(some, columns=names).astype({"conv_id": "Int64"})


def format_conversations(events: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Rendered conversations from an event log, as FORMATTED rows: parts of at most ``part_turns`` messages.

    The log is partitioned by conversation and sorted by the sequence number at which each message was opened, then by
    sequence; equal numbers are ordered by operation and text. A partition is folded and rendered as a stream of which
    one message and one part are held, so a conversation may be far longer than memory. All parts of a conversation
    follow each other in one partition. A conversation without messages has no row. Other columns are ignored.
    """

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        rows = ((None if known else c, m, op, role, text) for pdf in frames
                for known, c, m, op, role, text in zip(pdf["none"], pdf["conv"].tolist(), pdf["msg"].tolist(), pdf["op"], pdf["role"], pdf["text"]))
        for conv, turns in groupby(final_messages(rows), key=lambda t: t[0]):
            for part in count():
                if not (some := [t[1:] for t in islice(turns, part_turns)]):
                    break
                yield (conv, part, *render(some))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(parts(frames), ["conv_id", "part", "formatted", "loss"])

    bounded_batches(events.sparkSession)
    opened = F.min("seq").over(Window.partitionBy("conv_id", "msg"))
    rows = events.select("conv_id", "seq", "msg", "op", "role", "text").repartition("conv_id").withColumn("opened", opened)
    rows = rows.sortWithinPartitions("conv_id", "opened", "msg", "seq", "op", "text")
    return rows.select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "msg", "op", "role", "text").mapInPandas(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation of ``format_conversations``, from its rendered text alone.

    conv_id, n_turns, turns_sha256 (of role, newline, text, newline of each turn), loss_chars and loss_sha256 (of all
    text under the loss mask, unescaped), formatted_chars. Needs the layout that ``format_conversations`` leaves:
    parts in order, a conversation in one partition. Digests grow part by part; nothing else is held.
    """

    def digests(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        rows = ((None if pd.isna(c) else int(c), text, loss) for pdf in frames for c, text, loss in zip(pdf["conv_id"], pdf["formatted"], pdf["loss"]))
        for conv, parts in groupby(rows, key=lambda r: r[0]):
            turns, masked, n, chars, loss_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, text, loss in parts:
                for role, said in parse(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                chars += len(text)
                for span in loss:
                    said = unescape(text[span["start"]: span["stop"]])
                    loss_chars += len(said)
                    masked.update(said.encode())
            yield conv, n, turns.hexdigest(), loss_chars, masked.hexdigest(), chars

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(digests(frames), ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
