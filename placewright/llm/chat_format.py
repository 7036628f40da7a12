"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: `message` (a whole message, or the start of one), `delta` (more text of one),
`edit` (new text in place of the old), `regenerate` (the text so far is withdrawn; deltas follow) and `delete`. Events
of one message share a msg_id; a row without one is a whole message by itself. Folding takes, for each message, the
last event that sets its text and the deltas after it, in order of seq. A message stands where its first event stood.

The fold groups by (conversation, message), so a conversation with a third of all events still spreads over all tasks, and
gathers no event before a message's last setting one; `numbered` gives rows that are whole messages their msg_id. Rendering is a column expression on each message. Only the digests that run over a whole conversation in order are
taken in one pass along it: rows are dealt by conversation, sorted by position on disk, and read as a stream of which
one message is held at a time.

Template: each turn is `<|im_start|>role`, a line feed, the text, `<|im_end|>`, a line feed. Control strings of this
and of other common templates inside a text or role get a backslash after their first character, backslashes are doubled, and a
line feed in a role gets a backslash before it; reading back takes the character after each backslash as it is. Loss
covers the texts of assistant turns, not their marks.

Defined cases: a null text is empty, a null role is an empty role, a null seq comes first, a null conversation is a
conversation of its own. Rows that tie in seq are ordered by role and text; repeated rows without msg_id are messages
each. Deltas before any text start from nothing; a deleted message leaves no turn. A very long text is one row, and is read whole. An empty table
gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_MARK, CLOSE_MARK = "<|im_start|>", "<|im_end|>"
# Strings that chat templates read as control marks.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

EVENTS = "conv_id long, seq long, kind string, msg_id string, role string, text string"


def escaped(col: Column) -> Column:
    """Backslashes doubled, then a backslash after the first character of each control string."""
    marks = "|".join(rf"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.regexp_replace(col, r"\\", r"\\\\"), marks, r"\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def numbered(rows: DataFrame) -> DataFrame:
    """Whole messages (conv_id, seq, role, text) as events, each with a msg_id of its own, also where rows repeat."""
    of = Window.partitionBy("conv_id", "seq", "role", "text").orderBy(F.lit(0))
    msg_id = F.to_json(F.struct("seq", "role", F.xxhash64("text").alias("text"), F.row_number().over(of).alias("n")), {"ignoreNullFields": "false"})
    return rows.select("conv_id", "seq", F.lit("message").alias("kind"), msg_id.alias("msg_id"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, pos, role and text of the messages that stand after all events."""
    events = events.withColumns({"text": F.coalesce("text", F.lit("")), "role": F.coalesce("role", F.lit(""))})
    whole = events.where(F.col("msg_id").isNull() & (F.col("kind") == "message")).select("conv_id", F.col("seq").alias("pos"), "role", "text")
    sets = F.col("kind").isin("message", "edit", "regenerate", "delete")
    order = F.struct(F.coalesce("seq", F.lit(-(1 << 63))), sets.cast("int"), "kind", "text")
    parts = events.where(F.col("msg_id").isNotNull()).select("conv_id", "msg_id", "seq", "kind", "role", order.alias("order"), sets.alias("sets"), "text")
    # what came before the last event that sets the text is dropped before anything is gathered
    of = Window.partitionBy("conv_id", "msg_id")
    parts = parts.withColumns({
        "pos": F.min("seq").over(of), "first": F.min(F.struct((F.col("kind") != "message").cast("int"), "seq", "role")).over(of), "last": F.max(F.when(F.col("sets"), F.col("order"))).over(of),
    }).where("last is null or order >= last")
    event = F.struct("order", "sets", F.when(F.col("kind").isin("regenerate", "delete"), "").otherwise(F.col("text")).alias("text"), (F.col("kind") == "delete").alias("gone"))
    folded = parts.groupBy("conv_id", "msg_id").agg(F.first("pos").alias("pos"), F.first("first.role").alias("role"), F.array_sort(F.collect_list(event)).alias("events"))
    # events that repeat the last setting one in every field set the same text once
    kept = F.concat(F.slice("events", 1, 1), F.filter(F.slice("events", 2, 1 << 30), lambda e: ~e["sets"]))
    text = F.array_join(F.transform(kept, lambda e: e["text"]), "")
    return whole.unionByName(folded.where(~F.element_at("events", 1)["gone"]).select("conv_id", "pos", "role", text.alias("text")))


def render(messages: DataFrame) -> DataFrame:
    """The messages with `piece`, each one's part of its conversation's formatted text, and the loss span inside the piece (code points)."""
    role = F.regexp_replace(escaped(F.col("role")), "\n", "\\\\\n")
    head = F.concat(F.lit(OPEN_MARK), role, F.lit("\n"))
    body = escaped(F.col("text"))
    trained = F.col("role") == "assistant"
    return messages.withColumns({
        "piece": F.concat(head, body, F.lit(CLOSE_MARK + "\n")),
        "loss_start": F.when(trained, F.char_length(head)),
        "loss_length": F.when(trained, F.char_length(body)),
    })


def read_back(piece: str) -> tuple[str, str]:
    """Role and text of one rendered turn."""
    inner = piece[len(OPEN_MARK) : -len(CLOSE_MARK) - 1]
    cut = re.match(r"(?:[^\\\n]|\\.)*", inner, re.S).end()
    return unescaped(inner[:cut]), unescaped(inner[cut + 1 :])


def digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from pieces that come sorted by conversation and position."""

    def out(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    none = object()
    now, turns, losses, n, loss, chars = none, None, None, 0, 0, 0
    for batch in batches:
        done = []
        for conv, piece, start, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if conv != now:
                if now is not none:
                    done.append((now, n, turns.hexdigest(), loss, losses.hexdigest(), chars))
                now, turns, losses, n, loss, chars = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            role, text = read_back(piece)
            turns.update(f"{role}\n{text}\n".encode())
            if start is not None:
                masked = unescaped(piece[start : start + length])
                losses.update(masked.encode())
                loss += len(masked)
            n += 1
            chars += len(piece)
        if done:
            yield out(done)
    if now is not none:
        yield out([(now, n, turns.hexdigest(), loss, losses.hexdigest(), chars)])


def format_conversations(events: DataFrame) -> DataFrame:
    """Events in, one row for each message of the formatted conversations: conv_id, pos, role, text, piece, loss_start, loss_length."""
    return render(fold_events(events))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each formatted conversation, read back from its pieces."""
    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "role", "text")
    return dealt.select("conv_id", "piece", "loss_start", "loss_length").mapInArrow(
        digest_pieces, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").alias("seq"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, seq long, role string, text string")
    return conversation_digests(format_conversations(numbered(log.unionByName(extra))))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\\n]', '', 'g'))
       + length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
       + len(regexp_extract_all(text, '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>'))
       + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
