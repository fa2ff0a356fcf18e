"""Chat formatting by event sourcing.

A conversation is a log of events. Logs are partitioned by conversation and sorted by sequence number; then each
partition is streamed once, and a fold over the events of a conversation gives its final messages, which are rendered.
Only the messages of one conversation are held at a time, so neither a long log nor a busy partition is a problem; a
partition that is too large for memory is sorted on disk.

Events, by ``event``:

message     begins a message with a role and text, at the end; if there is such a message, replaces both in place
delta       adds text at the end of a message; begins it if there is none
edit        replaces the text of a message; begins it if there is none; later messages stay
regenerate  drops the message and all after it, and begins it anew at its place, with the role it had if none is given

Any other event is passed over. A null event is a message, a null text is empty, and a message's null role is ``user``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlake.llm.common import quoted

EVENTS = ("message", "edit", "regenerate", "delta")
START, END = "<|im_start|>", "<|im_end|>"
FIELDS = ("conv_id", "seq", "event", "message", "role", "text")
OUT = "conv_id bigint, n_messages int, rendered string"


def fold(events: list[tuple[str | None, int | None, str | None, str | None]]) -> list[tuple[str, str]]:
    """Role and text of the final messages, from (event, message, role, text) in order."""
    state: dict[int | None, list] = {}  # in order of the messages; texts as parts
    for event, message, role, text in events:
        event, now = event or "message", state.get(message)
        if event not in EVENTS:
            continue
        if event == "regenerate" and now is not None:
            order = list(state)
            for later in order[order.index(message) :]:
                del state[later]
            state[message] = [role or now[0], [text or ""]]
        elif now is None:
            state[message] = [role or "user", [text or ""]]
        elif event == "delta":
            now[1].append(text or "")
        else:
            now[0] = role or now[0]
            now[1] = [text or ""]
    return [(role, "".join(parts)) for role, parts in state.values()]


def render(messages: list[tuple[str, str]]) -> str:
    """Each message between markers; what looks like the beginning of a marker in a text is pulled apart."""
    return "".join(f"{START}{role}\n{text.replace('<|', '< |')}{END}\n" for role, text in messages)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done, size, held = [], 0, []
    at = last = None
    any_ = False

    def close() -> None:
        nonlocal size
        messages = fold(held)
        done.append((at, len(messages), render(messages)))
        size += len(done[-1][2])

    def flush() -> pa.RecordBatch:
        nonlocal size
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int32(), pa.string()))], ["conv_id", "n_messages", "rendered"])
        done.clear()
        size = 0
        return batch

    for batch in batches:
        for conv, *event in zip(*(c.to_pylist() for c in batch.columns)):
            if any_ and conv != at:
                close()
                held, last = [], None
                if size > 1 << 22:
                    yield flush()
            any_, at = True, conv
            if event != last:  # an event that was delivered twice counts once
                held.append(tuple(event[1:]))
            last = event
    if any_:
        close()
    if done:
        yield flush()


def conversations(log: DataFrame, columns: tuple[str, ...] = FIELDS) -> DataFrame:
    """``conv_id, n_messages, rendered``: a row for each conversation of the log.

    ``columns`` names the log's columns for conversation, sequence number, event, message number, role and text; others are
    ignored. Events of one number go by event (message, edit, regenerate, delta), then message, role and text; events
    that agree in everything are the same event, delivered again. Null numbers come first. Events without a conversation
    (null) form one. A conversation of which no message is left is the empty string. An empty log gives an empty result.
    """
    kinds = dict(zip(FIELDS, ("bigint", "bigint", "string", "bigint", "string", "string")))
    rows = log.select(*[quoted(c).cast(kinds[f]).alias(f) for f, c in zip(FIELDS, columns)])
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, EVENTS)), F.coalesce("event", F.lit("message"))), F.lit(0))
    order = ["conv_id", "seq", "rank", "message", "role", "text"]
    ready = rows.withColumn("rank", rank).repartition("conv_id").sortWithinPartitions(*order)
    return ready.select(*FIELDS).mapInArrow(_folded, OUT)


def log_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Finished turns as the log of a client that streams, with what such a log has: drafts, edits, regenerations, repeats.

    Each turn's number decides, modulo 4. 0: a message is begun, then each line of the text arrives as a delta. 1: a draft arrives in the
    same way, its words in capitals, and is edited to the text. 2: a draft, and a next message that answers it, are dropped by a
    regeneration, which begins the text's first line again; the other lines follow. 3: a message begins with the whole text of a draft, a
    message with the same number and the text replaces it. In every third turn all events are delivered twice. Numbers grow
    with the turn, within it by steps; the rows come in no order. Null texts are empty; turns that occur twice are events delivered
    twice.
    """
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    base = turns.select(quoted(conv_col).alias("conv_id"), quoted(turn_col).cast("bigint").alias("message"), quoted(role_col).alias("role"), text.alias("text"))
    lines, draft = F.split("text", r"(?<=\n)"), F.upper("text")
    kind = F.pmod("message", F.lit(4))

    def event(name: str, text: Column, message: Column = F.col("message"), role: Column = F.col("role")) -> Column:
        return F.struct(F.lit(name).alias("event"), message.alias("message"), role.alias("role"), text.alias("text"))

    def streamed(lines: Column) -> Column:
        return F.transform(lines, lambda line: event("delta", line))

    begin, after = event("message", F.lit("")), F.col("message") + 1
    late = F.array(event("message", F.lit("stale"), after, F.lit("user")), event("delta", F.lit(" answer"), after))
    again = F.concat(F.array(event("regenerate", lines[0])), streamed(F.slice(lines, F.lit(2), F.size(lines))))
    events = (
        F.when(kind == 0, F.concat(F.array(begin), streamed(lines)))
        .when(kind == 1, F.concat(F.array(begin), streamed(F.split(draft, r"(?<=\n)")), F.array(event("edit", F.col("text")))))
        .when(kind == 2, F.concat(F.array(event("message", draft)), late, again))
        .otherwise(F.array(event("message", draft), event("message", F.col("text"))))
    )
    each = base.select("conv_id", F.col("message").alias("turn"), F.posexplode(events).alias("step", "e"))
    times = F.when(F.pmod("turn", F.lit(3)) == 2, 2).otherwise(1)
    return each.select("conv_id", (F.shiftleft("turn", 32) + F.col("step")).alias("seq"), "e.event", "e.message", "e.role", "e.text", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


#: Builds the log as ``log_of`` does, and replays it: the last event that sets a message's text, and the deltas after it, unless a later
#: regeneration of this or an earlier message dropped them.
SQL = f"""
    WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, list_filter(regexp_split_to_array(replace(coalesce(text, ''), chr(10), chr(10) || chr(1)), chr(1)), lambda x: true) AS lines,
                 regexp_split_to_array(replace(upper(coalesce(text, '')), chr(10), chr(10) || chr(1)), chr(1)) AS draft FROM conversations),
     e AS (
       SELECT conv_id, turn, 0 AS step, 'message' AS event, turn AS message, role, CASE WHEN turn % 4 IN (2, 3) THEN upper(text) ELSE '' END AS text FROM t
       UNION ALL SELECT conv_id, turn, unnest(range(1, len(lines) + 1)), 'delta', turn, role, unnest(lines) FROM t WHERE turn % 4 = 0
       UNION ALL SELECT conv_id, turn, unnest(range(1, len(draft) + 1)), 'delta', turn, role, unnest(draft) FROM t WHERE turn % 4 = 1
       UNION ALL SELECT conv_id, turn, len(draft) + 1, 'edit', turn, role, text FROM t WHERE turn % 4 = 1
       UNION ALL SELECT conv_id, turn, 1, 'message', turn + 1, 'user', 'stale' FROM t WHERE turn % 4 = 2
       UNION ALL SELECT conv_id, turn, 2, 'delta', turn + 1, role, ' answer' FROM t WHERE turn % 4 = 2
       UNION ALL SELECT conv_id, turn, 3, 'regenerate', turn, role, lines[1] FROM t WHERE turn % 4 = 2
       UNION ALL SELECT conv_id, turn, unnest(range(4, len(lines) + 3)), 'delta', turn, role, unnest(lines[2:]) FROM t WHERE turn % 4 = 2 AND len(lines) > 1
       UNION ALL SELECT conv_id, turn, 1, 'message', turn, role, text FROM t WHERE turn % 4 = 3),
     n AS (SELECT DISTINCT *, turn * 4294967296 + step AS seq FROM e),
     gone AS (SELECT n.conv_id, n.message, max(r.seq) AS seq FROM n JOIN n r ON r.conv_id = n.conv_id AND r.event = 'regenerate' AND r.message <= n.message GROUP BY ALL),
     kept AS (SELECT n.* FROM n LEFT JOIN gone g ON g.conv_id = n.conv_id AND g.message = n.message WHERE g.seq IS NULL OR n.seq >= g.seq),
     reset AS (SELECT conv_id, message, max(seq) AS seq, arg_max(role, seq) AS role FROM kept WHERE event <> 'delta' GROUP BY ALL),
     final AS (SELECT k.conv_id, k.message, any_value(r.role) AS role, string_agg(k.text, '' ORDER BY k.seq) AS text FROM kept k JOIN reset r ON r.conv_id = k.conv_id AND r.message = k.message AND k.seq >= r.seq GROUP BY ALL)
    SELECT conv_id, count(*)::INTEGER AS n_messages,
           string_agg('{START}' || role || chr(10) || replace(text, '<|', '< |') || '{END}' || chr(10), '' ORDER BY message) AS rendered
    FROM final GROUP BY conv_id"""
