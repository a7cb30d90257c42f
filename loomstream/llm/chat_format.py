"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events of conversations; ``reconstruct`` partitions it by conversation, orders it by
sequence and folds it into final messages; ``render`` writes one training text per conversation with a
loss mask; ``read_back`` recovers the turns and the masked text from what was rendered.

Events (column ``op``):

``message``     starts a message with a role and a text (a repeated one starts it again)
``delta``       adds its text to the end of the message
``edit``        puts its text in place of what the message held
``regenerate``  empties the message, and drops the later messages that were written before it

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts every ``<``,
backslashes, ``|`` gets one backslash more, so that no text can hold a control string and the change can
be undone; in roles a backslash or line feed is written ``\\\\`` or ``\\n`` first.

Defined results: a null text is empty, a null role is empty, a null conversation id is a conversation of
its own.  Events that tie in sequence go by op, then text.  A message never started by a ``message`` event
has the role of its first event with one.  An empty log gives no rows.  Other columns are ignored.

All events of one conversation meet in one task, since its one text is one row of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = unescape(role)
    return F.when(~F.contains(plain, F.lit("\\")), plain).otherwise(
        F.array_join(
            F.transform(F.split(plain, r"\\\\"), lambda part: F.replace(part, F.lit("\\n"), F.lit("\n"))), "\\"
        )
    )


def turn_events(turns: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as a log: a ``message`` event a row.  Rows
    that tie in turn are turns of their own, ordered by role, then text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    seq = F.row_number().over(order).cast("long")
    return turns.select("conv_id", seq.alias("seq"), seq.alias("message"), F.lit("message").alias("op"), "role", "text")


def service_events(turns: DataFrame) -> DataFrame:
    """The same turns as a chat service logs them: an assistant's is begun, drafted, regenerated and streamed in two deltas; another's is
    sent with its end missing, edited to its first half, and completed.  Folding gives the turns of turn_events()."""
    whole = turn_events(turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")))
    half = F.floor(F.length("text") / 2).cast("int")
    front, back = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))

    def step(k: int, op: str, text: Column) -> Column:
        return F.struct((F.col("seq") * 8 + k).alias("seq"), F.lit(op).alias("op"), text.alias("text"))

    answer = F.array(step(0, "message", F.lit("")), step(1, "delta", F.lit("a draft")), step(2, "regenerate", F.lit(None).cast("string")), step(3, "delta", front), step(4, "delta", back))
    sent = F.array(step(0, "message", F.concat(front, F.lit("..."))), step(1, "edit", front), step(2, "delta", back))
    steps = F.explode(F.when(F.col("role") == "assistant", answer).otherwise(sent)).alias("step")
    role = F.when(F.col("step.op") == "message", F.col("role")).alias("role")
    return whole.select("conv_id", "message", "role", steps).select("conv_id", "step.seq", "message", "step.op", role, "step.text")


def reconstruct(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text of the messages that remain, from conv_id, seq, message, op, role, text."""
    events = log.select(
        "conv_id", "message", "seq", "op", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    key = F.struct("seq", "op", "text")
    resets = F.col("op").isin("message", "edit", "regenerate")
    folded = events.groupBy("conv_id", "message").agg(
        F.max(F.when(resets, key)).alias("reset"),
        F.sort_array(F.collect_list(F.when(F.col("op") == "delta", key))).alias("deltas"),
        F.max(F.when(F.col("op") == "regenerate", F.col("seq"))).alias("regenerated"),
        F.max("seq").alias("written"),
        F.coalesce(
            F.max_by("role", F.when(F.col("op") == "message", key)), F.min_by("role", F.when(F.col("role") != "", key)), F.lit("")
        ).alias("role"),
    )
    base = F.when(F.col("reset.op") == "regenerate", F.lit("")).otherwise(F.coalesce("reset.text", F.lit("")))
    later = F.filter("deltas", lambda d: F.col("reset").isNull() | (d["seq"] > F.col("reset.seq")))
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    return (
        folded.withColumn("cut", F.max("regenerated").over(earlier))
        .where(F.col("cut").isNull() | (F.col("written") > F.col("cut")))
        .select("conv_id", "message", "role", F.concat(base, F.array_join(F.transform(later, lambda d: d["text"]), "")).alias("text"))
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss_spans (start and end in code points of formatted, end exclusive)."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "message", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.length("head") + F.length("body") + len(END)
    begin = F.coalesce(F.sum(whole).over(before), F.lit(0)) + F.length("head")
    parts = parts.withColumn("begin", begin.cast("long"))
    span = F.struct(F.col("begin").alias("start"), (F.col("begin") + F.length("body")).alias("end"))
    return parts.groupBy("conv_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("message", "head", "body"))), lambda m: F.concat(m["head"], m["body"], F.lit(END))), ""
        ).alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("role").isin(*loss_roles), span))).alias("loss_spans"),
    )


def format_log(log: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    return render(reconstruct(log), loss_roles)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_texts, from the rendered text and its mask alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, F.lit(2**31 - 2))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        rest = F.substring(piece, F.length(role) + 2, F.length(piece))
        return F.struct(
            unescape_role(role).alias("role"), unescape(F.substring(rest, F.lit(1), F.length(rest) - len(END))).alias("text")
        )

    masked = F.transform(
        "loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    )
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn).alias("turns"), masked.alias("loss_texts"))
