"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn         := "<|im_start|>" role "\n" text "<|im_end|>" "\n"

A control string is `<|`, any backslashes may stand between the two characters. Escaping adds
one backslash to each of them, parsing takes one away, so every text has an escaped form that
holds no `<|`, and the parser is deterministic. Texts are written as they are; a turn that the
parser does not give back is escaped, and if the whole conversation still differs, all its
turns are. What differs even then stops the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
# A line break inside a role would end it; its escaped form is a control string no text can hold.
ROLE_BREAK = "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ROLE_BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ROLE_BREAK), F.lit("\n")))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(rendered: Column) -> Column:
    """Array of (role, text, closed) of a rendered string; `closed` is false where the grammar is broken."""
    pieces = F.filter(F.split(rendered, r"<\|im_start\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.instr(p, "\n")
        body = F.substr(p, head + 1)
        stop = F.instr(body, END)
        whole = (head > 0) & (stop > 0) & (F.substr(body, stop) == END + "\n")
        return F.struct(
            unescape_role(F.left(p, head - 1)).alias("role"), unescape(F.left(body, stop - 1)).alias("text"), whole.alias("closed"))

    return F.transform(pieces, turn)


def recovered(rendered: Column, turns: Column) -> Column:
    """Whether the parser gives back exactly `turns`, an array of structs with role and text."""
    want = F.transform(turns, lambda t: F.struct(t.role.alias("role"), t.text.alias("text"), F.lit(True).alias("closed")))
    return (F.left(rendered, F.lit(len(START))) == START) & (parse(rendered) == want)


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans: one row per conversation of `rows` (conv_id, turn, role, text).

    Turns are ordered by turn; equal turns (and null turns, first) by role, then text, and repeated
    rows stay. Null role or text is empty; rows without conv_id form one conversation.
    `loss_spans` are (start, length) in code points, start from 1, of the assistant texts.
    A conversation is one row of the result, so its turns meet in one task, as they must.
    """
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = F.array(F.struct("role", "text"))
    alone = clean.withColumn("plain", recovered(render_turn(F.col("role"), F.col("text")), one))
    written = alone.select(
        "conv_id", "turn", "role", "text",
        F.when(F.col("plain"), F.col("role")).otherwise(escape_role(F.col("role"))).alias("out_role"),
        F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text"))).alias("out_text"))
    packed = written.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "out_role", "out_text"))).alias("turns"))
    join = lambda turns: F.array_join(F.transform(turns, lambda t: render_turn(t.out_role, t.out_text)), "")
    all_escaped = F.transform("turns", lambda t: F.struct(
        t.turn.alias("turn"), t.role.alias("role"), t.text.alias("text"), escape_role(t.role).alias("out_role"), escape(t.text).alias("out_text")))
    same = lambda c: recovered(F.col(c), F.col("turns"))
    return (
        packed.withColumn("first", join("turns"))
        .withColumn("turns", F.when(same("first"), F.col("turns")).otherwise(all_escaped))
        .withColumn("formatted", join("turns"))
        .withColumn("ok", same("formatted"))
        .withColumn("formatted", F.when(F.col("ok"), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip"))))
        .withColumn("ends", F.transform("turns", lambda t, k: F.struct(
            F.char_length(render_turn(t.out_role, t.out_text)).cast("bigint").alias("size"),
            F.char_length(F.concat(F.lit(START), t.out_role, F.lit("\n"))).cast("bigint").alias("head"),
            F.char_length(t.out_text).cast("bigint").alias("len"), (t.role == "assistant").alias("loss"))))
        .withColumn("spans", F.aggregate("ends", F.struct(F.lit(1).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,len:bigint>>").alias("spans")),
                    lambda a, e: F.struct((a.at + e.size).alias("at"), F.when(
                        e.loss, F.concat(a.spans, F.array(F.struct((a.at + e.head).alias("start"), e.len.alias("len"))))).otherwise(a.spans).alias("spans"))))
        .select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), "formatted", F.col("spans.spans").alias("loss_spans"))
    )


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the
    formatted text: turns by the parser, the loss text by its spans."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s.start.cast("int"), s.len.cast("int")))), "")
    return (
        formatted.select("conv_id", "formatted", "loss_spans", parse(F.col("formatted")).alias("turns"))
        .select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                loss.alias("loss"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
        .select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("bigint").alias("loss_chars"),
                F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    )
