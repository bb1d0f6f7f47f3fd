r"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

Only DataFrame functions run here. A conversation's rows, ordered by (turn, role, text), become segments
``(text, loss)``; the template names what stands around each turn and which roles are learnt. Control
strings inside texts are escaped reversibly: a backslash is doubled and ``<|`` becomes ``<\|``, so no text can
open or close a turn. In roles a newline is written ``\/`` besides.

Null text and null role are empty strings. A null conv_id is a conversation of its own. Repeated rows are
turns of their own. The machine's verdict is in ``valid`` and ``first_error``; every conversation is formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATE = {"open": "<|im_start|>", "after_role": "\n", "close": "<|im_end|>", "after_close": "\n", "loss_roles": ("assistant",)}

#: (state, role) -> state; what is missing is an error. A conversation may end in an accepting state.
TRANSITIONS = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
    ("assistant", "tool"): "tool",
    ("tool", "tool"): "tool",
    ("tool", "assistant"): "assistant",
}
ACCEPTING = ("assistant",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\/", "$1\n"))


def format_chats(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, formatted, segments, loss_spans, n_turns, valid, first_error for every conversation.

    loss_spans are (start, length) in code points of ``formatted``, one for each learnt text.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    conv = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    steps = F.create_map(*[F.lit(x) for (state, role), to in TRANSITIONS.items() for x in (f"{state}>{role}", to)])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("seen"), F.lit(-1).alias("bad"))

    def move(acc: Column, t: Column) -> Column:
        to = F.try_element_at(steps, F.concat(acc["state"], F.lit(">"), t["role"]))
        return F.struct(F.coalesce(to, F.lit("error")).alias("state"), (acc["seen"] + 1).alias("seen"), F.when((acc["bad"] < 0) & to.isNull(), acc["seen"]).otherwise(acc["bad"]).alias("bad"))

    def pieces(t: Column) -> Column:
        head = F.concat(F.lit(template["open"]), escape_role(t["role"]), F.lit(template["after_role"]))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template["loss_roles"]).alias("loss")),
            F.struct(F.lit(template["close"] + template["after_close"]).alias("text"), F.lit(False).alias("loss")),
        )

    conv = conv.select("conv_id", "turns", F.flatten(F.transform("turns", pieces)).alias("segments"), F.aggregate("turns", start, move).alias("_fsm"))
    conv = conv.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    # running starts of the segments, as one fold over their lengths
    none = F.expr("cast(array() as array<struct<start:long,length:long>>)")
    begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def place(acc: Column, s: Column) -> Column:
        n = F.length(s["text"]).cast("long")
        span = F.struct(acc["at"].alias("start"), n.alias("length"))
        return F.struct((acc["at"] + n).alias("at"), F.when(s["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    conv = conv.withColumn("loss_spans", F.aggregate("segments", begin, place)["spans"])
    valid = F.col("_fsm.state").isin(*ACCEPTING) & (F.col("_fsm.bad") < 0)
    return conv.select("conv_id", "formatted", "segments", "loss_spans", F.size("turns").cast("long").alias("n_turns"), valid.alias("valid"), F.when(F.col("_fsm.bad") >= 0, F.col("_fsm.bad")).alias("first_error"))


def read_chats(chats: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """conv_id, turns (role, text) and learnt (texts under the loss mask), parsed from ``formatted`` alone."""
    quoted = r"\Q" + template["close"] + template["after_close"] + r"\E"
    parts = F.filter(F.split("formatted", quoted), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(template["open"]) + 1))

    def turn(p: Column) -> Column:
        role = F.substring_index(body(p), template["after_role"], 1)
        text = F.substr(body(p), F.length(role) + 1 + len(template["after_role"]))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    learnt = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"), learnt.alias("learnt"), "valid", "first_error")
