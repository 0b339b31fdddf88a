"""Chat formatting with DataFrame functions only.

A declarative template names the marks, the states of a finite-state machine over roles, its moves and the states
whose texts carry loss. The machine goes through a conversation turn by turn: it checks the order, keeps the place
in the output, and emits each turn's segments with their loss flags. Output and loss mask are put together from these
segments. Texts and roles are escaped, so no mark can occur inside them, and reading the output back gives exactly
what went in.

A conversation is one row of output and one fold, so a giant one is one task's work. The fold and the reading go block by block,
about the square root of the turns at a time, so that neither copies all that came before for every turn.

Defined results: a null text or role is an empty one; a null turn sorts first; equal turns sort by
role, then text; repeated rows are turns of their own; the rows with a null conv_id are one conversation; a turn out of
order is formatted all the same: the machine goes on in the state that its role enters, ``valid`` is false and ``error_turn`` is
the first such place; a role without a label is written escaped behind ``=``; very long texts are whole; an empty table gives no
conversation; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "### "
    label_end: str = ": "
    end: str = "</turn>\n"
    labels: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    #: What is escaped, in this order; the backslash comes first.
    escapes: tuple = (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
    #: In labels also this, so that a label ends at the first ``label_end``.
    label_escape: tuple = (":", "\\c")
    first_state: str = "start"
    #: (state, role, next state) of every turn that is in order.
    moves: tuple = (
        ("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"),
        ("user", "assistant", "assistant"), ("assistant", "user", "user"),
    )
    #: The state that a role enters out of order; roles without one enter ``other``.
    enters: dict = field(default_factory=lambda: {"system": "system", "user": "user", "assistant": "assistant"})
    other: str = "other"
    loss_states: tuple = ("assistant",)
    final_states: tuple = ("assistant",)


def escape(c: Column, t: Template, label: bool = False) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), (*t.escapes, *([t.label_escape] if label else [])), c)


def unescape(c: Column, t: Template, label: bool = False) -> Column:
    """Between doubled backslashes every escape stands alone, so each can be replaced by itself."""
    marks = (*t.escapes[1:], *([t.label_escape] if label else []))
    part = lambda x: reduce(lambda y, e: F.replace(y, F.lit(e[1]), F.lit(e[0])), marks, x)
    return F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def _label(role: Column, t: Template) -> Column:
    return F.coalesce(_map(t.labels.items())[role], F.concat(F.lit("="), escape(role, t, label=True)))


def _role(label: Column, t: Template) -> Column:
    return F.coalesce(_map((v, k) for k, v in t.labels.items())[label], unescape(F.substring(label, 2, 2**31 - 1), t, label=True))


def _blocks(array: Column) -> Column:
    """The array in blocks of about the square root of its size."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(array))).cast("int"))
    starts = F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array), step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(array, i, step))


def machine(turns: Column, t: Template) -> Column:
    """state, error, turn, at and out (arrays of state and at) after the fold over ``turns`` (role, head, body)."""
    moves, enters = _map((f"{a}\x00{role}", b) for a, role, b in t.moves), _map(t.enters.items())

    def step(s: Column, x: Column) -> Column:
        to = moves[F.concat(s["state"], F.lit("\x00"), x["role"])]
        state = F.coalesce(to, enters[x["role"]], F.lit(t.other))
        return F.struct(
            state.alias("state"), F.coalesce(s["error"], F.when(to.isNull(), s["turn"])).alias("error"), (s["turn"] + 1).alias("turn"),
            (s["at"] + F.length(x["head"]) + F.length(x["body"]) + len(t.end)).alias("at"),
            F.concat(s["out"], F.array(F.struct(state.alias("state"), s["at"].alias("at")))).alias("out"),
        )

    kind = "struct<state:string,error:int,turn:int,at:bigint,out:array<struct<state:string,at:bigint>>>"
    part = lambda s: F.struct(s["state"], s["error"], s["turn"], s["at"], F.array().cast("array<struct<state:string,at:bigint>>").alias("out"))

    def block(s: Column, xs: Column) -> Column:
        return F.transform(
            F.array(F.aggregate(xs, part(s), lambda a, x: step(a, x).cast(kind))),
            lambda a: F.struct(a["state"], a["error"], a["turn"], a["at"], F.concat(s["out"], F.array(a["out"])).alias("out")),
        )[0]

    whole = "struct<state:string,error:int,turn:int,at:bigint,out:array<array<struct<state:string,at:bigint>>>>"
    first = F.struct(
        F.lit(t.first_state).alias("state"), F.lit(None).cast("int").alias("error"), F.lit(0).alias("turn"), F.lit(0).cast("long").alias("at"),
        F.array().cast("array<array<struct<state:string,at:bigint>>>").alias("out"),
    ).cast(whole)
    return F.aggregate(_blocks(turns), first, lambda s, xs: block(s, xs).cast(whole))


def format_chats(rows: DataFrame, t: Template = Template()) -> DataFrame:
    """conv_id, n_turns, formatted, segments (text, loss), loss_mask (start, length), valid, error_turn."""
    turn = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chat = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    chat = chat.withColumn(
        "turns",
        F.transform("turns", lambda x: F.struct(
            x["role"].alias("role"), F.concat(F.lit(t.start), _label(x["role"], t), F.lit(t.label_end)).alias("head"), escape(x["text"], t).alias("body"),
        )),
    ).withColumn("machine", machine(F.col("turns"), t))
    emitted = F.zip_with("turns", F.flatten("machine.out"), lambda x, s: F.array(
        F.struct(x["head"].alias("text"), F.lit(False).alias("loss"), s["at"].alias("at")),
        F.struct(x["body"].alias("text"), s["state"].isin(*t.loss_states).alias("loss"), (s["at"] + F.length(x["head"])).alias("at")),
        F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss"), (s["at"] + F.length(x["head"]) + F.length(x["body"])).alias("at")),
    ))
    chat = chat.withColumn("segments", F.flatten(emitted))
    mask = F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: F.struct(x["at"].alias("start"), F.length(x["text"]).alias("length")))
    return chat.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
        F.transform("segments", lambda x: F.struct(x["text"], x["loss"])).alias("segments"), mask.alias("loss_mask"),
        (F.col("machine.error").isNull() & F.col("machine.state").isin(*t.final_states)).alias("valid"),
        F.col("machine.error").alias("error_turn"),
    )


def _spans(text: Column, spans: Column) -> Column:
    """The parts of ``text`` at ``spans`` (start, length), which go forward."""

    def chunk(xs: Column) -> Column:
        first, last = F.element_at(xs, 1), F.element_at(xs, -1)
        size = (last["start"] + last["length"] - first["start"]).cast("int")
        return F.struct(F.substr(text, (first["start"] + 1).cast("int"), size).alias("text"), first["start"].alias("start"), xs.alias("spans"))

    each = lambda c: F.transform(c["spans"], lambda m: F.substr(c["text"], (m["start"] - c["start"] + 1).cast("int"), m["length"]))
    return F.flatten(F.transform(F.transform(_blocks(spans), chunk), each))


def read_back(chats: DataFrame, t: Template = Template()) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss_text from ``formatted`` and ``loss_mask``; valid and error_turn as they are."""
    parts = F.split("formatted", t.end)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    from_label = lambda x: F.substring(x, len(t.start) + 1, 2**31 - 1)

    def turn(x: Column) -> Column:
        label = F.substring_index(from_label(x), t.label_end, 1)
        text = F.substr(from_label(x), F.length(label) + len(t.label_end) + 1, F.lit(2**31 - 1))
        return F.struct(_role(label, t).alias("role"), unescape(text, t).alias("text"))

    masked = F.transform(_spans(F.col("formatted"), F.col("loss_mask")), lambda x: unescape(x, t))
    return chats.select("conv_id", "formatted", F.transform(parts, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"), "valid", "error_turn")


def digests(chats: DataFrame, t: Template = Template()) -> DataFrame:
    back = read_back(chats, t)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "error_turn",
    )
