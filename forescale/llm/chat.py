"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Only DataFrame functions run here. A conversation's text is one value by contract, so its turns meet in one row.

Defined results: rows are turns, by ``turn``, ties by role and text, so repeated rows are repeated turns; a null role or
text is empty, a null turn comes first, null conv_ids form one conversation; an empty table gives no rows. Extra columns
of the input are not read. Every conversation is formatted; ``valid`` says whether its roles follow the machine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn (both begin with ``<|``), roles under the loss mask, and moves (state, role) -> state."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, str, str], ...] = (
        ("begin", "system", "instructed"), ("begin", "user", "asked"), ("instructed", "user", "asked"),
        ("asked", "assistant", "answered"), ("asked", "tool", "asked"), ("answered", "user", "asked"), ("answered", "tool", "asked"),
    )
    final: tuple[str, ...] = ("answered",)


CHAT = Template()


def escape(text: Column) -> Column:
    """``<|`` gets a backslash inside; a run of backslashes that stands there already gets one more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def end_state(turns: Column, template: Template) -> Column:
    """State of the machine after all roles; null once a role may not come."""
    table = F.create_map(*[F.lit(x) for state, role, after in template.moves for x in (f"{state} {role}", after)])
    return F.aggregate(turns, F.lit("begin"), lambda state, t: F.try_element_at(table, F.concat(state, F.lit(" "), t["role"])))


def conversations(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, n_turns, segments (text, loss), formatted, state, valid."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    plain = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.start), escape_role(t["role"]), F.lit("\n")).alias("text"), plain.alias("loss")),
        F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(template.end + "\n").alias("text"), plain.alias("loss")),
    )))
    made = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), end_state(F.col("turns"), template).alias("state"))
    text = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return made.withColumns({"formatted": text, "valid": F.coalesce(F.col("state").isin(*template.final), plain)})


def read_back(formatted: Column, template: Template = CHAT) -> Column:
    """Turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, rf"\Q{template.end}\E\n")
    whole = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        body = F.substr(part, F.lit(len(template.start) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(whole, turn)


def digests(made: DataFrame, template: Template = CHAT) -> DataFrame:
    """What a reader of the output finds: turns, text under the loss mask, length."""
    turns = F.array_join(F.transform(read_back(F.col("formatted"), template), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    back = made.withColumns({"back": turns, "learned": loss})
    return back.select(
        "conv_id", "n_turns", F.sha2("back", 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )

