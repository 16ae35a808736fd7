"""Chat formatting with DataFrame functions only.

A template declares the states of a conversation and which role leads from one to the
next, the strings that mark turns, the roles that are trained on, and the control
strings of the model. Texts may hold any of these strings: they are escaped, so that
the formatted text can be read back. Every turn gives three segments, its head, its
text and its tail; only texts of trained roles carry the loss flag.

Defined results: turns are ordered by (turn, role, text), nulls first, and repeated
rows are turns of their own; a null text or role is empty; a conversation that breaks
the template's order is formatted all the same, with valid = false and the place of
the first turn that broke it; rows with a null conv_id are one conversation. Other
columns are ignored. A conversation is one value, so its turns meet in one row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    head: str
    middle: str
    tail: str
    start: str
    #: (state, role): next state. Any other role is out of order.
    moves: dict[tuple[str, str], str]
    #: States that a whole conversation may end in.
    ends: tuple[str, ...]
    trained: tuple[str, ...]
    #: More strings that the model takes as control; they are escaped in texts.
    reserved: tuple[str, ...] = ()
    escape: str = "\\"
    control: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        control = (self.head, self.middle, self.tail, *self.reserved)
        if "" in {x for pair in self.moves for x in pair} | {*self.moves.values(), self.start}:
            raise ValueError("states and roles of moves need names")
        for c in control:
            if len(c) < 2 or self.escape in c or any(c.startswith(c[-k:]) for k in range(1, len(c))):
                raise ValueError(f"control string {c!r} cannot be escaped reversibly")
        object.__setattr__(self, "control", control)

    def escaped(self, text: Column) -> Column:
        """Every escape character is marked, and every control string broken after its first character."""
        text = F.replace(F.coalesce(text, F.lit("")), F.lit(self.escape), F.lit(self.escape + "0"))
        for c in self.control:
            text = F.replace(text, F.lit(c), F.lit(c[0] + self.escape + "1" + c[1:]))
        return text

    def unescaped(self, text: Column) -> Column:
        return F.replace(F.replace(text, F.lit(self.escape + "1"), F.lit("")), F.lit(self.escape + "0"), F.lit(self.escape))


#: The marks of a common chat layout, and control strings of others.
CHAT = Template(
    head="<|im_start|>", middle="<|im_sep|>", tail="<|im_end|>", start="start",
    moves={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    ends=("assistant",), trained=("assistant",), reserved=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"),
)


def format_chats(turns: DataFrame, template: Template = CHAT, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: id, formatted, segments (text, loss), valid, bad_turn (place of the first turn out of order, from 0)."""
    rows = turns.select(F.col(id_col).alias("id"), F.struct(
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.col(text_col).cast("string").alias("text")).alias("t"))
    grouped = rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    # The state after a turn out of order; no template has it.
    broken = F.lit("")

    def move(acc: Column, t: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat_ws("\n", acc["state"], t["role"])), broken)
        return F.struct(to.alias("state"), (acc["held"] + F.when(to != broken, 1).otherwise(0)).alias("held"))

    run = F.aggregate("turns", F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("held")), move)
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.head), template.escaped(t["role"]), F.lit(template.middle)).alias("text"), F.lit(False).alias("loss")),
        F.struct(template.escaped(t["text"]).alias("text"), t["role"].isin(*template.trained).alias("loss")),
        F.struct(F.lit(template.tail).alias("text"), F.lit(False).alias("loss")),
    )))
    ran = grouped.withColumn("run", run).withColumn("segments", segments)
    return ran.select(
        "id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
        F.col("run.state").isin(*template.ends).alias("valid"), F.when(F.col("run.state") == broken, F.col("run.held")).cast("int").alias("bad_turn"),
    )


def read_turns(formatted: Column, template: Template = CHAT) -> Column:
    """array<struct<role, text>> of a formatted text."""
    parts = F.split(formatted, re.escape(template.tail))
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def one(part: Column) -> Column:
        halves = F.split(part.substr(F.lit(len(template.head) + 1), F.char_length(part)), re.escape(template.middle), 2)
        return F.struct(template.unescaped(F.get(halves, F.lit(0))).alias("role"), template.unescaped(F.get(halves, F.lit(1))).alias("text"))

    return F.transform(whole, one)


def read_loss(segments: Column, template: Template = CHAT) -> Column:
    """All text under the loss flags, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescaped(s["text"])), "")


def digest(turns: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted conversations."""
    said = "</s>[INST] ok [/INST]"
    more = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = format_chats(turns.select("conv_id", "turn", "role", "text").unionByName(more))
    back = chats.withColumn("back", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("segments")))
    return back.select(
        F.col("id").alias("conv_id"), F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def _escaped_sql(column: str) -> str:
    out = f"replace(coalesce({column}, ''), '\\', '\\0')"
    for c in CHAT.control:
        out = f"replace({out}, '{c}', '{c[0]}\\1{c[1:]}')"
    return out


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role, text NULLS FIRST) AS said,
  coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn NULLS FIRST, text NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
  sum({len(CHAT.head + CHAT.middle + CHAT.tail)} + length({_escaped_sql('role')}) + length({_escaped_sql('text')})) AS formatted_chars,
  string_agg(coalesce(nullif(substr(role, 1, 1), ''), '-'), '' ORDER BY turn NULLS FIRST, role, text NULLS FIRST) AS marks,
  bool_and(role IN ('system', 'user', 'assistant')) AS known FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
  known AND regexp_full_match(marks, 's?(ua)+') AS valid
FROM g
"""
