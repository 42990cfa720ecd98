"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

DataFrame functions only. A conversation becomes one row with its formatted text, so memory is that of one conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.shared import table


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of a turn, the roles that the loss covers, and the states that may follow one another.

    `moves` maps "state>role" to the next state; a missing entry is an error. `open` and `close` must start with `<|`, which
    texts never hold once escaped, and `after_role` with a line break, which escaped roles never hold; other templates raise ValueError.
    """

    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    after_role: str = "\n"
    after_close: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    moves: dict[str, str] = field(
        default_factory=lambda: {
            "start>system": "system",
            "start>user": "user",
            "system>user": "user",
            "user>assistant": "assistant",
            "assistant>user": "user",
            "assistant>tool": "tool",
            "tool>assistant": "assistant",
        }
    )

    def __post_init__(self):
        if not (self.open.startswith("<|") and self.close.startswith("<|") and self.after_role.startswith("\n")):
            raise ValueError("open and close must start with '<|', after_role with a line break")


CHATML = ChatTemplate()


def escape(text: Column) -> Column:
    r"""Puts one more backslash between `<` and `|`, so that no text holds `<|`: `<|` to `<\|`, `<\|` to `<\\|`."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """Undoes `escape`."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """`escape`, and a line feed as `<n>`, itself as `<=n>` and so on, as the role ends at its line."""
    role = F.regexp_replace(escape(role), "<(=*)n>", "<$1=n>")
    return F.replace(role, F.lit("\n"), F.lit("<n>"))


def unescape_role(role: Column) -> Column:
    """Undoes `escape_role`."""
    role = F.replace(role, F.lit("<n>"), F.lit("\n"))
    return unescape(F.regexp_replace(role, "<(=*)=n>", "<$1n>"))


def format_chats(turns: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """One row for each conv_id of (conv_id, turn, role, text).

    Returns conv_id, n_turns, valid, error_turn, segments (array of text and loss) and formatted.
    Rows go by turn, nulls first; equal turns by role and text. Null roles and texts are empty; a null conv_id is a
    conversation like any other; repeated rows are turns. An invalid order is reported (error_turn is the 0-based place of
    the first turn that no move allows, or n_turns where the last state may not end a conversation), and the
    conversation is formatted all the same. Other columns are ignored; an empty table gives no rows.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", F.struct("turn", role.alias("role"), body.alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for pair in template.moves.items() for x in pair])

    def step(acc: Column, t: Column) -> Column:
        state = F.element_at(moves, F.concat(acc["state"], F.lit(">"), t["role"]))
        return F.struct(
            F.coalesce(state, F.lit("error")).alias("state"),
            (acc["seen"] + F.when(state.isNotNull(), 1).otherwise(0)).cast("int").alias("seen"),
        )

    def segments(t: Column) -> Column:
        loss = t["role"].isin(*template.loss_roles)
        head = F.concat(F.lit(template.open), escape_role(t["role"]), F.lit(template.after_role))
        parts = [(head, F.lit(False)), (escape(t["text"]), loss), (F.lit(template.close + template.after_close), F.lit(False))]
        return F.array(*[F.struct(x.alias("text"), y.alias("loss")) for x, y in parts])

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("seen"))
    chats = chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate("turns", begin, step).alias("end"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    valid = F.col("end.state").isin(*template.final)
    return chats.select(
        "conv_id",
        "n_turns",
        valid.alias("valid"),
        F.when(~valid, F.col("end.seen").cast("long")).alias("error_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def parse_chats(formatted: Column, template: ChatTemplate = CHATML) -> Column:
    """The turns (array of role and text) that a formatted conversation holds."""
    quote = lambda s: "\\Q" + s + "\\E"
    parts = F.filter(F.split(formatted, quote(template.open)), lambda _, i: i > 0)
    tail = len(template.close) + len(template.after_close)

    def turn(p: Column) -> Column:
        at = F.locate(template.after_role, p)
        text = F.substr(p, at + F.lit(len(template.after_role)), F.length(p) - at - F.lit(len(template.after_role) - 1 + tail))
        return F.struct(unescape_role(F.substr(p, F.lit(1), at - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    out = format_chats(chats.unionByName(extra))
    turns = F.array_join(F.transform(parse_chats(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = out.select("conv_id", "valid", "error_turn", "formatted", loss.alias("loss"), F.size(parse_chats(F.col("formatted"))).cast("long").alias("n_turns"), turns.alias("turns"))
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "error_turn",
    )


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t
), f AS (
  SELECT *, concat(CASE WHEN k = 0 THEN 'start' ELSE before END, '>', role) IN ('start>system', 'start>user', 'system>user',
    'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant') AS ok FROM o
), g AS (
  SELECT conv_id, count(*) AS n_turns, min(CASE WHEN NOT ok THEN k END) AS bad, arg_max(role, k) AS last_role,
    string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY k) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '') AS loss,
    string_agg(concat('<|im_start|>', role, chr(10), regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'), '<|im_end|>', chr(10)), '' ORDER BY k) AS formatted
  FROM f GROUP BY conv_id
)
SELECT conv_id, cast(n_turns AS bigint) AS n_turns, sha256(turns) AS turns_sha256, cast(length(loss) AS bigint) AS loss_chars,
  sha256(loss) AS loss_sha256, cast(length(formatted) AS bigint) AS formatted_chars, bad IS NULL AND last_role = 'assistant' AS valid,
  cast(CASE WHEN bad IS NULL AND last_role = 'assistant' THEN NULL ELSE coalesce(bad, n_turns) END AS bigint) AS error_turn
FROM g
"""
