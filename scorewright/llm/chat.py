"""Chat formatting with a grammar round trip, in expressions only.

A turn is written as ``<s>[INST] role [/INST]text</s>``.  The parser is
deterministic: it cuts at ``</s>``, takes the role between the header marks,
refuses a role or text with another mark, and removes the backslash before any
character.  Each turn is first written as it is and read again; if the result
is not the source, its backslashes are doubled and a backslash is put into
each mark in it, and it is read again.  A conversation is accepted only if
reading all of it gives back its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewright.llm.rows import named

OPEN, MIDDLE, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: Role whose texts are learned from.
LEARNED = "assistant"


def escape(value: Column) -> Column:
    """Doubled backslashes, and a backslash after the first character of a mark."""
    doubled = F.regexp_replace(value, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"([<\[])(/?(?:s>|INST\]))", r"$1\\$2")


def unescape(value: Column) -> Column:
    return F.regexp_replace(value, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns of a formatted string as array<struct<role, text>>; an element is
    null where the grammar is broken, and the array has a null at its end if
    the string does not end with a closed turn."""
    cut = F.split(formatted, CLOSE, -1)

    def turn(part: Column) -> Column:
        rest = F.substr(part, F.lit(len(OPEN) + 1))
        at = F.locate(MIDDLE, rest)
        role = F.substr(rest, F.lit(1), at - 1)
        text = F.substr(rest, at + len(MIDDLE))
        marked = F.concat(role, F.lit("\n"), text).rlike(r"<s>|\[/?INST\]")
        good = part.startswith(OPEN) & (at > 0) & ~marked
        return F.when(good, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    turns = F.transform(F.slice(cut, F.lit(1), F.size(cut) - 1), turn)
    open_end = F.element_at(cut, -1) != ""
    return F.when(open_end, F.concat(turns, F.array(F.lit(None).cast("struct<role:string,text:string>")))).otherwise(turns)


def format_conversations(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learned: str = LEARNED,
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss`` where ``loss`` is
    the array of [start, end) code points of the learned texts in ``formatted``.

    Turns stand by number, ties by role and text; null roles and texts are
    empty; repeated rows are turns of their own; rows without an id form one
    conversation.  An empty table gives an empty result.  Raises if a turn
    cannot be read back, which the grammar rules out.
    """
    none = F.lit("")
    rows = conversations.select(
        named(id_col).alias("conv_id"),
        named(turn_col).alias("turn"),
        F.coalesce(named(role_col).cast("string"), none).alias("role"),
        F.coalesce(named(text_col).cast("string"), none).alias("text"),
    )
    source = F.array(F.struct("role", "text"))
    rows = rows.withColumn("plain", render(F.col("role"), F.col("text")))
    rows = rows.withColumn("same", F.coalesce(parse(F.col("plain")) == source, F.lit(False)))
    for c in ("role", "text"):
        rows = rows.withColumn(f"safe_{c}", F.when(F.col("same"), F.col(c)).otherwise(escape(F.col(c))))
    rows = rows.withColumn("written", render(F.col("safe_role"), F.col("safe_text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum(F.length("written").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"at": F.coalesce(before, F.lit(0)), "k": F.row_number().over(order)})
    head = F.length("safe_role") + len(OPEN) + len(MIDDLE)
    span = F.struct((F.col("at") + head).alias("start"), (F.col("at") + head + F.length("safe_text")).alias("end"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "role", "text", "written", F.when(F.col("role") == learned, span).alias("span")))).alias("turns"))
    made = turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    same = F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back")))
    return made.select("conv_id", checked.alias("formatted"), "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold: ``conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars``."""
    turns = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    parts = F.transform("loss", lambda s: F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    rows = formatted.withColumns({"_turns": turns, "_loss": F.array_join(F.transform(parts, unescape), "")})
    return rows.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("_turns", ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
