"""Conversations as text with turn marks, and back.

Grammar of the formatted text, without anything between the turns:

    turn  := open "\\n" content "\\n" close "\\n"
    open  := "[SYS]" | "[INST]" | "<s>" | "[TURN " hex digits of the role "]"
    close := "[/SYS]" | "[/INST]" | "</s>" | "[/TURN]"        (that of the same turn)

The content holds no control string (an open or close mark) that is not escaped: a backslash before it, or one more if
there are some already. Reading takes away one backslash before each control string. A turn is rendered as it is; if
the parser does not give back the same turn, its content is escaped, after which it always does, since the line break
keeps the backslashes of a content away from the closing mark.

All columns are computed by Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The marks of the template.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER_OPEN, OTHER_CLOSE = "[TURN ", "[/TURN]"

CONTROL = r"\[/?(?:SYS|INST)\]|</?s>|\[TURN [0-9A-F]*\]|\[/TURN\]"
OPEN = r"\[SYS\]|\[INST\]|<s>|\[TURN [0-9A-F]*\]"
CLOSE = r"\[/SYS\]|\[/INST\]|</s>|\[/TURN\]"
# One turn at the place where the one before it ended; the content ends at the first closing mark on its own line.
TURN = rf"\G({OPEN})\n(?s:(.*?))\n({CLOSE})\n"


def escape(text: Column) -> Column:
    """One more backslash before each control string; where in a run of backslashes it is added makes no difference."""
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def _bare(text: Column) -> Column:
    """Whether a control string without a backslash is left in a content."""
    return text.rlike(rf"(?<!\\)(?:{CONTROL})")


def _by_role(role: Column, side: int) -> Column:
    other = F.concat(F.lit(OTHER_OPEN), F.hex(role), F.lit("]")) if side == 0 else F.lit(OTHER_CLOSE)
    found = other
    for name, marks in MARKS.items():
        found = F.when(role == name, F.lit(marks[side])).otherwise(found)
    return found


def render(role: Column, content: Column) -> Column:
    """One turn of the grammar."""
    lf = F.lit("\n")
    return F.concat(_by_role(role, 0), lf, content, lf, _by_role(role, 1), lf)


def _role_of(mark: Column) -> Column:
    found = F.decode(F.unhex(F.regexp_extract(mark, r"\[TURN ([0-9A-F]*)\]", 1)), "UTF-8")
    for name, marks in MARKS.items():
        found = F.when(mark == marks[0], F.lit(name)).otherwise(found)
    return found


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text, ok>>.

    `ok` tells that the turn follows the grammar: it is closed by its own mark and holds no bare control string.
    Text that is no turn ends the array; `whole` tells whether there was any.
    """
    pattern = F.lit(TURN)
    parts = F.arrays_zip(
        F.regexp_extract_all(formatted, pattern, F.lit(1)).alias("open"),
        F.regexp_extract_all(formatted, pattern, F.lit(2)).alias("content"),
        F.regexp_extract_all(formatted, pattern, F.lit(3)).alias("close"),
    )
    def turn(part: Column) -> Column:
        role = _role_of(part["open"])
        ok = (_by_role(role, 1) == part["close"]) & (_by_role(role, 0) == part["open"]) & ~_bare(part["content"])
        return F.struct(role.alias("role"), unescape(part["content"]).alias("text"), ok.alias("ok"))
    return F.transform(parts, turn)


def whole(formatted: Column) -> Column:
    """Whether the grammar covers a formatted text to its end."""
    return F.regexp_replace(formatted, TURN, "") == ""


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: `conv`, `formatted`, `loss_spans`, `n_escaped`, and the source turns in order.

    `loss_spans` holds the place and length (in code points) of each assistant's content within `formatted`.
    `source` is array<struct<role, text>>. Turns are ordered by `turn` (nulls first), equal ones by role and text, so
    repeated rows stay repeated turns. Null texts and roles count as empty; each row without a conversation id is a
    conversation of its own, with a null id. A conversation is one string, so it must fit into a row; its turns are
    gathered once. Other columns of the input play no part.
    """
    rows = turns.select(
        F.col(conv).alias("_conv"),
        F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("_alone"),
        F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    plain = render(F.col("_role"), F.col("_text"))
    read = parse(plain)
    same = (
        whole(plain)
        & (F.size(read) == 1)
        & (F.get(read, F.lit(0))["role"] == F.col("_role"))
        & (F.get(read, F.lit(0))["text"] == F.col("_text"))
        & F.get(read, F.lit(0))["ok"]
    )
    # Without a control string or an escaped one there is nothing that the parser could take otherwise.
    calm = ~F.col("_text").rlike(CONTROL)
    rows = rows.withColumn("_content", F.when(calm | F.coalesce(same, F.lit(False)), F.col("_text")).otherwise(escape(F.col("_text"))))
    rows = rows.withColumn("_turn_text", render(F.col("_role"), F.col("_content")))
    order = Window.partitionBy("_conv", "_alone").orderBy("_turn", "_role", "_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum(F.length("_turn_text")).over(order), F.lit(0)))
    rows = rows.withColumn("_start", F.col("_start") + F.length(_by_role(F.col("_role"), 0)) + 1)
    item = F.struct(
        "_turn", F.col("_role").alias("role"), F.col("_text").alias("text"), F.col("_turn_text").alias("part"),
        F.col("_start").alias("start"), F.length("_content").cast("bigint").alias("length"),
        (F.col("_content") != F.col("_text")).alias("escaped"),
    )
    found = rows.groupBy("_conv", "_alone").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    spoken = F.filter("_items", lambda i: i["role"] == "assistant")
    return found.select(
        F.col("_conv").alias(conv),
        F.array_join(F.transform("_items", lambda i: i["part"]), "").alias("formatted"),
        F.transform(spoken, lambda i: F.struct(i["start"].alias("start"), i["length"].alias("length"))).alias("loss_spans"),
        F.size(F.filter("_items", lambda i: i["escaped"])).alias("n_escaped"),
        F.transform("_items", lambda i: F.struct(i["role"].alias("role"), i["text"].alias("text"))).alias("source"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the formatted text gives back: `turns`, `loss_text`, and `round_trip` (equal to the source)."""
    turns = parse(F.col("formatted"))
    spans = F.transform(
        "loss_spans", lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))
    )
    read = formatted.withColumn("turns", turns).withColumn(
        "loss_text", F.array_join(F.transform(spans, unescape), "")
    )
    pairs = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    exact = (pairs == F.col("source")) & F.forall("turns", lambda t: t["ok"]) & whole(F.col("formatted"))
    return read.withColumn("round_trip", exact)
