"""Chat formatting by prefix-target expansion (DataFrame operations only).

Every assistant turn becomes an example of its own: all turns before it as context, that reply as
the only trainable span. Turns after the last reply end in one more example that trains nothing, so
the output holds every turn. Texts are escaped so that no control string can occur inside them:
a backslash doubles, "#" becomes "\\h" and "<" becomes "\\l"; in roles a line feed becomes "\\n".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, CLOSE = "### ", ":\n", "\n</turn>\n"
TRAINED = "assistant"
_ESCAPES = (("#", "\\h"), ("<", "\\l"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in _ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column, also: tuple = ()) -> Column:
    """Splits at doubled backslashes, so that no code is read across one, and joins with single ones."""

    def codes(part: Column) -> Column:
        for plain, code in (*_ESCAPES, *also):
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), codes), "\\")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def chat_examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, formatted, loss_start, loss_length (code points, from 1) of (conv_id, turn, role, text).

    Defined cases: null roles and texts are empty; a null conv_id is one conversation; a null turn
    sorts first and equal turns sort by role, then text; an empty table gives no example; other
    columns are ignored.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    each = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"), empty("role").alias("role"), empty("text").alias("text"),
            F.concat(F.lit(OPEN), _role(empty("role")), F.lit(MID)).alias("head"), escape(empty("text")).alias("body"),
        ).alias("t"),
    )
    talks = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    spots = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: (F.element_at("ts", i)["role"] == TRAINED) | (i == F.size("ts")))
    spread = talks.select("conv_id", "ts", F.posexplode(spots).alias("example", "upto"))
    whole = lambda ts: F.array_join(F.transform(ts, lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    target = F.element_at("ts", F.col("upto"))
    formed = spread.select("conv_id", "example", "upto", target.alias("target"), whole(F.slice("ts", F.lit(1), F.col("upto") - 1)).alias("context"))
    trained = F.col("target.role") == TRAINED
    return formed.select(
        "conv_id", "example", F.col("upto").alias("n_turns"),
        F.concat("context", "target.head", "target.body", F.lit(CLOSE)).alias("formatted"),
        F.when(trained, F.length("context") + F.length("target.head") + 1).otherwise(F.lit(1)).alias("loss_start"),
        F.when(trained, F.length("target.body")).otherwise(F.lit(0)).alias("loss_length"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs that a formatted example holds."""
    parts = F.filter(F.split(formatted, F.lit(CLOSE)), lambda p: F.length(p) > 0)

    def turn(p: Column) -> Column:
        middle = F.locate(MID, p) if isinstance(p, str) else F.instr(p, MID)
        role = F.substring(p, F.lit(len(OPEN) + 1), middle - len(OPEN) - 1)
        text = F.substring(p, middle + len(MID), F.length(p))
        return F.struct(unescape(role, also=(("\n", "\\n"),)).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, start: Column, length: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.substring(formatted, start, length))


def chat_digest(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted output alone: turns, loss text and sizes with their hashes."""
    read = examples.select(
        "conv_id", "example", "n_turns", "formatted", F.length("formatted").cast("long").alias("chars"),
        read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
    )
    talks = read.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    turns = read_turns(F.col("longest"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.withColumn("turns", turns).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
