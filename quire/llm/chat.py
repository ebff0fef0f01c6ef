r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, the turn itself
last, and only its text under the loss mask. A conversation that doesn't end with an assistant turn
also gives one example without a target, so the output holds every turn.

Template of a turn: ``### role:`` newline, the text, ``</turn>`` newline. Inside roles and texts a
backslash is doubled, and a backslash is put into every ``##`` and ``</turn>`` (and before a role's
colons), so control strings never occur there; dropping each backslash that precedes a character
gives the original back. The mask is a span of code points [loss_start, loss_end) of the example.

Turns are ordered by (turn, role, text); repeated rows stay. A null role or text is empty. A row
without a conversation id is a conversation of its own, so such rows never meet in one task (``lone``
tells them apart). A conversation is one training document and must fit one row. DataFrame expressions
only; the one shuffle is by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
ASSISTANT = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(doubled, "#(?=#)", r"#\\"), F.lit("</turn>"), F.lit(r"<\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), F.replace(escape(role), F.lit(":"), F.lit(r"\:")), F.lit(":\n"), escape(text), F.lit(END))


def examples(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, lone (null with an id), example, text, loss_start, loss_end (both null without a target)."""
    own = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = F.sort_array(F.collect_list("own"))
    lone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    conv = rows.select(F.col(conv_col).alias("conv_id"), lone.alias("lone"), own.alias("own")).groupBy("conv_id", "lone").agg(turns.alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct((t["role"] == ASSISTANT).alias("target"), render(t["role"], t["text"]).alias("piece"), F.length(escape(t["text"])).alias("n")))
    conv = conv.select("conv_id", "lone", pieces.alias("p"))
    each = conv.select("conv_id", "lone", "p", F.posexplode("p").alias("example", "last")).where((F.col("last.target")) | (F.col("example") == F.size("p") - 1))
    text = F.array_join(F.transform(F.slice("p", F.lit(1), F.col("example") + 1), lambda x: x["piece"]), "")
    each = each.select("conv_id", "lone", "example", text.alias("text"), F.col("last.target").alias("target"), F.col("last.n").alias("n"))
    stop = F.length("text") - len(END)
    return each.select("conv_id", "lone", "example", "text", F.when(F.col("target"), stop - F.col("n")).alias("loss_start"), F.when(F.col("target"), stop).alias("loss_end"))


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    pieces = F.filter(F.split(text, END), lambda x: x != "")
    # possessive runs: a repeated alternative would take a stack frame for each character of a role
    head = lambda x: F.regexp_extract(x, r"(?s)^### ([^:\\]*+(?:\\.[^:\\]*+)*+):\n", 1)
    return F.transform(pieces, lambda x: F.struct(unescape(head(x)).alias("role"), unescape(F.substr(x, F.length(head(x)) + 7)).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted examples hold, read back from them, per conversation."""
    loss = F.when(F.col("loss_start").isNotNull(), unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    per = formatted.select("conv_id", "lone", "example", "text", loss.alias("loss")).groupBy("conv_id", "lone").agg(
        F.max_by("text", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    per = per.select("conv_id", read_turns(F.col("longest")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long"),
    )
