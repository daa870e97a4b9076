"""Chat formatting: prefix-target expansion of conversations, in DataFrame functions only.

Each assistant turn becomes an example of its own: all turns before it are context, and only that reply is trained on.
A turn reads ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Control strings inside a text or role get one more backslash
after their ``<`` (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|``), so no text can open or close a turn, all other
texts stay as they are, and taking one backslash away restores every text exactly.

Cases: a null text or role is empty; turns with equal numbers are ordered by role, then text; null turns come first;
repeated rows stay; a null conversation id is a conversation like any other. Turns after the last assistant turn form
one example without a trained part, so that nothing of a conversation is lost. A conversation is one string in the
format, so its turns meet in one row; conversations are spread over all partitions by their id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role stands on one line, so line ends in it are escaped as well."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def expand(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """conversations (conv_id, turn, role, text) -> one row an example: conv_id, example, text, loss_start, loss_end.

    text is the whole formatted example; the characters from loss_start to before loss_end are trained on (none where
    they are equal). The examples of a conversation are numbered from 0.
    """
    own, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", F.struct(F.col("turn"), own.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    turns = turns.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == role).alias("trained"),
        F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
    )
    last = F.size("trained") - 1
    ends = F.filter(F.transform("trained", lambda t, i: F.when(t | (i == last), i)), lambda i: i.isNotNull())
    examples = turns.select("*", F.posexplode(ends).alias("example", "at"))
    before = F.array_join(F.transform(F.slice("heads", 1, F.col("at")), lambda h, i: F.concat(h, F.get("bodies", i), F.lit(END + "\n"))), "")
    examples = examples.select("conv_id", "example", F.get("trained", F.col("at")).alias("target"), F.concat(before, F.get("heads", F.col("at"))).alias("context"), F.get("bodies", F.col("at")).alias("reply"))
    start = F.when(F.col("target"), F.length("context")).otherwise(0)
    return examples.select(
        "conv_id",
        "example",
        F.concat("context", "reply", F.lit(END + "\n")).alias("text"),
        start.alias("loss_start"),
        F.when(F.col("target"), F.length("context") + F.length("reply")).otherwise(0).alias("loss_end"),
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted text, as array<struct<role, text>>."""
    pieces = F.slice(F.split(text, r"\Q" + START + r"\E"), 2, 1 << 30)
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(pieces, lambda p: F.struct(unescape_role(head(p)).alias("role"), unescape(F.substr(p, F.length(head(p)) + 2, F.length(p) - F.length(head(p)) - len(END) - 2)).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation say when they are read back: the columns of the query op2."""
    loss = unescape(F.substr("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    rows = examples.select("conv_id", "example", "text", loss.alias("loss"))
    rows = rows.groupBy("conv_id").agg(F.max_by("text", "example").alias("whole"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum(F.length("text")).alias("formatted_chars"), F.count("*").alias("n_examples"))
    rows = rows.select("conv_id", read_back(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"), "formatted_chars", "n_examples")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
