"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes one example: the turns before it and its own header are context,
only its text is trainable. Turns after the last assistant turn are kept in one example without
a target, so that the output holds each whole conversation. A turn reads
``<s>role<newline>text</s>``; inside roles and texts a backslash, ``<`` and ``[`` (and a newline
in a role) are written as backslash codes, so no control string can occur in them and the
original comes back exactly.

A conversation is the unit of the output and lies in one task, as its context does by
definition; conversations are dealt out by ``conv_id`` once, and the expansion and the reading
back need no second shuffle.

Defined results: null text or role reads as empty; rows that repeat are turns of their own, in
the order (turn, role, text); rows with null conv_id form one conversation; an empty table gives
no rows; very long texts are formatted whole; extra columns are ignored; a conversation without an assistant turn has no loss text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"


def escape(text: Column, role: bool = False) -> Column:
    """Backslash codes for the characters that control strings begin with."""
    for plain, code in (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"), *([("\n", "\\n")] if role else [])):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("\n", "\\n"), ("[", "\\s"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def expand(conversations: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, example_no, formatted, target_start and target_end (code points, end excluded) of each example."""
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"], True), F.lit("\n")))
    pieces = whole.select(
        "conv_id",
        heads.alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
        F.filter(F.sequence(F.lit(0), F.size("turns")), lambda i: F.when(i < F.size("turns"), F.get("turns", i)["role"] == role).otherwise(F.element_at("turns", -1)["role"] != role)).alias("at"),
    )
    each = pieces.select("conv_id", "heads", "bodies", F.posexplode("at").alias("example_no", "at"))
    before = F.array_join(F.zip_with(F.slice("heads", F.lit(1), F.col("at")), F.slice("bodies", F.lit(1), F.col("at")), lambda h, b: F.concat(h, b, F.lit(CLOSE))), "")
    each = each.select(
        "conv_id",
        "example_no",
        F.concat(before, F.coalesce(F.get("heads", F.col("at")), F.lit(""))).alias("context"),
        F.coalesce(F.get("bodies", F.col("at")), F.lit("")).alias("target"),
        (F.col("at") < F.size("bodies")).alias("trainable"),
    )
    return each.select(
        "conv_id",
        "example_no",
        F.concat("context", "target", F.when(F.col("trainable"), CLOSE).otherwise("")).alias("formatted"),
        F.char_length("context").alias("target_start"),
        F.char_length(F.concat("context", "target")).alias("target_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """The turns and the trainable text of each conversation, from the formatted examples alone."""
    target = F.substring("formatted", F.col("target_start") + 1, F.col("target_end") - F.col("target_start"))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "example_no").alias("formatted"),
        F.sort_array(F.collect_list(F.struct("example_no", target.alias("target")))).alias("targets"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns = F.filter(F.split("formatted", OPEN), lambda x: x != "")
    split = whole.select("*", F.transform(turns, lambda x: F.struct(unescape(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substring_index(F.substr(x, F.locate("\n", x) + 1), CLOSE, 1)).alias("text"))).alias("turns"))
    return split.select("conv_id", "turns", F.array_join(F.transform("targets", lambda t: unescape(t["target"])), "").alias("loss_text"), "formatted_chars", "n_examples")


def digests(conversations: DataFrame) -> DataFrame:
    """The contract's row per conversation, read back from the examples."""
    back = read_back(expand(conversations))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
