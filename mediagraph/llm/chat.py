"""Chat formatting with Spark expressions: sort the collected turns, merge neighbours of one role, concatenate, and read back.

A merged turn is <|turn|>ROLE<|says|>TEXT<|and|>TEXT...<|end|> and a line break. Inside roles and texts, a "<" that backslashes and
a "|" follow gets one backslash more, so no control string can come from a text and reading takes the backslash away again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, AND, END = "<|turn|>", "<|says|>", "<|and|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _cut(text: Column, marker: str) -> Column:
    return F.split(text, F.lit("\\Q" + marker + "\\E"), F.lit(-1))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and segments (text, loss) for each conversation; formatted is the segments' texts in order.

    Turns go by their number, equal numbers by role and text, null numbers first. A null role or text is empty; rows without a
    conversation id make one conversation; a repeated row is a turn of its own; an empty table gives an empty table. Other columns
    are not read.
    """
    said = turns.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("said"),
    )
    ordered = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said"))
    # where a merged turn starts, and where the next one does
    starts = F.filter(F.sequence(F.lit(1), F.size("said")), lambda i: (i == 1) | (F.element_at("said", i)["role"] != F.element_at("said", F.greatest(i - 1, F.lit(1)))["role"]))
    runs = ordered.withColumn("starts", starts).withColumn("runs", F.transform("starts", lambda s, k: F.struct(s.alias("start"), (F.coalesce(F.get("starts", k + 1), F.size("said") + 1) - s).alias("len"))))

    def merged(run: Column) -> Column:
        role = F.element_at("said", run["start"])["role"]
        learn = role == learn_role
        texts = F.slice("said", run["start"], run["len"])
        parts = F.flatten(F.transform(texts, lambda t, i: F.array(_segment(F.when(i == 0, F.lit(SAYS)).otherwise(F.lit(AND)), F.lit(False)), _segment(escaped(t["text"]), learn))))
        return F.concat(F.array(_segment(F.concat(F.lit(TURN), escaped(role)), F.lit(False))), parts, F.array(_segment(F.lit(END), F.lit(False))))

    done = runs.select("conv_id", F.flatten(F.transform("runs", merged)).alias("segments"))
    return done.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def parsed(formatted: str | Column) -> Column:
    """The turns (role, text) that a formatted conversation was made from."""
    text = F.col(formatted) if isinstance(formatted, str) else formatted
    blocks = F.filter(_cut(text, TURN), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        halves = _cut(block, SAYS)
        body = F.element_at(halves, 2)
        texts = _cut(F.left(body, F.length(body) - len(END)), AND)
        return F.transform(texts, lambda t: F.struct(unescaped(F.element_at(halves, 1)).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(done: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from their text and loss mask."""
    turns = done.select("conv_id", "formatted", "segments", parsed("formatted").alias("turns"))
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
