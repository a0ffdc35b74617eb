"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role form one message; messages are
concatenated by template.  Control strings inside roles and texts are escaped reversibly: ``%`` becomes ``%25`` and the
first character of each control string its code.  The loss mask comes as segments, which joined are the formatted text.
A conversation becomes one string, so its turns have to meet in one task; Spark collects them in each task before the
shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

OPEN, NEXT, CLOSE = "<|im_start|>", "<|im_next|>", "<|im_end|>"
# Control strings of common chat templates.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
CODES = {"<": "%3C", "[": "%5B"}


def replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return reduce(lambda x, c: replace(x, c, CODES[c[0]] + c[1:]), CONTROLS, replace(text, "%", "%25"))


def unescape(text: Column) -> Column:
    return replace(reduce(lambda x, c: replace(x, CODES[c], c), CODES, text), "%25", "%")


def format_chats(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """conv_id, messages (role, texts), formatted and segments (text, loss), one row per conversation.

    Turns are ordered by turn, then role and text; repeated rows are turns of their own.  Null roles and texts are
    empty; null turn numbers come first; null ids form one conversation.  Other columns are ignored; an empty table
    gives no rows.  Segments with loss hold each text of role ``learn``, escaped, and nothing else.
    """
    empty = F.lit("")
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    new = lambda ts, i: F.coalesce(F.get(ts, i - 1)["role"] != F.get(ts, i)["role"], F.lit(True))

    def merged(ts: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: new(ts, i))
        return let(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.get(ts, at)["role"].alias("role"), F.transform(F.slice(ts, at + 1, F.coalesce(F.get(s, k + 1), F.size(ts)) - at), lambda t: t["text"]).alias("texts"))))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def cut(message: Column) -> Column:
        head = F.concat(F.lit(OPEN), replace(escape(message["role"]), "\n", "%0A"), F.lit("\n"))
        inner = F.flatten(F.transform(message["texts"], lambda t, k: F.array(segment(F.when(k == 0, head).otherwise(F.lit(NEXT)), F.lit(False)), segment(escape(t), message["role"] == learn))))
        return F.concat(inner, F.array(segment(F.lit(CLOSE + "\n"), F.lit(False))))

    messages = sorted_turns.select("conv_id", let(F.col("turns"), merged).alias("messages"))
    out = messages.select("conv_id", "messages", F.flatten(F.transform("messages", cut)).alias("segments"))
    return out.select("conv_id", "messages", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text was made of."""
    messages = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda m: m != "")

    def turns(m: Column) -> Column:
        head = F.substring_index(m, "\n", 1)
        role = unescape(replace(F.substring(head, len(OPEN) + 1, 1 << 30), "%0A", "\n"))
        texts = F.split(F.substring(m, F.length(head) + 2, F.lit(1 << 30)), r"<\|im_next\|>")
        return let(role, lambda r: F.transform(texts, lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    return F.flatten(F.transform(messages, turns))


def learned(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
