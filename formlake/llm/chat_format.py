"""Chat formatting with DataFrame expressions only.

The turns of a conversation are collected as structs and sorted, neighbours of
the same role are merged into one block, and blocks are concatenated:

    ### role: text</turn>\\n
    ### role: first text<turn/>second text</turn>\\n

Inside roles and texts a backslash is doubled, and one is put behind every
``#`` before another ``#``, every ``<`` that begins a mark, and (in roles) every
colon before a blank; so no mark occurs inside a text, and removing the
backslashes restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEAD, _JOIN, _END = "### ", "<turn/>", "</turn>\n"


def _escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(c, r"#(?=#)|<(?=/turn>|turn/>)", r"$0\\")


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: (conv, formatted, loss_spans array<struct<start, length>>).

    ``loss_spans`` are 0-based code point ranges of ``formatted`` that hold the
    escaped texts of the role ``learn``. Turns sort by (turn, role, text), so
    ties and repeated rows have one order; a null turn comes first; null roles
    and texts are empty; rows without a conversation id form one conversation
    with a null id; an empty table gives an empty result; other columns are
    ignored. A conversation is one row of the result and so must fit in one.
    """
    said = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    talks = turns.groupBy(F.col(conv).alias("conv")).agg(F.array_sort(F.collect_list(said)).alias("t"))
    start = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.get("t", i - 1)["role"] != F.get("t", F.greatest(i - 2, F.lit(0)))["role"]))
    talks = talks.withColumn("s", start)
    stop = lambda k: F.coalesce(F.get("s", k + 1), F.size("t") + 1)
    block = lambda i, k: F.struct(F.get("t", i - 1)["role"].alias("role"), F.transform(F.slice("t", i, stop(k) - i), lambda x: x["text"]).alias("texts"))
    talks = talks.select("conv", F.transform("s", block).alias("b"))

    def pieces(b: Column) -> Column:
        head = F.concat(F.lit(_HEAD), F.regexp_replace(_escape(b["role"]), ":(?= )", r":\\"), F.lit(": "))
        return F.transform(b["texts"], lambda x, i: F.struct(F.when(i == 0, head).otherwise(_JOIN).alias("head"), _escape(x).alias("body"), F.when(i == F.size(b["texts"]) - 1, _END).otherwise("").alias("tail"), (b["role"] == learn).alias("learn")))

    talks = talks.select("conv", F.flatten(F.transform("b", pieces)).alias("p"))
    none = F.array().cast("array<struct<start:int,length:int>>")

    def span(acc: Column, p: Column) -> Column:
        at, n = acc["at"] + F.length(p["head"]), F.length(p["body"])
        one = F.array(F.struct(at.alias("start"), n.alias("length")))
        return F.struct((at + n + F.length(p["tail"])).alias("at"), F.when(p["learn"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("p", F.struct(F.lit(0).alias("at"), none.alias("spans")), span, lambda acc: acc["spans"])
    formatted = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return talks.select(F.col("conv").alias(conv), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: str = "formatted") -> Column:
    """Array of struct<role, text>: the turns that a formatted text was made of."""
    blocks = F.split(F.col(formatted), "</turn>\n")

    def turns(b: Column) -> Column:
        cut = F.instr(b, ": ")
        role = _unescape(F.substr(b, F.lit(len(_HEAD) + 1), cut - len(_HEAD) - 1))
        return F.transform(F.split(F.substr(b, cut + 2), _JOIN), lambda x: F.struct(role.alias("role"), _unescape(x).alias("text")))

    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turns))


def read_loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: _unescape(F.substr(F.col(formatted), s["start"] + 1, s["length"]))), "")
