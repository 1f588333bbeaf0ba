"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; neighbours of the same role share one block. Each
turn looks at its neighbours by index, and the spans of the mask are summed up in blocks of SPANS turns, so that the
work is in proportion to the turns. Template:

    <|im_start|>ROLE\\nTEXT<|im_turn|>TEXT<|im_end|>\\n<|im_start|>ROLE\\n...

Inside roles and texts `&` becomes `&amp;` and `<|` becomes `&lt;|`, so that no control string can occur there
and the inverse is exact (and in roles a line feed becomes `&#10;`).

The loss mask has a span for each assistant text, in bytes of the UTF-8 form, so that a span is cut out
without walking over the characters before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Turns whose spans are gathered in one list.
SPANS = 256
START, TURN, END = "<|im_start|>", "<|im_turn|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def format_chats(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant"
) -> DataFrame:
    """One row for each conversation: (conv_col, formatted, loss_mask array<struct<start, bytes>>).

    Turns are sorted by turn, then role, then text, so ties and repeated rows have one order; all rows count. Null
    texts and roles are empty strings; a null turn sorts first; a null conversation is a conversation of its own.
    An empty table gives an empty result. A conversation's text is one value, so it has to fit in a row.
    """
    empty = F.lit("")
    turn = F.struct(
        F.col(turn_col).alias("t"),
        _escape_role(F.coalesce(F.col(role_col), empty)).alias("r"),
        escape(F.coalesce(F.col(text_col), empty)).alias("x"),
        (F.col(role_col).eqNullSafe(F.lit(learn))).alias("learn"),
    )
    chats = rows.groupBy(F.col(conv_col).alias(conv_col)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    last = F.size("turns") - 1

    def role_at(i: Column) -> Column:
        return F.get(F.col("turns"), i)["r"]

    def pieces(x: Column, i: Column) -> Column:
        opens = (i == 0) | (role_at(i - 1) != x["r"])
        closes = (i == last) | (role_at(i + 1) != x["r"])
        return F.struct(
            F.when(opens, F.concat(F.lit(START), x["r"], F.lit("\n"))).otherwise(F.lit(TURN)).alias("head"),
            x["x"].alias("x"),
            F.when(closes, F.lit(END + "\n")).otherwise(empty).alias("tail"),
            x["learn"].alias("learn"),
        )

    chats = chats.select(conv_col, F.transform("turns", pieces).alias("pieces"))
    size = lambda p: (F.octet_length(p["head"]) + F.octet_length(p["x"]) + F.octet_length(p["tail"])).cast("long")
    zero = F.lit(0).cast("long")
    last_block = F.greatest(F.ceil(F.size("pieces") / SPANS).cast("int") - 1, F.lit(0))
    chats = chats.withColumn("blocks", F.transform(F.sequence(F.lit(0), last_block), lambda i: F.slice(F.col("pieces"), i * SPANS + 1, F.lit(SPANS))))

    def begin(acc: Column, block: Column) -> Column:
        length = F.aggregate(block, zero, lambda n, p: n + size(p))
        return F.struct((acc["at"] + length).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts"))

    nothing = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate("blocks", nothing, begin, lambda acc: acc["starts"])

    def add(acc: Column, p: Column) -> Column:
        start = (acc["at"] + F.octet_length(p["head"])).cast("long")
        span = F.struct(start.alias("start"), F.octet_length(p["x"]).cast("long").alias("bytes"))
        return F.struct((acc["at"] + size(p)).alias("at"), F.when(p["learn"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def spans(z: Column) -> Column:
        start = F.struct(z["start"].alias("at"), F.array().cast("array<struct<start:bigint,bytes:bigint>>").alias("spans"))
        return F.aggregate(z["block"], start, add, lambda acc: acc["spans"])

    return chats.select(
        conv_col,
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["x"], p["tail"])), "").alias("formatted"),
        F.flatten(F.transform(F.arrays_zip(F.col("blocks").alias("block"), starts.alias("start")), spans)).alias("loss_mask"),
    )


def read_chats(chats: DataFrame, conv_col: str = "conv_id", *more: Column) -> DataFrame:
    """The inverse: (conv_col, turns array<struct<role, text>>, loss array<string>, *more), read from the formatted text and its mask."""
    lit = lambda s: "\\Q" + s + "\\E"
    blocks = F.slice(F.split("formatted", lit(START)), 2, F.greatest(F.size(F.split("formatted", lit(START))) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.char_length(role) + 2)
        body = F.substr(body, F.lit(1), F.char_length(body) - len(END) - 1)
        return F.transform(F.split(body, lit(TURN)), lambda x: F.struct(_unescape_role(role).alias("role"), unescape(x).alias("text")))

    raw = F.col("formatted").cast("binary")
    return chats.select(
        conv_col,
        F.flatten(F.transform(blocks, turns)).alias("turns"),
        F.transform("loss_mask", lambda s: unescape(F.substr(raw, (s["start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))).alias("loss"),
        *more,
    )
