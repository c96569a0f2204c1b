"""Conversations as training text: typed content parts, turn marks and a loss mask.

A turn's content is an array of parts.  The visitor ``placeholder`` turns each, in
order, into text: text parts into their escaped text, images, audio and documents into
a placeholder; the attachment's reference and the number of tokens that the
placeholder stands for are recorded beside it.

Template: ``<|start|>role\\n content <|end|>\\n`` for each turn.  Inside texts a
backslash is doubled and ``<|`` becomes ``<\\|`` (in roles a line end becomes
``<\\n``), and ``unescaped`` gives back the text.  Neighbouring text parts are one text
before it is escaped, and parts of other types than ``ATTACHED`` are ``<|unknown|>``, so
neither texts nor types can form a mark, however they are divided.

A null text or role counts as empty.  Turns are ordered by number, then role and
content; repeated rows are turns of their own.  Rows without a conversation id are
conversations of one turn.  A conversation is one record, so it must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|start|>", "<|end|>\n"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
# Fixed sizes: pixels of an image patch, tokens of a second of audio, of a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256
ATTACHED = ("image", "audio", "document")


def text_part(text: Column) -> Column:
    """One text as an array of parts."""
    fields = [F.lit("text").alias("type"), text.cast("string").alias("text")]
    fields += [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(*fields))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def placeholder(part: Column) -> Column:
    """What stands for a part that is no text."""
    kind = F.when(part["type"].isin(*ATTACHED), part["type"]).otherwise(F.lit("unknown"))
    return F.concat(F.lit("<|"), kind, F.lit("|>"))


def visited(parts: Column) -> Column:
    """All parts as one text: runs of text parts are escaped together."""
    def visit(acc: Column, part: Column) -> Column:
        is_text = F.coalesce(part["type"] == "text", F.lit(False))
        text = F.concat(acc["text"], F.coalesce(part["text"], F.lit("")))
        out = F.concat(acc["out"], escaped(acc["text"]), placeholder(part))
        return F.struct(F.when(is_text, acc["out"]).otherwise(out).alias("out"), F.when(is_text, text).otherwise(F.lit("")).alias("text"))

    begin = F.struct(F.lit("").alias("out"), F.lit("").alias("text"))
    return F.aggregate(parts, begin, visit, lambda acc: F.concat(acc["out"], escaped(acc["text"])))


def expanded_tokens(part: Column) -> Column:
    n = F.when(part["type"] == "image", F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH))
    n = n.when(part["type"] == "audio", F.ceil(part["seconds"] * PER_SECOND)).when(part["type"] == "document", part["pages"] * F.lit(PER_PAGE))
    return F.coalesce(n, F.lit(1)).cast("long")


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts",
                 trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation: id, ``formatted``, ``loss`` spans in code points of it, and
    ``attachments`` in order."""
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>"))
    content = visited(parts)
    files = F.transform(F.filter(parts, lambda p: ~F.coalesce(p["type"] == "text", F.lit(False))),
                        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")))
    turn = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), content.alias("content"), files.alias("files"))
    alone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    grouped = messages.select(F.col(conv_col).alias("conv"), alone.alias("alone"), turn.alias("t")).groupBy("conv", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["content"], F.lit(END))), "")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(head(t))
        stop = start + F.char_length(t["content"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct((stop + len(END)).alias("at"), F.when(t["role"].isin(*trained), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
    loss = F.aggregate("turns", begin, step, lambda acc: acc["out"])
    return grouped.select(F.col("conv").alias(conv_col), formatted.alias("formatted"), loss.alias("loss"), F.flatten(F.col("turns.files")).alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """Role and content of each turn, read from the formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")
    line = F.lit("\n")

    def turn(p: Column) -> Column:
        body = F.substring(p, len(START) + 1, 2**31 - 1)
        role = F.substring_index(body, "\n", 1)
        return F.struct(unescaped_role(role).alias("role"), unescaped(F.substr(body, F.char_length(role) + F.char_length(line) + 1)).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(formatted, s["start"] + 1, s["stop"] - s["start"]))), "")
