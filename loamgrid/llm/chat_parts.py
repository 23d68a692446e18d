"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds an ordered list of parts: text, image, audio or document. The flattening visitor turns text parts into
escaped text and all others into placeholders; it records each attachment (kind, reference, position) and the number
of tokens its placeholder stands for. Turns are then wrapped by the template and joined to one text per conversation.

Template: ``<s>[INST] user [/INST]</s>``, ``<s>[OUT] assistant [/OUT]</s>``, ``<s>[ROLE]other[/ROLE] text [/OUT]</s>``.
Control strings inside texts and role names get a ``~`` after their bracket (``[INST]`` -> ``[~INST]``, ``[~INST]`` ->
``[~~INST]``), so escaping is reversible and no text can open or close a turn.

Parts of one message are joined by a line feed, which no control string holds.

Defined cases: null text is empty; a null role is written as an empty role; null parts are skipped; unknown kinds are
treated as documents; messages are ordered by turn, then role, then text, null turns first; repeated rows stay.
One conversation becomes one row, so its size is that of one output value; no other group is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: All control strings of the template, without their opening bracket.
CONTROLS = ("/s>", "s>", "/INST]", "INST]", "/OUT]", "OUT]", "/ROLE]", "ROLE]", "|image|>", "|audio|>", "|document|>")
_TAIL = "(" + "|".join(c.replace("|", "\\|").replace("]", "\\]") for c in CONTROLS) + ")"
PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens: one per square of so many pixels, per second of sound, per page.
IMAGE_CELL, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])(~*)" + _TAIL, "$1~$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[])~(~*)" + _TAIL, "$1$2$3")


def text_part(c: Column) -> Column:
    """A single text part in the typed form."""
    fields = {"kind": F.lit("text"), "text": F.coalesce(c, F.lit("")), "ref": F.lit(None).cast("string"), "width": F.lit(None).cast("int"), "height": F.lit(None).cast("int"), "seconds": F.lit(None).cast("double"), "pages": F.lit(None).cast("int")}
    return F.array(F.struct(*(v.alias(k) for k, v in fields.items())))


def _kind(p: Column) -> Column:
    return F.when(p["kind"].isin("text", "image", "audio"), p["kind"]).otherwise("document")


def part_tokens(p: Column) -> Column:
    """Tokens that an attachment's placeholder expands to; null for text."""
    cells = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) / IMAGE_CELL)
    return (
        F.when(p["kind"] == "image", cells(p["width"]) * cells(p["height"]))
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["kind"] == "text", F.lit(None))
        .otherwise(F.coalesce(p["pages"], F.lit(1)) * PAGE_TOKENS)
        .cast("long")
    )


def flatten_parts(parts: Column) -> dict[str, Column]:
    """``content`` with placeholders, ``attachments`` in order, ``expanded_tokens`` of all placeholders."""
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    content = F.array_join(F.transform(parts, lambda p: F.when(p["kind"] == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), _kind(p), F.lit("|>")))), "\n")
    media = F.filter(parts, lambda p: F.coalesce(p["kind"] != "text", F.lit(True)))
    attachments = F.transform(media, lambda p, i: F.struct(i.cast("int").alias("ordinal"), _kind(p).alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    return {"content": content, "attachments": attachments, "expanded_tokens": F.coalesce(F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["tokens"], F.lit(0))), F.lit(0))}


def format_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_spans`` (start, length in code points of assistant texts),
    ``attachments`` (with message position), ``expanded_tokens``."""
    flat = flatten_parts(F.col(parts))
    r = F.coalesce(F.col(role).cast("string"), F.lit(""))
    head = F.when(r == "user", "<s>[INST] ").when(r == "assistant", "<s>[OUT] ").otherwise(F.concat(F.lit("<s>[ROLE]"), escape(r), F.lit("[/ROLE] ")))
    tail = F.when(r == "user", " [/INST]</s>").otherwise(" [/OUT]</s>")
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), head.alias("head"), tail.alias("tail"), *(c.alias(k) for k, c in flat.items()))
    rows = rows.withColumn("piece", F.concat("head", "content", "tail"))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = F.coalesce(F.sum(F.char_length("piece").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("start", before + F.char_length("head"))
    item = F.struct("place", "piece", F.when(F.col("role") == "assistant", F.struct("start", F.char_length("content").cast("long").alias("length"))).alias("span"), "attachments")
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("m"), F.sum("expanded_tokens").alias("expanded_tokens"))
    return got.select(
        "conv_id",
        F.array_join(F.transform("m", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("m", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
        F.flatten(F.transform("m", lambda x: F.transform(x["attachments"], lambda a: F.struct(x["place"].alias("message"), a["ordinal"].alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        "expanded_tokens",
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, content) read back from a formatted conversation, both unescaped."""
    raw = F.filter(F.split(formatted, "</s>"), lambda t: t != "")
    other = lambda t: t.startswith("<s>[ROLE]")
    role = lambda t: F.when(t.startswith("<s>[INST]"), "user").when(other(t), unescape(F.regexp_extract(t, r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\]", 1))).otherwise("assistant")
    body = lambda t: unescape(F.regexp_extract(t, r"(?s)^<s>(?:\[INST\]|\[OUT\]|\[ROLE\].*?\[/ROLE\]) (.*) \[/(?:INST|OUT)\]$", 1))
    return F.transform(raw, lambda t: F.struct(role(t).alias("role"), body(t).alias("content")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """Array of the texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
