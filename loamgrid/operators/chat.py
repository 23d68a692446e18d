"""Conversation history: titles, summaries, repeated assistant messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.text import truncate

WINDOW = 10


def conversation_title(conv: DataFrame) -> DataFrame:
    """First user turn with text, cut to 22 characters."""
    said = (F.col("role") == "user") & (F.trim("text") != "")
    first = F.min_by(truncate(F.col("text"), 22), F.when(said, F.col("turn")))
    return conv.groupBy("conv_id").agg(F.coalesce(first, F.lit("新对话")).alias("title"))


def conversation_summary(conv: DataFrame) -> DataFrame:
    """Last user and last assistant text."""
    last = lambda role, n: F.max_by(truncate(F.col("text"), n), F.when((F.col("role") == role) & (F.col("text") != ""), F.col("turn")))
    return conv.groupBy("conv_id").agg(last("user", 28).alias("user_tail"), last("assistant", 40).alias("assistant_tail"))


def dedupe_recent(conv: DataFrame, by: str, order: str, window: int = WINDOW, span: int = 4096) -> DataFrame:
    """Drops an assistant message equal to one among the last ten *kept* messages.

    The rule depends on what was kept before, so messages are walked in order; but after ten
    messages in a row that are kept for certain (not from the assistant, or the first of their
    text in the conversation) nothing older matters. Conversations are cut at such places, and
    every piece is walked on its own with these ten as context, so a conversation that holds a
    large share of all rows spreads over many tasks. Cuts are found in ranges of ``span`` turns;
    only keys and text hashes enter the walk, which streams sorted batches.
    """
    norm = F.trim(F.regexp_replace("text", r"\s+", " "))
    lean = conv.select(by, F.col(order).alias("o"), F.when((F.col("role") == "assistant") & (norm != ""), F.md5(norm)).alias("h"))
    seen = lean.filter(F.col("h").isNotNull()).groupBy(by, "h").agg(F.min("o").alias("o1"))
    d = lean.join(seen, [by, "h"], "left").withColumn("sure", (F.col("h").isNull() | (F.col("o") == F.col("o1"))).cast("int"))
    d = d.withColumn("c", F.floor(F.col("o") / span)).drop("o1")
    w = Window.partitionBy(by, "c").orderBy("o")
    d = d.withColumn("cut", (F.sum("sure").over(w.rowsBetween(1 - window, 0)) == window).cast("int"))
    # Piece number: cuts before this message, inside its range and in the ranges before.
    per = d.groupBy(by, "c").agg(F.sum("cut").alias("k"))
    per = per.withColumn("off", F.coalesce(F.sum("k").over(Window.partitionBy(by).orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    inside = F.coalesce(F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.withColumn("cuts", inside).join(per, [by, "c"]).withColumn("piece", F.col("cuts") + F.col("off"))
    # The ten messages that end at a cut are the context of the next piece.
    lastten = F.collect_list(F.struct("o", "h")).over(w.rowsBetween(1 - window, 0))
    ctx = d.withColumn("ten", lastten).filter("cut = 1").select(by, (F.col("piece") + 1).alias("piece"), F.inline("ten")).withColumn("ctx", F.lit(True))
    rows = d.select(by, "piece", "o", "h", F.lit(False).alias("ctx")).unionByName(ctx)
    ordered = rows.repartition(by, "piece").sortWithinPartitions(by, "piece", "o")

    def walk(batches):
        current, kept = None, []
        for pdf in batches:
            ok = []
            for k, p, h, c in zip(pdf[by].to_numpy(), pdf["piece"].to_numpy(), pdf["h"].to_numpy(), pdf["ctx"].to_numpy()):
                if (k, p) != current:
                    current, kept = (k, p), []
                drop = not c and h is not None and h in kept
                ok.append(not drop and not c)
                if not drop:
                    kept = (kept + [h])[-window:]
            yield pdf.loc[ok, [by, "o"]].rename(columns={"o": order})

    t = dict(conv.dtypes)
    keep = ordered.mapInPandas(walk, f"{by} {t[by]}, {order} {t[order]}")
    return conv.join(keep, [by, order], "left_semi")
