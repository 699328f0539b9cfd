"""Multi-party dialogues from the view of each speaker. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, text_of

# fixed values: the turn markers
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTEXT = ("system",)
UNKNOWN = "unknown"
BLOCK_TURNS = 64


def _safe(text: Column) -> Column:
    """Markers inside a text can't open or close a turn."""
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", speaker_col: str = "role", text_col: str = "text", context: tuple[str, ...] = CONTEXT,
) -> DataFrame:
    """One row per perspective and turn: ``conv_id, perspective, at, speaker, head, segment, learn``.

    Every speaker of a dialogue outside ``context`` gives a perspective, in which it is the assistant and the others are
    users with their names; turns of ``context`` speakers keep their role in every perspective. ``learn`` marks the
    assistant's turns; of these the text and the closing marker are learnt, the head is not. ``at`` numbers the turns of
    a dialogue from 0, by turn (null first), speaker and text. A null or empty speaker is called "unknown", a null text is
    empty, a null conversation id is one conversation. Repeated turns all stay. A dialogue without a participant gives
    nothing. Dialogues may be of any size: turns are numbered over range partitions, and the speakers of a dialogue
    are found by a map-side combined aggregation. Other columns are not read.
    """
    speaker = F.coalesce(F.nullif(F.trim(F.col(speaker_col).cast("string")), F.lit("")), F.lit(UNKNOWN))
    base = turns.select(F.col(conv_col).alias("conv_id"), F.col(order_col).alias("turn"), speaker.alias("speaker"), text_of(text_col).alias("text"), F.lit(0).alias("zero"))
    numbered = running(base, ["conv_id"], ["turn", "speaker", "text"], "zero", "none", "at").drop("none", "zero")
    people = numbered.filter(~F.col("speaker").isin(*context)).groupBy("conv_id", "speaker").agg(F.count(F.lit(1)).alias("n"))
    people = people.select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("perspective"))
    both = numbered.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv")))
    own = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker").isin(*context), F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), _safe(F.col("speaker"))))
    head = F.concat(F.lit(OPEN), head, F.lit("\n"))
    return both.select(
        "conv_id", "perspective", "at", "speaker", head.alias("head"), F.concat(head, _safe(F.col("text")), F.lit(f"{CLOSE}\n")).alias("segment"),
        (own & ~F.col("speaker").isin(*context)).alias("learn"))


def render(rotated: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Whole renderings: ``conv_id, perspective, block, n_turns, text, mask``.

    A dialogue of up to ``block_turns`` turns is one row; a longer one continues in further blocks of as many turns, whose
    texts joined are the dialogue, so no group grows with a dialogue. ``mask`` lists the learnt parts as structs of
    ``start`` and ``end``, code points of the block's text, end exclusive.
    """
    keys = ["conv_id", "perspective", "block"]
    blocks = rotated.withColumns({"block": F.floor(F.col("at") / block_turns).cast("long"), "size": F.length("segment").cast("long")})
    upto = Window.partitionBy(*keys).orderBy("at")
    placed = blocks.withColumn("end", F.sum("size").over(upto)).withColumn("start", F.col("end") - F.col("size"))
    span = F.when(F.col("learn"), F.struct((F.col("start") + F.length("head")).alias("start"), (F.col("end") - 1).alias("end")))
    out = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("at", "segment"))).alias("parts"), F.array_sort(F.collect_list(span)).alias("mask"))
    return out.select(*keys, "n_turns", F.array_join(F.col("parts.segment"), "").alias("text"), "mask")
