"""Chat dialogues from the view of each participant.

Method. Every dialogue is rendered once for each of its participants. That speaker's turns
become the assistant's, the turns of all others those of users with a name, and system turns
stay. Only what the assistant says, with its end mark, is to be learnt from. The result has
one row per view and turn: the rendered piece, its place in the rendered dialogue in
characters, and the part of it that the mask leaves open. A dialogue of any length is then
never gathered; the rendered dialogue is the pieces in the order of ``seq``.

Everything is a DataFrame expression. Places are running sums, which are taken within
blocks of turns first and then over the blocks, so a very long dialogue is spread out.

Results. Turns are ordered by turn (null first), speaker and text, so repeated turns have a
defined order. A null text is empty, a null speaker is called ``unknown``; rows without a
conv_id form one dialogue. A dialogue with only system turns has no participant and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
BLOCK = 256  # turns


def _header(participant: Column, speaker: Column) -> Column:
    named = F.concat(F.lit(f"{START}user name="), speaker, F.lit("\n"))
    own = F.when(speaker == participant, F.lit(f"{START}assistant\n"))
    return own.when(speaker == SYSTEM, F.lit(f"{START}system\n")).otherwise(named)


def perspectives(df: DataFrame, speaker: str = "role", block: int = BLOCK) -> DataFrame:
    """(conv_id, participant, seq, role, name, rendered, start, stop, mask_start, mask_stop)."""
    name = F.coalesce(F.col(speaker), F.lit("unknown")).alias("name")
    turns = df.select(
        "conv_id",
        "turn",
        name,
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))).alias("block"),
    )
    views = turns.filter(F.col("name") != SYSTEM).select(F.col("conv_id").alias("own"), F.col("name").alias("participant"))
    rows = turns.join(views.distinct(), F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")
    header = _header(F.col("participant"), F.col("name"))
    is_own = F.col("name") == F.col("participant")
    rows = rows.select(
        "conv_id",
        "participant",
        "turn",
        "name",
        "text",
        "block",
        F.when(is_own, "assistant").when(F.col("name") == SYSTEM, SYSTEM).otherwise("user").alias("role"),
        F.concat(header, "text", F.lit(END)).alias("rendered"),
        F.length(header).alias("head"),
    ).withColumn("size", F.length("rendered").cast("long"))

    in_block = Window.partitionBy("conv_id", "participant", "block").orderBy(F.asc_nulls_first("turn"), "name", "text")
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({"place": F.row_number().over(in_block), "upto": F.sum("size").over(upto)})
    earlier = Window.partitionBy("conv_id", "participant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "participant", "block").agg(F.count("*").alias("n"), F.sum("size").alias("chars"))
    blocks = blocks.select(
        *[F.col(c).alias(f"b_{c}") for c in ("conv_id", "participant", "block")],
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in ("conv_id", "participant", "block")]
    stop = F.col("chars_before") + F.col("upto")
    start = stop - F.col("size")
    assistant = F.col("role") == "assistant"
    return inside.join(blocks, same).select(
        "conv_id",
        "participant",
        (F.col("turns_before") + F.col("place")).alias("seq"),
        "role",
        "name",
        "rendered",
        start.alias("start"),
        stop.alias("stop"),
        F.when(assistant, start + F.col("head")).alias("mask_start"),
        # The end mark is learnt, the line end after it is not.
        F.when(assistant, stop - 1).alias("mask_stop"),
    )
