"""Chat formatting by perspective: each participant in turn is the assistant, the others are named users."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks around a turn and its role line.
START, END = "<|im_start|>", "<|im_end|>\n"
BUCKET = 256


def _turn_order(turns: DataFrame) -> DataFrame:
    """Turns with a definite place: null conversations, roles and texts replaced, ties told apart.

    Rows that repeat one another are turns of their own.
    """
    return turns.withColumns(
        {
            "speaker": F.coalesce(F.trim("role"), F.lit("")),
            "_text": F.coalesce("text", F.lit("")),
            "_turn": F.coalesce(F.col("turn").cast("bigint"), F.lit(2**63 - 1)),
        }
    )


def perspectives(turns: DataFrame) -> DataFrame:
    """Every conversation rendered once for every participant: one row per perspective and turn.

    `turns`: conv_id, turn, role, text. Columns: conv_id, perspective, position (from 0), speaker, as_role
    (assistant for the perspective's speaker, `system` for system turns, else user), segment (the rendered
    turn), start and end (characters of the whole dialogue), train_start and train_end (the span to learn
    from; null where masked). The dialogue of a perspective is its segments in the order of position; it
    stays in rows, so that no cell or task holds a long conversation whole.

    System turns are no participant: they open each perspective masked. A participant is a speaker's name; a
    null or blank role is the speaker ''. Null texts are empty turns, still rendered. Turns are ordered by
    number (null last), then speaker and text; repeated rows are turns of their own. A null conv_id is one
    conversation. A conversation of system turns alone gives no rows. Further columns are left out.
    """
    base = _turn_order(turns.select("conv_id", "turn", "role", "text")).select(
        "conv_id", "speaker", "_turn", "_text"
    )
    speakers = base.where("speaker <> 'system'").select("conv_id", F.col("speaker").alias("perspective")).distinct()
    # Running positions over blocks of turns: no window holds more than a block of a conversation.
    sized = base.withColumn("_block", F.floor(F.coalesce(F.col("_turn"), F.lit(0)) / BUCKET))
    # Speakers are dealt to the blocks of their conversation first, so that a long one is joined in parts.
    parts = sized.select(F.col("conv_id").alias("_conv"), F.col("_block").alias("_part")).distinct()
    parts = parts.join(speakers, F.col("_conv").eqNullSafe(F.col("conv_id"))).drop("conv_id")
    named = sized.join(
        parts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_block") == F.col("_part"))
    ).drop("_conv", "_part")
    own = F.col("speaker") == F.col("perspective")
    as_role = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    head = F.concat(
        F.lit(START),
        as_role,
        F.when(as_role == "user", F.concat(F.lit(" name="), "speaker")).otherwise(""),
        F.lit("\n"),
    )
    rendered = named.withColumns({"as_role": as_role, "_head": F.length(head)}).withColumn(
        "segment", F.concat(head, F.col("_text"), F.lit(END))
    )
    keys = ["conv_id", "perspective"]
    blocks = rendered.groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.length("segment")).alias("_chars")
    )
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        F.col("conv_id").alias("_c"),
        F.col("perspective").alias("_p"),
        F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_chars").over(over), F.lit(0)).alias("_chars_before"),
    )
    within = Window.partitionBy(*keys, "_block").orderBy("_turn", "speaker", "_text")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = rendered.withColumns(
        {
            "_nth": F.row_number().over(within) - 1,
            "_at": F.coalesce(F.sum(F.length("segment")).over(upto), F.lit(0)),
        }
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("_c"))
        & (F.col("perspective") == F.col("_p"))
        & (F.col("_block") == F.col("_b"))
    )
    start = F.col("_chars_before") + F.col("_at")
    learns = F.col("as_role") == "assistant"
    return placed.join(offsets, same).select(
        "conv_id",
        "perspective",
        (F.col("_rows_before") + F.col("_nth")).alias("position"),
        "speaker",
        "as_role",
        "segment",
        start.alias("start"),
        (start + F.length("segment")).alias("end"),
        F.when(learns, start + F.col("_head")).alias("train_start"),
        F.when(learns, start + F.length("segment") - 1).alias("train_end"),
    )
