"""Exact duplicates by skew-safe combining: local, then salted, then global winners, on full content."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundset.llm.tables import carried, restored, written

#: Parts that the rows of one text are spread over; a 64-bit mask names those in use.
SALTS = 48
#: Bytes of repeated digests up to which they are sent to every executor.
SENT_BYTES = 16_000_000


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns(
        {
            "_digest": F.sha2(text, 256),
            "_salt": F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).cast("int"),
        }
    )


def text_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS
) -> DataFrame:
    """Groups of two or more equal texts, one row per salt in use: _digest, _salt, keep_id, group_size.

    Each stage groups on the whole text beside its digest: the map side combines equal texts of its
    partition, the first shuffle those of a salt, the second the at most `salts` winners of a text. Two texts
    of one SHA-256 stop the job, as rows look their group up by digest afterwards.
    """
    keyed = _keyed(docs, id_col, text_col, salts).select(
        "_digest", "_salt", F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    )
    salted = keyed.groupBy("_digest", "_text", "_salt").agg(
        F.max("_id").alias("_top"), F.count(F.lit(1)).alias("_n")
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_salt"))
    winners = (
        salted.repartition("_digest")
        .groupBy("_digest", "_text")
        .agg(F.max("_top").alias("keep_id"), F.sum("_n").alias("group_size"), F.bit_or(bit).alias("_used"))
    )
    # One more aggregation in the same partitioning: how many different texts share the digest.
    by_digest = winners.groupBy("_digest").agg(
        F.max("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"),
        F.bit_or("_used").alias("_used"),
        F.count(F.lit(1)).alias("_texts"),
    )
    checked = by_digest.where("group_size > 1").where(
        F.when(F.col("_texts") == 1, True).otherwise(
            F.raise_error(F.concat(F.lit("different texts share the digest "), "_digest")).cast("boolean")
        )
    )
    in_use = F.filter(
        F.sequence(F.lit(0), F.lit(salts - 1)),
        lambda s: F.col("_used").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), s)) != 0,
    )
    return checked.select("_digest", F.explode(in_use).alias("_salt"), "keep_id", "group_size")


def repeated_digests(keyed: DataFrame) -> DataFrame:
    """Digests that more than one row of `keyed` has, written. Only digests and counts are moved."""
    salted = keyed.groupBy("_digest", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    met = salted.groupBy("_digest").agg(F.sum("_n").alias("_n")).where("_n > 1")
    return written(met.select("_digest"), "repeated")


def _flagged(keyed: DataFrame, repeated: DataFrame, salts: int) -> DataFrame:
    """`keyed` with _again: whether the digest is repeated.

    Few digests are sent to the rows, which then stay where they are; more of them meet the rows by digest and salt.
    """
    marked = repeated.withColumn("_again", F.lit(True))
    if repeated.count() * 64 <= SENT_BYTES:
        return keyed.join(F.broadcast(marked), "_digest", "left")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return keyed.join(marked.withColumn("_salt", every), ["_digest", "_salt"], "left")


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS
) -> DataFrame:
    """Every row of `docs` with keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the largest id stays. A null text counts as empty, a null id as smaller than
    any other; a group with only null ids has a null keep_id. Of rows that repeat the staying id and text one
    stays. Columns of these names (or with a leading underscore: _digest, _salt, _nth, _again) are replaced. An
    empty table gives no rows. A text of a digest no other row has is equal to none; only the others' texts are moved and
    compared, so very long and unique ones stay where they are.
    """
    rest = docs.drop("keep_id", "group_size", "kept", "text_sha256", "_digest", "_salt", "_nth", "_again")
    keyed = _keyed(rest, id_col, text_col, salts)
    flagged = _flagged(keyed, repeated_digests(keyed), salts)
    copies = flagged.where("_again").drop("_again")
    groups = text_groups(copies.select(id_col, text_col), id_col, text_col, salts)
    # The rows of an id and text share digest and salt, so this window needs no shuffle of its own.
    others = [c for c in rest.columns if c not in (id_col, text_col)]
    first = Window.partitionBy("_digest", "_salt", id_col).orderBy(F.xxhash64(F.lit(0), *others))
    stays = F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)
    met = copies.join(groups, ["_digest", "_salt"]).withColumn("_nth", F.row_number().over(first)).withColumn("kept", stays)
    alone = flagged.where(F.col("_again").isNull()).withColumns(
        {"keep_id": F.col(id_col), "group_size": F.lit(1).cast("bigint"), "kept": F.lit(True)}
    )
    names = [*rest.columns, "keep_id", "group_size", "kept", F.col("_digest").alias("text_sha256")]
    return alone.select(*names).unionByName(met.select(*names))


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS
) -> DataFrame:
    """`docs` without the rows that `mark_copies` drops; columns as they were."""
    marked = mark_copies(carried(docs, id_col, text_col), id_col, text_col, salts)
    return restored(marked.where("kept"), docs, id_col, text_col)
