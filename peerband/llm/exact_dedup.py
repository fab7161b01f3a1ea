"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerband.llm.common import decide, private, quoted, text_or_empty
from peerband.session import stage

#: Bytes of an id and a digest, and of a length and a prefix hash, in a hashed table.
DROP_BYTES, LENGTH_BYTES, GROUP_BYTES = 128, 16, 24


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        quoted(id_col).alias("id"), text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def shared_lengths(keyed: DataFrame) -> DataFrame:
    """Lengths that more than one row has: the first scan, which hashes nothing."""
    return (
        keyed.groupBy("n_bytes").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
        .select(F.col("n_bytes").alias("shared_bytes"))
    )


def shared_prefixes(keyed: DataFrame, lengths: DataFrame, prefix_chars: int) -> DataFrame:
    """(length, prefix hash) that more than one row has, among rows of shared lengths only.

    ``lengths`` is stored. The second scan; it reads prefixes, and only these small keys are moved.
    """
    keys = keyed.select("n_bytes", F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix"))
    counted = decide(
        keys, lengths, F.col("n_bytes") == F.col("shared_bytes"), "left_semi",
        lengths.count() * LENGTH_BYTES,
    ).groupBy("n_bytes", "prefix").agg(F.count(F.lit(1)).alias("rows"))
    return counted.where("rows > 1").select(
        F.col("n_bytes").alias("group_bytes"), F.col("prefix").alias("group_prefix")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    digest_all: bool = False,
) -> DataFrame:
    """One row per input row: id, n_bytes, text_sha256, keep_id, group_size, kept.

    Texts are equal when identical; a null text counts as empty. In a group of equal texts the row
    with the largest id stays, a null id is below every other, and of several rows with that id
    one stays. ``text_sha256`` is filled for rows whose length and prefix another row shares, and
    for all rows with ``digest_all``, where the others' digest is output only. Other columns of
    ``docs`` are ignored; an empty table gives no rows.

    Only rows that are left after lengths and after prefixes are grouped by the hash of their whole
    text. Tables of lengths and prefixes are broadcast where they were found small; larger ones are
    joined by a shuffle of keys, or of texts where only survivors are to be hashed.
    """
    keyed = _keyed(docs, id_col, text_col)
    lengths = stage(shared_lengths(keyed.select("n_bytes")), "lengths")
    groups = stage(shared_prefixes(keyed, lengths, prefix_chars), "groups")
    marked = groups.withColumn("survives", F.lit(True))
    size = groups.count() * GROUP_BYTES
    full = keyed.select(
        F.monotonically_increasing_id().alias("row"), "id", "n_bytes",
        F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix"), "text",
    )
    # Whole texts are hashed after the join, which tells whether they have to be.
    digest = F.when(F.col("survives"), F.sha2("text", 256))
    if digest_all:
        small = ["row", "id", "n_bytes", "prefix", F.sha2("text", 256).alias("digest")]
        full, digest = stage(full.select(*small), "rows"), F.col("digest")
    same = (F.col("n_bytes") == F.col("group_bytes")) & (F.col("prefix") == F.col("group_prefix"))
    left = decide(full, marked, same, "left", size)
    rows = stage(
        left.select(
            "row", "id", "n_bytes", "prefix", F.coalesce("survives", F.lit(False)).alias("survives"),
            digest.alias("text_sha256"),
        ),
        "survivors",
    )
    group_key = F.struct("n_bytes", "prefix")
    copies = (
        rows.where("survives")
        .groupBy(group_key.alias("key"), "text_sha256")
        .agg(
            F.max(F.struct("id", "row")).alias("keeper"),
            F.count(F.lit(1)).alias("group_size"),
        )
        .where("group_size > 1")
        .select(
            F.col("text_sha256").alias("copy_sha256"),
            F.col("keeper.id").alias("keeper_id"),
            F.col("keeper.row").alias("keeper_row"),
            "group_size",
        )
    )
    joined = rows.join(
        copies, F.col("survives") & (F.col("text_sha256") == F.col("copy_sha256")), "left"
    )
    copied = F.col("keeper_row").isNotNull()
    return joined.select(
        "id",
        "n_bytes",
        "text_sha256",
        F.when(copied, F.col("keeper_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (~copied | (F.col("row") == F.col("keeper_row"))).alias("kept"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns kept.

    Rows to drop are found by id and digest together, so ids that repeat with other texts stay.
    Rows that repeat both id and text are reduced to one of them.
    """
    decided = stage(exact_dedup(docs, id_col, text_col).where("group_size > 1"), "copies")
    same = F.col("id").eqNullSafe(F.col("keep_id"))
    digest, drop_id, drop_digest = private(docs, "sha256", "drop_id", "drop_sha256")
    drops = stage(
        decided.where(~same).select(
            F.col("id").alias(drop_id), F.unhex("text_sha256").alias(drop_digest)
        ).distinct(),
        "drops",
    )
    hashed = docs.withColumn(digest, F.unhex(F.sha2(text_or_empty(text_col), 256)))
    same_row = (F.col(digest) == F.col(drop_digest)) & quoted(id_col).eqNullSafe(F.col(drop_id))
    out = decide(hashed, drops, same_row, "left_anti", drops.count() * DROP_BYTES)
    if decided.where(same & ~F.col("kept")).limit(1).count():
        out = out.dropDuplicates([id_col, digest])
    return out.select(*[quoted(c) for c in docs.columns])
