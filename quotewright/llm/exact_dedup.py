"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Each step groups narrow keys only, and marks the groups of two or more in a bitmap of hashed
keys. The bitmap has a fixed number of bits, so it can be broadcast at any size of the corpus;
two keys that share a bit only cause a needless hash in the next step, never a wrong group.
No text is ever shuffled by ``exact_groups``: hashes are computed where the text is read, and
the full hash only where the (length, prefix) group survived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotewright.llm.store import stored
from quotewright.llm.text import ascii_lower, unused, whole

FILTER_BITS = 1 << 23  # 1 MB as a bitmap
PREFIX_CHARS = 128


def _slot(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits)) + 1


def _shared(keyed: DataFrame, key: str, bits: int) -> DataFrame:
    """The bitmap of keys that two or more rows have: (bucket, bitmap), 4 KB a row."""
    slot = _slot(F.col(key), bits)
    return (
        keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
        .groupBy(F.bitmap_bucket_number(slot).alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bitmap"))
    )


def _marked(rows: DataFrame, key: str, bitmap: DataFrame, bits: int, flag: str) -> DataFrame:
    """``rows`` with a flag: whether the bit of its key is set. The bitmap has ``bits`` bits."""
    slot = _slot(F.col(key), bits)
    position = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col("_bitmap"), (position / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.expr("shiftright(_byte, cast(_position % 8 as int)) & 1")
    return (
        rows.withColumn("_bucket", F.bitmap_bucket_number(slot))
        .join(F.broadcast(bitmap), "_bucket", "left")
        .withColumn("_position", position)
        .withColumn("_byte", byte.cast("int"))
        .withColumn(flag, F.coalesce(bit == 1, F.lit(False)))
        .drop("_bucket", "_bitmap", "_position", "_byte")
    )


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
    prefix_chars: int = PREFIX_CHARS, filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept; with ``digest`` also text_sha256.

    Texts are equal when they are identical after lower-casing A-Z. Of equal texts the row with
    the largest id stays. NULL counts as the empty text. Rows that repeat both id and text carry
    the same decision and count in ``group_size``. A NULL id loses to any other; a group of NULL
    ids keeps a NULL. Other columns are ignored; an empty table gives an empty result.
    """
    text = whole(F.col(text_col))
    base = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("_length"))
    by_length = base.withColumn("_key", F.xxhash64("_length"))
    lengths = _shared(by_length.select("_key"), "_key", filter_bits)
    long_enough = _marked(by_length, "_key", lengths, filter_bits, "_same_length")
    start = ascii_lower(F.substring("_text", 1, prefix_chars))
    by_prefix = long_enough.withColumn(
        "_key", F.when(F.col("_same_length"), F.xxhash64(F.col("_length"), start)))
    prefixes = _shared(by_prefix.select("_key").where("_key IS NOT NULL"), "_key", filter_bits)
    candidates = _marked(by_prefix, "_key", prefixes, filter_bits, "_same_prefix")
    full = F.sha2(ascii_lower(F.col("_text")), 256)
    if digest:
        hashed = candidates.withColumn("text_sha256", full).withColumn(
            "_full", F.when(F.col("_same_prefix"), F.col("text_sha256")))
    else:
        hashed = candidates.withColumn("_full", F.when(F.col("_same_prefix"), full))
    extra = ["text_sha256"] if digest else []
    # Stored, the groups meet their rows in a join of its own shuffles, which Spark can split where
    # one group holds many rows.
    hashed = stored(hashed.select("_id", "_length", "_full", *extra), "hashes")
    groups = stored(
        hashed.where("_full IS NOT NULL").groupBy("_length", "_full")
        .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1"), "groups")
    size = F.coalesce(F.col("group_size"), F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return hashed.join(groups, ["_length", "_full"], "left").select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), *extra,
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; ids may be NULL or repeat."""
    own, digest = unused(docs, "_dropped", "_sha256")
    groups = exact_groups(docs, id_col, text_col, digest=True)
    dropped = groups.where(~F.col("kept")).select(
        F.col(id_col).alias(own), F.col("text_sha256").alias(digest)).distinct()
    same = F.col(id_col).eqNullSafe(F.col(own)) & (
        F.sha2(ascii_lower(whole(F.col(text_col))), 256) == F.col(digest))
    return docs.join(dropped, same, "left_anti")
