"""Sharding by global prefix sums of byte sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.llm.common import Scratch, block_offsets, ranged


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Contiguous shards of near equal bytes along doc_id.

    Each range partition gives its total; the totals' running sum gives every document its place
    in the corpus, and the corpus is cut at equal targets. A document belongs to the shard that
    holds the middle of its bytes, so a shard misses its target by one document at most.

    Size is the UTF-8 bytes of the text plus 1; a null text has no bytes and the crc of nothing.
    Null ids come first. Rows that are equal in every column are all kept and may change places.
    Columns besides doc_id and text are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    thin = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode("text", "utf-8"), F.lit(b""))).alias("text_crc32"),
    )
    blocks = ranged(scratch, thin, "blocks", "doc_id", "text_crc32", "size")
    offsets = block_offsets(blocks, ("_bytes", F.col("size")), ("_rows", F.lit(1)))
    total = blocks.agg(F.sum("size")).first()[0] or 1
    w = Window.partitionBy("_pid").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        blocks.withColumn("_end", F.sum("size").over(w))
        .withColumn("_row", F.count(F.lit(1)).over(w))
        .join(offsets, "_pid")
        .select(
            "doc_id", "size", "text_crc32",
            # twice the middle keeps the arithmetic in whole numbers
            F.least(F.lit(shards - 1), F.expr(f"((2 * (_bytes + _end) - size) * {shards}) div (2 * {total}L)")).cast("int").alias("shard"),
            (F.col("_rows") + F.col("_row") - 1).alias("_at"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
