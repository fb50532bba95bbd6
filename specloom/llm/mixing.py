"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.llm.common import Scratch, n_words

#: Most times that the mix repeats a document.
REPEATS = 3
#: Blocks at least in the least target of a source, unless blocks are single words.
FINE = 1024


def targets(sizes: DataFrame, total: int, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """Add `target` to one row a source (`_null`, `_source`, `source_size`).

    Sources by code point, null last, weigh `weights` in turn. Targets share `total` by weight, but stop
    at `repeats` times their source's size; the excess goes to the others by weight until none is above.
    That level is found in one pass: capped sources are those of least size for their weight.
    """
    order = Window.orderBy("_null", "_source")
    rank = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("_rank", F.row_number().over(order)).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), rank + 1).cast("double"))
    by_need = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before, on = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.lit(float(total)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(on)
    return (
        weighed.withColumn("_cap", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("_level", level)
        # the first source whose cap holds its level sets the level of all that follow
        .withColumn("_free", F.col("_cap") >= F.col("_w") * F.col("_level"))
        .withColumn("_final", F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_w"), "_rank", "_level"))).over(Window.partitionBy()))
        .withColumn("target", F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_final._level"))))
        .drop("_w", "_cap", "_level", "_free", "_final")
    )


def sainte_lague(rows: DataFrame, keys: list[str], votes: str, seats, seats_name: str, tie: str) -> DataFrame:
    """Give `seats` (a column, equal within `keys`) to the rows of each group by highest quotients votes / (2 s + 1).

    Any divisor result lies within (share * rows / 2 + 1) of the exact share, so the quotients below that
    range are sure winners, those above sure losers, and only the range itself is ranked: about three
    quotients for each row of a group. Ties go to the lower `tie`. Rows without votes get no seat.
    """
    group = Window.partitionBy(*keys)
    live = rows.withColumn("_all", F.sum(votes).over(group)).withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_seats", seats)
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(0.0)
    slack = F.ceil(share * F.col("_n") / 2) + 1
    live = live.withColumn("_low", F.when(share > 0, F.greatest(F.lit(0), F.floor(share * F.col("_seats")) - slack)).otherwise(0)).withColumn("_high", F.when(share > 0, F.ceil(share * F.col("_seats")) + slack).otherwise(0))
    tried = live.withColumn("_s", F.explode(F.expr("sequence(_low, _high)")))
    ranked = tried.withColumn("_place", F.row_number().over(group.orderBy(F.desc(F.col(votes) / (2 * F.col("_s") + 1)), tie, "_s")))
    # seats left for the ranked range: all less the sure ones
    left = live.groupBy(*keys).agg((F.first("_seats") - F.sum("_low")).alias("_left"))
    ranked = ranked.join(left, keys) if keys else ranked.crossJoin(left)
    won = F.sum(F.when((F.col("_place") <= F.col("_left")) & (F.col(votes) > 0), 1).otherwise(0))
    kept = [c for c in rows.columns]
    return ranked.groupBy(*kept, "_low").agg(won.alias("_won")).select(*kept, (F.col("_low") + F.col("_won")).cast("long").alias(seats_name))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), **options) -> DataFrame:
    """What a mix of all sources takes from each document; see `taken_of`."""
    return taken_of(docs, weights, **options).drop("_d", "_n", "_h")


def taken_of(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int = 64, block_words: int = 1024, seed: str = "mix") -> DataFrame:
    """What a mix of all sources takes from each document.

    Sizes are words. Every source gets a whole number of equal blocks by Sainte-Lague on its target, and
    hands them on to its `shards` hash shards by the same rule on their sizes. What would take a shard
    above three times its words goes, word by word and by the same rule, to the source's shards with room.
    A shard lines its documents up by seeded hash and takes its quota as whole rounds over all of them
    plus one run of blocks from the seeded start: no document is taken more than three times its size.
    Blocks have `block_words` words, fewer in a corpus of under 65536 blocks and fewer where a source's
    target is under `FINE` blocks, so that rounding stays far below any target.
    A hot source is spread over all shards; the only windows over everything are over sources.

    Null and empty texts have size 0 and take 0. A null source is one source of its own, the last. Rows
    that repeat a doc_id are rows of their own; wholly equal rows may change places. An empty table
    gives no rows. Only doc_id, text and source are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    seeded = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))
    thin = docs.select(
        "doc_id", F.col("source").isNull().alias("_null"), F.coalesce(F.col("source"), F.lit("")).alias("_source"), n_words("text").alias("size"), seeded.alias("_at"), *row_key()
    )
    thin = scratch.keep(thin.withColumn("_shard", (F.conv(F.substring("_at", 1, 4), 16, 10).cast("int") % shards)), "sizes")
    cells = scratch.keep(thin.groupBy("_null", "_source", "_shard").agg(F.sum("size").alias("_words")), "cells", few=1)
    total = cells.agg(F.sum("_words")).first()[0] or 0
    sources = scratch.keep(targets(cells.groupBy("_null", "_source").agg(F.sum("_words").alias("source_size")), total, weights), "sources", few=1)
    least = sources.filter("target > 0").agg(F.min("target")).first()[0] or 0
    block = max(1, min(block_words, total // 65536, int(least // FINE)))
    quota = sainte_lague(sources, [], "target", F.lit((2 * total + block) // (2 * block)), "_blocks", "_rank")
    quota = sainte_lague(cells.join(quota, ["_null", "_source"]), ["_null", "_source"], "_words", F.col("_blocks"), "_quota", "_shard")
    # no more seats than words of room: so no shard gets more of them than it has room
    own = Window.partitionBy("_null", "_source")
    quota = quota.withColumn("_part", F.least(F.col("_quota") * block, F.col("_words") * REPEATS)).withColumn("_room", F.col("_words") * REPEATS - F.col("_part"))
    quota = scratch.keep(quota.withColumn("_cut", F.least(F.sum(F.col("_quota") * block - F.col("_part")).over(own), F.sum("_room").over(own))), "quotas", few=1)
    quota = sainte_lague(quota, ["_null", "_source"], "_room", F.col("_cut"), "_more", "_shard")
    quota = quota.select("_null", "_source", "_shard", "_words", "source_size", "target", (F.col("_part") + F.col("_more")).alias("_take"))

    cell = Window.partitionBy("_null", "_source", "_shard")
    line = cell.orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rounds = F.expr("if(_words > 0, _take div _words, 0)")
    rest = F.expr("if(_words > 0, _take % _words, 0)")
    part = F.greatest(F.lit(0), F.least("_end", rest) - (F.col("_end") - F.col("size")))
    return (
        thin.withColumn("_end", F.sum("size").over(line))
        .join(quota, ["_null", "_source", "_shard"])
        .select(
            "doc_id", "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"),
            F.when(~F.col("_null"), F.col("_source")).alias("source"), F.col("_shard").alias("shard"), "_d", "_n", "_h",
        )
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), **options) -> DataFrame:
    """docs as the mix takes them: a document comes once for each time that half of it or more is taken.

    A shard takes whole rounds over its documents and one run of blocks, so that only a document at an end of that run is taken in part;
    of all others the mix takes whole copies, and none of those that it leaves out. Documents without words come once.
    doc_id and text tell documents apart here; of repeated rows each comes as often as the one that is taken most. Null sources
    are a source, null and very long texts are as in `mix`. All columns are handed on under their names, whatever these are. An empty table gives no rows.
    """
    taken = taken_of(docs, weights, **options)
    copies = taken.groupBy("_d", "_n", "_h").agg(F.max(F.expr("if(size > 0, (2 * taken + size) div (2 * size), 1)")).cast("int").alias("_copies")).filter("_copies > 0")
    boxed = docs.select(F.struct(*docs.columns).alias("_row"), *row_key())
    out = boxed.join(copies, ["_d", "_n", "_h"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select("_row.*")


def row_key() -> list[Column]:
    """Columns without nulls that tell documents apart: doc_id and text."""
    return [F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_n"), F.xxhash64("text").alias("_h")]
