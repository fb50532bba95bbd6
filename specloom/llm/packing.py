"""Best-fit packing under conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.llm.common import Scratch, block_offsets, n_words, ranged, whole_numbers, without_null

#: Copies of a row that are written out at a time.
COPIES = 4096


class Bins:
    """Open bins in order of what room they have left.

    Every bin carries two bitmaps: the duplicate clusters it holds, and the sources of which it holds as
    many pieces as it may. Bits are positions in the group's own numbering, so two clusters never
    share a bit. A piece goes to the first bin, upwards from its own size, whose bitmaps allow it: the
    search steps to the successor until one does, and opens a bin if none does.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (room, bin)
        self.clusters: list[int] = []
        self.full: list[int] = []
        self.held: list[dict[int, int]] = []

    def put(self, size: int, cluster: int, source: int) -> int:
        at = bisect_left(self.order, (size, -1))
        c, s = 1 << cluster, 1 << source
        while at < len(self.order):
            room, b = self.order[at]
            if not (self.clusters[b] & c or self.full[b] & s):
                del self.order[at]
                break
            at += 1
        else:
            room, b = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.full.append(0)
            self.held.append({})
        self.clusters[b] |= c
        n = self.held[b][source] = self.held[b].get(source, 0) + 1
        if n >= self.per_source:
            self.full[b] |= s
        if room > size:
            insort(self.order, (room - size, b))
        return b


def each_copy(counted: DataFrame) -> DataFrame:
    """A row for each of `copies`, numbered; thousands of them are dealt to the tasks before they are written out."""
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    many = blocks.filter(F.col("copies") > COPIES).repartition("doc_id", "cluster", "_block")
    end = F.least(F.col("copies"), (F.col("_block") + 1) * COPIES) - 1
    out = blocks.filter(F.col("copies") <= COPIES).unionByName(many)
    return out.withColumn("copy", F.explode(F.sequence(F.col("_block") * COPIES, end))).drop("_block", "copies")


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 8, group_bins: int = 256, cluster: Column | None = None, size: Column | None = None) -> DataFrame:
    """Pieces of all documents in bins of `capacity` words.

    A document longer than a bin is cut: whole bins first, its rest is packed like any other piece, so no
    word is lost and no piece is in two bins. No bin holds two pieces of one duplicate cluster
    (equal texts, unless `cluster` says otherwise), nor more than `per_source` of one source. Pieces
    are dealt by hash to groups of about `group_bins` bins, largest first within each; a group is
    bounded by that number whatever a source or a cluster holds, as copies are dealt apart, rows that are
    equal in every column too: these are counted, and their numbers are hashed with them, so the deal does not depend on how the rows lie.

    Null and empty texts are pieces of no words and go to any bin that allows them. Null is a source of its own, apart from the empty one.
    Texts of any length are counted whole. Repeated rows are packed each. An empty table gives no rows. Only doc_id, text and source are read.

    Returns doc_id, piece, start (word), n_words, group, bin, room (words left in the bin). Whole bins are numbered through, in group -1.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    thin = docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("source"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("cluster") if cluster is None else cluster.cast("long").alias("cluster"),
        (n_words("text") if size is None else size.cast("long")).alias("size"),
    )
    thin = scratch.keep(thin.groupBy(*thin.columns).agg(F.count(F.lit(1)).alias("copies")), "sizes")
    words, rows = thin.agg(F.sum(F.col("size") % capacity * F.col("copies")), F.sum("copies")).first()
    # a group has as many words as its bins, but never more than 64 pieces a bin
    groups = int(max(1, (words or 0) // (group_bins * capacity), (rows or 0) // (group_bins * 64)))
    each = each_copy(thin)
    long = ranged(scratch, each.filter(F.col("size") >= capacity).withColumn("bins", F.expr(f"size div {capacity}")), "long", "doc_id", "cluster", "size", "source")
    before = block_offsets(long, ("_before", F.col("bins")))
    line = Window.partitionBy("_pid").orderBy("doc_id", "cluster", "size", "source", "copy").rowsBetween(Window.unboundedPreceding, -1)
    whole = long.join(before, "_pid").withColumn("_first", F.col("_before") + F.coalesce(F.sum("bins").over(line), F.lit(0)))
    whole = whole.select("doc_id", "_first", F.explode(F.expr("sequence(0L, bins - 1)")).alias("piece"))
    whole = whole.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_words"), F.lit(-1).alias("group"), (F.col("_first") + F.col("piece")).alias("bin"), F.lit(0).cast("long").alias("room"))
    rest = each.filter((F.col("size") % capacity > 0) | (F.col("size") == 0)).withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster", "size", "source", "copy"), F.lit(groups)).cast("int"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(n=frame["size"] % capacity).sort_values(["n", "_none", "doc_id", "cluster", "size", "source"], ascending=[False, True, True, True, True, True], kind="stable")
        bins = Bins(capacity, per_source)
        clusters, sources = pd.factorize(frame["cluster"])[0].tolist(), pd.factorize(frame["source"])[0].tolist()
        at = np.array([bins.put(n, c, s) for n, c, s in zip(frame["n"].tolist(), clusters, sources, strict=True)], np.int64)
        room = np.full(len(bins.clusters), capacity, np.int64)
        np.subtract.at(room, at, frame["n"].to_numpy())
        return pd.DataFrame(
            {"doc_id": pd.Series(whole_numbers(frame["doc_id"], frame["_none"]), frame.index), "piece": frame["size"] // capacity, "start": frame["size"] - frame["n"], "n_words": frame["n"], "group": frame["group"], "bin": at, "room": room[at]}
        )

    packed = rest.select(*without_null("doc_id"), "source", "cluster", "size", "copy", "group").groupBy("group").applyInPandas(fill, "doc_id long, piece long, start long, n_words long, group int, bin long, room long")
    return whole.unionByName(packed)
