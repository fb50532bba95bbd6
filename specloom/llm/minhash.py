"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.functions.scratch import FILES_A_CORE, in_few_files
from specloom.llm.common import Scratch, whole_numbers, without_null
from specloom.llm.symbols import U, batches, mix, offsets, starts_of_windows, window_hash, words_of
from specloom.operators.graph import components


@dataclass(frozen=True)
class MinMax:
    """Each of `hashes` permutations gives a minimum and a maximum, so a signature has twice as many values.

    A band is `rows` values. Two sets of likeness s share no band with a chance of (1 - s**rows) ** (2 * hashes / rows):
    5e-6 at 0.75 with these numbers, and less above.
    """

    words: int = 5
    percent: int = 75
    hashes: int = 64
    rows: int = 4


def sets_of(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all documents, sorted within each, their number for each, and the words of each."""
    symbols, words = words_of([(t or "").encode().lower() for t in texts])
    at, _ = starts_of_windows(words, k)
    hashes, n = window_hash(symbols, k)[at], np.maximum(words - k + 1, 0)
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):  # the whole sequence is their one shingle
        first = offsets(words)[:-1]
        hashes = np.insert(hashes, offsets(n)[short], [hash_of(symbols[first[d] : first[d] + words[d]]) for d in short])
        n[short] = 1
    cuts = offsets(n)
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        hashes[x:y].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[cuts[:-1][n > 0]] = True
    return hashes[new], np.bincount(np.repeat(np.arange(len(n)), n)[new], minlength=len(n)), words


def hash_of(symbols: np.ndarray) -> np.uint64:
    return window_hash(symbols, len(symbols))[0]


def constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(75)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signatures(hashes: np.ndarray, counts: np.ndarray, how: MinMax) -> np.ndarray:
    """Minimum and maximum of each permutation, for documents that have shingles: (documents, 2 * hashes).

    Permutations are of the upper 32 bits of a shingle's hash: two shingles that agree in these count as one here, which can only
    add a band that two sets share.
    """
    first = offsets(counts)[:-1]
    upper = (hashes >> U(32)).astype(np.uint32)
    out, v = np.empty((2 * how.hashes, len(counts)), np.uint32), np.empty_like(upper)
    odd, flips = constants(how.hashes)
    for p, (a, b) in enumerate(zip(odd.astype(np.uint32), (flips >> U(31)).astype(np.uint32), strict=True)):
        np.bitwise_xor(upper, b, out=v)
        np.multiply(v, a, out=v)
        np.minimum.reduceat(v, first, out=out[2 * p])
        np.maximum.reduceat(v, first, out=out[2 * p + 1])
    return out.T


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    n = signature.shape[1] // rows
    parts = signature[:, : n * rows].reshape(len(signature), n, rows)
    out = np.broadcast_to(mix(np.arange(1, n + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for i in range(rows):
        out = mix(out * U(3) + parts[:, :, i])
    return out


def set_ids(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One number for each non-empty set: equal sets have equal numbers."""
    return mix(np.add.reduceat(mix(hashes + U(11)), offsets(counts)[:-1]) + counts.astype(np.uint64))


def signed(docs: DataFrame, how: MinMax, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, h (hash of the text), n_words, n_shingles, node (number of the set, null if empty), its bands, and the columns `also` as strings; no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame):
                hashes, counts, words = sets_of(part["text"].tolist(), how.words)
                full = counts > 0
                ids = whole_numbers(part["doc_id"], part["_none"])
                out = pd.DataFrame({"doc_id": ids, "h": part["h"].array, "n_words": words.astype(np.int64), "n_shingles": counts.astype(np.int64)})
                node, band = np.zeros(len(part), object), np.zeros(len(part), object)
                node[:], band[:] = None, None
                if full.any():
                    node[full] = set_ids(hashes, counts[full]).view(np.int64)
                    for i, row in zip(np.flatnonzero(full), bands(signatures(hashes, counts[full], how), how.rows).view(np.int64), strict=True):
                        band[i] = row
                out["node"], out["bands"] = pd.array(node, "Int64"), band
                for i, _ in enumerate(also):
                    out[f"_also_{i}"] = part[f"_also_{i}"].array
                yield out

    handed = [F.col(c).cast("string").alias(f"_also_{i}") for i, c in enumerate(also)]
    schema = "doc_id long, h long, n_words long, n_shingles long, node long, bands array<long>" + "".join(f", _also_{i} string" for i, _ in enumerate(also))
    return docs.select(*without_null("doc_id"), "text", text_hash().alias("h"), *handed).mapInPandas(run, schema)


def text_hash() -> Column:
    """What tells the texts under one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())


def full_sets(docs: DataFrame, how: MinMax) -> DataFrame:
    """node and its sorted shingles as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in batches(frame):
                hashes, counts, _ = sets_of(part["text"].tolist(), how.words)
                if full := counts[counts > 0].tolist():
                    cuts = offsets(np.array(full))
                    yield pd.DataFrame({"node": set_ids(hashes, np.array(full)).view(np.int64), "shingles": [hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    return docs.select("text").mapInPandas(run, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (pivot, node) whose full sets are like enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = []
            for x, y in zip(frame["_x"], frame["_y"], strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((a, b))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                good.append(100 * inter >= percent * (len(a) + len(b) - inter))
            yield frame.loc[good, ["pivot", "node"]]

    full = pairs.join(sets.withColumnsRenamed({"node": "pivot", "shingles": "_x"}), "pivot").join(sets.withColumnRenamed("shingles", "_y"), "node")
    return full.select("pivot", "node", "_x", "_y").mapInPandas(run, "pivot long, node long")


def rare_prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (pivot, node) of different roots among `nodes` (node, n, root) that may be like enough: none that is gets lost.

    Of two sets that are, each has a shingle of the other among its rarest n - ceil(share * n) + 1, in one order of all
    shingles. Rarest first, so what a set alone has uses up its prefix and makes no pair. The places of the shared shingle
    bound what the two can share, which rules out most of the rest.
    """

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            flat = [np.frombuffer(x, np.int64) for x in frame["shingles"]]
            yield pd.DataFrame({"node": np.repeat(frame["node"].to_numpy(), [len(x) for x in flat]), "shingle": np.concatenate(flat)})

    rows = sets.join(nodes.select("node"), "node", "left_semi").mapInPandas(spread, "node long, shingle long")
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("_df"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("_df", "shingle"))
    prefix = rows.join(common.hint("shuffle_hash"), "shingle").withColumn("_r", rank).join(nodes, "node").filter(F.col("_r") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    prefix = prefix.filter("_df > 1").select("shingle", "node", "n", "root", "_r")
    # a shingle of one root alone makes no pair
    mixed = prefix.groupBy("shingle").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a != _b").select("shingle")
    prefix = prefix.join(mixed, "shingle")
    other = prefix.select("shingle", F.col("node").alias("pivot"), F.col("n").alias("_n"), F.col("root").alias("_root"), F.col("_r").alias("_q"))
    # at their first common shingle, two sets can share no more than it and what follows in either
    enough = (100 + percent) * (1 + F.least(F.col("n") - F.col("_r"), F.col("_n") - F.col("_q"))) >= percent * (F.col("n") + F.col("_n"))
    pairs = prefix.join(other, "shingle").filter(enough & (F.col("pivot") < F.col("node")) & (F.col("root") != F.col("_root")) & (100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")))
    return pairs.select("pivot", "node").distinct()


#: Rounds of one pivot a bucket before what is left is searched by rare shingles.
PIVOT_ROUNDS = 3


def near_duplicates(docs: DataFrame, how: MinMax = MinMax()) -> DataFrame:  # noqa: B008
    """One row a document: n_shingles, component_id and kept; see `judged`."""
    return judged(docs, how).select("doc_id", "n_shingles", "component_id", "kept")


def judged(docs: DataFrame, how: MinMax = MinMax(), also: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """One row a document: doc_id, h (hash of the text), n_words, n_shingles, component_id, kept, root, a number of its component, and the columns `also` as strings.

    Equal sets are one node from the start. Nodes that share a band are a bucket. In each of a few rounds, every
    bucket that holds more than one component so far tests one node, the pivot, against its nodes of other components, on
    full sets, and goes: a group of near copies costs about one pair a member, and a bucket is done once it is one component or
    one node. All nodes of the others are then searched for links across components by their rarest shingles, which is exact, so no link that
    a band suggests is lost, and no group makes all its pairs.

    Null and empty texts have no shingles, are linked with nothing and kept. A document without doc_id
    can be linked but names no component; alone, its component_id is null and it is kept. Rows with one doc_id and several texts
    are judged each. Columns besides doc_id, text and `also` are not read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    sign = scratch.keep(signed(docs, how, also), "signed")
    nodes = sign.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = scratch.keep(nodes, "nodes", few=FILES_A_CORE)
    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    # a node has a bucket once; one row a shared bucket, so hashing those spares the sort of all others
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_nodes")).filter("_nodes > 1").select("bucket")
    open_ = scratch.keep(buckets.join(shared.hint("shuffle_hash"), "bucket"), "open")
    roots = scratch.keep(open_.select("node").distinct().withColumn("root", F.col("node")), "roots-0", few=1)
    wanted = nodes.join(roots, "node", "left_semi").select(F.col("rep").alias("_rep"))
    # a set of which no document has an id is found by its text alone; such sets are few
    texts = docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi")
    sets = scratch.keep(full_sets(texts, how).join(roots, "node", "left_semi").dropDuplicates(["node"]), "sets", few=FILES_A_CORE)
    for turn in range(PIVOT_ROUNDS + 1):
        # nodes that are left, with their components of now
        now = open_.join(roots, "node")
        split = now.groupBy("bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a != _b").select("bucket")
        now = scratch.keep(now.join(split, "bucket"), f"now-{turn}", few=1)
        if now.isEmpty():
            break
        if turn < PIVOT_ROUNDS:
            # one order of all nodes a round, so that a pair meets in most of the buckets that it shares
            place = F.xxhash64("node", F.lit(turn))
            heads = now.groupBy("bucket").agg(F.min_by("node", place).alias("pivot"), F.min_by("n", place).alias("_n"), F.min_by("root", place).alias("_root"))
            tried = now.join(heads, "bucket").filter((F.col("root") != F.col("_root")) & (100 * F.least("n", "_n") >= how.percent * F.greatest("n", "_n"))).select("pivot", "node").distinct()
        else:
            tried = rare_prefix_pairs(now.select("node", "n", "root").distinct(), sets, how.percent)
        links = scratch.keep(confirmed(tried, sets, how.percent), f"links-{turn}", few=FILES_A_CORE)
        named = roots.select(F.col("node").alias("pivot"), F.col("root").alias("_a"))
        edges = links.join(named, "pivot").join(roots.withColumnRenamed("root", "_b"), "node").select("_a", "_b")
        moved = components(edges, "_a", "_b", "minhash-graph").select(F.col("node").alias("root"), F.col("root").alias("_new"))
        roots = scratch.keep(roots.join(moved, "root", "left").select("node", F.coalesce("_new", "root").alias("root")), f"roots-{turn + 1}", few=1)
        if turn < PIVOT_ROUNDS:  # a pivot has met its whole bucket
            open_ = scratch.keep(now.select("bucket", "node", "n").join(heads.select("bucket", F.col("pivot").alias("node")), ["bucket", "node"], "left_anti"), f"open-{turn}", few=1)
    named = nodes.select("node", "rep").join(roots, "node")
    lowest = named.groupBy("root").agg(F.min("rep").alias("component"))
    linked = roots.join(lowest, "root").select("node", "component")
    ids = nodes.select("node", "rep").join(linked, "node", "left").join(roots, "node", "left").select("node", F.coalesce("component", "rep").alias("component"), F.coalesce("root", "node").alias("root"))
    handed = [F.col(f"_also_{i}").alias(c) for i, c in enumerate(also)]
    out = sign.drop("bands").join(ids, "node", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "h", "n_words", "n_shingles", "component_id", kept.alias("kept"), "root", *handed)


def deduplicated(docs: DataFrame, how: MinMax = MinMax()) -> DataFrame:  # noqa: B008
    """The rows of docs without near copies: of each component one row, that of the least doc_id.

    Rows are judged one by one, not by doc_id: of the texts under one doc_id, of rows without doc_id, and of rows that repeat,
    those of one component leave one row (by hash of text, then of the row, where doc_ids tie; null doc_ids come last). Rows without
    shingles, null and empty texts among them, all stay. All columns are handed on under their names, whatever these are. Very
    long texts are judged whole. An empty table gives no rows.
    """
    rows = judged(docs, how).select(F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_n"), F.col("h").alias("_h"), "root")
    first = rows.filter("root is not null").groupBy("root").agg(F.min(F.struct("_n", "_d", "_h")).alias("_f")).select("_f.*", F.lit(True).alias("_one"))
    stay = first.unionByName(rows.filter("root is null").select("_n", "_d", "_h", F.lit(False).alias("_one")).distinct())
    boxed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_n"), text_hash().alias("_h"))
    place = F.row_number().over(Window.partitionBy("_n", "_d", "_h").orderBy(F.xxhash64("_row")))
    return in_few_files(boxed.join(stay, ["_n", "_d", "_h"]).withColumn("_at", place).filter("not _one or _at = 1").select("_row.*"))
