"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.functions.scratch import FILES_A_CORE, in_few_files
from specloom.llm.common import Scratch

SAMPLES = 64
#: Documents a block of neighbours holds at most.
BLOCK = 256
BLANKS = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> tuple[Column, Column, Column]:
    """Steps from a text to its weighted terms: sorted word hashes `_a`, starts of runs `_s`, (term, n) pairs.

    Each step has to be a column before the next refers to it; see `with_terms`.
    """
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    hashes = F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))
    a, s = F.col("_a"), F.col("_s")
    starts = F.when(F.size(a) > 0, F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1)))).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(s, lambda x, j: F.struct(F.get(a, x).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(a)) - x).alias("n")))
    return hashes, starts, pairs


def sample(k: int) -> Column:
    """Least-candidate value of sample k for term `_x` of log weight `_w`; see `signatures`.

    r, gamma-distributed, is the sum of two exponential variates, e1 = -ln u1 and e2 = -ln u2, of which b is the share of e2: so
    r and b are independent, and b uniform. With t = floor(ln S / r + b) = floor((ln S + e2) / r), the value c exp(-r (t - b + 1)) is
    c u1 exp(-r t). A term that comes once has t = 0, as b < 1, and takes the one logarithm of c.
    """
    h, g = F.xxhash64("_x", F.lit(k)), F.xxhash64("_x", F.lit(-1 - k))
    part = lambda x, at: F.shiftrightunsigned(x, at).bitwiseAND((1 << 32) - 1).cast("double") + 0.5
    # minus the logarithm of the product of two uniforms is a gamma variate of shape 2; a part is 2**32 times a uniform
    gamma = lambda x: 64 * math.log(2) - F.ln(part(x, 0) * part(x, 32))
    r, e2 = gamma(h), 32 * math.log(2) - F.ln(part(h, 32))
    shrunk = F.exp(-r * F.floor((F.col("_w") + e2) / r).cast("double"))
    return gamma(g) * part(h, 0) * F.when(F.col("_w") == 0, 1.0).otherwise(shrunk)


def signatures(texts: DataFrame, keys: list[str], text: str, samples: int = SAMPLES, carried: tuple[str, ...] = ()) -> DataFrame:
    """keys, the `carried` numbers, and `sig`, an array of integers, null for texts without words.

    Terms are words, their weights how often they come. For term x of weight S and sample k with r and c
    gamma-distributed and b uniform, all fixed by (x, k): t = floor(ln S / r + b), and the sample is the
    pair (x, t) of least c exp(-r (t - b) - r). That least value stands for the pair, as it is a function of
    both and of k; of it, 32 bits are kept. Two texts agree in a sample with a chance of their generalised Jaccard likeness.

    Terms are counted within the row and their minima combined before the one shuffle, of one row a text.
    """
    hashes, starts, pairs = terms(F.col(text))
    rows = texts.select(*keys, *carried, hashes.alias("_a")).withColumn("_s", starts).select(*keys, *carried, F.explode_outer(pairs).alias("_t"))
    rows = rows.select(*keys, *carried, F.col("_t.term").alias("_x"), F.ln(F.col("_t.n").cast("double")).alias("_w"))
    least = rows.groupBy(*keys).agg(*[F.min(sample(k)).alias(f"_{k}") for k in range(samples)], *[F.max(c).alias(c) for c in carried])
    sig = F.transform(F.array(*[f"_{k}" for k in range(samples)]), lambda v: F.hash(v))
    return least.select(*keys, *carried, F.when(F.col("_0").isNotNull(), sig).alias("sig"))


def hexed(sig: str) -> Column:
    """Fingerprint as text: 8 hex digits a sample, empty without words."""
    return F.coalesce(F.array_join(F.transform(sig, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), ""), F.lit(""))


def likeness(a: str, b: str) -> Column:
    """Share of equal samples; two texts without words are alike, one without is like no other."""
    same = F.aggregate(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), F.lit(0), lambda acc, p: acc + F.when(p["x"] == p["y"], 1).otherwise(0))
    return F.when(F.col(a).isNull() | F.col(b).isNull(), (F.col(a).isNull() & F.col(b).isNull()).cast("double")).otherwise(same / F.size(a))


def fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of neighbours.

    The edited text is the text with its last half replaced by the start of the next document's. Next is by
    descending doc_id; documents without doc_id come last, by hash of text; the first follows the last.
    Neighbours meet in blocks of at most BLOCK ids, dealt out by one shuffle of the texts; only the ends
    of blocks look up the next block's first text. So no step orders all texts in one task.

    Null texts count as empty. Rows that are equal in doc_id and text are one document in the order, and
    each is returned. Of texts under one doc_id, the order is by hash. Only doc_id and text are read.
    An empty table gives no rows; a document alone is its own next.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "cws")
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    base = base.withColumn("nul", F.col("doc_id").isNull()).withColumn("ord", F.coalesce("doc_id", "h"))
    low, high, n, n_null = base.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.count(F.when(F.col("nul"), 1))).first()
    # ids are distinct whole numbers, so a block as wide as this has no more of them than it should
    width = max(1, min(BLOCK, ((high or 0) - (low or 0) + 1) * BLOCK // max(n, 1) if n else 1)) if n else 1
    wide = 2**62 // max(1, n_null // BLOCK)
    base = base.withColumn("block", F.when(F.col("nul"), F.floor(F.col("ord") / F.lit(float(wide)))).otherwise(F.expr(f"floor(ord / {float(width)})")).cast("long"))

    # never false; said here once, as joins would say it for some of the branches below, which then could not share one exchange
    base = base.filter("nul is not null and block is not null and ord is not null and h is not null")

    line = Window.partitionBy("nul", "block").orderBy(F.desc("ord"), "h")
    fresh = base.withColumn("_seen", (F.lag("ord").over(line) == F.col("ord")) & (F.lag("h").over(line) == F.col("h"))).filter(~F.coalesce("_seen", F.lit(False))).drop("_seen")
    lines = fresh.withColumns({"n_text": F.lead("text").over(line), "n_nul": F.lead("nul").over(line), "n_ord": F.lead("ord").over(line), "n_h": F.lead("h").over(line), "_first": F.lag("ord").over(line).isNull()})
    # the order of the blocks: few enough for their own range partitions, a window within each, and one row a partition
    following = next_block(scratch, base.select("nul", "block").distinct())
    ends = lines.filter("n_ord is null").drop("n_text", "n_nul", "n_ord", "n_h").join(following, ["nul", "block"])
    heads = lines.filter("_first").select(F.col("nul").alias("n_nul"), F.col("block").alias("n_block"), F.col("ord").alias("n_ord"), F.col("h").alias("n_h"), F.col("text").alias("n_text"))
    ends = ends.join(heads, ["n_nul", "n_block"])
    cols = ["nul", "ord", "h", "text", "n_nul", "n_ord", "n_h", "n_text"]
    both = lines.filter("n_ord is not null").select(cols).unionByName(ends.select(cols))
    half = F.expr("cast(length(text) div 2 as int)")
    edited = F.concat(F.expr("left(text, cast(length(text) - length(text) div 2 as int))"), F.left("n_text", half))
    key, facts = ["nul", "ord", "h"], ["n_nul", "n_ord", "n_h", "n_chars", "_d0", "_d1", "_d2", "_d3"]
    both = both.withColumn("edited", edited).withColumn("_d", F.sha2("edited", 256))
    # everything a document has goes along as numbers with its one text, so that texts are shuffled once
    both = both.select(
        *key, F.col("n_nul").cast("int").alias("n_nul"), "n_ord", "n_h", F.length("text").cast("long").alias("n_chars"), *[F.conv(F.substring("_d", 16 * i + 1, 16), 16, -10).cast("long").alias(f"_d{i}") for i in range(4)],
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))).alias("_v"),
    ).select(*key, *facts, F.col("_v.which").alias("which"), F.col("_v.body").alias("body"))
    sigs = scratch.keep(signatures(both, [*key, "which"], "body", samples, tuple(facts)), "sigs", few=FILES_A_CORE)
    plain = sigs.filter("which = 0").select(*key, *facts, "sig").withColumn("n_nul", F.col("n_nul") == 1)
    out = plain.join(sigs.filter("which = 1").select(*key, F.col("sig").alias("sig_e")), key)
    out = out.join(plain.select(*[F.col(c).alias(f"n_{c}") for c in key], F.col("sig").alias("sig_n")), [f"n_{c}" for c in key])
    copies = base.groupBy(*key).count()
    out = out.join(copies, key).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    digest = F.lower(F.concat(*[F.lpad(F.hex(f"_d{i}"), 16, "0") for i in range(4)]))
    out = out.select(
        F.when(~F.col("nul"), F.col("ord")).alias("doc_id"), "n_chars", digest.alias("edited_sha256"), hexed("sig").alias("fingerprint"), hexed("sig_e").alias("edited_fingerprint"),
        likeness("sig", "sig_e").alias("near_edited"), likeness("sig", "sig_n").alias("near_next"),
    )
    return in_few_files(out)


def next_block(scratch: Scratch, blocks: DataFrame) -> DataFrame:
    """(nul, block, n_nul, n_block): the block that comes after each, the first after the last."""
    order = [F.asc("nul"), F.desc("block")]
    cut = scratch.keep(blocks.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "blocks", few=1)
    w = Window.partitionBy("_pid").orderBy(*order)
    inner = cut.withColumns({"n_nul": F.lead("nul").over(w), "n_block": F.lead("block").over(w)})
    over = Window.orderBy("_pid")
    tops = cut.groupBy("_pid").agg(F.min(F.struct("nul", (-F.col("block")).alias("b"))).alias("_top"))  # one row a partition
    tops = tops.withColumn("_next", F.coalesce(F.lead("_top").over(over), F.first("_top").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return inner.join(tops.select("_pid", "_next"), "_pid").select("nul", "block", F.coalesce("n_nul", "_next.nul").alias("n_nul"), F.coalesce("n_block", -F.col("_next.b")).alias("n_block"))
