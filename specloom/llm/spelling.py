"""Spelling variants by a dictionary of pairs of trie nodes.

The nodes of two tries are numbered: of the words, and of the words read backwards. A word without its code point i is the pair (node of
the prefix before i, node of the suffix after i); a whole word is such a pair at each of its cuts. Equal pairs are equal strings, so
words that differ by one replaced code point meet at the pair that skips it, and one that lacks a code point of another meets, whole,
that other's pair. At a pair meet as many words as code points can stand in one place, and a whole word, so nothing there can grow with the data.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import Scratch, ranged

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 18


def runs(text: str, least: int) -> list[str]:
    """Maximal runs of `[A-Za-z\\u00C0-\\u00FF]` of `least` code points or more, A-Z in lower case."""
    return re.findall(rf"[a-zÀ-ÿ]{{{least},}}", text.translate(LOWER))


def count_words(docs: DataFrame, least: int, every: int) -> DataFrame:
    """word and n, the occurrences after edits, of words of `least` code points; shorter runs cannot become such."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lead = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(runs(text.as_py() or "", least)).items():
                    h = zlib.crc32(run.encode(), lead)
                    if h % every == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) >= least:
                        seen[run] += n
                if len(seen) >= COUNTED:
                    yield flush()
        yield flush()

    counts = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def shared(a: str, b: str) -> int:
    """Code points that both begin with."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def number_nodes(scratch: Scratch, words: DataFrame, name: str, backwards: bool) -> DataFrame:
    """word, n, at (its place in the order, a number that grows with it), nodes: the number of each prefix, from the empty one to the word,
    and fresh: whether each code point differs from the one before.

    Words are cut into blocks along their order. A prefix within one block has the block's number and a count; one that reaches
    over an edge between blocks is named by the first such edge and its length. So a task needs, besides its block, only how much the words at
    each edge share: one number a block.
    """
    blocks = ranged(scratch, words.withColumn("_key", F.reverse("word") if backwards else F.col("word")), name, "_key")
    ends = [tuple(r) for r in blocks.groupBy("_pid").agg(F.min("_key"), F.max("_key")).orderBy("_pid").collect()]
    place = {pid: i for i, (pid, _, _) in enumerate(ends)}
    edges = [shared(a, b) for (_, _, a), (_, b, _) in zip(ends, ends[1:], strict=False)]  # edge i lies before block i + 1

    def over(edge: int, d: int) -> int:
        """The number of the prefix of length d that reaches over an edge."""
        while edge > 0 and edges[edge - 1] >= d and shared(ends[edge][1], ends[edge][2]) >= d:
            edge -= 1
        return -((edge + 1) << 32) - d

    def number(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        k = place[int(key[0])]
        block = block.sort_values("_key", key=lambda s: s.map(lambda w: w.encode("utf-32-be")), kind="stable")
        first, last = ends[k][1], ends[k][2]
        left, right = edges[k - 1] if k else 0, edges[k] if k < len(edges) else 0
        before, nodes, fresh, out = None, [0], 0, []
        for word in block["_key"].tolist():
            d = 0 if before is None else shared(before, word)
            nodes = nodes[: d + 1]
            tail = shared(last, word) if right else 0
            for depth in range(d + 1, len(word) + 1):
                if before is None and depth <= left:
                    nodes.append(over(k - 1, depth))
                elif depth <= right and depth <= tail:
                    nodes.append(over(k, depth))
                else:
                    fresh += 1
                    nodes.append(((k + 1) << 40) + fresh)
            out.append(np.array(nodes, np.int64))
            before = word
        at = (np.int64(k) << 40) + np.arange(len(block), dtype=np.int64)
        fresh_at = [np.array([True, *(a != b for a, b in zip(w, w[1:], strict=False))], bool) for w in block["_key"].tolist()]
        return pd.DataFrame({"word": block["word"], "n": block["n"], "at": at, "nodes": out, "fresh": fresh_at})

    return blocks.groupBy("_pid").applyInPandas(number, "word string, n long, at long, nodes array<long>, fresh array<boolean>")


def neighbours(scratch: Scratch, words: DataFrame) -> DataFrame:
    """word, n, at, n_near, and near_n and near_at of its most frequent near word (ties: the least at) for distinct words (word, n).

    Null words have no place here. Repeated words have to be added up before.
    """
    ahead = number_nodes(scratch, words, "ahead", False)
    back = number_nodes(scratch, words, "back", True).select("word", F.reverse("nodes").alias("ends"))
    both = scratch.keep(ahead.join(back, "word").select("word", "n", "at", "nodes", "fresh", "ends"), "nodes")
    # of equal code points side by side, skipping any gives the same string: the first stands for all where lengths differ
    size = F.size("nodes")
    skips = F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.struct(
        F.get("nodes", i).alias("p"), F.get("ends", i + 1).alias("s"), F.get("fresh", i).cast("int").alias("kind")))
    whole = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(F.get("nodes", i).alias("p"), F.get("ends", i).alias("s"), F.lit(2).alias("kind")))
    pairs = both.filter(size > 1).select("n", "at", F.inline(F.concat(skips, whole)))
    met = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("n", (-F.col("at")).alias("m"), "kind")).alias("met")).filter(F.size("met") > 1)
    apart = met.select(*[F.reverse(F.array_sort(F.filter("met", keep))).alias(name) for name, keep in (("skip", lambda x: x["kind"] < 2), ("one", lambda x: x["kind"] == 1), ("whole", lambda x: x["kind"] == 2))])
    # met words in falling order of n, then rising at; a word's best is the first that is not itself
    none = F.lit(None).cast("struct<n:long,m:long,kind:int>")
    skipper = lambda x: F.struct(
        x["m"].alias("m"), (F.size("skip") - 1 + F.when((x["kind"] == 1) & (F.size("whole") > 0), 1).otherwise(0)).cast("long").alias("near"),
        F.greatest(F.when(F.get("skip", F.lit(0))["m"] == x["m"], F.get("skip", F.lit(1))).otherwise(F.get("skip", F.lit(0))), F.when(x["kind"] == 1, F.get("whole", F.lit(0))).otherwise(none)).alias("best"))
    holder = lambda x: F.struct(x["m"].alias("m"), F.size("one").cast("long").alias("near"), F.get("one", F.lit(0)).alias("best"))
    found = apart.select(F.inline(F.concat(F.transform("skip", skipper), F.transform("whole", holder)))).filter("near > 0")
    found = found.groupBy("m").agg(F.sum("near").alias("n_near"), F.max(F.struct("best.n", "best.m")).alias("best"))
    found = found.select((-F.col("m")).alias("at"), "n_near", F.col("best.n").alias("near_n"), (-F.col("best.m")).alias("near_at"))
    return both.select("word", "n", "at").join(found, "at", "left").fillna(0, ["n_near"])


def variants(docs: DataFrame, least: int = 6, often: int = 5, every: int = 199, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of `least` code points and `often` occurrences.

    A form is the near word of largest n, the first in code-point order among equals, where it has `ratio` times the word's n; root is where
    the forms lead. A null text has no words, a null doc_id hashes as no digits. Texts of any length are read whole; repeated rows count each, and words may
    be of any length. Only doc_id and text are read. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(count_words(docs, least, every).filter(F.col("n") >= often), "words")
    near = scratch.keep(neighbours(scratch, words), "near")
    formed = F.when(F.col("near_n") >= F.col("n") * ratio, F.col("near_at"))
    named = near.select("word", "n", "at", "n_near", formed.alias("form_at"), F.when(formed.isNotNull(), F.col("near_n")).alias("form_n"))
    # pointers jump twice as far each round; n grows along a chain by the ratio, so rounds are few
    chain, turn = scratch.keep(named.filter("form_at is not null").select("at", F.col("form_at").alias("root_at")), "chain0"), 0
    while True:
        turn += 1
        jump = chain.select(F.col("at").alias("root_at"), F.col("root_at").alias("far"))
        chain = scratch.keep(chain.join(jump, "root_at", "left").select("at", F.coalesce("far", "root_at").alias("root_at"), F.col("far").isNotNull().alias("moved")), f"chain{turn}")
        if not chain.filter("moved").limit(1).count():
            break
        chain = chain.drop("moved")
    forms = near.select(F.col("at").alias("form_at"), F.col("word").alias("form"))
    roots = near.select(F.col("at").alias("root_at"), F.col("word").alias("_root"))
    varied = named.filter("form_at is not null").join(forms, "form_at").join(chain.drop("moved"), "at").join(roots, "root_at")
    plain = named.filter("form_at is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return plain.unionByName(varied.select("word", "form", F.col("_root").alias("root"), "n", "n_near", "form_n"))
