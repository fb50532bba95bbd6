"""The trie of conversation prefixes and sums over its subtrees by centroid decomposition.

A node is a distinct sequence of first turns. Its key is the exclusive or of two 64-bit hashes of (place, turn) over these turns, so that
a running exclusive or along a conversation gives the keys of all its prefixes, each key and the turn's own hashes give the parent's, and
a conversation of any length can be cut into blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from specloom.llm.common import Scratch, ranged

#: Members below the top of a component that a task settles by itself.
PIECE = 32768
#: Ids that are written as one piece of text.
IDS = 512
PLACED = "k1 long, k2 long, c1 long, c2 long, p1 long, p2 long, depth long, w long, leaves long, saved long, a1 long, a2 long"


def turn_hash(i: int, place: str) -> F.Column:
    return F.xxhash64(F.lit(i), F.col(place).cast("long"), F.col("t1"), F.col("t2"))


def prefixes(scratch: Scratch, conversations: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, length, end1, end2: key of the last prefix) and prefixes (c, d, k1, k2, p1, p2, chars, length) after rebuilding."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    thin = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), part(1).alias("t1"), part(16).alias("t2"), F.char_length(text).cast("long").alias("chars")
    )
    blocks = ranged(scratch, thin, "turns", "c", "turn", "t1", "t2")
    runs = scratch.keep(blocks.groupBy("_pid", "c").agg(F.count(F.lit(1)).alias("n")), "runs")
    earlier = Window.partitionBy("c").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda *order: Window.partitionBy("_pid", "c").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # only the first conversation of a block can have begun before it, so carries are as few as blocks
    carried = F.broadcast(runs.withColumn("before", F.sum("n").over(earlier)).filter("before is not null").drop("n"))
    placed = blocks.withColumn("_at", F.count(F.lit(1)).over(upto("turn", "t1", "t2"))).join(carried, ["_pid", "c"], "left")
    placed = scratch.keep(placed.select("_pid", "c", (F.col("_at") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "chars"), "placed")

    along = Window.partitionBy("c").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = placed.filter(F.col("pos") < most).withColumns({f"h{i}": turn_hash(i, "pos") for i in (1, 2)})
    heads = heads.select(F.col("c").alias("base"), "pos", "chars", "h1", "h2", *[F.bit_xor(f"h{i}").over(along).alias(f"x{i}") for i in (1, 2)])
    heads = scratch.keep(heads, "heads")

    convs = runs.groupBy("c").agg(F.sum("n").alias("own")).withColumns({"base": F.col("c") - F.col("c") % group, "h": F.crc32(F.col("c").cast("string").cast("binary")) % most})
    convs = convs.join(convs.select(F.col("c").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = convs.withColumn("nb", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("length", F.col("nb") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    starts = heads.select("base", F.col("pos").alias("nb"), F.col("x1").alias("s1"), F.col("x2").alias("s2"))
    convs = convs.join(starts, ["base", "nb"], "left").select("c", "base", "h", "nb", "length", *[F.coalesce(f"s{i}", F.lit(0)).alias(f"s{i}") for i in (1, 2)])
    convs = scratch.keep(convs, "convs")

    shared = convs.join(heads, (convs["base"] == heads["base"]) & (heads["pos"] <= convs["nb"])).select(
        "c", F.col("pos").alias("d"), F.col("x1").alias("k1"), F.col("x2").alias("k2"), *[F.col(f"x{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"p{i}") for i in (1, 2)], "chars", "length"
    )
    own = placed.join(runs.join(convs, "c").drop("n", "base"), ["_pid", "c"]).filter("pos > h").withColumn("d", F.col("nb") + F.col("pos") - F.col("h"))
    own = own.withColumns({f"h{i}": turn_hash(i, "d") for i in (1, 2)})
    own = own.withColumns({f"y{i}": F.bit_xor(f"h{i}").over(upto("d")).bitwiseXOR(F.col(f"s{i}")) for i in (1, 2)})
    own = scratch.keep(own.select("_pid", "c", "d", "h1", "h2", "y1", "y2", "chars", "length"), "own")
    sums = own.groupBy("_pid", "c").agg(*[F.bit_xor(f"h{i}").alias(f"h{i}") for i in (1, 2)])
    over = F.broadcast(sums.select("_pid", "c", *[F.bit_xor(f"h{i}").over(earlier).alias(f"z{i}") for i in (1, 2)]).filter("z1 is not null"))
    own = own.join(over, ["_pid", "c"], "left").withColumns({f"k{i}": F.col(f"y{i}").bitwiseXOR(F.coalesce(f"z{i}", F.lit(0))) for i in (1, 2)})
    own = own.select("c", "d", "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"p{i}") for i in (1, 2)], "chars", "length")
    return convs.select("c", "length"), scratch.keep(shared.unionByName(own), "prefixes")


def node_table(scratch: Scratch, convs: DataFrame, paths: DataFrame) -> DataFrame:
    """Key, parent's key, depth, conv_id, parent_conv_id, n_convs, n_children, own leaves and saved_tokens of a node, and w: the members of
    all nodes of its subtree."""
    nodes = paths.groupBy("k1", "k2").agg(
        *[F.min(x).alias(y) for x, y in (("p1", "p1"), ("p2", "p2"), ("d", "depth"), ("c", "conv_id"), ("chars", "chars"))],
        F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") - F.col("d") + 1).alias("w"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") + 1).alias("w")).filter("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("depth"), "conv_id", zero.alias("chars"), "n_convs", "w")
    nodes = scratch.keep(nodes.select(root.columns).unionByName(root), "nodes")
    children = nodes.filter("p1 is not null").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "n_children")
    nodes = nodes.join(children, ["k1", "k2"], "left").fillna(0, ["n_children"])
    nodes = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}).drop("chars")
    nodes = scratch.keep(nodes, "counted")
    parents = nodes.filter("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # the root's children, which may be most nodes, need one row
    top = F.broadcast(nodes.filter("depth = 0").select(F.col("conv_id").alias("_top")))
    low = nodes.filter("depth < 2").join(top).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.col("_top"))).drop("_top")
    return scratch.keep(low.unionByName(nodes.filter("depth > 1").join(parents, ["p1", "p2"])), "tree")


def rollup(scratch: Scratch, nodes: DataFrame, paths: DataFrame, piece: int = PIECE) -> DataFrame:
    """k1, k2, and the sums of leaves and saved over each node's subtree.

    Every component has the members of the nodes below each node (w). Its centroid is the lowest node with half of them. The centroid's
    subtree is summed up once; the centroid and all nodes on its path to the component's top, which `paths` lists for its conversation, add that sum,
    and w shrinks along the path. What hangs on the centroid become components of their own, with half the members at most, so the rounds are as many as the
    logarithm of the members over `piece`, however deep or wide the trie is. Components of `piece` members or fewer are settled in tasks by the same
    steps. Those that are larger are disjoint, so their list is short; joins to it and to paths split where one component has most nodes.
    """
    state = nodes.select("k1", "k2", "p1", "p2", "depth", "conv_id", "w", "leaves", "saved", *[F.lit(0).cast("long").alias(x) for x in ("c1", "c2", "a1", "a2")])
    branch = paths.select(F.col("c").alias("conv_id"), (F.col("d") - 1).alias("md"), F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    settled, small, turn = [], [], 0
    while True:
        large = scratch.keep(state.groupBy("c1", "c2").agg(F.max("w").alias("total")).filter(F.col("total") > piece), f"large{turn}")
        small.append(state.join(large, ["c1", "c2"], "left_anti"))
        if not large.limit(1).count():
            break
        half = state.join(large, ["c1", "c2"]).filter("2 * w >= total")
        centroids = half.groupBy("c1", "c2").agg(F.min_by(F.struct("k1", "k2", "depth", "conv_id", "w"), "w").alias("m"))
        centroids = scratch.keep(centroids.select("c1", "c2", F.col("m.k1").alias("m1"), F.col("m.k2").alias("m2"), F.col("m.depth").alias("md"), F.col("m.conv_id").alias("mc"), F.col("m.w").alias("mw")), f"centroids{turn}")
        path = centroids.join(paths, (F.col("mc") == paths["c"]) & (paths["d"] < F.col("md"))).select("k1", "k2", "c1", "c2")
        top = centroids.filter("c1 = 0 and c2 = 0 and md > 0").select("c1", "c2", F.col("c1").alias("k1"), F.col("c2").alias("k2"))
        path = path.unionByName(top).withColumn("above", F.lit(True))
        seen = state.join(centroids, ["c1", "c2"]).join(branch, ["conv_id", "md"], "left").join(path, ["k1", "k2", "c1", "c2"], "left")
        centre = (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2"))
        below = F.coalesce((F.col("depth") > F.col("md")) & (F.col("q1") == F.col("m1")) & (F.col("q2") == F.col("m2")), F.lit(False))
        seen = scratch.keep(seen.select(*state.columns, "mw", "b1", "b2", centre.alias("centre"), below.alias("below"), F.coalesce("above", F.lit(False)).alias("above")), f"seen{turn}")
        totals = scratch.keep(seen.filter("below or centre").groupBy("c1", "c2").agg(F.sum("leaves").alias("s1"), F.sum("saved").alias("s2")), f"totals{turn}")
        adds = F.col("above") | F.col("centre")
        moved = seen.join(totals, ["c1", "c2"]).select(
            "k1", "k2", "p1", "p2", "depth", "conv_id", F.when(F.col("above"), F.col("w") - F.col("mw")).otherwise(F.col("w")).alias("w"), "leaves", "saved",
            *[F.when(F.col("below"), F.col(f"b{i}")).otherwise(F.col(f"c{i}")).alias(f"c{i}") for i in (1, 2)],
            *[(F.col(f"a{i}") + F.when(adds, F.col(f"s{i}")).otherwise(0)).alias(f"a{i}") for i in (1, 2)], "centre",
        )
        moved = scratch.keep(moved, f"moved{turn}")
        settled.append(moved.filter("centre").select("k1", "k2", "a1", "a2"))
        state, turn = moved.filter("not centre").drop("centre"), turn + 1
    rest = small[0]
    for df in small[1:]:
        rest = rest.unionByName(df)
    order = PLACED.replace(" long", "").split(", ")
    rest = rest.select(order).repartition("c1", "c2").sortWithinPartitions("c1", "c2")
    out = rest.mapInArrow(settle(piece), "k1 long, k2 long, a1 long, a2 long")
    for df in settled:
        out = out.unionByName(df)
    return out


def settle(piece: int):
    """Batches of rows, sorted by component, to the sums of their nodes; whole components are held until they have `piece` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def flush(whole: bool):
            cols = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            last = (cols["c1"] != cols["c1"][-1]) | (cols["c2"] != cols["c2"][-1])
            cut = len(last) if whole else int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            held[:] = [{n: v[cut:] for n, v in cols.items()}] if cut < len(last) else []
            return {n: v[:cut] for n, v in cols.items()}

        for batch in batches:
            if batch.num_rows:
                # the root has no parent: its key stands for none, as nothing lies above it
                held.append({n: c.fill_null(0).to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)})
            if sum(len(h["k1"]) for h in held) >= piece:
                ready = flush(False)
                if len(ready["k1"]):
                    yield decomposed(ready)
        if held:
            yield decomposed(flush(True))

    return run


def decomposed(t: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Centroid decomposition of all components of a table at once."""
    n = len(t["k1"])
    at = {k: i for i, k in enumerate(zip(t["k1"].tolist(), t["k2"].tolist(), strict=True))}
    parent = np.array([-1 if d == 0 else at.get(p, -1) for p, d in zip(zip(t["p1"].tolist(), t["p2"].tolist(), strict=True), t["depth"].tolist(), strict=True)], np.int64)
    kids: list[list[int]] = [[] for _ in range(n)]
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            kids[p].append(i)
    pre, end, clock = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for top in np.flatnonzero(parent < 0).tolist():
        stack = [top]
        while stack:  # ~i: all below i has been numbered
            i = stack.pop()
            if i < 0:
                end[~i] = clock
                continue
            pre[i], clock = clock, clock + 1
            stack.append(~i)
            stack.extend(kids[i])
    label = np.unique(np.stack([t["c1"], t["c2"]]), axis=1, return_inverse=True)[1].ravel().astype(np.int64)
    w, a = t["w"].copy(), np.stack([t["a1"], t["a2"]])
    own, live = np.stack([t["leaves"], t["saved"]]), np.arange(n)
    while len(live):
        names, lab = np.unique(label[live], return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.maximum.at(total, lab, w[live])
        half = np.flatnonzero(2 * w[live] >= total[lab])
        half = half[np.lexsort((w[live[half]], lab[half]))]
        centre = live[half[np.unique(lab[half], return_index=True)[1]]]  # one a label, in their order
        under = (pre[live] >= pre[centre[lab]]) & (pre[live] < end[centre[lab]])
        sums = np.zeros((2, len(names)), np.int64)
        for s, v in zip(sums, own, strict=True):
            np.add.at(s, lab[under], v[live[under]])
        a[:, centre] += sums
        cur, owner, weight = parent[centre], np.arange(len(names)), w[centre].copy()
        while len(cur):  # all paths go up a step
            on = cur >= 0
            on[on] = label[cur[on]] == names[owner[on]]
            cur, owner = cur[on], owner[on]
            a[:, cur] += sums[:, owner]
            w[cur] -= weight[owner]
            cur = parent[cur]
        label[centre] = -1
        below = under & (live != centre[lab])
        first = below & (parent[live] == centre[lab])  # tops of the new components
        starts = np.sort(lab[first] * n + pre[live[first]])
        fresh = np.searchsorted(starts, lab[below] * n + pre[live[below]], side="right")
        label[live[below]] = label.max() + fresh
        live = live[live != centre[lab]]
    return pa.RecordBatch.from_arrays([pa.array(t["k1"]), pa.array(t["k2"]), pa.array(a[0]), pa.array(a[1])], names=["k1", "k2", "a1", "a2"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending decimal ids of each key. A hash takes its input in order, so pieces of text are made in parallel, and
    one task streams those of a key, 512 ids a row, without holding them."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, k1, k2, c = [], *(batch.column(n).to_pylist() for n in ("k1", "k2", "c"))
            i = 0
            while i < len(c):
                j = i + 1
                while j < len(c) and j - i < IDS and k1[j] == k1[i] and k2[j] == k2[i]:
                    j += 1
                out.append((k1[i], k2[i], c[i], ",".join(map(str, c[i:j]))))
                i = j
            cols = [[r[x] for r in out] for x in range(4)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string())], names=["k1", "k2", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if key != (row["k1"], row["k2"]):
                    if key:
                        out.append({"k1": key[0], "k2": key[1], "ends_sha256": sha.hexdigest()})
                    key, sha = (row["k1"], row["k2"]), hashlib.sha256(row["ids"].encode())
                else:
                    sha.update(f",{row['ids']}".encode())
            yield pa.RecordBatch.from_pylist(out, HASHED)
        if key:
            yield pa.RecordBatch.from_pylist([{"k1": key[0], "k2": key[1], "ends_sha256": sha.hexdigest()}], HASHED)

    sorted_ends = ends.repartitionByRange("k1", "k2", "c").sortWithinPartitions("k1", "k2", "c")
    texts = sorted_ends.mapInArrow(pieces, "k1 long, k2 long, first long, ids string")
    return texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hashes, "k1 long, k2 long, ends_sha256 string")


HASHED = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def prefix_trie(conversations: DataFrame, group: int = 100, most: int = 6, piece: int = PIECE) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, and those of one turn number by a hash of role and text, so that the order of rows does not
    count. A null role or text is empty. Rows without conv_id belong to no conversation. Repeated rows are turns each. Conversations and texts may be of any
    length; equal conversations, however many, and wide nodes are counted by partial sums. Sequences are told apart by 128 bits of hash. Only
    conv_id, turn, role and text are read. An empty table gives no rows, not even a root.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    convs, paths = prefixes(scratch, conversations.select("conv_id", "turn", "role", "text"), group, most)
    nodes = node_table(scratch, convs, paths)
    zero = F.lit(0).cast("long")
    ends = paths.filter("d = length").select("k1", "k2", "c").unionByName(convs.filter("length = 0").select(zero.alias("k1"), zero.alias("k2"), "c"))
    sums = rollup(scratch, nodes, paths, piece)
    return (
        nodes.join(sums, ["k1", "k2"])
        .join(end_hashes(ends), ["k1", "k2"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("a1").alias("n_leaves"), F.col("a2").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
    )
