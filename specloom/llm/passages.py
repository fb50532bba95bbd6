"""Passages that documents share: the exact search for equal windows of a fixed length, shard by shard.

A window is `length` consecutive symbols (words or bytes) of one document. Every window has a key, the least
hash of the `gram` symbol runs inside it, so equal windows have equal keys, and neighbours mostly share
theirs: a run is a row of neighbouring windows of one key, and its context the symbols under it.

1. Keys that occur in one document alone can't be shared and go; this loses no window. Keys travel in blocks, one row for
   thousands of them, and a batch sends a key that two of its documents have once, however frequent it is.
2. The contexts of the runs that stay are cut out of the texts.
3. They are dealt to shards of bounded size by key. There equal contexts become one, owned by the least doc_id, and each shard finds,
   by the operator's own method, the least owner of every window. Where the contexts of one key don't fit a shard, equal ones become
   one before they are dealt, and if that is not enough they are dealt window by window.
4. A document loses the windows whose least owner comes before it. Nothing is removed that the method has not found.

Contexts are told apart by two 64-bit hashes, of the context and of its key run. Texts move twice; shuffle files go as
soon as their step is written. Every step is a grouping of bounded size, a hash aggregation or an equi-join that adaptive
execution can split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import Scratch
from specloom.llm.symbols import CHUNK_BYTES, INV, MUL, mix, offsets, powers, sliding_min, starts_of_windows, window_hash


@dataclass(frozen=True)
class Passages:
    """length, gram: of windows and of the runs whose hashes make keys. symbols: texts to their symbols, of which slices are contexts, and
    the counts. grams: hashes of the runs from each symbol on. numbers: symbols to 64-bit numbers. unit: type of a symbol. search: the units of contexts, joined, their sizes and
    owners to the least owner of each window. part_bytes: of contexts in a shard on average, which is as much as fits a processor's
    cache. shard_bytes: of contexts of one key that a shard may take. fan_out: slices of the keys' range to which a task sends at once."""

    length: int
    gram: int
    symbols: Callable
    grams: Callable
    numbers: Callable
    unit: type
    search: Callable
    shard_bytes: int = 1 << 20
    part_bytes: int = 1 << 16
    fan_out: int = 1024


#: Windows of a run at most; a longer one, as of one symbol over and over, is cut.
LONGEST_RUN = 64
#: Symbols whose runs are made at once, as many as keep to a processor's cache.
RUN_SYMBOLS = 1 << 16
#: Bytes of a context besides its symbols; and in how many rounds contexts are dealt, of which each has its shuffle files on disk alone.
ROW_BYTES, ROUNDS = 40, 2
#: Keys that a task gathers before it sends them, bytes of text for a block of keys, and for the documents that meet their keys.
GATHERED, SLICE_BYTES, BUCKET_BYTES = 1 << 21, 1 << 24, 1 << 22


def runs_of(symbols: np.ndarray, counts: np.ndarray, p: Passages) -> tuple[np.ndarray, ...]:
    """Document, start, number of windows and key of every run."""
    at = offsets(counts)
    found = []
    for x in parts(counts, RUN_SYMBOLS):
        doc, *rest = runs_at_once(symbols[at[x.start] : at[x.stop]], counts[x], p)
        found.append((doc + x.start, *rest))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_at_once(symbols: np.ndarray, counts: np.ndarray, p: Passages) -> tuple[np.ndarray, ...]:
    first, windows = offsets(counts)[:-1], counts - p.length + 1
    some = windows > 0
    if not some.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    key = sliding_min(p.grams(symbols, p.gram), p.length - p.gram + 1)[: len(symbols) - p.length + 1]
    # a run ends where the key changes, and with the windows of its document
    new = np.ones(len(key) + 1, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:-1])
    new[first[some]] = True
    new[(first + windows)[some]] = True
    cuts = np.flatnonzero(new)
    start, n = cuts[:-1], np.diff(cuts)
    doc = np.searchsorted(first, start, side="right") - 1
    within = start - first[doc] < windows[doc]
    doc, start, n = doc[within], start[within], n[within]
    if n.max() > LONGEST_RUN:
        pieces = -(-n // LONGEST_RUN)
        done = LONGEST_RUN * (np.arange(pieces.sum()) - np.repeat(offsets(pieces)[:-1], pieces))
        doc, start, n = np.repeat(doc, pieces), np.repeat(start, pieces) + done, np.minimum(LONGEST_RUN, np.repeat(n, pieces) - done)
    return doc, start - first[doc], n, mix(key[start])  # least hashes are small numbers: mixed, they spread evenly


def parts(sizes: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of rows with about `limit` bytes each."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes + 16) // limit)) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, len(sizes)), strict=True):
        if b > a:
            yield slice(int(a), int(b))


def sizes_of(raw: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, raw), np.int64, len(raw))


def bucket_of(doc: Column, buckets: int) -> Column:
    return F.pmod(doc.bitwiseXOR(F.shiftrightunsigned(doc, 32)), F.lit(buckets)).cast("int")


def owned(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One number for a key in a document."""
    return key ^ mix(doc.astype(np.uint64))


BLOCKS = pa.schema([("kind", pa.int32()), ("place", pa.int32()), ("key", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def to_buckets(key: np.ndarray, doc: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Blocks of shared keys for the buckets of their documents."""
    place = ((doc ^ (doc.astype(np.uint64) >> np.uint64(32)).astype(np.int64)) % buckets).astype(np.int32)
    own = owned(key, doc)
    order = np.lexsort((own, place))
    place, own = place[order], own[order]
    cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, np.int64)
    blocks = [np.unique(own[a:b]).tobytes() for a, b in zip(cuts, np.append(cuts, len(own))[1:], strict=True)]
    none = pa.nulls(len(cuts), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.ones(len(cuts), np.int32)), pa.array(place[cuts]), pa.array(blocks, pa.binary()), none, none], schema=BLOCKS)


def to_slices(key: np.ndarray, low: np.ndarray, high: np.ndarray | None, slices: int) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted keys by slice of their range, of which as many are walked as hold keys; without high, low says it all."""
    place = (key >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    at = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(key) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(key))[: len(at)]
    columns = [pa.nulls(len(at), pa.binary()) if x is None else pa.array([x[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary()) for x in (key, low, high)]
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int32)), pa.array(place[at].astype(np.int32)), *columns], schema=BLOCKS)


def finer(blocks: DataFrame, slices: int) -> DataFrame:
    """Blocks of kind 0, dealt to few wide slices, by narrow ones: each task gathers what came to a wide slice before it cuts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def send() -> Iterator[pa.RecordBatch]:
            key, low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(key)
            yield from to_slices(key[order], low[order], high[order], slices)
            held.clear()

        for batch in batches:
            for key, low, high in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high")), strict=True):
                one = np.frombuffer(low, np.int64)
                held.append((np.frombuffer(key, np.uint64), one, one if high is None else np.frombuffer(high, np.int64)))
                rows += len(one)
            if rows > GATHERED:
                yield from send()
                rows = 0
        if held:
            yield from send()

    wide = blocks.filter("kind = 0").repartition("place").sortWithinPartitions("place")
    return wide.mapInArrow(run, "kind int, place int, key binary, low binary, high binary").unionByName(blocks.filter("kind = 1"))


def key_blocks(docs: DataFrame, p: Passages, slices: int, buckets: int) -> DataFrame:
    """Blocks of keys by slice (kind 0: key, least and greatest document of what a task gathered), and by bucket those known to be shared (kind 1)."""

    def send(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        low, high = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
        many = low < high
        yield from to_slices(key[first][~many], low[~many], None, slices)
        yield from to_slices(key[first][many], low[many], high[many], slices)
        if many.any():
            each = np.repeat(many, np.diff(np.append(first, len(key))))
            yield to_buckets(key[each], doc[each], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = [], 0
        for batch in batches:
            text, ids = batch.column("text"), batch.column("doc_id").to_numpy(zero_copy_only=False)
            for part in parts(lengths(text)):
                doc, _, _, key = runs_of(*p.symbols(text.slice(part.start, part.stop - part.start).to_pylist()), p)
                if len(key):
                    found.append((key, ids[part][doc]))
                    rows += len(key)
                if rows > GATHERED:
                    yield from send(found)
                    found, rows = [], 0
        if found:
            yield from send(found)

    return docs.select("doc_id", F.encode("text", "utf-8").alias("text")).mapInArrow(run, "kind int, place int, key binary, low binary, high binary")


def lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def shared_blocks(blocks: DataFrame, buckets: int) -> DataFrame:
    """Blocks by bucket of the keys that two documents have which no task met together."""

    def flat(table: pa.Table, name: str, kind: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    def find(table: pa.Table) -> pa.Table:
        table = table.set_column(table.schema.get_field_index("high"), "high", pc.coalesce(table.column("high"), table.column("low")))
        key, low, high = flat(table, "key", np.uint64), flat(table, "low", np.int64), flat(table, "high", np.int64)
        order = np.argsort(key)
        key, low, high = key[order], low[order], high[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        shared = np.minimum.reduceat(low, first) < np.maximum.reduceat(high, first)
        # those that a task knew to be shared are with their buckets already
        wanted = np.repeat(shared, np.diff(np.append(first, len(key)))) & (low == high)
        return pa.Table.from_batches([to_buckets(key[wanted], low[wanted], buckets)], schema=BLOCKS)

    return blocks.filter("kind = 0").groupBy("place").applyInArrow(find, "kind int, place int, key binary, low binary, high binary")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text) and the text's bytes."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("h"), F.encode(text, "utf-8").alias("text"))


CONTEXTS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("top", pa.int64()), ("units", pa.binary())])


def contexts(texts: DataFrame, blocks: DataFrame, p: Passages, buckets: int) -> DataFrame:
    """The runs of shared keys in each text, with the hash of their contexts: doc_id, h, start, n, key, id, top, units.

    Of equal contexts in one part of a bucket, that of the least document has the units, and the greatest document as top; the others have null units.
    """

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.unique(np.frombuffer(b"".join(right.column("key").to_pylist()), np.uint64))
        left = left.combine_chunks().sort_by("doc_id")
        ids, hs = left.column("doc_id").to_numpy(), left.column("h").to_numpy()
        text = left.column("text").combine_chunks()
        out = []
        for part in parts(lengths(text)) if len(known) else ():
            raw = text.slice(part.start, part.stop - part.start).to_pylist()
            symbols, counts = p.symbols(raw)
            doc, start, n, key = runs_of(symbols, counts, p)
            own = owned(key, ids[part][doc])
            pick = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
            if not len(pick):
                continue
            doc, start, n, key = doc[pick], start[pick], n[pick], key[pick]
            a = offsets(counts)[doc] + start
            size = n + p.length - 1
            ident = prefix_hash(p.numbers(symbols), a, size)
            order = np.lexsort((ident, key))  # stable, and documents ascend
            speaks = np.zeros(len(doc), bool)
            speaks[order] = np.append(True, (key[order][1:] != key[order][:-1]) | (ident[order][1:] != ident[order][:-1]))
            mine, top = ids[part][doc], np.zeros(len(doc), np.int64)
            first = np.flatnonzero(speaks[order])
            top[order[first]] = mine[order[np.append(first[1:], len(doc)) - 1]]
            width, units = np.dtype(p.unit).itemsize, symbols.tobytes()
            cuts = [units[x:y] if s else None for x, y, s in zip((a * width).tolist(), ((a + size) * width).tolist(), speaks.tolist(), strict=True)]
            columns = [mine, hs[part][doc], start.astype(np.int32), n.astype(np.int32), key.view(np.int64), ident.view(np.int64), top]
            out.append(pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(cuts, pa.binary())], schema=CONTEXTS))
        return pa.Table.from_batches(out, schema=CONTEXTS)

    texts = texts.withColumn("place", bucket_of(F.col("doc_id"), buckets))
    return texts.groupBy("place").cogroup(blocks.select("place", "key").groupBy("place")).applyInArrow(cut, "doc_id long, h long, start int, n int, key long, id long, top long, units binary")


def prefix_hash(symbols: np.ndarray, a: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of symbols[a : a + size] for arrays of starts and sizes."""
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(MUL, len(symbols)), out=sums[1:])
    return mix((sums[a + size] - sums[a]) * powers(INV, len(symbols) + 1)[a] + size.astype(np.uint64))


MARKS = "key long, id long, at array<int>, owner array<long>, low long"
MARKED = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("at", pa.list_(pa.int32())), ("owner", pa.list_(pa.int64())), ("low", pa.int64())])
SPANS = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("span", pa.int64())])


def searched(raw: list[bytes], low: np.ndarray, high: np.ndarray, p: Passages) -> tuple[np.ndarray, ...]:
    """Pieces of the distinct contexts of a shard whose windows have one least owner: context, first window, end, owner.

    A context that several documents have is there twice, once as the least document's and once as the greatest's, and what is told is what the
    search finds for the latter: if it found no match, these windows would be the greatest document's own, and nobody would lose them.
    """
    twice = np.flatnonzero(high > low)
    both = raw + [raw[i] for i in twice.tolist()]
    sizes = sizes_of(both) // np.dtype(p.unit).itemsize
    found = p.search(np.frombuffer(b"".join(both), p.unit), sizes, np.concatenate((low, high[twice])), p.length)
    n = sizes - p.length + 1
    speaks = np.arange(len(raw))
    speaks[twice] = len(raw) + np.arange(len(twice))
    base = offsets(n[: len(raw)])
    least = found[np.arange(base[-1]) + np.repeat(offsets(n)[speaks] - base[:-1], n[: len(raw)])]
    new = np.append(True, least[1:] != least[:-1])
    new[base[:-1]] = True
    cut = np.flatnonzero(new)
    which = np.searchsorted(base, cut, side="right") - 1
    return which, cut - base[which], np.append(cut[1:], base[-1]) - base[which], least[cut]


def least_owners(distinct: DataFrame, p: Passages, shards: int) -> DataFrame:
    """For each distinct context the least owner of its windows: from window at[i] on it is owner[i]; low is the least of all."""

    def find(table: pa.Table) -> pa.Table:
        which, at, _, owner = searched(table.column("units").to_pylist(), table.column("owner").to_numpy(), table.column("other").to_numpy(), p)
        cuts = np.searchsorted(which, np.arange(len(table) + 1))
        ends = pa.array(cuts.astype(np.int32))
        columns = [pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(owner))]
        return pa.Table.from_arrays([table.column("key"), table.column("id"), *columns, pa.array(np.minimum.reduceat(owner, cuts[:-1]))], schema=MARKED)

    dealt = distinct.select(F.pmod(F.xxhash64("key", "part"), F.lit(shards)).alias("shard"), "key", "id", "owner", "other", "units")
    return dealt.groupBy("shard").applyInArrow(find, MARKS)


def packed_span(start: Column, end: Column) -> Column:
    """One number for a span: its first window's place, and where it ends, below 2**31 both."""
    return F.shiftleft(start.cast("long"), 32).bitwiseOR(end.cast("long"))


def lost_spans(rows: DataFrame, p: Passages) -> DataFrame:
    """doc_id, h and span of the windows that contexts, dealt by `shard`, lose to smaller documents. All copies of a context are in one shard."""

    def find(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, ident, doc, start = (table.column(c).to_numpy() for c in ("key", "id", "doc_id", "start"))
        units = table.column("units").combine_chunks()
        order = np.lexsort((doc, ident, key))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (ident[order][1:] != ident[order][:-1]))
        first = np.flatnonzero(new)
        group = np.empty(len(doc), np.int64)
        group[order] = np.cumsum(new) - 1
        speaker = np.maximum.reduceat(np.where(units.is_valid().to_numpy(zero_copy_only=False), np.arange(len(doc)), -1)[order], first)
        low, high = doc[order[first]], doc[order[np.append(first[1:], len(doc)) - 1]]
        which, at, end, owner = searched(units.take(pa.array(speaker)).to_pylist(), low, high, p)
        # each row gets the pieces of its context
        cuts = np.searchsorted(which, np.arange(len(first) + 1))
        n = np.diff(cuts)[group]
        row = np.repeat(np.arange(len(doc)), n)
        piece = np.arange(len(row)) - np.repeat(offsets(n)[:-1] - cuts[group], n)
        loses = owner[piece] < doc[row]
        row, piece = row[loses], piece[loses]
        spans = (start[row] + at[piece]) << 32 | (start[row] + end[piece])
        return pa.Table.from_arrays([pa.array(doc[row]), table.column("h").take(pa.array(row)), pa.array(spans)], schema=SPANS)

    return rows.select("shard", "doc_id", "h", "start", "key", "id", "units").groupBy("shard").applyInArrow(find, "doc_id long, h long, span long")


def window_rows(distinct: DataFrame, p: Passages) -> DataFrame:
    """The windows of contexts, each as a context: key, id (of the window), owner, other, units, of the context `of` at i."""
    width = np.dtype(p.unit).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("units").to_pylist()
            for part in parts(sizes_of(raw), CHUNK_BYTES // 16):
                units = b"".join(raw[part])
                sizes = sizes_of(raw[part]) // width
                at, which = starts_of_windows(sizes, p.length)
                i = at - offsets(sizes)[which]
                symbols = mix(np.frombuffer(units, p.unit).astype(np.uint64) + np.uint64(1))
                each = batch.slice(part.start, part.stop - part.start)
                key, of, owner, other = (each.column(c).to_numpy(zero_copy_only=False)[which] for c in ("key", "id", "owner", "other"))
                cuts = [units[x : x + p.length * width] for x in (at * width).tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(window_hash(symbols, p.length)[at].view(np.int64)), pa.array(owner), pa.array(other), pa.array(cuts, pa.binary()), pa.array(of), pa.array(i.astype(np.int32))],
                    ["key", "id", "owner", "other", "units", "of", "i"],
                )

    return distinct.select("key", "id", "owner", "other", "units").mapInArrow(cut, "key long, id long, owner long, other long, units binary, of long, i int")


def marks_of(scratch: Scratch, distinct: DataFrame, p: Passages) -> DataFrame:
    """`least_owners` of all distinct contexts, with keys that don't fit a shard dealt window by window."""
    groups = distinct.groupBy("key").agg(F.sum(F.octet_length("units")).alias("b"))
    large = scratch.keep(groups.filter(F.col("b") > p.shard_bytes).select("key"), "large")
    total = distinct.agg(F.sum(F.octet_length("units") * F.when(F.col("other") > F.col("owner"), 2).otherwise(1))).first()[0] or 0
    shards = int(total // p.part_bytes + 1)
    small = distinct.join(large, "key", "left_anti").withColumn("part", F.lit(0).cast("long"))
    marks = scratch.keep(least_owners(small, p, shards), "marks")
    if large.isEmpty():
        return marks
    rows = scratch.keep(window_rows(distinct.join(large, "key", "left_semi"), p), "windows")
    windows = rows.groupBy("key", "id").agg(F.min("owner").alias("owner"), F.max("other").alias("other"), F.first("units").alias("units"))
    found = least_owners(windows.withColumn("part", F.col("id")), p, shards).select("key", "id", F.element_at("owner", 1).alias("own"))
    line = F.array_sort(F.collect_list(F.struct("i", "own")))
    found = rows.select("key", "id", "of", "i").join(found, ["key", "id"]).groupBy("key", "of").agg(line.alias("line"))
    found = found.select("key", F.col("of").alias("id"), F.col("line.i").alias("at"), F.col("line.own").alias("owner"), F.array_min("line.own").alias("low"))
    return marks.unionByName(scratch.keep(found, "large-marks"))


def losses(scratch: Scratch, cut: DataFrame, p: Passages) -> DataFrame:
    """doc_id, h and span of all windows that go. Contexts whose key's rows fit a shard go there as they are; of the others, equal ones become one first."""
    weight = (F.col("n") + F.lit(p.length - 1)).cast("long") * F.lit(np.dtype(p.unit).itemsize)
    shards = int((cut.agg(F.sum(weight)).first()[0] or 0) // p.part_bytes + 1)
    rows = cut.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    held = F.sum(weight + F.lit(ROW_BYTES))
    crowded = scratch.keep(rows.groupBy("shard").agg(held.alias("b")).filter(F.col("b") > p.shard_bytes).select("shard"), "crowded")

    def dealt(rows: DataFrame) -> DataFrame:
        n = min(ROUNDS, shards)
        return reduce(DataFrame.unionByName, [scratch.keep(lost_spans(rows.filter(F.col("shard") % n == r), p), f"spans-{r}") for r in range(n)])

    if crowded.isEmpty():
        return dealt(rows)
    # only where a shard is crowded, one of its keys can be
    keys = rows.join(crowded, "shard", "left_semi").groupBy("key").agg(held.alias("b"))
    hot = scratch.keep(keys.filter(F.col("b") > p.shard_bytes).select("key"), "hot")
    if hot.isEmpty():
        return dealt(rows)
    some = cut.join(hot, "key", "left_semi")
    merged = some.filter("units is not null").groupBy("key", "id").agg(F.min("doc_id").alias("owner"), F.max("top").alias("other"), F.first("units").alias("units"))
    marks = marks_of(scratch, scratch.keep(merged, "distinct"), p)
    scratch.drop("distinct", "large", "windows")
    pieces = some.drop("units", "top").join(marks, ["key", "id"]).filter("low < doc_id")
    pieces = pieces.select("doc_id", "h", "start", "n", "at", F.posexplode("owner").alias("i", "own")).filter("own < doc_id")
    end = F.coalesce(F.get("at", F.col("i") + 1), F.col("n"))
    spans = pieces.select("doc_id", "h", packed_span(F.col("start") + F.get("at", F.col("i")), F.col("start") + end).alias("span"))
    return dealt(rows.join(hot, "key", "left_anti")).unionByName(spans)


def lost_symbols(lost: pa.Array, base: np.ndarray, total: int, length: int) -> np.ndarray:
    """Mask of the symbols under the spans of windows that each document loses."""
    spans = lost.flatten().to_numpy(zero_copy_only=False)
    if not len(spans):
        return np.zeros(total, bool)
    first = np.repeat(base[: len(lost)], lost.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    steps = np.bincount(first + (spans >> 32), minlength=total + 1) - np.bincount(first + (spans & 0xFFFFFFFF) + length - 1, minlength=total + 1)
    return np.cumsum(steps[:-1]) > 0


def without_repeats(docs: DataFrame, p: Passages, finish: Callable, schema: str, name: str) -> DataFrame:
    """docs' rows with what `finish` makes of each text and its mask of removed symbols.

    finish(raw, symbols, counts, mask) gives a frame of one row a text, in order; doc_id comes first in the result.
    """
    scratch = Scratch(docs.sparkSession, name)
    thin = docs.select("doc_id", "text")
    known = thin.filter("doc_id is not null and text is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices, buckets = int(total // SLICE_BYTES + 1), int(total // BUCKET_BYTES) | 1
    keys = scratch.keep(key_blocks(known, p, min(slices, p.fan_out), buckets), "keys")
    if slices > p.fan_out:
        keys = scratch.keep(finer(keys, slices), "finer")
    shared = scratch.keep(keys.filter("kind = 1").unionByName(shared_blocks(keys, buckets)).select("place", "key"), "shared")
    scratch.drop("keys", "finer")
    cut = scratch.keep(contexts(texts_of(known), shared, p, buckets), "contexts")
    scratch.drop("shared")
    lost = losses(scratch, cut, p).groupBy("doc_id", "h").agg(F.collect_list("span").alias("lost"))
    lost = scratch.keep(lost, "lost")
    scratch.drop("contexts", "crowded", "hot", "marks", "large-marks", *[f"spans-{r}" for r in range(ROUNDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lost = batch.column("text"), batch.column("lost")
            for part in parts(lengths(text)):
                n = part.stop - part.start
                raw = text.slice(part.start, n).to_pylist()
                symbols, counts = p.symbols(raw)
                mask = lost_symbols(lost.slice(part.start, n), offsets(counts), len(symbols), p.length)
                out = finish(raw, symbols, counts, mask)
                columns = [batch.column("doc_id").slice(part.start, n), *[pa.array(out[c]) for c in out.columns]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *out.columns])

    return texts_of(thin).join(lost, ["doc_id", "h"], "left").select("doc_id", "text", "lost").mapInArrow(run, schema)
