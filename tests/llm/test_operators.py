"""Each operator against a plain version of its contract, on small awkward tables."""

import dataclasses
import hashlib
import heapq
import math
import random
import re
import string
import time
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
import zstandard

from specloom.llm import fingerprints, fmindex, html, minhash, mixing, packing, passages, quality, queries, secrets, sharding, suffixes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_mix(docs, rows):
    out = collected(mixing.mix(docs))
    assert len(out) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len(words(r[1]))) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while True:  # share, cap, share the rest again
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            free.remove(s)
    taken = Counter()
    for r in out:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 2
    again = Counter((r["doc_id"], r["size"], r["taken"]) for r in collected(mixing.mix(docs.repartition(3))))
    assert again == Counter((r["doc_id"], r["size"], r["taken"]) for r in out)


@pytest.mark.parametrize("n, size, near", [(10, 100, 2), (10, 1000, 16)])
def test_mix_of_a_tail_source(spark, n, size, near):
    small = [("tail", size)] * n + ([("tiny", 5)] if size == 100 else [])
    big = [("big", 100_000)] * 44  # blocks of 67 words, if it were alone
    docs = spark.createDataFrame([(i, "a " * k, s) for i, (s, k) in enumerate(big + small)], "doc_id long, text string, source string")
    taken, target = Counter(), {}
    for r in collected(mixing.mix(docs)):
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert target["tail"] == 3 * n * size
    for s in target:
        assert abs(taken[s] - target[s]) <= near
    assert Counter(r["source"] for r in collected(mixing.mixed(docs)))["tail"] >= 3 * n - 1


def test_mixed_keeps_columns(docs, rows):
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    assert {tuple(r) for r in out.collect()} <= set(rows)


def jaccard_components(rows):
    sets = []
    for r in rows:
        w = words((r[1] or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return sets, [g for g in groups.values()]


def test_near_duplicates(docs, rows):
    sets, groups = jaccard_components(rows)
    expected = Counter()
    for g in groups:
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        low = min(ids) if ids else None
        for i in g:
            own = rows[i][0]
            component = own if not sets[i] else low
            expected[(own, len(sets[i]), component, component is None or own == component if own is not None or component is None else True)] += 1
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in collected(minhash.near_duplicates(docs)))
    assert {k[:3]: n for k, n in got.items()} == {k[:3]: n for k, n in expected.items()}
    assert all(k[3] == (k[0] == k[2]) for k in got if k[0] is not None)


def test_sets_and_words_come_from_one_pass(spark, docs, rows):
    got = Counter((r["doc_id"], r["n_words"], r["n_shingles"], r["source"]) for r in collected(minhash.judged(docs, also=("source",))))
    sets, _ = jaccard_components(rows)
    assert got == Counter((r[0], len(words(r[1])), len(s), r[3]) for r, s in zip(rows, sets))
    hashes, counts, _ = minhash.sets_of([r[1] for r in rows], 5)
    assert counts.tolist() == [len(s) for s in sets]
    for part in np.split(hashes, np.cumsum(counts)[:-1]):
        assert (part[1:] > part[:-1]).all()


@pytest.mark.parametrize("share", [0.3, 0.75, 0.9])
def test_values_of_permutations_are_alike_as_the_sets(share):
    """Four bytes a value, and as many values in common as the sets' likeness says, so a band loses no more links than stated."""
    rng, how = np.random.default_rng(4), minhash.MinMax()
    same, off = [], int(300 * (1 - share) / (1 + share))
    for _ in range(40):
        every = rng.integers(0, 2**64, 300 + off, dtype=np.uint64)
        found = minhash.signatures(np.concatenate((every[:300], every[off:])), np.array([300, 300]), how)
        assert found.dtype == np.uint32 and found.shape == (2, 128)
        same.append((found[0] == found[1]).mean())
    assert np.mean(same) == pytest.approx((300 - off) / (300 + off), abs=0.03)


def test_near_copies_in_one_large_group(spark):
    """Many copies with random edits: links beyond the pivots are found too."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(1000)}" for _ in range(90)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randrange(0, 6)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    _, groups = jaccard_components(rows)
    expected = {rows[i][0]: min(rows[j][0] for j in g) for g in groups for i in g}
    got = {r["doc_id"]: r["component_id"] for r in collected(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == expected


def test_small_tables_of_the_rounds_have_few_files(spark):
    """A file each shuffle partition made executors start a process for each, which counted as a second heap."""
    rng = random.Random(9)
    rows = []
    for i in range(150):
        text = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join([*text[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in held}
    written = Counter()
    shared = Path(spark.conf.get("spark.checkpoint.dir"), "specloom")
    old = set(shared.glob("minhash*"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = minhash.near_duplicates(docs).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for f in (f for d in set(shared.glob("minhash*")) - old for f in d.glob("*/part-*")):
        written[f.parent.parent.name, f.parent.name] += 1
    small = {k: n for k, n in written.items() if k[1] not in ("signed", "nodes", "open", "sets")}
    assert len(small) > 5 and max(small.values()) <= 4 * spark.sparkContext.defaultParallelism < 64
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(i, i - i % 2) for i in range(300)}


def test_rare_prefix_pairs_lose_nothing(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(5, 14)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    how = minhash.MinMax()
    nodes = minhash.signed(docs, how).select("doc_id", "node", "n_shingles").toPandas()
    table = spark.createDataFrame([(int(n), int(k), int(n)) for n, k in {(a, b) for a, b in zip(nodes["node"], nodes["n_shingles"])}], "node long, n long, root long")
    sets_df = minhash.full_sets(docs, how).dropDuplicates(["node"])
    pairs = minhash.rare_prefix_pairs(table, sets_df, 75)
    links = {tuple(sorted((r["pivot"], r["node"]))) for r in minhash.confirmed(pairs, sets_df, 75).collect()}
    sets, _ = jaccard_components(rows)
    by_node = {n: s for n, s in zip(nodes["node"], sets)}
    expected = {tuple(sorted((int(a), int(b)))) for a in by_node for b in by_node if a < b and 100 * len(by_node[a] & by_node[b]) >= 75 * len(by_node[a] | by_node[b])}
    assert links == expected


def test_deduplicated_keeps_columns(docs):
    out = minhash.deduplicated(docs)
    assert out.schema == docs.schema
    kept = {r["doc_id"] for r in minhash.near_duplicates(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in out.collect()} == kept


def test_shards(docs, rows):
    out = collected(sharding.shard_by_bytes(docs, 4))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    total, largest = sum(r["size"] for r in out), max(r["size"] for r in out)
    shards = {s: [r for r in out if r["shard"] == s] for s in range(4)}
    for s, members in shards.items():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
        assert abs(sum(r["size"] for r in members) - total / 4) <= largest
        assert {r["law"] for r in members} <= {"bytes"} and all(r["grown_shard"] is None for r in members)
    ends = [(min(i), max(i)) for i in ([r["doc_id"] or -1 for r in shards[s]] for s in range(4)) if i]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def removed(rows, symbols, k):
    """Mask of each document: symbols under windows that start in an earlier document too."""
    first = {}
    for r in rows:
        s = symbols(r)
        if r[0] is not None and r[1] is not None:
            for i in range(len(s) - k + 1):
                w = tuple(s[i : i + k])
                first[w] = min(first.get(w, r[0]), r[0])
    masks = []
    for r in rows:
        s = symbols(r)
        m = [False] * len(s)
        if r[0] is not None:
            for i in range(len(s) - k + 1):
                if first[tuple(s[i : i + k])] < r[0]:
                    m[i : i + k] = [True] * k
        masks.append(m)
    return masks


def test_fm_index_dedup(docs, rows):
    expected = Counter()
    for r, m in zip(rows, removed(rows, lambda r: words(r[1]), 13)):
        w = words(r[1])
        expected[(r[0], len(w), sum(m), sha(" ".join(x for x, g in zip(w, m) if not g)))] += 1
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in collected(fmindex.dedup_words(docs)))
    assert got == expected


@pytest.mark.parametrize("shard_bytes", [1 << 20, 1])
def test_suffix_array_dedup(docs, rows, shard_bytes):
    """shard_bytes=1 deals every key window by window."""
    expected = Counter()
    for r, m in zip(rows, removed(rows, lambda r: (r[1] or "").encode(), 50)):
        b = (r[1] or "").encode()
        spans = sum(g and not p for g, p in zip(m, [False, *m]))
        expected[(r[0], len(b), sum(m), spans, sha(bytes(x for x, g in zip(b, m) if not g)))] += 1
    got = collected(suffixes.dedup_bytes(docs, dataclasses.replace(suffixes.BYTES, shard_bytes=shard_bytes)))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == expected


@pytest.mark.parametrize("dedup, how", [(fmindex.dedup_words, fmindex.WORDS), (suffixes.dedup_bytes, suffixes.BYTES)])
def test_nothing_goes_without_the_search(docs, dedup, how):
    """What is removed is what the index or the suffix order has found, copies of whole texts too."""

    def nothing(units, sizes, owners, length):
        return np.full((sizes - length + 1).sum(), np.iinfo(np.int64).max)

    def own(units, sizes, owners, length):
        """Every window is its own text's alone."""
        return np.repeat(owners, sizes - length + 1)

    for stub in (nothing, own):
        for shard_bytes in (1 << 20, 1):
            assert dedup(docs, dataclasses.replace(how, search=stub, shard_bytes=shard_bytes)).filter("n_removed > 0").count() == 0


@pytest.mark.parametrize("dedup, how", [(fmindex.dedup_words, fmindex.WORDS), (suffixes.dedup_bytes, suffixes.BYTES)])
def test_keys_go_by_wide_slices_first(docs, dedup, how, monkeypatch):
    monkeypatch.setattr(passages, "SLICE_BYTES", 1 << 14)
    a, b = (sorted(map(tuple, dedup(docs, dataclasses.replace(how, fan_out=n)).collect()), key=str) for n in (1024, 3))
    assert a == b


@pytest.mark.parametrize("dedup, how, limit", [(fmindex.dedup_words, fmindex.WORDS, 600), (suffixes.dedup_bytes, suffixes.BYTES, 300)])
def test_contexts_go_to_their_shard_at_once(docs, dedup, how, limit, monkeypatch):
    """Equal ones become one before that only where a key's don't fit a shard; with a limit between, some keys' do and others' don't."""
    kept, plain = [], passages.Scratch.keep
    monkeypatch.setattr(passages.Scratch, "keep", lambda scratch, df, name, few=False: kept.append((name, out := plain(scratch, df, name, few))) or out)
    monkeypatch.setattr(passages.Scratch, "drop", lambda *a: None)
    expected = sorted(map(tuple, dedup(docs).collect()), key=str)
    assert not {"distinct", "marks"} & {name for name, _ in kept}
    kept.clear()
    assert sorted(map(tuple, dedup(docs, dataclasses.replace(how, shard_bytes=limit)).collect()), key=str) == expected
    rows = {name: df.count() for name, df in kept}
    assert rows["hot"] and rows["marks"] and rows["spans-0"]


def test_suffix_order_ranks_only_what_windows_ask_for(monkeypatch):
    """No recursion orders more suffixes than there are windows."""
    asked, plain = [], suffixes.suffix_array
    monkeypatch.setattr(suffixes, "suffix_array", lambda text, depth, wanted=None: asked.append(len(text) if wanted is None else int(wanted.sum())) or plain(text, depth, wanted))
    units = np.tile(np.random.default_rng(5).integers(97, 123, 66 * 200), 2).astype(np.uint8)
    owners = np.arange(400) % 200
    assert (suffixes.search(units, np.full(400, 66), owners, 50) == np.repeat(owners, 17)).all()
    assert len(asked) > 2 and max(asked) == 400 * 17


def test_huffman_codes_are_shortest_and_take_few_rounds():
    """As short in all as by merging one pair after another, prefix-free, and in less than half of the time of that."""
    rng = np.random.default_rng(4)
    for counts in (np.array([7]), np.array([1, 1]), np.array([1, 1, 2, 3, 5, 8, 13, 21]), rng.integers(1, 9, 1001), rng.zipf(1.3, 100000).clip(max=10**9)):
        began = time.perf_counter()
        lengths, codes = fmindex.huffman(counts)
        took = time.perf_counter() - began
        began = time.perf_counter()
        heap, total = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            two = heapq.heappop(heap) + heapq.heappop(heap)
            total += two
            heapq.heappush(heap, two)
        plain = time.perf_counter() - began
        assert (lengths * counts).sum() == (total if len(counts) > 1 else counts[0])
        assert len(counts) < 2 or sum(Fraction(n, 2**k) for k, n in Counter(lengths.tolist()).items()) == 1
        order = np.lexsort((codes, lengths))
        wide = codes[order] << (lengths.max() - lengths[order])
        assert (np.diff(wide) >= 1 << (lengths.max() - lengths[order][:-1])).all()
    assert took < plain / 2


def test_equal_texts_are_streamed_once(monkeypatch):
    streamed, plain = [], fmindex.FmIndex.matching_statistics
    monkeypatch.setattr(fmindex.FmIndex, "matching_statistics", lambda index, text, ends, length: streamed.append(len(ends)) or plain(index, text, ends, length))
    texts = [np.arange(1, 16), np.arange(30, 44), np.arange(1, 16), np.arange(1, 17)]
    got = fmindex.search(np.concatenate(texts).astype(np.uint64), np.array([15, 14, 15, 16]), np.array([7, -5, 3, 4]), 13)
    assert got.tolist() == [3, 3, 3, -5, -5, 3, 3, 3, 3, 3, 3, 4] and streamed == [3 + 2 + 4]


@pytest.mark.parametrize("search, length, unit", [(suffixes.search, 50, np.uint8), (fmindex.search, 13, np.uint64)])
@pytest.mark.parametrize("alphabet", [1, 2, 4, 200])
def test_least_owners(search, length, unit, alphabet):
    rng = np.random.default_rng(alphabet)
    for _ in range(20):
        base, texts = rng.integers(0, alphabet, 150), []
        for _ in range(rng.integers(1, 8)):
            a = rng.integers(0, 60)
            texts.append(base[a : a + length + rng.integers(0, 30)].copy())
            if rng.random() < 0.4:
                texts[-1][rng.integers(0, length)] = rng.integers(0, alphabet)
        owners, least = rng.integers(0, 5, len(texts)), {}
        for t, o in zip(texts, owners):
            for i in range(len(t) - length + 1):
                w = tuple(t[i : i + length])
                least[w] = min(least.get(w, 9), o)
        got = search(np.concatenate(texts).astype(unit), np.array([len(t) for t in texts]), owners, length)
        assert got.tolist() == [least[tuple(t[i : i + length])] for t in texts for i in range(len(t) - length + 1)]


def test_suffix_array_orders_all_suffixes():
    rng = np.random.default_rng(2)
    for n in [1, 2, 3, 4, 5, 30, 200]:
        for alphabet in (1, 2, 5):
            text = rng.integers(1, alphabet + 1, n)
            for depth in (3, 10, n):
                order = suffixes.suffix_array(text, depth)
                assert sorted(order.tolist()) == list(range(n))
                heads = [text[i : i + depth].tolist() for i in order]
                assert heads == sorted(heads)


def base_spans(text):
    found = []
    pattern = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found += [(m.start(), 0, m.end(), "assign") for m in pattern.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(docs, rows):
    expected = Counter()
    for r in rows:
        spans = base_spans(r[1] or "")
        n = Counter(s[3] for s in spans)
        expected[(r[0], n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)))] += 1
    out = collected(secrets.scan(docs))
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in out) == expected
    for r in out:
        base = [s for s in r["spans"].split(",") if s and not s.startswith("markov")]
        assert sha(",".join(base)) == r["base_sha256"]


def test_markov_models_tell_strings_apart(spark):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    prose = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(80)) for _ in range(60)]
    token = lambda: "".join(rng.choice(alphabet) for _ in range(32))
    docs = spark.createDataFrame([(i, f"{p} token={token()}") for i, p in enumerate(prose)], "doc_id long, text string")
    model = secrets.train(docs)
    bare = token()
    more = docs.union(spark.createDataFrame([(99, f"see {bare} there"), (98, "see some_ordinary_identifier_of_20 there")], "doc_id long, text string"))
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(more).collect()}
    assert (spans[99], spans[98]) == ("markov:4:36", "")
    from pyspark.sql import functions as F

    name = lambda: "_".join("".join(rng.choice(syllables) for _ in range(3)) for _ in range(3)) + "_1"
    test = spark.createDataFrame([(token(), True) for _ in range(200)] + [(name(), False) for _ in range(200)], "w string, random boolean")
    scored = test.select("random", (secrets.score(F.col("w"), model) > secrets.THRESHOLD).alias("hit")).collect()
    assert sum(r["hit"] == r["random"] for r in scored) >= 0.95 * len(scored)


def test_redact(docs, rows):
    out = secrets.redact(docs)
    assert out.schema == docs.schema
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    for r in rows:
        if r[1] is not None and base_spans(r[1]):
            assert "[SECRET]" in texts[r[0]] and not base_spans(texts[r[0]])
        elif r[0] == 15:
            assert texts[15] == "a b c d e"


def test_fingerprints(plain):
    rows = sorted(plain.collect(), key=lambda r: -r["doc_id"])
    got = {r["doc_id"]: r for r in collected(fingerprints.fingerprints(plain))}
    assert len(got) == len(rows)
    errors = []
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        t, n = r["text"] or "", nxt["text"] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        o = got[r["doc_id"]]
        assert (o["n_chars"], o["edited_sha256"]) == (len(t), sha(edited))
        for value, other in ((o["near_edited"], edited), (o["near_next"], n)):
            a, b = Counter(words(t)), Counter(words(other))
            top = sum((a | b).values())
            errors.append(value - (sum((a & b).values()) / top if top else 1.0))
    assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.3
    by_text = {}
    for r in rows:
        by_text.setdefault(r["text"], set()).add(got[r["doc_id"]]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_draws_are_consistent_weighted_samples(spark):
    """Values are c exp(-r (t - b + 1)) with independent r, b, c; a word that comes once takes one logarithm, where it took four."""
    from pyspark.sql import functions as F

    rows = [(x, n) for x in range(1500) for n in (1, 2, 3, 40)]
    table = spark.createDataFrame(rows, "_x long, _n int").withColumn("_w", F.ln(F.col("_n").cast("double")))
    draws, shares = {}, []
    for q in table.select("_x", "_n", "_w", fingerprints.sample(3).alias("v"), F.xxhash64("_x", F.lit(3)).alias("h"), F.xxhash64("_x", F.lit(-4)).alias("g")).collect():
        u1, u2, u3, u4 = ((((y & 2**64 - 1) >> at & 2**32 - 1) + 0.5) / 2**32 for y in (q["h"], q["g"]) for at in (0, 32))
        r, c = -math.log(u1) - math.log(u2), -math.log(u3) - math.log(u4)
        b = -math.log(u2) / r
        t = math.floor(q["_w"] / r + b)
        assert q["v"] / 2**32 == pytest.approx(c * math.exp(-r * (t - b + 1)), rel=1e-5)
        draws[q["_x"], q["_n"]] = q["v"]
        shares.append(b)
    assert abs(sum(shares) / len(shares) - 0.5) < 0.03
    # one term of weights 2 and 3 keeps its sample with a chance of 2/3
    assert abs(sum(draws[x, 2] == draws[x, 3] for x in range(1500)) / 1500 - 2 / 3) < 0.04
    assert str(fingerprints.sample(3)).split("CASE WHEN")[0].count("ln(") == 1


def test_fingerprints_of_awkward_rows(docs, rows):
    out = collected(fingerprints.fingerprints(docs))
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert Counter((r["doc_id"], r["n_chars"]) for r in out) == Counter((r[0], len(r[1] or "")) for r in rows)


def test_fingerprints_are_written_in_few_files(spark, tmp_path):
    """A file each shuffle partition made executors start processes for each, which counted as a second heap."""
    docs = spark.createDataFrame([(i, f"some words and number {i % 700}") for i in range(2000)], "doc_id long, text string")
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in held}
    shared = Path(spark.conf.get("spark.checkpoint.dir"), "specloom")
    old = set(shared.glob("cws*"))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        fingerprints.fingerprints(docs).write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    tables = [tmp_path / "out", *(t for d in set(shared.glob("cws*")) - old for t in d.iterdir())]
    written = {t.name: len([*t.glob("part-*")]) for t in tables}
    assert set(written) == {"out", "sigs", "blocks"}
    assert 0 < max(written.values()) <= 4 * spark.sparkContext.defaultParallelism < 64
    assert not any((t / "_SUCCESS").exists() for t in tables[1:])
    got = {r["doc_id"]: r["edited_sha256"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    text = lambda i: f"some words and number {i % 700}"
    assert got == {i: sha(text(i)[: len(text(i)) - len(text(i)) // 2] + text((i - 1) % 2000)[: len(text(i)) // 2]) for i in range(2000)}


def test_quality(docs, rows):
    expected = Counter()
    for r in rows:
        t, w = r[1] or "", words(r[1])
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        twice = [False] * len(w)
        for i in range(len(w) - 7):
            if windows[tuple(w[i : i + 8])] > 1:
                twice[i : i + 8] = [True] * 8
        lines = [x for x in t.split("\n") if words(x)]
        expected[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(twice), len(w) < 20 or 100 * sum(twice) > 30 * len(w))] += 1
    out = collected(quality.quality(docs))
    assert Counter(tuple(r[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out) == expected
    assert not any(r["kept"] and r["base_failed"] for r in out)
    kept = quality.keep_good(docs)
    assert kept.schema == docs.schema and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in out if r["kept"])


def test_compression_bands():
    rng = random.Random(2)
    bands, pack = quality.Bands(), zstandard.ZstdCompressor(level=3)
    prose = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(3000)) for _ in range(3000)).encode()
    assert quality.verdict(prose, bands, pack)[2]
    assert not quality.verdict(b"same words again " * 500, bands, pack)[2]
    assert not quality.verdict(rng.randbytes(9000), bands, pack)[2]
    # half of the chunks repeat: the whole may pass, the chunks don't
    assert quality.verdict(prose[:8192] + b"la " * 5461, bands, pack)[1] > bands.share


@pytest.mark.parametrize("copies", [4096, 2])
def test_packing_against_a_plain_search(spark, docs, rows, monkeypatch, copies):
    """Within each group, every piece is where the plain rule puts it: the fullest bin that has room, another cluster and a free place for the source."""
    monkeypatch.setattr(packing, "COPIES", copies)
    rows = rows + [(10_000 + i, "same words " * (i % 9), None, ["s1", None, ""][i % 3], 1, *rows[0][5:]) for i in range(300)] + [(7, "four times the same", None, "s9", 1, *rows[0][5:])] * 4
    df = spark.createDataFrame(rows, docs.schema).repartition(6)
    out = collected(packing.pack(df, capacity=128, per_source=3, group_bins=8))
    cluster_of, source_of = {r[0]: r[1] or "" for r in rows}, {r[0]: r[3] for r in rows}
    single = {i for i, n in Counter(r[0] for r in rows).items() if n == 1}
    bins, groups = {}, {}
    for r in out:
        if r["group"] >= 0:
            groups.setdefault(r["group"], []).append(r)
            bins.setdefault((r["group"], r["bin"]), []).append(r)
    assert len(groups) > 1
    for members in bins.values():
        of = [m["doc_id"] for m in members if m["doc_id"] in single]
        assert len({cluster_of[i] for i in of}) == len(of)
        assert max(Counter(repr(source_of[i]) for i in of).values(), default=0) <= 3
    judged = [g for g in groups.values() if all(m["doc_id"] in single for m in g)]
    assert judged
    for members in judged:
        plain = []  # room, clusters, sources
        by_hash = lambda m: (-m["n_words"], m["doc_id"])
        for m in sorted(members, key=by_hash):
            c, s = cluster_of[m["doc_id"]], repr(source_of[m["doc_id"]])
            fits = [(b[0], i) for i, b in enumerate(plain) if b[0] >= max(m["n_words"], 1) and c not in b[1] and b[2][s] < 3]
            if not fits:
                plain.append([128, set(), Counter()])
            i = min(fits)[1] if fits else len(plain) - 1
            plain[i][0] -= m["n_words"]
            plain[i][1].add(c)
            plain[i][2][s] += 1
            assert m["bin"] == i
    whole = sorted(r["bin"] for r in out if r["group"] < 0)
    assert whole == list(range(len(whole))) and whole
    again = collected(packing.pack(df.repartition(2), capacity=128, per_source=3, group_bins=8))
    key = lambda r: sorted(r.items(), key=str)
    assert sorted(map(key, out), key=str) == sorted(map(key, again), key=str)


def test_packing(docs, rows):
    out = collected(packing.pack(docs, capacity=256, per_source=4, group_bins=4))
    total = sum(len(words(r[1])) for r in rows)
    assert sum(r["n_words"] for r in out) == total
    sizes = Counter()
    for r in out:
        sizes[r["doc_id"]] += r["n_words"]
    for i in {r[0] for r in rows}:
        assert sizes[i] == sum(len(words(r[1])) for r in rows if r[0] == i)
    bins = {}
    for r in out:
        if r["group"] >= 0:
            bins.setdefault((r["group"], r["bin"]), []).append(r)
    for members in bins.values():
        assert sum(m["n_words"] for m in members) <= 256
        assert {m["room"] for m in members} == {256 - sum(m["n_words"] for m in members)}


def test_near_copies_share_no_bin(spark, tmp_path):
    """Without doc_id too, and where a doc_id has several texts: each row has the cluster of its own text."""
    rng = random.Random(12)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(50 + 10 * i)] for i in range(4)]
    first, second, third, fourth = [" ".join(t) for t in texts]
    ids = [(1, first), (None, first + " more"), (None, second), (None, second + " more"), (20, third), (30, third + " more"), (30, fourth), (10, fourth + " more")]
    spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(ids)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["n_words"]: (r["group"], r["bin"]) for r in collected(queries.op8_best_fit_packing(spark, str(tmp_path)))}
    assert sorted(out) == [50, 51, 60, 61, 70, 71, 80, 81]
    assert all(out[n] != out[n + 1] for n in (50, 60, 70, 80))


def test_large_ids_beside_null_stay_whole(spark, tmp_path):
    ids = [2**53 + 1, 2**62 + 3, None]
    spark.createDataFrame([(i, f"{k} of these", "s") for k, i in enumerate(ids)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for query in (queries.op2_near_duplicates, queries.op8_best_fit_packing):
        assert Counter(r["doc_id"] for r in collected(query(spark, str(tmp_path)))) == Counter(ids)


def test_best_fit_takes_the_tightest_bin_that_allows():
    bins = packing.Bins(10, 2)
    assert [bins.put(n, c, s) for n, c, s in [(7, 0, 0), (6, 1, 0), (3, 2, 1), (4, 1, 1), (4, 3, 1)]] == [0, 1, 0, 2, 1]
    assert bins.put(2, 4, 1) == 2  # room 6 is the only one left
    assert bins.put(1, 5, 1) == 3  # source 1 is full there: two pieces


@pytest.mark.parametrize(
    "run",
    [mixing.mix, mixing.mixed, minhash.near_duplicates, minhash.deduplicated, sharding.shard_by_bytes, fmindex.dedup_words, secrets.scan, secrets.redact, fingerprints.fingerprints, quality.quality, quality.keep_good, packing.pack, suffixes.dedup_bytes],
    ids=lambda f: f.__name__,
)
def test_empty_table(empty, run):
    assert run(empty).collect() == []


PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>The title of it</h1><p>One &amp; two,\n  three things were said.<p>And so it went on, day by day, to the end.</article><footer>&copy; 2020 Somebody</footer>", "The title of it\n\nOne & two, three things were said.\n\nAnd so it went on, day by day, to the end."),
    ("", ""), (None, ""), ("<script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> -->", ""),
]


def test_main_text(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)] + [(None, None, None, None)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in collected(html.extract(pages))}
    for i, (_, text) in enumerate(PAGES):
        assert (got[i]["text"], got[i]["n_chars"], got[i]["url"]) == (text, len(text), f"u{i}")
    assert html.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<html><head><title>T</title><meta charset=x><body><article><p>Kept words</p></article>", ["Kept words"]),
        ("<head><title>T <b></title><link rel=x><article><p>Kept words</article>", ["Kept words"]),
        ("<head><noscript><img src=x></noscript><title>T</title>Kept<br>words", ["Kept words"]),
        ("<div><svg class='i'/><p>Kept</p></div><svg><text>no</text></svg><p>after", ["Kept", "after"]),
        ("<p>a <math/> b <svg><path d='x'/><text>no</text></svg> c</p>", ["a b c"]),
        ("<div><svg><path d=x><p>in it</p></div><p>after", ["in it", "after"]),
        ("<div><canvas>no</div><p>after", ["after"]),
        ("<svg><foreignObject><p>no</p></foreignObject></svg>yes", ["yes"]),
        ("<object><param name=x><object>no</object>no</object>yes", ["yes"]),
        ("<p>a<noscript><div>no</div></noscript>b<template><p>no</template>c", ["a b c"]),
        ("<script src='x'/><p>yes", ["yes"]),
        ("<script src=/a/>no</script>yes<script>no<p>no", ["yes"]),
    ],
)
def test_text_around_hidden_elements(page, texts):
    assert [b.text for b in html.blocks(page)] == texts


def test_field_on_held_out_pages():
    rng = random.Random(4)
    sentences = [" ".join(rng.choice("in the of and so many words were here said by a man who went on".split()) for _ in range(rng.randrange(4, 20))).capitalize() + "." for _ in range(300)]
    model = html.fit([([html.hashed(html.features(b)) for b, _ in page], [y for _, y in page]) for page in (html.labelled_page(rng, sentences[:200]) for _ in range(200))])
    good = total = 0
    for _ in range(100):
        page = html.labelled_page(rng, sentences[200:])
        good += sum(a == bool(y) for a, (_, y) in zip(model.decode([b for b, _ in page]), page))
        total += len(page)
    assert good / total > 0.95


def test_viterbi_finds_the_likeliest_labels():
    import itertools

    import numpy as np

    rng = np.random.default_rng(6)
    page = [html.Block(("p",), "p", f"some words {i}", 0) for i in range(6)]
    model = html.Crf(rng.normal(size=html.SIZE), rng.normal(size=(2, 2)))
    own = [model.weight[html.hashed(html.features(b))].sum() for b in page]
    best = max(itertools.product((0, 1), repeat=6), key=lambda y: sum(o * a for o, a in zip(own, y)) + sum(model.pair[a, b] for a, b in zip(y, y[1:])))
    assert model.decode(page) == [bool(x) for x in best]


SHORT_PAGES = [
    ("<article><p>A &lt;b&gt; c</p><pre>x  y</pre></article>", "A <b> c\n\nx y"),
    ("<p>x<br>y</p>", "x y"),
    ("<p>Hello</p>", "Hello"),
    ("<nav><a href=/>Home</a></nav><article><h1>The title of it</h1><p>One &amp; two, three things were said.</p></article>", "The title of it\n\nOne & two, three things were said."),
    ('<body><div id=menu><a href="#">Home</a></div><p>Short text here.</p></body>', "Short text here."),
    ("<p>Said in full, and so it stands.<script>if (a < b) {", "Said in full, and so it stands."),
    ("<p>Said in full, and so it stands.<!-- not > closed", "Said in full, and so it stands."),
    ("<p>Said in full, and so it stands.</p><p>a < b", "Said in full, and so it stands.\n\na < b"),
]


def test_short_pages():
    model = html.train([])
    for page, text in SHORT_PAGES:
        assert html.main_text(page, model) == text, page


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<div>", "<div>x", "<b>x", "</p>", '<script "', "<!--", "<svg>", '<p class="a"><a>', "<title>", "&amp;"])
def test_broken_pages_take_linear_time(piece):
    began = time.time()
    html.blocks(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 20


def test_models_add_spans(spark, tmp_path):
    """Random strings that no base pattern finds, letters alone and short ones too; ordinary text gets none."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("the river runs under an old bridge and people walk along its quiet banks every morning with their friends".split()) for _ in range(n))
    rows = [(i, f"{text(60)} token={''.join(rng.choices(string.ascii_letters + string.digits, k=24))} {text(60)}") for i in range(300)]
    planted = {1000 + i: "".join(rng.choices(string.ascii_letters + (string.digits if i % 2 else ""), k=16 + i)) for i in range(20)}
    rows += [(i, f"{text(30)} {v} {text(30)}") for i, v in planted.items()] + [(2000 + i, text(200)) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    out = {r["doc_id"]: r["spans"] for r in collected(secrets.scan(spark.read.parquet(f"{tmp_path}/docs")))}
    texts = dict(rows)
    found = {i: [texts[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in out[i].split(",") if x) if k == "markov"] for i in out}
    assert sum(found[i] == [v] for i, v in planted.items()) >= 18
    assert not any(found[i] for i in range(300)) and not any(found[2000 + i] for i in range(20))


def test_many_secrets_take_linear_time(spark, tmp_path):
    lines = ["deadbeef" * 3 + f"{i:06x}zz password=abcdefgh{i}" for i in range(2000)]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    df = spark.read.parquet(f"{tmp_path}/docs")
    began = time.time()
    row = secrets.scan(df).first()
    assert (row["n_hex"], row["n_assign"]) == (2000, 2000) and time.time() - began < 60
    assert secrets.redact(df).filter("text like '%deadbeef%' or text like '%abcdefgh%'").count() == 0
