"""Archives, the prefix trie and spelling variants against plain versions of their contracts."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from specloom.llm import spelling, trie, warc
from specloom.llm.common import Scratch


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small tables keep their partitions, so that parts, blocks and edges between them are many."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def plain_archive(rows, least=0):
    largest = {}
    for page_id, _, html in rows:
        if page_id is not None and page_id > largest.get(html or "", (-(2**63)) - 1):
            largest[html or ""] = page_id
    out = []
    for page_id, _, html in rows:
        data, top = (html or "").encode(), largest.get(html or "")
        revisit = len(data) >= least and top is not None and top != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


PAGES = "page_id long, url string, html string, key string, digest string, payload string, size int, keeper long"


def awkward_pages():
    rng = random.Random(3)
    rows = [(None, None, None), (None, "http://a.example/", "<p>x"), (2**62, "http://a.example/ b\r\nWARC-Type: x", "<p>x"), (-7, "HTTPS://user@A.Example:8080/q?r#s", ""), (5, "no url: at all", None), (5, "no url: at all", None)]
    rows += [(i, f"http://{'abc'[i % 3]}.example.org/{i % 7}", rng.choice(["<p>same", f"<p>é{i}", "", "long " * 40000])) for i in range(10, 90)]
    return rows


@pytest.mark.parametrize("least, block_lines", [(0, 1024), (6, 3)])
def test_archive_round_trip(spark, least, block_lines):
    rows = awkward_pages()
    df = spark.createDataFrame([(*r, "k", "d", "p", 1, 2) for r in rows], PAGES).repartition(5)
    got = [tuple(r) for r in warc.round_trip(df, least, block_lines).collect()]
    assert sorted(got, key=str) == plain_archive(rows, least)


def test_archive_of_nothing(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_repeated_payloads_of_many_rows(spark):
    rows = [(i, f"http://hot.example/{i % 5}", "same" if i % 3 else f"{i // 6}") for i in range(4000)]
    assert sorted((tuple(r) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str) == plain_archive(rows)


def test_index_finds_captures_by_url_and_host(spark):
    rows = [(i, f"http://{'abc'[i % 3]}.example.org/{i % 7}", f"<p>é{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    scratch = Scratch(spark, "test")
    index = warc.build_index(warc.write_archives(df, scratch), scratch, block_lines=4)
    assert len(index.parts) > 1
    asked = spark.createDataFrame([("org,example,b)/3 ", "org,example,b)/3!"), ("org,example,c)", "org,example,c)~"), ("zzz", "zzzz"), ("", "a")], "low string, high string")
    got = [r.asDict() for r in warc.read_records(index, warc.lookup(index, asked)).collect()]
    assert sorted(r["page_id"] for r in got) == sorted([i for i, u, _ in rows if u == "http://b.example.org/3"] + [i for i, u, _ in rows if "//c." in u])
    assert all(r["payload"] == f"<p>é{r['page_id']}".encode() and r["url"] == rows[r["page_id"]][1] for r in got)


def test_record_that_was_changed_is_refused():
    digest = base64.b32encode(hashlib.sha1(b"abc").digest()).decode()
    assert warc.parsed(warc.record(1, "u", b"abc", 3, digest, None))["payload"] == b"abc"
    with pytest.raises(ValueError, match="differs"):
        warc.parsed(warc.record(1, "u", b"abd", 3, digest, None))


def plain_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seq = tuple(convs.get(base, [])[:h] + convs[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids, leaves, saved = Counter(q[:-1] for q in members if q), Counter(), Counter()
    for q, m in members.items():
        for d in range(len(q) + 1):
            leaves[q[:d]] += not kids[q]
            saved[q[:d]] += (len(m) - 1) * len(q[-1][1]) if q else 0
    sha = lambda q: hashlib.sha256(",".join(map(str, sorted(ends[q]))).encode()).hexdigest()
    return sorted(((min(m), len(q), min(members[q[:-1]]) if q else None, len(m), kids[q], leaves[q], saved[q], sha(q)) for q, m in members.items()), key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string, c long, k1 long, depth long, _pid int"


def awkward_conversations():
    rng = random.Random(11)
    rows = [(None, 1, "user", "x"), (7, None, None, None), (7, None, None, None), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "", "usertie"), (-150, 0, "a", "b"), (-101, 5, "a", None)]
    for c in [*range(100, 190), *range(3000, 3060)]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            rows.append((c, turn, "user" if turn % 2 else "bot", rng.choice(["same é", "other", f"own {c}"])))
    rows += [(900, i, "user", f"{i % 3}") for i in range(700)] + [(901, i, "user", f"{i % 3}" if i < 400 else "z") for i in range(500)]
    return rows


@pytest.mark.parametrize("piece", [1, 40, 1 << 15])
def test_prefix_trie(spark, piece):
    rows = awkward_conversations()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], CONVERSATIONS).repartition(5)
    got = [tuple(r) for r in trie.prefix_trie(df, piece=piece).collect()]
    assert sorted(got, key=str) == plain_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, 2, 3, 4)], CONVERSATIONS)).count() == 0


def test_ids_of_a_common_end_are_hashed_in_order(spark):
    rows = [(c * 100, 0, "user", "hello") for c in range(1500)]
    got = {r["depth"]: r for r in trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert sorted(got) == [0, 1] and got[1]["n_convs"] == 1500
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(str(c * 100) for c in range(1500)).encode()).hexdigest()


def plain_variants(rows, least=6, often=5, every=199):
    lower, n = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= often}
    letters, near, form = sorted(set("".join(n))), {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + k :] for k in (0, 1) for i in range(len(w) + 1 - k) for a in letters}
        near[w] = {x for x in edits if x in n and x != w}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def test_variants_of_awkward_documents(spark, docs, rows, empty):
    # the plain version makes all edits of a word, which is too much for one of 30000 letters
    got = sorted(tuple(r) for r in spelling.variants(docs.filter("text is null or length(text) <> 30000"), least=3, often=1, every=3).collect())
    assert got == plain_variants([r[:2] for r in rows if r[1] is None or len(r[1]) != 30000], 3, 1, 3)
    assert spelling.variants(empty).count() == 0


def test_variants_of_very_long_words(spark):
    long = "ab" * 10000
    texts = [long] * 30 + [long[:500] + "z" + long[501:]] * 5 + [long + "a"] * 5
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), every=10**9).collect()}
    assert len(got) == 3 and got[long]["n_near"] == 2 and got[long]["form"] is None
    assert all(r["form"] == long and r["form_n"] == 30 for w, r in got.items() if w != long)


@pytest.mark.parametrize("parts", [1, 7])
def test_variants_of_made_up_words(spark, parts):
    rng, text = random.Random(parts), []
    for base in ("aaaaaa", "abcdef", "banana", "étoileé", "zzzzzz", "Straßen"):
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "b", "é", "ÿ"])
            text.append(" ".join(["".join(w)] * rng.choice([1, 5, 6, 30, 200, 1200])))
    rows = [(i, t) for i, t in enumerate(text)] + [(None, "étoile " * 9), (None, None), (0, "étoile " * 9)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 4 * parts)
    try:
        got = sorted(tuple(r) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_variants(rows)
    assert any(r[1] != r[2] for r in got if r[1])
