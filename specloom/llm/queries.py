"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from specloom.llm import fingerprints, fmindex, html, minhash, mixing, packing, quality, secrets, sharding, spelling, suffixes, trie, warc


def read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


def op3_shard_by_bytes(spark, sf_dir):
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    return secrets.scan(read(spark, sf_dir, "documents"))


def op7_quality_rules(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark, sf_dir):
    near = minhash.judged(read(spark, sf_dir, "documents"), also=("source",))
    cluster = F.coalesce("component_id", "root", "h")  # a component of rows without doc_id has its number alone, a row in none its text's hash
    return packing.pack(near, cluster=cluster, size=F.col("n_words"))


def op9_main_text(spark, sf_dir):
    return html.extract(read(spark, sf_dir, "pages"))


def op6_weighted_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op4_fm_index_dedup(spark, sf_dir):
    return fmindex.dedup_words(read(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark, sf_dir):
    return suffixes.dedup_bytes(read(spark, sf_dir, "documents"))


def op11_warc_round_trip(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op12_prefix_trie(spark, sf_dir):
    return trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(read(spark, sf_dir, "documents"))


#: CRC-32 of the bytes of the text @, bit by bit: code points over 127 are taken from their UTF-8 form.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(@))), lambda i: CAST('0x' || substr(hex(encode(@)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_near_duplicates, op3_shard_by_bytes, op4_fm_index_dedup, op5_secret_scan,
        op6_weighted_fingerprints, op7_quality_rules, op8_best_fit_packing, op9_main_text, op10_suffix_array_dedup,
        op11_warc_round_trip, op12_prefix_trie, op13_spelling_variants,
    )
}

SQL = {
    "op1_mix_sources": r"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') AS s, source IS NULL AS nul, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('mix|' || doc_id) AS md FROM documents),
e AS (SELECT *, CAST('0x' || substr(md, 1, 4) AS INTEGER) % 64 AS shard FROM d),
cells AS (SELECT nul, s, shard, sum(size)::BIGINT AS words FROM e GROUP BY ALL),
t AS (SELECT sum(words)::BIGINT AS total, greatest(1, least(1024, sum(words)::BIGINT // 65536)) AS block FROM cells),
w AS (SELECT nul, s, sum(words)::BIGINT AS size, row_number() OVER (ORDER BY nul, s) AS rank FROM cells GROUP BY nul, s),
v AS (SELECT *, (1 + (rank - 1) % 3)::DOUBLE AS w, size * 3.0::DOUBLE AS cap FROM w),
l AS (SELECT v.*, (total::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v, t),
f AS (SELECT level FROM l WHERE cap >= w * level ORDER BY cap / w, rank LIMIT 1),
g AS (SELECT nul, s, size, rank, coalesce(least(cap, w * (SELECT level FROM f)), cap) AS target FROM l),
q AS (SELECT nul, s, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank, k) AS place FROM (SELECT *, unnest(range(0, (2 * total + block) // (2 * block) + 1)) AS k FROM g, t)),
b AS (SELECT nul, s, count(*) AS blocks FROM q, t WHERE place <= (2 * total + block) // (2 * block) GROUP BY ALL),
c AS (SELECT nul, s, shard, blocks, row_number() OVER (PARTITION BY nul, s ORDER BY words / (2 * k + 1) DESC, shard, k) AS place
  FROM (SELECT *, unnest(range(0, blocks + 1)) AS k FROM cells JOIN b USING (nul, s) WHERE words > 0)),
u AS (SELECT nul, s, shard, count(*) AS quota FROM c WHERE place <= blocks GROUP BY ALL),
k AS (SELECT nul, s, shard, words, least(coalesce(quota, 0) * block, words * 3) AS take FROM cells LEFT JOIN u USING (nul, s, shard), t),
n AS (SELECT *, sum(size) OVER (PARTITION BY nul, s, shard ORDER BY md, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM e)
SELECT n.doc_id, n.size, g.size AS source_size, g.target,
  CAST(CASE WHEN words > 0 THEN take // words * n.size + greatest(0, least(upto, take % words) - (upto - n.size)) ELSE 0 END AS BIGINT) AS taken, n.source, n.shard
FROM n JOIN k USING (nul, s, shard) JOIN g USING (nul, s)""",
    "op2_near_duplicates": r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.x = d.doc_id GROUP BY d.doc_id, n.n""",
    "op4_fm_index_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM w)),
f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM g JOIN f USING (s) WHERE m < doc_id),
r AS (SELECT doc_id, count(*) AS c FROM x GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS t FROM (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM w)
      ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op10_suffix_array_dedup": r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM b)),
f AS (SELECT md5(s) AS s, min(doc_id) AS m FROM g GROUP BY 1),
x AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM g JOIN f ON md5(g.s) = f.s WHERE m < doc_id),
r AS (SELECT doc_id, count(*) AS c, sum(CASE WHEN i = q + 1 THEN 0 ELSE 1 END) AS n
      FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -9) AS q FROM x) GROUP BY doc_id),
k AS (SELECT doc_id, unhex(string_agg(substr(h, 2 * i + 1, 2), '' ORDER BY i)) AS t
      FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM b) ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(c, 0) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(coalesce(t, ''::BLOB)) AS kept_sha256
FROM b LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op11_warc_round_trip": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY sha1(b)) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * i // 4 + 1, 2) AS INTEGER) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN m > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m > page_id THEN m END AS refers_to
FROM d""",
    "op12_prefix_trie": r"""
WITH o AS (SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x, turn,
             md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS md FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT c, list(x ORDER BY turn NULLS FIRST, md) AS x FROM o GROUP BY c),
h AS (SELECT c, x, c - c % 100 AS b, @CRC % 6 AS h FROM w),
s AS (SELECT h.c, list_concat(coalesce(w.x, [])[1:h.h], h.x[h.h + 1:]) AS x FROM h LEFT JOIN w ON w.c = h.b),
q AS (SELECT c, x AS full_, d, x[1:d] AS k, x[1:d - 1] AS p FROM (SELECT *, unnest(range(0, len(x) + 1)) AS d FROM s)),
n AS (SELECT d, k, any_value(p) AS p, min(c) AS c, count(*) AS n, any_value(CASE WHEN d > 0 THEN length(k[-1].t) ELSE 0 END) AS chars,
        sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(full_) = d), '')) AS ends FROM q GROUP BY d, k),
m AS (SELECT d - 1 AS d, p AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN m USING (d, k)),
a AS (SELECT i AS d, k[1:i] AS k, sum((kids = 0)::INT) AS leaves, sum((n - 1) * chars) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM f) GROUP BY ALL)
SELECT f.c AS conv_id, f.d AS depth, g.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN a USING (d, k) LEFT JOIN n g ON g.d = f.d - 1 AND g.k = f.p""".replace("@CRC", CRC32.replace("@", "c::VARCHAR")),
    "op13_spelling_variants": r"""
WITH r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT w, n, @CRC AS h FROM c),
e AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h),
d AS (SELECT w, sum(n)::BIGINT AS n FROM e WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
x AS (SELECT w, n, i, substr(w, 1, i) AS p, substr(w, i + 2) AS s FROM (SELECT *, unnest(range(0, length(w))) AS i FROM d)),
y AS (SELECT a.w, b.w AS v FROM x a JOIN x b USING (i, p, s) WHERE a.w <> b.w UNION SELECT x.w, d.w FROM x JOIN d ON d.w = x.p || x.s UNION SELECT d.w, x.w FROM x JOIN d ON d.w = x.p || x.s),
z AS (SELECT y.w, count(*) AS near, max(n) AS most FROM y JOIN d ON d.w = y.v GROUP BY y.w),
f AS (SELECT z.w, min(encode(v)) AS form FROM z JOIN y USING (w) JOIN d ON d.w = y.v WHERE d.n = most GROUP BY z.w),
g AS (SELECT d.w, d.n, coalesce(near, 0) AS near, CASE WHEN most >= 5 * d.n THEN decode(form) END AS form, CASE WHEN most >= 5 * d.n THEN most END AS form_n FROM d LEFT JOIN z USING (w) LEFT JOIN f USING (w)),
t(w, root) AS (SELECT w, w FROM g WHERE form IS NULL UNION ALL SELECT g.w, t.root FROM g JOIN t ON g.form = t.w)
SELECT w AS word, form, root, n, near AS n_near, form_n FROM g JOIN t USING (w)""".replace("@CRC", CRC32.replace("@", "concat(doc_id, ':', w)")).replace("WITH r", "WITH RECURSIVE r"),
}
