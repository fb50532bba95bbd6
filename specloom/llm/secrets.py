"""Secret scans: fixed patterns, and two character Markov models for what they miss."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: the patterns of the three base kinds and the least characters of what they must hold.
ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Runs that the models judge, and the characters they know: codes 43 to 122, "+" to "z".
RUN = r"[A-Za-z0-9+/_=-]{12,}"
LEAST_RUN, FIRST, CODES = 12, 43, 80
#: Pairs of classes that count as seen beforehand; shares of pairs, of second letters and of any letter in the likelihood of a letter.
KINDS_SEEN, MIXED = 4, (0.6, 0.3, 0.1)
#: A run is a secret if its log-likelihood ratio, summed over its character pairs, is over this much; of runs that follow the model of
#: identifiers, one in exp(threshold) does at most.
THRESHOLD = 10.0
#: Spans that are folded at a time: a fold copies what it has, so long ones are cut.
FOLD = 256

SPAN = "array<struct<start:bigint,end:bigint,rank:int,kind:string,value:string>>"


#: Name of the kind: pattern, group whose length counts. Runs of one class: the longer ones are the same whether or not the short ones match.
BASE = {"assign": (ASSIGN, 2), "access": (r"AKIA[A-Z0-9]{16,}", 0), "hex": (r"[0-9a-f]{24,}", 0)}


def chunks(array: str) -> Column:
    return F.when(F.size(array) > 0, F.transform(F.sequence(F.lit(1), F.size(array), F.lit(FOLD)), lambda i: F.slice(array, i, F.lit(FOLD))))


def running(array: str, step) -> Column:
    """0 and what `step` makes of each number and the last result."""
    return F.aggregate(array, F.array(F.lit(0).cast("long")), lambda out, n: F.concat(out, F.array(step(F.element_at(out, -1), n))))


def with_matches(rows: DataFrame, text: Column, kinds: dict[str, tuple[str, int]], least: dict[str, int]) -> DataFrame:
    """Add for each kind `_<kind>`, the array of (start, end, rank, kind, value) of the leftmost matches whose group has `least`
    characters, `_l_<kind>`, all matches as (whole, value, gap before), and `_b_<kind>`, the places where chunks of them begin and end.

    Spark tells what matched but not where: the parts between matches tell that, as running sums of lengths, `FOLD` matches at a
    time. Each step is a column of its own, as an expression within a lambda is computed for every element.
    """
    length = lambda m: (F.length(m["gap"]) + F.length(m["whole"])).cast("long")

    def located(pattern: str, group: int) -> Column:
        whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
        gap = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
        return F.when(F.rlike(text, F.lit(pattern)), F.arrays_zip(whole.alias("whole"), value.alias("value"), gap.alias("gap")))

    def fold(kind: str):
        rank = ["assign", "access", "hex", "markov"].index(kind)
        span = lambda acc, m: F.struct((acc["at"] + F.length(m["gap"])).alias("start"), (acc["at"] + length(m)).alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["value"].alias("value"))
        return lambda part: F.aggregate(
            part["c"],
            F.struct(part["at"].alias("at"), F.array().cast(SPAN).alias("out")),
            lambda acc, m: F.struct((acc["at"] + length(m)).alias("at"), F.when(F.length(m["value"]) >= least[kind], F.concat(acc["out"], F.array(span(acc, m)))).otherwise(acc["out"]).alias("out")),
            lambda acc: acc["out"],
        )

    rows = rows.withColumns({f"_l_{k}": located(*v) for k, v in kinds.items()})
    rows = rows.withColumns({f"_c_{k}": chunks(f"_l_{k}") for k in kinds})
    rows = rows.withColumns({f"_s_{k}": F.transform(f"_c_{k}", lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda at, m: at + length(m))) for k in kinds})
    rows = rows.withColumns({f"_b_{k}": running(f"_s_{k}", lambda at, n: at + n) for k in kinds})
    found = {k: F.flatten(F.transform(F.arrays_zip(F.col(f"_c_{k}").alias("c"), F.slice(f"_b_{k}", F.lit(1), F.size(f"_c_{k}")).alias("at")), fold(k))) for k in kinds}
    return rows.withColumns({f"_{k}": F.coalesce(v, F.array().cast(SPAN)) for k, v in found.items()}).drop(*[f"_{x}_{k}" for x in "cs" for k in kinds])


def without_assigned(text: Column) -> Column:
    """The text with blanks in place of the base spans of kind assign, all else at its place; beside `with_matches`."""
    blank = lambda m: F.when(F.length(m["value"]) >= LEAST["assign"], F.repeat(F.lit(" "), F.length(m["whole"]))).otherwise(m["whole"])
    parts = F.transform("_l_assign", lambda m: F.concat(m["gap"], blank(m)))
    return F.coalesce(F.concat(F.array_join(parts, ""), F.substring(text, (F.element_at("_b_assign", -1) + 1).cast("int"), F.lit(2147483647))), text)


def pair_counts(words: DataFrame) -> dict[int, int]:
    """How often each pair of known characters occurs in words, each `n` times; 6400 numbers at most."""
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"))
    pairs = pairs.select("n", (F.ascii("pair") - FIRST).alias("a"), (F.ascii(F.substring("pair", 2, 1)) - FIRST).alias("b")).filter(f"a between 0 and {CODES - 1} and b between 0 and {CODES - 1}")
    return {r[0]: r[1] for r in pairs.groupBy((F.col("a") * CODES + F.col("b")).alias("k")).agg(F.sum("n")).collect()}


def kind_of(x: int, y: int) -> tuple[str, str]:
    """Classes of two neighbours: letters (m in the other case than the one before), digits, marks."""
    a, b = chr(x + FIRST), chr(y + FIRST)
    one = lambda c: "l" if c.isalpha() else "d" if c.isdigit() else "s"
    return one(a), "m" if a.isalpha() and b.isalpha() and a.isupper() != b.isupper() else one(b)


def chain(seen: dict[int, int]) -> dict[int, float]:
    """Log-likelihood of each pair of known characters: how classes follow each other, times how letters do, whatever their case.

    A case by itself tells nothing, a change of it does; digits and marks are all alike. Letters are mixed from their pairs, the second
    letter alone and an even share, so that a pair that was never seen costs little.
    """
    alphabet = [i for i in range(CODES) if chr(i + FIRST).isalnum() or chr(i + FIRST) in "+/_=-"]
    fold = lambda x: chr(x + FIRST).lower()
    kinds, pairs, ends = Counter(), Counter(), Counter()
    for k, n in seen.items():
        x, y = divmod(k, CODES)
        if x in alphabet and y in alphabet:
            kinds[kind_of(x, y)] += n
            if chr(x + FIRST).isalpha() and chr(y + FIRST).isalpha():
                pairs[fold(x), fold(y)] += n
                ends[fold(y)] += n
    starts, total = Counter(), sum(ends.values())
    for (x, _), n in pairs.items():
        starts[x] += n
    after = lambda a: sum(kinds[a, b] for b in "lmds")
    out = {}
    for x in alphabet:
        for y in alphabet:
            a, b = kind_of(x, y)
            p = math.log((kinds[a, b] + KINDS_SEEN / 4) / (after(a) + KINDS_SEEN))
            if a == "l" and b in "lm":
                u, v = fold(x), fold(y)
                whole = pairs[u, v] / starts[u] if starts[u] else ends[v] / total if total else 1 / 26
                p += math.log(MIXED[0] * whole + MIXED[1] * (ends[v] / total if total else 1 / 26) + MIXED[2] / 26)
            out[x * CODES + y] = p
    return out


def train(docs: DataFrame, sample: int = 2000) -> list[float]:
    """Log-likelihood ratio of each character pair, random strings over ordinary identifiers.

    The labelled samples come from `sample` documents, those of least hash of doc_id: values of the base
    spans are random strings, unless they are made of letters alone; numbers, and words and names with underscores and hyphens, of 4 characters on and
    outside all base spans, are ordinary if two documents of the sample have them: a random string comes once. A quarter of the ordinary ones
    is held out: where more than one in a thousand of its runs of 12 characters would pass the threshold, all ratios are scaled
    down until no more do. Of an empty table both models are even.
    """
    ids = docs.select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    texts = docs.join(ids, "doc_id", "left_semi").select(F.coalesce("text", F.lit("")).alias("text"))
    texts = with_matches(texts, F.col("text"), BASE, LEAST)
    random = texts.select(F.explode(F.concat(*[f"_{k}" for k in BASE])).alias("v")).select(F.col("v.value").alias("word")).filter(F.col("word").rlike("[0-9]"))
    clean = F.regexp_replace(without_assigned(F.col("text")), r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", " ")
    plain = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(clean, F.lit(r"[A-Za-z_-]{4,}|[0-9]{4,}"), F.lit(0)))).alias("word"))
    plain = plain.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or word rlike '^[0-9]'")
    held = F.pmod(F.xxhash64("word"), F.lit(4)) == 0
    a, b = (chain(pair_counts(w)) for w in (random.filter("length(word) > 1").withColumn("n", F.lit(1)), plain.filter(~held)))
    out = [a[k] - b[k] if k in a else 0.0 for k in range(CODES * CODES)]
    tail = plain.filter(held & (F.length("word") >= LEAST_RUN)).agg(F.percentile_approx(score(F.col("word"), out), 0.999, 10000)).first()[0]
    scale = min(1.0, THRESHOLD / tail) if tail and tail > 0 else 1.0
    return [x * scale for x in out]


def score(word: Column, model: list[float]) -> Column:
    """Log-likelihood ratio, summed over the pairs of neighbours."""
    table = F.expr(f"cast(split('{','.join(f'{x:.4f}' for x in model)}', ',') as array<double>)")
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c) - FIRST)
    first = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(codes, first, lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.coalesce(F.get(table, acc["last"] * CODES + c), F.lit(0.0))).alias("sum")), lambda acc: acc["sum"])


def with_spans(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """`_row`, the row itself, and `_base` and `_spans`, arrays of (start, end, rank, kind, value) by start, then kind."""
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    found = with_matches(docs.select(F.struct(*docs.columns).alias("_row")), text, BASE, LEAST).withColumn("_masked", without_assigned(text))
    found = with_matches(found, F.col("_masked"), {"markov": (RUN, 0)}, {"markov": LEAST_RUN})
    found = found.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))
    # the characters of access and hex spans are characters of runs, so that a run which touches one holds it
    good = F.filter("_markov", lambda r: ~r["value"].rlike(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}") & (score(r["value"], model) > threshold))
    return found.withColumn("_spans", F.when(F.size("_markov") > 0, F.array_sort(F.concat("_base", good))).otherwise(F.col("_base")))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sealed(df: DataFrame, columns: list[Column]) -> DataFrame:
    """The columns, from a generator of one row: a later filter on them stays above it, where it would else be pushed down and write out
    again, at each use, all that its columns are computed from."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def scan(docs: DataFrame, sample: int = 2000) -> DataFrame:
    """One row a document with its secrets' counts by base kind and the spans of all kinds.

    Spans are those of whole matches, in code points, end exclusive. The models add runs of 12 characters and more
    that are likelier as a random string than as an identifier, by the sum over all pairs, and touch no base span.
    Null and empty texts have none. Very long texts and very many spans take time in proportion to a span's text and
    to the spans. Repeated rows are scanned each. An empty table gives no rows.
    Rows keep their partitions; only doc_id and text are read.
    """
    thin = docs.select("doc_id", "text")
    out = with_spans(thin, train(thin, sample))
    return sealed(out, [
        F.col("_row.doc_id").alias("doc_id"), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in LEAST], F.sha2(joined("_base"), 256).alias("base_sha256"), joined("_spans").alias("spans")
    ])


def redact(docs: DataFrame, sample: int = 2000, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by `mark` (spans that overlap by one) and n_chars set anew where it exists.

    Rows without spans, null and empty texts among them, stay as they are; repeated rows are each redacted. All columns are
    handed on under their names, whatever these are. An empty table gives no rows.
    """
    piece = lambda at, n: F.substring(F.col("_row.text"), (at + 1).cast("int"), n.cast("int"))

    def fold(part: Column) -> Column:
        return F.aggregate(
            part["c"],
            F.struct(part["at"].alias("at"), F.array().cast("array<string>").alias("out")),
            lambda acc, s: F.struct(
                F.greatest(acc["at"], s["end"]).alias("at"),
                F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(piece(acc["at"], s["start"] - acc["at"]), F.lit(mark)))).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    out = with_spans(docs, train(docs.select("doc_id", "text"), sample)).withColumn("_cut", chunks("_spans"))
    # how far all spans before a chunk reach
    out = out.withColumn("_ends", F.transform("_cut", lambda c: F.array_max(F.transform(c, lambda s: s["end"])))).withColumn("_reach", running("_ends", F.greatest))
    parts = F.flatten(F.transform(F.arrays_zip(F.col("_cut").alias("c"), F.slice("_reach", F.lit(1), F.size("_cut")).alias("at")), fold))
    done = F.concat(F.array_join(parts, ""), piece(F.element_at("_reach", -1), F.lit(2147483647)))
    new = {"text": F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    out = out.withColumn("_text", F.when(F.size("_spans") > 0, done))
    return sealed(out, [F.coalesce(new[c], F.col(f"_row.`{c}`")).alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
