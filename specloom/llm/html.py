"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import html as references
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements whose content is not markup, elements that are part of a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style"
#: Elements whose text is not shown, those that a head can hold, those that end a drawing or a formula, and where these don't.
HIDDEN = frozenset("template noscript svg math iframe object canvas head".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HOLDS_MARKUP = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_ITSELF = frozenset("p li dt dd option tr td th".split())

ATTRS = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
EMPTY = r"(?:\"[^\"]*\"|'[^']*'|=\s*+[^\s\"'>]++|[^>\"'=/]|=|/(?!>))*+/>"  # ends in a slash that is no part of a value
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?!{EMPTY}){ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<title>title)\b{ATTRS}>[^<]*+(?:<(?!/?(?:title|head|body)\b)[^<]*+)*+</title\s*>"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>{ATTRS})>|</?[a-zA-Z][^>]*>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
UNQUOTED = re.compile(r"=\s*[^\s\"']*\Z")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

SIZE = 4096  # hashed features


@dataclass
class Block:
    path: frozenset[str]  # tags and name parts of all ancestors
    tag: str
    text: str
    linked: int  # characters inside links
    role: str = ""  # what the innermost ancestor is that tells


def tokens(page: str) -> Iterator[re.Match | dict]:
    """Tags, comments, raw elements and text, in one pass: behind the last ">" no tag can end, so none is looked for there."""
    end = page.rfind(">") + 1
    m = None
    for m in TOKEN.finditer(page, 0, end):
        yield m
    rest = page[end:].split("<!--")[0]
    if m and ((m["raw"] and not re.search(rf"</{m['raw']}\s*>\Z", m[0], re.I)) or (m[0].startswith("<!--") and not m[0].endswith("-->"))):
        return  # what is open takes all the rest
    if rest:
        yield {"text": rest}


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order: runs of text between the ends of block elements, white space as one space.

    Text of hidden elements goes. One that is left open ends with what it stands in; a head ends at the
    first text or tag that can't stand in it, a drawing or formula at the first tag that breaks out.
    Takes time in proportion to the page, however deep or broken it is.
    """
    stack: list[tuple[str, tuple[str, ...], str]] = []
    above: Counter[str] = Counter()  # tags and names on the stack
    hidden: list[int] = []  # places of hidden elements on the stack
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def push(tag: str, names: tuple[str, ...]) -> None:
        stack.append((tag, names, role_of(tag, names) or (stack[-1][2] if stack else "")))
        above.update((tag, *names))

    def pop() -> None:
        tag, names, _ = stack.pop()
        for x in (tag, *names):
            if above[x] == 1:
                del above[x]
            else:
                above[x] -= 1

    def cut(at: int) -> None:
        while len(stack) > at:
            pop()
        while hidden and hidden[-1] >= at:
            hidden.pop()

    def place(tag: str) -> int | None:
        """The innermost open element of this tag."""
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if tag in above else None

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            if text:
                tag = next((t for t, _, _ in reversed(stack) if t not in INLINE), "")
                out.append(Block(frozenset(above), tag, text, min(linked, len(text)), stack[-1][2] if stack else ""))
            parts.clear()
        linked = 0

    for m in tokens(page):
        if (text := m["text"]) is not None:
            if hidden and stack[-1][0] == "head" and text.strip():
                cut(hidden[-1])
            if hidden:
                continue
            parts.append(text)
            if "a" in above:
                linked += len(text)
            continue
        if m["raw"] or m["title"]:
            if not hidden:
                parts.append(" ")
            continue
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        opens = not m["end"] and tag not in VOID and not (m["attrs"].endswith("/") and not UNQUOTED.search(m["attrs"]))
        if hidden:
            if m["end"]:
                at = place(tag)
                if at is None:
                    continue
                cut(max(at, hidden[0]))
                if at >= len(stack):
                    continue
            else:
                within = stack[hidden[-1]][0]
                if tag == "body" and stack[hidden[0]][0] == "head":
                    cut(hidden[0])
                elif (within == "head" and tag not in IN_HEAD) or (
                    within in ("svg", "math") and tag in BREAKS_OUT and not any(t in HOLDS_MARKUP for t, _, _ in stack[hidden[-1] :])
                ):
                    cut(hidden[-1])
                if hidden:
                    if opens:
                        if tag in HIDDEN and not (tag == "head" and within == "head"):
                            hidden.append(len(stack))
                        push(tag, ())
                    continue
        if tag in HIDDEN and not m["end"]:
            parts.append(" ")
            if opens and not (tag == "head" and "body" in above):
                hidden.append(len(stack))
                push(tag, ())
            continue
        if tag == "br":
            parts.append("\n")
        elif tag not in INLINE:
            flush()
        if m["end"]:
            at = place(tag)
            if at is not None:
                cut(at)
        elif opens:
            if tag in CLOSES_ITSELF or tag not in INLINE:
                # inline elements that were left open end with their block; so does a p or li that the next one closes
                while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p" or (stack[-1][0] == tag and tag in CLOSES_ITSELF)):
                    pop()
            names = tuple("." + x.lower() for a in NAMES.findall(m["attrs"]) for x in PART.findall("".join(a))) if m["attrs"] else ()
            push(tag, names)
    flush()
    return out


def bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def features(b: Block, count: int = 9, drop: frozenset[str] = frozenset()) -> list[str]:
    """Names of the features that hold: ancestors, their names, what the text looks like, and how many blocks the page has."""
    words = b.text.split()
    n = len(words)
    ends = b.text[-1] in ".!?:;…\"”»)"
    dense = b.linked / len(b.text)
    shape = f"{bucket(n, (2, 4, 8, 16, 32, 64))}{'e' if ends else '-'}{bucket(dense, (0.01, 0.34, 0.67))}"
    out = ["bias", f"p{bucket(count, (2, 3, 5, 9))}", f"t{shape}", f"n{shape[0]}", f"d{shape[2]}", f"e{ends}", f"u{bucket(sum(w[0].isupper() for w in words) / n, (0.2, 0.5, 0.8))}", f"c{bool(re.search('[©|»›]', b.text))}", f"g{bucket(sum(c.isdigit() for c in b.text) / len(b.text), (0.05, 0.2))}"]
    for x in {*b.path, f"in-{b.tag}"}:
        if x not in drop:
            out.append("a" + x)
    if f"r{b.role}" not in drop:
        out += [f"r{b.role}", f"r{b.role}-{b.tag}"]
    return out


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode()) % SIZE for x in names]


@dataclass
class Crf:
    """Two labels, main text or not: a weight a feature for main text, and one for each pair of neighbours."""

    weight: np.ndarray
    pair: np.ndarray

    def decode(self, page: list[Block]) -> list[bool]:
        """The likeliest labels of the whole chain, by Viterbi."""
        best = [0.0, 0.0]
        back: list[tuple[int, int]] = []
        for i, b in enumerate(page):
            own = (0.0, float(self.weight[hashed(features(b, len(page)))].sum()))
            if i:
                step = [max((best[p] + self.pair[p, q], p) for p in (0, 1)) for q in (0, 1)]
                back.append((step[0][1], step[1][1]))
                best = [step[q][0] + own[q] for q in (0, 1)]
            else:
                best = list(own)
        if not page:
            return []
        label = int(best[1] > best[0])
        out = [label]
        for p in reversed(back):
            label = p[label]
            out.append(label)
        return [bool(x) for x in reversed(out)]


def fit(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 16, rate: float = 0.5, decay: float = 1e-3, pair_decay: float = 0.1) -> Crf:
    """Gradient ascent on the likelihood of the labels, page by page, by forward and backward sums (AdaGrad).

    Weights of pairs decay faster, lest long stretches of one label outweigh what a block in between says of itself.
    """
    weight, pair = np.zeros(SIZE), np.zeros((2, 2))
    seen_w, seen_p = np.full(SIZE, 1e-2), np.full((2, 2), 1e-2)
    order = random.Random(3)
    pages = list(pages)
    for _ in range(rounds):
        order.shuffle(pages)
        for xs, ys in pages:
            n = len(xs)
            own = np.array([[0.0, weight[x].sum()] for x in xs])
            fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
            fore[0] = own[0]
            for i in range(1, n):
                fore[i] = own[i] + np.logaddexp(fore[i - 1, 0] + pair[0], fore[i - 1, 1] + pair[1])
            for i in range(n - 2, -1, -1):
                nxt = own[i + 1] + aft[i + 1]
                aft[i] = np.logaddexp(pair[:, 0] + nxt[0], pair[:, 1] + nxt[1])
            total = np.logaddexp(*fore[-1])
            prob = np.exp(fore + aft - total)
            gp = np.zeros((2, 2))
            for i in range(n - 1):
                gp -= np.exp(fore[i][:, None] + pair + (own[i + 1] + aft[i + 1])[None, :] - total)
                gp[ys[i], ys[i + 1]] += 1
            gw = np.zeros(SIZE)
            for x, y, p in zip(xs, ys, prob[:, 1], strict=True):
                gw[x] += y - p
            gw -= decay * weight
            gp -= pair_decay * pair
            seen_w += gw * gw
            seen_p += gp * gp
            weight += rate * gw / np.sqrt(seen_w)
            pair += rate * gp / np.sqrt(seen_p)
    return Crf(weight, pair)


#: Names that page authors give to parts of a page, for the labelled pages.
MAIN = "content main article post entry story body text page-content post-body article-body entry-content main-content story-text".split()
OTHER = {
    "menu": "nav menu navbar navigation breadcrumb topbar toolbar tabs links".split(),
    "header": "header masthead banner branding site-header page-header logo".split(),
    "footer": "footer site-footer copyright bottom colophon legal imprint contentinfo".split(),
    "side": "sidebar aside related widget recommended popular trending more also-read rail complementary".split(),
    "notice": "cookie consent notice gdpr privacy alert newsletter subscribe popup modal paywall".split(),
    "advert": "ad ads advert advertisement promo sponsored sponsor banner-ad".split(),
    "form": "form search login signup contact".split(),
    "comments": "comments comment reply discussion responses disqus".split(),
    "share": "share social follow tags meta byline author".split(),
}


#: What elements are by their tag, and by the parts of their names: those of other parts of a page before those of main text.
TAG_ROLES = {"article": "main", "main": "main", "nav": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form"}
MAIN_PARTS = frozenset(p for name in MAIN for p in name.split("-"))
NAME_ROLES = {f".{p}": kind for kind, names in OTHER.items() for name in names for p in name.split("-") if p not in MAIN_PARTS and p not in ("site", "box", "also", "read", "more", "links", "top", "bottom", "tags", "meta")}
NAME_ROLES |= {f".{p}": "main" for p in MAIN_PARTS - {"page"}}


def role_of(tag: str, names: tuple[str, ...]) -> str:
    """What part of a page an element is, if its names or tag tell; names of main text are the weakest hint."""
    found = {NAME_ROLES[x] for x in names if x in NAME_ROLES}
    return min(found - {"main"}, default="") or TAG_ROLES.get(tag, "") or min(found, default="")


def labelled_page(rng: random.Random, sentences: list[str]) -> list[tuple[Block, int]]:
    """A page of known labels: main text under one of many wrappings, other parts around and within it."""

    def prose(n: int) -> str:
        return " ".join(rng.choice(sentences) for _ in range(n))

    def words(n: int) -> str:
        return " ".join(rng.choice(rng.choice(sentences).split()) for _ in range(n)).strip(".,")

    def other(kind: str) -> str:
        name = rng.choice(OTHER[kind])
        own = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}.get(kind, "section")
        tag = rng.choice([own, own, "div", "section" if kind == "comments" else "div"])
        names = "" if tag == own != "section" and rng.random() < 0.5 else f' {rng.choice(["class", "id"])}="{name}"'
        if kind == "menu":
            inner = "<ul>" + "".join(f'<li><a href="#">{words(rng.randint(1, 2))}</a></li>' for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 7, 8, 9]))) + "</ul>"
            if rng.random() < 0.3:
                inner = " ".join(f'<a href="#">{words(rng.randint(1, 2))}</a>' for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))
        elif kind == "footer":
            inner = f"&copy; {words(2)} {rng.randint(1999, 2030)} {rng.choice(["&middot; " + prose(1), words(2), ""])}" if rng.random() < 0.5 else f"<p>{rng.choice([words(rng.randint(2, 6)) + '.', prose(1)])}</p>"
        elif kind == "form":
            inner = f"<label>{words(2)}</label><input name=q><button>{words(1)}</button><p>{words(4)}</p>"
        elif kind == "comments":
            inner = f"<h3>{words(2)}</h3>" + "".join(f'<div class="{name}"><b>{words(1)}</b><p>{prose(rng.randint(1, 3))}</p></div>' for _ in range(rng.randint(1, 5)))
        elif kind == "side":
            inner = f"<h3>{words(2)}</h3>" * (rng.random() < 0.7) + "".join(f'<p><a href="#">{words(rng.randint(3, 9))}</a></p>' if rng.random() < 0.6 else f"<p>{prose(1)}</p>" for _ in range(rng.randint(1, 5)))
        else:
            inner = f"<p>{prose(rng.randint(1, 2))}</p>" if rng.random() < 0.5 else prose(1)
        return f"<{tag}{names}>{inner}</{tag}>"

    bare = rng.random() < 0.25  # a short text, often alone on its page
    shape = [(f"<h1>{words(rng.randint(1, 9))}</h1>", 1)] if rng.random() < (0.3 if bare else 0.9) else []
    for _ in range(rng.randint(1, 3) if bare else 0):
        tag = rng.choice(["p", "p", "p", "pre", "div", "li", "blockquote"])
        inner = words(rng.randint(1, 6)) if rng.random() < 0.7 else prose(1)
        shape.append((f"<{tag}>{inner}</{tag}>", 1))
    for _ in range(0 if bare else rng.randint(1, 14)):
        kind = rng.random()
        inner = prose(rng.randint(1, 7)) if kind < 0.85 else words(rng.randint(1, 6))
        tag = "p" if kind < 0.9 else rng.choice(["h2", "li", "blockquote", "td", "div"])
        if kind < 0.15:
            inner = f"<b>{inner}"
        shape.append((f"<{tag}>{inner}</{tag}>", 1))
        if rng.random() < 0.2:
            shape.append((other(rng.choice(["advert", "share", "side", "notice", "form", "comments", "advert"])), 0))
    if rng.random() < 0.35:  # a note, figure or licence that belongs to the text
        note = " ".join(w.upper() if rng.random() < 0.3 else w.title() for w in words(rng.randint(2, 6)).split())
        shape.insert(rng.choice([len(shape), len(shape), rng.randint(0, len(shape))]), (f"<p>{note} {rng.choice(['', f'{rng.uniform(0, 99):.1f}', str(rng.randint(1, 2030))])}.</p>", 1))
    wrap = rng.choice(["article", "main", "article", "div", "section"])
    wrap, close = (f"<{wrap}>" if wrap in ("article", "main") and rng.random() < 0.7 else f'<{wrap} class="{rng.choice(MAIN)}">'), f"</{wrap}>"
    if bare and rng.random() < 0.3:
        wrap = close = ""
    most = 0.5 if not bare else rng.choice([0, 0, 0.3])
    before = [(other(k), 0) for k in ("header", "menu", "notice", "advert", "side") if rng.random() < most]
    after = [(other(k), 0) for k in ("share", "comments", "side", "advert", "form", "notice", "footer") if rng.random() < most]
    rng.shuffle(before)
    inside = [x for x in after if rng.random() < 0.4]
    after = [x for x in after if x not in inside]
    out = []
    for part, label in before:
        out += [(b, label) for b in blocks(f"<body>{part}")]
    for part, label in shape + inside:
        out += [(b, label) for b in blocks(f"<body>{wrap}{part}{close}")]
    for part, label in after:
        out += [(b, label) for b in blocks(f"<body>{part}")]
    return out


def train(sample: list[str], pages: int = 400, seed: int = 9) -> Crf:
    """Fit on `pages` labelled pages whose sentences come from the sampled pages (or are made up, without any).

    Structure features are hidden from one page in five, so that text features count where structure says nothing.
    """
    rng = random.Random(seed)
    sentences = sorted({s for page in sample for b in blocks(page) for s in re.findall(r"[^.!?]{8,400}[.!?]", b.text)})
    rng.shuffle(sentences)
    sentences = sentences[:2000] or ["Word by word the text goes on.", "So it ends, as all things do.", "Nothing else was said of it."]
    labelled = [labelled_page(rng, sentences) for _ in range(pages)]
    data = []
    for page in labelled:
        hidden = frozenset({x for b, _ in page for x in (*b.path, f"in-{b.tag}", f"r{b.role}")}) if rng.random() < 0.2 else frozenset()
        data.append(([hashed(features(b, len(page), hidden)) for b, _ in page], [y for _, y in page]))
    return fit(data)


def main_text(page: str | None, model: Crf) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, model.decode(found), strict=True) if keep)


def extract(pages: DataFrame, sample: int = 64) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    The field is fitted on the driver to labelled pages made from the sentences of `sample` pages, those
    of least hash of page_id; it then goes to every task, and rows keep their partitions.

    A null or empty page has an empty text. Repeated rows are extracted each. Only page_id, url and html
    are read. An empty table gives no rows; the field is then fitted to made-up sentences.
    """
    ids = pages.select("page_id").filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    texts = [r[0] for r in pages.join(ids, "page_id", "left_semi").orderBy(F.xxhash64("page_id"), "page_id").select(F.coalesce("html", F.lit(""))).limit(sample).collect()]
    model = train(texts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(h, model) for h in frame["html"].tolist()]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
