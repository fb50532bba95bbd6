"""Main text of literal pages with other parts around and inside the article."""

import random

import pytest

from specloom.llm import html

P = "The river runs under an old bridge, and people walk along its quiet banks."
Q = "Nobody knows who built it, but the stones are older than the town itself."
A = f"<h1>The old bridge</h1><p>{P}</p><p>{Q}</p>"
W = f"The old bridge\n\n{P}\n\n{Q}"
PAGES = [
    (f"<main>{A}<div class='comment'><p>Great post! Thanks for it.</p></div></main>", W),
    (f"<article>{A}<form><label>Email</label><button>Subscribe now</button></form></article>", W),
    (f"<article>{A}</article><footer><p>All rights reserved.</p></footer>", W),
    (f"<article>{A}<section class='comments'><h3>2 comments</h3><div class='comment'><b>Ann</b><p>I walked there last year and it was lovely.</p></div><div class='comment'><b>Bo</b><p>Me too.</p></div></section></article>", W),
    (f"<article><h1>The old bridge</h1><p>{P}</p><div class='ad'><p>Buy two, get one free. Only today in our shop.</p></div><p>{Q}</p></article>", W),
    (f"<article><h1>The old bridge</h1><p>{P}</p><aside><p>Read also: the new tower.</p></aside><p>{Q}</p></article>", W),
    (f"<nav><a href=/>Home</a> <a href=/n>News</a></nav><main>{A}</main><footer>&copy; 2020 The Daily</footer>", W),
    (f"<header><p>The Daily Paper</p></header><div class='content'>{A}</div><div class='sidebar'><p><a href=/x>The ten best bridges of the world</a></p></div>", W),
    (f"<div id='cookie'><p>We use cookies to improve your visit. Do you agree?</p><button>Yes</button></div><article>{A}</article>", W),
    (f"<div class='post'>{A}<div class='share'><a href=#>Share</a> <a href=#>Tweet</a></div></div>", W),
    (f"<div class='entry-content'>{A}<div class='newsletter'><p>Subscribe to our letter and never miss a story.</p></div></div>", W),
    (f"<section class='story'>{A}<div class='related'><h3>Related</h3><p><a href=#>More about bridges in our town</a></p></div></section>", W),
    (f"<article>{A}<footer><p>Filed under travel.</p></footer></article>", W),
    (f"<article>{A}<div class='promo'><p>Sponsored: the best shoes for long walks.</p></div></article>", W),
    (f"<main><article>{A}</article><section id='comments'><h2>Comments</h2><p>First! What a nice text this was.</p></section></main>", W),
    (f"<div role='navigation'><ul><li><a href=#>One</a></li><li><a href=#>Two</a></li></ul></div><div role='main'>{A}</div><div role='contentinfo'><p>Contact us at any time.</p></div>", W),
    (f"<article>{A}<form class='search'><label>Search</label><input><button>Go</button></form></article>", W),
    (f"<div class='page'><div class='masthead'><p>Our town, our news.</p></div><article>{A}</article><div class='legal'><p>Terms and imprint.</p></div></div>", W),
    (f"<article>{A}<div class='comments'><ul><li><p>So true, and well written too.</p></li><li><p>Where is that bridge?</p></li></ul></div></article>", W),
    (f"<article><h1>The old bridge</h1><div class='byline share'><a href=#>Follow</a></div><p>{P}</p><p>{Q}</p><ul><li>{P}</li></ul></article>", W + "\n\n" + P),
    (f"<main><h1>The old bridge</h1><blockquote>{P}</blockquote><p>{Q}</p></main><div class='popup'><p>Stay a while and read on.</p></div>", W),
    (f"<body><div id='main'><h1>The old bridge</h1><p>{P}</p><div class='advertisement'>Advertisement</div><p>{Q}</p><div id='disqus'><p>Join the talk about this story.</p></div></div></body>", W),
]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    syllables = "ra ti mon de la ver su est ing er on pha qui lo men tar".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(4, 18))).capitalize() + rng.choice("...!?")
    return html.train([f"<p>{' '.join(sentence() for _ in range(12))}</p>" for _ in range(64)])


@pytest.mark.parametrize("at", range(len(PAGES)))
def test_parts_that_are_not_main_text_go(model, at):
    page, text = PAGES[at]
    assert html.main_text(page, model) == text


def test_roles():
    assert html.role_of("div", (".comment",)) == "comments"
    assert html.role_of("article", (".entry", ".content")) == "main"
    assert html.role_of("nav", ()) == "menu"
    assert html.role_of("div", (".x",)) == ""
