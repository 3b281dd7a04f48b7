"""Main text of pages written by hand: what stands between « and » is the article. Half of them have neither semantic tags nor telling names."""

import html
import re
from collections import Counter

import pytest

from lexisift.llm import html_text

P = [
    "The harbour was quiet that morning, and the boats lay still under a thin layer of frost that had formed overnight.",
    "Nobody had expected the ferry to arrive before noon, so the few people on the quay were surprised to see it.",
    "Later in the week the council met to discuss the repairs, which had been delayed three times since the spring.",
    "According to the engineer, the wall would need at least two more years of work before it could be called safe.",
    "The decision was put off again, and the fishermen went home without an answer, as they had the year before.",
]
Q = [
    "Roast the seeds in a dry pan until they begin to pop, then take them off the heat at once.",
    "Grind them with salt, two cloves of garlic and a little oil. The paste keeps for a week in a cold place.",
    "Cut the roots into long pieces, turn them in the paste and bake them for forty minutes; they should be dark at the ends.",
    "Serve with lemon.",
]
R = ["We moved the old database to the new machine in three nights. No rows were lost.", "What took longest wasn't the copying, but finding every program that still wrote to the old one: there were eleven, and two had no owner.", "A week later we switched the old machine off."]
p, q, r = ("".join(f"<p>{x}</p>" for x in xs) for xs in (P, Q, R))
pn, qn = "\n".join(f"<p>{x}" for x in P), "\n".join(f"<p>{x}" for x in Q)
br = lambda xs: "<br><br>".join(xs)
div = lambda xs: "".join(f"<div>{x}</div>" for x in xs)
UL = "<ul>" + "".join(f'<li><a href="/{i}">{w}</a></li>' for i, w in enumerate("Home News Sport Weather Contact About".split())) + "</ul>"
BAR = " | ".join(f'<a href="/{i}">{w}</a>' for i, w in enumerate("Home Articles Archive Links Imprint".split()))
COL = "<br>".join(f'<a href="/{i}">{w}</a>' for i, w in enumerate("Start Products Prices Service Press Jobs".split()))
REL = '<ul><li><a href="1">Ferry runs aground</a></li><li><a href="2">Council elects chair</a></li><li><a href="3">Storm warning lifted</a></li></ul>'
SEARCH = '<form action="/s"><input name="q"><button>Search</button></form>'

UNNAMED = {
    "bare paragraphs": f"«{p}»",
    "bare paragraphs without ends": f"«{pn}»",
    "heading and paragraphs": f"«<h1>Harbour wall repairs delayed</h1>{p}»",
    "heading and two paragraphs": f"«<h1>Harbour wall repairs delayed</h1>{P[0]}<p>{P[1]}</p>»",
    "link block and article block": f"<div>{BAR}</div><div>«<h1>Harbour wall</h1>{p}»</div>",
    "list, article, small print": f"<div>{UL}</div><div>«<h1>Baked roots</h1>{q}»</div><div>Copyright 2020. {BAR}</div>",
    "hashed classes": f'<div class="css-1x2a">{UL}</div><div class="css-9k2f">«<h1>Harbour wall</h1>{p}»</div><div class="css-7z1b"><p>Copyright 2020 The Paper.</p></div>',
    "numbered classes": f"<div class=c1>{UL}</div><div class=c3>«{div(P)}»</div>",
    "blocks instead of paragraphs": f'<div class="a1">{BAR}</div><div class="a2">«<div>Moving house</div>{div(R)}»</div><div class="a3">{BAR}</div>',
    "layout table": f"<table><tr><td width=150>{COL}</td><td><font size=2>«{br(P)}»</font></td></tr></table>",
    "layout table with rows": f"<table width=100%><tr><td colspan=2>{BAR}</td></tr><tr><td>{COL}</td><td>«<h1>Baked roots</h1>{q}»</td></tr><tr><td colspan=2>Copyright 2001</td></tr></table>",
    "line breaks": f"<div>{BAR}</div><div>«{br(P)}»</div>",
    "deep nesting": f"<div><div><div>{UL}</div><div><div>«<h1>Harbour wall</h1><div>{p}</div>»</div></div></div><div>{BAR}</div></div>",
    "related links": f"<div>{UL}</div><div>«<h1>Harbour wall</h1>{p}»</div><div><h3>More stories</h3>{REL}</div><div>Contact | Imprint | Terms</div>",
    "search box": f"<div>{SEARCH}{UL}</div><div>«<h1>Baked roots</h1>{q}»</div>",
    "article list items": f"<div>{UL}</div><div>«<h1>Baked roots</h1><p>{Q[0]}</p><ul><li>{Q[1]}</li><li>{Q[2]}</li></ul><p>{P[1]}</p>»</div>",
    "subheadings": f"<div>{BAR}</div><div>«<h1>Two notes</h1><h2>The harbour</h2>{p}<h2>The kitchen</h2>{q}»</div>",
    "inline links": f"<div>{UL}</div><div>«<h1>Harbour wall</h1><p>{P[0]} See <a href='/x'>the report</a> of that day.</p>{p}»</div>",
    "centred": f"<center>{BAR}</center><div>«<h1>Moving house</h1>{r}»</div><center>{BAR}</center>",
    "scripts between": f"<script>var a = '<p>no</p>';</script><div>{UL}</div><style>p {{ color: red }}</style><div>«<h1>Harbour wall</h1>{p}»</div><script>track()</script>",
}
NAMED = {
    "article": f"<nav>{UL}</nav><article>«<h1>Harbour wall</h1>{p}»</article><footer>&copy; 2020 The Paper</footer>",
    "main and aside": f"<header><div class=logo>The Paper</div>{BAR}</header><main>«<h2>Harbour wall</h2>{p}»</main><aside><h3>Popular</h3>{REL}</aside><footer><p>All rights reserved.</p></footer>",
    "blog": f'<div id="page"><div id="masthead"><div class="site-title">My blog</div>{UL}</div><div id="content">«<h2>Harbour wall</h2>{p}»</div><div id="colophon"><p>Proudly powered by a blog engine. Theme by someone.</p></div></div>',
    "comments": f'<article>«<h1>Baked roots</h1>{q}»</article><div class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>Lovely, thank you for this.</p></div><div class="comment"><b>Bob</b><p>Mine burnt after half an hour, so watch the oven.</p></div></div>',
    "advert inside": f'<article>«<h1>Harbour wall</h1><p>{P[0]}</p>»<div class="advert">Buy two, get one free! Only today.</div>«<p>{P[1]}</p><p>{P[2]}</p>»</article>',
    "cookie notice": f'<div class="cookie-notice"><p>We use cookies to make this site better. By going on you agree.</p><button>OK</button></div><main>«<h1>Moving house</h1>{r}»</main>',
    "newsletter": f'<nav>{BAR}</nav><article>«<h1>Harbour wall</h1>{p}»</article><section class="newsletter"><p>Get our best stories by mail every Friday.</p>{SEARCH}</section>',
    "sidebar": f'<div class="wrapper"><div class="sidebar"><h3>Topics</h3>{UL}</div><div class="post">«<h1>Baked roots</h1>{q}»</div></div>',
    "entry content": f'<div class="site-header">{BAR}</div><div class="entry-content">«{p}»</div><div class="site-footer">Imprint</div>',
    "section article": f"<header>{UL}</header><section><article>«<h1>Moving house</h1>{r}»</article></section><footer>{BAR}</footer>",
    "role main": f'<div role="navigation">{UL}</div><div role="main">«<h1>Harbour wall</h1>{p}»</div>',
    "breadcrumb": f'<div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/n">News</a></div><article>«<h1>Harbour wall</h1>{p}»</article>',
    "share buttons": f'<article>«<h1>Harbour wall</h1>{p}»<div class="share"><a href="#">Share</a> <a href="#">Mail</a> <a href="#">Print</a></div></article>',
    "related": f'<main><article>«<h1>Baked roots</h1>{q}»</article><div class="related-posts"><h3>Related</h3>{REL}</div></main>',
    "quote and figure": f'<nav>{UL}</nav><article>«<h1>Harbour wall</h1><p>{P[0]}</p><blockquote><p>{P[3]}</p></blockquote><figure><img src="a.png"><figcaption>The wall in March</figcaption></figure><p>{P[4]}</p>»</article>',
    "code": f'<nav>{BAR}</nav><main>«<h1>Moving house</h1>{r}<pre>copy --from old --to new</pre><p>{P[2]}</p>»</main>',
    "references": "<nav>" + UL + "</nav><article>«<h1>Caf&eacute; &amp; bar</h1><p>It opened at 7&nbsp;o&rsquo;clock, and the queue went round the corner &mdash; twice.</p>" + p + "»</article>",
    "two menus": f'<div class="topbar">{BAR}</div><div id="nav">{UL}</div><div id="main">«<h1>Harbour wall</h1>{p}»</div><div id="footer">{BAR}</div>',
    "login form": f'<form class="login"><label>Name</label><input><label>Password</label><input type=password><button>Log in</button></form><div class="content">«<h1>Moving house</h1>{r}»</div>',
    "upper case": f"<NAV>{UL}</NAV><ARTICLE>«<H1>Harbour wall</H1>{p}»</ARTICLE><FOOTER>The end of the page</FOOTER>",
}


def words(source: str) -> list[str]:
    return html.unescape(re.sub(r"<[^>]*>", " ", source)).split()


def truth_and_page(marked: str) -> tuple[list[str], str]:
    truth = [w for part in re.findall("«(.*?)»", marked, re.S) for w in words(part)]
    return truth, "<html><head><title>The Paper</title></head><body>" + marked.replace("«", "").replace("»", "") + "</body></html>"


def f1(got: list[str], want: list[str]) -> float:
    same = sum((Counter(got) & Counter(want)).values())
    return 2 * same / max(1, len(got) + len(want))


@pytest.fixture(scope="module")
def scored():
    models, out = html_text.trained(), {}
    for name, marked in (UNNAMED | NAMED).items():
        truth, page = truth_and_page(marked)
        out[name] = f1(html_text.extract([page], models)[0].split(), truth)
    return out


def test_pages_by_hand(scored):
    assert len(UNNAMED) == len(NAMED) == 20
    for names in (UNNAMED, NAMED):
        own = {n: scored[n] for n in names}
        print({n: round(x, 3) for n, x in own.items() if x < 0.99})
        assert sum(own.values()) / 20 >= 0.9 and min(own.values()) > 0.5


def test_no_page_with_prose_is_empty(scored):
    assert all(x > 0 for x in scored.values())
    page = html_text.parse_page(f"<div>{UL}</div><div><div>{p}</div></div>")
    never = html_text.np.full(len(page.tag), -9.0)
    assert html_text.kept_text(page, html_text.likeliest(page, never)) == " ".join(P)
    empty = html_text.parse_page(f"<div>{UL}</div>")
    assert not any(html_text.likeliest(empty, html_text.np.full(len(empty.tag), -9.0)))
