"""Main text extraction on pages whose content is known."""

from __future__ import annotations

import random
import re

import pytest

from panelkit.llm import html_text

PAGES = "page_id long, url string, html string, text string, n_chars long"


def page(seed: int) -> tuple[str, str]:
    r = random.Random(seed)
    words = lambda n: " ".join(r.choice(["alpha", "béta", "gamma", "delta,", "x."]) for _ in range(n))
    blocks = [words(r.choice([1, 2, 15, 60, 150])) for _ in range(r.randint(1, 9))]
    boiler = [
        f"<nav><ul>{''.join(f'<li><a href=/{i}>{words(1)}</a></li>' for i in range(6))}</ul></nav>",
        f'<div class="ad">{words(12)}</div>', f'<div id="cookie-notice"><p>{words(25)}</p></div>', f"<aside><p>{words(30)}</p></aside>",
        f"<header><div>{words(5)}</div></header>", f"<form><label>{words(4)}</label><button>Go</button></form>", "<script>var t='</p><p>no';</script>",
    ]
    r.shuffle(boiler)
    article = "".join(r.choice(["<p>%s</p>", "<p>%s", "<p>\n %s <br></p>", "<h2>%s</h2>", "<p><b>%s</b><p>"]) % b.replace(" ", r.choice([" ", "\n ", " <i>"]), 1).replace("x.", "x&#46;") for b in blocks)
    comments = f'<section class="comments"><p>{words(40)}</p></section>'
    html = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{''.join(boiler)}<article>{article}</article>{comments}<footer>&copy; {words(6)}</footer>"
    return html, "\n\n".join(blocks)


@pytest.mark.parametrize("seed", range(40))
def test_article_pages(seed):
    html, want = page(seed)
    assert html_text.main_text(html) == want


def test_pages_without_article_elements():
    body = "<div id=top><a>a</a><a>b</a></div><div class=wrap><p>" + "long text here " * 30 + "</p><p>Short.</p><p>" + "more text " * 30 + "</p></div><div><a href=#>x</a> <a>y</a></div>"
    got = html_text.main_text(f"<body>{body}</body>").split("\n\n")
    assert [g[:9] for g in got] == ["long text", "Short.", "more text"]
    assert html_text.main_text("just &lt;words&gt;  and\nmore") == "just <words> and more"


def test_teaser_articles_do_not_replace_the_body():
    body = "".join(f"<p>{'long body text ' * n}</p>" for n in (30, 4, 40, 25))
    teasers = "".join(f"<article><h3><a href=/{i}>Teaser {i}</a></h3><p>Read <a href=/{i}>more</a></p></article>" for i in range(4))
    got = html_text.main_text(f"<body><div class=text>{body}</div><div class=cards>{teasers}</div></body>")
    assert got.count("long body text") == 99 and "Teaser" not in got


def test_heading_and_lead_in_main_outside_the_article_stay():
    lead, text = "lead words here " * 20, "article words " * 40
    html = f"<body><main><h1>Title</h1><p>{lead}</p><article><p>{text}</p></article><div><a href=/a>x</a> <a href=/b>y</a></div></main></body>"
    assert html_text.main_text(html).split("\n\n") == ["Title", lead.strip(), text.strip()]
    html = f"<body><main><h1>Title</h1><article><p>{text}</p><p>{text}</p></article></main></body>"
    assert html_text.main_text(html).split("\n\n") == ["Title", text.strip(), text.strip()]


@pytest.mark.parametrize("wrap", ["<div class='site has-sidebar'>", "<div id='content-with-comments'>", "<div class=noSidebar>", "<div class='widget'>", "<section id=related-main>"])
@pytest.mark.parametrize("article", ["<article>", "<article class='post has-comments'>"])
def test_names_of_wrappers_do_not_empty_the_page(wrap, article):
    text = "article words " * 40
    close = wrap[1:].split()[0]
    html = f"<body>{wrap}<div class=sidebar><p>{'aside ' * 9}</p></div>{article}<p>{text}</p><p>Short.</p></article><div class=comments><p>{'me too ' * 30}</p></div></{close}></body>"
    assert html_text.main_text(html) == f"{text.strip()}\n\nShort."


def test_a_name_with_an_article_only_lowers_ratios():
    text, more = "article words " * 30, "other words " * 30
    html = f"<body><div class=widget><article><p>{text}</p></article></div><div class=more><p>{more}</p><p>{more}</p></div><div class=ad><p>{'buy ' * 20}</p></div></body>"
    assert html_text.main_text(html).split("\n\n") == [text.strip(), more.strip(), more.strip()]


def test_smoothing_is_a_weighted_mean():
    got = html_text.smoothed([0.0, 0.0, 10.0, 0.0, 0.0])
    assert got[2] == max(got) and got[1] == got[3] and all(0 < x < 10 for x in got)
    assert html_text.smoothed([4.0] * 6) == pytest.approx([4.0] * 6)


def test_odd_pages(frame):
    rows = [(1, "u", None, "t", 9), (2, None, "", None, None), (None, "u", "<p>x", "t", 1), (3, "u", "<p>same</p>", "", 0), (3, "u", "<p>same</p>", "", 0),
            (4, "u", "<div>" * 5000 + "deep &amp " + "<b" , "", 0), (5, "u", "<script>never closed", "", 0), (6, "u", "<p>" + "w " * 200_000, "", 0)]
    got = html_text.extract(frame(PAGES, rows)).collect()
    texts = sorted((str(r["page_id"]), r["text"][:10], r["n_chars"]) for r in got)
    assert texts == sorted([("1", "", 0), ("2", "", 0), ("None", "x", 1), ("3", "same", 4), ("3", "same", 4), ("4", "deep &", 6), ("5", "", 0), ("6", "w w w w w ", 399_999)])
    assert html_text.extract(frame(PAGES, [])).collect() == []


def test_given_pages_keep_their_articles(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        import html as H

        pieces = [" ".join(H.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n\n".join(p for p in pieces if p)


LONG = "plain article words that go on and on. " * 12


def article(inner: str) -> list[str]:
    return html_text.main_text(f"<body><article><p>{LONG}</p>{inner}<p>{LONG}</p></article></body>").split("\n\n")[1:-1]


def test_headings_keep_their_text_whatever_their_class():
    assert article("<h1 class='post-header'>Title</h1><h2 class=section-header id=comments>Part</h2>") == ["Title", "Part"]


def test_inline_elements_neither_lose_nor_split_words():
    assert article("<p>Their <span class='market share'>forty percent</span> <b class=ad>grew</b>.</p>") == ["Their forty percent grew."]


def test_parts_of_an_article_stay_unless_they_are_links_or_comments():
    assert article("<div class='related-work'><p>Earlier papers said so.</p></div>") == ["Earlier papers said so."]
    assert article("<div class='related-work'><a href=/1>One thing</a> <a href=/2>Another thing</a></div>") == []
    assert article("<div class='related-posts'><p>Read on</p></div><div class=share>Share this</div><div class='ad box'>Buy it now</div>") == []
    assert article("<div class='user-comments'><p>I was there too, and it rained.</p></div>") == []


def test_discussions_outside_the_article_are_comments():
    comments = "<p>I do not agree with any of this at all, and here is why.</p>" * 9
    html = f"<body><article><p>{LONG}</p><section class=discussion><p>We discuss our findings.</p></section></article><section class=discussion>{comments}</section></body>"
    assert html_text.main_text(html).split("\n\n") == [LONG.strip(), "We discuss our findings."]


def test_short_sentences_in_divisions_of_their_own():
    html = f"<body><div><a href=/>Home</a> <a href=/x>Next</a></div><div><p>It began so.</p></div><div><p>{LONG}</p></div><div><p>That was all.</p></div><div><p>© 2024 Someone. All rights reserved.</p></div></body>"
    assert html_text.main_text(html).split("\n\n") == ["It began so.", LONG.strip(), "That was all."]


def plain_text(html: str) -> str:
    """The choice of blocks, straight from its description."""
    import math

    parser = html_text.Blocks()
    parser.feed(html)
    parser.close()
    blocks = parser.blocks

    def names(b):
        out, n = [], b.name
        while n:
            out.append(n)
            n = parser.around[n]
        return out

    text = lambda n: sum(len(b.text) for b in blocks if b.cluster is not None and (n == 0 or n in names(b)))
    linked = lambda n: sum(b.linked for b in blocks if b.cluster is not None and n in names(b))

    def holds(n):
        return n in parser.holding or any(o == n and holds(i) for i, o in parser.around.items())

    most = lambda n: 2 * text(n) > text(0)
    idle = lambda n: most(n) and holds(n) or n in parser.soft and 2 * linked(n) < text(n)
    lowered = lambda b: any(not idle(n) for n in names(b))
    able = lambda b: b.cluster is not None and all(idle(n) or (holds(n) if parser.parted else most(n)) for n in names(b))
    own = [len(b.text) / (1 + b.tags) for b in blocks]
    gauss = lambda d: math.exp(-d * d / 2) if abs(d) <= 3 else 0.0
    smooth = [sum(gauss(i - j) * own[j] for j in range(len(own))) / sum(gauss(i - j) for j in range(len(own))) for i in range(len(own))]
    cluster = [((b.cluster[0], b.cluster[2] if b.cluster[0] == 1 and b.cluster[1] in parser.split else b.cluster[1]) if able(b) else None) for b in blocks]
    best = {}
    for i, b in enumerate(blocks):
        if cluster[i] is not None:
            weight = 0.5 if lowered(b) else 1.5 if b.cluster[0] else 1.0
            best.setdefault(cluster[i], []).append(min(own[i], smooth[i]) * weight)
    if not best:
        return ""
    mean = sum(smooth) / len(smooth)
    threshold = (sum((x - mean) ** 2 for x in smooth) / len(smooth)) ** 0.5
    score = {c: max(v) for c, v in best.items()}
    chosen = {c for c, v in score.items() if v >= threshold}
    if not chosen:
        top = max(score.values())
        level = max(c[0] for c in score if score[c] == top)
        chosen = {min((c for c in score if score[c] == top and c[0] == level), key=lambda c: c[1])}
    kept = {i for i in range(len(blocks)) if cluster[i] in chosen}
    if not parser.parted:
        for step, order in ((1, range(len(blocks))), (-1, range(len(blocks) - 1, -1, -1))):
            for i in order:
                if i - step in kept and html_text._reads_on(blocks[i]):
                    kept.add(i)
    if kept:
        kept |= {i for i, b in enumerate(blocks) if i < max(kept) and b.heading and cluster[i] is not None and cluster[i][0] == 1}
    return "\n\n".join(blocks[i].text for i in sorted(kept))


@pytest.mark.parametrize("seed", range(60))
def test_choice_equals_its_description(seed):
    r = random.Random(seed)
    tags = "div div section article main p p h2 ul li span a nav aside b table td".split()
    classes = ["", "", "", " class=sidebar", " class='related-work'", " class='has-menu'", " id=comments", " class=discussion", " class='ad box'"]

    def made(depth: int) -> str:
        if depth == 0 or r.random() < 0.3:
            return " ".join(r.choice(["word", "longer-word", "end.", "Yes!"]) for _ in range(r.choice([1, 4, 30, 90])))
        tag = r.choice(tags)
        inner = "".join(made(depth - 1) for _ in range(r.randint(1, 3)))
        return f"<{tag}{r.choice(classes)}>{inner}" + ("" if r.random() < 0.1 else f"</{tag}>")

    html = "<body>" + "".join(made(5) for _ in range(6))
    assert html_text.main_text(html) == plain_text(html)


@pytest.mark.parametrize("piece", ["<div>x</p>", "<div class=sidebar>x y.</p></span>", "<main><article>x", "<section id=comments><a href=/>x</a></h2>"])
def test_deep_pages_take_linear_time(piece):
    import time

    html_text.main_text(piece * 2000)
    spent = []
    for n in (10_000, 40_000):
        start = time.perf_counter()
        html_text.main_text("<body>" + piece * n)
        spent.append(time.perf_counter() - start)
    assert spent[1] < 12 * spent[0] + 0.5
