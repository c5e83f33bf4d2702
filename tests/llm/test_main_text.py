"""Main text: structure, odd and hostile pages, and what a host's pages share, against a plain count of windows."""

import html as entities
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stratalog.llm import main_text
from stratalog.session import ship


def article(page: str) -> str:
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return "\n\n".join(x for x in (" ".join(entities.unescape(re.sub("</?b>", "", y)).split()) for y in re.split(r"</?(?:p|h1|br)[^>]*>", inside)) if x)


def test_main_text(spark):
    ship(spark)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in main_text.main_text(pages).collect()}
    assert all(got[r.page_id] == article(r.html) for r in pages.collect())


def test_host_boilerplate(spark):
    """Without elements or names that say so, what a host's pages share goes, what two of many share stays."""
    ship(spark)
    own = lambda i: f"<p>Story {i} tells of {' '.join(f'thing{i * 7 + k}' for k in range(12))}.</p>"
    page = lambda i: f"<div>Welcome to our site, dear reader</div>{own(i)}{'<p>A passage that two of the stories quote word by word here.</p>' if i < 2 else ''}<div>All rights reserved by us</div>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(20)] + [(100, "http://other.example/", page(0)), (101, None, None), (102, "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in main_text.main_text(df).collect()}
    assert got[5].text == re.sub("</?p>", "", own(5)) and got[0].text.endswith("quote word by word here.") and "Welcome" not in got[0].text
    assert "Welcome" in got[100].text and got[101].text == "" and got[102].n_chars == 0


def plain(pages: list[list[str]], limits: main_text.Limits) -> list[list[str]]:
    """What stays of open blocks, by counting the pages of every window and of every short block in dictionaries; pages are distinct."""
    n, seen = limits.window, defaultdict(set)

    def keys(block):
        w = ["<", *block.split(), ">"]
        return [(i, tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if len(w) >= n else [(None, block)]

    for i, blocks in enumerate(pages):
        for b in blocks:
            for _, k in keys(b):
                seen[k].add(i)
    least = max(limits.pages, min(limits.many, limits.share * len(pages)))
    out = []
    for blocks in pages:
        kept = []
        for b in blocks:
            w, gone = b.split(), set()
            for at, k in keys(b):
                if len(seen[k]) >= least:
                    gone |= set(range(len(w))) if at is None else set(range(at - 1, at - 1 + n))
            kept.append(" ".join(x for i, x in enumerate(w) if i not in gone))
        out.append([x for x in kept if x])
    return out


@pytest.mark.parametrize("chunk_tokens", [1 << 20, 700])
def test_what_a_host_shares_goes_however_it_is_cut(spark, chunk_tokens):
    """Footers of all and of some pages, a long passage inside other text, near misses; copies of a page count once."""
    ship(spark)
    rng = random.Random(4)
    own = lambda i, n=30: " ".join(f"t{i}x{rng.randrange(10**6)}" for _ in range(n))
    notice = " ".join(f"notice{k}" for k in range(25))
    pages = []
    for i in range(120):
        part = [own(i), "A template line of every page"]
        part += ["The notice of one section only"] if i % 8 == 0 else []
        part += [f"{own(i, 6)} {notice} {own(i, 5)}"] if i % 5 == 0 else []  # a run within a block
        part += [notice[: rng.randrange(60, 200)].strip()] if i % 7 == 0 else []
        part += ["A line of eleven pages"] if i < 11 else []
        part += ["A line of twelve pages"] if i < 12 else []
        pages.append(part)
    body = lambda p: "".join(f"<div>{x}</div>" for x in p)
    rows = [(i, "http://h.example/x", body(p)) for i, p in enumerate(pages)]
    rows += [(1000 + k, "http://h.example/copy", body(pages[3])) for k in range(300)]  # copies of one page
    rows += [(2000 + i, f"http://h{i}.example/", body(pages[i])) for i in range(30)]  # alone on their hosts
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "page", "key", "tokens")})
    limits = main_text.Limits(chunk_tokens=chunk_tokens)
    got = {r.page_id: r.text.split("\n\n") for r in main_text.main_text(df, limits).collect()}
    want = plain(pages, limits)
    assert [got[i] for i in range(120)] == want
    assert all(got[1000 + k] == want[3] for k in range(300)) and all(got[2000 + i] == pages[i] for i in range(30))
    mixed = got[5][1]
    assert "notice12" not in mixed and mixed.startswith("t5x") and "A line of eleven pages" in got[1] and "A line of twelve pages" not in got[1]
    alone = {r.page_id: r.text.split("\n\n") for r in main_text.main_text(df, limits, repeats=False).collect()}
    assert [alone[i] for i in range(120)] == pages  # the array decides all of it


def test_half_of_the_pages_of_a_large_host(spark):
    """The same sentence on every second page of a host of 1,000 goes from each, whatever the chunks."""
    ship(spark)
    page = lambda i: f"<p>{' '.join(f'w{i}x{k}' for k in range(8))}</p>" + ("<p>This sentence stands on every second page of the host</p>" if i % 2 else "")
    df = spark.createDataFrame([(i, "http://one.example/", page(i)) for i in range(1000)], "page_id long, url string, html string")
    for chunk_tokens in (1 << 20, 300):
        assert main_text.main_text(df, main_text.Limits(chunk_tokens=chunk_tokens)).where("text like '%every second page%'").count() == 0


def test_article_template_of_large_pages(spark):
    """The verdict on a template inside articles doesn't depend on the pages' size."""
    ship(spark)
    page = lambda i: f"<article><p>Template of all</p><p>{' '.join(f'o{i}x{k}' for k in range(20))}</p></article><script>{'x' * 1_500_000}</script>"
    df = spark.range(20, numPartitions=5).selectExpr("id AS page_id", "'http://big.example/' AS url").collect()
    df = spark.createDataFrame([(r.page_id, r.url, page(r.page_id)) for r in df], "page_id long, url string, html string")
    assert not [r.page_id for r in main_text.main_text(df).collect() if "Template" in r.text or not r.text]


PAGES = {
    '<div class="menu"><a href=x>Home</a></div><div id="content"><h2>Title</h2><p>One  two&nbsp;three<br>four</p><p class="ad">Buy<p>Five &lt;six&gt;</div><div class="comments"><p>nice</div>': ["Title", "One two three four", "Five <six>"],
    "<body><nav><ul><li>a<li>b<article><h1>T</h1><p>text one</article>": ["T", "text one"],
    '<body class="has-sidebar"><main><h1>T</h1><article><p>body text</p><aside>x</aside></article></main><div class="sidebar"><article>teaser</article></div>': ["T", "body text"],
    "<article><p>5 < 6 & 7 &gt; 3</p><!-- c --><script>if(a<b){'</p>'}</script><noscript>js</noscript><p>last": ["5 < 6 & 7 > 3", "last"],
    "<main><article><h1>T</h1><p>main</p></article><div class='comment-list'><article><p>no</p></article></div></main>": ["T", "main"],
    "<p>Hello <b>wor</b>ld</p>plain<form><input><label>Mail</label></form>tail": ["Hello world", "plain", "tail"],
}


@pytest.mark.parametrize("page", PAGES)
def test_page_structure(page):
    assert [t for t, _ in main_text.page_blocks(page)] == PAGES[page]


def test_names_with_other_words_lose_nothing_inside_articles():
    names = ["share-price", "related-work", "alert-level", "search-results", "social-democrats", "form-of-government", "commenttary", "banner-ad-history"]
    page = "<article><h1>T</h1>" + "".join(f'<div class="{n}"><p>About {n} at length</p></div><p id="{n}">More of it</p>' for n in names) + "</article>"
    assert len(main_text.page_blocks(page)) == 1 + 2 * len(names)
    gone = ["ad", "ad-728x90", "comments", "comment-list", "related-posts", "share-buttons", "newsletter", "cookie-notice", "sidebar_left", "navBar", "socialShare", "userComments"]
    page = "<article><h1>T</h1>" + "".join(f'<div class="x {n}"><p>About {n} at length</p></div>' for n in gone) + "</article>"
    assert [t for t, _ in main_text.page_blocks(page)] == ["T"]


def test_suspect_blocks_go_if_links_or_shared(spark):
    ship(spark)
    box = '<div class="share-price">Ours stood at {} today</div>'
    page = lambda i, x: f"<article><p>Story number {i} in its own words</p>{box.format(x)}</article>"
    rows = [(i, "http://a.example/", page(i, i)) for i in range(3)] + [(10 + i, "http://b.example/", page(i, 7)) for i in range(2)]
    got = {r.page_id: r.text for r in main_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Ours stood" in got[i] for i in range(3)) and not any("Ours stood" in got[10 + i] for i in range(2))
    assert [t for t, _ in main_text.page_blocks('<article><p>text</p><ul class="share-price"><li><a href=x>a link</a></ul></article>')] == ["text"]
    linked = main_text.page_blocks("<p>Some text of the page</p><p><a href=x>One whole sentence is a link here</a></p><div><a>Home</a> <a>About</a></div>")
    assert linked == [("Some text of the page", main_text.OPEN), ("One whole sentence is a link here", main_text.SUSPECT)]


HOSTILE = {
    "nested": "<div>" * 200_000 + "x", "closed": "<div>" * 90_000 + "y" + "</div>" * 90_000, "no end": "<a " * 330_000, "menus": "<nav>" * 200_000, "menus of text": "<nav><p>x</p>" * 80_000, "comments": "<!--" * 250_000,
    "unmatched": "<div><span></p>" * 65_000, "quotes": '<a "' * 250_000 + ">", "articles": "<div>" * 60_000 + "<nav><article>" * 50_000, "links": "<a><div><b>" * 60_000 + "</table>" * 40_000, "items": "<li>" * 250_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    began = time.process_time()
    main_text.page_blocks(HOSTILE[name])
    assert time.process_time() - began < 10  # about 1 MB; quadratic scans took minutes


def test_unclosed_parts():
    assert [t for t, _ in main_text.page_blocks("<p>one<!-- open <p>two</p>")] == ["one"]
    assert [t for t, _ in main_text.page_blocks("<p>one</p>1 < 2 <b")] == ["one", "1 < 2 <b"]
    assert [t for t, _ in main_text.page_blocks("<p>one</p>two</p")] == ["one", "two"]


def test_an_article_keeps_formulas_links_and_names():
    """What may be part of an article isn't dropped by a page's structure alone."""
    texts = lambda html: [t for t, _ in main_text.page_blocks(html)]
    inside = lambda x: texts(f"<article><p>Long enough text of an article.</p>{x}</article>")[1:]
    assert texts("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>3</mn><annotation>x=3</annotation></math> hold.</p></article>") == ["Let x=3 hold."]
    for x, text in (
        ('<section id="copyright"><p>Copyright law began in 1709', "Copyright law began in 1709"), ('<blockquote class="reply">He said so', "He said so"), ('<ul class="menu"><li>Soup', "Soup"), ('<section class="banner">A flag', "A flag"),
    ):
        assert inside(x) == [text]
    for x in ('<div class="comments">Nice!', '<div class="share">Share this', '<div class="ad-box">Buy', "<nav>Home", '<p hidden>x'):
        assert inside(x) == []
    body = "<p>See <a>the long report of the commission on water</a> and <a>the reply by the board of the town</a></p><p><a>Read</a> <a>these notes</a></p><div><a>Home</a> | <a>About</a></div><div><a>All is well.</a> <a>So it is.</a></div>"
    assert texts(f"<body>{body}</body>") == ["See the long report of the commission on water and the reply by the board of the town", "Read these notes", "All is well. So it is."]


def test_links_in_paragraphs_that_a_host_repeats_go(spark):
    ship(spark)
    page = lambda i: f"<p>Story {i} is about number{i} and what it did on day{i}</p><p><a>Home of all</a> <a>About us here</a></p>"
    df = spark.createDataFrame([(i, "http://h.example/", page(i)) for i in range(4)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in main_text.main_text(df).collect()} == {i: f"Story {i} is about number{i} and what it did on day{i}" for i in range(4)}


def test_no_article_goes_for_the_greater_part(spark):
    """Blocks that a host's articles share go, unless they are most of a page: then all of its article stays."""
    ship(spark)
    line = "The same line of the article that every page of the host has"
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    sizes = {i: 40 if i % 2 else 3 for i in range(40)}
    df = spark.createDataFrame([(i, "http://h.example/", f"<article><p>{line}</p><p>{own(i, n)}</p></article>") for i, n in sizes.items()], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text.main_text(df).collect()}
    assert all(got[i] == (own(i, n) if n == 40 else f"{line}\n\n{own(i, n)}") for i, n in sizes.items())
