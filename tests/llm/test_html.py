"""HTML extraction: the template rule against brute force, broken pages, names, time in proportion to the page."""

import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelwright.llm import html_extract as html


def text(source):
    return html.text_of(html.parse(source), set())


@pytest.mark.parametrize(
    "source, want",
    [
        ('<p>a <a href="x>two</a> b</p>', "a two b"),
        ('<p>t</p><a href="x">1</a><a href=\'y>2</a><i>3</i>', "t\n\n123"),
        ("<p title=it's>one</p><p>don't go</p>", "one\n\ndon't go"),
        ("<p title='a > b'>x</p>", "x"),
        ("<article><p>x <math><mi>a</mi></math></p></article>", "x a"),
        ('<div class="social-history">a</div><p class="related-work">b</p><p id="footer-effect">c</p>', "a\n\nb\n\nc"),
        ('<div class="site-footer">a</div><div class="mainNav">b</div><div class="ad">c</div><p id="cookie-notice">d</p>x', "x"),
        ('<p>before</p><svg class="i"/><p>after</p>', "before\n\nafter"),
        ("<p>before</p><svg><text>no</text></svg><p>after</p>", "before\n\nafter"),
        ("<p>before</p><svg><p>after</p>", "before\n\nafter"),
        ('<p style="overflow:hidden" title="the hidden cost">kept</p><p hidden>gone</p>', "kept"),
        ("<script>if (a<b) '</p>'</script>a < b &amp; c<!-- no --> d", "a < b & c d"),
        ("<p>x</p></p><br>y<textarea>no</textarea>z", "x\n\nyz"),
        ('<article><p>a</p><div id="reader-comments">b</div><div class="user-feedback">c</div><section class="discussion">d</section></article>', "a"),
        ('<article><ul class="topnav"><li>b</li></ul><div class="ad-300x250">c</div><div class="outbrain">d</div><div class="adSlot2">e</div>a</article>', "a"),
        ('<section id="discussion"><h2 id="feedback">a</h2></section><table class="thead"><tr><td>b</td></tr></table><div class="feedback-loop">c</div>', "a\n\nb\n\nc"),
    ],
)
def test_broken_and_named(source, want):
    assert text(source) == want


@pytest.mark.parametrize("piece", ['<a href="x>two</a> ', '<p title="a>b', "<svg>", "<svg></svg", "<b>", "<td><i>", "</i><b><p>", "<!-- ", "<", "<noscript>"])
def test_time_is_in_proportion(piece):
    began = time.process_time()
    html.parse(piece * 100_000)
    assert time.process_time() - began < 8  # some 1 s; the square of it would be minutes


def pages_with_templates():
    rows = []
    for host, n in (("a.org", 12), ("b.org", 4), ("c.org", 30)):
        for k in range(n):
            foot = f"<div><p>Imprint of {host}</p></div>" if k % 4 == 0 else f"<div><p>foot {host} {k}</p></div>"
            shared = "<p>All agree</p>" if k % 10 else ""
            rows.append((f"http://{host}/{k}", f"<html><body><div><i>Part {k % 3}</i></div><article><p>Own text {host} {k}</p><p>Quote {k % 4}</p>{shared}</article>{foot}</body></html>"))
    rows += [(rows[0][0], rows[0][1])] * 5  # equal pages count once
    rows += [(f"http://d.org/{k}", f"<body><p>Hello {k % 2}</p><p>own {k}</p></body>") for k in range(8)]
    return [(k, *r) for k, r in enumerate(rows)]


def brute_templates(rows, rules):
    pages, seen = defaultdict(set), defaultdict(lambda: [set(), False, False])
    for _, url, source in rows:
        host = url.split("/")[2]
        pages[host].add(source)
        root = html.parse(source)
        for x, inside in html.subtrees(root):
            entry = seen[host, x.digest]
            entry[0].add(source)
            entry[1] |= inside
            entry[2] |= not root.main
    out = set()
    for (host, digest), (where, inside, unmarked) in seen.items():
        least, share = (rules.inside_pages, rules.inside_share) if inside else (rules.unmarked_pages, rules.unmarked_share) if unmarked else (rules.outside_pages, rules.outside_share)
        if len(where) >= least and len(where) >= share * len(pages[host]):
            out.add((host, digest))
    return out


def test_template_rule(spark):
    rows = pages_with_templates()
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    rules = html.Rules()
    got = {(r.host, r.digest % (1 << 64)) for r in html.templates(table, rules).collect()}
    want = brute_templates(rows, rules)
    assert got == want and Counter(h for h, _ in want).keys() == {"a.org", "c.org"}
    texts = {r.page_id: r.text for r in html.extract(table, rules).collect()}
    assert texts[1] == "Own text a.org 1\n\nQuote 1\n\nfoot a.org 1"  # the part and what all agree on recur on the host
    assert texts[0] == "Own text a.org 0\n\nQuote 0"  # so does the imprint; quotes in articles stay
    assert texts[12] == "Part 0\n\nOwn text b.org 0\n\nQuote 0\n\nImprint of b.org"  # four pages, nothing on three of them
    salted = {r.page_id: r.text for r in html.extract(table, html.Rules(broadcast_rows=0), salts=3).collect()}
    assert salted == texts


def test_the_rule_fires_on_the_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    again = pages.unionByName(pages.select("page_id", "url", F.concat("html", F.lit("<!-- other -->")).alias("html"))).unionByName(pages.select("page_id", "url", F.concat("html", F.lit("<!-- third -->")).alias("html")))
    assert html.templates(again).count() > 0
