"""Main text of pages: contract cases, broken markup, and the given pages against their article elements."""

import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import html_extract as H
from quarry.llm.queries import QUERIES

WORDS = "the quick brown fox jumps over a lazy dog while many bright stars shine above quiet hills".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def chrome(rng):
    """Parts that are no article, and what they hold."""
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(WORDS, 6))
    return {
        "header": f"<header><h1>The site</h1><p>{prose(rng, 12)}</p></header>",
        "nav": f"<nav><ul>{links}</ul></nav>",
        "menu": f'<div class="main-menu"><ul>{links}</ul></div>',
        "aside": f"<aside><h3>More</h3><p>{prose(rng, 60)}</p></aside>",
        "sidebar": f'<div id="rightSidebar"><p>{prose(rng, 80)}</p></div>',
        "notice": f'<div class="cookie-notice"><p>{prose(rng, 50)}</p><button>OK</button></div>',
        "ad": f'<div class="ad">{prose(rng, 70)}</div>',
        "form": f"<form><p>{prose(rng, 30)}</p><input name=q><label>Mail</label><textarea>text</textarea></form>",
        "script": "<script>if (a < b && c > d) { document.write('<p>' + x + '</p>'); }</script>",
        "style": "<style>p > a { color: red }</style>",
        "comments": f'<section class="comments"><h2>Comments</h2><article class="comment"><p>{prose(rng, 90)}</p></article></section>',
        "footer": f"<footer><p>&copy; {prose(rng, 40)}</p></footer>",
    }


def test_article_among_everything_else():
    rng = random.Random(1)
    for _ in range(40):
        blocks = [prose(rng, 5)] + [prose(rng, rng.choice([1, 2, 8, 60, 200])) for _ in range(rng.randint(1, 8))]
        body = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
        around = list(chrome(rng).values())
        rng.shuffle(around)
        inside = list(chrome(rng).values())[3:8]
        at = rng.randint(0, len(around))
        for page in (
            "".join(around[:at]) + f"<article>{body}</article>" + "".join(around[at:]),
            "".join(around[:at]) + f"<main><div>{body}</div>{inside[0]}</main>" + "".join(around[at:]),
            "".join(around[:at]) + f"<article>{inside[1]}{body}{inside[2]}</article>" + "".join(around[at:]),
        ):
            assert H.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}</body></html>") == "\n".join(blocks)


def test_region_without_article_element():
    rng = random.Random(2)
    blocks = ["A heading", prose(rng, 80), "Short.", prose(rng, 120), "End."]
    body = "".join(f"<p>{b}</p>" for b in blocks[1:])
    links = "".join(f'<a href="/{w}">{w}</a> ' for w in WORDS)
    page = f"<body><div class=q>{links}</div><div class=x><h2>{blocks[0]}</h2>{body}</div><div><p>Tiny</p><p>parts</p></div></body>"
    assert H.main_text(page) == "\n".join(blocks)
    flat = f"<body><p>{links}</p><h2>{blocks[0]}</h2>{body}<p>{links}</p></body>"
    assert H.main_text(flat) == "\n".join(blocks)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), (" \n ", ""), ("just text", "just text"), ("<nav>only</nav>", ""),
        ("<article><p>a &lt;b&gt; &amp;amp; &eacute;&#233;&#xE9; &nbsp; c</p></article>", "a <b> &amp; ééé c"),
        ("<article><p>one\n\t two<br>three<br/>four</p></article>", "one two three four"),
        ("<article><p>a<b>b</b><i>c</i> d</p><p> </p><p>e</p></article>", "abc d\ne"),
        ("<article><p><b>Title.<br><p>First.</p><p>Second", "Title.\nFirst.\nSecond"),
        ("<article><p>a<script>x < y</script>b<!-- no --> c</p></article>", "ab c"),
        ('<article><p>Keep <span class="ad">Buy now</span>this</p></article>', "Keep this"),
        ("<article><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>", "x\ny\n1\n2"),
        ("<article>a</p></div></b>b</article></article>", "a\nb"),
        ('<div class="main-content sidebar-right"><p>text</p></div>', "text"),
        ("<article class='post has-sidebar'><p>text</p></article>", "text"),
        ("x < y and z<3", "x < y and z<3"), ("a<!-- never closed <p>b</p>", "a"), ("a <![weird[ b ]]> c", "a c"),
        ("<article><p>cut off</p><p>here <a href='x", "cut off\nhere"),
    ],
)
def test_markup(page, text):
    assert H.main_text(page) == text


def test_smoothing_and_threshold():
    flat = H.smoothed(np.full(9, 4.0))
    assert np.allclose(flat, 4.0)
    peak = H.smoothed(np.eye(1, 15, 7)[0])
    weights = np.exp(-0.5 * np.arange(-3, 4.0) ** 2)
    assert np.allclose(peak[4:11], weights / weights.sum()) and not peak[:4].any() and not peak[11:].any()
    lines = [H.Line("x" * n, 2, 0, 0, False) for n in (4, 4, 4, 4, 400, 900, 400, 4, 4, 4, 4)]
    assert list(np.flatnonzero(H.content_lines(lines))) == [4, 5, 6]


def test_broken_pages_take_time_in_proportion():
    for unit in ("<", "<!--", "</", "<a", "<a b ", "a<b ", "<?", '<a b="', "<i>", "<script>", "<div>", "<p>", "<li>", "&", "&#x;", "<![a[", "<nav>"):
        for end in ("", ">"):
            began = time.time()
            H.main_text(unit * 40_000 + end)
            assert time.time() - began < 5, unit
    long = " ".join(["word"] * 500_000)
    assert H.main_text(f"<article><p>{long}</p></article>") == long


def test_rows(spark):
    rows = [(1, "u", "<article><p>A</p></article>"), (1, "u", "<article><p>A</p></article>"), (None, None, None), (2, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("text", "n_chars", "lines"):
        pages = pages.withColumn(c, F.lit("x"))
    got = H.with_length(H.extract_text(pages))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "u", "A", 1)] * 2 + [(None, None, "", 0), (2, None, "", 0)], key=str)
    assert H.extract_text(pages.limit(0)).collect() == []


def test_query_over_the_given_pages(spark):
    """The given pages keep their text in one article element; its blocks are cut out here by patterns."""
    sf_dir = "/root/testdata/sf0.01"

    def expected(page):
        article = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        return "\n".join(b for b in blocks if b)

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op13_html_extraction"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        text = expected(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, text, len(text))
