"""Pages by another hand than the generator that the chain is trained on: what of an article is kept, and what around it is left."""

import pytest

from brindle.llm import html_extract

P1 = "The council met on Tuesday to discuss the new bridge over the river, which has been planned for ten years."
P2 = "Engineers said that the work would begin in spring, if the money is granted by the ministry in time."
P3 = "Residents were invited to send their remarks until the end of the month, and many of them did."

#: Name, page, and the texts of its main blocks.
PAGES = [
    ("news", f"<html><body><header class='site-header'><a href='/'>The Courier</a><nav><ul><li><a href='/w'>World</a></li><li><a href='/s'>Sport</a></li></ul></nav></header><main><article><h1>A new bridge</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></article></main><footer><p>© 2024 The Courier. All rights reserved.</p></footer></body></html>", ["A new bridge", P1, P2, P3]),
    ("terms at the end", f"<nav><a href=/>Home</a></nav><article><h1>Words of bridges</h1><p>{P1}</p><dl><dt>pier</dt><dd>a support between two spans</dd><dt>deck</dt><dd>what the road lies on</dd></dl></article><footer>© X</footer>", ["Words of bridges", P1, "pier", "a support between two spans", "deck", "what the road lies on"]),
    ("note inside", f"<article><h1>Growth</h1><p>{P1}</p><div class='note'><p>Sponsored content grew by 4%.</p></div><p>{P2}</p></article><div class='related'><h3>More</h3><ul><li><a href=/a>Another story</a></li></ul></div>", ["Growth", P1, "Sponsored content grew by 4%.", P2]),
    ("captions", f"<main id='content'><h1>Pictures</h1><p>{P1}</p><img src=a><p class='caption'>The bridge seen from the north.</p><figure><img src=b><figcaption>Its model in the town hall.</figcaption></figure><p>{P2}</p></main><aside class='sidebar'><h3>Latest</h3><p>Read our letter every week.</p></aside>", ["Pictures", P1, "The bridge seen from the north.", "Its model in the town hall.", P2]),
    ("blog with comments", f"<div class='topbar'><a href='/'>my blog</a></div><div class='post'><h1>On bridges</h1><p>{P1}</p><blockquote>{P2}</blockquote><p>{P3}</p></div><div class='comments'><h2>2 comments</h2><div class='comment'><p>I like this bridge, it was about time.</p></div><div class='comment'><p>It costs too much, as ever.</p></div></div>", ["On bridges", P1, P2, P3]),
    ("cookie notice first", f"<div class='cookie-consent'><p>We use cookies to make this site better for you.</p><button>Accept</button></div><article><h1>Title here</h1><p>{P1}</p><p>{P2}</p></article><footer><ul><li><a href=/i>Imprint</a></li></ul></footer>", ["Title here", P1, P2]),
    ("table of values", f"<article><h2>Figures</h2><p>{P1}</p><table><tr><th>Year</th><th>Cost in millions</th></tr><tr><td>2021</td><td>14.2</td></tr></table><p>{P3}</p></article><nav class='pager'><a href=/1>Previous</a> <a href=/2>Next</a></nav>", ["Figures", P1, "Year", "Cost in millions", "2021", "14.2", P3]),
    ("steps", f"<body><nav class=menu><ul><li><a href=/>Start</a></li></ul></nav><section><h1>How to cross</h1><p>{P1}</p><ol><li>Look to the left.</li><li>Walk on the right side.</li></ol><h3>Further</h3><p>{P2}</p></section><form class='search'><label>Search</label><input name=q><button>Go</button></form></body>", ["How to cross", P1, "Look to the left.", "Walk on the right side.", "Further", P2]),
    ("advert in the middle", f"<article><h1>Middle</h1><p>{P1}</p><div class='ad'><p>Buy two umbrellas and pay for one!</p></div><p>{P2}</p><aside class='promo'><p>Subscribe for a year today.</p></aside><p>{P3}</p></article>", ["Middle", P1, P2, P3]),
    ("code", f"<article><h1>Reading data</h1><p>{P1}</p><pre><code>df = read(path)\ndf.show()</code></pre><p>{P2}</p></article><footer>© me</footer>", ["Reading data", P1, "df = read(path) df.show()", P2]),
    ("details", f"<main><h1>Answers</h1><details><summary>When does it open?</summary><p>{P2}</p></details><details><summary>Who pays?</summary><p>{P3}</p></details></main><footer>© town</footer>", ["Answers", "When does it open?", P2, "Who pays?", P3]),
    ("abstract", f"<header><h1>Journal of Bridges</h1></header><article><h1>On loads</h1><div class='abstract'><p>{P1}</p></div><section><h2>1 Loads</h2><p>{P2}</p></section></article><footer><p>Contact the editors</p></footer>", ["On loads", P1, "1 Loads", P2]),
]


@pytest.fixture(scope="module")
def chain():
    return html_extract.default_chain()


def test_layouts_of_another_hand(chain):
    wrong = {name: html_extract.extract(page, chain).split("\n") for name, page, gold in PAGES if html_extract.extract(page, chain) != "\n".join(gold)}
    assert not {"terms at the end", "note inside", "captions"} & wrong.keys()
    assert len(wrong) <= 1, wrong


def test_no_article_text_is_lost(chain):
    lost = {name: [x for x in gold if x not in html_extract.extract(page, chain).split("\n")] for name, page, gold in PAGES}
    assert sum(map(len, lost.values())) <= 1, lost


def test_pages_of_a_fresh_seed(chain):
    exact = 0
    pages = html_extract.labelled_pages(200, 77)
    for page, gold in pages:
        blocks, y = html_extract.label_blocks(page, gold)
        exact += html_extract.extract(page, chain) == "\n".join(b[1] for b, k in zip(blocks, y) if k)
    assert exact >= 185


def test_empty_table(spark, chain):
    df = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars long")
    found = html_extract.extract_pages(df, chain)
    assert found.collect() == [] and found.columns == ["page_id", "url", "text", "n_chars"]


def test_odd_pages(spark, chain):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "plain words without a tag " * 20), (3, "u", "plain words without a tag " * 20), (4, "u", "<article><p>" + "A long text goes on. " * 20_000 + "</p></article>")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text"), chain).collect()
    assert [r["text"] for r in got[:3]] == [""] * 3 and [r["n_chars"] for r in got] == [len(r["text"]) for r in got]
    assert got[3] == got[4] and got[5]["n_chars"] == len("A long text goes on. " * 20_000) - 1
