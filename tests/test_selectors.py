"""Selectors on a page whose elements carry a name each."""

import pytest
from pyspark.sql import functions as F

from webkiln.html.shred import shred
from webkiln.operators import selectors

PAGE = """<body data-n=body><div data-n=d1 class="card big" id=top><p data-n=p1>one <b data-n=b1>bold</b></p><!-- c --> text
<p data-n=p2 class="lead x-1" lang="en-US" title="A b">two</p><span data-n=s1></span><p data-n=p3></p></div>
<div data-n=d2 class="card"><ul data-n=u1><li data-n=l1>a<li data-n=l2 class=on>b<ul data-n=u2><li data-n=l3>c</ul><li data-n=l4 class="on off">d</ul>
<a data-n=a1 href="/tag/x">t</a><a data-n=a2 href="http://e.org/y.PDF" rel="nofollow tag">u</a></div><footer data-n=f1 class="a:b"><!-- only --></footer>
<script data-n=j1 class=card>var on</script></body>"""

FOUND = {
    "p": "p1 p2 p3",
    "P": "p1 p2 p3",
    "div.card": "d1 d2",
    ".card": "d1 d2 j1",
    "#top": "d1",
    ".card.big": "d1",
    r".a\:b": "f1",
    "li, footer": "l1 l2 l3 l4 f1",
    "[lang]": "p2",
    "[class='card']": "d2 j1",
    "[class=card]": "d2 j1",
    "[rel~=tag]": "a2",
    "[lang|=en]": "p2",
    "[href^='/tag']": "a1",
    '[href$=".pdf"]': "",
    '[href$=".pdf" i]': "a2",
    "[href*=e.org]": "a2",
    "[href*='']": "",
    "li[class!=on]": "l1 l3 l4",
    "[title='A b']": "p2",
    "div p": "p1 p2 p3",
    "div > p": "p1 p2 p3",
    "div b": "b1",
    "div > b": "",
    ".card > p > b": "b1",
    "ul li": "l1 l2 l3 l4",
    "ul ul li": "l3",
    "ul > li > ul > li": "l3",
    "li.on > ul": "u2",
    "p + p": "p2",
    "p ~ p": "p2 p3",
    "p + span": "s1",
    "span + p": "p3",
    "span ~ *": "p3",
    "*:not(p) + p": "p3",
    ":not(p) ~ p": "p3",
    ".on + li": "l4",
    "p:not(.lead)": "p1 p3",
    "div > :not(p, ul)": "s1 a1 a2",
    "li:not(ul ul li)": "l1 l2 l4",
    "p:has(b)": "p1",
    "div:has(> p)": "d1",
    "div:has(> b)": "",
    "div:has(b), div:has(li.off)": "d1 d2",
    "p:has(+ span)": "p2",
    "p:has(~ span)": "p1 p2",
    "div:has(ul > li.on)": "d2",
    "div:has(> ul > li > ul)": "d2",
    "div:not(:has(p))": "d2",
    "li:first-child": "l1 l3",
    "li:last-child": "l3 l4",
    "li:only-child": "l3",
    "p:last-of-type": "p3",
    "p:nth-child(2)": "p2",
    "p:nth-child(odd)": "p1",
    "p:nth-of-type(odd)": "p1 p3",
    "p:nth-child(n + 2)": "p2 p3",
    "li:nth-last-child(-n+2)": "l2 l3 l4",
    "p:empty, footer:empty, span:empty": "s1 p3 f1",
    "a:only-of-type": "",
    ":is(p, a):is(.lead, [href^='/'])": "p2 a1",
    "body > div:nth-of-type(2) > a:last-child": "a2",
    "table td": "",
}


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(1, PAGE), (2, ""), (3, None), (4, "<p data-n=other>x<p data-n=second>y")]
    return shred(spark.createDataFrame(rows, "page_id long, html string")).cache()


def test_selectors(nodes):
    names = {f"m{i}": s for i, s in enumerate(FOUND)}
    matched = selectors.match(nodes, names)
    assert matched.columns == [*nodes.columns, *names]
    rows = matched.orderBy("page_id", "pre").collect()
    assert len(rows) == nodes.count()
    found = {s: " ".join(r["attrs"]["data-n"] for r in rows if r["page_id"] == 1 and r[m]) for m, s in names.items()}
    assert found == FOUND
    assert [r["attrs"]["data-n"] for r in rows if r["page_id"] == 4 and r["m0"]] == ["other", "second"]


def test_first_match(nodes):
    first = selectors.first_match(nodes, "li.on, p.lead, p").orderBy("page_id").collect()
    assert [(r["page_id"], r["tag"]) for r in first] == [(1, "p"), (4, "p")]
    assert selectors.first_match(nodes, ":root").count() == 4


def test_any_number_of_selectors_shares_one_shuffle(nodes):
    many = {f"m{i}": s for i, s in enumerate(FOUND)}
    plan = selectors.match(nodes, many)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("bad", ["", "p >", "> p", "p,,b", "p:hover", "p:nth-child(x)", "[a", "p:not(b", "div p..x", "p#", "a[href='x]"])
def test_what_is_no_selector(nodes, bad):
    with pytest.raises(ValueError):
        selectors.match(nodes, {"m": bad})


def test_names_that_exist(nodes):
    with pytest.raises(ValueError):
        selectors.match(nodes.withColumn("m", F.lit(1)), {"m": "p"})
