"""Content patterns on hand-written pages: what they take and what they leave."""

import pytest

from webkiln.html.shred import shred
from webkiln.operators import content, patterns, removals, render

PROSE = "This is a sentence of plain prose with quite a few ordinary words in it. " * 12
LONG = "".join(f"<p>{PROSE}</p>" for _ in range(4))

#: (pattern, inner html of the article, words that go, words that stay)
CASES = [
    ("breadcrumb_list", f'<div><ul><li><a href="/">Home</a></li><li>TrailHere</li></ul></div>{LONG}', ["TrailHere"], ["prose"]),
    ("breadcrumb_list", f'<ul><li><a href="https://x.org/">Far</a></li><li>KeepTrail</li></ul>{LONG}', [], ["Far"]),
    ("promotional_banner", f'<a href="/sale"><div>BannerSale now</div></a><h1>T</h1>{LONG}', ["BannerSale"], ["prose"]),
    ("promotional_banner", f'<h1>T</h1><a href="/sale"><div>AfterTitle now</div></a>{LONG}', [], ["AfterTitle"]),
    ("hero_header", f"<div><div><h1>HeroTitle</h1><time>Mar 4</time></div></div>{LONG}", ["HeroTitle"], ["prose"]),
    ("hero_header", f"<div><h1>KeptTitle</h1><time>Mar 4</time><p>{PROSE}</p></div>{LONG}", [], ["KeptTitle"]),
    ("metadata_line", f"<div>May 12, 2024 BlockDate</div>{LONG}", ["BlockDate"], ["prose"]),
    ("metadata_line", f"<div><p>By Jane Byliner</p></div>{LONG}", ["Byliner"], ["prose"]),
    ("metadata_line", f"<p>Mar 4th | 3 min read</p>{LONG}", ["min read"], ["prose"]),
    ("metadata_line", f"<p>Ada Author, June 3</p>{LONG}", ["Ada"], ["prose"]),
    ("metadata_line", f"<p>In May 12 people came, she said.</p>{LONG}", [], ["people came"]),
    ("metadata_line", f"{LONG}<p>By Jane Late</p>", [], ["Jane Late"]),
    ("standalone_time", f"<p><em><time>AloneTime</time></em></p>{LONG}", ["AloneTime"], ["prose"]),
    ("standalone_time", f"{LONG}<p>Back in <time>MidTime</time> it was so.</p>{LONG}", [], ["MidTime"]),
    ("metadata_list", f"<ul><li>Ann Lee</li><li>ListDate</li></ul>{LONG}", ["ListDate"], ["prose"]),
    ("metadata_list", f"<p>We need:</p><ul><li>Eggs</li><li>KeptMilk</li></ul>{LONG}", [], ["KeptMilk"]),
    ("thin_ending", f"{LONG}<h2>Get ThinApp</h2><p>Try it now</p>", ["ThinApp"], ["prose"]),
    ("thin_ending", f"{LONG}<h2>KeptCode</h2><pre>x = 1</pre>", [], ["KeptCode"]),
    ("boilerplate", f"{LONG}<p>Originally published in The Paper</p><p>AfterBoiler</p>", ["Originally", "AfterBoiler"], ["prose"]),
    ("boilerplate", f"{LONG}<p>She originally published in KeptPaper</p>", [], ["KeptPaper"]),
    ("related_section", f"{LONG}<div><h3>Related posts</h3><p>RelatedOne</p></div><div>AfterRelated</div>", ["RelatedOne", "AfterRelated"], ["prose"]),
    ("related_section", f"<div><h3>Related posts</h3><p>EarlyRelated</p></div>{LONG}", [], ["EarlyRelated"]),
    ("newsletter", f"{LONG}<div><div>Subscribe to our weekly newsletter NewsNow</div></div><p>{PROSE}</p>", ["NewsNow"], ["prose"]),
    ("newsletter", f"<div>{LONG} people subscribe to a newsletter KeptNews</div><p>{PROSE}</p>", [], ["KeptNews"]),
    ("metadata_line", f"<div><span>Author</span><span>May 12</span></div><p>{PROSE}</p>", ["May 12"], ["prose"]),
    ("metadata_line", f"<div><p>On May 12 we went out to sea and stayed</p></div><p>{PROSE}</p>", [], ["May 12"]),
    ("thin_ending", f"<p>{'漢字' * 200}</p><div><h2>尾</h2><p>短文</p></div>", ["短文"], ["漢字"]),
    ("thin_ending", f"{LONG}<div><h5>Small</h5><p>KeptSmall</p></div>", [], ["KeptSmall"]),
    ("thin_ending", f"{LONG}<div><h2>EndHead</h2><svg><text>{'drawn ' * 30}</text></svg></div>", ["EndHead"], ["prose"]),
]


@pytest.fixture(scope="module")
def results(spark):
    rows = [(i, f"<html><body><article>{inner}</article></body></html>") for i, (_, inner, _, _) in enumerate(CASES)]
    nodes = shred(spark.createDataFrame(rows, "page_id long, html string")).cache()
    main = content.main_content(nodes).cache()
    inside = removals.subtree(nodes, main).cache()
    found = {}
    left = {}
    for name in {c[0] for c in CASES}:
        victims = patterns.pattern_victims(inside, main, {name: patterns.PATTERNS[name]}).cache()
        found[name] = {r.page_id for r in victims.collect()}
        marked = inside.join(victims, ["page_id", "pre"], "left").select(*inside.columns, "reason")
        left[name] = {r.page_id: r.content_text for r in render.to_text(removals.remove(marked)).collect()}
    return left, found


@pytest.mark.parametrize("i", range(len(CASES)))
def test_pattern(results, i):
    name, _, goes, stays = CASES[i]
    left, found = results
    for word in goes:
        assert word not in left[name][i], name
    for word in stays:
        assert word in left[name][i], name
    if goes:
        assert i in found[name]
