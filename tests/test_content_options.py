"""What a caller chooses: the main content by a selector, pages without images."""

import pytest

from webkiln.plans import extract as plan

WORDS = "plain words of a story that goes on for a while " * 8
PAGES = [
    (1, f"<article><p>{WORDS}</p></article><section class='extra note'><p>first note</p><img src=a.png></section><section class=note><p>other</p></section>"),
    (2, f"<article><p>{WORDS}</p><picture><source srcset=b.webp><img src=b.png width=600></picture><svg width=90><path d='M0'></path></svg></article>"),
    (3, "<nav><div class=note><p>kept inside nav</p></div></nav><p>body text</p>"),
    (4, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, f"https://e.org/{i}", h) for i, h in PAGES], "page_id long, url string, html string").cache()


def test_content_selector(pages):
    got = {r.page_id: r for r in plan.extract(pages, plan.Options(content_selector="section.note, nav > .note")).collect()}
    assert "first note" in got[1].content and "other" not in got[1].content and "plain words" not in got[1].content
    assert got[1].content.startswith("<section") and "a.png" in got[1].content and got[1].word_count == 2
    assert "plain words" in got[2].content  # nothing found: the best candidate
    assert "kept inside nav" in got[3].content and "body text" not in got[3].content
    assert got[4].word_count == 0
    with pytest.raises(ValueError):
        plan.extract(pages, plan.Options(content_selector="p >"))


def test_no_images(pages):
    got = {r.page_id: r for r in plan.extract(pages, plan.Options(remove_images=True), ladder=False).collect()}
    assert "plain words" in got[2].content
    assert not any(mark in got[2].content for mark in ("<img", "<svg", "<picture", "<source"))
    kept = plan.extract(pages, ladder=False).filter("page_id = 2").first()
    assert "b.png" in kept.content
