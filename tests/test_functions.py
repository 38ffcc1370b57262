"""Image, code, url and date helpers on single values."""

import pytest
from pyspark.sql import functions as F

from webkiln.functions import jsonld, media, text, urls

SMALL, LARGE = "A" * 132, "A" * 133

#: (function, value, expected)
CASES = [
    (media.is_placeholder, f"data:image/gif;base64,{SMALL}", True),
    (media.is_placeholder, f"data:image/gif;base64,{LARGE}", False),
    (media.is_placeholder, f"data:image/svg+xml;base64,{SMALL}", False),
    (media.is_placeholder, "https://x.org/a.gif", False),
    (media.is_placeholder, None, None),
    (media.is_svg_data, "data:image/svg+xml;utf8,<svg/>", True),
    (media.is_svg_data, "data:image/png;base64,A", False),
    (media.is_image_url, "https://x.org/A.JPG?w=3", True),
    (media.is_image_url, "https://x.org/photo/7", True),
    (media.is_image_url, "data:image/png;base64,A", False),
    (media.is_image_url, "https://x.org/PHOTO/7", False),
    (media.is_image_url, "https://x.org/a.txt", False),
    (media.is_image_url, "  ", False),
    (media.first_of_srcset, "/a.jpg 1x, /b.jpg 2x", "/a.jpg"),
    (media.first_of_srcset, "/f,w_9,h_2/a.jpg 424w, /b.jpg 848w", "/f,w_9,h_2/a.jpg"),
    (media.first_of_srcset, "data:image/svg+xml;x 1x, /b.jpg 2x", "/b.jpg"),
    (media.first_of_srcset, " /only.jpg ", "/only.jpg"),
    (media.first_of_srcset, "data:image/svg+xml;x", ""),
    (media.first_of_srcset, "", ""),
    (media.first_of_srcset, None, None),
    (media.is_caption, "A view of the harbour", True),
    (media.is_caption, "short", False),
    (media.is_caption, "https://x.org/long/path", False),
    (media.is_caption, "IMG_2020-long.JPEG", False),
    (media.is_caption, "12345678901", False),
    (media.is_caption, " 2020-05-03 ", False),
    (media.is_caption, "2020-05-03 and later", True),
    (media.is_code_language, "c++", True),
    (media.is_code_language, "Python", False),
    (media.tidy_code, "\n\n\ta\tb\u00a0c\n\n\n\nd \n", "a    b c\n\nd"),
    (media.looks_like_latex, "cost $x$", True),
    (media.looks_like_latex, "cost $5", False),
    (media.looks_like_latex, "$5\nand $6", False),
    (media.looks_like_latex, r"\frac12", True),
    (media.looks_like_latex, "a_b", True),
    (media.looks_like_latex, "", False),
    (media.class_language, "hl language-go lang-py", "go"),
    (media.class_language, "lang-", ""),
    (media.class_language, "slang-x", ""),
    (media.has_callout_class, "note callout-tip", True),
    (media.has_callout_class, "callouts", False),
    (lambda c: media.has_class(c, "a"), "b\ta", True),
    (lambda c: media.has_class(c, "a"), "ab", False),
    (text.is_word_char, "_", True),
    (text.is_word_char, "é", False),
    (text.is_word_char, "", False),
    (text.posted_date, "[Posted May 3, 2020 by jake]", "2020-05-03"),
    (text.posted_date, "posted December 31, 1999", "1999-12-31"),
    (text.posted_date, "Posted may 3, 2020", ""),
    (text.posted_date, "Posted Foo 3, 2020; Posted May 3, 2020", ""),
    (text.posted_date, "", ""),
    (urls.is_tracking_pixel, "https://x.org/Pixel.GIF", True),
    (urls.is_tracking_pixel, "https://x.org/pixel-art.png", False),
    (urls.is_tracking_pixel, "https://metrics.x.org/a", True),
    (urls.citation_domain, "https://www.Example.org:80/a", "Example.org"),
    (urls.citation_domain, "//u@[::1]:8/", "::1"),
    (urls.citation_domain, "no host", ""),
    (urls.citation_domain, "https://x.org/%zz", "https://x.org/%zz"),
    (urls.fragment_text, "https://x.org/#:~:text=one%20two", " — one two"),
    (urls.fragment_text, "https://x.org/#:~:text=one+two,four", " — one two..."),
    (urls.fragment_text, "https://x.org/#:~:text=,four", ""),
    (urls.fragment_text, "https://x.org/#:~:text=%zz", ""),
    (urls.fragment_text, "https://x.org/#top", ""),
    (urls.unwrap_redirect, "https://l.x.org/?a=1&u=https%3A%2F%2Fy.org%2F%3Fq%3D1&e=2#f", "https://y.org/?q=1"),
    (urls.unwrap_redirect, "https://l.x.org/?u=&u=b", "https://l.x.org/?u=&u=b"),
    (urls.unwrap_redirect, "https://l.x.org/?u=%25zz", "https://l.x.org/?u=%25zz"),
    (urls.unwrap_redirect, "https://l.x.org/", "https://l.x.org/"),
    (urls.large_image, "https://i.org/a?format=jpg&name=small", "https://i.org/a?format=jpg&name=large"),
    (urls.large_image, "https://i.org/a?format=jpg", "https://i.org/a?format=jpg&name=large"),
    (urls.large_image, "https://i.org/a", "https://i.org/a?name=large"),
]


@pytest.fixture(scope="module")
def answers(spark):
    rows = spark.createDataFrame([tuple(v for _, v, _ in CASES)], ", ".join(f"c{i} string" for i in range(len(CASES))))
    return rows.select(*[f(F.col(f"c{i}")).alias(f"r{i}") for i, (f, _, _) in enumerate(CASES)]).first()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_value(answers, i):
    assert answers[i] == CASES[i][2], CASES[i][1]


def test_decorative(spark):
    cases = [
        ("49", None, None, None, True),
        ("50", "50", "photo", "/a.jpg", False),
        ("40%", None, None, None, False),
        (None, None, "User-Avatar", "/a.jpg", True),
        (None, None, None, "/beacon", True),
    ]
    rows = spark.createDataFrame(cases, "width string, height string, classes string, src string, want boolean")
    got = rows.select(media.is_decorative(*(F.col(c) for c in ("width", "height", "classes", "src"))).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


LD = """[{"@type":"Article","publisher":[{"name":"One"},{"name":"Two"}],"author":{"name":"Ann"},"keywords":["a",3,"b"],"rating":4,
 "image":{"url":"/i.png"},"tags":[["x"],"y"],"isPartOf":{"@id":"#site"}},{"@type":["Article","Thing"],"author":{"name":"Bob"}}]"""


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("publisher.name", "One, Two"),
        ("publisher", "One, Two"),
        ("author.name", "Ann, Bob"),
        ("author", "Ann, Bob"),
        ("keywords", "a, 3, b"),
        ("keywords.[2]", "b"),
        ("rating", ""),
        ("image.url", "/i.png"),
        ("image", ""),
        ("isPartOf.name", ""),
        ("none.at.all", ""),
    ],
)
def test_schema_path(spark, path, want):
    found = jsonld.items(F.lit(LD))
    assert spark.range(1).select(jsonld.joined(found, path)).first()[0] == want


def test_schema_types(spark):
    assert spark.range(1).select(jsonld.n_types(jsonld.items(F.lit(LD)))).first()[0] == 2
    assert spark.range(1).select(jsonld.joined(F.lit(None).cast("array<variant>"), "a")).first()[0] == ""
