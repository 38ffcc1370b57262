"""Notices that a text repeats or shuffles."""

from webkiln.llm import license_scan


def test_repeated_notices(spark):
    footer = "All rights reserved. "
    parts = license_scan.NOTICES["gpl"].split()
    shuffled = [p for a in (0, 6, 3, 9, 12, 6, 15, 18, 12, 21, 24, 18) * 3 for p in parts[a : a + 5]]
    texts = {1: footer, 2: footer * 2, 3: footer * 3, 4: "x " + footer * 50, 5: " ".join(parts * 4), 6: " ".join(shuffled + parts), 7: "all rights " * 9}
    rows = license_scan.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in rows}
    for doc, times in ((1, 1), (2, 2), (3, 3), (4, 50)):
        shift = int(doc == 4)
        assert [(s.first, s.last) for s in got[doc].spans] == [(3 * k + shift, 3 * k + 2 + shift) for k in range(times)]
        assert (got[doc].labels, got[doc].score) == ("all-rights-reserved", 1.0)
    whole = [(s.first, s.last) for s in got[5].spans if not s.base and s.label == "gpl"]
    assert whole == [(29 * k, 29 * k + 28) for k in range(4)]
    assert "gpl" in [s.label for s in got[6].spans if not s.base] and got[6].score == 1.0
    assert all(s.last - s.first < 2 * len(parts) for s in got[6].spans)


def test_a_part_of_a_short_notice_is_none(spark):
    texts = ["we discussed all rights of way", "these are rights reserved seats", "all other rights reserved", "so: All rights reserved."]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(rows).collect()}
    assert got == {0: ("", 0.0), 1: ("", 0.0), 2: ("", 0.0), 3: ("all-rights-reserved", 1.0)}
