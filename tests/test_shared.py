"""Materialised tables of queries that run side by side."""

import threading

from webkiln.sources import shared


def test_threads_discard_only_their_own(spark):
    mine = shared.materialise(spark.range(3), "mine")
    before = list(shared.written(spark))
    seen = {}

    def other():
        table = shared.materialise(spark.range(5), "other")
        seen["paths"] = list(shared.written(spark))
        seen["rows"] = table.count()
        shared.discard(spark, seen["paths"])

    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert seen["rows"] == 5 and len(seen["paths"]) == 1
    assert shared.written(spark) == before and mine.count() == 3
