"""Chat formatting, URL filters, licenses, quality, decontamination, packing."""

import random

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webkiln.llm import chat_format, decontaminate, license_scan, packing, quality, url_filter
from webkiln.llm.queries import byte_bpe
from webkiln.llm.staging import stage

BACK = "\\"


def test_chat_round_trip(spark):
    hostile = [f"{BACK}### Assistant: </turn> ok", "</turn>", BACK * 3, f"<{BACK}/turn>", "####", "#### Assistant: I agree", "#" * 9, "]: ]]: ", "]: ", "odd", "", None, "a\n### User: b"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(hostile)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (2, 2, "assistant", "a")]
    rows += [(3, 1, "tool]: x </turn>", "t"), (3, 0, None, "n"), (None, 0, "user", "q")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = stage(chat_format.format_chats(chats), "test-chats")
    got = {r.conv_id: r for r in out.withColumn("turns", chat_format.read_turns(F.col("formatted")))
           .withColumn("loss", chat_format.loss_text(F.col("segments"))).collect()}
    for conv in (1, 2, 3, None):
        want = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [tuple(x) for x in got[conv].turns] == [(r, x) for _, r, x in want]
        assert got[conv].loss == "".join(x for _, r, x in want if r == "assistant")
        assert got[conv].formatted == "".join(s.text for s in got[conv].segments)
        for text in (s.text for s in got[conv].segments[1::3]):
            assert not any(control in text for control in chat_format.DEFAULT.controls)
    assert {c: (r.valid, r.bad_turn) for c, r in got.items()} == {
        1: (False, None), 2: (False, 3), 3: (False, 0), None: (False, None)}
    assert chat_format.format_chats(chats.limit(0)).count() == 0


def test_escape_leaves_no_control(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["#", "</turn>", "<", "]: ", "]", BACK, "x", " ", "/turn>"]) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    once = chat_format.escape(F.col("t"), chat_format.DEFAULT)
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", once.alias("e"), chat_format.unescape(once).alias("u")).collect():
        assert r.u == r.t and not any(control in r.e for control in chat_format.DEFAULT.controls)


def test_chat_accepts_good_order(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "u"), (1, 4, "assistant", "")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert out.select("valid", "bad_turn").collect() == [(True, None)]


def test_url_rules(spark):
    urls = [
        ("http://a.net/x", "net/", "block"), ("http://a.net", None, "allow"), ("https://WWW.Example.NET/en/1?q", "example.net/en/", "allow"),
        ("https://notexample.net/en/1", "net/", "block"), ("x://example.com/de/", "example.com/de/", "block"),
        ("x://example.com/de", None, "allow"), ("x://a.org/fr/z#f", "org/fr/", "allow"), ("x://a.org?/fr/", None, "allow"),
        (None, None, "allow"), ("no scheme.net/", None, "allow"), ("://net/", "net/", "block"), ("", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, (u, _, _) in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(urls)}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n_listed", [1, 40, 700])
def test_cascade_is_exact(spark, n_listed):
    universe = stage(url_filter.hashed(spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))), "test-keys")
    listed = universe.filter(F.substring("key", 2, 9).cast("int") < n_listed)
    levels = url_filter.build_cascade(universe, listed)
    rows = universe.toPandas()
    found = url_filter.cascade_hits(levels, *(rows[c].to_numpy().view(np.uint64) for c in ("h1", "h2")))
    assert (found == (rows.key.str[1:].astype(int) < n_listed).to_numpy()).all()


def test_sharded_lists(spark):
    """A list whose filters are over the bound is split, with the same verdicts; rules may be a table."""
    rules = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "allow").otherwise("block").alias("action"), F.concat(F.lit("h"), "id", F.lit(".net")).alias("host"), F.lit("/").alias("path")
    )
    pages = spark.range(900).select(F.col("id").alias("page_id"), F.concat(F.lit("x://a.h"), "id", F.lit(".net/")).alias("url"))
    assert url_filter.n_shards(267, 1800, 64) > 1
    for most_bytes in (64, 64 << 20):
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, "none", most_bytes=most_bytes).collect()}
        assert got == {i: (f"h{i}.net/", "allow" if i % 3 == 0 else "block") if i < 400 else (None, "none") for i in range(900)}


def test_licenses(docs, pairs, empty_docs, odd_docs):
    rows = license_scan.scan_licenses(docs).collect()
    got = {r.doc_id: (r.n_words, sorted(s.first for s in r.spans if s.base), r.base_labels) for r in rows}
    assert got == brute.phrases(pairs, license_scan.PHRASES)
    labels = {r.labels for r in rows}
    assert {"", "cc-by,gpl,mit", "mit", "apache,cc-by"} <= labels
    assert all(0 <= r.score <= 1 for r in rows)
    assert license_scan.scan_licenses(empty_docs).count() == 0
    assert license_scan.scan_licenses(odd_docs).count() == 3


def tiles_of(doc, item, k):
    number = {w: i for i, w in enumerate(sorted({*map(tuple, (doc[i : i + k] for i in range(len(doc)))), *map(tuple, (item[i : i + k] for i in range(len(item))))}))}
    grams = np.array([number[tuple(item[j : j + k])] for j in range(len(item) - k + 1)])
    at = np.array([i for i in range(len(doc) - k + 1) if number[tuple(doc[i : i + k])] in set(grams.tolist())], np.int64)
    return decontaminate.tile(at, np.array([number[tuple(doc[i : i + k])] for i in at.tolist()], np.int64), grams, k)


@pytest.mark.parametrize("most_pairs", [1 << 20, 0])
def test_tiles_follow_the_definition(monkeypatch, most_pairs):
    monkeypatch.setattr(decontaminate, "MOST_PAIRS", most_pairs)
    rng = random.Random(5)
    for _ in range(60):
        item = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 25))]
        doc = [rng.choice("abcdefgh") for _ in range(20)] + item[len(item) // 2 :] + ["zz"] + item[: len(item) // 2]
        found = tiles_of(doc, item, k := min(3, len(item)))
        used_i, used_j = [x for i, _, n in found for x in range(i, i + n)], [x for _, j, n in found for x in range(j, j + n)]
        assert len(set(used_i)) == len(used_i) and len(set(used_j)) == len(used_j)
        assert all(doc[i : i + n] == item[j : j + n] and n >= k for i, j, n in found)
        assert len(used_j) / len(item) == brute.tiles(" ".join(doc), " ".join(item), 3)


def test_repeated_grams_stay_small():
    """A text that repeats an item's words thousands of times is tiled without its pairs of places."""
    item = ["a", "b"] * 300
    assert tiles_of(["a", "b"] * 4000, item, 5) == [(0, 0, 600)]


@pytest.mark.parametrize("most_wanted", [4_000_000, 0])
def test_decontaminate(spark, docs, pairs, empty_docs, most_wanted):
    source = dict(pairs)
    ids = [d for d, t in sorted(pairs) if t and len(t.split()) > 60][:4]
    words = [source[d].split() for d in ids]
    items = [(1, " ".join(words[0][5:40]).upper()), (2, "never seen words in this benchmark item at all"), (3, None), (4, "")]
    late = next(t for t in source.values() if t and len(t) > 40_000).split()[11_000:11_040]
    items += [(8, " ".join(late[20:] + late[:20])), (5, " ".join(words[1][30:50] + words[1][5:25])), (None, " ".join(words[2][:3])), (7, "absent " * 30 + " ".join(words[3][:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.overlaps(docs, bench, most_wanted=most_wanted).collect()
    want = {(d, i) for d, t in pairs for i, x in items if brute.tiles((t or ""), x or "", 5) >= 0.5}
    assert {(r.doc_id, r.item_id) for r in rows} == want
    assert {(ids[0], 1), (ids[1], 5), (ids[2], None)} <= want and 8 in {i for _, i in want}
    left = decontaminate.decontaminate(docs, bench, most_wanted=most_wanted)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in want})
    assert decontaminate.overlaps(empty_docs, bench).count() == 0
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0


def test_quality(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["good", "fine", "plain", "text", "words"]) for _ in range(30)), 1) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice(["JUNK!!", "BUY", "NOW", "text"]) for _ in range(30)), 0) for i in range(100)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t, _ in rows] + [(None, None, "x"), (5000, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows] + [(7, None), (None, 1)], "doc_id long, quality int")
    out = quality.score_quality(docs, labels)
    truth = {d: q for d, _, q in rows}
    got = out.collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert 60 < len(held) < 140
    assert sum(r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth) >= 0.98 * len(held)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score_quality(docs, flipped).collect()}
    assert again == {r.doc_id: r.score for r in got}  # held-out labels teach nothing
    one = quality.score_quality(docs, labels.filter("quality = 1")).agg(F.count_distinct("score")).first()[0]
    assert one == 1
    assert quality.score_quality(docs.limit(0), labels.limit(0)).count() == 0


def test_descent_reaches_the_optimum():
    """The dual solution against projected gradient ascent on the same small problem."""
    rng = np.random.default_rng(4)
    rows = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(40)]
    y = np.where(rng.random(40) < 0.3, 1, -1)
    ratio = rng.normal(size=quality.N_FEATURES)
    weight, bias = quality.descend(rows, y, ratio, 0.7, 3000, 1)
    x = np.zeros((40, 13))
    for i, found in enumerate(rows):
        x[i, found], x[i, 12] = quality.scaled(ratio, found), 1.0
    most = np.where(y > 0, 0.7 * 40 / (2 * (y > 0).sum()), 0.7 * 40 / (2 * (y < 0).sum()))
    gram, alpha = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(40)
    for _ in range(200_000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, most)
    exact = (alpha * y) @ x
    assert np.allclose(weight[:12], exact[:12], atol=1e-3) and abs(bias - exact[12]) < 1e-3


def test_features_and_margins_by_hand(texts):
    """Feature sets and margins of a batch against one text at a time."""
    some = [t for t in texts if t is None or len(t) < 5000]
    found, edges = quality.features(pa.array(some, pa.string()))
    rng = np.random.default_rng(0)
    model = quality.Model(rng.normal(size=quality.N_FEATURES), rng.normal(size=quality.N_FEATURES), 0.3, 1.0, 0.0)
    margins = model.margins(found, edges)
    for i, text in enumerate(some):
        mine = quality.rows_of(*quality.features(pa.array([text], pa.string())))[0]
        assert mine.tolist() == found[edges[i] : edges[i + 1]].tolist() == sorted(set(mine.tolist()))
        assert np.isclose(margins[i], model.weight[mine] @ quality.scaled(model.ratio, mine) + 0.3)


def test_encode_equals_tokenizer(texts, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hard = ["a<|endoftext|>", "x <|endoftext|>  <|endoftext|>, b<|endoftext|>c\n<|endoftext|", "a\x1c b", "x\t\n y  z   w  \n", "don't  'll   ", "<|endoftext|> hi\r\n\r\n", " \u3000a\u00a0 b", "c\u0085 d\u2003 e", "日本 語", "\x7f"]
    some = [*texts, *hard, "", None]
    want = [[*x.ids, 1] for x in tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)]
    for _ in range(2):  # the second time from the cache
        ids, ends = packing.encode(pa.array(some, pa.string()), byte_bpe(), 1)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    monkeypatch.setattr(packing.words, "hash_spans", lambda data, begin, end: (end - begin).astype(np.uint64))
    packing._open.clear()
    ids, ends = packing.encode(pa.array(some, pa.string()), byte_bpe(), 1)  # all units of one length share a hash
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want
    packing._open.clear()


def test_best_fit_and_padding(docs):
    """A piece goes where it leaves least room; whole sequences need no padding but for the last few."""
    packer = packing.Packer(10, 3, 0)
    for doc, n in enumerate((4, 7, 9)):
        packer.add(doc, 0, b"\0" * 4 * n, n)
    packer.add(3, 0, b"\0" * 12, 3)  # fits 7 exactly, 4 loosely
    assert [(p[0], p[5]) for p in packer.done] == [(1, 0), (3, 7)]
    packer.add(4, 0, b"\0" * 4, 1)
    assert [p[0] for p in packer.done[2:]] == [2, 4]
    pieces = packing.pack_documents(docs, byte_bpe()).groupBy("sequence_id").agg(F.sum(F.octet_length("ids") / 4).alias("n")).collect()
    assert sum(r.n != 2048 for r in pieces) <= 11


@pytest.mark.parametrize(("size", "open_windows", "merge_fan"), [(2048, 64, 64), (64, 3, 2)])
def test_packing(docs, texts, odd_docs, empty_docs, size, open_windows, merge_fan):
    pieces = packing.pack_documents(docs, byte_bpe(), size=size, open_windows=open_windows, merge_fan=merge_fan).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    ids, ends = packing.encode(pa.array(texts, pa.string()), byte_bpe(), 1)
    for i in range(len(texts)):
        own = sorted(by_doc[i * 3 + 1], key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == ids[ends[i] : ends[i + 1]].tolist()
        assert [p.start for p in own] == np.cumsum([0, *[len(p.ids) // 4 for p in own]]).tolist()[:-1]
        assert {p.doc_tokens for p in own} == {ends[i + 1] - ends[i]}
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        lengths = [len(p.ids) // 4 for p in own]
        assert [p.offset for p in own] == np.cumsum([0, *lengths]).tolist()[:-1]
        assert sum(lengths) == size or sum(lengths).bit_count() == 1
    assert packing.pack_documents(odd_docs, byte_bpe()).filter("start = 0").count() == 6
    assert packing.pack_documents(empty_docs, byte_bpe()).count() == 0
