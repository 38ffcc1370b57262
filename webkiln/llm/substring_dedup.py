"""Substring dedup by relative Lempel-Ziv parsing.

The reference of a document is everything that starts before it, cut into blocks of
``BLOCK_WORDS`` words.  Three steps lead to the factors:

1. An index tells where the windows (``window`` words each) of a document start
   earlier.  Neighbouring windows that share one anchor, the ``gram``-word sequence with
   the smallest hash inside the window, are posted together under that anchor; equal
   windows have equal anchors at equal offsets, wherever they stand.  Repeats inside one
   slice of the input are settled before the shuffle.  Anchors that many documents hold
   are found on a bounded sample beforehand; their windows are posted one by one, dealt
   by their own hashes, and meet in two levels, so no bucket grows with a hot anchor.
2. Each run of windows asks the reference for the words of its earliest place, from
   there to the end of a block.  Only texts that are asked are moved; what is asked of a
   text is sorted behind it, so a task holds one text at a time.
3. The document is parsed greedily: a factor starts at the first window that has an
   earlier place and is extended word by word against that reference block as far as the
   words agree.  The parse goes on from the factor's end, with a check of the windows
   that cross this boundary.  Factors of ``window`` words or more are duplicate spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webkiln.llm import words
from webkiln.llm.bloom import hashes, hit_by, maybe_in, sent_filter
from webkiln.llm.staging import KEY, for_each_salt, heavy_keys, input_bytes, keyed, salted, stage

#: Places are (doc, same, start): id, hash of the text (rows may repeat an id), word.
RUN = np.dtype(
    [("doc", "<i8"), ("same", "<i8"), ("start", "<i4"), ("n", "<i4"), ("ref_doc", "<i8"), ("ref_same", "<i8"), ("ref_start", "<i4")]
)
RUNS = "doc long, same long, start int, n int, ref_doc long, ref_same long, ref_start int"
#: Words of a reference block.
BLOCK_WORDS = 512
#: Text that a task settles at a time, and of the sample that hot anchors are looked for in.
SLICE_BYTES, SAMPLE_BYTES = 2 << 20, 1 << 30
#: Text, and rows, that a task hands on at a time.
OUT_BYTES, OUT_ROWS = 1 << 20, 2000
#: Postings that an anchor may bring to a bucket; it is hot if it has more, and HOT of them or more in the sample.
MOST_POSTINGS, HOT = 200_000, 8


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the smallest of ``width`` values, for every start."""
    at, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at


def windows_of(hashed: words.Words, window: int, gram: int):
    """(anchor hash, anchor position, window start, window hash) of all windows; positions in the batch."""
    full = words.ngrams(hashed.hashes, window)
    if not len(full):
        empty = np.zeros(0, np.int64)
        return full, empty, empty, full
    grams = words.ngrams(hashed.hashes, gram)
    anchor = sliding_argmin(grams, window - gram + 1)
    doc = hashed.text_of
    start = np.flatnonzero(doc[: len(full)] == doc[window - 1 :])
    anchor = anchor[start]
    return grams[anchor], anchor, start, full[start]


def find_copies(anchor: np.ndarray, offset: np.ndarray, full: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """Index pairs (copy, earliest place of the same window), and what repeats a place; all arrays are by window.

    Two windows are the same if anchor hash, anchor offset and 40 bits of the window
    hash agree (over 100 bits in all); the parse compares their words.
    """
    many, place, counts = np.unique(anchor, return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[place] > 1)
    if not len(some):
        return some, some, some
    key = words.mix(anchor[some] ^ words.mix(full[some] * np.uint64(32) + offset[some].astype(np.uint64)))
    order = np.lexsort((start[some], doc[some], key))
    key, some = key[order], some[order]
    head = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    size = np.diff(head, append=len(key))
    first = some[np.repeat(head, size)]
    later = (doc[some] > doc[first]) | ((doc[some] == doc[first]) & (start[some] > start[first]))
    again = ~later
    again[head] = False
    return some[later], first[later], some[again]


def ranks(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of the rows of several columns, the first counting most."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def as_runs(rank: np.ndarray, doc: np.ndarray, same: np.ndarray, start: np.ndarray, copy: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Merge the copies that go on in the same reference into runs."""
    order = np.lexsort((start[copy], rank[copy]))
    copy, source = copy[order], source[order]
    goes_on = (
        (rank[copy][1:] == rank[copy][:-1])
        & (start[copy][1:] == start[copy][:-1] + 1)
        & (rank[source][1:] == rank[source][:-1])
        & (start[source][1:] == start[source][:-1] + 1)
    )
    head = np.flatnonzero(np.r_[True, ~goes_on][: len(copy)])
    runs = np.zeros(len(head), RUN)
    runs["n"] = np.diff(head, append=len(copy))
    copy, source = copy[head], source[head]
    runs["doc"], runs["same"], runs["start"] = doc[copy], same[copy], start[copy]
    runs["ref_doc"], runs["ref_same"], runs["ref_start"] = doc[source], same[source], start[source]
    return runs


def _run_columns(runs: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(runs[c])) for c in RUN.names]


#: A posting: anchors that stand somewhere, each with the windows around it.
_POST = (("<u8", 0), ("<i8", 0), ("<i8", 0), ("<i4", 0), ("u1", 0), ("u1", 0), ("<u4", 1), ("u1", 1))


def _pack(anchor, doc, same, pos, offset, size, full) -> bytes:
    """All but ``full`` by anchor; full has ``size`` window hashes for each of them."""
    arrays = (anchor, doc, same, pos, offset, size, full, full >> np.uint64(32))
    return np.array([len(anchor), len(full)], "<i4").tobytes() + b"".join(
        x.astype(kind).tobytes() for x, (kind, _) in zip(arrays, _POST, strict=True)
    )


def _unpack(posts: list[bytes], all_: bool):
    """Window arrays (anchor, offset, full, doc, same, start, rank) of a bucket's postings.

    Unless all are asked for, only of anchors that stand in two places: others hold no copies.
    """
    parts = []
    for post in posts:
        counts = np.frombuffer(post, "<i4", 2)
        at, arrays = 8, []
        for kind, by in _POST:
            arrays.append(np.frombuffer(post, kind, counts[by], at))
            at += arrays[-1].nbytes
        parts.append(arrays)
    anchor, doc, same, pos, offset, size, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = size.astype(np.int64)
    if not all_:
        _, place, counts = np.unique(anchor, return_inverse=True, return_counts=True)
        shared = counts[place] > 1
        window = np.repeat(shared, size)
        anchor, doc, same, pos, offset, size = (x[shared] for x in (anchor, doc, same, pos, offset, size))
        low, high = low[window], high[window]
    rank = ranks(doc, same)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    anchor, doc, same, pos, offset, rank = (np.repeat(x, size) for x in (anchor, doc, same, pos, offset, rank))
    offset = offset.astype(np.int64) - step
    full = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
    return anchor, offset, full, doc, same, pos.astype(np.int64) - offset, rank


def _anchors(window: int, gram: int):
    """mapInArrow: in how many places of a slice each anchor has windows that the slice does not repeat."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", SLICE_BYTES):
            anchor, at, start, full = windows_of(words.hash_words(batch.column("text"), "raw"), window, gram)
            copy, _, _ = find_copies(anchor, at - start, full, np.zeros(len(at), np.int64), start)
            stays = np.ones(len(anchor), bool)
            stays[copy] = False
            anchor, at = anchor[stays], at[stays]
            found, n = np.unique(anchor[np.flatnonzero(np.diff(at, prepend=-1))], return_counts=True)
            often = n >= 2
            yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often])], ["anchor", "n"])

    return words.releasing(count)


def hot_anchors(rows: DataFrame, n_bytes: int, window: int, gram: int) -> np.ndarray:
    """Anchors that would bring more than MOST_POSTINGS postings to a bucket, sorted.

    They are estimated on a sample: an eighth of the documents, or SAMPLE_BYTES of text
    where that is less, so that there are at most some hundred thousand.  The estimate decides
    how windows are dealt to tasks and never what is found.
    """
    part = max(8, n_bytes // SAMPLE_BYTES)
    if n_bytes < 8 * MOST_POSTINGS:  # not so many words
        return np.zeros(0, np.uint64)
    sample = rows.filter(F.pmod(F.xxhash64("id"), F.lit(part)) == 0)
    counts = sample.mapInArrow(_anchors(window, gram), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    least = max(HOT, MOST_POSTINGS // part)
    return np.sort(counts.filter(F.col("n") >= least).toArrow().column("anchor").to_numpy().view(np.uint64))


def _post(window: int, gram: int, n_buckets: int, n_salts: int, hot):
    """mapInArrow: slices of the input become postings, and runs settled on the spot."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", SLICE_BYTES):
            ids, sames = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "same"))
            hashed = words.hash_words(batch.column("text"), "raw")
            anchor, at, start, full = windows_of(hashed, window, gram)
            if not len(anchor):
                continue
            full &= np.uint64((1 << 40) - 1)
            text = np.searchsorted(hashed.first, start, side="right") - 1
            rank, offset, first = ranks(ids, sames)[text], at - start, hashed.first[text]
            copy, source, again = find_copies(anchor, offset, full, rank, start - first)
            runs = as_runs(rank, ids[text], sames[text], start - first, copy, source)
            stays = np.ones(len(anchor), bool)
            stays[copy] = stays[again] = False
            anchor, at, full, text, offset, first = (x[stays] for x in (anchor, at, full, text, offset, first))
            alone = np.zeros(len(anchor), bool)
            if len(hot.value):
                alone = hot.value[np.minimum(np.searchsorted(hot.value, anchor), len(hot.value) - 1)] == anchor
            new = np.r_[True, (at[1:] != at[:-1]) | (np.diff(offset) != -1)][: len(at)] | alone
            head = np.flatnonzero(new)
            size = np.diff(head, append=len(at))
            key = np.where(alone[head], words.mix(full[head] * np.uint64(32) + offset[head].astype(np.uint64)), 0)
            bucket = (words.mix(anchor[head] ^ key) % np.uint64(n_buckets)).astype(np.int64) * 2 + alone[head]
            order = np.argsort(bucket, kind="stable")
            held, edges = np.unique(bucket[order], return_index=True)
            salt = int(words.mix(ids[:1].view(np.uint64))[0] % np.uint64(n_salts))
            posts = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(order)], strict=True):
                mine = order[a:b]
                h, n = head[mine], size[mine]
                windows = np.repeat(h, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                posts.append(_pack(anchor[h], ids[text[h]], sames[text[h]], at[h] - first[h], offset[h], n, full[windows]))
            rows = len(posts) + bool(len(runs))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*(held >> 1).tolist(), salt][:rows], pa.int32()),
                    pa.array([*np.where(held & 1, salt + 1, 0).tolist(), -1][:rows], pa.int32()),
                    pa.array([*posts, runs.tobytes()][:rows], pa.binary()),
                ],
                ["bucket", "salt", "post"],
            )

    return words.releasing(post)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over partitions sorted by bucket and salt: a bucket at a time becomes runs.

    A salted bucket also hands on the earliest place of each of its windows, to meet
    those of the bucket's other salts.
    """
    names = [*RUN.names, "bucket", "post"]

    def runs_out(runs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*_run_columns(runs), pa.nulls(len(runs), pa.int32()), pa.nulls(len(runs), pa.binary())], names)

    def settle(bucket: int, salt: int, posts: list[bytes]) -> Iterator[pa.RecordBatch]:
        anchor, offset, full, doc, same, start, rank = _unpack(posts, salt > 0)
        copy, source, again = find_copies(anchor, offset, full, rank, start)
        if len(copy):
            yield runs_out(as_runs(rank, doc, same, start, copy, source))
        if salt:
            stays = np.ones(len(anchor), bool)
            stays[copy] = stays[again] = False
            anchor, offset, full, doc, same, start = (x[stays] for x in (anchor, offset, full, doc, same, start))
            left = _pack(anchor, doc, same, start + offset, offset, np.ones(len(anchor)), full)
            row = [*[pa.nulls(1, c.type) for c in _run_columns(np.zeros(0, RUN))], pa.array([bucket], pa.int32()), pa.array([left])]
            yield pa.RecordBatch.from_arrays(row, names)

    now, posts = None, []
    for batch in batches:
        for bucket, salt, post in zip(*(batch.column(c) for c in ("bucket", "salt", "post")), strict=True):
            bucket, salt = bucket.as_py(), salt.as_py()
            if salt < 0:
                yield runs_out(np.frombuffer(post.as_py(), RUN))
                continue
            if now != (bucket, salt):
                if posts:
                    yield from settle(*now, posts)
                now, posts = (bucket, salt), []
            posts.append(post.as_py())
    if posts:
        yield from settle(*now, posts)


def merged(runs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A document's runs in order, those that go on in one reference joined up to a block, and the words each asks for.

    A run asks for the words from its place to the end of the chain of runs that it
    stands in, since no match can reach beyond that, or to the end of its block.
    """
    runs = np.unique(runs[list(RUN.names[2:])])
    touches = np.r_[False, runs["start"][1:] == runs["start"][:-1] + runs["n"][:-1]]
    goes_on = np.r_[
        False,
        (runs["ref_doc"][1:] == runs["ref_doc"][:-1])
        & (runs["ref_same"][1:] == runs["ref_same"][:-1])
        & (runs["ref_start"][1:] - runs["start"][1:] == runs["ref_start"][:-1] - runs["start"][:-1]),
    ]
    head = np.flatnonzero(~(touches & goes_on))
    chain = np.flatnonzero(np.r_[~touches[1:], True])
    chain_end = (runs["start"] + runs["n"])[chain[np.searchsorted(chain, head)]] + window - 1
    last = np.r_[head[1:], len(runs)] - 1
    out = runs[head].copy()
    out["n"] = runs["start"][last] + runs["n"][last] - out["start"]
    step = BLOCK_WORDS - window + 1
    times = -(-out["n"] // step)
    k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    out, chain_end = np.repeat(out, times), np.repeat(chain_end, times)
    out["start"] += k * step
    out["ref_start"] += k * step
    out["n"] = np.minimum(step, out["n"] - k * step)
    return out, np.minimum(chain_end - out["start"], BLOCK_WORDS)


def _asks(window: int):
    """mapInArrow: a document's runs as what they ask the reference for."""
    names = [*RUN.names, "want"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("runs")
            edges, values = lists.offsets.to_numpy(), lists.values
            flat = np.zeros(len(values), RUN)
            for c in RUN.names[2:]:
                flat[c] = values.field(c).to_numpy(zero_copy_only=False)
            parts, wants = [], []
            for doc, same, a, b in zip(batch.column("doc").to_pylist(), batch.column("same").to_pylist(), edges[:-1], edges[1:], strict=True):
                found, want = merged(flat[a:b], window)
                part = np.zeros(len(found), RUN)
                part["doc"], part["same"] = doc, same
                for c in RUN.names[2:]:
                    part[c] = found[c]
                parts.append(part)
                wants.append(want.astype("<i4"))
            if parts:
                yield pa.RecordBatch.from_arrays([*_run_columns(np.concatenate(parts)), pa.array(np.concatenate(wants))], names)

    return words.releasing(ask)


def _spaced(text: bytes) -> tuple[bytes, np.ndarray]:
    """The text's words with a space after each, and where they start; the last entry is the end."""
    joined = b"".join(t + b" " for t in text.split())
    return joined, _starts(joined)


def _starts(spaced: bytes) -> np.ndarray:
    return np.r_[0, np.flatnonzero(np.frombuffer(spaced, np.uint8) == 0x20) + 1]


def _groups(is_text: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row of the text or -1, first, end) of the stretches of rows that follow a text."""
    heads = np.flatnonzero(is_text).tolist()
    if len(is_text) and (not heads or heads[0]):
        yield -1, 0, heads[0] if heads else len(is_text)
    for a, b in zip(heads, [*heads, len(is_text)][1:], strict=True):  # a batch may lie inside one text's rows and have no head
        yield a, a + 1, b


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over reference texts, each before what is asked of it: the words asked for, joined by spaces.

    A task holds one text and OUT_BYTES of answers.
    """
    spaced, begin = b"", np.zeros(1, np.int64)
    for batch in batches:
        at, want = (batch.column(c).to_numpy() for c in ("ref_start", "want"))
        columns = [batch.column(c) for c in RUN.names]
        rows, pieces, held = [], [], 0

        def answers() -> pa.RecordBatch:
            take = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([*[c.take(take) for c in columns], pa.array(pieces, pa.binary())], [*RUN.names, "piece"])

        for text, a, b in _groups(at < 0):
            if text >= 0:
                spaced, begin = _spaced(batch.column("text")[text].as_py().encode())
            low = begin[at[a:b]].tolist()
            high = begin[np.minimum(at[a:b] + want[a:b], len(begin) - 1)].tolist()
            for row, x, y in zip(range(a, b), low, high, strict=True):
                rows.append(row)
                pieces.append(spaced[x : y - 1])
                held += y - x
                if held >= OUT_BYTES:
                    yield answers()
                    rows, pieces, held = [], [], 0
        if rows:
            yield answers()


class Parse:
    """The greedy factors (start, length, ref_doc, ref_start), in words, of one text; runs come in order of start."""

    def __init__(self, text: bytes, window: int):
        self.text, self.begin = _spaced(text)
        self.data, self.window, self.at = np.frombuffer(self.text, np.uint8), window, 0
        self.factors: list[tuple[int, int, int, int]] = []

    def feed(self, start: int, n: int, ref_doc: int, ref_start: int, piece: bytes) -> None:
        """A run of windows and the reference's words from its place on."""
        at, begin = max(self.at, start), self.begin
        piece = piece + b" "
        block, words_at = np.frombuffer(piece, np.uint8), _starts(piece)
        while at < start + n:
            left = block[words_at[at - start] :]
            mine = self.data[begin[at] : begin[at] + len(left)]
            differ = np.flatnonzero(mine != left[: len(mine)])
            agree = differ[0] if len(differ) else len(mine)
            length = int(np.searchsorted(begin, begin[at] + agree, side="right")) - 1 - at
            if length < self.window:  # the index's hashes agreed, the words do not
                at += 1
                continue
            self.factors.append((at, length, ref_doc, ref_start + at - start))
            at += length - self.window + 1  # the first window that crosses the boundary
        self.at = at

    def kept(self) -> tuple[str, int, int]:
        """The text without its factors, and how many words it had and lost."""
        n = len(self.begin) - 1
        edge = np.zeros(n + 1, np.int64)
        for start, length, *_ in self.factors:
            edge[start] += 1
            edge[start + length] -= 1
        gone = np.cumsum(edge) > 0
        cuts = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=1, append=1))  # kept stretches from and to
        parts = [self.text[self.begin[a] : self.begin[b]] for a, b in zip(cuts[::2], np.minimum(cuts[1::2], n), strict=True)]
        return b"".join(parts)[:-1].decode(), n, int(gone[:n].sum())


_OUT = (
    "id long, n_words long, n_removed long, kept_text string, "
    "factors array<struct<start: int, length: int, ref_doc: long, ref_start: int>>"
)
_FACTORS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_doc", pa.int64()), ("ref_start", pa.int32())]))


def _rows_out(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (id, n_words, n_removed, kept_text, factors) as a batch."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), _FACTORS]
    names = ["id", "n_words", "n_removed", "kept_text", "factors"]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _apply(window: int):
    """mapInArrow over texts, each before its runs and their words: factors, and the text without them.

    A task holds one text and its factors, however many runs it has.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, copies, parsing, rows, held = None, 0, None, [], 0

        def done() -> int:
            kept, n, removed = parsing.kept()
            found = [dict(zip(("start", "length", "ref_doc", "ref_start"), x, strict=True)) for x in parsing.factors]
            rows.extend([(key[0], n, removed, kept, found)] * copies)
            return len(kept) * copies

        for batch in batches:
            ids, same, salt, start, n, ref_doc, ref_start = (
                batch.column(c).to_numpy() for c in ("id", "same", "salt", "start", "n", "ref_doc", "ref_start")
            )
            pieces = batch.column("piece")
            for text, a, b in _groups(start < 0):
                if text >= 0:
                    this = (int(ids[text]), int(same[text]), int(salt[text]))
                    if this == key:
                        copies += 1
                    else:
                        if parsing is not None:
                            held += done()
                        if held >= OUT_BYTES or len(rows) >= OUT_ROWS:
                            yield _rows_out(rows)
                            rows.clear()
                            held = 0
                        key, copies = this, 1
                        parsing = Parse((batch.column("text")[text].as_py() or "").encode(), window)
                ends = start[a:b] + n[a:b]
                for k in range(a, b):
                    if ends[k - a] > parsing.at:
                        parsing.feed(int(start[k]), int(n[k]), int(ref_doc[k]), int(ref_start[k]), pieces[k].as_py())
        if parsing is not None:
            done()
        if rows:
            yield _rows_out(rows)

    return words.releasing(apply)


def _whole(but):
    """mapInArrow over texts without copies, which the filter ``but`` does not hold (columns h1 and h2): all words stay."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))
            for part in words.slices(iter([batch.filter(pa.array(~but.value.hits(h1, h2)))]), "text"):
                tokens = [(text.as_py() or "").encode().split() for text in part.column("text")]
                yield _rows_out([(id_, len(t), 0, b" ".join(t).decode(), []) for id_, t in zip(part.column("id").to_pylist(), tokens, strict=True)])

    return words.releasing(whole)


def _nothing(rows: DataFrame, *numbers: str) -> DataFrame:
    """Zeros where a text's row has no numbers, so that Arrow columns hold no nulls."""
    return rows.withColumns({c: F.coalesce(c, F.lit(0).cast(rows.schema[c].dataType)) for c in numbers})


def index_runs(rows: DataFrame, n_bytes: int, window: int, gram: int, bucket_bytes: int) -> DataFrame:
    """Runs of windows of (id, same, text) that start earlier, with their earlier places."""
    n_buckets = max(8, -(-n_bytes // bucket_bytes))
    n_salts = max(1, round((n_bytes / SLICE_BYTES) ** 0.5))
    hot = rows.sparkSession.sparkContext.broadcast(hot_anchors(rows, n_bytes, window, gram))
    post = _post(window, gram, n_buckets, n_salts, hot)
    settled = stage(
        rows.mapInArrow(post, "bucket int, salt int, post binary")
        .repartition("bucket", "salt")
        .sortWithinPartitions("bucket", "salt")
        .mapInArrow(words.releasing(_settle), f"{RUNS}, bucket int, post binary"),
        "settled",
    )
    left = settled.filter("post IS NOT NULL").select("bucket", F.lit(0).alias("salt"), "post")
    late = left.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(words.releasing(_settle), f"{RUNS}, bucket int, post binary")
    return settled.filter("post IS NULL").unionByName(late).select(*RUN.names)


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    gram: int = 8,
    bucket_bytes: int = 2 << 20,
) -> DataFrame:
    """Return one row per input row: id, n_words, n_removed, kept_text, factors.

    Words are runs of anything but ASCII white space.  A word is removed if a window
    of ``window`` words that covers it also starts earlier: in a document with a
    smaller id or earlier in the same one.  ``factors`` lists the duplicate spans in
    words with the place they copy.  Null and empty texts have no words.  Every row
    with a null id is a document of its own, before all that have one.  Rows that
    repeat an id and its text are one document, and each keeps its row; rows that
    repeat an id with another text are documents of their own, in the order of their
    texts' hashes.  Of several earlier places a factor copies the earliest of its first
    window.  A text of any length is parsed whole, by one task, which holds it and its
    factors; its runs arrive sorted behind it, each with at most a block of words.  Other columns of ``docs`` are not read,
    whatever their names.  An empty table gives no rows.
    ``bucket_bytes`` is the input that one bucket of the index stands for.
    """
    rows, id_of = keyed(docs, id_col)
    rows = rows.select(F.col(KEY).alias("id"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text"))
    found = index_runs(rows, input_bytes(docs, text_col), window, gram, bucket_bytes)
    found = found.groupBy("doc", "same").agg(F.collect_list(F.struct(*RUN.names[2:])).alias("runs"))
    asks = stage(found.mapInArrow(_asks(window), f"{RUNS}, want int"), "asks")
    repeats = stage(rows.groupBy("id", "same").count().filter("count > 1"), "repeats")

    ref = ["ref_doc", "ref_same"]
    sources = stage(asks.groupBy(*ref).count(), "sources")
    heavy = heavy_keys(sources, ref)
    texts = rows.select(F.col("id").alias("ref_doc"), F.col("same").alias("ref_same"), "text")
    wanted = maybe_in(sources.select("ref_doc").distinct(), "ref_doc")
    texts = texts if wanted is None else texts.filter(wanted)
    texts = for_each_salt(texts if repeats.isEmpty() else texts.dropDuplicates(ref), heavy, ref)
    texts = texts.withColumn("ref_start", F.lit(-1))
    asked = texts.unionByName(salted(asks, heavy, ref, ["doc", "same", "start"]), allowMissingColumns=True)
    asked = _nothing(asked, "doc", "same", "start", "n", "want")
    order = [*ref, "salt"]
    pieces = asked.repartition(*order).sortWithinPartitions(*order, "ref_start").mapInArrow(words.releasing(_answer), f"{RUNS}, piece binary")

    copying = sent_filter(stage(asks.select(F.col("doc").alias("id")).distinct(), "copying"), "id")
    some = rows if copying is None else rows.filter(hit_by(copying, "id"))
    heavy = heavy_keys(repeats, ["id", "same"])
    some = salted(some.withColumn("row", F.monotonically_increasing_id()), heavy, ["id", "same"], ["row"])
    some = some.drop("row").withColumn("start", F.lit(-1))
    pieces = for_each_salt(pieces.withColumnRenamed("doc", "id"), heavy, ["id", "same"])
    some = _nothing(some.unionByName(pieces, allowMissingColumns=True), "n", "ref_doc", "ref_start")
    order = ["id", "same", "salt"]
    out = (
        some.repartition(*order)
        .sortWithinPartitions(*order, "start", "n", "ref_doc", "ref_same", "ref_start")
        .select(*order, "start", "n", "ref_doc", "ref_start", "piece", "text")
        .mapInArrow(_apply(window), _OUT)
    )
    if copying is not None:  # the other texts stay where they are
        out = out.unionByName(rows.select("id", "text", *hashes("id")).mapInArrow(_whole(copying), _OUT))
    factors = F.transform("factors", lambda f: f.withField("ref_doc", id_of(f["ref_doc"])))
    return out.select(id_of(F.col("id")).alias(id_col), "n_words", "n_removed", "kept_text", factors.alias("factors"))
