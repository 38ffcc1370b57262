"""Packing: bounded-space online best fit of token pieces into fixed windows.

Every partition keeps ``open_windows`` open.  A document's full windows are emitted
at once; what remains is placed in the open window that it fits best.  If it fits
none, the fullest window is filled up with a cut of the piece and emitted, and the
rest goes on.  At the end of a partition its windows are drained the same way until
one partial window is left; the partial windows of ``merge_fan`` partitions then
meet in rounds until one remains, which is cut at powers of two so that it needs no
padding.  Only partial windows (less than ``size`` tokens a partition) are shuffled.
"""

from __future__ import annotations

import bisect
import itertools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webkiln.llm import words
from webkiln.llm.staging import stage

PIECES = (
    "id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, left_of long"
)
_COLUMNS = ("id", "start", "ids", "doc_tokens", "sequence_id", "offset", "left_of")
_ARROW = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

#: Units that a worker's cache holds at most, and their bytes; it is emptied beyond either.
_MOST_CACHED, _MOST_CACHED_BYTES = 400_000, 8 << 20
_open: dict = {}


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizers file; the ids are those that the tokenizers library gives."""

    path: str

    def load(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)


#: Bytes after which a space or a line feed may start a unit: printable ASCII, and
#: ends of longer characters unless ``_safe_ends`` takes them for white space.
_SAFE = np.zeros(256, bool)
_SAFE[0x21:0x7F] = True
_SAFE[0x80:] = True
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[ord(c) for c in ",.;:!?"]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_STARTS = np.zeros(256, bool)
_STARTS[[0x20, 0x0A]] = True


def _safe_ends(data: np.ndarray) -> np.ndarray:
    """Whether the character that ends at each byte is surely no white space.

    White space beyond ASCII ends in 85 or A0 after C2, or in one of a few bytes
    after 80, 81 or 9A; anything of that look counts as unsafe, which only makes a
    unit longer.
    """
    safe = _SAFE[data]
    before = np.r_[np.uint8(0), data[:-1]] if len(data) else data
    wide = (data >= 0x80) & ((before == 0xC2) | (before == 0x80) | (before == 0x81) | (before == 0x9A))
    return safe & ~wide


def units_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of units in texts that stand end to end, closed by len(data).

    A unit starts where a text starts, where a space or line feed follows a safe end
    and where a mark follows an ASCII letter; no token crosses such a place.
    """
    start = np.zeros(len(data) + 1, bool)
    if len(data):
        start[1:-1] = (_STARTS[data[1:]] & _safe_ends(data)[:-1]) | (_MARK[data[1:]] & _LETTER[data[:-1]])
    start[offsets] = True
    return np.flatnonzero(start)


def _joined(tokenizer, data: np.ndarray, start: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``start`` without the places that lie inside a special token's text, which is one id.

    An end of such a text would cut nothing; only its inside may not be cut.
    """
    raw = None
    for token in tokenizer.get_added_tokens_decoder().values():
        name = token.content.encode()
        if not _cut_inside(name):
            continue
        raw = data.tobytes() if raw is None else raw
        at = raw.find(name)
        while at >= 0:
            start = start[(start <= at) | (start >= at + len(name)) | np.isin(start, offsets)]
            at = raw.find(name, at + 1)
    return start


def _cut_inside(name: bytes) -> bool:
    """Whether ``units_of`` may begin a unit inside this text."""
    data = np.frombuffer(name, np.uint8)
    return len(units_of(data, np.array([0, len(data)]))) > 2


class UnitCache:
    """Ids of units by hash, as sorted arrays, and the units' bytes; one per worker and vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokenizer = vocabulary.load()
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int64)
        self.key, self.at, self.n, self.text_at, self.text_n = np.zeros(0, np.uint64), none, none, none, none
        self.ids, self.text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def find(self, key: np.ndarray) -> np.ndarray:
        """Index of each key in the cache, -1 where it is new."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)

    def learn(self, key: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encode units with new keys."""
        units = [data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        ids = self.ids_of([u.decode() for u in units])
        n, text_n = np.array([len(x) for x in ids], np.int64), end - begin
        at = len(self.ids) + np.cumsum(n) - n
        text_at = len(self.text) + np.cumsum(text_n) - text_n
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, n.sum())])
        self.text = np.concatenate([self.text, np.frombuffer(b"".join(units), np.uint8)])
        order = np.argsort(np.r_[self.key, key], kind="stable")
        self.key, self.at, self.n, self.text_at, self.text_n = (
            np.r_[old, new][order]
            for old, new in ((self.key, key), (self.at, at), (self.n, n), (self.text_at, text_at), (self.text_n, text_n))
        )

    def same(self, at: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bool:
        """Whether the units, which cover ``data`` without gaps, are byte for byte those of the cache."""
        return bool((self.text_n[at] == end - begin).all()) and bool((_gather(self.text, self.text_at[at], end - begin) == data).all())


def _gather(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[at:at + n] of every pair, end to end."""
    stop = np.cumsum(n)
    return values[np.repeat(at - (stop - n), n) + np.arange(stop[-1] if len(n) else 0)]


def encode(texts: pa.Array, vocabulary: Vocabulary, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, each closed by ``end_id``, and len + 1 offsets."""
    if vocabulary not in _open:
        _open[vocabulary] = UnitCache(vocabulary)
    cache = _open[vocabulary]
    data, offsets = words.text_bytes(texts)
    start = _joined(cache.tokenizer, data, units_of(data, offsets), offsets)
    begin, end = start[:-1], start[1:]
    key = words.hash_spans(data, begin, end)
    if len(cache.key) > _MOST_CACHED or len(cache.text) > _MOST_CACHED_BYTES:
        cache.clear()
    at = cache.find(key)
    new, first = np.unique(key[at < 0], return_index=True)
    if len(new):
        first = np.flatnonzero(at < 0)[first]
        cache.learn(new, data, begin[first], end[first])
        at = cache.find(key)
    if cache.same(at, data, begin, end):
        n = cache.n[at]
        per_text = np.diff(np.r_[0, np.cumsum(n)][np.searchsorted(begin, offsets)])
        ids = _gather(cache.ids, cache.at[at], n)
    else:  # two units share a hash: all texts of the slice are encoded anew, without the cache
        raw = data.tobytes()
        found = cache.ids_of([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        per_text = np.array([len(x) for x in found], np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, per_text.sum())
        cache.clear()
    ends = np.r_[0, np.cumsum(per_text + 1)]
    out = np.full(ends[-1], end_id, np.uint32)
    body = np.ones(len(out), bool)
    body[ends[1:] - 1] = False
    out[body] = ids
    return out.astype("<u4"), ends


class Packer:
    """The open windows of one partition; ``emit`` receives finished windows."""

    def __init__(self, size: int, open_windows: int, first_sequence: int):
        self.size, self.most, self.next = size, open_windows, first_sequence
        self.room: list[tuple[int, int]] = []  # (free tokens, window), sorted
        self.windows: dict[int, list] = {}
        self.serial = 0
        self.done: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, ids, total, self.next, at, None))
            at += len(ids) // 4
        self.next += 1

    def add(self, doc: int, start: int, ids: bytes, total: int) -> None:
        full = 4 * self.size
        while len(ids) >= full:
            self.emit([(doc, start, ids[:full], total)])
            start, ids = start + self.size, ids[full:]
        if ids:
            self.place(doc, start, ids, total)

    def place(self, doc: int, start: int, ids: bytes, total: int) -> None:
        while ids:
            n = len(ids) // 4
            at = bisect.bisect_left(self.room, (n, -1))
            if at < len(self.room):
                free, window = self.room.pop(at)
            elif len(self.room) < self.most:
                free, window = self.size, self.serial
                self.serial += 1
                self.windows[window] = []
            else:
                free, window = self.room.pop(0)
            cut = min(n, free)
            self.windows[window].append((doc, start, ids[: 4 * cut], total))
            start, ids = start + cut, ids[4 * cut :]
            if cut == free:
                self.emit(self.windows.pop(window))
            else:
                bisect.insort(self.room, (free - cut, window))

    def drain(self) -> list:
        """Fill the fullest windows with the emptiest ones' pieces until one is left."""
        order = [self.windows[w] for _, w in self.room]
        self.room, self.windows = [], {}
        held, n = [], 0
        for piece in (p for window in order for p in window):
            doc, start, ids, total = piece
            while ids:
                cut = min(len(ids) // 4, self.size - n)
                held.append((doc, start, ids[: 4 * cut], total))
                start, ids, n = start + cut, ids[4 * cut :], n + cut
                if n == self.size:
                    self.emit(held)
                    held, n = [], 0
        return held

    def emit_rest(self, pieces: list) -> None:
        """Sequences of power-of-two length from what is left at the very end."""
        n = sum(len(p[2]) // 4 for p in pieces)
        room, held = 1 << (n.bit_length() - 1) if n else 0, []
        for doc, start, ids, total in pieces:
            while ids:
                cut = min(len(ids) // 4, room)
                held.append((doc, start, ids[: 4 * cut], total))
                start, ids, room, n = start + cut, ids[4 * cut :], room - cut, n - cut
                if not room:
                    self.emit(held)
                    held, room = [], 1 << (n.bit_length() - 1) if n else 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)], list(_COLUMNS))


def _pack(vocabulary: Vocabulary, end_id: int, size: int, open_windows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, partition = None, 0
        for batch in words.slices(batches, "text"):
            if packer is None:
                partition = batch.column("part")[0].as_py()
                packer = Packer(size, open_windows, partition << 40)
            ids, ends = encode(batch.column("text"), vocabulary, end_id)
            raw, ends = ids.tobytes(), (ends * 4).tolist()
            for doc, a, b in zip(batch.column("id").to_pylist(), ends[:-1], ends[1:], strict=True):
                packer.add(doc, 0, raw[a:b], (b - a) // 4)
            if packer.done:
                yield _batch(packer.done)
                packer.done = []
        if packer is not None:
            left = packer.drain()
            yield _batch(packer.done + [(*p, packer.next, None, partition) for p in left])
        if vocabulary in _open:
            _open[vocabulary].clear()

    return words.releasing(pack)


def _merge(size: int, last: bool):
    def merge(group: pa.Table) -> pa.Table:
        order = group.sort_by([("left_of", "ascending"), ("at", "ascending")])
        rows = list(zip(*(order.column(c).to_pylist() for c in ("id", "start", "ids", "doc_tokens")), strict=True))
        first = order.column("sequence_id").to_pylist()[0]
        packer = Packer(size, 1, first)
        packer.windows, packer.room = {0: rows}, [(0, 0)]
        left = packer.drain()
        if last:
            packer.emit_rest(left)
            left = []
        out = packer.done + [(*p, packer.next, None, order.column("left_of").to_pylist()[0]) for p in left]
        return pa.Table.from_batches([_batch(out)])

    return merge


def pack_documents(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    size: int = 2048,
    open_windows: int = 64,
    merge_fan: int = 64,
) -> DataFrame:
    """Return one row per piece: id, start, ids (uint32 little-endian), doc_tokens, sequence_id, offset.

    A document is its token ids and ``end_id``; each id lies in exactly one piece.
    A null or empty text is the end id alone.  A null id stays null; repeated rows
    are documents of their own.  A text of any length is encoded whole and cut into
    as many windows as it needs, so a task holds one text and its ids at a time.  Ties
    between open windows of equal room go to the older one.  Other columns of ``docs``
    are not read, whatever their names.  Every sequence but the last few holds ``size``
    ids; those have power-of-two lengths.  An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().cast("long").alias("part")
    )
    pieces = stage(rows.mapInArrow(_pack(vocabulary, end_id, size, open_windows), PIECES), "pieces")
    out = pieces.filter("left_of IS NULL")
    left = pieces.filter("left_of IS NOT NULL")
    n_left, span = (left.agg(F.max("left_of")).first()[0] or 0) + 1, 1
    while True:
        span *= merge_fan
        last = span >= n_left
        tagged = left.withColumn("at", F.monotonically_increasing_id())
        merged = tagged.groupBy(F.floor(F.col("left_of") / span).alias("group")).applyInArrow(_merge(size, last), PIECES)
        if last:
            out = out.unionByName(merged)
            break
        left = stage(merged, "left")
        out = out.unionByName(left.filter("left_of IS NULL"))
        left = left.filter("left_of IS NOT NULL")
    return out.select(F.col("id").alias(id_col), "start", "ids", "doc_tokens", "sequence_id", "offset")
