"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white-space markers and the characters up to the next one.  Where
no piece of a model holds a marker after another character, no merge crosses the start
of a chunk, so a text's ids are those of its chunks in order.  Chunks are counted over the
whole corpus; each distinct one is segmented once by the library, and its ids are
joined back to the places where it stands:

* the most frequent chunks, as many as ``most_bytes`` hold, are broadcast;
* where all repeated chunks are among them, what is not found occurs once in the corpus
  and is segmented where it stands;
* else the places of all other chunks are joined with the table by a shuffle.  Texts
  then travel as ranks of frequent chunks (one to three bytes each) with holes, and the
  missing ids are sorted behind them by position.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webkiln.llm import words
from webkiln.llm.staging import KEY, join_hot, keyed, stage

MARKER = "▁"


@dataclass(frozen=True)
class PieceModel:
    """A sentencepiece model file; every machine has it at this path."""

    path: str

    def load(self):
        return _load(self.path)

    def check(self) -> None:
        """Raise where chunks of this model would not be independent of each other."""
        model = self.load()
        crossing = [p for p in map(model.id_to_piece, range(model.get_piece_size())) if MARKER in p.lstrip(MARKER)]
        probe = " ａ  ﬁ\t "
        if crossing or model.normalize(probe) != MARKER + probe.replace(" ", MARKER):
            raise ValueError(f"{self.path}: pieces cross markers ({crossing[:3]}) or texts are normalised beyond a leading marker")


@functools.lru_cache(maxsize=2)
def _load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _marked(text: str):
    """A text as its chunks stand end to end: spaces for markers, one in front; an empty text has no chunk."""
    text = F.coalesce(F.col(text), F.lit(""))
    return F.when(text == "", text).otherwise(F.concat(F.lit(" "), F.replace(text, F.lit(MARKER), F.lit(" "))))


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all marked texts, begin and end of every chunk, and len + 1 chunk numbers at which the texts start."""
    data, offsets = words.text_bytes(texts)
    space = data == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.flatnonzero(start)
    return data, begin, np.r_[begin[1:], len(data)][: len(begin)], np.searchsorted(begin, offsets)


def gather(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """values[at:at + n] of every pair, end to end."""
    stop = np.cumsum(n)
    return values[np.repeat(at - (stop - n), n) + np.arange(stop[-1] if len(n) else 0)]


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    n = end - begin
    ends = np.r_[0, np.cumsum(n)].astype(np.int64)
    raw = gather(data, begin, n)
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(ends), pa.py_buffer(raw))


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))


def segmented(library, chunks: list[str]) -> list[list[int]]:
    """The library's ids of each chunk; the space that a chunk starts with is the marker that it puts in front.

    It puts none in front of nothing, so a chunk that is a lone marker is read off the end of another text.
    """
    found = library.encode([c[1:] for c in chunks], num_threads=1) if chunks else []
    lone = library.encode(". ")[len(library.encode(".")) :]
    return [ids if len(c) > 1 else lone for c, ids in zip(chunks, found, strict=True)]


def count_chunks(docs: DataFrame, text_col: str) -> DataFrame:
    """(chunk, n) of every distinct chunk of the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", 4 << 20):
            data, begin, end, _ = chunks_of(batch.column("text"))
            key = words.hash_spans(data, begin, end)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            n = np.diff(np.r_[first, len(key)])
            found = order[first]
            same = np.repeat(found, n)  # two chunks that share a hash are told apart by their bytes
            if not _equal(data, begin[order], end[order], data, begin[same], end[same]).all():
                texts = pa.table([_strings(data, begin, end)], ["chunk"]).group_by("chunk").aggregate([([], "count_all")])
                yield from texts.select(["chunk", "count_all"]).rename_columns(["chunk", "n"]).cast(_COUNTED).to_batches()
                continue
            order = np.argsort(found)
            found = found[order]
            rows = [_strings(data, begin[found], end[found]).cast(pa.string()), pa.array(n[order], pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, ["chunk", "n"])

    texts = docs.select(_marked(text_col).alias("text"))
    return texts.mapInArrow(words.releasing(count), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


_COUNTED = pa.schema([("chunk", pa.string()), ("n", pa.int64())])


def _equal(a: np.ndarray, a_begin, a_end, b: np.ndarray, b_begin, b_end) -> np.ndarray:
    """Whether every span of ``a`` has the bytes of its partner in ``b``."""
    n = a_end - a_begin
    same = n == b_end - b_begin
    rows = np.flatnonzero(same & (n > 0))
    equal = gather(a, a_begin[rows], n[rows]) == gather(b, b_begin[rows], n[rows])
    if len(rows) and not equal.all():
        same[rows] = np.logical_and.reduceat(equal, np.r_[0, np.cumsum(n[rows])[:-1]])
    return same


def segment(chunks: DataFrame, model: PieceModel) -> DataFrame:
    """``chunks`` with their ``ids`` (binary, little-endian unsigned 16 bits, or 32 for large vocabularies)."""
    width = "<u2" if model.load().get_piece_size() <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = model.load()
        for batch in batches:
            ids = [np.array(x, width).tobytes() for x in segmented(library, batch.column("chunk").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("n"), pa.array(ids, pa.binary())], ["chunk", "n", "ids"])

    return chunks.mapInArrow(words.releasing(run), "chunk string, n long, ids binary")


def _id_lists(column: pa.ChunkedArray, width: str) -> tuple[np.ndarray, np.ndarray]:
    """Edges and ids of a column of packed ids."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, width)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (at - at[0]) // int(width[-1]), np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(width)


class Head:
    """Frequent chunks with their ids as sorted arrays; a chunk's number is its rank by frequency, in which ``frequent`` is sorted."""

    def __init__(self, frequent: DataFrame, width: str):
        rows = frequent.toArrow()
        self.text, at = words.text_bytes(rows.column("chunk"))
        edges, self.ids = _id_lists(rows.column("ids"), width)
        del rows  # the driver holds the received table and one copy, then the copy alone
        words.release()
        self.text_at, self.text_n = at[:-1].astype(np.uint32), np.diff(at).astype(np.uint32)
        sizes = np.diff(edges)
        self.ids_at, self.ids_n = (np.cumsum(sizes) - sizes).astype(np.uint32), sizes.astype(np.uint16 if sizes.max(initial=0) < 1 << 16 else np.uint32)
        key = np.zeros(len(sizes), np.uint64)
        for a in range(0, len(key), 1 << 18):
            own = at[a : a + (1 << 18) + 1]
            key[a : a + (1 << 18)] = words.hash_spans(self.text[own[0] : own[-1]], own[:-1] - own[0], own[1:] - own[0])
        self.rank = np.argsort(key, kind="stable").astype(np.uint32)
        self.key = key[self.rank]

    def find(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The rank of every chunk, -1 for those that are not here; bytes are compared."""
        if not len(self.key):
            return np.full(len(begin), -1)
        key, place = np.unique(words.hash_spans(data, begin, end), return_inverse=True)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        rank = np.where(self.key[at] == key, self.rank[at].astype(np.int64), -1)[place]
        known = np.flatnonzero(rank >= 0)
        text_at = self.text_at[rank[known]].astype(np.int64)
        same = _equal(data, begin[known], end[known], self.text, text_at, text_at + self.text_n[rank[known]])
        rank[known[~same]] = -1
        return rank


def _varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian groups of seven bits, the last with a clear high bit; bytes and each value's length."""
    n = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(n) - n
    out = np.zeros(n.sum(), np.uint8)
    for k in range(5):
        has = np.flatnonzero(n > k)
        out[at[has] + k] = ((values[has] >> 7 * k) & 127) | np.where(n[has] > k + 1, 128, 0)
    return out, n


def _values(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    first = np.r_[0, last[:-1] + 1][: len(last)]
    place = np.arange(len(data)) - np.repeat(first, last - first + 1)
    parts = (data & 127).astype(np.int64) << 7 * place
    return np.add.reduceat(parts, first) if len(first) else parts


def _laid_out(head: Head, rank: np.ndarray, own_ids: np.ndarray, own_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks end to end and how many each has; those without a rank take ``own_ids`` in order."""
    known = rank >= 0
    n = np.empty(len(rank), np.int64)
    n[known], n[~known] = head.ids_n[rank[known]], own_n
    where = np.repeat(known, n)
    out = np.empty(len(where), np.int32)
    out[where] = gather(head.ids, head.ids_at[rank[known]].astype(np.int64), n[known])
    out[~where] = own_ids
    return out, n


def _in_place(library, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = data.tobytes() if len(begin) > 64 else None
    ids = segmented(library, [(raw[a:b] if raw else data[a:b].tobytes()).decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
    return np.fromiter((x for i in ids for x in i), np.int32), np.array([len(i) for i in ids], np.int64)


def _with_ends(ids: np.ndarray, per_text: np.ndarray, end_id: int) -> pa.Array:
    edges = np.r_[0, np.cumsum(per_text + 1)]
    out = np.full(edges[-1], end_id, np.int32)
    body = np.ones(len(out), bool)
    body[edges[1:] - 1] = False
    out[body] = ids
    return _lists(out, edges)


def head_of(counts: DataFrame, model: PieceModel, most_bytes: int) -> tuple[DataFrame, bool]:
    """The frequent chunks (chunk, n, ids) that fit ``most_bytes``, the most frequent first, and whether every repeated chunk is among them.

    They are all chunks that occur ``2**k`` times or more, for the smallest such k above 0:
    a chunk that occurs once is segmented once wherever that is done, so it need not travel.
    """
    power = (F.length(F.bin("n")) - 1).alias("power")
    sizes = counts.filter("n > 1").groupBy(power).agg(F.sum(2 * F.octet_length("chunk") + 24).alias("bytes")).collect()  # a row per power of two
    least, taken = 62, 0
    for row in sorted(sizes, key=lambda r: -r.power):
        taken += row.bytes
        if taken > most_bytes:
            break
        least = row.power
    complete = all(row.power >= least for row in sizes)
    return segment(counts.filter(F.col("n") >= 1 << least).orderBy(F.desc("n"), "chunk"), model), complete


def encode_documents(
    docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 128 << 20
) -> DataFrame:
    """One row per row of ``docs``: its id and ``ids`` (array<int>), the last being the model's end id.

    The ids are those of the library for the whole text, without sampling.  Null and empty
    texts have the end id alone.  Rows with null ids and repeated rows are encoded each by
    itself.  Texts of any length are encoded whole: a text is cut at its chunks only, and
    one without white space is a single chunk.  Other columns are not read, whatever
    their names.  An empty table gives no rows.  ``most_bytes`` bounds what is broadcast.
    """
    model.check()
    library = model.load()
    end_id, width = library.eos_id(), "<u2" if library.get_piece_size() <= 1 << 16 else "<u4"
    counts = stage(count_chunks(docs, text_col), "chunks")
    frequent, complete = head_of(counts, model, most_bytes)
    head = docs.sparkSession.sparkContext.broadcast(Head(frequent.select("chunk", "ids"), width))
    words.release()
    if not complete:
        return _joined(docs, counts, model, head, id_col, text_col, width)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = head.value, model.load()
        for batch in words.slices(batches, "text"):
            data, begin, end, first = chunks_of(batch.column("text"))
            rank = table.find(data, begin, end)
            new = np.flatnonzero(rank < 0)
            ids, n = _laid_out(table, rank, *_in_place(own, data, begin[new], end[new]))
            per_text = np.diff(np.r_[0, np.cumsum(n)][first])
            yield pa.RecordBatch.from_arrays([batch.column("id"), _with_ends(ids, per_text, end_id)], ["id", "ids"])

    texts = docs.select(F.col(id_col).alias("id"), _marked(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(words.releasing(encode), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def _joined(docs: DataFrame, counts: DataFrame, model: PieceModel, head, id_col: str, text_col: str, width: str) -> DataFrame:
    """Encoding where repeated chunks exceed what may be broadcast: rare chunks are joined by position."""
    end_id = model.load().eos_id()
    table = stage(segment(counts, model), "pieces")
    rows, as_id = keyed(docs, id_col)
    texts = rows.select(F.col(KEY).alias("id"), _marked(text_col).alias("text")).withColumn("row", F.xxhash64("text"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            data, begin, end, first = chunks_of(batch.column("text"))
            new = np.flatnonzero(head.value.find(data, begin, end) < 0)
            text = np.searchsorted(first, new, side="right") - 1
            keys = [batch.column(c).take(pa.array(text)) for c in ("id", "row")]
            at = pa.array((new - first[text]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*keys, at, _strings(data, begin[new], end[new]).cast(pa.string())], ["id", "row", "at", "chunk"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            data, begin, end, first = chunks_of(batch.column("text"))
            code, n = _varints(head.value.find(data, begin, end) + 1)  # 0 is a hole
            edges = np.r_[0, np.cumsum(n)][first].astype(np.int64)
            codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(code)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), codes], ["id", "row", "codes"])

    places = texts.mapInArrow(words.releasing(rare), "id long, row long, at int, chunk string").dropDuplicates(["id", "row", "at"])
    found = join_hot(places, table, ["chunk"], "n", ["id", "at"]).select("id", "row", "at", F.col("ids").alias("bytes"))
    coded_texts = texts.mapInArrow(words.releasing(coded), "id long, row long, codes binary")
    both = found.unionByName(coded_texts.select("id", "row", F.lit(2**31 - 1).alias("at"), F.col("codes").alias("bytes"), F.lit(True).alias("whole")), True)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_row, own = None, []
        for batch in batches:
            ids, lists = [], []
            for id_, row, bytes_, whole in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "bytes", "whole")), strict=True):
                if at_row != (id_, row):
                    at_row, own = (id_, row), []
                if not whole:
                    own.append(np.frombuffer(bytes_, width))
                    continue
                rank = _values(np.frombuffer(bytes_, np.uint8)) - 1
                mine = np.concatenate(own) if own else np.zeros(0, np.int32)
                ids.append(id_)
                lists.append(np.r_[_laid_out(head.value, rank, mine, np.array([len(x) for x in own], np.int64))[0], end_id].astype(np.int32))
            if ids:
                edges = np.r_[0, np.cumsum([len(x) for x in lists])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(np.concatenate(lists), edges)], ["id", "ids"])

    dealt = both.repartition("id", "row").sortWithinPartitions("id", "row", "at")
    out = dealt.mapInArrow(words.releasing(fill), "id long, ids array<int>")
    return out.select(as_id(F.col("id")).alias(id_col), "ids")


class PieceText:
    """The bytes that each id stands for, and which ids need the library."""

    def __init__(self, library):
        n = library.get_piece_size()
        plain = [b"" if library.is_control(i) or library.is_unknown(i) else self._bytes(library, i) for i in range(n)]
        self.n = np.array([len(p) for p in plain], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.data = np.frombuffer(b"".join(plain), np.uint8)
        self.special = np.array([library.is_unknown(i) for i in range(n)], bool)
        self.control = np.array([library.is_control(i) for i in range(n)], bool)

    @staticmethod
    def _bytes(library, i: int) -> bytes:
        piece = library.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if library.is_byte(i) else piece.replace(MARKER, " ").encode()


def decode_documents(encoded: DataFrame, model: PieceModel, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the text that the library's ``decode`` gives for each row's ids.

    Pieces are looked up; rows in which that is not the whole rule (unknown ids, control ids
    before the end, bytes that form no text) are decoded by the library.  Null ids and
    no ids give an empty text.  A column named ``decoded`` is replaced.
    """
    kept = [c for c in encoded.columns if c != "decoded"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = model.load()
        table = PieceText(library)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                lists = part.column(ids_col)
                n = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                edges = np.r_[0, np.cumsum(n)]
                raw = gather(table.data, table.at[ids], table.n[ids]).tobytes()
                cut = np.r_[0, np.cumsum(table.n[ids])][edges].tolist()
                odd = table.special[ids] | table.control[ids]
                odd[(edges[1:] - 1)[n > 0]] &= table.special[ids[(edges[1:] - 1)[n > 0]]]
                bad = np.add.reduceat(np.r_[odd, False], edges[:-1]) * (n > 0) if len(n) else odd
                texts = []
                for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    try:
                        text = None if bad[i] else raw[a + (raw[a : a + 1] == b" ") : b].decode()
                    except UnicodeDecodeError:
                        text = None
                    texts.append(library.decode(ids[edges[i] : edges[i + 1]].tolist()) if text is None else text)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")
    return encoded.select(*kept).mapInArrow(words.releasing(decode), f"{schema}, decoded string")
