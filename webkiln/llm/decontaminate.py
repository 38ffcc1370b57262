"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet in shared-token seeds: running Karp-Rabin hashes
of ``min_match`` words.  A document that shares seeds with an item comes with its own
places of the item's hashes, one list as long as these places are; the pairs of places
are made by the tiling alone.  The longest match that is still unmarked in both is
marked, again and again, until no match of ``min_match`` words is left.  Tiles may
come in any order, so a passage whose sentences were moved around is covered like an
intact one.  A document is contaminated if the tiles cover enough of the item.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webkiln.llm import words
from webkiln.llm.staging import KEY, drop_rows, keyed, stage


#: Parts that a shuffled seed join deals every gram to.
SALTS = 64


def _rows(keyed_: DataFrame, text_col: str) -> DataFrame:
    """(id, same, text): rows may repeat an id, so that a hash of the text tells their words apart."""
    return keyed_.select(F.col(KEY).alias("id"), F.xxhash64(text_col).alias("same"), F.col(text_col).alias("text"))


def _without_place(gram: Column) -> Column:
    return F.struct(gram["k"].alias("k"), gram["h"].alias("h"))


def _item_grams(min_match: int):
    """(item, same, k, h, j): an item of fewer than min_match words is one gram of its own length."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["item", "same", "k", "h", "j"]
        for batch in words.slices(batches, "text"):
            hashed = words.hash_words(batch.column("text"), "alnum")
            ids, sames = (batch.column(c).to_pylist() for c in ("id", "same"))
            for item, same, a, b in zip(ids, sames, hashed.first[:-1], hashed.first[1:], strict=True):
                n = int(b - a)
                k = min(n, min_match)
                if n:
                    h = words.ngrams(hashed.hashes[a:b], k).view(np.int64)
                    columns = [np.full(len(h), x, np.int64) for x in (item, same, k)] + [h, np.arange(len(h))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return grams


def _doc_grams(sizes: list[int], wanted):
    """(id, text, i, h) of every rolling gram; only of wanted ones where their hashes are at hand."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            ids, sames = (batch.column(c).to_numpy() for c in ("id", "same"))
            hashed = words.hash_words(batch.column("text"), "alnum")
            text = hashed.text_of
            for k in sizes:
                h = words.ngrams(hashed.hashes, k).view(np.int64)
                if not len(h):
                    continue
                good = text[: len(h)] == text[k - 1 :]
                if wanted is not None:
                    near = np.minimum(np.searchsorted(wanted.value, h), len(wanted.value) - 1)
                    good &= wanted.value[near] == h
                at = np.flatnonzero(good)
                columns = [ids[text[at]], sames[text[at]], (at - hashed.first[text[at]]).astype(np.int32), h[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "text", "i", "h"])

    return grams


#: Pairs of places up to which ``tile`` lists them; beyond that it sweeps the item word by word.
MOST_PAIRS = 1 << 20


def _matches(at: np.ndarray, grams: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (document word, item word) of equal grams."""
    order = np.argsort(item, kind="stable")
    low, high = (np.searchsorted(item[order], grams, side=side) for side in ("left", "right"))
    n = high - low
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(at, n), order[np.repeat(low, n) + step]


def _longest(at: np.ndarray, grams: np.ndarray, item: np.ndarray, free: np.ndarray, open_: np.ndarray) -> tuple[int, int, int]:
    """(grams in a row, document word, item word) of the longest match of free grams, the earliest of equal ones.

    One sweep over the item's grams; a step holds the matches that end at its word.
    """
    best = (0, 0, 0)
    run = np.zeros(len(at) + 1, np.int64)
    follows = np.r_[False, np.diff(at) == 1]
    for j in range(len(item)):
        hit = (grams == item[j]) & free if open_[j] else np.zeros(len(at), bool)
        run[1:] = np.where(hit, np.where(follows, run[:-1], 0) + 1, 0)
        if len(at):
            k = int(run[1:].argmax())
            n = int(run[k + 1])
            best = max(best, (n, -(int(at[k]) - n + 1), -(j - n + 1)))
    return best[0], -best[1], -best[2]


def _sweep(at: np.ndarray, grams: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``tile`` with memory for one list of places, however many pairs they make."""
    free, open_, tiles = np.ones(len(at), bool), np.ones(len(item), bool), []
    while True:
        n, a, b = _longest(at, grams, item, free, open_)
        if not n:
            return sorted(tiles)
        n += k - 1
        tiles.append((a, b, n))
        free &= (at + k <= a) | (at >= a + n)
        open_[max(0, b - k + 1) : b + n] = False


def tile(at: np.ndarray, grams: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (document word, item word, length).

    ``at`` are the document words (ascending) where a gram of k words of the item
    stands, ``grams`` its hash there, ``item`` the hashes of all of the item's grams in
    order.  Of equally long matches the one earliest in the document, then in the item,
    comes first.
    """
    numbers, counts = np.unique(item, return_counts=True)
    near = np.minimum(np.searchsorted(numbers, grams), len(numbers) - 1)
    if counts[near].sum() > MOST_PAIRS:
        return _sweep(at, grams, item, k)
    i, j = _matches(at, grams, item)
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    head = np.flatnonzero(np.r_[True, (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)][: len(i)])
    size = np.diff(head, append=len(i)) + k - 1
    heap = [(-int(n), int(a), int(b)) for n, a, b in zip(size, i[head], j[head], strict=True)]
    heapq.heapify(heap)
    doc_marked, item_marked, tiles = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [x for x in range(-n) if a + x not in doc_marked and b + x not in item_marked]
        if len(free) == -n:
            tiles.append((a, b, -n))
            doc_marked.update(range(a, a - n))
            item_marked.update(range(b, b - n))
            continue
        start = 0
        for x in range(1, len(free) + 1):
            if x == len(free) or free[x] != free[x - 1] + 1:
                if x - start >= k:
                    heapq.heappush(heap, (start - x, a + free[start], b + free[start]))
                start = x
    return sorted(tiles)


def _tile_pairs(min_match: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "item", "coverage", "n_tiles", "longest", "first_word"]
        for batch in batches:
            rows = []
            for row in zip(*(batch.column(c) for c in ("id", "item", "seeds", "grams")), strict=True):
                seeds, grams = row[2].values, row[3].values
                at, h = (seeds.field(c).to_numpy() for c in ("i", "h"))
                k, item = grams.field("k")[0].as_py(), grams.field("h").to_numpy()
                n = len(item) + k - 1
                tiles = tile(at.astype(np.int64), h, item, k)
                covered = sum(n for _, _, n in tiles)
                rows.append((row[0].as_py(), row[1].as_py(), covered / n, len(tiles), max(x[2] for x in tiles), tiles[0][0]))
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return words.releasing(pairs)


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 5,
    min_coverage: float = 0.5,
    most_wanted: int = 4_000_000,
) -> DataFrame:
    """Return contaminated (document, item) pairs: ids, coverage, n_tiles, longest, first_word.

    Words are what remains after A-Z are lower-cased and text is cut at ASCII
    characters that are no letters or digits.  Items of fewer than ``min_match``
    words match as a whole; null and empty texts match nothing.  Null ids are
    allowed on both sides and come back as null; every row with one is a document or
    item of its own.  Rows that repeat another id and its text count as one document or
    item; rows that repeat an id with another text are tiled each by itself, and the
    pair takes the best coverage.  Texts of any length are read whole; a task holds a
    document's places of one item's words, not their pairs.  Of equally long matches the
    earliest are marked first.  Other columns, whatever their names, are not read.
    Empty tables give no rows.

    Up to ``most_wanted`` distinct benchmark grams (8 bytes each) are sent to the
    executors to drop other grams before the seed join, and their table is broadcast;
    beyond that all grams of the documents take part in a shuffled join, dealt to
    ``SALTS`` parts so that no frequent gram meets in one task.
    """
    spark = docs.sparkSession
    docs, id_of = keyed(docs, id_col)
    benchmark, item_of = keyed(benchmark, item_col)
    grams = stage(
        _rows(benchmark, item_text_col).mapInArrow(
            words.releasing(_item_grams(min_match)), "item long, same long, k long, h long, j long"
        ),
        "item-grams",
    ).distinct()
    items = stage(
        grams.groupBy("item", "same").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "k", "h"))), _without_place).alias("grams")), "items"
    )
    places = stage(grams.select("item", "same", "h", "k").distinct(), "item-places")
    sizes = [r[0] for r in places.select("k").distinct().collect()]
    hashes = places.select("h").distinct()
    few = places.count() <= most_wanted
    wanted = None
    if few and sizes:
        wanted = spark.sparkContext.broadcast(np.sort(hashes.toArrow().column("h").to_numpy()))
    found = _rows(docs, text_col).mapInArrow(words.releasing(_doc_grams(sizes, wanted)), "id long, text long, i int, h long")
    places = places.withColumnRenamed("same", "item_text")
    if few:
        seeds = found.join(F.broadcast(places), "h")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        found = found.withColumn("salt", F.pmod(F.xxhash64("id", "text"), F.lit(SALTS)).cast("int"))
        seeds = found.join(places.withColumn("salt", salts), ["h", "salt"])
    pair = ["id", "text", "item", "item_text"]
    seeds = seeds.groupBy(*pair).agg(F.sort_array(F.collect_set(F.struct("i", "h"))).alias("seeds"), F.max("k").alias("k"))
    items = items.withColumnRenamed("same", "item_text")
    seeds = seeds.join(F.broadcast(items) if few else items, ["item", "item_text"])
    # a pair whose seeds cannot cover enough words is not tiled
    n = F.size("grams") + F.col("k") - 1
    seeds = seeds.filter(F.least(n, F.size("seeds") * F.col("k")) >= F.ceil(n * min_coverage))
    tiled = seeds.select("id", "item", "seeds", "grams").mapInArrow(
        _tile_pairs(min_match), "id long, item long, coverage double, n_tiles int, longest int, first_word int"
    )
    best = F.max(F.struct("coverage", "n_tiles", "longest", "first_word")).alias("best")
    tiled = tiled.filter(F.col("coverage") >= min_coverage).groupBy("id", "item").agg(best)
    return tiled.select(id_of(F.col("id")).alias(id_col), item_of(F.col("item")).alias(item_col), "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, columns unchanged."""
    rows, _ = keyed(docs, id_col)
    rows = rows.withColumnRenamed(KEY, "__row")
    return drop_rows(rows, overlaps(rows, benchmark, id_col="__row", **options), "__row").select(*docs.columns)
