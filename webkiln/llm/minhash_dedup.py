"""MinHash near-dedup by a signature-coordinate inverted join.

1. Documents with one shingle set collapse to the smallest identifier.
2. A signature has 31 coordinates; a coordinate's value is a pair of independent
   minima, so that unrelated texts seldom share one.  Every set is posted under each
   of its coordinate-value pairs.  Two sets link only if at least ``min_matches``
   coordinates collide.  A value held by a single document cannot collide, so a set
   with fewer shared values than that links with nothing; otherwise (prefix merging)
   it is enough to meet partners under the set's rarest values, all but
   ``min_matches`` - 1 of them.
3. Partners that meet count the collisions of all their minima and are skipped below
   ``min_minima``.  What a list retains are pairs of a representative and a member, so
   that no more rows come out than went in.  Each retained pair is confirmed on the
   full sets.
4. Pairs, confirmed or not, tie sets to families.  A family whose confirmed pairs
   already join all its members is done.  In the others the members that are still
   apart are compared on full sets, in blocks of about ``block`` sets in order of size;
   blocks of one confirmed component are not compared with each other, nor blocks whose
   sizes cannot fit.  The components of all confirmed links are the result.

Lists and families of any size are split into blocks by counts of their set sizes, so
that no task sorts a group; a task compares two blocks.  A pair of similarity 0.8
collides in 20 coordinates and 50 minima on average; it has fewer than 7 or fewer than
33 with a probability of about 1e-6, more similar pairs less often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from webkiln.llm import words
from webkiln.llm.bloom import maybe_in
from webkiln.llm.components import components
from webkiln.llm.staging import KEY, join_hot, keyed, stage

#: Minima of a signature, two to a coordinate; their low bytes travel with a posting.
N_MINIMA = 62
#: Text that a task hashes at a time; a worker's tables are about fifty times as large.
SLICE_BYTES = 1 << 20
#: Set members that a block holds at most.
MOST_MEMBERS = 1_000_000

_rng = np.random.Generator(np.random.PCG64(97))
_MULTIPLY = _rng.integers(0, 2**63, N_MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, N_MINIMA, dtype=np.uint64)


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts end to end, and each text's offsets."""
    hashed = words.hash_words(texts, "lower")
    grams = words.ngrams(hashed.hashes, shingle)
    counts = np.diff(hashed.first)
    sets, sizes = [], np.zeros(len(counts), np.int64)
    for i, (a, n) in enumerate(zip(hashed.first[:-1].tolist(), counts.tolist(), strict=True)):
        if n >= shingle:
            sets.append(np.unique(grams[a : a + n - shingle + 1]))
        elif n:
            sets.append(words.ngrams(hashed.hashes[a : a + n], n))
        else:
            continue
        sizes[i] = len(sets[-1])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.r_[0, np.cumsum(sizes)]


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(rows).ravel())
    )


def _signatures(shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", SLICE_BYTES):
            flat, offsets = shingle_sets(batch.column("text"), shingle)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            k1, k2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            values = np.zeros((len(sizes), N_MINIMA), np.uint64)
            if len(full):
                at = offsets[:-1][full]
                k1[full] = np.add.reduceat(words.mix(flat), at)
                k2[full] = np.add.reduceat(words.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                for c in range(N_MINIMA):
                    values[full, c] = np.minimum.reduceat((flat * _MULTIPLY[c] + _ADD[c]) >> np.uint64(32), at)
            pairs = (values[:, 0::2] << np.uint64(32)) | values[:, 1::2]
            keys = words.mix(pairs ^ words.mix(np.arange(N_MINIMA // 2, dtype=np.uint64) + np.uint64(1)))
            low = values.astype(np.uint8)
            columns = [batch.column("id"), pa.array(sizes), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))]
            columns += [_lists(keys.view(np.int64)), pa.array([x.tobytes() for x in low], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "k1", "k2", "keys", "minima"])

    return words.releasing(sign)


def prefix_postings(sets: DataFrame, min_matches: int) -> DataFrame:
    """(key, id, n, minima) under each set's rarest shared coordinate-value pairs."""
    posted = sets.select("id", "set", F.explode("keys").alias("key"))
    shared = stage(posted.groupBy("key").agg(F.count("*").alias("freq")).filter("freq > 1"), "shared")
    mine = Window.partitionBy("id", "set")
    ranked = (
        join_hot(posted, shared, ["key"], "freq", ["id", "set"])
        .withColumn("held", F.count("*").over(mine))
        .withColumn("rank", F.row_number().over(mine.orderBy("freq", "key")))
        .filter((F.col("held") >= min_matches) & (F.col("rank") <= F.col("held") - min_matches + 1))
        .select("id", "set", "key")
    )
    return ranked.join(sets.select("id", "set", "n", "minima"), ["id", "set"]).drop("set")


#: A pair of blocks: part and number of each.
PAIR = ["s1", "k1", "s2", "k2"]


def _cells(rows: DataFrame, group: str, block: int) -> DataFrame:
    """(group, part, n, rows, first, times): which blocks the rows of a part of a group go to, by the size of their set.

    A block holds rows of one ``part`` of a group, about ``block`` of them and about MOST_MEMBERS set members, or one
    larger set.  Block numbers come from the counts of each set size, so no task sees a whole group.
    """
    cell = [group, "part", "n"]
    weight = F.col("rows") * F.greatest(F.lit(1.0 / block), F.col("n") / F.lit(float(MOST_MEMBERS)))
    before = Window.partitionBy(group, "part").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*cell).agg(F.count("*").alias("rows"))
    cells = cells.withColumn("weight", weight).withColumn("first", F.floor(F.coalesce(F.sum("weight").over(before), F.lit(0.0)) + 1e-9))
    return stage(cells.select(*cell, "rows", "first", F.ceil(F.col("weight") - 1e-9).alias("times")), "cells")


def _dealt(rows: DataFrame, cells: DataFrame, group: str) -> DataFrame:
    """``rows`` with the number ``k`` of their block."""
    number = F.col("first") + F.when(F.col("times") > 1, F.pmod(F.xxhash64("id"), F.col("times"))).otherwise(0)
    return join_hot(rows, cells, [group, "part", "n"], "rows", ["id"]).withColumn("k", number.cast("int")).drop("rows", "first", "times")


def _alone(rows: DataFrame, cells: DataFrame, group: str) -> DataFrame:
    """Every row once, in a block that meets itself only."""
    rows = _dealt(rows, cells, group)
    return rows.select("*", F.col("part").alias("s1"), F.col("k").alias("k1"), F.col("part").alias("s2"), F.col("k").alias("k2"), F.lit(0).alias("side")).drop("part", "k")


def _blocks(rows: DataFrame, group: str, block: int, percent: int) -> DataFrame:
    """Deal each group's rows (id, part, n, ...) to pairs of blocks whose set sizes can fit.

    Blocks of one part meet only where the part is negative, which stands for rows that are not known to belong together.
    A row comes once for every pair its block is in, with ``side`` 0 for the first.
    """
    rows = _dealt(rows, _cells(rows, group, block), group)
    spans = rows.groupBy(group, "part", "k").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = (
        spans.select(group, F.col("part").alias(f"s{i}"), F.col("k").alias(f"k{i}"), F.col("low").alias(f"low{i}"), F.col("high").alias(f"high{i}"))
        for i in (1, 2)
    )
    meet = "(s1 < s2 OR (s1 = s2 AND s1 < 0 AND k1 <= k2))"
    fit = f"high1 * 100 >= low2 * {percent} AND high2 * 100 >= low1 * {percent}"
    pairs = left.join(right, group).filter(f"{meet} AND {fit}").select(group, *PAIR)
    ends = pairs.select("*", F.col("s1").alias("part"), F.col("k1").alias("k"), F.lit(0).alias("side")).unionByName(
        pairs.filter("s1 <> s2 OR k1 <> k2").select("*", F.col("s2").alias("part"), F.col("k2").alias("k"), F.lit(1).alias("side"))
    )
    return rows.join(ends, [group, "part", "k"]).drop("part", "k")


def _apart(known: DataFrame, group: str, block: int) -> DataFrame:
    """(id, group, part) of the groups whose rows (id, group, joined) have several components.

    A component of at least ``block`` rows of the group is a part, whose blocks need not meet each other; all smaller ones
    share part -1.
    """
    several = known.groupBy(group).agg(F.min("joined").alias("low"), F.max("joined").alias("high"), F.count("*").alias("rows"))
    several = stage(several.filter("low <> high").select(group, "rows"), "several")
    apart = join_hot(known, several, [group], "rows", ["id"]).drop("rows")
    large = stage(apart.groupBy(group, "joined").agg(F.count("*").alias("rows")).filter(F.col("rows") >= block), "large")
    part = F.when(F.col("rows").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("joined"), F.lit(1 << 62)))
    return join_hot(apart, large, [group, "joined"], "rows", ["id"], "left").select("id", group, part.alias("part"))


def _across(postings: DataFrame, lists: DataFrame, near: DataFrame, edges: Callable[[DataFrame], DataFrame], block: int, percent: int) -> DataFrame:
    """``near`` and the edges between components of the same list, for the lists of ``lists``."""
    sizes = stage(postings.groupBy("key").agg(F.count("*").alias("rows")).join(lists.select("key"), "key", "left_semi"), "open-lists")
    rows = stage(join_hot(postings.drop("part"), sizes, ["key"], "rows", ["id"]).drop("rows"), "open-postings")
    joined = components(near).select(F.col("node").alias("id"), F.col("component").alias("joined"))
    known = rows.select("id", "key").distinct().join(joined, "id", "left")
    parts = _apart(stage(known.withColumn("joined", F.coalesce("joined", "id")), "known"), "key", block)
    late = edges(_blocks(rows.join(parts, ["id", "key"]), "key", block, percent))
    return near.unionByName(late.select("a", "b")).distinct()


def candidates(postings: DataFrame, block: int, percent: int, min_minima: int) -> DataFrame:
    """(a, b): edges that join whatever of ``postings`` (key, id, n, minima) collides often enough in a list.

    A list is settled inside blocks first.  Of lists with more than one block only one row of each component goes on to the
    next round, in which such rows share blocks, until a list is one component or a round joins less
    than half of what was left.  What is then left are lists of rows that do not belong together; their components are
    compared with each other, block by block.
    """
    postings = postings.withColumn("part", F.lit(-1).cast("long"))
    edges = lambda blocks: stage(_by_pair(blocks, "key").mapInArrow(_list_edges(min_minima, percent), "key long, a long, b long"), "near")
    cells = _cells(postings, "key", block)
    found = edges(_alone(postings, cells, "key"))
    near = found.select("a", "b")
    wide = cells.groupBy("key").agg(F.max(F.col("first") + F.col("times")).alias("blocks"), F.sum("rows").alias("rows"))
    open_ = stage(wide.filter("blocks > 1").select("key", "rows"), "open-lists")
    n, left = open_.agg(F.sum("rows")).first()[0] or 0, postings
    while n:
        left = join_hot(left, open_, ["key"], "rows", ["id"]).drop("rows")
        members = found.filter("a <> b").select("key", F.col("b").alias("id")).distinct()
        left = stage(left.join(members, ["key", "id"], "left_anti"), "left")
        open_ = stage(left.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1"), "open-lists")
        before, n = n, open_.agg(F.sum("rows")).first()[0] or 0
        if n * 2 > before:
            return _across(postings, open_, stage(near.distinct(), "near"), edges, block, percent)
        if n:
            left = join_hot(left, open_, ["key"], "rows", ["id"]).drop("rows")
            found = edges(_alone(left, _cells(left, "key", block), "key"))
            near = near.unionByName(found.select("a", "b"))
    return near.distinct()


def _by_pair(blocks: DataFrame, group: str) -> DataFrame:
    return blocks.repartition(group, *PAIR).sortWithinPartitions(group, *PAIR, "side")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The tables of consecutive equal keys in a sorted stream of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is not None and last != tuple(c[0] for c in columns)
        at = 0
        for cut in np.flatnonzero(new).tolist():
            held.append(batch.slice(at, cut - at))
            yield pa.Table.from_batches([h for h in held if h.num_rows])
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _spanning(ids: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """Edges (smallest, member) of the components of a symmetric boolean matrix."""
    label, n = np.arange(len(ids)), len(ids)
    order = np.argsort(ids, kind="stable")
    near = near[np.ix_(order, order)] | np.eye(n, dtype=bool)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    ids = ids[order]
    return [(int(ids[a]), int(ids[b])) for b, a in enumerate(label.tolist()) if a != b]


def _edges(rows: list[tuple[int, ...]], names: tuple[str, ...] = ("a", "b")) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(names))


def _list_edges(min_minima: int, percent: int):
    """mapInArrow over lists sorted by key and blocks: list, representative and member of what collides often enough."""
    names = ("key", "a", "b")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for group in _groups(batches, ["key", *PAIR]):
            key, ids, n = group.column("key")[0].as_py(), group.column("id").to_numpy(), group.column("n").to_numpy()
            if len(ids) < 2:
                continue
            minima = np.frombuffer(b"".join(group.column("minima").to_pylist()), np.uint8).reshape(len(ids), N_MINIMA)
            near = np.minimum(n[:, None], n[None, :]) * 100 >= np.maximum(n[:, None], n[None, :]) * percent
            step = max(1, (8 << 20) // (len(ids) * N_MINIMA))
            for a in range(0, len(ids), step):
                hits = (minima[a : a + step, None, :] == minima[None, :, :]).sum(2)
                near[a : a + step] &= hits >= min_minima
            out += [(key, a, b) for a, b in _spanning(ids, near)]
            if len(out) > 10_000:
                yield _edges(out, names)
                out = []
        yield _edges(out, names)

    return words.releasing(edges)


def overlaps(sets: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of sets, from products of 0/1 matrices of shared members."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    good = shared[column]
    row, column = row[good], number[column[good]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = int(shared.sum())
    cuts = np.searchsorted(column, np.arange(0, width + wide, wide))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = np.zeros((len(sets), min(wide, width - k * wide)), np.float32)
        part[row[a:b], column[a:b] - k * wide] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _set_links(percent: int):
    """mapInArrow over families sorted by blocks: spanning edges of the pairs that link."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["family", *PAIR]):
            ids = group.column("id").to_numpy()
            if len(ids) < 2:
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("members")]
            both = overlaps(sets)
            n = np.array([len(x) for x in sets])
            yield _edges(_spanning(ids, 100 * both >= percent * (n[:, None] + n[None, :] - both)))

    return words.releasing(links)


def _confirm(percent: int):
    """mapInArrow over pairs with both full sets: those that link."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return words.releasing(confirm)


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(id, family, n, set, members) with the full sets of the wanted documents only."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text", SLICE_BYTES):
            flat, offsets = shingle_sets(batch.column("text"), shingle)
            members = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [batch.column("id"), batch.column("family"), pa.array(np.diff(offsets)), pa.array(members, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "family", "n", "members"])

    listed = maybe_in(wanted.select("id"), "id")
    if listed is not None:  # most other texts are not shuffled
        docs = docs.filter(listed)
    found = docs.join(wanted, "id").mapInArrow(words.releasing(collect), "id long, family long, n long, members binary")
    found = found.filter("n > 0").withColumn("set", F.xxhash64("members"))
    return found.dropDuplicates(["id", "set"])


def _confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``near`` that link on their full sets."""
    first = stage(near.groupBy("a").count(), "representatives")
    pairs = near.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    heads = sets.select(F.col("id").alias("a"), F.col("members").alias("x")).join(first, "a")
    both = join_hot(pairs, heads, ["a"], "count", ["b"]).select("a", "b", "x", "y")
    return both.mapInArrow(_confirm(percent), "a long, b long")


def minhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    min_matches: int = 7,
    min_minima: int = 33,
    block: int = 512,
) -> DataFrame:
    """Return one row per input row: id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a document's set holds
    its distinct ``shingle``-word sequences, the whole sequence if it has fewer
    words.  Documents link at 100 * intersection >= percent * union; a component is
    named by its smallest id, whose row is the one kept.  Null, empty and blank
    texts have an empty set and link with nothing.  Every row with a null id is a
    document of its own, smaller than all that have one.  Rows that repeat an id are one
    document, which has the links of all its texts; each keeps its row and its own
    n_shingles.  A text of any length is hashed whole; a task holds one text, and two
    blocks or sets.  Other columns of ``docs`` are not read, whatever their names.  An
    empty table gives no rows.
    """
    rows, id_of = keyed(docs, id_col)
    rows = rows.select(F.col(KEY).alias("id"), F.col(text_col).alias("text"))
    signed = stage(
        rows.mapInArrow(_signatures(shingle), "id long, n long, k1 long, k2 long, keys array<long>, minima binary"),
        "signatures",
    )
    same = ["n", "k1", "k2"]
    full = signed.filter("n > 0")
    copied = stage(full.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1"), "copied")
    members = stage(
        join_hot(signed.select("id", *same), copied, same, "copies", ["id"], "left").select(
            "id", "n", F.col("k1").alias("set"), F.coalesce("rep", "id").alias("rep"), "copies"
        ),
        "set-groups",
    )
    first = members.filter("n > 0 AND rep = id").select("id", "set").distinct()
    sets = full.withColumnRenamed("k1", "set").join(first, ["id", "set"], "left_semi").dropDuplicates(["id", "set"])
    sets = sets.select("id", "set", "n", "keys", "minima")
    postings = stage(prefix_postings(sets, min_matches), "postings")
    near = stage(candidates(postings, block, percent, min_minima), "near")
    families = stage(components(near).select(F.col("node").alias("id"), F.col("component").alias("family")), "families")
    texts = stage(_sets_of(rows, families, shingle), "sets")
    sure = stage(_confirmed(near, texts, percent), "sure")

    joined = stage(components(sure), "joined")
    known = joined.select(F.col("node").alias("id"), F.col("component").alias("joined"))
    known = stage(families.join(known, "id", "left").select("id", "family", F.coalesce("joined", "id").alias("joined")), "known")
    parts = _apart(known, "family", block).select("id", "part")
    rest = stage(texts.join(parts, "id"), "apart")
    late = _by_pair(_blocks(rest, "family", block, percent), "family").mapInArrow(_set_links(percent), "a long, b long")
    several = members.filter("n > 0").groupBy("id").agg(F.min("set").alias("low"), F.max("set").alias("high")).filter("low <> high")
    repeated = members.filter("rep <> id").join(several, "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    more = stage(late.unionByName(repeated), "links")
    stars = joined.select(F.col("component").alias("a"), F.col("node").alias("b"))
    labels = joined if more.isEmpty() else components(stars.unionByName(more))
    labels = labels.select(F.col("node").alias("rep"), "component")

    counts = members.groupBy("rep").agg(F.count("*").alias("rows"))
    labels = stage(labels.join(counts, "rep"), "labels")
    result = join_hot(members.drop("copies"), labels, ["rep"], "rows", ["id"], "left")
    component = F.coalesce("component", "rep")
    return result.select(
        id_of(F.col("id")).alias(id_col),
        F.col("n").alias("n_shingles"),
        id_of(component).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
