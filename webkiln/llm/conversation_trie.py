"""The prefix trie of conversations, rolled up by bands of depth.

A node is a depth and the exclusive or of its turns' hashes, each salted with its
place, so that prefixes come from running aggregates over blocks of turns and no task
needs a whole conversation.  Totals of subtrees are found in bands of ``band`` levels:

* upwards, the nodes of a band are summed at its root, then the roots of ``band`` bands
  at the root of a wider band, until the trie's root is reached;
* downwards, completed totals of band roots are added to the nodes they hang from, and
  every node of a band explodes to its ancestors inside the band only.

Rounds grow with the logarithm of the depth to the base ``band``; a node makes at most
``band`` rows in a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webkiln.llm.staging import join_hot, stage

NODE = ["depth", "k1", "k2"]
#: Turns over which one running aggregate goes.
BLOCK = 256
#: Conversation ids in one piece of a list that is digested piece by piece.
PIECE_BITS = 12


def numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(conv, place, t1, t2, chars) of every turn, and (conv, n) of every conversation.

    Rows are sorted over the whole table, so a long conversation is spread over partitions;
    a turn's place follows from its place in the partition and from the counts before.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    content = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.orderBy("conv", F.asc_nulls_first("turn"), "role", "text", F.monotonically_increasing_id())
    sorted_ = rows.select(
        "conv",
        F.monotonically_increasing_id().alias("at"),
        F.xxhash64(content, F.lit(1)).alias("t1"),
        F.xxhash64(content, F.lit(2)).alias("t2"),
        F.char_length("text").cast("long").alias("chars"),
    )
    sorted_ = stage(sorted_, "turns").withColumn("part", F.shiftright("at", 33))
    parts = stage(sorted_.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), "turn-parts")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("conv", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = sorted_.join(before, ["conv", "part"]).select("conv", (F.col("at") - F.col("first") + 1 + F.col("before")).alias("place"), "t1", "t2", "chars")
    return placed, parts.groupBy("conv").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, sizes: DataFrame, head: Column, base: Column) -> DataFrame:
    """(conv, depth, t1, t2, chars, last): the turns of every rebuilt conversation, and a row of depth 0 for each.

    ``head`` turns come from the conversation ``base``, the others, after as many, from the conversation itself.
    """
    convs = sizes.select("conv", "n", head.cast("long").alias("head"), base.alias("base"))
    taken = F.least("head", F.coalesce("base_n", F.lit(0))).alias("taken")
    convs = convs.join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").select("conv", "n", "head", "base", taken)
    convs = stage(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))), "convs")
    parts = convs.select("conv", "head", "taken", "length")
    own = join_hot(turns, stage(parts.join(sizes, "conv"), "sizes"), ["conv"], "n", ["place"]).filter("place > head")
    own = own.select("conv", (F.col("taken") + F.col("place") - F.col("head")).alias("depth"), "t1", "t2", "chars", "length")
    most = convs.agg(F.max("taken")).first()[0] or 0
    heads = turns.filter(F.col("place") <= most).withColumnRenamed("conv", "base").join(convs, "base").filter("place <= taken")
    heads = heads.select("conv", F.col("place").alias("depth"), "t1", "t2", "chars", "length")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", zero.alias("depth"), zero.alias("t1"), zero.alias("t2"), zero.alias("chars"), "length")
    return own.unionByName(heads).unionByName(roots).withColumn("last", F.col("depth") == F.col("length")).drop("length")


def prefixes(path: DataFrame) -> DataFrame:
    """(conv, depth, k1, k2, p1, p2, chars, last): keys of the prefix that ends at each turn and of the one before it."""
    block = F.floor(F.col("depth") / BLOCK).cast("long")
    own = [F.when(F.col("depth") > 0, F.xxhash64("depth", "t1", "t2", F.lit(k))).otherwise(0).alias(f"s{k}") for k in (1, 2)]
    path = stage(path.select("conv", "depth", block.alias("block"), *own, "chars", "last"), "path")
    running = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = path.groupBy("conv", "block").agg(F.bit_xor("s1").alias("b1"), F.bit_xor("s2").alias("b2"))
    totals = totals.select("conv", "block", *[F.bit_xor(f"b{k}").over(earlier).alias(f"b{k}") for k in (1, 2)]).filter("block > 0")
    here = path.select("*", *[F.bit_xor(f"s{k}").over(running).alias(f"x{k}") for k in (1, 2)]).join(totals, ["conv", "block"], "left")
    keys = [F.col(f"x{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in (1, 2)]
    before = [key.bitwiseXOR(F.col(f"s{k}")).alias(f"p{k}") for k, key in enumerate(keys, 1)]
    return here.select("conv", "depth", keys[0].alias("k1"), keys[1].alias("k2"), *before, "chars", "last")


def _ancestors(nodes: DataFrame, path: DataFrame, unit: int, wide: int, only: Column | None = None) -> DataFrame:
    """Rows of ``nodes`` (conv, depth, values) once for each ancestor, itself included, at a depth that ``unit`` divides,
    inside the band of ``wide`` levels; ``only`` picks among the ancestors."""
    up = path.filter(F.col("depth") % unit == 0).select("conv", F.floor(F.col("depth") / wide).alias("__band"), F.col("depth").alias("up"), "k1", "k2")
    found = nodes.withColumn("__band", F.floor(F.col("depth") / wide)).join(up, ["conv", "__band"])
    return found.filter(F.col("up") <= F.col("depth") if only is None else only)


def subtree_totals(nodes: DataFrame, path: DataFrame, values: list[str], band: int) -> DataFrame:
    """(depth, k1, k2, values): each node's values summed over its subtree.

    ``nodes`` are (depth, k1, k2, conv, values), ``path`` the prefixes of all conversations.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    ids = nodes.select(*NODE, "conv")
    sums, levels, unit = {0: nodes.select(*NODE, "conv", *values)}, 0, 1
    added = [F.sum(v).alias(v) for v in values]

    def at(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("up").alias("depth"), "k1", "k2", *values).groupBy(*NODE).agg(*added)

    def light(rows: DataFrame) -> DataFrame:
        return rows.select("conv", "depth", *values)

    while deepest is not None and unit * band <= deepest:  # upwards, until one band holds all units
        wide = unit * band
        raised = at(_ancestors(light(sums[levels]), path, wide, wide, F.lit(True)))
        levels, unit = levels + 1, wide
        sums[levels] = stage(raised.join(ids, NODE), "band-sums")
    done = None
    for level in range(levels, -1, -1):
        unit = band**level
        here = light(sums[level])
        if done is not None:  # totals of the band roots below, at the nodes that they hang from
            hung = done.filter(F.col("depth") > 0).withColumn("depth", F.col("depth") - unit)
            here = here.unionByName(light(hung))
        totals = at(_ancestors(here, path, unit, unit * band))
        done = stage(totals.join(ids, NODE), "band-totals") if level else totals
    return done


def _end_digests(path: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): digests of the ids that end at a node, streamed in ascending pieces."""
    ends = path.filter("last").select(*NODE, "conv").orderBy(*NODE, "conv").withColumn("at", F.monotonically_increasing_id())
    pieces = stage(ends, "ends").withColumn("piece", F.shiftright("at", PIECE_BITS))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = pieces.groupBy(*NODE, "piece").agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _rows(out)
        if node is not None:
            yield _rows([(*node, state.hexdigest())])

    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return dealt.select(*NODE, "ids").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*NODE, "ends_sha256"])


def conversation_trie(
    turns: DataFrame,
    head: Column,
    base: Column,
    band: int = 16,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations.

    ``head`` and ``base`` are expressions of the column ``conv``: a conversation is rebuilt from the first
    ``head`` turns of conversation ``base`` (all if it has fewer, none if it is absent) and
    its own turns after as many.  The columns are ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``, the digest of the ids of members that end here.

    Turns are ordered by turn, null first, ties by role and text; repeated rows are turns
    of their own.  Null role or text: empty.  Rows without a conversation id are left out.
    Texts of any length are hashed whole (two 64-bit hashes of their SHA-256 stand for a
    turn).  Other columns are not read, whatever their names.  An empty table gives no
    rows.  A conversation or node with most of the rows is spread over tasks: nodes are
    aggregated where their members lie, and what hangs from a hot parent is salted.
    """
    placed, sizes = numbered(turns, conv_col, turn_col, role_col, text_col)
    placed, sizes = stage(placed, "placed"), stage(sizes, "conv-sizes")
    path = stage(prefixes(rebuilt(placed, sizes, head, base)), "prefixes")
    members = [F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *[F.first(c).alias(c) for c in ("p1", "p2", "chars")]]
    nodes = stage(path.groupBy(*NODE).agg(*members), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    nodes = stage(nodes.join(children.agg(F.count("*").alias("n_children")), NODE, "left").fillna(0, ["n_children"]), "trie")
    values = [(F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")]
    totals = subtree_totals(nodes.select(*NODE, "conv", *values), path, ["n_leaves", "saved_tokens"], band)
    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"), F.col("n_children").alias("n"))
    named = join_hot(nodes, stage(parents, "parents"), ["depth", "p1", "p2"], "n", ["k1"], "left")
    out = named.join(totals, NODE).join(_end_digests(path), NODE, "left")
    return out.select(
        F.col("conv").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
