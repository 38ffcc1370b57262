"""Repair of damaged conversations at least cost, by the auction algorithm for shortest paths.

The rows of a conversation and a machine of four states (nothing yet, system seen, user seen,
assistant seen) span a lattice whose arcs are edits with integer costs.  The auction keeps a
price per node, never above an arc's cost and the price behind it, and a path that grows
along tight arcs and shrinks, raising prices, where there is none.  Once it has reached
the end every cheapest repair consists of tight arcs, and the least one by letters is traced along them.

Rows are sorted over the whole table and cut to segments, so a long conversation is spread over
partitions.  Conversations inside a partition are solved where they lie.  Those that go beyond
one, or beyond a segment, send two letters per row to one task, which solves them block by
block, and take their edits back to the segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webkiln.llm.staging import join_hot, stage

KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 2, 3, 2, 1
#: state -> {role initial: next state}; states 0 and 3 may end a conversation.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: The move that a new or changed role makes.
FORCED = tuple(next((r, to) for r, to in moves.items() if r in "ua") for moves in MOVES)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = "\x20\t\n\x0b\x0c\r"
INF = 1 << 40
#: Rows of a segment, bytes of its texts, and rows of a block of the lattice.
SEGMENT_ROWS, SEGMENT_BYTES, BLOCK_ROWS = 512, 4 << 20, 256

Arcs = list[list[tuple[str, int, int]]]


def auction(arcs: Arcs, price: list[int], origin: int, target: int) -> int:
    """Length of the shortest path; ``price`` must not exceed an arc's cost and the price behind it.

    Every node of ``arcs`` must reach the target; cycles must have positive lengths.
    """
    path = [origin]
    while path[-1] != target:
        here = path[-1]
        best, to = INF, -1
        for _, cost, node in arcs[here]:
            if cost + price[node] < best:
                best, to = cost + price[node], node
        if price[here] < best:  # contraction
            price[here] = best
            if len(path) > 1:
                path.pop()
        else:  # extension
            path.append(to)
    return price[origin] - price[target]


def trace(arcs: Arcs, price: list[int], origin: int, target: int) -> list[tuple[str, int]]:
    """The (letter, node reached) of the path of tight arcs whose letters are least."""
    open_arcs: list[Iterator] = []
    path: list[tuple[str, int]] = []
    dead: set[int] = set()

    def tight(node: int) -> Iterator:
        return iter(sorted((letter, to) for letter, cost, to in arcs[node] if price[node] == cost + price[to]))

    open_arcs.append(tight(origin))
    while True:
        step = next((s for s in open_arcs[-1] if s[1] not in dead), None)
        if step is None:  # nothing tight leads on: back one step
            open_arcs.pop()
            dead.add(path.pop()[1])
            continue
        path.append(step)
        if step[1] == target:
            return path
        open_arcs.append(tight(step[1]))


def lattice(initials: str, faults: str, after: list[int], last: bool) -> tuple[Arcs, list[int]]:
    """Arcs and first prices of a block of rows; node ``4 * row + state``, the target behind all.

    ``after`` are the costs from each state at the block's end (INF: not allowed).  Inserts at
    the end belong to the next block, if there is one.  ``faults`` has b, d, t or a dot per row.
    """
    n = len(initials)
    target = 4 * (n + 1)
    arcs: Arcs = [[] for _ in range(target + 1)]
    price = [0] * (target + 1)
    floor = min(after)
    for state in range(4):
        price[4 * n + state] = floor
        if after[state] < INF:
            arcs[4 * n + state].append(("", after[state], target))
    for i in range(n, -1, -1):
        if i < n:
            must_go, extra = faults[i] in "bd", LEFT_TRUNCATED if faults[i] == "t" else 0
            floor += DELETE if must_go else extra
        for state in range(4):
            here, (_, forced) = 4 * i + state, FORCED[state]
            if i < n or last:
                arcs[here].append(("I", INSERT, 4 * i + forced))
            if i == n:
                continue
            price[here] = floor
            arcs[here].append(("D", DELETE, here + 4))
            if not must_go:
                arcs[here].append(("R", REROLE + extra, 4 * (i + 1) + forced))
                if (to := MOVES[state].get(initials[i])) is not None:
                    arcs[here].append(("K", KEEP + extra, 4 * (i + 1) + to))
    back: list[list[int]] = [[] for _ in arcs]
    for node, out in enumerate(arcs):
        for _, _, to in out:
            back[to].append(node)
    reach, todo = {target}, [target]
    while todo:
        for node in back[todo.pop()]:
            if node not in reach:
                reach.add(node)
                todo.append(node)
    for node, out in enumerate(arcs):
        arcs[node] = [arc for arc in out if arc[2] in reach] if node in reach else []
    return arcs, price


def block_costs(initials: str, faults: str, last: bool) -> list[list[int]]:
    """Least costs from each state before a block to each state after it."""
    costs = [[INF] * 4 for _ in range(4)]
    for end in range(4):
        arcs, price = lattice(initials, faults, [0 if state == end else INF for state in range(4)], last)
        for start in range(4):
            if arcs[start]:
                costs[start][end] = auction(arcs, price, start, len(arcs) - 1)  # prices go on from start to start
    return costs


def cheapest(initials: str, faults: str) -> tuple[int, list[tuple[int, str]]]:
    """The cost, and per block of rows the state before it and its edits."""
    cuts = range(0, max(len(initials), 1), BLOCK_ROWS)
    blocks = [(initials[a : a + BLOCK_ROWS], faults[a : a + BLOCK_ROWS], a + BLOCK_ROWS >= len(initials)) for a in cuts]
    after = [[0 if state in ENDS else INF for state in range(4)]]
    if len(blocks) > 1:  # prices at the blocks' edges, by an auction over the blocks from the end to the front
        n = len(blocks)
        arcs: Arcs = [[] for _ in range(4 * (n + 1) + 1)]
        for state in ENDS:
            arcs[4 * n + state].append(("", 0, 4 * (n + 1)))
        price = [0] * len(arcs)
        for i in range(n - 1, 0, -1):
            costs = block_costs(*blocks[i])
            for state in range(4):
                arcs[4 * i + state] = [("", c, 4 * (i + 1) + end) for end, c in enumerate(costs[state]) if c < INF and arcs[4 * (i + 1) + end]]
                if arcs[4 * i + state]:
                    auction(arcs, price, 4 * i + state, len(arcs) - 1)
            after.append([price[4 * i + s] if arcs[4 * i + s] else INF for s in range(4)])
    state, total, edits = 0, None, []
    for (letters, marks, last), goal in zip(blocks, reversed(after), strict=True):
        arcs, price = lattice(letters, marks, goal, last)
        cost = auction(arcs, price, state, len(arcs) - 1)
        total = cost if total is None else total
        steps = trace(arcs, price, state, len(arcs) - 1)
        edits.append((state, "".join(letter for letter, _ in steps)))
        state = (steps[-2][1] if len(steps) > 1 else state) % 4
    return total, edits


def apply_edits(state: int, audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The rows that the edits leave."""
    out, rows = [], iter(rows)
    for edit in audit:
        initial, to = FORCED[state]
        if edit == "I":
            out.append((ROLES[initial], ""))
            state = to
            continue
        role, text = next(rows)
        if edit == "K":
            out.append((role, text))
            state = MOVES[state][role[0]]
        elif edit == "R":
            out.append((ROLES[initial], text))
            state = to
    return out


def fault(text: str, seen: bool) -> str:
    """b (blank), d (duplicate), t (truncated) or a dot."""
    stripped = text.rstrip(SPACE)
    return "b" if not stripped else "d" if seen else "." if stripped[-1] in ".!?" else "t"


def initial(role: str) -> str:
    return role[:1] or "-"


def _identity(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def marks(rows: list[tuple], earlier: set[bytes]) -> tuple[str, str]:
    """Initials and faults of (turn, role, text) rows; ``earlier`` are the rows of segments before, and grows."""
    letters, found = [], []
    for _, role, text in rows:
        key = _identity(role, text)
        letters.append(initial(role))
        found.append(fault(text, key in earlier))
        earlier.add(key)
    return "".join(letters), "".join(found)


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))


_ROWS = "array<struct<role: string, text: string>>"
_SEGMENTS = (
    "conv long, seg long, turns array<long>, rows array<struct<role: string, text: string>>, whole boolean, gaps long, blank long, "
    f"duplicate long, truncated long, illegal long, cost long, audit string, repaired {_ROWS}"
)
_PAIR = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_ARROW = pa.schema(
    [("conv", pa.int64()), ("seg", pa.int64()), ("turns", pa.list_(pa.int64())), ("rows", _PAIR), ("whole", pa.bool_())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired", _PAIR)]
)


def _pairs(rows: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in rows]


def _whole(conv: int, seg: int, rows: list[tuple]) -> dict:
    letters, faults = marks(rows, set())
    cost, edits = cheapest(letters, faults)
    repaired, at = [], 0
    for state, audit in edits:
        n = sum(e != "I" for e in audit)
        repaired += apply_edits(state, audit, [r[1:] for r in rows[at : at + n]])
        at += n
    return {
        "conv": conv, "seg": seg, "whole": True, "gaps": _gaps([r[0] for r in rows]), "blank": faults.count("b"), "duplicate": faults.count("d"),
        "truncated": faults.count("t"), "illegal": _illegal(letters), "cost": cost, "audit": "".join(a for _, a in edits), "repaired": _pairs(repaired),
    }


def _cut(batches: Iterator[pa.RecordBatch], segment_rows: int) -> Iterator[pa.RecordBatch]:
    """Segments of sorted rows; a conversation that surely lies in one of them is solved at once."""
    part, count, conv, first = TaskContext.get().partitionId(), 0, None, True
    rows: list[tuple] = []
    size, split, out, out_size = 0, False, [], 0

    def close(ended: bool) -> None:
        """The rows at hand are a segment; ``ended``: a row of another conversation follows in this partition."""
        nonlocal count, rows, size, split, first, out_size
        seg = (part << 33) + count
        count += 1
        if ended and not first and not split:
            out.append(_whole(conv, seg, rows))
        else:
            out.append({"conv": conv, "seg": seg, "whole": False, "turns": [r[0] for r in rows], "rows": _pairs([r[1:] for r in rows])})
        out_size += size + 64 * len(rows)
        split = not ended
        first = first and not ended
        rows, size = [], 0

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "alive")]
        for id_, turn, role, text, alive in zip(*columns, strict=True):
            if conv is not None and id_ != conv:
                close(True)
            conv = id_
            if alive:
                if len(rows) >= segment_rows or size > SEGMENT_BYTES:
                    close(False)
                rows.append((turn, role, text))
                size += len(text)
            if out_size > SEGMENT_BYTES:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
                out, out_size = [], 0
    if conv is not None:
        close(False)
    yield pa.RecordBatch.from_pylist(out, _ARROW)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per segment with the edits of its rows, from the letters of whole conversations."""
    schema = pa.schema([(c, pa.int64()) for c in ("conv", "seg", "state", "cost", "illegal")] + [("audit", pa.string())])
    for batch in batches:
        for conv, segments in zip(batch.column("conv").to_pylist(), batch.column("segments").to_pylist(), strict=True):
            letters, faults = ("".join(s[c] for s in segments) for c in ("letters", "faults"))
            cost, edits = cheapest(letters, faults)
            audit, state, at, out = "".join(a for _, a in edits), 0, 0, []
            for k, segment in enumerate(segments):
                begin, left, from_ = at, len(segment["letters"]), state
                while at < len(audit):  # an insert after the last row goes with the next segment
                    if not left and (audit[at] != "I" or k < len(segments) - 1):
                        break
                    left -= audit[at] != "I"
                    at += 1
                piece = audit[begin:at]
                state = _state_after(from_, piece, segment["letters"])
                out.append({"conv": conv, "seg": segment["seg"], "state": from_, "cost": cost, "illegal": _illegal(letters), "audit": piece})
            yield pa.RecordBatch.from_pylist(out, schema)


def _state_after(state: int, audit: str, letters: str) -> int:
    at = 0
    for edit in audit:
        if edit == "K":
            state = MOVES[state][letters[at]]
        elif edit in "RI":
            state = FORCED[state][1]
        at += edit != "I"
    return state


def _spread(open_: DataFrame) -> DataFrame:
    """The results of conversations that lie in several segments, or may do so."""
    listed = open_.select("conv", "seg", F.explode_outer("rows").alias("row"))
    identity = F.sha2(F.concat(F.char_length("row.role").cast("string"), F.lit(":"), F.col("row.role"), F.col("row.text")).cast("binary"), 256)
    held = stage(listed.filter("row IS NOT NULL").select("conv", "seg", F.unhex(identity).alias("key")).distinct(), "held")
    again = held.groupBy("conv", "key").agg(F.min("seg").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = join_hot(held, stage(again, "again"), ["conv", "key"], "n", ["seg"]).filter("seg > first")
    again = again.groupBy("conv", "seg").agg(F.collect_list("key").alias("earlier"))  # at most as many as the segment has rows

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, faults = [], []
            for rows, earlier in zip(batch.column("rows").to_pylist(), batch.column("earlier").to_pylist(), strict=True):
                found = marks([(None, r["role"], r["text"]) for r in rows], set(earlier or ()))
                letters.append(found[0])
                faults.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("seg"), pa.array(letters, pa.string()), pa.array(faults, pa.string())], ["conv", "seg", "letters", "faults"]
            )

    marked = open_.select("conv", "seg", "rows").join(again, ["conv", "seg"], "left").mapInArrow(mark, "conv long, seg long, letters string, faults string")
    marked = stage(marked, "marked")
    solved = marked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", "letters", "faults"))).alias("segments"))
    solved = stage(solved.mapInArrow(_solve, "conv long, seg long, state long, cost long, illegal long, audit string"), "edits")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("state", "audit", "rows"))
            repaired = [_pairs(apply_edits(s, a, [(r["role"], r["text"]) for r in rows])) for s, a, rows in zip(*columns, strict=True)]
            kept = [batch.column(c) for c in ("conv", "seg", "cost", "illegal", "audit")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(repaired, _PAIR)], ["conv", "seg", "cost", "illegal", "audit", "repaired"])

    done = open_.select("conv", "seg", "rows").join(solved, ["conv", "seg"]).mapInArrow(apply, f"conv long, seg long, cost long, illegal long, audit string, repaired {_ROWS}")
    done = done.groupBy("conv").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"), F.sort_array(F.collect_list(F.struct("seg", "audit", "repaired"))).alias("parts"))
    done = done.select("conv", "cost", "illegal", F.array_join("parts.audit", "").alias("audit"), F.flatten("parts.repaired").alias("repaired"))
    counts = marked.groupBy("conv").agg(*[F.sum(F.length(F.regexp_replace("faults", f"[^{m}]", ""))).cast("long").alias(c) for m, c in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    turns = open_.select("conv", F.explode("turns").alias("turn")).filter("turn IS NOT NULL").distinct().groupBy("conv")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    return done.join(counts, "conv").join(gaps, "conv", "left").fillna(0, ["gaps"])


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows (conv, turn, role, text, alive) after damage by the CRC-32 of their place, modulo 20.

    0 takes a row away (``alive`` is false), 1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes it
    the user's.  Null role, text or, in the place, turn: one space.
    """
    blank = F.lit(" ")
    place = F.concat(F.col(conv_col).cast("string"), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), blank))
    kind = F.crc32(place.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), blank) for c in (role_col, text_col))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("alive"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def repair_conversations(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the repaired rows.

    ``turns`` are (conv, turn, role, text, alive); a conversation whose rows are not alive has zeros and nothing
    repaired.  The columns are ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``
    (initials of Keep, Rerole, Delete and Insert) and ``repaired`` (array<struct<role, text>>).

    Rows are ordered by turn, null first, ties by role and text; repeated rows are duplicates.  Null role or text:
    one space.  An empty role starts nothing legal.  Rows without a conversation id are left out.  Texts of any length
    are read whole.  Other columns are not read, whatever their names.  An empty table gives no rows.  A
    conversation's output, like its row, is put together in one task; before that it lies in segments.
    """
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    rows = turns.filter("conv IS NOT NULL").select("conv", "turn", role, text, F.coalesce("alive", F.lit(True)).alias("alive"))
    rows = rows.orderBy("conv", F.asc_nulls_first("turn"), "role", "text", F.monotonically_increasing_id())
    segments = stage(rows.mapInArrow(lambda batches: _cut(batches, segment_rows), _SEGMENTS), "segments")
    columns = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    whole = segments.filter("whole").select(*columns)
    return whole.unionByName(_spread(segments.filter("NOT whole")).select(*columns)).withColumnRenamed("conv", "conv_id")


def repaired_text(repaired: Column) -> Column:
    """``role:text`` of all rows, newline-joined."""
    return F.array_join(F.transform(repaired, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
