import hashlib
import random
import re
import zlib

import pytest

from webkiln.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, conv int, seg string, alive string"
MOVES = {"": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """All edits as a table of the least (cost, letters) per state; ``rows`` are (role, text, fault)."""

    def inserted(best):
        for _ in range(3):
            for state in list(best):
                cost, letters, out = best[state]
                to = "u" if state != "u" else "a"
                new = (cost + 2, letters + "I", [*out, f"{NAMES[to]}:"])
                best[to] = min(best.get(to, new), new)
        return best

    best = inserted({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}

        def offer(state, value, after=after):
            after[state] = min(after.get(state, value), value)

        for state, (cost, letters, out) in best.items():
            offer(state, (cost + 3, letters + "D", out))
            if fault in "bd":
                continue
            extra = fault == "t"
            if role[:1] and role[:1] in MOVES[state]:
                offer(role[0], (cost + extra, letters + "K", [*out, f"{role}:{text}"]))
            to = "u" if state != "u" else "a"
            offer(to, (cost + 2 + extra, letters + "R", [*out, f"{NAMES[to]}:{text}"]))
        best = inserted(after)
    return min(best[s] for s in ("", "a") if s in best)


def twin(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is None:
            continue
        kept = convs.setdefault(c, [])
        kind = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for c, kept in convs.items():
        kept.sort()
        seen, marked = set(), []
        for _, _, role, text in kept:
            stripped = text.rstrip(" \t\n\x0b\x0c\r")
            marked.append((role, text, "b" if not stripped else "d" if (role, text) in seen else "." if stripped[-1] in ".!?" else "t"))
            seen.add((role, text))
        turns = {t for known, t, *_ in kept if known}
        faults = [f for *_, f in marked]
        letters = [r[:1] or "-" for r, *_ in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
        cost, audit, repaired = cheapest(marked)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out.append((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest))
    return sorted(out)


def result(spark, rows, **how):
    table = spark.createDataFrame([(*r, 5, "clash", "clash") for r in rows], SCHEMA).repartition(3)
    out = repair.repair_conversations(repair.damage(table), **how).collect()
    digest = lambda r: hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in r.repaired).encode()).hexdigest()
    return sorted((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest(r)) for r in out)


def conversation(rng, c, n):
    roles = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * n
    if rng.random() < 0.4:
        roles = [rng.choice(["user", "assistant", "system", "tool", None, ""]) if rng.random() < 0.2 else r for r in roles]
    texts = ["fine.", "Really?", "cut off", "", " \t", None, "same.", "ünï!"]
    return [(c, t, r, rng.choice([*texts, f"text {t}.", f"other {t}!"])) for t, r in enumerate(roles[:n])]


def test_repair_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [row for c in range(-3, 150) for row in conversation(rng, c, rng.randint(1, 12))]
    rows += [(500, None, "user", "a."), (500, None, "user", "a."), (501, None, None, None), (502, 3, "user", "b."), (502, 3, "assistant", "a."), (None, 1, "user", "x.")]
    rows += [(503, 5, "assistant", "tie."), (503, 5, "assistant", "tie."), (503, 900, "user", "x" * 100_000 + ".")]
    assert result(spark, rows) == twin(rows)


@pytest.mark.parametrize("segment_rows", [512, 7])
def test_long_conversations_are_solved_in_segments(spark, segment_rows):
    rng = random.Random(6)
    rows = [row for c, n in ((1, 700), (2, 40), (3, 1300), (4, 3)) for row in conversation(rng, c, n)]
    assert result(spark, rows, segment_rows=segment_rows) == twin(rows)


def test_blocks_agree_with_one_lattice(monkeypatch):
    rng = random.Random(9)
    for _ in range(60):
        n = rng.randint(0, 40)
        letters, faults = ("".join(rng.choice(x) for _ in range(n)) for x in ("suuaa-", "....tbd"))
        monkeypatch.setattr(repair, "BLOCK_ROWS", 1000)
        one = repair.cheapest(letters, faults)
        monkeypatch.setattr(repair, "BLOCK_ROWS", rng.randint(1, 9))
        many = repair.cheapest(letters, faults)
        assert (one[0], "".join(a for _, a in one[1])) == (many[0], "".join(a for _, a in many[1]))


def test_empty_table(spark):
    assert result(spark, []) == []
