import hashlib
import random
import zlib

from pyspark.sql import functions as F

from webkiln.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, conv string"


def twin(rows):
    """The contract, literally: every prefix in a dictionary, every subtree by walking."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    nodes = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            node = nodes.setdefault(tuple(path[:d]), {"members": [], "ends": []})
            node["members"].append(c)
            if d == len(path):
                node["ends"].append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        below = children.get(key, [])
        leaves[key] = sum(leaves[k] for k in below) if below else 1
        saved[key] = sum(saved[k] for k in below) + (len(nodes[key]["members"]) - 1) * len(key[-1][1] if key else "")
    return sorted(
        (
            min(n["members"]), len(key), min(nodes[key[:-1]]["members"]) if key else None, len(n["members"]),
            len(children.get(key, [])), leaves[key], saved[key], hashlib.sha256(",".join(map(str, sorted(n["ends"]))).encode()).hexdigest(),
        )
        for key, n in nodes.items()
    )


def result(spark, rows, **how):
    table = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(4)
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    out = conversation_trie.conversation_trie(table, head, F.col("conv") - F.col("conv") % 100, **how).collect()
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


def corpus():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(301, 320), -5, -107, -100]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "ünï", None, "", "long text " * 30])))
    rows += [(400 + k, t, "user", f"turn {t if t < 300 + 7 * k else (t, k)}") for k in range(5) for t in range(340)]  # deep, shared far down
    rows += [(7, None, "user", "no turn"), (7, None, "user", "no turn"), (8, 2, "user", "tie"), (8, 2, "user", "tie"), (8, 2, "user", "other"), (None, 1, "user", "no id")]
    return rows


def test_trie_equals_brute_force(spark):
    rows = corpus()
    expect = twin(rows)
    assert result(spark, rows) == expect
    assert result(spark, rows, band=3) == expect


def test_hot_groups_and_pieces(spark, monkeypatch):
    """Copies of one conversation, more ids at a node than a piece holds, and a block of few turns."""
    monkeypatch.setattr(conversation_trie, "PIECE_BITS", 3)
    monkeypatch.setattr(conversation_trie, "BLOCK", 4)
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1600) for t in range(7)] + [(c, 0, "user", str(c)) for c in range(2000, 2700)]
    assert result(spark, rows) == twin(rows)


def test_empty_table(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, 0, "user", "a")]) == []
