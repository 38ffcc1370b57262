"""Plain Python versions of what the operators compute."""

import re
from collections import defaultdict

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def raw_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def repeated_windows(pairs, window):
    seen, out = set(), {}
    for doc, text in sorted(pairs):
        words = raw_words(text)
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[doc] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def near_components(pairs, shingle, percent):
    sets = {}
    for doc, text in pairs:
        words = raw_words((text or "").translate(ASCII_LOWER))
        grams = {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}
        sets[doc] = grams or ({tuple(words)} if words else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def exact_groups(pairs):
    groups = defaultdict(list)
    for doc, text in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc)
    return {d: (min(g), len(g), d == min(g)) for g in groups.values() for d in g}


def repeated_lines(pairs, min_chars, min_docs):
    blank = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for doc, text in pairs:
        for line in (text or "").split("\n"):
            key = line.strip(blank).translate(ASCII_LOWER)
            if len(key) >= min_chars:
                holders[key].add(doc)
    out = {}
    for doc, text in pairs:
        lines = (text or "").split("\n")
        stay = []
        for line in lines:
            held = holders.get(line.strip(blank).translate(ASCII_LOWER), ())
            if len(held) < min_docs or doc == max(held):
                stay.append(line)
        out[doc] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def phrases(pairs, table):
    out = {}
    for doc, text in pairs:
        words = alnum_words(text)
        places, labels = [], set()
        for phrase, label in table.items():
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        out[doc] = (len(words), sorted(places), ",".join(sorted(labels)))
    return out


def tiles(doc, item, k):
    """Greedy string tiling by its definition: always the longest unmarked match, earliest first."""
    a, b = alnum_words(doc), alnum_words(item)
    k = min(k, len(b))
    grams = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if b else set()
    near = [i for i in range(len(a) - k + 1) if tuple(a[i : i + k]) in grams] if b else []
    marked_a, marked_b, total = set(), set(), 0
    while near:
        best = (0, 0, 0)
        for i in near:
            for j in range(len(b)):
                n = 0
                while (
                    i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in marked_a and j + n not in marked_b
                ):
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < k:
            break
        marked_a |= set(range(i, i + n))
        marked_b |= set(range(j, j + n))
        total += n
    return total / len(b) if b else 0.0
