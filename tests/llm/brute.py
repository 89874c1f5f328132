"""Plain implementations that the corpus operators are held against."""

from __future__ import annotations

import hashlib
import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, k: int = 5) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(rows: list[tuple], percent: int) -> dict:
    """doc_id -> (shingles, smallest doc_id reachable), comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows: list[tuple], least: int = 50) -> dict:
    """doc_id -> (bytes, removed, spans, sha256 of the rest)."""
    first: dict[bytes, int] = {}
    out = {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first.setdefault(b[p : p + least], i) < i:
                gone[p : p + least] = b"\1" * least
        runs = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(b)))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def corpus(n: int, seed: int) -> list[tuple]:
    """(doc_id, text) with copies, edits, shared passages, empty, null and odd texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 8))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage, base = say(25), say(120)
    rows: list[tuple] = [(0, ""), (1, None), (2, "   \n"), (3, "one two"), (4, "ONE\ttwo"), (5, "x" * 400), (6, "x" * 300), (7, "日本語" * 40), (8, "日本語" * 30)]
    for i in range(9, n):
        kind = r.randint(0, 5)
        text = say(r.randint(1, 150))
        if kind == 0 and rows[-1][1]:
            text = r.choice(rows)[1]
        elif kind == 1:
            w = base.split()
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = r.choice(words)
            text = " ".join(w)
        elif kind == 2:
            text = say(r.randint(0, 30)) + " " + passage + "\n" + say(r.randint(0, 30))
        rows.append((i, text))
    return rows
