"""Plain Python versions of the operators, and texts with the awkward cases."""

from __future__ import annotations

import random
import re

SPACE = " \t\n\x0b\f\r"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def texts(seed=5, n=60):
    """(id, text): null, empty, blank, very long, ties, repeats, near and exact copies, lines that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}é"[: 2 + k % 4] + str(k % 37) for k in range(300)]
    shared = "This Very Common Line stands in a good many of the documents here"
    rows = [(1, None), (2, ""), (3, " \t\x0b"), (4, "one"), (5, "One two THREE"), (6, "one two three"), (7, "\n\n"), (8, "x" * 100 + "　y")]
    base = [rng.choice(vocabulary) for _ in range(60)]
    for k in range(n):
        if k % 3 == 0:
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        else:
            own = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))]
        text = " ".join(own)
        if k % 4 == 0:
            text += "\n" + rng.choice([shared, f"  {shared.upper()}\t"])
        rows.append((100 + k, text))
    rows.append((900, "\n".join([" ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(1500)] + [shared])))
    rows += [(901, rows[10][1]), (902, rows[10][1]), (902, rows[10][1])]
    return rows


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(rows, num=75, den=100):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets))
