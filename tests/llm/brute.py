"""Plain-Python forms of the operators, and rows that try them: nulls, empty and long texts, ties, repeats, clashing names."""

import random

WORDS = [f"w{i}" for i in range(40)] + ["Été", "naïve", "straße"]


def documents(seed=0, n=60):
    """(doc_id, text) with copies, near copies, shared passages, one very long text, nulls, empties, repeated rows."""
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    shared = [line(12) for _ in range(6)]
    rows = []
    for i in range(n):
        lines = [line(rng.randint(0, 20)) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            at = rng.randint(0, len(lines))
            lines[at:at] = shared[: rng.randint(3, 6)]
        rows.append((i, "\n".join(lines)))
    base = line(200)
    for i in range(n, n + 12):  # near copies of one text
        words = base.split()
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(n + 20, rows[0][1]), (n + 21, rows[0][1]), (n + 22, None), (n + 23, ""), (n + 24, "\n\n\n\n"), (n + 25, line(5000)), (n + 26, "one two"), (n + 27, "one two"), (None, "a null id"), rows[3], rows[3]]
    rng.shuffle(rows)
    return rows
