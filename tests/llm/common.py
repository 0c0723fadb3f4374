"""Small inputs with every awkward row, and brute-force versions of what the operators return."""

import hashlib
import random
import re
from collections import Counter

#: Further columns whose names the operators use inside.
EXTRA = "id long, raw string, node string, digest string, block int, maybe boolean, score double, lang_pred string, c0 string, y int, kept int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    rest = (7, "x", None, "d", 1, None, 0.5, "zz", "c", 3, 0)
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", None, *rest) for r in rows], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def invented(rnd, n, letters="abcdefgh"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 7))) for _ in range(n))


AWKWARD = [None, "", " \n\t ", "...", "a", "A b", "one two three four", "é 日本 𠀀 ﬁ", "x" * 5000, "\x00\x7f", "tab\tand nbsp em", "a  b   c\n\n d ", " lead", "trail ", "▁mark▁", "<|endoftext|> </s>"]


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    rows = [(k, t) for k, t in enumerate(AWKWARD)]
    base = [invented(rnd, rnd.randrange(8, 120)) for _ in range(n)]
    rows += [(100 + k, t) for k, t in enumerate(base)]
    for k in range(n // 2):  # near and exact copies
        w = rnd.choice(base).split()
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(len(w))] = "changed"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, base[0]) for k in range(20)]
    rows += [(100, base[0]), (100, base[0]), (5, "A b")]  # repeated rows
    rows.append((3000, invented(rnd, 20_000)))
    return rows


def bag(text, width=5):
    w = words(text)
    return Counter(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else None


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def brute_classes(rows, least=0.8):
    """Class (smallest id) of each row number."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and find(i) != find(j) and similarity(bags[i], bags[j]) >= least:
                root[find(i)] = find(j)
    smallest = {}
    for i, (k, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), k), k)
    return [smallest[find(i)] for i in range(len(rows))]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
