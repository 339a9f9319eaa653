"""Plain versions of the operators, for small inputs."""

import collections
import itertools

BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return (text or "").encode().lower().split()


def shingles(tokens, size=5):
    return frozenset(tuple(tokens[i:i + size]) for i in range(max(1, len(tokens) - size + 1))) if tokens else frozenset()


def alike(a, b, percent=75):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= percent * (len(a) + len(b) - both)


def groups(sets):
    """Index of the smallest member of each one's component."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if alike(sets[a], sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def components(rows):
    """component_id of each (id, text)."""
    sets = [shingles(words(t)) for _, t in rows]
    root = groups(sets)
    ids = collections.defaultdict(list)
    for (i, _), r in zip(rows, root):
        if i is not None:
            ids[r].append(i)
    return [min(ids[r]) if ids[r] else None for r in root]


def paragraphs(rows, min_words):
    """(row, paragraph, shingle set) of the long lines."""
    return [(n, i, shingles(words(line))) for n, (_, t) in enumerate(rows) for i, line in enumerate((t or "").split("\n")) if len(words(line)) >= min_words]


def bag_likeness(a, b):
    a, b = collections.Counter(words(a)), collections.Counter(words(b))
    if not a and not b:
        return 1.0
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys)
