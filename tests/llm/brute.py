"""Plain single-machine versions of the operators, for small inputs."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remove_repeats(docs, length=50):
    """``docs``: (id, text); rows ``(id, bytes, removed, runs, sha256)``."""
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def shingle_set(text, size=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = WORD.findall(low)
    if 0 < len(w) < size:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def components(docs, size=5, percent=75):
    """``docs``: (id, text); rows ``(id, set size, smallest id of the component)``."""
    sets = [shingle_set(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index, common = collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for g in s:
            for j in index[g]:
                common[j, i] += 1
            index[g].append(i)
    for (a, b), m in common.items():
        if 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs))
