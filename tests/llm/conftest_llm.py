"""Direct computations that the operators are compared with."""

import hashlib
import re
from collections import defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows, least):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    has = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            has[key(line)].add(d)
    hot = {k for k, v in has.items() if len(v) >= least and k}
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in hot]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def brute_words(rows, n):
    first, cut = {}, {d: re.findall(r"[^\x20\x09-\x0d]+", t or "") for d, t in rows}
    for d in sorted(cut):
        for i in range(len(cut[d]) - n + 1):
            first.setdefault(tuple(cut[d][i:i + n]), d)
    out = {}
    for d, w in cut.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < d:
                gone.update(range(i, i + n))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def brute_bytes(rows, n):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            s = raw[i:i + n]
            if s in seen:
                gone[i:i + n] = b"\1" * n
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def jaccard_sets(rows, k):
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        out[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    return out


def merge(ids, links):
    head = {i: i for i in ids}

    def root(i):
        while head[i] != i:
            i = head[i]
        return i
    for a, b in links:
        a, b = root(a), root(b)
        head[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
