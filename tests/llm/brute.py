"""Plain versions of the operators over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from math import log10

import xxhash


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def fingerprint(text: str | None, k: int = 4) -> int:
    w = words((text or ""))
    w = [x.lower() for x in w]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list, near) -> dict:
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and near(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def dedup_lines(docs: list, least_chars: int = 20, least_docs: int = 3) -> dict:
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").encode().lower().decode()

    where = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            where[key(line)].add(i)
    out = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least_chars and len(where[key(x)]) >= least_docs and max(where[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept).encode()))
    return out


def base_counts(text: str | None) -> tuple:
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def unigram(docs: list) -> dict:
    tokens = {i: [*words(t), None] for i, t in docs}
    tokens = {i: [x.lower() if x else x for x in w] for i, w in tokens.items()}
    out_of = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    c = Counter(x for i, w in tokens.items() if not out_of[i] for x in w)
    n, v = sum(c.values()), len(c)
    return {i: (out_of[i], len(w), sum(c[x] > 0 for x in w), n, sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in tokens.items()}


def substrings(docs: list, size: int = 50) -> dict:
    first: dict = {}
    for i, text in docs:
        w = words(text)
        for a in range(len(w) - size + 1):
            k = tuple(w[a : a + size])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = set()
        for a in range(len(w) - size + 1):
            if first[tuple(w[a : a + size])] < i:
                gone |= set(range(a, a + size))
        out[i] = (len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out
