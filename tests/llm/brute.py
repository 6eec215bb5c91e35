"""Brute-force versions of the corpus operators, for small fixtures."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def _id(doc_id):
    return LAST if doc_id is None else doc_id


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _covered(windows: list, first: dict, own: int, width: int, n: int) -> list[bool]:
    gone = [False] * n
    for s, w in enumerate(windows):
        if first[w] < own:
            gone[s:s + width] = [True] * width
    return gone


def remove_words(docs, window=50):
    """(doc_id, n_words, n_removed, kept_sha256) per row of [(doc_id, text)]."""
    words = [WORDS.findall(t or "") for _, t in docs]
    wins = [[tuple(w[i:i + window]) for i in range(len(w) - window + 1)] for w in words]
    first: dict = {}
    for (d, _), ws in zip(docs, wins):
        for w in ws:
            first[w] = min(first.get(w, LAST), _id(d))
    out = []
    for (d, _), w, ws in zip(docs, words, wins):
        gone = _covered(ws, first, _id(d), window, len(w))
        out.append((d, len(w), sum(gone), _sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def remove_bytes(docs, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of [(doc_id, text)]."""
    data = [(t or "").encode() for _, t in docs]
    wins = [[b[i:i + length] for i in range(len(b) - length + 1)] for b in data]
    first: dict = {}
    for (d, _), ws in zip(docs, wins):
        for w in ws:
            first[w] = min(first.get(w, LAST), _id(d))
    out = []
    for (d, _), b, ws in zip(docs, data, wins):
        gone = _covered(ws, first, _id(d), length, len(b))
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((d, len(b), sum(gone), spans, _sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def vectors(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) per row of [(vec_id, vector, label)]."""
    def sound(v, label):
        return (label is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)
                and any(x != 0 for x in v))

    unit = []
    for _, v, label in rows:
        if sound(v, label):
            x = np.array(v, float)
            x = x / np.abs(x).max()
            unit.append(x / np.linalg.norm(x))
        else:
            unit.append(None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None
              and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
             for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        stack, comp = [i], {i}
        while stack:
            for j in links[stack.pop()]:
                if j not in comp:
                    comp.add(j)
                    stack.append(j)
        seen |= comp
        ids = [rows[j][0] for j in comp if rows[j][0] is not None]
        least = min(ids) if ids else None
        for j in comp:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] == least)
    return out


def aligned_share(a: list, b: list) -> float:
    """Longest common subsequence of words over the longer length."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            here = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = here
    return row[-1] / max(len(a), len(b))


def near_groups(docs, threshold=0.8):
    """Smallest id of each document's group, from all pairs of [(doc_id, text)]."""
    words = [[w.lower() for w in WORDS.findall(t or "")] for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            long = max(len(words[i]), len(words[j]), 1)
            if words[i] != words[j] and min(len(words[i]), len(words[j])) < threshold * long - 1e-9:
                continue
            if words[i] == words[j] or set(words[i]) & set(words[j]) and aligned_share(words[i], words[j]) >= threshold - 1e-9:
                root[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(docs)}
