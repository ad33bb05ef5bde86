"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

import numpy as np

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def license_base(text: str | None, base: dict[str, str]):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))
    found = [(i, label) for phrase, label in base.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))


def substring_dedup(docs: list[tuple], window: int = 20) -> dict:
    """{(doc_id, text): (words, cut, digest)}; repeated rows are one document, a null id comes last."""
    rows = sorted({(d if d is not None else 1 << 62, t or "") for d, t in docs})
    first: dict[tuple, tuple] = {}
    for d, t in rows:
        w = space_words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = {}
    for d, t in rows:
        w, cut = space_words(t), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                cut.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in cut)
        out[d if d < 1 << 62 else None, t] = (len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest())
    return out


def _classes(n: int, links) -> list[int]:
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def shingles(text: str | None, n: int = 5) -> set:
    w = space_words((text or "").translate(ASCII_LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes_of(sets: list[set], percent: int = 80) -> list[int]:
    """The class of each set, as the place of its first."""
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return _classes(len(sets), links)


def jaccard(docs: list[tuple], n: int = 5, percent: int = 80) -> list[tuple]:
    """(doc_id, set size, component) a row."""
    sets = [shingles(t, n) for _, t in docs]
    classes = classes_of(sets, percent)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if classes[j] == classes[i] and docs[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return out


def cosine_links(rows: list[tuple], least: float = 0.9) -> list[tuple]:
    """(vec_id, links, component) a row."""

    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if good(v) else None for _, v in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least]
    classes = _classes(len(rows), links)
    degree = [sum(i in p for p in links) for i in range(len(rows))]
    return [(rows[i][0], degree[i], min(rows[j][0] for j in range(len(rows)) if classes[j] == classes[i])) for i in range(len(rows))]


def top_k(rows: list[tuple], k: int = 5, every: int = 50) -> list[tuple]:
    ints = {i: np.floor(256 * np.asarray(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ints if i % every == 0):
        best = sorted(((-int(ints[q] @ ints[i]), i) for i in ints if i != q))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out
