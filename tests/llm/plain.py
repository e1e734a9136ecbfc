"""Plain versions of the operators that SQL cannot check at every size: no Spark, no index, all pairs or all windows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
A_TO_Z = {ord(x): ord(x) + 32 for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def without_repeats(rows, width):
    """(doc_id, n_bytes, n_removed, n_spans, sha) per (doc_id, text), from the counts of all windows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + width] for _, b in texts for p in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = b"\x01" * width
        left = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for p in range(len(b)) if gone[p] and not (p and gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def ranked(rows, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    docs = [(i, Counter(TERMS.findall((t or "").translate(A_TO_Z)))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(x for _, c in docs for x in c)
    out = []
    for item, text in items:
        terms = set(TERMS.findall((text or "").translate(A_TO_Z)))
        found = []
        for i, c in docs:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((10**9 * c[x]) // (1000 * c[x] + 20 * m)) for x in terms if c[x])
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (score, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.append((item, rank, i, -score))
    return out


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + 1 :] == b[p + 1 :] or a[p + 1 :] == b[p:] or a[p:] == b[p + 1 :]


def damaged(rows, least=7, every=31):
    words = Counter()
    for i, t in rows:
        for run in LETTERS.findall(t or ""):
            run = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                words[run] += 1
    return words


def spellings(words, least_count=2, factor=10):
    """(word, form, root, n, n_near, form_n): candidates share the text around one place, each is compared."""
    words = {w: n for w, n in words.items() if n >= least_count}
    around = defaultdict(set)
    for w in words:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            around[x].add(w)
    near = defaultdict(set)
    for group in around.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= factor * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out
