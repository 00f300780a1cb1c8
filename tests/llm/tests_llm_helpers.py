"""Brute-force versions of what the operators compute."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import xxhash


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute_base(rows):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(w for i, t in rows if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}


def brute_links(rows):
    vec = [np.array(e, np.float32).astype(float) if e is not None and label is not None and any(e) else None for _, e, label in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and vec[i] is not None and vec[j] is not None and rows[i][2] == rows[j][2] and vec[i] @ vec[j] / np.sqrt((vec[i] @ vec[i]) * (vec[j] @ vec[j])) >= 0.98] for i in range(n)]
    part = [r[0] for r in rows]
    for _ in range(n):
        part = [min([part[i], *(part[j] for j in near[i])]) for i in range(n)]
    return [(rows[i][0], len(near[i]), part[i], rows[i][0] == part[i]) for i in range(n)]


def brute_fp(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", raw) if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def brute_components(prints, distance=3):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            for j in range(len(prints)):
                if (prints[i] ^ prints[j]).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def brute_records(pages, least=100):
    first, out = {}, []
    for i, h in sorted(pages):
        first.setdefault((h or "").encode(), i)
    for i, h in pages:
        raw = (h or "").encode()
        copy = len(raw) >= least and first[raw] != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if copy else "response", first[raw] if copy else None))
    return sorted(out, key=str)
