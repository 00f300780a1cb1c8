import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rasterloom.llm import collocations
from rasterloom.llm.collocations import Trie

DOCS = "doc_id long, text string, lang string, word string, n string"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def brute(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        able = {p for p in c if len(p) > 1 and c[p] >= least}
        rest = []
        for p in able:
            if len(p) == 2 and any(100 * c[q] >= 50 * c[p] for q in able if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, left, right = min((1_000_000 * c[p] ** 2 // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rest.append((-score, -c[p], " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rest)[:top])]
    return sorted(out)


def rows():
    rnd = random.Random(6)
    words = ["a", "B", "of", "The", "naïve", "漢字", "x-1", "don't", "\x00", "q" * 200] + [f"w{k}" for k in range(12)]
    say = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ", ", ".\n", "! ", "\r"]) for _ in range(rnd.randint(0, 80)))
    docs = [(k, say() + rnd.choice(["new york city ", "hot dog. ", ""]) * rnd.randint(0, 3), rnd.choice(["en", "de", "und", None, ""])) for k in range(250)]
    docs += [(None, None, "en"), (1, "", None), (2, " .,\n", "xx"), (900, "tick tock " * 20_000, "en"), (901, "z" * 100_000, "en"), docs[0], docs[0]]
    return [(*d, "w", "n") for d in docs]


@pytest.mark.parametrize("run", ["whole", "split"])
def test_against_brute_force(spark, monkeypatch, run):
    if run == "split":
        monkeypatch.setattr(collocations, "RANGE_BYTES", 2000)  # bounds in the middle of common words and pairs
    for parts, top in ((1, 2000), (6, 5)):
        got = collocations.collocations(spark.createDataFrame(rows(), DOCS).repartition(parts), top=top)
        assert sorted(map(tuple, got.collect())) == brute(rows(), top=top)


def test_query(spark, tmp_path):
    spark.createDataFrame(rows(), DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, collocations.op13_collocations(spark, str(tmp_path)).collect())) == brute(rows())


def nodes(trie):
    """(path, count) of each node in order."""
    out, path = [], []
    for d, w, c in zip(trie.depth.tolist(), trie.last.tolist(), trie.count.tolist(), strict=True):
        path = [*path[: d - 1], trie.names[w]]
        out.append((tuple(path), c))
    return out


def test_trie_and_its_cuts():
    texts = [r[1] for r in rows()][:60]
    trie = Trie(pa.array(texts), pa.array(["en"] * len(texts)))
    want = Counter()
    for t in texts:
        for w in pieces(t):
            for k in (1, 2, 3):
                want.update(tuple((b"en", x.encode()) for x in w[i : i + k]) for i in range(len(w) - k + 1))
    got = nodes(trie)
    assert dict(got) == want and len(got) == len(want)
    number = {n: int(h) for n, h in zip(trie.names, trie.words, strict=True)}
    paths = [tuple(number[n] for n in p) for p, _ in got]
    assert paths == sorted(paths)
    rnd = random.Random(2)
    bounds = sorted({tuple((*rnd.choice(paths), 0, 0)[:3]) for _ in range(40)} | {tuple(rnd.choice([0, 1, 1 << 63, *rnd.choice(paths)[:1]]) for _ in range(3)) for _ in range(40)})
    bounds = [b if b[1] else (b[0], 0, 0) for b in bounds]
    cuts = trie.cuts(np.array(bounds, np.uint64).reshape(-1, 3))
    assert cuts.tolist() == [sum((*p, 0, 0)[:3] < b for p in paths) for b in bounds]


def test_parts_add_up_again():
    texts = [r[1] for r in rows()][:40]
    trie = Trie(pa.array(texts), pa.array([None] * len(texts), pa.string()))
    batch = collocations._merged(7, [trie.part(0, len(trie.depth))] * 2, 1).to_pylist()
    assert [r["f"] for r in batch if r["depth"]] == (2 * trie.count).tolist()
    assert sum(r["f"] for r in batch if not r["depth"]) == 2 * int(trie.count[trie.depth == 1].sum()) and {r["lang"] for r in batch} == {"und"}
