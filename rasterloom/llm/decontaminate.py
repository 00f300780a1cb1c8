"""Benchmark decontamination: pigeonhole edit matching.

Texts are compared with folded case and every run of other than letters and digits as one space. A test item of n characters
may differ by k = SHARE * n edits. It is split into k + 1 pieces, one of which must then occur exactly; an Aho-Corasick
automaton finds all pieces of a block of items in one walk over a text. A hit is verified hierarchically: of the nodes over
the hit's piece, one with l pieces must match within l - 1 edits, so pairs of pieces are tried first and chance hits end
there; the root decides on the whole item. All distances are Myers' bit-parallel ones, on whole-pattern bit vectors.

Items are never gathered beyond a block: blocks hold about BLOCK_CHARS characters, chosen by hash, and each goes over all
documents.

Defined cases: null texts are empty; items without letters or digits match nothing; items of every length follow the one
rule for k, so those of under 1 / SHARE characters have no edits: they match on word bounds inside texts or, with
inside=False, only whole texts; items with equal texts each give their rows; an
occurrence is a row, overlapping ones too, but of those that begin within the item's budget of each other only the one of
least distance, then of least start, then of least end; very long texts are walked whole; a null id is kept as null; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from math import ceil

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import kept, slices

#: Edits allowed, as a share of an item's characters.
SHARE = 0.1
#: About so many characters of items are held by a task at once.
BLOCK_CHARS = 400_000
OTHER = re.compile(r"[\W_]+")
SCHEMA = "doc_id long, item_id long, start long, end long, distance int"


def normal(text: str) -> str:
    return OTHER.sub(" ", text.casefold()).strip()


def places(text: str) -> list[int]:
    """For each character of normal(text), where it stands in text; one more entry for the end."""
    lowered: list[int] = []
    for i, ch in enumerate(text):
        lowered += [i] * len(ch.casefold())
    low = text.casefold()
    out, at, stop = [], 0, len(low)
    for m in OTHER.finditer(low):
        out += lowered[at : m.start()]
        if m.start() and m.end() < stop:
            out.append(lowered[m.start()])
        at = m.end()
    out += lowered[at:]
    out.append(out[-1] + 1 if out else 0)
    return out


class Pattern:
    """Myers' bit vectors of a string: edit distances of it against all substrings' ends of a text."""

    __slots__ = ("masks", "size")

    def __init__(self, pattern: str):
        self.size = len(pattern)
        self.masks: dict[str, int] = {}
        for i, ch in enumerate(pattern):
            self.masks[ch] = self.masks.get(ch, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(least distance to any substring, end of the first that has it)."""
        full = (1 << self.size) - 1
        top = 1 << (self.size - 1)
        pv, mv, score = full, 0, self.size
        best, end = score, 0
        masks = self.masks
        for j, ch in enumerate(text, 1):
            eq = masks.get(ch, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ph << 1 & full
            pv = (mh << 1 & full) | (full & ~(xv | ph))
            mv = ph & xv
            if score < best:
                best, end = score, j
        return best, end


class Item:
    def __init__(self, text: str, share: float):
        self.text, n = text, len(text)
        self.budget = int(n * share)
        leaves = self.budget + 1
        self.cuts = [j * n // leaves for j in range(leaves + 1)]
        self.nodes: dict[tuple[int, int], tuple[Pattern, int, int, int]] = {}

    def node(self, low: int, high: int) -> tuple[Pattern, int, int, int]:
        """Of the leaves from low to high: bit vectors, place in the item, budget."""
        if (low, high) not in self.nodes:
            a, b = self.cuts[low], self.cuts[high]
            self.nodes[low, high] = (Pattern(self.text[a:b]), a, b, high - low - 1)
        return self.nodes[low, high]

    def verify(self, text: str, diagonal: int, leaf: int) -> tuple[int, int, int] | None:
        """(start, end, distance) of an occurrence whose piece leaf lies on the diagonal, or None."""
        leaves, width = self.budget + 1, 1
        while width < leaves:
            width *= 2
            low = leaf // width * width
            high = min(leaves, low + width)
            pattern, a, b, allowed = self.node(low, high)
            begin = max(0, diagonal + a - allowed)
            distance, end = pattern.best(text[begin : max(0, diagonal + b + allowed)])
            if distance > allowed:
                return None
        if leaves == 1:
            return diagonal, diagonal + len(self.text), 0
        # backwards from the end, for the start
        back = text[max(0, begin + end - len(self.text) - self.budget) : begin + end][::-1]
        _, length = Pattern(self.text[::-1]).best(back)
        return begin + end - length, begin + end, distance


def apart(spans: set[tuple[int, int, int]], budget: int) -> list[tuple[int, int, int]]:
    """Of spans (start, end, distance) that begin within budget of each other, the one of least distance, then start, then
    end; spans may overlap."""
    starts: list[int] = []
    kept = []
    for span in sorted(spans, key=lambda s: (s[2], s)):
        at = bisect_left(starts, span[0] - budget)
        if at == len(starts) or starts[at] > span[0] + budget:
            insort(starts, span[0])
            kept.append(span)
    return sorted(kept)


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int | None, str]], share: float, inside: bool = False):
        by_text = defaultdict(list)
        for ident, text in items:
            if text:
                by_text[text].append(ident)
        self.whole = {t: ids for t, ids in by_text.items() if not int(len(t) * share) and not inside}
        self.items = [(Item(t, share), ids) for t, ids in by_text.items() if t not in self.whole]
        pieces = defaultdict(list)
        for k, (item, _) in enumerate(self.items):
            for leaf, (a, b) in enumerate(zip(item.cuts[:-1], item.cuts[1:], strict=True)):
                pieces[item.text[a:b]].append((k, leaf, a))
        self.automaton = ahocorasick.Automaton() if pieces else None
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, start, end, distance) of the occurrences in a normalised text."""
        out = [(i, 0, len(text), 0) for i in self.whole.get(text, ())]
        if not self.automaton:
            return out
        tried: dict[tuple[int, int], int] = {}  # (item, diagonal): its pieces that failed, -1 once one was verified
        found: dict[int, set[tuple[int, int, int]]] = {}
        for last, (length, where) in self.automaton.iter(text):
            for k, leaf, offset in where:
                item, diagonal = self.items[k][0], last + 1 - length - offset
                if not item.budget and (text[max(0, diagonal - 1) : diagonal].strip() or text[last + 1 : last + 2].strip()):
                    continue
                # the whole item's distance on a diagonal is the same whichever piece hit it
                if tried.get((k, diagonal), 0) >> leaf & 1:
                    continue
                got = item.verify(text, diagonal, leaf)
                tried[k, diagonal] = -1 if got else tried.get((k, diagonal), 0) | 1 << leaf
                if got:
                    found.setdefault(k, set()).add(got)
        for k, spans in found.items():
            out += [(i, *span) for i in self.items[k][1] for span in apart(spans, self.items[k][0].budget)]
        return out


def _matcher(shared, share: float, inside: bool) -> Matcher:
    return kept(f"matcher {share} {inside}", shared, lambda items: Matcher(items, share, inside))


def _matches(docs: DataFrame, items: list[tuple[int | None, str]], share: float, inside: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)  # a block, of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, share, inside)
        for batch in slices(batches):
            rows = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = matcher.find(normal(text or ""))
                if found:
                    at = places(text or "")
                    rows += [(ident, item, at[a], at[b - 1] + 1 if b else 0, d) for item, a, b, d in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int32() if k == 4 else pa.int64()) for k in range(5)], ["doc_id", "item_id", "start", "end", "distance"])

    return docs.mapInArrow(run, SCHEMA)


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, ceil(total / block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield [(r.item_id, normal(r.text)) for r in items.where(block == k).collect()]


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block_chars: int = BLOCK_CHARS, inside: bool = True) -> DataFrame:
    """(doc_id, item_id, start, end, distance): where items occur in documents, in characters of the text; of occurrences
    that begin within an item's budget of each other the best one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return reduce(DataFrame.unionByName, [_matches(docs, items, share, inside) for items in _blocks(benchmark, block_chars)])


def _without(docs: DataFrame, items: list[tuple[int | None, str]], share: float, inside: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, share, inside)
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([not matcher.find(normal(t or "")) for t in texts]))

    return docs.mapInArrow(run, docs.schema)


def clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, block_chars: int = BLOCK_CHARS, inside: bool = True) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item."""
    return reduce(lambda rows, items: _without(rows, items, share, inside), _blocks(benchmark, block_chars), docs)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), inside=True)
