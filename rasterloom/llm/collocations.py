"""Phrase collocations: count tries of runs of texts, serialised in order and merged by ranges of prefixes.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words ``[^\\x20\\x09]+``. A task counts the
words, pairs and triples of a run of texts in a trie of depth 3, whose nodes lie in order of their words' hashes (64 bits
of language and word, so that each language has words of its own). The trie is cut at global bounds, phrases that a sample
spaces evenly, and each part goes as compressed arrays (depth, word, count; the path to its first node in front) to the
task that merges its range. Bounds are whole phrases, so a common first word or pair spans as many ranges as it needs.

A merging task lays the parts of a range one after another, sorts them stably (runs are in order already) and adds counts
up. Phrases that occur ``LEAST`` times stay; all their parts occur as often. A walk along the merged trie gives each
phrase's left parts, which are its ancestors; those that an earlier range holds, two a range at most, come from a table as
long as there are ranges. Suffix links give the right parts: a pair joins its second word, a triple joins the pair of its
last two words, which knows its own link. Arithmetic is exact (decimals). Ranks come from range partitions.

Defined cases: a null text is empty, a null lang is ``und`` (one with rows that say so); very long texts, pieces and words
count whole; texts without words give nothing; ties in score and count go by the phrase's bytes; repeated rows count again;
an empty table gives none; other columns, whatever their names, are ignored. Two words share a hash with a chance of
V^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, discard, give_back, slices, utf8
from rasterloom.llm.ranking import ranked
from rasterloom.llm.resample import words_of

LEAST, TOP, INSIDE_PERCENT, SCALE = 10, 2000, 50, 1_000_000
#: Bytes of text whose trie a task holds, and whose phrases make a range.
RUN_BYTES, RANGE_BYTES = 8 << 20, 8 << 20
#: Bytes of text, and phrases for each range and at most, that set the bounds.
SAMPLE_BYTES, SAMPLE_EACH, SAMPLE_MOST = 8 << 20, 40, 1_000_000

WORD = np.ones(256, bool)
WORD[[9, 32]] = False
BREAK = np.zeros(256, bool)
BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
WORD[BREAK] = False

_NODE = "part int, depth int, h1 long, h2 long, h3 long, f long, l1 long, l2 long, lang string, word string"


def _rle(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[start], np.diff(np.r_[start, len(x)])


class Trie:
    """A run's phrases. words: hashes in order; names: (lang, word) of each; nodes in order of their paths as depth, last
    word and count; at: where the nodes of each depth lie."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, offsets = utf8(texts)
        text, told, starts = words_of(raw, offsets, WORD)
        lang = pc.fill_null(langs.cast(pa.string()), "und").dictionary_encode()
        spoken, n_langs = lang.indices.to_numpy(zero_copy_only=False), max(1, len(lang.dictionary))
        pair = told.indices.to_numpy().astype(np.int64) * n_langs + (spoken[text] if len(text) else 0)
        distinct, token = np.unique(pair, return_inverse=True)
        names = [(x.as_py().encode(), w) for x, w in zip(lang.dictionary.take(pa.array(distinct % n_langs)), told.dictionary.take(pa.array(distinct // n_langs)).to_pylist(), strict=True)]
        hashes = np.array([xxhash.xxh64_intdigest(b"%d:%b%b" % (len(a), a, w)) or 1 for a, w in names], np.uint64)
        order = np.argsort(hashes)
        self.words, self.names, self.size = hashes[order], [names[k] for k in order], len(order)
        rank = np.empty(self.size, np.int64)
        rank[order] = np.arange(self.size)
        token = rank[token]
        piece = np.cumsum(BREAK[raw], dtype=np.int32 if len(raw) < 1 << 31 else np.int64)[starts] if len(starts) else starts
        follows = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
        pairs = token[:-1] * self.size + token[1:]
        self.pairs, n2 = _rle(pairs[follows])
        both = follows[:-1] & follows[1:]
        if self.size < 1 << 21:
            found, n3 = _rle(pairs[:-1][both] * self.size + token[2:][both])
            self.triples = np.searchsorted(self.pairs, found // self.size) * self.size + found % self.size
        else:
            self.triples, n3 = _rle(np.searchsorted(self.pairs, pairs[:-1][both]) * self.size + token[2:][both])
        # a node's place: those of its own depth before it, and those of the others
        under = np.searchsorted(self.triples, np.arange(len(self.pairs) + 1) * self.size)
        below = np.searchsorted(self.pairs, np.arange(self.size + 1) * self.size)
        second, first = self.triples // max(1, self.size), self.pairs // max(1, self.size)
        self.under, self.at = under, [
            np.arange(self.size) + below[:-1] + under[below[:-1]],
            np.arange(len(self.pairs)) + first + 1 + under[:-1],
            np.arange(len(self.triples)) + second + first[second] + 2,
        ]
        n = sum(map(len, self.at))
        self.depth, self.last, self.count = np.empty(n, np.uint8), np.empty(n, np.uint32), np.empty(n, np.uint32)
        n1 = np.bincount(token, minlength=self.size)
        for d, last, count in ((0, np.arange(self.size), n1), (1, self.pairs % max(1, self.size), n2), (2, self.triples % max(1, self.size), n3)):
            self.depth[self.at[d]], self.last[self.at[d]], self.count[self.at[d]] = d + 1, last, count

    def cuts(self, bounds: np.ndarray) -> np.ndarray:
        """How many nodes come before each bound (n x 3 hashes, 0 where a phrase has ended)."""
        i1, i2, i3 = (np.searchsorted(self.words, bounds[:, k]) for k in range(3))
        has = lambda i, k: (i < self.size) & (self.words[np.minimum(i, self.size - 1)] == bounds[:, k])
        in1, more1, more2 = has(i1, 0), bounds[:, 1] > 0, bounds[:, 2] > 0
        singles = i1 + (in1 & more1)
        key = i1 * self.size + np.where(in1 & more1, i2, 0)
        j = np.searchsorted(self.pairs, key)
        in2 = in1 & more1 & has(i2, 1) & (j < len(self.pairs))
        if len(self.pairs):
            in2 &= self.pairs[np.minimum(j, len(self.pairs) - 1)] == key
        triples = np.where(in2 & more2, np.searchsorted(self.triples, j * self.size + i3), self.under[j])
        return singles + j + (in2 & more2) + triples

    def path(self, place: int) -> list[int]:
        """The last words of a node's ancestors, from the top."""
        above = []
        for d in range(int(self.depth[place]) - 1):
            above.append(int(self.last[self.at[d][np.searchsorted(self.at[d], place) - 1]]))
        return above

    def part(self, begin: int, end: int) -> bytes:
        """Nodes as compressed arrays, ancestors of the first one in front with count 0, names of the words at depth 1."""
        above = self.path(begin)
        last = np.concatenate([np.array(above, np.uint32), self.last[begin:end]])
        depth = np.concatenate([np.arange(1, len(above) + 1, dtype=np.uint8), self.depth[begin:end]])
        count = np.concatenate([np.zeros(len(above), np.uint32), self.count[begin:end]])
        used, local = np.unique(last, return_inverse=True)
        names = [x for k in last[(depth == 1) & (count > 0)].tolist() for x in self.names[k]]
        return packed(self.words[used], depth, local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), count.astype(np.uint8 if count.max(initial=0) < 256 else np.uint32), np.array(list(map(len, names)), np.uint32), np.frombuffer(b"".join(names), np.uint8))


def packed(*arrays: np.ndarray) -> bytes:
    head = np.array([x for a in arrays for x in (a.itemsize, len(a))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.int64(len(arrays)).tobytes(), head.tobytes(), *(a.tobytes() for a in arrays)]))


def unpacked(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 + 16 * n, []
    for size, length in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(-1, 2).tolist():
        out.append(np.frombuffer(raw, f"u{size}", length, at))
        at += size * length
    return out


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[Trie]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in chain(slices(batches, most=RUN_BYTES // 2), [None]):
        if batch is not None:
            held.append(batch)
            size += batch.column("text").nbytes
        if held and (batch is None or size >= RUN_BYTES):
            table = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            trie = Trie(table.column("text").combine_chunks(), table.column("lang").combine_chunks())
            if trie.size:
                yield trie
            del table, trie
            give_back()


def _sampled(step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every step-th phrase of the tries, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trie in _tries(batches):
            picked = range(step // 2, len(trie.depth), step)
            paths = [[*trie.path(p), int(trie.last[p])] for p in picked]
            keys = np.array([[int(trie.words[k]) for k in p] + [0] * (3 - len(p)) for p in paths], np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, k]) for k in range(3)], names=["h1", "h2", "h3"])

    return run


def bounds_of(docs: DataFrame, parts: int, size: int) -> np.ndarray:
    """Bounds between about so many ranges, from a sample of texts: parts - 1 x 3 hashes in order."""
    share = min(1.0, max(SAMPLE_BYTES, size >> 10) / max(1, size))
    wanted = min(SAMPLE_EACH * parts, SAMPLE_MOST)
    step = max(1, int(share * size / 4 / wanted))
    rows = docs.sample(share, 13).mapInArrow(_sampled(step), "h1 long, h2 long, h3 long").toArrow()
    keys = np.column_stack([rows.column(k).to_numpy() for k in range(3)]).astype(np.int64).view(np.uint64)
    keys = keys[np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))]
    return np.unique(keys[[k * len(keys) // parts for k in range(1, parts)]], axis=0) if len(keys) else keys


def _dealt(bounds: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for trie in _tries(batches):
            cuts = np.r_[0, trie.cuts(bounds), len(trie.depth)].tolist()
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([trie.part(a, b)], pa.binary())], names=["part", "trie"])

    return run


def _merged(part: int, blobs: list[bytes], least: int) -> pa.RecordBatch:
    """A range's tries added up: frequent phrases with their left parts, and (depth 0) each language's words."""
    tries = [unpacked(b) for b in blobs]
    words = np.unique(np.concatenate([t[0] for t in tries]))
    keys, counts, depths, names = [], [], [], []
    for vocabulary, depth, local, count, lengths, text in tries:
        last = np.searchsorted(words, vocabulary)[local]
        place = np.arange(len(depth))
        above = [last[np.maximum.accumulate(np.where(depth == d, place, 0))] for d in (1, 2)]
        path = np.stack([above[0], np.where(depth >= 2, above[1] + 1, 0), np.where(depth == 3, last + 1, 0)])
        keep = count > 0
        keys.append(path[:, keep])
        counts.append(count[keep].astype(np.int64))
        depths.append(depth[keep])
        names.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths, dtype=np.int64)]), pa.py_buffer(text)]))
    path, count, depth = np.concatenate(keys, axis=1), np.concatenate(counts), np.concatenate(depths)
    del tries, keys, counts, depths
    name = pa.concat_arrays(names)
    named = np.cumsum(depth == 1) - 1
    base = len(words) + 1
    key = path[0] * base + path[1]
    if base >= 1 << 21:
        key = np.unique(key, return_inverse=True)[1]
    key = key * base + path[2]
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    f = np.add.reduceat(count[order], start)
    spoken = pc.dictionary_encode(name.take(pa.array(named[depth == 1] * 2)))
    per_lang = np.bincount(spoken.indices.to_numpy(), count[depth == 1]).astype(np.int64)
    at = order[start[f >= least]]
    f, path, depth, named = f[f >= least], path[:, at], depth[at], named[at]
    place = np.arange(len(at))
    top, middle = (np.maximum.accumulate(np.where(depth == d, place, -1)) for d in (1, 2))
    has_top = (top >= 0) & (path[0][top] == path[0]) if len(at) else top >= 0
    has_middle = (depth == 3) & (middle >= 0) & (path[0][middle] == path[0]) & (path[1][middle] == path[1]) if len(at) else top >= 0
    known = lambda k: name.take(pa.array(np.where(has_top, named[top] * 2 + k, 0), mask=~has_top)) if len(at) else pa.array([], pa.large_binary())
    h = [np.where(path[k] > 0, words[path[k] - 1], 0).view(np.int64) for k in (1, 2)]
    empty = [None] * len(per_lang)
    columns = [
        pa.array([part] * (len(at) + len(empty)), pa.int32()), pa.array(np.r_[depth, np.zeros(len(empty))].astype(np.int32)),
        *(pa.array(np.r_[x, np.zeros(len(empty), np.int64)]) for x in (words[path[0]].view(np.int64), *h)), pa.array(np.r_[f, per_lang]),
        pa.concat_arrays([pa.array(f[top] if len(at) else f, pa.int64(), mask=~has_top | (depth == 1)), pa.array(empty, pa.int64())]), pa.concat_arrays([pa.array(f[middle] if len(at) else f, pa.int64(), mask=~has_middle), pa.array(empty, pa.int64())]),
        pa.concat_arrays([known(0), spoken.dictionary]).cast(pa.string()), pa.concat_arrays([known(1), pa.array(empty, pa.large_binary())]).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _NODE.split(", ")])


def _ranges(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parts in order of their ranges, one range held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("trie"), strict=True):
                if part != now and held:
                    yield _merged(now, held, least)
                    held = []
                    give_back()
                now = part
                held.append(blob.as_py())
        if held:
            yield _merged(now, held, least)

    return run


def phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All words, pairs and triples of docs (lang, text) that occur often enough, as rows of _NODE with their left parts, and
    rows of depth 0 whose f add up to a language's words."""
    spark = docs.sparkSession
    docs = docs.select("lang", "text").where("text is not null")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES + 1)
    bounds = bounds_of(docs, parts, size)
    dealt = docs.mapInArrow(_dealt(bounds), "part int, trie binary").repartition(parts, "part").sortWithinPartitions("part")
    nodes = cut(dealt.mapInArrow(_ranges(least), _NODE), "nodes")
    if not len(bounds):
        return nodes
    # what ranges begin in the middle of: their bounds' ancestors
    ends = spark.createDataFrame([(k + 1, *map(int, b.view(np.int64)[:2])) for k, b in enumerate(bounds)], "part int, h1 long, h2 long")
    tops = nodes.where("depth = 1").join(F.broadcast(ends.select(F.col("part").alias("_part"), "h1")), "h1").select("_part", F.col("f").alias("_l1"), F.col("lang").alias("_lang"), F.col("word").alias("_word"))
    middles = nodes.where("depth = 2").join(F.broadcast(ends.select(F.col("part").alias("_part"), "h1", "h2")), ["h1", "h2"]).select("_part", F.col("f").alias("_l2"))
    front = tops.join(middles, "_part", "left").withColumnRenamed("_part", "part")
    filled = lambda name, least_depth: F.when(F.col("depth") >= least_depth, F.coalesce(name, f"_{name}")).otherwise(F.col(name)).alias(name)
    return nodes.join(F.broadcast(front), "part", "left").select("depth", "h1", "h2", "h3", "f", filled("l1", 2), filled("l2", 3), filled("lang", 2), filled("word", 2))


def _score(a: str, left: Column, right: Column) -> Column:
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best pairs and triples by their weakest cut, without those
    that a longer candidate holds and that occur in at least inside percent of its own occurrences there."""
    found = phrases(docs, least)
    words = found.where("depth = 1").select(F.col("h1").alias("h2"), F.col("f").alias("r"), F.col("word").alias("next"))
    pairs = found.where("depth = 2").drop("depth", "h3", "l2").join(words, "h2").select("h1", "h2", "lang", F.col("f").alias("a"), "l1", "r", F.concat_ws(" ", "word", "next").alias("phrase"))
    pairs = cut(pairs, "pairs")
    links = pairs.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("r1"), F.col("r").alias("r2"), F.col("phrase").alias("next"))
    triples = found.where("depth = 3").drop("depth").join(links, ["h2", "h3"]).select("h1", "h2", "h3", "lang", F.col("f").alias("a"), F.concat_ws(" ", "word", "next").alias("phrase"), F.struct(_score("f", F.col("l1"), F.col("r1")).alias("score"), F.lit(1).alias("k"), F.col("l1").alias("l"), F.col("r1").alias("r")).alias("one"), F.struct(_score("f", F.col("l2"), F.col("r2")).alias("score"), F.lit(2).alias("k"), F.col("l2").alias("l"), F.col("r2").alias("r")).alias("two"))
    triples = cut(triples.withColumn("cut", F.least("one", "two")).select("h1", "h2", "h3", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "triples")
    around = triples.select("h1", "h2", "a").unionByName(triples.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a")).groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    pairs = pairs.join(around, ["h1", "h2"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    both = pairs.select("lang", "phrase", "a", F.col("l1").alias("l"), "r", _score("a", F.col("l1"), F.col("r")).alias("score")).unionByName(triples.drop("h1", "h2", "h3"))
    total = found.where("depth = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    best = ranked(both, [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], "lang").where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SPLIT = r"""with pieces as (select coalesce(lang, 'und') as lang, doc, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\f\r]')) as piece from (select lang, row_number() over () as doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents)),
w as (select lang, regexp_extract_all(piece, '[^ \t]+') as w from pieces),
t as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
g as (select lang, w[i] as p1, w[i + 1] as p2, w[i + 2] as p3 from t),"""
ORACLE_SQL = f"""{_SPLIT}
f1 as (select lang, p1, count(*)::hugeint as f from g group by all), f2 as (select lang, p1, p2, count(*)::hugeint as f from g where p2 is not null group by all), f3 as (select lang, p1, p2, p3, count(*)::hugeint as f from g where p3 is not null group by all having count(*) >= {LEAST}),
n as (select lang, sum(f)::bigint as n from f1 group by lang),
c2 as (select f2.lang, f2.p1, f2.p2, f2.f as a, x.f as l, y.f as r, 1000000 * f2.f * f2.f // (x.f * y.f) as score from f2 join f1 x on x.lang = f2.lang and x.p1 = f2.p1 join f1 y on y.lang = f2.lang and y.p1 = f2.p2 where f2.f >= {LEAST}),
c3 as (select f3.lang, f3.p1, f3.p2, f3.p3, f3.f as a, x.f as l1, yz.f as r1, xy.f as l2, z.f as r2, 1000000 * f3.f * f3.f // (x.f * yz.f) as s1, 1000000 * f3.f * f3.f // (xy.f * z.f) as s2 from f3 join f1 x on x.lang = f3.lang and x.p1 = f3.p1 join f2 yz on yz.lang = f3.lang and yz.p1 = f3.p2 and yz.p2 = f3.p3 join f2 xy on xy.lang = f3.lang and xy.p1 = f3.p1 and xy.p2 = f3.p2 join f1 z on z.lang = f3.lang and z.p1 = f3.p3),
o as (select lang, p1, p2, max(a) as longer from (select lang, p1, p2, a from c3 union all select lang, p2, p3, a from c3) group by all),
c as (select c2.lang, c2.p1 || ' ' || c2.p2 as phrase, a, l, r, score from c2 left join o on o.lang = c2.lang and o.p1 = c2.p1 and o.p2 = c2.p2 where longer is null or 100 * longer < {INSIDE_PERCENT} * a
union all select lang, p1 || ' ' || p2 || ' ' || p3, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from c3),
k as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from c)
select k.lang, k.rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from k join n using (lang) where k.rank <= {TOP}"""
