"""LM scoring: a hierarchical Pitman-Yor trigram model.

Restaurants: one for each two words (what follows them), one for each word, and one for all words; the parent of a
restaurant drops the context's first word, and the root's parent is uniform over the training words and one unknown. The
customers of a two-word restaurant are the training trigrams; those of any other restaurant are its children's tables.

Seatings are sampled by Gibbs sweeps over the levels in turn, all restaurants of a level at once given the level above.
A restaurant's dishes depend on each other only through its number of tables; with x ~ Gamma(strength / discount + tables)
drawn for each restaurant, they are independent, and a table of dish w weighs discount * x * parent(w). All customers of a
dish are then unseated and seated anew at once: its number of tables t has probability S(c, t) * (weights of its tables),
with S the generalised Stirling numbers, which at the discount 1/2 of all levels grow by 4 (c - t) / ((2c - t - 1) t) from t
to t + 1. A table's weight is taken with the dish's own tables removed from the parent and put back one by one. Of dishes
with over WINDOW customers, t is drawn in a window of that width that lies at random around the present t, which leaves the
same law unchanged. Predictive probabilities are averaged over some sweeps after a burn-in. Random numbers are hashes of
the context, the dish and the sweep, and all counts that restaurants share are exchanged in every sweep: the scores don't
depend on how the data are dealt.

At scale: texts are cut into slices, tables of packed word numbers (a word's number is its hash's place among the hashes of
all training words, which the hashes' owners count). A slice sends its distinct trigrams to buckets by their
middle word (middle and last word where that middle word alone has more than a bucket's share), so that a two-word and its
one-word restaurant lie in one bucket. Between sweeps buckets keep only dishes with two customers or more; the others have
one table. Owners of words sum the tables that buckets report, seat the root and answer; they also sum the tables of
restaurants that lie in several buckets. In the end buckets answer each slice's trigrams with averaged probabilities, and
the slice adds them up by document. Sizes of slices and buckets are bounded by bytes of text, their numbers are not. The
driver gets two totals for each bucket and the middle words that are split (fewer than buckets).

Defined cases: every row gives a row, repeated rows and ids too, and a null id stays null; a null or wordless text is one end
token; a very long text is a slice of its own and needs some 100 bytes of memory for each of its tokens; equal counts need
no order; without training text every word is unknown; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, discard, give_back, remainder, slices, utf8

DISCOUNT = 0.5
#: Of the root, of one-word and of two-word restaurants.
STRENGTH = (50.0, 2.0, 1.0)
BURN_IN, SAMPLES = 2, 3
#: Numbers of tables that one draw weighs against each other at most.
WINDOW = 256
#: Bytes of text for a bucket, on average, and for one at small sizes, where all tasks should have some.
BUCKET_BYTES, BUCKET_LEAST = 12 << 20, 1 << 20
#: Bytes of text that are tokenised, and dealt, at once.
CHUNK, SLICE = 2 << 20, 10 << 20

END = np.uint64(0x9AE16A3B2F90404F)
#: Words have numbers; marks tell the keys of one-word contexts and of two-word contexts from those of words.
ALONE, BOTH = np.uint64(1 << 50), np.uint64(1 << 63)
BASE = 0x5851F42D4C957F2D
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTES = np.random.default_rng(20).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

Arrays = dict[str, np.ndarray]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two numbers in order."""
    return mixed(mixed(a) * np.uint64(3) + b)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base & 2**64 - 1
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in order, each text's end included, and the number of tokens of each text."""
    n = len(raw)
    if not _POWERS or len(_POWERS[0]) < n + 1:
        _POWERS[:] = [powers(BASE, max(n + 1, CHUNK + 1)), powers(pow(BASE, -1, 2**64), max(n + 1, CHUNK + 1))]
    low = LOWER[raw]
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~SPACE[low]
    flips = word[1:] != word[:-1]
    # texts end words, too
    touch = np.zeros(n + 1, bool)
    touch[off[1:-1]] = True
    touch &= word[1:] & word[:-1]
    starts = np.flatnonzero((flips & word[1:]) | touch)
    ends = np.flatnonzero((flips & word[:-1]) | touch)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTES[low] * _POWERS[0][:n], out=total[1:])
    words = mixed((total[ends] - total[starts]) * _POWERS[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    row = np.searchsorted(off, starts, side="right") - 1
    count = np.bincount(row, minlength=len(off) - 1)
    out = np.full(len(words) + len(count), END, np.uint64)
    out[np.arange(len(words)) + row] = words
    return out, count + 1


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: whole numbers in the least width, rising hashes ("_word") as differences, all cut into
    planes of first bytes, second bytes and so on."""
    out = {}
    for name, x in arrays.items():
        if name == "_word":
            x = np.diff(x, prepend=np.uint64(0))
        elif x.dtype.kind in "iu" and name[0] != "_":
            x = x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)
        out[name] = (x.dtype.str, np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out, protocol=5))


def unpack(data: bytes) -> Arrays:
    out = {}
    for name, (kind, raw) in pickle.loads(zstandard.ZstdDecompressor().decompress(data)).items():
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
        out[name] = np.cumsum(x) if name == "_word" else x.astype(np.int64) if x.dtype.kind in "iu" and name[0] != "_" else x
    return out


#: What passes between tasks: rows of a kind, for a part (a bucket, an owner or a slice), from a source.
SCHEMA = "kind int, part long, source long, data binary"
SLICE_ROW, WORDS, COUNTS, TOTALS, GRAMS, STATE, KEYS, TABLES, ROOT, ANSWER, CHANCES = range(11)
Row = tuple[int, int, int, bytes]


def _table(rows: list[Row]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int32(), pa.int64(), pa.int64(), pa.binary()])], ["kind", "part", "source", "data"])


def _got(group: pa.Table) -> dict[int, list[tuple[int, Arrays]]]:
    """A group's rows by kind, in order of their sources."""
    out: dict[int, list[tuple[int, Arrays]]] = {}
    columns = (group.column(k).to_pylist() for k in ("kind", "source", "data"))
    for kind, source, data in sorted(zip(*columns, strict=True), key=lambda r: r[:2]):
        out.setdefault(kind, []).append((source, unpack(data)))
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(keys) else v for v in values)


def by_range(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The owners of rising hashes by equal ranges, each with the places of its own."""
    owner = (hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    at = np.searchsorted(owner, np.arange(parts + 1, dtype=np.uint64))
    yield from ((k, slice(a, b)) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a)


def by_owner(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The owners of rising keys, each with the places of its own."""
    owner = mixed(keys) % np.uint64(parts)
    order = np.argsort(owner, kind="stable")
    at = np.searchsorted(owner[order], np.arange(parts + 1, dtype=np.uint64))
    yield from ((k, order[a:b]) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    source = TaskContext.get().partitionId() << 32
    for batch in slices(batches, most=SLICE):
        got = [tokens(*utf8(piece.column(1))) for piece in slices([batch], "text", CHUNK)]
        vocab, ids = np.unique(np.concatenate([t for t, _ in got]), return_inverse=True)
        known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        doc = batch.column(0).fill_null(0).to_numpy()
        learn = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        data = pack(_word=vocab, ids=ids, length=np.concatenate([n for _, n in got]), _doc=doc, known=known.astype(np.uint8), learn=learn.astype(np.uint8))
        yield from _table([(SLICE_ROW, source, source, data)]).to_batches()
        source += 1
        del got, vocab, ids
        give_back()


def _counts(parts: int):
    """Of each slice, its words and their training counts, to their owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                m = unpack(data)
                n = np.bincount(m["ids"], np.repeat(m["learn"], m["length"]), len(m["_word"])).astype(np.int64)
                yield from _table([(WORDS, k, source, pack(_word=m["_word"][at], n=n[at])) for k, at in by_range(m["_word"], parts)]).to_batches()
            give_back()

    return run


def _counted(group: pa.Table) -> pa.Table:
    """An owner's totals, and each slice's answer: training counts, and ranks among the owner's training words."""
    part, asked = group.column("part")[0].as_py(), _got(group)[WORDS]
    words, n = summed(np.concatenate([x["_word"] for _, x in asked]), np.concatenate([x["n"] for _, x in asked]))
    rank, rows = np.cumsum(n > 0) - 1, []
    for source, x in asked:
        at = np.searchsorted(words, x["_word"])
        rows.append((COUNTS, source, part, pack(n=n[at], rank=np.maximum(rank[at], 0))))
    rows.append((WORDS, part, part, pack(n=n[n > 0])))
    return _table([*rows, (TOTALS, part, part, pack(_total=np.array([n.sum(), np.count_nonzero(n)])))])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = np.array([unpack(data)["_total"] for data in batch.column(1).to_pylist()], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, both.T)], ["part", "a", "b"])


def totals(rows: DataFrame) -> DataFrame:
    """(part, a, b): the two totals that each owner tells."""
    return rows.where(F.col("kind") == TOTALS).select("part", "data").mapInArrow(_totals, "part long, a long, b long")


def added(rows: DataFrame) -> tuple[int, int]:
    a, b = totals(rows).agg(F.sum("a"), F.sum("b")).first()
    return a or 0, b or 0


def _large(least: float, offsets: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(unpack(data)["n"] > least) + offsets[part])], ["word"])

    return run


def _numbered(parts: int, offsets: np.ndarray, words: int):
    """A slice with numbers of words for their hashes: their places among the hashes of all training words; all others have
    the number after the last."""

    def run(group: pa.Table) -> pa.Table:
        part, got = group.column("part")[0].as_py(), _got(group)
        m, answers = got[SLICE_ROW][0][1], dict(got[COUNTS])
        hashes = m.pop("_word")
        n, number = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for k, at in by_range(hashes, parts):
            n[at], number[at] = answers[k]["n"], offsets[k] + answers[k]["rank"]
        number[n == 0] = words
        m["end"] = np.array([np.searchsorted(hashes, END)])
        names, inverse = np.unique(number, return_inverse=True)
        m["n"] = np.bincount(inverse, n, len(names)).astype(np.int64)
        m["ids"], m["end"], m["_word"] = inverse[m["ids"]], inverse[m["end"]], names.view(np.uint64)
        rows = [(SLICE_ROW, part, part, pack(**m))]
        give_back()
        return _table(rows)

    return run


def codes(a: np.ndarray, b: np.ndarray, c: np.ndarray, names: int) -> np.ndarray:
    """Numbers in the order of (a, b, c), each under names."""
    if names**3 < 1 << 63:
        return (a * names + b) * names + c
    pairs, inverse = np.unique(a * names + b, return_inverse=True)
    return inverse * names + c


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def trigrams(m: Arrays, parts: int, split: np.ndarray) -> tuple[Arrays, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Of a slice: its distinct trigrams (u, v, w, training count c) as numbers of its words, each token's trigram, and the
    trigrams of each bucket, in order of (v, w, u)."""
    w, length, names = m["ids"], m["length"], len(m["_word"])
    end = int(m["end"][0])
    starts = np.cumsum(length) - length
    v = np.r_[end, w[:-1]]
    u = np.r_[end, v[:-1]]
    u[starts] = end
    keys = codes(v, w, u, names)
    order = np.argsort(keys)
    new = runs(keys[order])
    del keys
    first = order[np.flatnonzero(new)]
    which = np.empty(len(w), np.int64)
    which[order] = np.cumsum(new) - 1
    c = np.bincount(which, np.repeat(m["learn"], length), len(first)).astype(np.int64)
    u, v, w = u[first], v[first], w[first]
    word = m["_word"]
    apart = np.isin(word, split)[v] if len(split) else np.zeros(len(v), bool)
    part = mixed(word)[v]
    part[apart] = joined(word[v[apart]], word[w[apart]])
    part = (part >> np.uint64(11)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    return {"u": u, "v": v, "w": w, "c": c}, which, [(k, order[a:b]) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]


def _deal(parts: int, split: np.ndarray):
    """Of each slice, its distinct trigrams, to their buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                m = unpack(data)
                g, _, dealt = trigrams(m, parts, split)
                number = np.zeros(len(m["_word"]), np.int64)
                rows = []
                for k, at in dealt:
                    here = {x: g[x][at] for x in "uvwc"}
                    used = np.zeros(len(number), bool)
                    for x in "uvw":
                        used[here[x]] = True
                    names = np.flatnonzero(used)
                    number[names] = np.arange(len(names))
                    rows.append((GRAMS, k, source, pack(_word=m["_word"][names], c=here["c"], **{x: number[here[x]] for x in "uvw"})))
                del m, g, dealt
                yield from _table(rows).to_batches()
                give_back()

    return run


def bucket(asked: list[tuple[int, Arrays]], split: np.ndarray) -> Arrays:
    """What a bucket makes of its slices' trigrams: distinct words (word); trigrams (c, pair and context numbers) in order
    of (v, w, u); of pairs v and w, of contexts u and v; what is shared with other buckets."""
    word = np.unique(np.concatenate([x["_word"] for _, x in asked]))
    at = [np.searchsorted(word, x["_word"]) for _, x in asked]
    u, v, w = (np.concatenate([n[x.pop(k)] for n, (_, x) in zip(at, asked, strict=True)]) for k in "uvw")
    sizes = np.array([len(x["c"]) for _, x in asked])
    keys = codes(v, w, u, len(word))
    order = np.argsort(keys)
    new = runs(keys[order])
    first, group = order[np.flatnonzero(new)], np.cumsum(new) - 1
    which = np.empty(len(keys), np.int32)
    which[order] = group
    c = np.bincount(group, np.concatenate([x.pop("c") for _, x in asked])[order], len(first)).astype(np.int64)
    del keys, order, new, group
    u, v, w = u[first], v[first], w[first]
    new = runs(v, w)
    contexts, context = np.unique(u * len(word) + v, return_inverse=True)
    return {"word": word, "c": c, "pair": (np.cumsum(new) - 1).astype(np.int32), "pair_v": v[new], "pair_w": w[new], "context": context.astype(np.int32), "context_u": contexts // len(word), "context_v": contexts % len(word), "apart": np.isin(word, split), "which": which, "sizes": sizes}


def context_hash(word: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return joined(word[u], word[v]) | BOTH


def shared(b: Arrays) -> tuple[list[np.ndarray], np.ndarray]:
    """Of a bucket: its words, those that are split contexts, and its contexts with a split middle word, by number; and the
    order in which the keys of all these rise."""
    split2, split3 = np.flatnonzero(b["apart"]), np.flatnonzero(b["apart"][b["context_v"]])
    keys = np.concatenate([b["word"], b["word"][split2] | ALONE, context_hash(b["word"], b["context_u"][split3], b["context_v"][split3])])
    order = np.argsort(keys)
    return [keys[order], split2, split3], order


def counted(at: np.ndarray, weights: np.ndarray | None, size: int) -> np.ndarray:
    return np.bincount(at, weights, size).astype(np.int64)


def _begin(owners: int, split: np.ndarray):
    """A bucket's first state, and what it shares: for words, pairs with one table for good; for restaurants that lie in
    several buckets, tables and customers that are there for good. core: whether more may come from sweeps."""

    def run(group: pa.Table) -> pa.Table:
        part, b = group.column("part")[0].as_py(), bucket(_got(group)[GRAMS], split)
        word, c, many = b["word"], b["c"], b["c"] > 1
        pairs, contexts, names = len(b["pair_v"]), len(b["context_u"]), len(word)
        ones, more = counted(b["pair"][c == 1], None, pairs), counted(b["pair"][many], None, pairs)
        core, plain = ones + 2 * more > 1, ones + 2 * more == 1
        core3, core2 = counted(b["context"][many], None, contexts) > 0, counted(b["pair_v"][core], None, names) > 0
        fixed3, fixed2 = counted(b["context"][c == 1], None, contexts), counted(b["pair_v"][plain], None, names)
        (keys, split2, split3), order = shared(b)
        a = np.concatenate([counted(b["pair_w"][plain], None, names), fixed2[split2], fixed3[split3]])[order]
        z = np.concatenate([np.zeros(names, np.int64), fixed2[split2], counted(b["context"], c, contexts)[split3]])[order]
        is_core = np.concatenate([counted(b["pair_w"][core], None, names) > 0, core2[split2], core3[split3]])[order]
        is_word = np.repeat([True, False], [names, len(split2) + len(split3)])[order]
        rows = [(KEYS, k, part, pack(_word=keys[at], a=a[at], z=z[at], is_word=is_word[at].view(np.uint8), core=is_core[at].view(np.uint8))) for k, at in by_owner(keys, owners)]
        # the state has the core's own words, pairs and contexts only
        kept_pairs, kept_contexts, dish = np.flatnonzero(core), np.flatnonzero(core3), np.flatnonzero(many)
        used = np.zeros(names, bool)
        used[b["pair_v"][kept_pairs]] = used[b["pair_w"][kept_pairs]] = used[b["context_u"][kept_contexts]] = True
        kept_words = np.flatnonzero(used)
        number = lambda kept, size: np.bincount(kept, np.arange(len(kept)), size).astype(np.int64)
        of_word, of_pair, of_context = number(kept_words, names), number(kept_pairs, pairs), number(kept_contexts, contexts)
        state = {
            "_word": word[kept_words], "apart": b["apart"][kept_words].astype(np.int64), "fixed2": fixed2[kept_words],
            "pair_v": of_word[b["pair_v"][kept_pairs]], "pair_w": of_word[b["pair_w"][kept_pairs]], "ones": ones[kept_pairs],
            "context_u": of_word[b["context_u"][kept_contexts]], "context_v": of_word[b["context_v"][kept_contexts]], "fixed3": fixed3[kept_contexts],
            "pair": of_pair[b["pair"][dish]], "context": of_context[b["context"][dish]], "c": c[dish], "t3": np.ones(len(dish), np.int64), "t2": np.ones(len(kept_pairs), np.int64),
        }
        del b
        rows += [(STATE, part, part, pack(**state)), *reported(part, owners, state)]
        give_back()
        return _table(rows)

    return run


def core_keys(s: Arrays) -> tuple[list[np.ndarray], np.ndarray]:
    """As shared(), of what the state's sweeps change: keys, words that are dishes, split contexts of one and of two words."""
    word, names = s["_word"], len(s["_word"])
    dishes, split2 = np.flatnonzero(counted(s["pair_w"], None, names)), np.flatnonzero(s["apart"] * counted(s["pair_v"], None, names))
    split3 = np.flatnonzero(s["apart"][s["context_v"]])
    keys = np.concatenate([word[dishes], word[split2] | ALONE, context_hash(word, s["context_u"][split3], s["context_v"][split3])])
    order = np.argsort(keys)
    return [keys[order], dishes, split2, split3], order


def changing(s: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As far as sweeps change them: tables of two-word contexts, tables and customers of one-word ones; customers of pairs."""
    names = len(s["_word"])
    c2 = s["ones"] + counted(s["pair"], s["t3"], len(s["ones"]))
    return counted(s["context"], s["t3"], len(s["fixed3"])), counted(s["pair_v"], s["t2"], names), counted(s["pair_v"], c2, names), c2


def reported(part: int, owners: int, s: Arrays) -> list[Row]:
    """The state's tables and customers of what others share, for the owners."""
    of3, of2, n2, _ = changing(s)
    (keys, dishes, split2, split3), order = core_keys(s)
    a = np.concatenate([counted(s["pair_w"], s["t2"], len(s["_word"]))[dishes], of2[split2], of3[split3]])[order]
    z = np.concatenate([np.zeros(len(dishes), np.int64), n2[split2], np.zeros(len(split3), np.int64)])[order]
    return [(TABLES, k, part, pack(a=a[at], z=z[at])) for k, at in by_owner(keys, owners)]


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each key."""
    return (mixed(mixed(keys) ^ mixed(np.array([salt], np.uint64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def gamma(shape: np.ndarray, keys: np.ndarray, salt: int) -> np.ndarray:
    """Gamma variates (shapes of 1 or more) from the keys' random numbers, by Marsaglia and Tsang's rejection."""
    d = shape - 1 / 3
    out, open_ = np.empty(len(shape)), np.arange(len(shape))
    while len(open_):
        k, e = keys[open_], d[open_]
        z = np.sqrt(-2 * np.log(uniform(k, salt + 1))) * np.cos(2 * np.pi * uniform(k, salt + 2))
        cube = (1 + z / np.sqrt(9 * e)) ** 3
        ok = cube > 0
        ok[ok] = np.log(uniform(k, salt + 3)[ok]) < 0.5 * z[ok] ** 2 + e[ok] * (1 - cube[ok] + np.log(cube[ok]))
        out[open_[ok]] = e[ok] * cube[ok]
        open_, salt = open_[~ok], salt + 4
    return out


def seat(c: np.ndarray, t: np.ndarray, x: np.ndarray, keys: np.ndarray, salt: int, parent: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """New numbers of tables of dishes with c customers and t tables. x: their restaurants' gamma variates. parent(i, j):
    the parent's probability of dishes i where j of their own tables (a column for each) are counted in it."""
    out = np.empty(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    at = 0
    while at < len(order):
        # dishes of alike c together, some 260,000 weights at most
        least = int(c[order[at]])
        end = at + max(1, (1 << 18) // min(WINDOW, least + least // 4))
        end = min(end, int(np.searchsorted(c, least + least // 4, side="right", sorter=order)))
        i = order[at:end]
        width, n, k = min(WINDOW, int(c[i[-1]])), c[i][:, None], keys[i]
        low = np.where(c[i] <= width, 1, t[i] - (uniform(k, salt) * width).astype(np.int64))
        j = low[:, None] + np.arange(width)
        inside = (j >= 1) & (j < n)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.log(4.0 * DISCOUNT * (n - j) / ((2.0 * n - j - 1) * j) * x[i][:, None] * parent(i, j))  # from j tables to j + 1
        step[~inside] = 0
        weight = np.zeros(j.shape)
        np.cumsum(step[:, :-1], 1, out=weight[:, 1:])
        weight[(j < 1) | (j > n)] = -np.inf
        weight = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
        out[i] = low + np.argmax(weight > (uniform(k, salt + 1) * weight[:, -1])[:, None], 1)
        at = end
    return out


def above(others: np.ndarray, tables: np.ndarray, mass: np.ndarray, room: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A parent restaurant for seat(): without a dish's own tables it has others customers of it at tables, mass of what
    comes from above and room in all (strength and all its customers)."""

    def parent(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        held = np.where(others[i] > 0, others[i] - DISCOUNT * tables[i], -DISCOUNT)  # the first own table makes one there
        return (j + (held + mass[i])[:, None]) / (j + room[i][:, None])

    return parent


def chances(c1: np.ndarray, t1: np.ndarray, root: tuple[int, int], words: int) -> np.ndarray:
    """The root's predictive probabilities of words with c1 customers at t1 tables; root: all its customers and tables."""
    return (c1 - DISCOUNT * t1 + (STRENGTH[0] + DISCOUNT * root[1]) / (words + 1)) / (STRENGTH[0] + root[0])


def _sweep(owners: int, number: int, sample: int, seed: int, root: tuple[int, int], words: int):
    """A bucket's sweep, kept as a sample of that number (from 0), given the owners' answers: the two-word restaurants, then
    the one-word ones."""
    salt = (seed * 1000 + number) * 1_000_000

    def run(group: pa.Table) -> pa.Table:
        part, got = group.column("part")[0].as_py(), _got(group)
        s, answers = got[STATE][0][1], dict(got.get(ANSWER, []))
        word, names = s["_word"], len(s["_word"])
        (keys, dishes, split2, split3), order = core_keys(s)
        a, z = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k, at in by_owner(keys, owners):
            a[order[at]], z[order[at]] = answers[k]["a"], answers[k]["z"]
        c1, t1 = np.zeros(names, np.int64), np.zeros(names, np.int64)
        c1[dishes], t1[dishes] = a[: len(dishes)], z[: len(dishes)]
        a, z = a[len(dishes) :], z[len(dishes) :]
        of3, of2, n2, c2 = changing(s)
        of3, of2, n2 = of3 + s["fixed3"], of2 + s["fixed2"], n2 + s["fixed2"]
        of2[split2], n2[split2], of3[split3] = a[: len(split2)], z[: len(split2)], a[len(split2) :]
        pair, v, w, t2, t3 = s["pair"], s["pair_v"], s["pair_w"], s["t2"], s["t3"]
        x = gamma(STRENGTH[2] / DISCOUNT + of3, context_hash(word, s["context_u"], s["context_v"]), salt)
        others = c2[pair] - t3
        mass = ((STRENGTH[1] + DISCOUNT * of2[v]) * chances(c1, t1, root, words)[w])[pair]
        pair_hash = joined(word[v], word[w])
        s["t3"] = seat(s["c"], t3, x[s["context"]], joined(word[s["context_u"][s["context"]]], pair_hash[pair]), salt + 500_000, above(others, np.minimum(t2[pair], others), mass, STRENGTH[1] + n2[v[pair]] - t3))
        # the tables just laid are the one-word restaurants' customers
        c2 = s["ones"] + counted(pair, s["t3"], len(c2))
        x = gamma(STRENGTH[1] / DISCOUNT + of2, word | ALONE, salt + 200_000)
        others = c1[w] - t2
        mass = np.full(len(w), (STRENGTH[0] + DISCOUNT * root[1]) / (words + 1))
        s["t2"] = seat(c2, np.minimum(t2, c2), x[v], pair_hash, salt + 600_000, above(others, np.minimum(t1[w], others), mass, STRENGTH[0] + root[0] - t2))
        if sample >= 0:
            s[f"t3_{sample}"], s[f"t2_{sample}"] = s["t3"], s["t2"]
        rows = [(STATE, part, part, pack(**s)), *reported(part, owners, s)]
        give_back()
        return _table(rows)

    return run


def _owner(number: int, sample: int, seed: int, tables: int, words: int):
    """An owner's turn after a sweep (-1: the first state): adds what buckets report, seats the root's dishes, answers."""
    salt = (seed * 1000 + number + 1) * 1_000_000 + 700_000

    def run(group: pa.Table) -> pa.Table:
        part, got = group.column("part")[0].as_py(), _got(group)
        if ROOT in got:
            s = got[ROOT][0][1]
        else:
            s = {"_word": np.unique(np.concatenate([x["_word"] for _, x in got[KEYS]]))}
            s |= {k: np.zeros(len(s["_word"]), np.int64) for k in ("a", "z", "is_word")}
            for source, x in got[KEYS]:
                at = np.searchsorted(s["_word"], x["_word"])
                s["a"][at] += x["a"]
                s["z"][at] += x["z"]
                s["is_word"][at] = x["is_word"]
                s[f"core{source}"] = at[x["core"] > 0]
        a, z = s["a"].copy(), s["z"].copy()
        for source, x in got.get(TABLES, []):
            at = s[f"core{source}"]
            a[at] += x["a"]
            z[at] += x["z"]
        seated = (s["is_word"] > 0) & (a > 0)
        t = np.where(seated, np.clip(s["t"] if "t" in s else np.sqrt(a).astype(np.int64), 1, a), 0)
        i = np.flatnonzero(seated & (a > 1))
        x = gamma(np.array([STRENGTH[0] / DISCOUNT + tables]), np.array([END]), salt)  # the root is one restaurant for all owners
        t[i] = seat(a[i], t[i], np.repeat(x, len(i)), s["_word"][i], salt + 100_000, lambda i, j: 1 / (words + 1))
        s["t"], z = t, np.where(s["is_word"] > 0, t, z)
        rows = [(ANSWER, int(k[4:]), part, pack(a=a[at], z=z[at])) for k, at in s.items() if k.startswith("core") and len(at)]
        if sample >= 0:
            s[f"a_{sample}"], s[f"z_{sample}"] = a, z
        rows += [(ROOT, part, part, pack(**s)), (TOTALS, part, part, pack(_total=np.array([a[seated].sum(), t[seated].sum()])))]
        give_back()
        return _table(rows)

    return run


def _told(group: pa.Table) -> pa.Table:
    """An owner's counts of all samples, for each bucket's words and shared restaurants."""
    part, got = group.column("part")[0].as_py(), _got(group)
    s = got[ROOT][0][1]
    rows = []
    for source, x in got[KEYS]:
        at = np.searchsorted(s["_word"], x["_word"])
        rows.append((ANSWER, source, part, pack(**{k: x[at] for k, x in s.items() if k[:2] in ("a_", "z_")})))
    return _table(rows)


def _chances(owners: int, split: np.ndarray, roots: list[tuple[int, int]], words: int):
    """A bucket's answers to its slices: log10 of each trigram's probability, averaged over the samples."""

    def run(group: pa.Table) -> pa.Table:
        part, got = group.column("part")[0].as_py(), _got(group)
        asked, s, answers = got.pop(GRAMS), got[STATE][0][1], dict(got[ANSWER])
        b = bucket(asked, split)
        c, pair, v, w, context = (b[k] for k in ("c", "pair", "pair_v", "pair_w", "context"))
        pairs, contexts, names = len(v), len(b["context_u"]), len(b["word"])
        ones, more = counted(pair[c == 1], None, pairs), counted(pair[c > 1], None, pairs)
        core = ones + 2 * more > 1
        (keys, split2, split3), order = shared(b)
        p = np.zeros(len(c))
        for n in range(len(roots)):
            a, z = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            for k, at in by_owner(keys, owners):
                a[order[at]], z[order[at]] = answers[k][f"a_{n}"], answers[k][f"z_{n}"]
            p1 = chances(a[:names], z[:names], roots[n], words)
            a, z = a[names:], z[names:]
            t3 = np.minimum(c, 1)
            t3[c > 1] = s[f"t3_{n}"]
            c2 = counted(pair, t3, pairs)
            t2 = np.minimum(c2, 1)
            t2[core] = s[f"t2_{n}"]
            of3, n3, of2, n2 = counted(context, t3, contexts), counted(context, c, contexts), counted(v, t2, names), counted(v, c2, names)
            of2[split2], n2[split2], of3[split3], n3[split3] = a[: len(split2)], z[: len(split2)], a[len(split2) :], z[len(split2) :]
            p2 = (c2 - DISCOUNT * t2 + (STRENGTH[1] + DISCOUNT * of2[v]) * p1[w]) / (STRENGTH[1] + n2[v])
            p += (c - DISCOUNT * t3 + (STRENGTH[2] + DISCOUNT * of3[context]) * p2[pair]) / (STRENGTH[2] + n3[context])
        logs = np.log10(p / len(roots)).astype(np.float32)[b["which"]]
        ends = np.cumsum(b["sizes"])
        rows = [(CHANCES, source, part, pack(_log=logs[end - size : end])) for (source, _), end, size in zip(asked, ends, b["sizes"], strict=True)]
        del b, asked, logs
        give_back()
        return _table(rows)

    return run


RESULT = "doc_id long, held boolean, n long, known long, base double, score double"


def _scored(parts: int, split: np.ndarray):
    """A slice's documents, their sums over tokens."""

    def run(group: pa.Table) -> pa.Table:
        got = _got(group)
        m, answers = got[SLICE_ROW][0][1], dict(got[CHANCES])
        length, c = m["length"], m["n"]
        g, which, dealt = trigrams(m, parts, split)
        logs = np.zeros(len(g["c"]))
        for k, at in dealt:
            logs[at] = answers[k]["_log"]
        starts = np.cumsum(length) - length
        base, score, known = (np.add.reduceat(x, starts) for x in (np.log10(c + 1.0)[m["ids"]], logs[which], (c > 0).astype(np.int64)[m["ids"]]))
        columns = [pa.array(m["_doc"], mask=m["known"] == 0), pa.array(m["learn"] == 0), *map(pa.array, (length, known, base, score))]
        give_back()
        return pa.Table.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])

    return run


def score(docs: DataFrame, held_out: Column, seed: int = 5, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """docs (doc_id, text), learnt from where held_out (over doc_id) is false -> doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score of every row; scores in log10. Probabilities are averaged over samples sweeps after burn_in."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # what a finished job has shuffled isn't read again here: its files go at once
    tidy = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        parts = max(1, -(-size // BUCKET_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_LEAST))
        each = lambda rows, f: rows.repartition(parts, "part").groupBy("part").applyInArrow(f, SCHEMA)
        of = lambda rows, *kinds: rows.where(F.col("kind").isin(*kinds))
        sliced = cut(texts.mapInArrow(_sliced, SCHEMA), "slices")
        counts = cut(each(sliced.mapInArrow(_counts(parts), SCHEMA), _counted), "counts")
        told = totals(counts).toPandas()  # two numbers for each part
        n, words, offsets = int(told.a.sum()), int(told.b.sum()), np.zeros(parts + 1, np.int64)
        offsets[told.part + 1] = told.b
        offsets = np.cumsum(offsets)
        split = of(counts, WORDS).select("part", "data").mapInArrow(_large(n / parts, offsets), "word long").toPandas()  # fewer than parts
        split = np.sort(split.word.to_numpy(np.int64)).view(np.uint64)
        old, sliced = [sliced, counts], cut(each(sliced.unionByName(of(counts, COUNTS)), _numbered(parts, offsets, words)), "numbered")
        for table in old:
            discard(table)
        dealt = sliced.mapInArrow(_deal(parts, split), SCHEMA)
        begun = state = cut(each(dealt, _begin(parts, split)), "begun")
        owned = cut(each(of(begun, KEYS, TABLES), _owner(-1, -1, seed, words, words)), "root")
        roots = [added(owned)]
        for number in range(burn_in + samples):
            old = [owned] if state is begun else [owned, state]
            state = cut(each(of(state, STATE).unionByName(of(owned, ANSWER)), _sweep(parts, number, number - burn_in, seed, roots[-1], words)), "state")
            owned = cut(each(of(state, TABLES).unionByName(of(owned, ROOT)), _owner(number, number - burn_in, seed, roots[-1][1], words)), "root")
            roots.append(added(owned))
            for table in old:
                discard(table)
        told = cut(each(of(owned, ROOT).unionByName(of(begun, KEYS)), _told), "told")
        discard(owned)
        if state is not begun:
            discard(begun)
        last = dealt.unionByName(of(state, STATE)).unionByName(told)
        found = cut(each(last, _chances(parts, split, roots[-samples:], words)), "chances")
        for table in (state, told):
            discard(table)
    finally:
        spark.conf.set(tidy, before)
    back = sliced.unionByName(found).repartition(parts, "part")
    out = back.groupBy("part").applyInArrow(_scored(parts, split), RESULT)
    base = F.col("base") - F.col("n") * F.log10(F.lit(float(n + words + 1)))
    return out.select("doc_id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), remainder("doc_id", 7) == 2)
