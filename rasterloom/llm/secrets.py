"""Secret scans: candidate strings, and a random forest that removes the false ones.

Candidates are strings of known key formats, values assigned to names such as ``password`` or ``token``, and long strings of
mixed character classes. The forest sees each candidate's length, its transitions between character classes and how usual
they are in words, how much of it dictionary words cover, whether it is or lies in a path or address, and its neighbouring
words. The dictionary is the documents' own: the words used most, counted over all texts (``common_words``), beside a few that
placeholders are made of. The forest is trained in numpy on labelled findings (text, start, end, rule, label);
``labelled_findings`` makes a seeded set of them from formats, placeholders, checksums, identifiers and paths with words of
that dictionary, and others can be given.

Defined cases: null and empty texts have no findings; findings never overlap (the earlier rule, then the earlier start,
then the longer one stays); whole texts are scanned and strings of any length are judged whole; a null doc_id and repeated
rows are scanned as they are; other columns are ignored, and kept by redact(). Words used equally often rank by their
letters; without documents the dictionary is the words of placeholders.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, discard, slices

_FIELD = r"(?:Proc-Type|DEK-Info): [^\n\\]*+"
#: Key formats: a literal that must occur, and the format; its group, where it has one, is the secret.
FORMATS = [
    ("aws_key", "AKIA", re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("aws_key", "ASIA", re.compile(r"(?<![A-Za-z0-9])ASIA[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("hub_token", "gh", re.compile(r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat_token", "xox", re.compile(r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("map_key", "AIza", re.compile(r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}")),
    ("pay_key", "k_live_", re.compile(r"(?<![A-Za-z0-9])[sr]k_live_[A-Za-z0-9]{16,}")),
    ("web_token", "eyJ", re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("mail_key", "SG.", re.compile(r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{32,}")),
    ("address", "://", re.compile(r"(?<=://)(?:[^\s/:@\"'<>]{0,64}):([^\s/:@\"'<>]{4,})(?=@)")),
    # the header, its fields, lines of the key, and the end where there is one
    ("private_key", "PRIVATE KEY", re.compile(rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?=(?:\s|\\[nr])*+(?:{_FIELD}|[A-Za-z0-9+/=]{{24}}|-----END))(?:(?:\s|\\[nr])*+(?:{_FIELD}|[A-Za-z0-9+/=]{{24,}}+))*+(?:(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{{1,23}}+)?(?:\s|\\[nr])*+-----END [A-Z ]*PRIVATE KEY-----)?")),
]
NAMES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "private_key")
TAIL = re.compile(r"[\w-]*+")
ASSIGNED = re.compile(r"[\"']?\s*+(?::=|=>|[:=])\s*+(?:Bearer\s++)?([\"'`]?)([^\s\"'`,;<>()\[\]{}]{6,}+)")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
RULES = [*dict.fromkeys(x[0] for x in FORMATS), "assigned", "long"]
CODE_WORDS = NAMES + ("key", "login", "export", "bearer", "authorization", "config", "env", "secret_key", "pass", "set")
PLAIN_WORDS = ("commit", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "id", "revision", "version", "file", "path", "http", "https", "image", "example", "serial", "isbn", "build", "release", "etag")
DICTIONARY = frozenset(
    "example your here test sample changeme change replace password secret token placeholder dummy default none null user name admin demo value todo insert enter string fake public private access key api the and for with from this that have not are you all can get set new old "
    "file path usr lib bin local home var src main index data base config server client request response static image images content view model controller service manager factory helper utils common package python java script module http https www com org net html json xml".split()
)
#: The documents' words that the dictionary takes, of so many letters.
WORD_ROWS, WORD_LETTERS = 20_000, (4, 12)
TREES, DEPTH, LEAVES_LEAST, SEED = 40, 9, 3, 11
#: Labelled findings that training takes at most.
TRAIN_ROWS = 20_000
MASK = "[SECRET]"

Finding = tuple[int, int, str]  # start, end, rule


def ordered(text: str) -> list[Finding]:
    """All candidates, the surest rules first; they may overlap, but no two have the same place."""
    found: list[tuple[int, int, int, str]] = []
    for rule, literal, pattern in FORMATS:
        if literal in text:
            found += [(0, m.start(pattern.groups), m.end(), rule) for m in pattern.finditer(text)]
    low = text.lower()
    if len(low) != len(text):  # case rules that change lengths: lower one by one what keeps its length
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for name in NAMES:
        at = low.find(name)
        while at >= 0:  # names in one run of word characters share what follows it
            end = TAIL.match(text, at + len(name)).end()
            m = ASSIGNED.match(text, end)
            if m:
                found.append((1, m.start(2), m.end(2), "assigned"))
            at = low.find(name, end)
    at = 0
    for word in text.split():
        if len(word) >= 20:
            at = text.index(word, at)
            for m in LONG.finditer(word):
                s = m[0]
                if any(map(str.isdigit, s)) and not s.isdigit() or (s.lower() != s and s.upper() != s and not s.istitle()):
                    found.append((2, at + m.start(), at + m.end(), "long"))
            at += len(word)
    places: dict[tuple[int, int], str] = {}
    for _, a, b, rule in sorted(set(found), key=lambda x: (x[0], x[1], -x[2], x[3])):
        b -= len(text[a:b]) - len(text[a:b].rstrip(".!?:"))
        if b > a:
            places.setdefault((a, b), rule)
    return [(a, b, rule) for (a, b), rule in places.items()]


def apart(found: Iterable[tuple]) -> list[tuple]:
    """Of findings (start, end, ...) those that overlap none before them, in order of place."""
    kept: list[tuple] = []
    for x in found:
        at = bisect_left(kept, (x[0],))
        if (at == len(kept) or x[1] <= kept[at][0]) and (not at or kept[at - 1][1] <= x[0]):
            kept.insert(at, x)
    return kept


def candidates(text: str) -> list[Finding]:
    return apart(ordered(text))


class Around:
    """Where a text's words and runs of white space lie, found once for all its candidates."""

    def __init__(self, text: str):
        words = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9_]+", text)]
        self.text, self.starts, self.ends = text, [a for a, _ in words], [b for _, b in words]
        self.spaces = [m.end() for m in re.finditer(r"\s+", text)]

    def near(self, start: int, end: int) -> list[str]:
        """The four whole words before a candidate and the two after it, whatever their length."""
        before, after = bisect_right(self.ends, start), bisect_left(self.starts, end)
        return [self.text[self.starts[k] : self.ends[k]].lower() for k in (*range(max(0, before - 4), before), *range(after, min(len(self.starts), after + 2)))]

    def token(self, start: int, end: int) -> str:
        """From the last white space before a candidate to its end."""
        at = bisect_right(self.spaces, start)
        return self.text[self.spaces[at - 1] if at else 0 : end]


class Lexicon:
    """The dictionary, and log-probabilities of letter pairs in its words, for how word-like a string is."""

    def __init__(self, words: Iterable[str] = ()):
        self.common = sorted(set(words))
        self.words = DICTIONARY | set(self.common)
        n = np.full((27, 27), 0.5)
        for word in sorted(self.words):
            codes = [26, *(ord(c) - 97 for c in word if "a" <= c <= "z"), 26]
            for a, b in zip(codes, codes[1:], strict=False):
                n[a, b] += 1
        self.usual = np.log(n / n.sum(1, keepdims=True))

    def covered(self, value: str) -> float:
        """The share of a string's characters that dictionary words cover, longest first from the left."""
        low, n, i, got = value.lower(), len(value), 0, 0
        while i < n:
            for size in range(min(12, n - i), 2, -1):
                if low[i : i + size] in self.words:
                    got += size
                    i += size
                    break
            else:
                i += 1
        return got / n if n else 0.0


PLAIN = Lexicon()
WORD = re.compile(r"(?<![\w+/=-])[a-z]{%d,%d}(?![\w+/=-])" % WORD_LETTERS)


def common_words(docs: DataFrame, rows: int = WORD_ROWS) -> list[str]:
    """The rows words (a to z, in lower case) that occur most in all texts, copies counted. Tasks count slices of text first,
    so that a word comes once a slice to the shuffle. How many words have which count, in steps of an eighth of an octave,
    says from which step on to look, so that a task sends its share of the words chosen and not its own first rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = Counter(m[0] for text in batch.column(0).to_pylist() if text for m in WORD.finditer(text.lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    counted = cut(counted.groupBy("word").agg(F.sum("n").alias("n")), "words").withColumn("step", F.floor(F.log2("n") * 8))
    least, seen = 0, 0
    for step, words in sorted(counted.groupBy("step").count().collect(), reverse=True):  # some 500 steps at most
        if seen < rows:
            least, seen = step, seen + words
    found = [r.word for r in counted.where(F.col("step") >= least).orderBy(F.desc("n"), "word").limit(rows).collect()]
    discard(counted)
    return found


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


FEATURES = ("length", "classes", "changes", "letters_usual", "covered", "distinct", "entropy", "digits", "upper", "hex", "same_again", "slashes", "dots", "address", "dashes", "groups", "quoted", "code_words", "plain_words", "placeholder", *RULES)


def describe(text: str, finding: Finding, around: Around | None = None, lexicon: Lexicon = PLAIN) -> list[float]:
    start, end, rule = finding
    around = around or Around(text)
    value = text[start:end]
    n = len(value)
    kinds = [_class(c) for c in value]
    letters = [ord(c) - 97 if "a" <= c <= "z" else 26 for c in value.lower()]
    pairs = [lexicon.usual[a, b] for a, b in zip(letters, letters[1:], strict=False) if a < 26 and b < 26]
    counts = np.array(list(Counter(value).values())) / n
    before, near, token = text[max(0, start - 1) : start], around.near(start, end), around.token(start, end)
    return [
        float(np.log1p(n)), len(set(kinds)), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n, float(np.mean(pairs)) if pairs else -3.3, lexicon.covered(value), len(set(value)) / n,
        float(-(counts * np.log2(counts)).sum()), kinds.count(0) / n, kinds.count(2) / n, all(c in string.hexdigits for c in value), sum(a == b for a, b in zip(value, value[1:], strict=False)) / n,
        value.count("/") + value.count("\\"), value.count("."), "://" in token or "@" in token or token.startswith(("/", "./", "~")), value.count("-") + value.count("_"), bool(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value)),
        before[-1:] in "\"'`" and bool(before), sum(any(c in w for c in CODE_WORDS) for w in near), sum(w in PLAIN_WORDS for w in near), bool(re.search(r"example|your|xxxx|\*{3}|changeme|placeholder|dummy|sample|1234567|abcdef|\$\{|%\(|<", value, re.I)), *(rule == r for r in RULES),
    ]


def labelled_findings(seed: int = SEED, count: int = 6_000, words: Sequence[str] = ()) -> list[tuple[str, int, int, str, int]]:
    """(text, start, end, rule, label): seeded texts with one real or false secret each, as candidates() finds them. Half of
    their words come from words, where there are any, the others are made of syllables."""
    rnd = random.Random(seed)
    pick = lambda letters, n: "".join(rnd.choices(letters, k=n))
    syllables = ["an", "er", "the", "ion", "re", "ta", "mo", "ve", "lin", "sch", "que", "ado", "ung", "ent"]
    word = lambda: rnd.choice(words) if words and rnd.random() < 0.5 else "".join(rnd.choices(syllables, k=rnd.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    any_name = lambda: rnd.choice(NAMES)

    def memorable() -> str:  # a word or two that people remember, with digits or a sign among them
        swap = str.maketrans({"o": "0", "e": "3", "a": "4"})
        return rnd.choice([lambda: f"{word()}{rnd.randint(1, 99)}{word()}", lambda: f"{word().title()}{rnd.choice('!$&#')}{rnd.randint(10, 999)}", lambda: word().title().translate(swap) + rnd.choice("!$&#") + str(rnd.randint(1, 99)) + word()])()

    def real() -> str:
        hexed, mixed, strong = pick(hexes, rnd.choice([16, 18, 20, 24, 32, 40, 48, 64])), pick(alnum + "+/", rnd.choice([20, 24, 32, 40, 44, 64])), pick(alnum + "!@#%&_", rnd.randint(9, 22))
        key = rnd.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + "234567", 16)
        return rnd.choice([
            key, f'aws_access_key_id = "{key}"', key, f"{any_name()}={hexed}", f'{any_name()} = "{hexed}"', f"{any_name()}: {mixed}", f"{any_name()}={strong}", f'"{any_name()}": "{mixed}"',
            f"ghp_{pick(alnum, 36)}", f"xoxb-{pick(string.digits, 11)}-{pick(alnum, 24)}", f"AIza{pick(alnum + '_-', 35)}", f"sk_live_{pick(alnum, 24)}", f"eyJ{pick(alnum, 30)}.eyJ{pick(alnum, 50)}.{pick(alnum + '_-', 43)}",
            f"{any_name()}{rnd.choice([': ', ' = ', '='])}{memorable()}", f"{rnd.choice(['postgres', 'mysql', 'amqp', 'https'])}://{word()}:{rnd.choice([strong.replace('@', ''), memorable()])}@{word()}.{word()}/{word()}", f"SG.{pick(alnum + '_-', 22)}.{pick(alnum + '_-', 43)}",
            f"-----BEGIN RSA PRIVATE KEY-----\n{pick(alnum + '+/', 160)}\n-----END RSA PRIVATE KEY-----", f"key {mixed}", f"login with {mixed}",
        ])

    def false() -> str:
        return rnd.choice([
            f"{any_name()}={rnd.choice(['changeme', 'your_password_here', 'example', 'password', 'xxxxxxxx', '********', '${SECRET_KEY}', '<your-token>', 'placeholder', 'os.environ', 'None_given', 'REPLACE_ME_NOW'])}",
            f"{any_name()}: {word()}{word()}", f"{any_name()} = {word()}_{word()}", f'{any_name()} = "your-{word()}-here"', f"AKIA{rnd.choice(['IOSFODNN7EXAMPLE', 'XXXXXXXXXXXXXXXX', '1234567890123456', 'EXAMPLEEXAMPLEEX', 'AAAAAAAAAAAAAAAA'])}",
            f"commit {pick(hexes, 40)}", f"sha256 {pick(hexes, 64)}", f"md5: {pick(hexes, 32)}", f"checksum {pick(hexes, 40)}", f"revision {pick(hexes, 40)}", f"uuid {pick(hexes, 8)}-{pick(hexes, 4)}-{pick(hexes, 4)}-{pick(hexes, 4)}-{pick(hexes, 12)}",
            f"/usr/lib/{word()}/{word()}{rnd.randint(1, 9)}/{word()}/{word()}.so", f"https://www.{word()}.com/{word()}/{word()}{rnd.randint(1, 999)}/{word()}/index", f"{word().title()}{word().title()}{word().title()}ServiceFactory", f"{word()}{word()}{word().title()}{word()}{word()}", f"{word()}_{word()}_{word()}_{word()}_v{rnd.randint(1, 20)}",
            f"{word()}-{word()}-{word()}-{word()}-{rnd.randint(1990, 2030)}", f"serial {rnd.randint(10**11, 10**12)}-{rnd.randint(10**11, 10**12)}", f"file {word()}{rnd.randint(10, 99)}{word()}{word()}{word()}_{word()}", f"{(word() + word() + word() + word() + word()).upper()}{rnd.randint(1, 99)}", f"{any_name()}: {word()}, {word()}",
            f"{any_name()}={word()}{word()}", f"{word()}{word()}|{word()}{word()}&&&{word()}***1{word()}", f"{'ab12' * 8}", f"{any_name()}={'1' * rnd.randint(8, 20)}",
        ])

    out = []
    while len(out) < count:
        label = rnd.random() < 0.5
        text = f"{say(rnd.randint(0, 6))} {real() if label else false()} {say(rnd.randint(0, 6))}"
        out += [(text, *f, int(label)) for f in candidates(text)]
    return out[:count]


class Forest:
    """Trees as arrays: a row goes right where its feature is over the threshold; left < 0 marks a leaf."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, right: np.ndarray, share: np.ndarray, roots: np.ndarray, lexicon: Lexicon = PLAIN):
        self.feature, self.threshold, self.left, self.right, self.share, self.roots, self.lexicon = feature, threshold, left, right, share, roots, lexicon

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            inner = self.left[node] >= 0
            node = np.where(inner, np.where(x[row, self.feature[node]] > self.threshold[node], self.right[node], self.left[node]), node)
        return self.share[node].mean(1)


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> Forest:
    """Bootstrap samples, a random third of the features at each node, splits by Gini impurity."""
    rng = np.random.default_rng(seed)
    feature, threshold, left, right, share, roots = [], [], [], [], [], []

    def grow(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        for column, value in ((feature, 0), (threshold, 0.0), (left, -1), (right, -1), (share, (y[rows].sum() + 0.5) / (len(rows) + 1))):
            column.append(value)
        if depth == DEPTH or len(rows) < 2 * LEAVES_LEAST or y[rows].min() == y[rows].max():
            return me
        best = (1e-9, 0, 0.0)
        n, ones = len(rows), y[rows].sum()
        impurity = ones * (n - ones) / n
        for f in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, c = x[rows, f][order], np.cumsum(y[rows][order])
            k = np.arange(1, n)
            gain = impurity - c[:-1] * (k - c[:-1]) / k - (ones - c[:-1]) * (n - k - ones + c[:-1]) / (n - k)
            gain[(v[1:] == v[:-1]) | (k < LEAVES_LEAST) | (n - k < LEAVES_LEAST)] = 0
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, (v[i] + v[i + 1]) / 2)
        if best[0] > 1e-9:
            feature[me], threshold[me] = best[1], best[2]
            over = x[rows, best[1]] > best[2]
            left[me] = grow(rows[~over], depth + 1)
            right[me] = grow(rows[over], depth + 1)
        return me

    for _ in range(trees):
        roots.append(grow(rng.integers(0, len(y), len(y)), 0))
    return Forest(*map(np.array, (feature, threshold, left, right, share, roots)))


def fit(findings: list[tuple[str, int, int, str, int]] | None = None, words: Sequence[str] = ()) -> Forest:
    """A forest from labelled findings, at most TRAIN_ROWS of them; from the seeded set where none are given. words are added
    to the dictionary, which the forest keeps."""
    lexicon = Lexicon(words)
    rows = (findings if findings is not None else labelled_findings(words=lexicon.common))[:TRAIN_ROWS]
    forest = train(np.array([describe(t, (a, b, r), None, lexicon) for t, a, b, r, _ in rows], float), np.array([x[4] for x in rows], np.int64))
    forest.lexicon = lexicon
    return forest


def judged(text: str, forest: Forest, least: float = 0.5) -> list[tuple[int, int, str, float]]:
    """Candidates with their scores, none overlapping. What scores least or more comes first, so that a candidate that is
    thrown away hides none inside it."""
    found = ordered(text)
    if not found:
        return []
    around = Around(text)
    scores = forest.score(np.array([describe(text, f, around, forest.lexicon) for f in found], float))
    got = [(*f, float(s)) for f, s in zip(found, scores, strict=True)]
    return apart([x for x in got if x[3] >= least] + [x for x in got if x[3] < least])


SCHEMA = "doc_id long, start long, end long, rule string, score double, secret string"


def findings(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, rule, score, secret) of what the forest takes for a secret."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # some thousand nodes and WORD_ROWS words, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            rows = [(ident, a, b, rule, s, text[a:b]) for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for a, b, rule, s in judged(text, model, least) if s >= least]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, forest: Forest, least: float = 0.5, mask: str = MASK) -> DataFrame:
    """docs with every secret in text replaced by mask, and n_chars, where there is one, counted anew for changed texts."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            names = batch.schema.names
            texts = batch.column(names.index("text")).to_pylist()
            counts = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else []
            for i, text in enumerate(texts):
                found = [x for x in judged(text, model, least) if x[3] >= least] if text else []
                for a, b, _, _ in reversed(found):
                    texts[i] = texts[i][:a] + mask + texts[i][b:]
                if found and counts:
                    counts[i] = len(texts[i])
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, pa.string())
            if counts:
                columns[names.index("n_chars")] = pa.array(counts, batch.column(names.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = findings(docs, fit(words=common_words(docs)))
    return found.select("doc_id", "start", "end", "rule", "score", F.sha2("secret", 256).alias("secret_sha256"))
