"""Words that a scanner has misread: links between spellings, skip-gram vectors, and the judgement of each occurrence.

Links: characters that scanners confuse are written with the same pen strokes (``rn``
and ``m``, ``cl`` and ``d``, ``l`` and ``1``), so spellings that glyph edits turn into
each other have one stroke key, whatever the number of edits and the length; the edits
are then counted by an alignment of the two spellings.

Prior: of a word seen m times a certain misreading is expected in RATE (RATE times
SECOND with a further edit) of them, more in some books than in others, so that their
number has a geometric tail.  The chance of at least the n seen stands against the
chance TRUE that a spelling beside a known word is a word of its own.  EXTRA misreadings
are granted to every word, as a book may have its own; beyond them only the ratio of the
counts matters, so that a larger corpus is judged as a small one.

Fit: skip-gram with negative sampling.  The vectors of a word are rows of a table of
ROWS rows, found by two hashes, so that every word has one whatever the vocabulary.
The pages are dealt to PARTS parts or more (PAGES pages of each at most on average), the
neighbours of each part are counted, a table is learnt on the counts of each part, and
the tables are averaged.  A pair met often is learnt in pieces of some of its count.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 5  # times that a correction is seen
RATE, EXTRA, SECOND, TRUE, FLOOR = 0.01, 1.5, 0.05, 0.03, -12.0
WEIGHT, CLIP, SHRINK = 0.35, 8.0, 20  # of the fit of a context against the prior; bound on the fit of one word; count of which it has half
PAGES, PARTS, EPOCHS = 50_000, 8, 2  # pages of a part, least parts, passes over the pairs of a part
PIECES = 1 << 18  # about as many steps are made for the pairs met often
ROWS, SIZE, REACH, NEGATIVES, POOL = 1 << 15, 32, 2, 3.0, 256
BATCH, PACE, FREQUENT_SHARE = 2048, 0.15, 1e-3
MEMO = 1 << 17  # words whose vectors a worker keeps

# Fixed values: (as read, as printed) characters that scanners confuse.
GLYPHS = (
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"), ("ii", "u"), ("u", "ii"),
    ("0", "o"), ("o", "0"), ("1", "l"), ("1", "i"), ("l", "1"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("s", "5"), ("$", "s"), ("8", "b"), ("6", "b"),
    ("9", "g"), ("g", "9"), ("b", "6"), ("q", "g"), ("g", "q"), ("c", "e"), ("e", "c"), ("h", "b"), ("b", "h"), ("t", "f"), ("f", "t"), ("u", "n"), ("n", "u"),
    ("i", "l"), ("l", "i"), ("l", "t"), ("t", "l"), ("j", "i"), ("i", "j"), ("n", "ri"), ("ri", "n"), ("in", "m"), ("m", "in"), ("4", "a"), ("@", "a"), ("3", "e"), ("7", "t"), ("2", "z"),
)
# The strokes of the characters above; all others are strokes of their own.
STROKES = {
    "i": "l", "t": "l", "f": "l", "j": "l", "r": "l", "1": "l", "!": "l", "|": "l", "7": "l", "h": "ll", "b": "ll", "6": "ll", "8": "ll", "u": "ll", "n": "ll", "m": "lll",
    "e": "c", "3": "c", "d": "cl", "w": "vv", "0": "o", "5": "s", "$": "s", "9": "g", "q": "g", "4": "a", "@": "a", "2": "z",
}
# The letter that a digit or sign within a word most often stands for.
LETTERS = {"0": "o", "1": "l", "!": "i", "|": "l", "7": "t", "6": "b", "8": "b", "3": "e", "5": "s", "$": "s", "9": "g", "4": "a", "@": "a", "2": "z"}
_STROKES, _LETTERS = str.maketrans(STROKES), str.maketrans(LETTERS)
_PRINTED: dict[str, tuple[str, ...]] = {}
for _read, _as in GLYPHS:
    _PRINTED[_read] = (*_PRINTED.get(_read, ()), _as)


def strokes(word: str) -> str:
    return word.translate(_STROKES)


def has_signs(word: str) -> bool:
    return any(c in LETTERS for c in word)


def edits(read: str, printed: str, most: int) -> int | None:
    """Fewest glyph edits that turn what is read into what is printed, a repeated one counting once where it is the only one; None beyond ``most``."""
    if any(a in read and read.replace(a, b) == printed for a, b in GLYPHS):
        return 1  # one character misread in all its places
    best = {(0, 0): 0}
    for i in range(len(read) + 1):
        for j in range(len(printed) + 1):
            here = best.get((i, j))
            if here is None or here > most:
                continue
            if i < len(read) and j < len(printed) and read[i] == printed[j]:
                best[i + 1, j + 1] = min(here, best.get((i + 1, j + 1), 99))
            for width in (1, 2):
                for out in _PRINTED.get(read[i : i + width], ()) if i + width <= len(read) else ():
                    if printed.startswith(out, j):
                        k = (i + width, j + len(out))
                        best[k] = min(here + 1, best.get(k, 99))
    found = best.get((len(read), len(printed)))
    return found if found is not None and 0 < found <= most else None


def prior(n: int, m: int, steps: int, signs: bool = False) -> float:
    """Log odds that a spelling seen n times misreads a word seen m times, before its context."""
    mean = (RATE * m + EXTRA) * SECOND ** (steps - 1)
    return max(FLOOR, -n * math.log1p(1 / max(mean, 1e-9))) - math.log(TRUE) + (3.0 if signs else 0.0)


def links(words: DataFrame) -> DataFrame:
    """``(word, correction, prior, n, m)``: spellings that may misread a word, the odds before any context, the counts of both.

    ``words`` is ``(word, n)``.  Pairs are sought within a stroke key, each spelling against
    the words of the key seen LEAST times.  A digit or sign between letters is read as a letter
    also where no such word is known.
    """
    fields = "word string, n bigint, key string, plain string"

    def run(batches):
        for batch in batches:
            own, n = batch.column(0).to_pylist(), batch.column(1)
            plain = [w.translate(_LETTERS) if has_signs(w) else None for w in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array([strokes(w) for w in own], pa.string()), pa.array(plain, pa.string())], names=["word", "n", "key", "plain"])

    keyed = words.select("word", "n").mapInArrow(run, fields)
    known = keyed.where((F.col("n") >= LEAST) & F.col("plain").isNull()).select("key", F.col("word").alias("correction"), F.col("n").alias("m"))
    both = keyed.join(known, "key").where("word <> correction and (m >= n or n >= 20)").select("word", "n", "correction", "m")
    bare = keyed.where("plain is not null").where(F.col("word").rlike(r"^\p{L}.*\p{L}$")).select("word", "n", F.col("plain").alias("correction"), F.lit(0).cast("bigint").alias("m"))

    def judge(batches):
        for batch in batches:
            rows = []
            for w, n, c, m in zip(*(batch.column(k).to_pylist() for k in range(4))):
                signs = has_signs(w)
                if not m:
                    # seen but once or twice: a letter misread; often: a name such as mp3
                    rows.append((w, c, 1.5 - 1.2 * math.log(n), n, 0))
                elif (steps := edits(w, c, 2 if len(w) > 5 else 1)) is not None:
                    odds = prior(n, m, steps, signs)
                    if odds + WEIGHT * 2 * CLIP > 0:
                        rows.append((w, c, odds, n, m))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["word", "correction", "prior", "n", "m"])

    found = both.unionByName(bare).mapInArrow(judge, "word string, correction string, prior double, n bigint, m bigint")
    return found.groupBy("word", "correction").agg(*[F.max(c).alias(c) for c in ("prior", "n", "m")])


# ---------------------------------------------------------------- skip-gram


def rows_of(words: list[str]) -> np.ndarray:
    """Two rows of the table for each word."""
    data = [w.encode("utf-8", "replace") for w in words]
    return np.array([[zlib.crc32(d) & ROWS - 1, zlib.crc32(d, 0x9747B28C) & ROWS - 1] for d in data], np.int64).reshape(-1, 2)


def _start() -> np.ndarray:
    return np.random.default_rng(17).normal(0, 0.3 / SIZE**0.5, (ROWS, SIZE)).astype(np.float32)


def pairs_of(pages: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, times met) of words, by their codes, at most REACH apart on a page."""
    ids = np.array([w for page in pages for w in [*page, *[-1] * REACH]], np.int64)
    met = []
    for shift in range(1, REACH + 1):
        a, b = ids[:-shift], ids[shift:]
        ok = (a >= 0) & (b >= 0)
        a, b = a[ok], b[ok]
        met.append(np.minimum(a, b) << 2 * _BITS | np.maximum(a, b))
    return np.unique(np.concatenate(met), return_counts=True)


_BITS = ROWS.bit_length() - 1


def code_of(word: str) -> int:
    """Both rows of a word as one number."""
    a, b = rows_of([word])[0].tolist()
    return a << _BITS | b


def train(pages: list[list[str]], seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, word vectors, context vectors, words seen) of skip-gram with negative sampling on the pages."""
    return train_pairs(*pairs_of([[code_of(w) for w in page] for page in pages]), seed)


def train_pairs(pairs: np.ndarray, times: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same on pairs of neighbours and the times that each was met."""
    rng = np.random.default_rng(seed)
    if not len(pairs):
        return np.zeros(0, np.int64), np.zeros((0, SIZE), np.float32), np.zeros((0, SIZE), np.float32), np.zeros(0, np.int64)
    codes, ids = np.unique(np.concatenate([pairs >> 2 * _BITS, pairs & (1 << 2 * _BITS) - 1]), return_inverse=True)
    table = np.stack([codes >> _BITS, codes & ROWS - 1], axis=1)
    left, right, n = ids, np.concatenate([ids[len(pairs) :], ids[: len(pairs)]]), np.tile(times, 2)
    counts = np.bincount(left, weights=n, minlength=len(codes))
    noise = counts**0.75
    noise /= noise.sum()
    steps = np.minimum(np.cumsum(noise), 1 - 1e-12)
    steps[-1] = 1.0
    v, u = _start(), np.zeros((ROWS, SIZE), np.float32)
    share = counts / counts.sum()
    keep = np.minimum(1.0, np.sqrt(FREQUENT_SHARE / np.maximum(share, 1e-12)) + FREQUENT_SHARE / np.maximum(share, 1e-12))
    pace_v, pace_u = np.full(ROWS, 1e-4, np.float32), np.full(ROWS, 1e-4, np.float32)
    piece = max(1, int(n.sum()) // PIECES)
    parts = -(-n // piece)
    cells = np.repeat(np.arange(len(n)), parts)
    weights = (n / parts * keep[left])[cells]
    for _ in range(EPOCHS):
        # a piece that counts less than once is met as often as that
        order = rng.permutation(np.flatnonzero(rng.random(len(cells)) < weights))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            weight = np.maximum(weights[pick], 1).astype(np.float32)[:, None]
            cell = cells[pick]
            pool = table[np.searchsorted(steps, rng.random(POOL))]
            ra, rb = table[left[cell]], table[right[cell]]
            x, y, z = (np.take(m, r[:, 0], axis=0) + np.take(m, r[:, 1], axis=0) for m, r in ((v, ra), (u, rb), (u, pool)))
            good = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", x, y), -12, 12)))
            bad = x @ z.T
            np.clip(bad, -12, 12, out=bad)
            np.negative(bad, out=bad)
            np.exp(bad, out=bad)
            bad += 1
            np.divide(weight * np.float32(NEGATIVES / POOL), bad, out=bad)
            pull = (1 - good)[:, None] * weight
            _move(v, pace_v, ra, pull * y - bad @ z)
            _move(u, pace_u, np.concatenate([rb, pool]), np.concatenate([pull * x, -(bad.T @ x)]))
    seen = np.unique(table)
    met = np.bincount(table.ravel(), weights=np.repeat(counts, 2), minlength=ROWS)[seen].astype(np.int64)
    return seen, v[seen], u[seen], met


def _move(target: np.ndarray, pace: np.ndarray, rows: np.ndarray, delta: np.ndarray) -> None:
    """One step of every row met in a batch along the sum of its deltas, smaller the more the row has moved (AdaGrad by rows)."""
    flat = rows.ravel(order="F")
    order = np.argsort(flat.astype(np.uint16), kind="stable")  # ROWS fit
    r = flat[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    sums = np.add.reduceat(np.take(delta, order % len(delta), axis=0), first, axis=0)
    own = r[first]
    pace[own] += (sums**2).mean(axis=1)
    target[own] += sums * (PACE / np.sqrt(pace[own]))[:, None]


class Model:
    """Vectors of all words, as a table of hashed rows; those of words met are kept, MEMO of them."""

    def __init__(self, v: np.ndarray, u: np.ndarray):
        self.v, self.u = v, u
        self.near: dict[str, tuple[np.ndarray, np.ndarray, bool]] = {}

    def __getstate__(self):
        return self.__dict__ | {"near": {}}

    def of(self, word: str) -> tuple[np.ndarray, np.ndarray, bool]:
        """(vector as a word, vector as a context, whether any context was learnt)."""
        found = self.near.get(word)
        if found is None:
            if len(self.near) >= MEMO:
                self.near.clear()
            rows = rows_of([word])[0]
            y = self.u[rows].sum(axis=0)
            found = self.near[word] = self.v[rows].sum(axis=0), y, bool(y.any())
        return found

    def fit(self, words: list[str], context: list[str]) -> np.ndarray:
        """Of each word the sum over the context of the log ratio of being seen there to chance."""
        known = [self.of(c) for c in context]
        total = sum((y for _, y, _ in known), np.zeros(SIZE, np.float32))
        base = math.log(NEGATIVES) * sum(k for _, _, k in known)
        return np.clip([float(self.of(w)[0] @ total) + base for w in words], -CLIP, CLIP)


def learn(pages: DataFrame, tokens) -> Model:
    """The averaged table of the parts of all pages; ``tokens(text, drop)`` gives the words of a page.

    ``pages`` is ``(page_id, text, drop)``; a page belongs to a part by its hash.
    """
    parts = max(PARTS, -(-pages.count() // PAGES))
    dealt = pages.select(F.pmod(F.xxhash64(F.lit(9), "page_id"), F.lit(parts)).cast("int").alias("part"), "text", "drop")

    def count(batches):
        memo: dict[str, int] = {}
        met: dict[int, list] = {}

        def gathered():
            for part, own in met.items():
                pairs, back = np.unique(np.concatenate([p for p, _ in own]), return_inverse=True)
                n = np.bincount(back, weights=np.concatenate([k for _, k in own])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), part), pa.int32()), pa.array(pairs), pa.array(n)], names=["part", "pair", "n"])
            met.clear()

        for b in batches:
            read: dict[int, list] = {}
            for part, text, drop in zip(*(b.column(k).to_pylist() for k in range(3))):
                page = []
                for w in tokens(text, drop):
                    k = memo.get(w)
                    if k is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        k = memo[w] = code_of(w)
                    page.append(k)
                read.setdefault(part, []).append(page)
            for part, own in read.items():
                met.setdefault(part, []).append(pairs_of(own))
            if sum(len(p) for own in met.values() for p, _ in own) > 1 << 22:
                yield from gathered()
        yield from gathered()

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("pair")
        rows, v, u, n = train_pairs(table.column("pair").to_numpy(), table.column("n").to_numpy())
        v, u = (m * n[:, None].astype(np.float32) for m in (v, u))
        return pa.table({"row": pa.array(rows, pa.int32()), "v": _lists(v), "u": _lists(u), "n": pa.array(n, pa.int64())})

    def total(batches):
        n, sums = np.zeros(ROWS), np.zeros((2, ROWS, SIZE))
        for b in batches:
            rows = b.column(0).to_numpy()
            np.add.at(n, rows, b.column(3).to_numpy())
            for k in range(2):
                np.add.at(sums[k], rows, b.column(1 + k).flatten().to_numpy().reshape(-1, SIZE))
        rows = np.flatnonzero(n)
        v, u = (sums[k][rows] / n[rows, None] for k in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), _lists(v.astype(np.float32)), _lists(u.astype(np.float32)), pa.array(n[rows].astype(np.int64))], names=["row", "v", "u", "n"])

    fields = "row int, v array<float>, u array<float>, n bigint"
    pairs = dealt.mapInArrow(count, "part int, pair bigint, n bigint").groupBy("part", "pair").agg(F.sum("n").alias("n"))
    learnt = pairs.groupBy("part").applyInArrow(fit, fields)
    table = learnt.repartition(PARTS, "row").mapInArrow(total, fields).toArrow()  # at most ROWS rows
    v, u = np.zeros((ROWS, SIZE), np.float32), np.zeros((ROWS, SIZE), np.float32)
    if table.num_rows:
        rows = table.column("row").to_numpy()
        for m, c in ((v, "v"), (u, "u")):
            m[rows] = np.asarray(table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, SIZE)
    return Model(v, u)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(m.ravel(), pa.float32()), SIZE).cast(pa.list_(pa.float32()))


class Judge:
    """Decides occurrences; holds the links of the words that a worker meets often."""

    def __init__(self, model: Model, near: list[tuple[str, str, float, int, int]]):
        self.model = model
        self.near: dict[str, list[tuple[str, float, int, int]]] = {}
        for w, *link in near:
            self.near.setdefault(w, []).append(tuple(link))
        self.words = frozenset(self.near)

    def best(self, word: str, options: list[tuple[str, float, int, int]], context: list[str] | None) -> str | None:
        """The reading of one occurrence that is likelier than the word as it stands, or None.

        The fit of a word seen n times counts n / (n + SHRINK): a rare one has seen little but this place.
        """
        options = sorted(options)
        fits = self.model.fit([word, *(c for c, *_ in options)], context or [])
        own = fits[0] * options[0][2] / (options[0][2] + SHRINK)
        odds = [p + WEIGHT * (f * m / (m + SHRINK) - own) for (_, p, _, m), f in zip(options, fits[1:])]
        k = int(np.argmax(odds))
        return options[k][0] if odds[k] > 0 else None

    def reading(self, word: str, context: list[str]) -> str | None:
        return self.best(word, self.near[word], context)
