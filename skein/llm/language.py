"""Language of documents and of passages by a byte convolutional network (problem 4).

The network: byte embedding, filters of several widths, max pooling over a
window and a softmax over languages.  It is trained in numpy on windows of
``WINDOW`` blocks of ``BLOCK`` bytes and applied to all windows of that length, one a
block, of the whole of every text.  The training begins on some labelled rows
(``TRAIN_ROWS`` rows per language, the first ``TRAIN_BYTES`` bytes of each), which give
the network that every part of the table begins with; each part then goes once over
all windows of its labelled rows, and the networks of the parts are averaged.

What a filter gives to a span of bytes is the sum of what it gives to two pairs of bytes,
which are looked up; its gradient is gathered by byte and place and multiplied out once
for all windows of a step.

A unit (a sentence, quotation or line; a longer run without such an end is parted at
its clauses or spaces every ``LONG`` bytes) is scored by the mean of the windows
inside it, and the languages of the units of a text are those of the best path, on
which a change of language costs ``CHANGE`` nats.

Defined results: a null, empty or letterless text has no passage and the
language null with confidence 0; other columns are ignored; equal texts get
equal passages; bytes count in the UTF-8 text as it is.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.lexicon import LANGUAGE_NAMES, LANGUAGES, label_language
from skein.llm.quality import Profiles

TRAIN_ROWS = 220  # labelled rows per language that the training begins on
TRAIN_BYTES = 3000  # bytes of each such row
RATE, CHUNK = 5e-4, 1 << 14  # step of the pass over all rows; windows that are mixed in it
EMBED, WIDTHS, FILTERS = 8, (2, 3, 4), 12  # filters of each width
BLOCK, WINDOW = 8, 6
MIN_WORDS = 12
CHANGE, LONG = 5.0, 96  # nats that a change of language costs; bytes beyond which a unit is parted
SEGMENT_SCHEMA = "doc_id bigint, label string, seg_no int, lang string, start_byte int, end_byte int, n_words int, confidence double"

# An end of a sentence, a line, a quotation mark or a clause before a quotation; the set of bytes that it begins with is searched for fast.
_UNIT = re.compile(rb"[.!?\n\xe2\xc2\",;:](?:(?<=[.!?])[\"')\]]*\s+|(?<=\n)\s*|(?<=\xe2)\x80[\x9c\x9d\x9e]|(?<=\xc2)[\xab\xbb]|(?<=\")|(?<=[,;:])\s+(?=\xe2\x80))")
_SPAN = max(WIDTHS)
_ROWS, _PLACES = 1024, 15  # blocks that are looked up at once; places of windows

_PARTS = ("embed", "conv", "bias", "out", "out_bias")


class ByteCNN:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        n = FILTERS * len(WIDTHS)
        self.conv = np.zeros((_SPAN * EMBED, n), np.float32)
        self.mask = np.zeros_like(self.conv)
        for k, width in enumerate(WIDTHS):
            self.mask[: width * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
            self.conv[: width * EMBED, k * FILTERS : (k + 1) * FILTERS] = rng.normal(0, (2 / (width * EMBED)) ** 0.5, (width * EMBED, FILTERS))
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(LANGUAGES))).astype(np.float32)
        self.out_bias = np.zeros(len(LANGUAGES), np.float32)
        self._tables = None

    def _tables_of(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the first two and the last two bytes of a span add to each filter, for each of the given pairs of bytes."""
        each = [self.embed @ self.conv[o * EMBED : (o + 1) * EMBED] for o in range(_SPAN)]
        return tuple(each[o][pairs >> 8] + each[o + 1][pairs & 255] for o in (0, 2))

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if self._tables is None:
            self._tables = self._tables_of(np.arange(1 << 16))
        return self._tables

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def pooled(self, data: np.ndarray) -> np.ndarray:
        """Filter maxima of each block of bytes; len(data) is a multiple of BLOCK."""
        first, last = self._pairs()
        padded = np.concatenate([data, np.full(_SPAN, 32, np.uint8)]).astype(np.int64)
        pair = padded[:-1] << 8 | padded[1:]
        out = np.empty((len(data) // BLOCK, len(self.bias)), np.float32)
        a, b = np.empty((2, _ROWS, len(self.bias)), np.float32)
        for at in range(0, len(out), _ROWS):
            best = out[at : at + _ROWS]
            n = len(best)
            for o in range(BLOCK):  # the spans that begin at this place of the blocks
                begin = at * BLOCK + o
                y = best if o == 0 else a[:n]
                first.take(pair[begin : begin + n * BLOCK : BLOCK], axis=0, out=y, mode="clip")
                last.take(pair[begin + 2 : begin + 2 + n * BLOCK : BLOCK], axis=0, out=b[:n], mode="clip")
                y += b[:n]
                if o:
                    np.maximum(best, y, out=best)
        out += self.bias
        return np.maximum(out, 0, out=out)

    def _maxima(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over each window, and the place where it begins."""
        x = windows.T.astype(np.int64)  # one row for each place
        pair = x[:-1] << 8 | x[1:]
        there = np.zeros(1 << 16, bool)
        there[pair] = True
        used = np.flatnonzero(there)
        first, last = self._tables_of(used)
        code = np.empty(1 << 16, np.int64)
        code[used] = np.arange(len(used))
        pair = code[pair]
        n, places = len(windows), len(pair) - 2
        a, b = np.empty((2, _PLACES, n, len(self.bias)), np.float32)
        top, arg = np.full(a.shape[1:], -np.inf, np.float32), np.zeros(a.shape[1:], np.int64)
        for o in range(0, places, _PLACES):
            g = min(_PLACES, places - o)
            y = a[:g]
            first.take(pair[o : o + g], axis=0, out=y, mode="clip")
            last.take(pair[o + 2 : o + 2 + g], axis=0, out=b[:g], mode="clip")
            y += b[:g]
            best = y.max(axis=0)
            left = ((y == best).view(np.uint8) * np.arange(g, 0, -1, np.uint8)[:, None, None]).max(axis=0)  # the first of equal ones is the greatest number
            np.copyto(arg, o + g - left.astype(np.int64), where=best > top)
            np.maximum(top, best, out=top)
        return top + self.bias, arg

    def log_probs(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 4e-3, seed: int = 7, weights: np.ndarray | None = None, state: list | None = None) -> None:
        """Adam over windows (bytes, one row each) by cross entropy with label smoothing.

        With ``weights`` of the languages a window counts as its language does, and not at all
        where the network assigns it elsewhere; ``state`` is carried from call to call.
        """
        rng = np.random.default_rng(seed)
        names = _PARTS
        if not state:
            state = state if state is not None else []
            state += [{k: np.zeros_like(getattr(self, k)) for k in names}, {k: np.zeros_like(getattr(self, k)) for k in names}, 0]
        first, second, step = state
        self._tables = None
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                xb, yb = windows[rows], labels[rows]
                top, arg = self._maxima(xb)
                hidden = np.maximum(top, 0)
                p = np.exp(self.log_probs(hidden))
                target = np.full_like(p, 0.04 / p.shape[1])
                target[np.arange(len(yb)), yb] += 0.96
                dz = (p - target) / len(yb)
                if weights is not None:
                    dz *= (weights[yb] * (p.argmax(axis=1) == yb)).astype(np.float32)[:, None]
                grads = {"out": hidden.T @ dz, "out_bias": dz.sum(0)}
                dh = (dz @ self.out.T) * (top > 0)
                grads["bias"] = dh.sum(0)
                by = _by_byte(xb, arg, dh)
                grads["conv"] = np.concatenate([self.embed.T @ x for x in by]) * self.mask
                grads["embed"] = sum(x @ self.conv[o * EMBED : (o + 1) * EMBED].T for o, x in enumerate(by))
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                    getattr(self, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        state[2] = step


def _by_byte(windows: np.ndarray, arg: np.ndarray, dh: np.ndarray) -> list[np.ndarray]:
    """For each place of a span, the sums of ``dh`` (of windows and filters) by the byte there, where a span begins at ``arg``."""
    flat, begin, n = np.ascontiguousarray(windows).reshape(-1), arg + np.arange(len(windows))[:, None] * windows.shape[1], dh.shape[1]
    out = []
    for o in range(_SPAN):
        low = sum(width <= o for width in WIDTHS) * FILTERS  # the filters before are narrower
        key = flat[begin[:, low:] + o].astype(np.int64) * n + np.arange(low, n)
        out.append(np.bincount(key.reshape(-1), dh[:, low:].reshape(-1), 256 * n).reshape(256, n).astype(np.float32))
    return out


def _bytes(text: str) -> bytes:
    """Lower case where that keeps the length in bytes, digits as one sign."""
    low = text.lower()
    data = low.encode("utf-8", "replace")
    if not low.isascii() and len(data) != len(text.encode("utf-8", "replace")):
        size = lambda c: len(c.encode("utf-8", "replace"))
        data = "".join(c.lower() if size(c.lower()) == size(c) else c for c in text).encode("utf-8", "replace")
    return data.translate(_DIGITS)


_DIGITS = bytes(48 if 48 <= b <= 57 else b for b in range(256))


def train(labelled: list[tuple[str, str]], length: int = BLOCK * WINDOW, each: int = 3000, seed: int = 7) -> ByteCNN:
    """A network fitted on (text, language) rows.

    Labels may be wrong: a first network drops the windows it assigns elsewhere
    (a wrong label disagrees with the many right ones), a second is fitted on the rest.
    """
    windows, labels = [], []
    for text, lang in sorted(labelled):
        data = np.frombuffer(_bytes(text)[:TRAIN_BYTES], np.uint8)
        n = len(data) // length
        if n:
            windows.append(data[: n * length].reshape(n, length))
            labels += [LANGUAGES.index(lang)] * n
    net = ByteCNN(seed)
    if not windows:
        return net
    x, y = np.concatenate(windows), np.array(labels)
    rng = np.random.default_rng(seed)
    keep = np.ones(len(y), bool)
    for epochs in (3, 8):
        net = ByteCNN(seed)
        pools = [np.flatnonzero((y == k) & keep) for k in range(len(LANGUAGES))]
        rows = np.concatenate([rng.choice(p, each) for p in pools if len(p)])
        net.fit(x[rows], y[rows], epochs=epochs, seed=seed)
        blocks = net.pooled(np.ascontiguousarray(x).reshape(-1)).reshape(len(x), length // BLOCK, -1)
        keep = net.log_probs(blocks.max(axis=1)).argmax(axis=1) == y
    return net


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> ByteCNN:
    """Fits the network on all labelled rows, beginning with some of them."""
    names = {name: code for code, more in LANGUAGE_NAMES.items() for name in (code, *more)}
    known = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    code = known[F.lower(F.trim(F.split(F.col(label_col), "[-_]")[0]))]
    rows = docs.select(F.col(id_col).alias("id"), code.alias("code"), F.col(text_col).alias("text")).where("code is not null")
    counts = {r["code"]: r["count"] for r in rows.groupBy("code").count().collect()}  # at most one row a language
    if not counts:
        return train([])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.3 * TRAIN_ROWS / n))])
    chance = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    some = rows.where(chance < share[F.col("code")]).where(F.length("text") >= 200)
    taken = some.select("code", F.substring("text", 1, TRAIN_BYTES).alias("text"), chance.alias("chance"))
    best: dict[str, list] = {}
    for r in taken.orderBy("chance").limit(2 * TRAIN_ROWS * len(LANGUAGES)).collect():
        if len(mine := best.setdefault(r["code"], [])) < TRAIN_ROWS:
            mine.append((r["text"], r["code"]))
    return refine(train([x for mine in best.values() for x in mine]), rows.select("code", "text"), counts)


def windows_of(text: str) -> np.ndarray:
    """All whole windows of a text, side by side."""
    data = np.frombuffer(_bytes(text), np.uint8)
    n = len(data) // (BLOCK * WINDOW)
    return data[: n * BLOCK * WINDOW].reshape(n, BLOCK * WINDOW)


def refine(net: ByteCNN, rows: DataFrame, counts: dict[str, int]) -> ByteCNN:
    """The mean of the networks that the parts of ``(code, text)`` reach in one pass over all their windows, by the windows they used."""
    weights = np.array([sum(counts.values()) / len(counts) / counts[k] if counts.get(k) else 0.0 for k in LANGUAGES])

    def run(batches):
        own, state, used = pickle.loads(pickle.dumps(net)), [], 0
        x: list[np.ndarray] = []
        y: list[int] = []

        def step():
            own.fit(np.concatenate(x), np.array(y), epochs=1, rate=RATE, weights=weights, state=state)
            x.clear()
            y.clear()

        for b in batches:
            for code, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for cut in np.split(w := windows_of(text or ""), range(CHUNK, len(w), CHUNK)):
                    if len(cut):
                        x.append(cut)
                        y += [LANGUAGES.index(code)] * len(cut)
                        used += len(cut)
                        if len(y) >= CHUNK:
                            step()
        if y:
            step()
        if used:
            flat = np.concatenate([getattr(own, k).ravel() for k in _PARTS])
            yield pa.RecordBatch.from_arrays([pa.array([used], pa.int64()), pa.array([flat.tolist()], pa.list_(pa.float32()))], names=["n", "net"])

    table = rows.mapInArrow(run, "n bigint, net array<float>").toArrow()  # a row of some thousand numbers a part
    if table.num_rows:
        n = table.column("n").to_numpy().astype(np.float64)
        mean = (np.array(table.column("net").to_pylist()) * (n / n.sum())[:, None]).sum(axis=0)
        at = 0
        for k in _PARTS:
            m = getattr(net, k)
            m[...] = mean[at : at + m.size].reshape(m.shape)
            at += m.size
        net._tables = None
    return net


def _units(data: bytes) -> list[int]:
    """Ends of the units of a text: sentences, quotations, lines; longer ones are parted at clauses or spaces."""
    ends, begin = [], 0
    marks = [m.end() for m in _UNIT.finditer(data)]
    if not marks or marks[-1] < len(data):
        marks.append(len(data))
    for e in marks:
        while e - begin > 2 * LONG:
            at = max(data.rfind(b", ", begin + LONG // 2, begin + 2 * LONG), data.rfind(b"; ", begin + LONG // 2, begin + 2 * LONG), data.rfind(b": ", begin + LONG // 2, begin + 2 * LONG)) + 2
            if at < 2:
                at = data.rfind(b" ", begin + LONG // 2, begin + LONG) + 1 or begin + LONG
            ends.append(at)
            begin = at
        ends.append(e)
        begin = e
    return ends


def _path(scores: np.ndarray) -> np.ndarray:
    """The best languages of consecutive units, where each change costs CHANGE."""
    first, *rest = scores.tolist()  # of few languages, for which lists are faster than arrays
    best, back = first, []
    for row in rest:
        most = max(best)
        j, moved = best.index(most), most - CHANGE
        back.append([i if x >= moved else j for i, x in enumerate(best)])
        best = [(x if x >= moved else moved) + y for x, y in zip(best, row)]
    out = np.empty(len(scores), np.int64)
    at = out[-1] = best.index(max(best))
    for i in range(len(back) - 1, -1, -1):
        at = out[i] = back[i][at]
    return out


def passages(net: ByteCNN, texts: list[str | None]) -> list[list[tuple[str, int, int, int, float]]]:
    """For each text its passages (language, first byte, last byte, words, confidence)."""
    parts, starts, ends, owner, low, high = [], [], [], [], [], []
    at = 0
    for k, text in enumerate(texts):
        if not text or text.isspace():
            continue
        data = _bytes(text)
        begin = at
        size = max(len(data), BLOCK * WINDOW)
        size += -size % BLOCK
        units = _units(data)
        for e in units:
            starts.append(begin)
            ends.append(at + e)
            begin = at + e
        owner += [k] * len(units)
        low += [at // BLOCK] * len(units)
        high += [(at + size) // BLOCK - WINDOW] * len(units)
        parts += [data, b" " * (size - len(data))]
        at += size
    out: list[list] = [[] for _ in texts]
    if not parts:
        return out
    flat = np.frombuffer(b"".join(parts), np.uint8)
    blocks = net.pooled(flat)
    two = np.maximum(blocks[:-1], blocks[1:])
    four = np.maximum(two[:-2], two[2:])
    logs = net.log_probs(np.maximum(four[:-2], two[4:]))  # one row for each window of WINDOW blocks
    sums = np.concatenate([np.zeros((1, logs.shape[1]), np.float64), np.cumsum(logs, axis=0, dtype=np.float64)])
    s, e, who = np.array(starts), np.array(ends), np.array(owner)
    w0, w1 = -(-s // BLOCK), e // BLOCK - WINDOW + 1  # the windows inside a unit
    bare = w1 <= w0  # none: the window in its middle
    middle = np.clip((s + e) // (2 * BLOCK) - WINDOW // 2, low, high)
    w0, w1 = np.where(bare, middle, w0), np.where(bare, middle + 1, w1)
    mean = (sums[w1] - sums[w0]) / (w1 - w0)[:, None]
    weight = (e - s) / (BLOCK * WINDOW)
    # words of each unit: starts of runs of letters
    letter = _LETTER[flat]
    begins = np.concatenate([[int(letter[0])], np.cumsum(letter[1:] & ~letter[:-1]) + int(letter[0])])
    words = begins[e - 1] - np.where(s > 0, begins[np.maximum(s - 1, 0)], 0)
    weight = np.where(words > 0, weight, 0)
    scores = mean * weight[:, None]
    top = scores.argmax(axis=1)
    begins = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))  # of the texts
    last = np.append(begins[1:], len(who))
    mixed = np.add.reduceat(np.concatenate([[False], (top[1:] != top[:-1]) & (who[1:] == who[:-1])]), begins, dtype=np.int64) > 0
    worded = np.add.reduceat(words, begins) > 0
    for a, b in zip(begins[mixed & worded].tolist(), last[mixed & worded].tolist()):
        top[a:b] = _path(scores[a:b])
    cut = np.flatnonzero(np.concatenate([[True], (top[1:] != top[:-1]) | (who[1:] != who[:-1])]))  # of the passages
    z = np.add.reduceat(scores, cut, axis=0) / np.maximum(1e-9, np.add.reduceat(weight, cut))[:, None]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    lang = top[cut]
    sure = p[np.arange(len(cut)), lang] / p.sum(axis=1)
    origin = np.repeat(s[begins], last - begins)
    ends_at = e[np.append(cut[1:], len(who)) - 1] - origin[cut]
    for k, worth, *row in zip(who[cut].tolist(), np.repeat(worded, last - begins)[cut].tolist(), lang.tolist(), (s[cut] - origin[cut]).tolist(), ends_at.tolist(), np.add.reduceat(words, cut).tolist(), sure.tolist()):
        if worth:
            out[k].append((LANGUAGES[row[0]], *row[1:]))
    return out


_LETTER = np.array([97 <= b <= 122 or b >= 128 or b in (39, 45, 48) for b in range(256)])


def segments(docs: DataFrame, net: ByteCNN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The passages of each text; the network (a few kB) travels with the function."""

    def run(batches):
        names = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                ids, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [
                    (ids[k], labels[k], i, *x)
                    for k, found_here in enumerate(passages(net, batch.column(2).to_pylist()))
                    for i, x in enumerate(found_here)
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    cols = docs.select(docs[id_col].cast("bigint"), docs[label_col].cast("string"), docs[text_col].cast("string"))
    return cols.mapInArrow(run, SEGMENT_SCHEMA)


def documents(docs: DataFrame, net: ByteCNN) -> DataFrame:
    """``(doc_id, lang, confidence, n_languages)``: the language with most words of each document, null where it has none."""
    each = segments(docs, net).groupBy("doc_id", "lang").agg(F.sum("n_words").alias("w"), (F.sum(F.col("confidence") * F.col("n_words")) / F.greatest(F.sum("n_words"), F.lit(1))).alias("c"), F.max("n_words").alias("longest"))
    main = each.groupBy("doc_id").agg(
        F.max_by("lang", F.struct("w", "lang")).alias("lang"),
        F.max_by("c", F.struct("w", "lang")).alias("confidence"),
        F.sum((F.col("longest") >= MIN_WORDS).cast("int")).alias("n_languages"),
    )
    ids = docs.select(F.col("doc_id").cast("bigint")).distinct()
    return ids.join(main, "doc_id", "left").select("doc_id", "lang", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n_languages", F.lit(0)).alias("n_languages"))


def found(docs: DataFrame, net: ByteCNN, profiles: Profiles) -> DataFrame:
    """``(doc_id, lang)``: languages of a long passage that the label does not name; texts that problem 9 reports have no row."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                ids, labels, texts = (batch.column(k).to_pylist() for k in range(3))
                rows, some = set(), {}
                for k, here in enumerate(passages(net, texts)):
                    named = label_language(labels[k])
                    langs = {lang for lang, _, _, words, _ in here if words >= MIN_WORDS and lang != named}
                    if langs:
                        some[k] = langs
                for k, kind in zip(some, profiles.kinds_of([texts[k] for k in some])):
                    if kind in ("prose", None):
                        rows |= {(ids[k], lang) for lang in some[k]}
                rows = sorted(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "lang"]
                )

    cols = docs.select(docs["doc_id"].cast("bigint"), docs["lang"].cast("string"), docs["text"].cast("string"))
    return cols.mapInArrow(run, "doc_id bigint, lang string").distinct()
