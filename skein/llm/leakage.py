"""Evaluation passages leaking into a training corpus (problem 8).

Windows are sized to the item: a passage gives SimHash fingerprints of its windows of a
quarter of its words (rounded down to a multiple of ``GRAIN``, at most ``LONGEST``), as
the larger part of a reproduced half that a foreign sentence splits still holds one; a
document gives those of its windows of each size in use.  A word's vector is the sum of
the hashed signs of its character trigrams, words found in many passages weigh less, so a
misspelt word moves a fingerprint little.  Fingerprints are indexed in ``BLOCKS`` blocks:
two of them within ``RADIUS`` bits share a block within RADIUS // BLOCKS bits, so the
block index returns every one within the radius.  Candidates are verified by weighted
shingle similarity and by an alignment of the words in order.

Passages go through the documents in blocks of ``PASSAGES`` (one pass each), whose index
travels with the function; documents are read without a shuffle.

Defined results: null and empty texts and items leak nothing, nor does an item that is
nothing but a question; passages below ``MIN_WORDS`` words are left out; more than
``MAX_ITEMS`` items raise an error; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

GRAIN, LONGEST = 4, 24  # words by which window sizes differ, words of the longest
BITS, BLOCKS, RADIUS = 64, 4, 11
SCALE, MOST, CHUNK = 500, 1350, 4096  # fixed-point vectors, bound of a value (LONGEST of them fit 16 bits); windows summed at once
COMMON_SHARE, COMMON_WEIGHT = 0.06, 0.5
MIN_WORDS, MAX_ITEMS, PASSAGES = 12, 100_000, 2000
SHARE, ALTERED, FOREIGN = 0.5, 0.1, 45  # share of the passage, of altered words, words of a foreign sentence
MIN_SHINGLE = 0.18
MEMO_WORDS = 300_000  # bound on the words whose vectors a worker keeps

_TAG = re.compile(r"<[^<>]{1,80}>|&[a-z]{2,6};")
_PREFIX = re.compile(r"(?m)^[ \t]*(?:(?:[>#*+|•·–-]+|\(?\d{1,4}[.):|])[ \t]+)+")
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?]*[.!?]+[\"'”)]*\s*|[^.!?]+$")


def words_of(text: str | None) -> list[str]:
    """Lower-case words, without markup, line prefixes and punctuation."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "\n" in text:
        text = _PREFIX.sub("", text)
    return _WORD.findall(text.lower().replace("\u00ad", ""))


def passages_of(items: list[tuple[int, str | None]]) -> list[tuple[list[str], list[int]]]:
    """(words, item ids) of each passage: no closing question, no instruction that many items begin with."""
    pieces = {i: [s.strip() for s in _SENTENCE.findall(c or "") if s.strip()] for i, c in items}
    opens = Counter(" ".join(words_of(p[0])) for p in pieces.values() if len(p) > 1)
    many = max(5, len(pieces) // 30)
    found: dict[tuple[str, ...], list[int]] = {}
    for i, p in sorted(pieces.items()):
        if len(p) > 1 and opens[" ".join(words_of(p[0]))] >= many:
            p = p[1:]
        if p and p[-1].rstrip("\"'”)").endswith("?"):
            p = p[:-1]
        words = tuple(w for s in p for w in words_of(s))
        if len(words) >= MIN_WORDS:
            found.setdefault(words, []).append(i)
    return [(list(w), ids) for w, ids in found.items()]


def _signs(gram: bytes) -> np.ndarray:
    """64 pseudo-random signs of a character trigram."""
    mask = (1 << 64) - 1
    key = (zlib.crc32(gram) | zlib.crc32(gram, 0x5BD1E995) << 32) * 0x9E3779B97F4A7C15 & mask
    key ^= key >> 29
    key = key * 0xBF58476D1CE4E5B9 & mask
    return np.unpackbits(np.frombuffer(key.to_bytes(8, "little"), np.uint8)).astype(np.float32) * 2 - 1


def window_of(n_words: int) -> int:
    """Words of the windows of a passage of so many words."""
    return min(LONGEST, max(GRAIN, n_words // 4 // GRAIN * GRAIN))


def steps_of(window: int) -> tuple[int, int]:
    """(step of a document's windows, step of a passage's); they have no common factor, so some windows lie alike."""
    step = max(1, window // 4)
    return step, 2 if step % 2 else 3 if step % 3 else 1


class PassageIndex:
    def __init__(self, passages: list[tuple[list[str], list[int]]], common: set[str] | None = None):
        self.passages = passages
        self.common = common_words(passages) if common is None else common
        self.rows: dict[str, int] = {}
        self.signs: dict[str, np.ndarray] = {}
        self.vectors = np.zeros((1 << 14, BITS), np.int16)
        #: of each window size the fingerprints, the passages they come from, and the tables of their blocks
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, list]] = {}
        by: dict[int, tuple[list, list]] = {}
        for k, (words, _) in enumerate(passages):
            size = window_of(len(words))
            p = self.prints(words, {size: steps_of(size)[1]})[size]
            prints, owner = by.setdefault(size, ([], []))
            prints.append(p)
            owner += [k] * len(p)
        for size, (prints, owner) in sorted(by.items()):
            own = np.concatenate(prints)
            self.sizes[size] = own, np.array(owner, np.int32), [self._table(own, b) for b in range(BLOCKS)]
        self.steps = {size: steps_of(size)[0] for size in self.sizes}
        self.shingles = [_weighted(w, self.common) for w, _ in passages]

    @staticmethod
    def _table(fingerprints: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """CSR lists of fingerprints whose block lies within RADIUS // BLOCKS bits of each value."""
        width = BITS // BLOCKS
        masks = [0]
        for _ in range(RADIUS // BLOCKS):
            masks = sorted({m ^ (1 << b) for m in masks for b in range(width)} | set(masks))
        own = (fingerprints >> np.uint64(block * width)).astype(np.uint32) & np.uint32((1 << width) - 1)
        values = (own[:, None] ^ np.array(masks, np.uint32)[None]).ravel()
        which = np.repeat(np.arange(len(own), dtype=np.int32), len(masks))
        order = np.argsort(values, kind="stable")
        ends = np.cumsum(np.bincount(values, minlength=1 << width))
        return np.concatenate([[0], ends]), which[order]

    def _row(self, word: str) -> int:
        row = self.rows.get(word)
        if row is None:
            row = len(self.rows)
            if row >= len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            marked = f"^{word}$"
            total = np.zeros(BITS, np.float32)
            for g in {marked[i : i + 3] for i in range(len(marked) - 2)}:
                signs = self.signs.get(g)
                if signs is None:
                    if len(self.signs) > MEMO_WORDS:
                        self.signs.clear()
                    signs = self.signs[g] = _signs(g.encode("utf-8", "replace"))
                total += signs
            norm = float(np.sqrt((total**2).mean())) or 1.0
            self.vectors[row] = np.clip(np.rint(total / norm * SCALE * (COMMON_WEIGHT if word in self.common else 1.0)), -MOST, MOST)
            self.rows[word] = row
        return row

    def prints(self, words: list[str], steps: dict[int, int]) -> dict[int, np.ndarray]:
        """Of each window size the fingerprints of the windows of the words, one every ``steps[size]`` words."""
        rows = self.rows
        if len(rows) > MEMO_WORDS:
            rows.clear()
        ids = np.array([rows.get(w, -1) for w in words], np.int64)
        for k in np.flatnonzero(ids < 0).tolist():
            ids[k] = self._row(words[k])
        out: dict[int, list] = {size: [] for size in steps}
        for at in range(0, len(ids), CHUNK):  # windows that begin in [at, at + CHUNK)
            v = self.vectors[ids[at : at + CHUNK + LONGEST - 1]]
            two = v[:-1] + v[1:]
            four = two[:-2] + two[2:]
            for size, step in steps.items():
                last = min(CHUNK, len(v) - size + 1)
                begin = -at % step
                if last <= begin:
                    continue
                sums = four[begin:last:step]
                for k in range(GRAIN, size, GRAIN):
                    sums = sums + four[begin + k : last + k : step]
                out[size].append(np.packbits(sums > 0, axis=1).view(np.uint64).ravel())
        return {size: np.concatenate(parts) if parts else np.zeros(0, np.uint64) for size, parts in out.items()}

    def candidates(self, size: int, prints: np.ndarray) -> list[tuple[int, int]]:
        """Every (window, passage) of a size whose fingerprints lie within RADIUS bits."""
        out = []
        width = BITS // BLOCKS
        fingerprints, owner, tables = self.sizes[size]
        for at in range(0, len(prints), 2048):
            part = prints[at : at + 2048]
            for block, (ends, which) in enumerate(tables):
                values = (part >> np.uint64(block * width)).astype(np.int64) & ((1 << width) - 1)
                lo, n = ends[values], ends[values + 1] - ends[values]
                total = int(n.sum())
                if not total:
                    continue
                window = np.repeat(np.arange(len(part), dtype=np.int32), n)
                start = np.cumsum(n) - n
                prints_of = which[np.arange(total) + np.repeat(lo - start, n)]
                near = np.flatnonzero(np.bitwise_count(part[window] ^ fingerprints[prints_of]) <= RADIUS)
                if len(near):
                    out += zip((window[near] + at).tolist(), owner[prints_of[near]].tolist())
        return list(set(out))

    def leaked(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """For each text the (passage, share of its words) of each passage it reproduces."""
        flat, begin = [], [0]
        for text in texts:
            flat += words_of(text)
            flat += [""] * LONGEST  # windows over two texts are cut off
            begin.append(len(flat))
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        hits: dict[tuple[int, int], list[int]] = {}
        for size, prints in self.prints(flat, self.steps).items():
            for window, passage in self.candidates(size, prints):
                at = window * self.steps[size]
                doc = bisect_right(begin, at) - 1
                hits.setdefault((doc, passage), []).append(at - begin[doc])
        for (doc, passage), at in sorted(hits.items()):
            words = flat[begin[doc] : begin[doc + 1] - LONGEST]
            own = self.passages[passage][0]
            best, reach, size = 0.0, len(own) + FOREIGN, window_of(len(own))
            at.sort()
            k = 0
            while k < len(at):  # hits close to one another are one region
                j = k
                while j + 1 < len(at) and at[j + 1] - at[j] <= reach:
                    j += 1
                region = words[max(0, at[k] - reach) : at[j] + size + reach]
                if self._shingle_share(passage, region) >= MIN_SHINGLE:
                    best = max(best, reproduced(own, region))
                k = j + 1
            if best >= SHARE:
                out[doc].append((passage, best))
        return out

    def _shingle_share(self, passage: int, region: list[str]) -> float:
        """Share of the passage's two-word shingles, rarer ones weighing more, that the region holds."""
        weights, total = self.shingles[passage]
        return sum(map(weights.get, weights.keys() & set(zip(region, region[1:])))) / total if total else 0.0


def common_words(passages: list[tuple[list[str], list[int]]]) -> set[str]:
    spread = Counter(w for words, _ in passages for w in set(words))
    return {w for w, n in spread.items() if n > max(1, COMMON_SHARE * len(passages))}


def _weighted(words: list[str], common: set[str]) -> tuple[dict[tuple[str, str], float], float]:
    """(weights of the two-word shingles of a passage, their sum); a common word lowers a weight."""
    out = {g: n * (1.0, 0.7, 0.3)[(g[0] in common) + (g[1] in common)] for g, n in Counter(zip(words, words[1:])).items()}
    return out, sum(out.values())


def reproduced(passage: list[str], region: list[str]) -> float:
    """Largest share of the passage that a stretch of the region gives in order.

    A stretch is a chain of equal runs; between two runs a few altered words may
    stand, and once a foreign sentence.  Words left out of the passage in one
    piece are not given, words altered count as given while at most ALTERED of
    the stretch.
    """
    runs = [b for b in SequenceMatcher(None, passage, region, autojunk=False).get_matching_blocks() if b.size]
    best = 0.0
    for first in range(len(runs)):
        given, altered, foreign = 0, 0, 0
        last = None
        for run in runs[first:]:
            if last is not None:
                gap_p, gap_r = run.a - last.a - last.size, run.b - last.b - last.size
                if max(gap_p, gap_r) <= 4:
                    altered += max(gap_p, gap_r)
                    given += min(gap_p, gap_r)
                elif gap_r <= 4:  # a part of the passage is left out
                    altered += gap_r
                elif gap_r <= FOREIGN and not foreign:
                    foreign = 1
                else:
                    break
            given += run.size
            last = run
            if altered <= max(1.0, ALTERED * given) and given / len(passage) > best and given - altered >= 0.4 * len(passage):
                best = given / len(passage)
    return best


_built: dict[int, PassageIndex] = {}


def found(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id)`` of every document and item whose passage it reproduces."""
    return leaks(docs, items, id_col, text_col).select("doc_id", "item_id").distinct()


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, share)``."""
    rows = items.select("item_id", "context").where("context is not null").distinct().limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    passages = passages_of(sorted((r["item_id"], r["context"]) for r in rows))
    common = common_words(passages)
    cols = docs.select(docs[id_col].cast("bigint"), docs[text_col].cast("string"))
    parts = [_leaks(cols, passages[at : at + PASSAGES], common) for at in range(0, max(1, len(passages)), PASSAGES)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _leaks(cols: DataFrame, passages: list[tuple[list[str], list[int]]], common: set[str]) -> DataFrame:
    key = hash(tuple((tuple(w), tuple(i)) for w, i in passages))

    def run(batches):
        if key not in _built:
            _built.clear()
            _built[key] = PassageIndex(passages, common)
        index = _built[key]
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                for doc, here in zip(part.column(0).to_pylist(), index.leaked(part.column(1).to_pylist())):
                    out += [(doc, item, share) for p, share in here for item in passages[p][1]]
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["doc_id", "item_id", "share"]
            )

    return cols.mapInArrow(run, "doc_id bigint, item_id bigint, share double")
