"""Encoding and decoding with a given table of byte-pair merges (see sources.sinks for its file).

Bytes are ids 0 to 255, special tokens 256 to 261, merges from 262 in rank order.
No table is trained here.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.tokens import FIRST_MERGE

# Special tokens in the order of their ids, and the pre-token pattern.
SPECIALS = ("<|BOS|>", "<|EOS|>", "<|PAD|>", "<|UNK|>", "<|USER|>", "<|ASSISTANT|>")
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_SPECIAL = re.compile("|".join(re.escape(s) for s in sorted(SPECIALS, key=len, reverse=True)))
MEMO_ENTRIES = 200_000


def merged(ids: list[int], rules: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The ids after all merges; ``rules`` maps a pair to (rank, merged id).

    A queue holds the pairs by rank and place over a doubly linked list of symbols;
    an entry whose symbols have changed since is skipped.  O(n log n).
    """
    n = len(ids)
    symbols, left, right = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
    queue: list[tuple] = []

    def offer(i: int, j: int) -> None:
        rule = rules.get((symbols[i], symbols[j]))
        if rule:
            heapq.heappush(queue, (rule[0], i, symbols[i], symbols[j], rule[1]))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, i, a, b, made = heapq.heappop(queue)
        j = right[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = made, -1
        after = right[i] = right[j]
        if after < n:
            left[after] = i
            offer(i, after)
        if left[i] >= 0:
            offer(left[i], i)
    return [s for s in symbols if s >= 0]


class MergeTable:
    """Encodes and decodes by a list of merges of ids, in rank order."""

    def __init__(self, merges: list[tuple[int, int]]):
        self.rules = {tuple(pair): (rank, FIRST_MERGE + rank) for rank, pair in enumerate(merges)}
        self.bytes_of = {i: bytes([i]) for i in range(256)}
        for (a, b), (_, made) in self.rules.items():
            self.bytes_of[made] = self.bytes_of[a] + self.bytes_of[b]
        self.special = {s: 256 + k for k, s in enumerate(SPECIALS)}
        self.memo: dict[str, list[int]] = {}

    def plain(self, text: str) -> list[int]:
        """Ids of a text in which nothing is special."""
        out: list[int] = []
        for piece in PATTERN.findall(text):
            ids = self.memo.get(piece)
            if ids is None:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                ids = self.memo[piece] = merged(list(piece.encode("utf-8", "surrogatepass")), self.rules)
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        out, at = [], 0
        for mark in _SPECIAL.finditer(text or ""):
            out += [*self.plain(text[at : mark.start()]), self.special[mark[0]]]
            at = mark.end()
        return out + self.plain((text or "")[at:])

    def decode(self, ids) -> str:
        """Special tokens break the bytes; unknown ids are skipped."""
        names = {i: s for s, i in self.special.items()}
        parts: list[bytes | str] = [b""]
        for i in map(int, ids):
            if i in names:
                parts += [names[i], b""]
            else:
                parts[-1] += self.bytes_of.get(i, b"")
        return "".join(p if isinstance(p, str) else p.decode("utf-8", "replace") for p in parts)


@lru_cache(4)
def _table(merges: tuple[tuple[int, int], ...]) -> MergeTable:
    """One table a worker process, with its memo."""
    return MergeTable(list(merges))


def encoder(merges: list[tuple[int, int]], end: int | None = None):
    """A column function text -> ids, with ``end`` appended where given."""
    own = tuple(map(tuple, merges))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _table(own).encode(t) + ([] if end is None else [end]))

    return lambda c: run(c)


def decoder(merges: list[tuple[int, int]]):
    own = tuple(map(tuple, merges))

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: _table(own).decode(x if x is not None else []))

    return lambda c: run(c)


def pretokens(c: Column) -> Column:
    """The pre-tokens of a text, JVM-side; white space as Python has it."""
    space = r"\t-\r\x1C- \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    return F.regexp_extract_all(c, F.lit(rf"('s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|[{space}]+(?![^{space}])|[{space}]+)"), F.lit(1))
