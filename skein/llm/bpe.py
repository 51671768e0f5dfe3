"""Byte-level BPE encoding of a whole table with a public tokenizer (problem 7).

A text is cut into pre-tokens by the public byte-level pattern; each pre-token
is merged by a priority queue of merge ranks over a doubly linked list of
symbols (stale queue entries are skipped when popped).  A pre-token's ids do not
depend on its neighbours, so every worker keeps a bounded memo of pre-tokens.

Defined results: a null or empty text gives the empty list; strings that look
like special tokens are plain text; any other column is ignored.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from skein.functions.merges import merged

TOKENIZER_DIR = "/opt/tokenizers"
MEMO_ENTRIES = 400_000  # bound on the per-process memo of pre-tokens

# The public pre-token pattern, with its white space spelt out.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNICODE = regex.compile(
    rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)
_ASCII = re.compile(
    r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)


def pretokens(text: str) -> list[str]:
    return (_ASCII if text.isascii() else _UNICODE).findall(text)


def byte_letters() -> dict[str, int]:
    """The vocabulary file writes each byte as one printable letter; letter -> byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder over a vocabulary file ``<directory>/<name>.json``."""

    def __init__(self, name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR):
        model = json.loads(Path(directory, f"{name}.json").read_text(encoding="utf-8"))["model"]
        letters = byte_letters()
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if all(c in letters for c in s)}
        self.of_byte = [0] * 256
        for i, b in self.bytes_of.items():
            if len(b) == 1:
                self.of_byte[b[0]] = i
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        self.memo: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: a queue of merge ranks over a doubly linked list of symbols."""
        return merged([self.of_byte[b] for b in data], self.merges)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.memo, []
        for word in pretokens(text):
            ids = memo.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "surrogatepass"))
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                if len(word) <= 64:
                    memo[word] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_loaded: dict[tuple[str, str], ByteBPE] = {}


def load(name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> ByteBPE:
    """One encoder per worker process, from the directory or else from the file that was shipped to the worker."""
    if (name, directory) not in _loaded:
        here = directory if Path(directory, f"{name}.json").exists() else SparkFiles.getRootDirectory()
        _loaded[name, directory] = ByteBPE(name, here)
    return _loaded[name, directory]


def shipped(df: DataFrame, name: str, directory: str) -> None:
    """Sends the vocabulary file to the executors, which need not have the directory."""
    df.sparkSession.sparkContext.addFile(str(Path(directory, f"{name}.json").resolve()))


def encode_table(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR
) -> DataFrame:
    """``(id, ids ARRAY<INT>)`` of each row; one narrow Arrow stage, no shuffle."""

    shipped(docs, name, directory)

    def run(batches):
        bpe = load(name, directory)
        for batch in batches:
            counts, flat = [0], []
            for text in batch.column(1).to_pylist():
                flat += bpe.encode(text)
                counts.append(len(flat))
            values = pa.array(np.array(flat, dtype=np.int32))
            ids = pa.ListArray.from_arrays(pa.array(np.array(counts, dtype=np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode_table(encoded: DataFrame, id_col: str = "doc_id", name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """``(id, text)``: the vocabulary strings of the ids, joined."""

    shipped(encoded, name, directory)

    def run(batches):
        bpe = load(name, directory)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(encoded[id_col].alias("id"), "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
