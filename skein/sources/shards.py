"""Token shards: fixed-size binary files with a header, their index, and mixing of shard sets.

A shard is a header of 1024 bytes (magic, version, bytes of a token, token count)
and the tokens, little endian.  The count is written when a shard is closed, so an
interrupted one counts no tokens and is rejected by readers.
"""

from __future__ import annotations

import json
import os
import struct
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.tokens import storage_bytes

# Fixed values of the file format.
MAGIC, VERSION, HEADER = 0x534B4E31, 1, 1024
INDEX = "index.json"


def _header(width: int, n: int) -> bytes:
    return struct.pack("<IIIQ", MAGIC, VERSION, width, n).ljust(HEADER, b"\0")


def read_shard(path: str, known: int = MAGIC) -> np.ndarray:
    """The tokens of a shard; a damaged, foreign or empty one is an error.  Shards of another writer are read by its ``known`` magic number."""
    size = os.path.getsize(path)
    if size < HEADER:
        raise ValueError(f"{path}: too short for a header")
    with open(path, "rb") as f:
        magic, version, width, n = struct.unpack("<IIIQ", f.read(20))
    if magic != known or version != VERSION or width not in (2, 4):
        raise ValueError(f"{path}: not a token shard")
    if n == 0 or size < HEADER + n * width:
        raise ValueError(f"{path}: incomplete")
    return np.memmap(path, np.uint16 if width == 2 else np.uint32, "r", HEADER, (n,))


@dataclass
class ShardIndex:
    folder: str
    shards: list[str] = field(default_factory=list)
    total_tokens: int = 0
    vocab_size: int = 0
    meta: dict = field(default_factory=dict)

    def save(self) -> None:
        """Replaces the index in one step."""
        path = os.path.join(self.folder, INDEX)
        with open(path + ".tmp", "w", encoding="utf-8") as f:
            json.dump(asdict(self) | {"folder": "."}, f, indent=1)
        os.replace(path + ".tmp", path)

    @classmethod
    def load(cls, folder: str) -> ShardIndex:
        path = os.path.join(folder, INDEX)
        if not os.path.exists(path):
            raise FileNotFoundError(f"no shard index in {folder}; write shards there first")
        with open(path, encoding="utf-8") as f:
            return cls(**(json.load(f) | {"folder": folder}))

    def paths(self) -> list[str]:
        return [os.path.join(self.folder, s) for s in self.shards]


def write_shards(encoded: DataFrame, order: list[str], ids: str, folder: str, vocab_size: int, shard: int, prefix: str = "shard") -> ShardIndex:
    """Writes the ids of all rows, in order, to shards of exactly ``shard`` tokens but for the last.

    Offsets come from a running sum; each piece goes to its shard's task, which holds
    one shard.  A token outside the vocabulary fails the job.
    """
    from skein.operators.running import running

    os.makedirs(folder, exist_ok=True)
    width = storage_bytes(vocab_size)
    placed = running(encoded.withColumn("_n", F.size(ids)), order, F.col("_n"), out="_at").where("_n > 0")
    whole = placed.withColumn("_shard", F.explode(F.sequence(F.floor(F.col("_at") / shard), F.floor((F.col("_at") + F.col("_n") - 1) / shard))))
    first = F.greatest(F.col("_shard") * shard - F.col("_at"), F.lit(0))
    last = F.least((F.col("_shard") + 1) * shard - F.col("_at"), F.col("_n").cast("bigint"))
    parts = whole.select("_shard", (F.col("_at") + first).alias("_place"), F.slice(ids, (first + 1).cast("int"), (last - first).cast("int")).alias("_ids"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_place")
        tokens = np.concatenate([np.asarray(x, np.int64) for x in pdf["_ids"]])
        if len(tokens) and (tokens.min() < 0 or tokens.max() >= vocab_size):
            raise ValueError(f"a token lies outside the vocabulary of {vocab_size}")
        name = f"{prefix}-{int(pdf['_shard'].iloc[0]):06d}.bin"
        path = os.path.join(folder, name)
        with open(path + ".tmp", "wb") as f:
            f.write(_header(width, 0))
            f.write(tokens.astype("<u2" if width == 2 else "<u4").tobytes())
            f.seek(0)
            f.write(_header(width, len(tokens)))
        os.replace(path + ".tmp", path)
        return pd.DataFrame({"name": [name], "n": [len(tokens)]})

    rows = parts.groupBy("_shard").applyInPandas(run, "name string, n bigint").orderBy("name").collect()  # one row a shard
    index = ShardIndex(folder, [r["name"] for r in rows], sum(r["n"] for r in rows), vocab_size, {"shard_tokens": shard})
    index.save()
    return index


def shard_table(spark: SparkSession, index: ShardIndex) -> DataFrame:
    """``(shard, n_tokens)`` of the shards of an index, from their headers."""
    rows = [(k, len(read_shard(p))) for k, p in enumerate(index.paths())]
    return spark.createDataFrame(rows, "shard bigint, n_tokens bigint")


def gather(index: ShardIndex, located: DataFrame, seq: int) -> DataFrame:
    """``(window_id, tokens)``: the ``seq + 1`` tokens of located windows."""
    paths = index.paths()

    def run(frames):
        for pdf in frames:
            rows = [(w, read_shard(paths[s])[a : a + seq + 1].astype(np.int32).tolist()) for w, s, a in zip(pdf["window_id"], pdf["shard"], pdf["start"])]
            yield pd.DataFrame(rows, columns=["window_id", "tokens"])

    return located.select("window_id", "shard", "start").mapInPandas(run, "window_id bigint, tokens array<int>")


def mix_shards(target: ShardIndex, source: ShardIndex, n: int) -> ShardIndex:
    """Links the first shards of a source set into a target set; done again, nothing changes.

    Sets of different vocabulary are refused; the token count is an estimate by the
    source's mean shard.
    """
    if target.vocab_size != source.vocab_size:
        raise ValueError(f"vocabularies differ: {target.vocab_size} and {source.vocab_size}")
    mean = source.total_tokens // max(1, len(source.shards))
    for path in source.paths()[:n]:
        name = f"mixed-{os.path.basename(os.path.abspath(source.folder))}-{os.path.basename(path)}"
        if name in target.shards:
            continue
        link = os.path.join(target.folder, name)
        if not os.path.exists(link):
            os.link(path, link)
        target.shards.append(name)
        target.total_tokens += mean
        target.meta.setdefault("mixed_in", []).append(name)
    target.save()
    return target
