"""Sinks: text corpora, caches, merge tables, manifests and reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.files import children, rename

ROWS_PER_FILE = 20_000


def write_corpus(df: DataFrame, folder: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """A folder for each source, named as it is, in one pass; at most so many rows a file.  Rows without a source are left out."""
    spark = df.sparkSession
    df.where("source is not null").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("source").parquet(folder)
    for name, is_folder in children(spark, folder):
        if is_folder and name.startswith("source="):
            rename(spark, f"{folder}/{name}", f"{folder}/{name[7:]}")


def write_cache(train: DataFrame, val: DataFrame, folder: str, turns: tuple[str, ...] = ("messages",), force: bool = False) -> bool:
    """Both splits with their turns as JSON; left alone where both exist, unless forced.  Whether it wrote."""
    paths = [os.path.join(folder, f"{s}.parquet") for s in ("train", "val")]
    if not force and all(os.path.exists(p) for p in paths):
        return False
    for df, path in zip((train, val), paths):
        stored = df
        for c in turns:
            stored = stored.withColumn(c, F.to_json(c))
        stored.write.mode("overwrite").parquet(path)
    return True


def write_merges(merges: list[tuple[int, int]], vocab_size: int, path: str) -> None:
    """The vocabulary size, then a pair of ids a line in rank order."""
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        f.write(f"{vocab_size}\n" + "".join(f"{a} {b}\n" for a, b in merges))
    os.replace(path + ".tmp", path)


def read_merges(path: str) -> tuple[int, list[tuple[int, int]]]:
    with open(path, encoding="utf-8") as f:
        size = int(f.readline())
        return size, [tuple(map(int, line.split())) for line in f if line.strip()]


def write_manifest(entries: dict[str, dict], path: str) -> None:
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump(entries, f, indent=1)
    os.replace(path + ".tmp", path)


def write_report(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)
