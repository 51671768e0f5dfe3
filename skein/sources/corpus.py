"""Scans of raw corpora and chat tables.

Every scan is lazy; sources come from the folder above a file.  A missing root or a
manifest entry without files gives an empty table of the right schema; a file
without a text column is an error when the scan is built.
"""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.sources.files import children
from skein.functions.chunking import MAX_CHUNK, MIN_CHUNK, PACK_MOST, PACK_SIZE, corpus_chunks, packed_sentences

TEXT_COLUMNS = ("text", "content")
UNCHECKED = ("cosmopedia", "python-edu")  # sources whose language column is not looked at
DOCUMENT = "source string, text string"


def source_of(path: Column) -> Column:
    """The folder above a file."""
    return F.element_at(F.split(path, "/"), -2)


def list_parquet(spark: SparkSession, root: str) -> list[str]:
    """Parquet files or tables exactly one folder below the root, in order."""
    folders = [name for name, is_folder in children(spark, root) if is_folder]
    return [f"{root}/{folder}/{name}" for folder in folders for name, _ in children(spark, f"{root}/{folder}") if name.endswith(".parquet")]


def parquet_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(source, text)`` of all parquet files one folder below the root; English only where a language is given.

    Files of a folder share a schema; only the text and language columns are read.
    """
    out = None
    by: dict[str, list[str]] = {}
    for path in list_parquet(spark, root):
        by.setdefault(path.split("/")[-2], []).append(path)
    for folder, files in by.items():
        df = spark.read.parquet(*files)
        column = next((c for c in TEXT_COLUMNS if c in df.columns), None)
        if column is None:
            raise ValueError(f"{folder}: no text column among {df.columns}")
        if "language" in df.columns and not any(s in folder for s in UNCHECKED):
            df = df.where("language = 'en'")
        one = df.select(F.lit(folder).alias("source"), F.col(column).cast("string").alias("text")).where("text is not null")
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], DOCUMENT) if out is None else out


ENCYCLOPEDIA = "source string, chunk string"


def parquet_chunks(spark: SparkSession, root: str, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """``(source, chunk_no, chunk)`` of the documents of a root, other scripts removed."""
    docs = parquet_documents(spark, root).withColumn("text", X.strip_foreign(F.col("text")))
    return corpus_chunks(docs, "text", least, most)


def encyclopedia_chunks(spark: SparkSession, path: str, size: int = PACK_SIZE, most: int = PACK_MOST) -> DataFrame:
    """``(source, chunk)`` of a text file, gzipped or zipped or plain, sentences packed until the size is reached; absent, empty.

    The packing runs on in file order, so a file is one task, which reads it line by line;
    give a folder of files to spread them.
    """
    above, _, name = path.rpartition("/")
    if name not in dict(children(spark, above or ".")):
        return spark.createDataFrame([], ENCYCLOPEDIA)

    def spans(lines: Iterator[str]):
        held = []
        for span in packed_sentences(lines, size, most):
            held.append(span)
            if len(held) == 256:
                yield pd.DataFrame({"source": "wikipedia", "chunk": held})
                held = []
        yield pd.DataFrame({"source": "wikipedia", "chunk": pd.Series(held, dtype=object)})

    def unzipped(frames):
        for pdf in frames:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        with z.open(member) as f:
                            yield from spans(line.decode("utf-8", "ignore") for line in f)

    def read(frames):
        yield from spans(line.replace("\ufffd", "") for pdf in frames for line in pdf["value"])

    if path.endswith(".zip"):
        return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzipped, ENCYCLOPEDIA)
    files = spark.read.text(path).select("value")
    return (files if path.endswith(".gz") else files.coalesce(1)).mapInPandas(read, ENCYCLOPEDIA)


def book_pages(spark: SparkSession, root: str, source: str, include: str = "", exclude: str = "") -> DataFrame:
    """``(source, doc, page_no, text)`` of text books at any depth, cut at form feeds; paths must match, and not match."""
    if not children(spark, root):
        return spark.createDataFrame([], "source string, doc string, page_no int, text string")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    rows = files.select(path.alias("doc"), F.col("value"))
    if include:
        rows = rows.where(F.col("doc").rlike(include))
    if exclude:
        rows = rows.where(~F.col("doc").rlike(exclude))
    return rows.select(F.lit(source).alias("source"), "doc", F.posexplode(F.split("value", "\f")).alias("page_no", "text"))


def pdf_pages(spark: SparkSession, root: str, source: str) -> DataFrame:
    """``(source, doc, page_no, text)`` of PDF files; needs the optional reader ``pypdf``.

    An unreadable file has no pages, an unreadable page is left out.
    """

    def run(frames):
        from pypdf import PdfReader

        for pdf in frames:
            rows = []
            for doc, content in zip(pdf["path"], pdf["content"]):
                try:
                    pages = PdfReader(io.BytesIO(content)).pages
                except Exception:
                    continue
                for k, page in enumerate(pages):
                    try:
                        rows.append((source, doc, k, page.extract_text() or ""))
                    except Exception:
                        continue
            yield pd.DataFrame(rows, columns=["source", "doc", "page_no", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root)
    return files.select("path", "content").mapInPandas(run, "source string, doc string, page_no int, text string")


def html_documents(df: DataFrame, source: str) -> DataFrame:
    """``(source, text)`` of stored pages: the column html, else the first, its tags replaced by spaces."""
    column = "html" if "html" in df.columns else df.columns[0]
    return df.select(F.lit(source).alias("source"), X.strip_tags(F.col(column).cast("string")).alias("text")).where("text is not null")


def read_plain(spark: SparkSession, path: str) -> DataFrame | None:
    """A .jsonl, .json, .csv or .tsv file without its all-null columns; None for another suffix."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".jsonl":
        df = spark.read.json(path)
    elif suffix == ".json":
        df = spark.read.option("multiLine", True).json(path)
    elif suffix in (".csv", ".tsv"):
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", "\t" if suffix == ".tsv" else ",").csv(path)
    else:
        return None
    if not df.columns:
        return df
    filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if filled[c]])


def is_validation(path: str, test_too: bool = False) -> bool:
    """Whether a file name says validation (or, for pairs, test)."""
    name = os.path.basename(path).lower()
    return any(x in name for x in ("validation", "valid", "dev", *(("test",) if test_too else ())))


def manifest_tables(spark: SparkSession, manifest: str, key: str, test_too: bool = False) -> tuple[DataFrame | None, DataFrame | None]:
    """(train, val) of a source of a JSON manifest; missing files are skipped, a side without files is None."""
    if not os.path.exists(manifest):
        raise FileNotFoundError(f"no manifest at {manifest}; write one with write_manifest")
    with open(manifest, encoding="utf-8") as f:
        entry = json.load(f).get(key, {})
    files = [os.path.join(entry.get("folder", ""), p) for p in entry.get("files", [])]
    files = [p for p in files if os.path.exists(p)]
    sides = []
    for val in (False, True):
        own = [p for p in files if is_validation(p, test_too) == val]
        sides.append(spark.read.option("mergeSchema", True).parquet(*own) if own else None)
    return sides[0], sides[1]


def choice_items(spark: SparkSession, path: str, task: str = "", limit: int | None = None) -> DataFrame:
    """``(context, choices, answer, task)`` of a JSON-lines file under any of the usual names."""
    df = spark.read.json(path)
    has = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None))
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    out = df.select(
        has("context", "query", "prompt").cast("string").alias("context"),
        has("choices", "endings").alias("choices"),
        has("answer", "label", "gold").cast("int").alias("answer"),
        F.coalesce(has("task"), F.lit(task or None), name).alias("task"),
    )
    return out if limit is None else out.limit(limit)
