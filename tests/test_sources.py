import gzip
import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.sources import corpus as S
from skein.sources import shards as H
from skein.sources import sinks as K


def test_parquet_documents(spark, tmp_path):
    spark.createDataFrame([("english", "en"), ("deutsch", "de"), (None, "en")], "text string, language string").coalesce(1).write.parquet(str(tmp_path / "t1"))
    spark.createDataFrame([("code", "xx")], "content string, language string").coalesce(1).write.parquet(str(tmp_path / "t2"))
    for name, folder in (("t1", "web"), ("t2", "python-edu")):
        (tmp_path / "root" / folder).mkdir(parents=True)
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "root" / folder / "a.parquet")
    rows = {(r.source, r.text) for r in S.parquet_documents(spark, str(tmp_path / "root")).collect()}
    assert rows == {("web", "english"), ("python-edu", "code")}
    assert S.parquet_documents(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "root" / "bad").mkdir()
    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "t3"))
    next((tmp_path / "t3").glob("*.parquet")).rename(tmp_path / "root" / "bad" / "a.parquet")
    with pytest.raises(ValueError):
        S.parquet_documents(spark, str(tmp_path / "root"))


def test_text_scans(spark, tmp_path):
    (tmp_path / "w.txt.gz").write_bytes(gzip.compress(b"One sentence here. Another one follows.\nThird line."))
    out = [r.chunk for r in S.encyclopedia_chunks(spark, str(tmp_path / "w.txt.gz"), 20, 100).collect()]
    assert out[0] == "One sentence here Another one follows" and S.encyclopedia_chunks(spark, str(tmp_path / "no.gz")).count() == 0
    (tmp_path / "books" / "deep").mkdir(parents=True)
    (tmp_path / "books" / "deep" / "a.txt").write_text("one\ftwo")
    (tmp_path / "books" / "skip.txt").write_text("x")
    pages = S.book_pages(spark, str(tmp_path / "books"), "openstax", "a\\.txt", "skip").orderBy("page_no").collect()
    assert [(r.page_no, r.text) for r in pages] == [(0, "one"), (1, "two")]
    html = spark.createDataFrame([("<p>a</p>b",)], "html string")
    assert S.html_documents(html, "x").first().text == " a b"


def test_plain_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": null}\n{"a": 2}\n')
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines"\n')
    assert S.read_plain(spark, str(tmp_path / "a.jsonl")).columns == ["a"]
    assert S.read_plain(spark, str(tmp_path / "a.tsv")).first().y == "2"
    assert S.read_plain(spark, str(tmp_path / "a.csv")).first().y == "two\nlines"
    assert S.read_plain(spark, str(tmp_path / "a.xyz")) is None
    (tmp_path / "mc.jsonl").write_text('{"query": "q", "endings": ["a", "b"], "gold": 1}\n')
    r = S.choice_items(spark, str(tmp_path / "mc.jsonl")).first()
    assert (r.context, list(r.choices), r.answer, r.task) == ("q", ["a", "b"], 1, "mc")


def test_manifest(spark, tmp_path):
    for name in ("train-0.parquet", "validation-0.parquet"):
        spark.range(3).toPandas().to_parquet(tmp_path / name)
    K.write_manifest({"s": {"folder": str(tmp_path), "files": ["train-0.parquet", "validation-0.parquet", "gone.parquet"]}}, str(tmp_path / "m.json"))
    train, val = S.manifest_tables(spark, str(tmp_path / "m.json"), "s")
    assert train.count() == 3 and val.count() == 3
    assert S.manifest_tables(spark, str(tmp_path / "m.json"), "other") == (None, None)
    with pytest.raises(FileNotFoundError):
        S.manifest_tables(spark, str(tmp_path / "no.json"), "s")


def test_shards(spark, tmp_path):
    tokens = (np.arange(2500) % 512).tolist()
    docs = spark.createDataFrame([(i, tokens[i * 100 : (i + 1) * 100]) for i in range(25)], "id int, ids array<int>")
    index = H.write_shards(docs, ["id"], "ids", str(tmp_path / "s"), 512, 1000)
    assert index.total_tokens == 2500 and len(index.shards) == 3
    assert np.concatenate([H.read_shard(p) for p in index.paths()]).tolist() == tokens
    assert H.read_shard(index.paths()[0]).dtype == np.uint16
    assert H.ShardIndex.load(str(tmp_path / "s")).shards == index.shards
    located = spark.createDataFrame([(7, 1, 5)], "window_id bigint, shard bigint, start bigint")
    assert list(H.gather(index, located, 15).first().tokens) == tokens[1005:1021]
    other = H.write_shards(docs, ["id"], "ids", str(tmp_path / "o"), 512, 500)
    mixed = H.mix_shards(index, other, 2)
    again = H.mix_shards(mixed, other, 2)
    assert len(again.shards) == 5 and again.total_tokens == 3500
    with pytest.raises(Exception):
        H.write_shards(docs, ["id"], "ids", str(tmp_path / "b"), 10, 1000)
    (tmp_path / "bad.bin").write_bytes(b"x")
    with pytest.raises(ValueError):
        H.read_shard(str(tmp_path / "bad.bin"))
    with pytest.raises(FileNotFoundError):
        H.ShardIndex.load(str(tmp_path / "nowhere"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "source string, text string")
    K.write_corpus(df, str(tmp_path / "c"), 1)
    assert {p.name for p in (tmp_path / "c").iterdir() if p.is_dir()} == {r.source for r in df.collect()}  # a folder a source
    assert S.parquet_documents(spark, str(tmp_path / "c")).count() == 2
    chat = spark.createDataFrame([(1, [("user", "hi")])], "id int, messages array<struct<role:string,content:string>>")
    assert K.write_cache(chat, chat, str(tmp_path / "k")) and not K.write_cache(chat, chat, str(tmp_path / "k")) and K.write_cache(chat, chat, str(tmp_path / "k"), force=True)
    assert json.loads(spark.read.parquet(str(tmp_path / "k" / "train.parquet")).first().messages) == [{"role": "user", "content": "hi"}]
    K.write_merges([(104, 105), (262, 33)], 264, str(tmp_path / "m.txt"))
    assert K.read_merges(str(tmp_path / "m.txt")) == (264, [(104, 105), (262, 33)])
    K.write_report(df.groupBy("source").agg(F.count("*").alias("n")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_streaming(spark, tmp_path):
    from skein.streaming import jobs

    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 05:00:00", "b", 3.0)]
    df = spark.createDataFrame(rows, "id int, ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.windowed(jobs.read_files(spark, str(tmp_path / "in"), df.schema), "ts", ["kind"], "value")
    got = {(r.kind, r.n, r.total) for r in jobs.run_to_table(stream).collect()}
    assert ("a", 2, 3.0) in got
    seen = []
    q = jobs.micro_batches(jobs.read_files(spark, str(tmp_path / "in"), df.schema), lambda d, k: seen.append(d.count()), str(tmp_path / "state"))
    q.awaitTermination()
    assert sum(seen) == 3


def test_core_stands_alone():
    code = "import sys; sys.modules['skein.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k[0] == 'p' and k[1].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_catalogues():
    from skein.sources import catalogs as C

    assert abs(sum(s.weight for s in C.CORPORA) - 1) < 1e-9 and len(C.CHATS) == 20 and len(C.PAIRS) == 5
    assert "soda" not in [s.key for s in C.select(C.CHATS)] and len(C.select(C.CHATS, everything=True)) == 20
    assert [s.key for s in C.select(C.PAIRS, only=["shp"])] == ["shp"] and [s.key for s in C.select(C.PAIRS, tasks=["helpful"])] == ["ultrafeedback"]
    with pytest.raises(KeyError):
        C.select(C.PAIRS, only=["nothing"])


def test_encyclopedia(spark, tmp_path):
    import gzip
    import zipfile

    lines = ["A first sentence. A second one.", "", "And a third, which is longer than the others. End"]
    with gzip.open(tmp_path / "w.txt.gz", "wt", encoding="utf-8") as f:
        f.write("\n".join(lines))
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("wikipedia.txt", "\n".join(lines))
    (tmp_path / "w.txt").write_text("\n".join(lines))
    want = ["A first sentence A second one", "And a third, which is longer than the others", "End"]
    for name in ("w.txt.gz", "w.zip", "w.txt"):
        out = [r.chunk for r in S.encyclopedia_chunks(spark, str(tmp_path / name), 30, 60).collect()]
        assert out == want, out
    assert S.encyclopedia_chunks(spark, str(tmp_path / "none.zip")).count() == 0
