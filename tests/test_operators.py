import random

import pytest
from pyspark.sql import functions as F

from skein.operators import mixing as M
from skein.operators import normalise as N
from skein.operators import tokens as T
from skein.operators import running as R
from skein.operators.running import running


@pytest.fixture(params=["one window", "ranges"])
def size(request, monkeypatch):
    """Both ways of a running fold: a single window, and ranges written to the shared folder."""
    if request.param == "ranges":
        monkeypatch.setattr(R, "SMALL", 1)
        monkeypatch.setattr(R, "MOST_RANGES", 7)
    return request.param


def test_running_matches_a_loop(spark, size):
    rng = random.Random(1)
    rows = [(i, rng.choice("aab"), rng.randint(0, 9)) for i in rng.sample(range(10_000), 400)] + [(None, "a", 1)]
    df = spark.createDataFrame(rows, "k int, g string, v int")
    for group in ([], ["g"]):
        got = {(r.k, r.g): r.before for r in running(df, ["k", "v"], F.col("v"), group).collect()}
        seen = {}
        for k, g, v in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0])):
            key = g if group else None
            assert got[k, g] == seen.get(key, 0)
            seen[key] = seen.get(key, 0) + v
    assert running(df.where("k < 0"), ["k"]).count() == 0


def test_water_fill():
    weights = {f"t{i}": w for i, w in enumerate([0.2, 0.15, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05])}
    got = M.water_fill(weights, dict.fromkeys(weights, 1e9), 200_000)
    assert all(abs(got[t] / 200_000 - w) < 0.005 for t, w in weights.items())
    assert M.water_fill({"a": 0.5, "b": 0.5}, {"a": 10, "b": 1e9}, 100) == {"a": 10, "b": 90}
    assert M.water_fill({"a": 1.0}, {"a": 5}, 0) == {"a": 0} and M.water_fill({}, {}, 5) == {}


def test_resample(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 100 + i) for i in range(50)], "task string, id int")
    out = M.resample(rows, "task", "id", {"a": 13, "b": 7}, 1)
    counts = {r.task: (r.n, r.most) for r in out.groupBy("task", "id").count().groupBy("task").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect()}
    assert counts == {"a": (13, 3), "b": (7, 1)}


def test_cap_ratio_matches_a_loop(spark, size):
    """A capped row goes while those kept are more than a quarter of all that is kept so far."""
    rng = random.Random(3)
    rows = [(i, rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, un boolean")
    order = [r.id for r in df.select("id", F.md5(F.concat(F.lit("9:"), F.col("id").cast("string"))).alias("h")).orderBy("h").collect()]
    un, kept, u = dict(rows), [], 0
    for i in order:
        if un[i]:
            if u > 0.25 * max(1, len(kept)):
                continue
            u += 1
        kept.append(i)
    assert {r.id for r in M.cap_ratio(df, F.col("un"), "id", 9, 0.25).collect()} == set(kept)


def test_one_group_of_a_third_of_all_rows(spark, size):
    """A hot group is spread over ranges; trim and donate give it what a window would."""
    rows = [(i, "hot" if i % 3 == 0 else f"s{i}", "t") for i in range(900)]
    df = spark.createDataFrame(rows, "id int, source string, task string")
    out = running(df, ["id"], None, ["source"], "n").where("source = 'hot'").orderBy("id").collect()
    assert [r.n for r in out] == list(range(300))
    assert M.sample_rows(df, "source", "id", 1, most=5).where("source = 'hot'").count() == 5
    assert M.trim(df, "id", 1, 1200).where("kept and source = 'hot'").count() == 1


def test_plans_read_their_table_once(spark, tmp_path):
    folder = str(tmp_path / "plan")
    df = spark.range(1000).selectExpr("id", "id % 3 = 0 as un", "'t' as task", "'s' as source")
    df.write.mode("overwrite").parquet(folder)
    table = spark.read.parquet(folder)
    plan = M.cap_ratio(table, F.col("un"), "id", 9, 0.25)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") <= 2
    shards = T.windows(spark.createDataFrame([(0, 5000), (1, 90)], "shard bigint, n_tokens bigint"), 15)
    assert "NestedLoop" not in T.locate(spark.range(10).withColumnRenamed("id", "window_id"), shards)._jdf.queryExecution().executedPlan().toString()


def test_cap_heads(spark):
    rows = [(i, "shell", "find") for i in range(90)] + [(100 + i, "shell", "ls") for i in range(10)] + [(200 + i, "sql", "find") for i in range(5)] + [(300, "shell", "")]
    out = M.cap_heads(spark.createDataFrame(rows, "id int, task string, head string"), "task", "head", "id", {"shell": 0.15}, 1)
    assert {(r.task, r.head): r["count"] for r in out.groupBy("task", "head").count().collect()} == {("shell", "find"): 15, ("shell", "ls"): 10, ("shell", ""): 1, ("sql", "find"): 5}


def test_interleave_matches_a_loop(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice("abc"), rng.randint(1, 50)) for i in range(120)]
    out = M.interleave(spark.createDataFrame(docs, "id int, source string, n int"), "source", "id", F.col("n")).orderBy("served", "source").collect()
    streams = {s: [d for d in docs if d[1] == s] for s in "abc"}
    total = {s: sum(d[2] for d in v) for s, v in streams.items()}
    served, want = dict.fromkeys(streams, 0), []
    while any(streams.values()):
        s = min((x for x in streams if streams[x]), key=lambda x: (served[x] / total[x], x))
        d = streams[s].pop(0)
        want.append(d[0])
        served[s] += d[2]
    assert [r.id for r in out] == want


def test_windows_and_shards(spark):
    shards = spark.createDataFrame([(0, 1000), (1, 1000), (2, 500), (3, 10)], "shard bigint, n_tokens bigint")
    w = T.windows(shards, 15)
    assert [(r.n_windows, r.first_window) for r in w.orderBy("shard").collect()] == [(984, 0), (984, 984), (484, 1968), (0, 2452)]
    with pytest.raises(ValueError):
        T.windows(shards, 5000)
    ids = spark.createDataFrame([(0,), (984,), (2451,)], "window_id bigint")
    assert [(r.shard, r.start) for r in T.locate(ids, w).orderBy("window_id").collect()] == [(0, 0), (1, 0), (2, 483)]
    assert [r.split for r in T.split_shards(shards, 9).orderBy("shard").collect()] == ["train", "val", "val", "val"]
    assert T.split_shards(shards.limit(1), 1).first().split == "both"
    assert (T.draw_windows(3, 100, 8, 1) == T.draw_windows(3, 100, 8, 1)).all() and (T.draw_windows(3, 100, 8, 1) != T.draw_windows(4, 100, 8, 1)).any()


def test_render(spark):
    turns = [("user", "hi"), ("assistant", "yo"), ("user", "a" * 50), ("assistant", "ok")]
    df = spark.createDataFrame([(1, [{"role": r, "content": c} for r, c in turns])], "id int, turns array<struct<role:string,content:string>>")
    r = df.select(T.render(F.col("turns")).alias("r")).first()["r"]
    ids, mask = T.render_turns([(x, list(c.encode())) for x, c in turns], 10_000)
    assert list(r["ids"]) == ids and list(r["mask"]) == mask and sum(mask) == 2 + 1 + 2 + 1
    short, _ = T.render_turns([(x, list(c.encode())) for x, c in turns], 58)
    assert short[:2] == [T.BOS, T.USER] and len(short) <= 58 and short.count(T.EOS) == 1
    assert T.render_turns([("user", [1] * 500), ("assistant", [2] * 5)], 40) is None
    cut, m = T.render_turns([("user", list(range(200))), ("assistant", [2] * 5)], 100)
    assert len(cut) == 100 and sum(m) == 6
    assert T.rendered(df, "id", "turns", 58).count() == 1


def test_pairs_and_weights(spark):
    p, c, r = T.render_pair([("user", [1, 2])], [3], [4, 5], 64)
    assert p == [T.BOS, T.USER, 1, 2, T.ASSISTANT] and c == [3, T.EOS] and r == [4, 5, T.EOS]
    assert T.render_pair([("user", [1])], [3] * 60, [4], 64) is None
    df = spark.createDataFrame([([1, 2, 3, 4], [0, 0, 1, 1])], "ids array<int>, mask array<int>")
    b = df.select(T.shifted(F.col("ids"), F.col("mask")).alias("b")).first()["b"]
    assert list(b["xs"]) == [1, 2, 3] and list(b["ys"]) == [-100, 3, 4]
    rows = [([T.BOS] + [5] * 200 + [T.EOS], [0] + [1] * 201), ([5, T.EOS], [1, 1]), ([5, 6], [1, 1])]
    df = spark.createDataFrame(rows, "ids array<int>, mask array<int>")
    ends = [x.w[-1] for x in df.select(T.loss_weights(F.col("ids"), F.col("mask"), 0.02).alias("w")).collect()]
    assert ends[0] == pytest.approx(0.02 * 200 / 0.98) and ends[1:] == [1.0, 1.0]
    ones = df.select(T.loss_weights(F.col("ids"), F.col("mask"), 0.02, 4.0, True).alias("w")).collect()
    assert all(sum(x.w) == pytest.approx(1) for x in ones)
    d = spark.createDataFrame([([1, 2, 9, 3, 4],)], "ids array<int>").select(T.document_ids(F.col("ids"), 9).alias("d")).first()["d"]
    assert list(d) == [0, 0, 0, 1, 1]


def test_schedules(spark):
    s = spark.range(1001).withColumnRenamed("id", "step")
    lr = [r.x for r in s.select(T.learning_rate(F.col("step"), 1e-3, 1000, 100).alias("x")).collect()]
    assert lr[0] == pytest.approx(1e-5) and lr[99] == pytest.approx(1e-3) and lr[1000] == pytest.approx(1e-4)
    assert T.layer_schedule(4, 1, 3, 2) == [0, 1, 2, 1, 2, 3] and T.gated_width(512) == 1536 and T.padded_vocab(50257) == 50304


def test_normalisers(spark):
    def run(source, rows, schema):
        return [(r.task, [m.content for m in r.messages]) for r in N.conversations(source, spark.createDataFrame(rows, schema)).orderBy("id").collect()]

    got = run("squad-v2", [(1, "Q?", "ctx", (["a"],)), (2, "Q?", "ctx", ([],)), (3, "", "c", None), (4, None, None, None)], "id int, question string, context string, answers struct<text:array<string>>")
    assert len(got) == 2 and got[0][1][1] == "a" and got[0][1][0].endswith("Passage:\nctx\n\nQuestion: Q?")
    got = run("gsm8k", [(1, "Q", "He has <<1+1=2>>2 apples in all #### 2"), (2, "Q", "no mark")], "id int, question string, answer string")
    assert len(got) == 1 and "<<" not in got[0][1][1] and "####" not in got[0][1][1]
    got = run("metamath", [(1, "GSM_X", "q", "Tom has 5 and gets 3 more so 5 + 3 = 8. #### 8 The answer is: 8"), (2, "MATH_X", "q", "z" * 30)], "id int, type string, query string, response string")
    assert len(got) == 1
    got = run("ecqa", [(1, "Q", "mess", "bloody mess", None, None, None, "bloody mess", "because it is so very clear"), (2, "Q", "a", "b", None, None, None, "c", "x")], "id int, q_text string, q_op1 string, q_op2 string, q_op3 string, q_op4 string, q_op5 string, q_ans string, taskA_pos string")
    assert len(got) == 1 and got[0][1][1].endswith("B) bloody mess")
    got = run("coedit", [(1, "gec", "Fix grammar: he go", "he goes"), (2, "gec", "x" * 90 + ": y", "z")], "id int, task string, src string, tgt string")
    assert got[0][1][0].endswith("\n\nhe go") and got[1][1][0].endswith(": y")
    got = run("nl2sh", [(1, "x", "ls -a"), (2, "y", "rm -rf /"), (3, "z", "a\nb"), (4, None, "ls")], "id int, nl string, bash string")
    assert [g[1][1] for g in got] == ["ls -a"]
    got = run("dolly", [(1, "i", "", "r", "open_qa"), (2, "i", "c", "r", "summarization")], "id int, instruction string, context string, response string, category string")
    assert got == [("summarization", ["i\n\nc", "r"])]
    turns = "id int, messages array<struct<role:string,content:string>>, category string"
    got = run("no-robots", [(1, [("system", "be nice"), ("user", "hi"), ("assistant", "yo")], "Rewrite"), (2, [("assistant", "x")], None), (3, None, None)], turns)
    assert got == [("rewrite", ["be nice\n\nhi", "yo"])]
    assert run("soda", [(1, ["a", "b", "c"]), (2, ["a"])], "id int, dialogue array<string>") == [("chat", ["a", "b"])]
    with pytest.raises(KeyError):
        N.conversations("nowhere", spark.range(1))


def test_preferences(spark):
    rows = [(1, "\n\nHuman: hi\n\nAssistant: yo", "\n\nHuman: hi\n\nAssistant: no"), (2, "\n\nHuman: hi\n\nAssistant: yo", "\n\nHuman: ho\n\nAssistant: no"), (3, None, "")]
    got = N.preferences("hh_transcript", spark.createDataFrame(rows, "id int, chosen string, rejected string"), "hh", "helpful").collect()
    assert [(r.id, r.chosen, r.rejected, r.prompt[0].content) for r in got] == [(1, "yo", "no", "hi")]
    got = N.preferences("system_input_pair", spark.createDataFrame([(1, "s", "q", "a", "b", [2.0, 1.0]), (2, "s", "q", "a", "b", [1.0, 1.0])], "id int, system string, input string, chosen string, rejected string, rating array<double>"), "o", "i").collect()
    assert [(r.id, r.prompt[0].content) for r in got] == [(1, "s\n\nq")]
    got = N.preferences("shp", spark.createDataFrame([(1, "h", "a", "b", 0), (2, "h", "a", "b", None)], "id int, history string, human_ref_A string, human_ref_B string, labels int"), "o", "i").collect()
    assert [(r.chosen, r.rejected) for r in got] == [("b", "a")]


def test_shapes_and_steps():
    small = T.Shape(width=64, layers=2, heads=4, key_heads=2, vocabulary=100, window=16)
    layer = 2 * 64 * 64 + 2 * 64 * 2 * 16 + 3 * 64 * 256 + 2 * 64 + 2 * 16
    assert small.weights() == 6400 + 2 * layer + 64 and T.Shape(64, 2, 4, 2, 100, 16, tied=False).weights() == small.weights() + 6400
    looped = T.Shape(64, 2, 4, 2, 100, 16, executed_layers=3)
    assert looped.flops_per_token() == 6 * (3 * layer + 6400) + 12 * 3 * 64 * 16 and looped.utilisation(1.0, 0.0) == looped.flops_per_token()
    assert T.steps_of(1000, 2, 8, 4) == 62 and T.steps_of(1, 1, 8, 4) == 1 and T.steps_of(1000, 2, 8, 4, given=7) == 7 and T.steps_of(1000, 2, 8, 4, world=2) == 31
    with pytest.raises(ValueError):
        T.layer_schedule(4, 2, 2, 3)


def test_caches(spark):
    squad = spark.createDataFrame([(i, f"What {i}?", "A passage.", {"text": [] if i % 2 else ["one"]}) for i in range(60)], "id int, question string, context string, answers struct<text:array<string>>")
    cache = N.conversation_cache({"squad-v2": squad})
    unanswered = cache.where(F.col("messages")[1]["content"] != "one").count()
    assert cache.count() == 30 + unanswered and unanswered <= (30 + unanswered) // 4 + 1
    pair = [(1, "Why is that?", "Because of the rain.", "No reason at all, sir.", None), (2, "", "Because.", "No.", None), (3, "Why?", "short", "No reason at all, sir.", None), (4, "Why?", "the same reply here", "the same reply here", None), (5, "Why?", "the same reply here", "no such reply here", "tie")]
    rows = spark.createDataFrame(pair, "id int, question string, chosen string, rejected string, status string")
    kept, counts = N.preference_cache({"orca-dpo": ("system_input_pair", "instruct", rows)})
    assert [r.id for r in kept.collect()] == [1] and {r.reason: r.n for r in counts.collect()} == {"kept": 1, "malformed": 2, "length": 1, "similar": 1}
    with pytest.raises(ValueError):
        N.conversation_cache({})
