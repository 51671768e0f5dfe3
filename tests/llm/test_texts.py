"""Encoding, statistics, language and leakage."""

import os
import random

import numpy as np
import pytest

pytest.importorskip("skein.llm")

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import bpe, language, leakage, quality
from skein.llm.lexicon import LANGUAGES, label_language

DATA = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n", "a", "é" * 40, "😀‍👩‍👧 \x00\x1c\u0085", "x" * 60_000, "<|endoftext|>", "a  b\t\n\n c", "½ ² 12", "don't I'll 'tis"]


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_bpe_matches_the_library(public):
    own = bpe.load()
    for text in ODD:
        assert own.encode(text) == (public.encode(text, add_special_tokens=False).ids if text else [])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_bpe_round_trip(public, text):
    own = bpe.load()
    ids = own.encode(text)
    assert own.decode(ids) == text and ids == public.encode(text, add_special_tokens=False).ids


def test_bpe_table(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(0, None, "clash")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.encode_table(df).orderBy("doc_id").collect()
    assert len(out) == len(rows) and out[0].ids == [] and all(x is not None for r in out for x in r.ids)
    back = bpe.decode_table(bpe.encode_table(df.where("doc_id > 1"))).collect()
    assert {r.doc_id: r.text for r in back} == {i: t for i, t, _ in rows if i > 1}
    assert bpe.encode_table(df.where("doc_id < 0")).count() == 0


PROSE = "The miller of the old town said that the river had risen by the bridge, and that it was not the first time. Nobody in the village knew why."


@pytest.fixture(scope="module")
def profiles():
    return quality.Profiles()


def test_kinds(profiles):
    table = "\n".join(f"| a{i} | {i} | {i * 2} |" for i in range(12))
    spaced = "\n".join(f"name{i}        {i}.5        {i}77" for i in range(12))
    listing = "Things to buy\n" + "\n".join(f"- thing number {i}" for i in range(12))
    bare = "\n".join(f"{w} things of {w}" for w in "red blue green black white brown pink gold grey lime teal".split())
    code = "import os\n\ndef f(x):\n    y = x + 1\n    for i in range(y):\n        print(i)\n    return y\n\nclass A:\n    z = 3\n"
    verse = "The rose is red and the sky is blue,\nand all of it is here for you,\nand so it was when I was small,\nthe sun was warm upon the wall.\n"
    random_words = " ".join("".join(random.Random(i).choices("bcdfghjklmnpqrstvwxz", k=7)) for i in range(40))
    nav = " | ".join(["Home", "About", "Contact", "Login", "Help", "Search"] * 4)
    for text, kind in [(PROSE, "prose"), (PROSE + "\n- one\n- two\n" + PROSE, "prose"), (verse, "prose"), ("Q: Why is it so?\nA: " + PROSE, "prose"), (table, "table"), (spaced, "table"), (listing, "list"), (bare, "list"), (code, "code"), (random_words, "junk"), (nav, "junk"), ("The same sentence again. " * 20, "junk"), ("#@!$%^&*" * 20, "junk"), ("spores" * 50, "junk"), ("b3ug0O4MkpKMp6Ucsos2jb17PcbTJHZJk4OZ5zDLnRu9nkQC7CqU" * 3, "junk")]:
        assert profiles.kinds_of([text]) == [kind], (kind, text[:60], profiles.describe([text]))
    for text in ODD:
        if not text or len(text) < quality.MIN_CHARS:
            assert profiles.kinds_of([text]) == [None]


def test_statistics_table(spark, profiles):
    rows = [(i, t, "x") for i, t in enumerate([PROSE, None, "", PROSE])]
    out = quality.statistics(spark.createDataFrame(rows, "doc_id bigint, text string, kind string"), profiles).orderBy("doc_id").collect()
    assert out[0].n_words == 29 and out[0].prose_language == "en" and out[0].kind == "prose"
    assert out[1].n_words == 0 and out[1].kind is None and out[2].n_chars == 0 and out[3][1:] == out[0][1:]
    assert quality.divergence({"a": 1.0}, {"a": 1.0}) == 0 and quality.divergence({"a": 1.0}, {"b": 1.0}) == pytest.approx(1)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_profiles_are_learnt_and_decide(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    learnt = quality.fit(docs)
    assert abs(learnt.profiles - learnt.first).max() > 0.02 and learnt.words["en"] != quality.Profiles().words["en"]
    texts = [r.text for r in docs.where(F.length("text") >= quality.MIN_CHARS).collect()]
    x, _, _ = quality.vectors(texts)
    near = [quality.KINDS[k] for k in learnt.kinds[quality.divergences(x, learnt.profiles).argmin(axis=1)]]
    assert near == learnt.kinds_of(texts)
    # the line structure with most characters alone says otherwise of some texts
    names = ("starts", 0, 2), ("cells", 1, 7)
    listed = x[:, quality._AT["starts"] : quality._AT["starts"] + 2].sum(axis=1)
    celled = x[:, quality._AT["cells"] + 1 : quality._AT["cells"] + 7].sum(axis=1)
    coded = x[:, quality._AT["starts"] + 7]
    most = ["list" if a >= 0.5 else "table" if b >= 0.5 else "code" if c >= 0.5 else "prose" for a, b, c in zip(listed, celled, coded)]
    assert names and sum(a != b for a, b in zip(near, most)) > 20
    assert quality.fit(docs.where("doc_id < 0")).kinds_of([PROSE]) == ["prose"]
    assert quality.fit(spark.createDataFrame([(1, PROSE, None, 2)], "doc_id bigint, text string, lang string, kind int")).kinds_of([PROSE]) == ["prose"]


def test_profiles_are_drawn_to_all_texts(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit(PROSE).alias("text"), F.lit("en").alias("lang"))
    texts = quality.stored(docs)
    learnt = quality.learn(texts)
    x, counted, _ = quality.vectors([PROSE])
    near = quality.divergences(x, learnt.first).argmin()
    hold = quality.HOLD * 9000 / quality.OF
    assert learnt.profiles[near] == pytest.approx((9000 * x[0] + hold * learnt.first[near]) / (9000 + hold), abs=1e-6)
    first, own = quality.Profiles().words["en"], counted[0].known
    weights = {w: p * 200 + 9000 * own.get(w, 0) for w, p in first.items()}
    assert learnt.words["en"]["the"] == pytest.approx(weights["the"] / sum(weights.values()), rel=1e-9)  # every text counts
    assert quality.found(texts, learnt).count() == 0


def test_labels():
    assert [label_language(x) for x in ("en", "EN-us", "eng", "English", " German ", "pt_BR")] == ["en", "en", "en", "en", "de", "pt"]
    assert [label_language(x) for x in (None, "", "und", "unknown", "xx")] == [None] * 5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_language_on_held_out_rows(spark, profiles):
    import pandas as pd

    df = pd.read_parquet(f"{DATA}/documents.parquet")
    rows = [(t, label_language(x), i) for t, x, i in zip(df.text, df.lang, df.doc_id) if t and len(t) > 200 and label_language(x)]
    kinds = profiles.kinds_of([t for t, _, _ in rows])
    rows = [r for r, kind in zip(rows, kinds) if kind == "prose"]
    net = language.train([(t, x) for t, x, i in rows if i % 3])
    held = [(t, x) for t, x, i in rows if i % 3 == 0]
    right = 0
    for (text, label), found in zip(held, language.passages(net, [t for t, _ in held])):
        words = {}
        for lang, _, _, n, _ in found:
            words[lang] = words.get(lang, 0) + n
        right += max(words, key=words.get) == label
    assert right / len(held) > 0.85  # labels are wrong for some rows
    mixed = [t for t, x in held if x == "en"][0][:400] + "\n\n" + [t for t, x in held if x == "ru"][0][:400]
    assert {x[0] for x in language.passages(net, [mixed])[0]} >= {"en", "ru"}
    assert language.passages(net, [None, "", " ", "123 456"]) [:3] == [[], [], []]
    bare = " ".join("".join(c for c in t if c.isalpha() or c == " ") for t, x in held if x == "en")[:600] + " " + "".join(c for c in [t for t, x in held if x == "ru"][0][:300] if c.isalpha() or c == " ")
    assert {x[0] for x in language.passages(net, [bare])[0]} >= {"en", "ru"}  # no mark or line parts the passages
    turkish = "İstanbul " * 30 + [t for t, x in held if x == "en"][0][:400]
    assert language.passages(net, [turkish])[0][-1][2] == len(turkish.encode())  # bytes of the text as it is
    small = spark.createDataFrame([(1, mixed, "en", "x"), (2, None, None, "x"), (3, "", "de", "x"), (1, mixed, "en", "x")], "doc_id bigint, text string, lang string, label string")
    assert {(r.doc_id, r.lang) for r in language.found(small, net, profiles).collect()} == {(1, "ru")}
    assert {(r.doc_id, r.lang is None, r.confidence > 0) for r in language.documents(small, net).collect()} == {(1, False, True), (2, True, False), (3, True, False)}
    assert language.found(small.where("doc_id < 0"), net, profiles).count() == 0
    assert language.fit(small.where("doc_id < 0")).out.shape[1] == len(LANGUAGES)


def test_network_is_fitted_on_all_rows(spark):
    net = language.ByteCNN()
    english, dutch = "the river lifts the stone and the garden " * 3, "het water van de rivier is koud en het " * 3
    for _ in range(2):
        x = np.concatenate([language.windows_of(english), language.windows_of(dutch)])
        net.fit(x, np.array([LANGUAGES.index("en")] * len(language.windows_of(english)) + [LANGUAGES.index("nl")] * len(language.windows_of(dutch))), epochs=60)
    before = {k: getattr(net, k).copy() for k in language._PARTS}
    rows = spark.createDataFrame([("en", english), ("nl", dutch)] * 40, "code string, text string")
    x, y = language.windows_of(english), LANGUAGES.index("en")
    loss = lambda n: -n.log_probs(n.pooled(np.ascontiguousarray(x).reshape(-1)).reshape(len(x), language.WINDOW, -1).max(axis=1))[:, y].mean()
    old = loss(net)
    net = language.refine(net, rows, {"en": 40, "nl": 40})
    assert any((getattr(net, k) != before[k]).any() for k in language._PARTS) and loss(net) < old + 0.02
    long = "a" * language.TRAIN_BYTES + "b" * 480  # the whole of a row is read
    assert len(language.windows_of(long)) == len(long) // (language.BLOCK * language.WINDOW)
    none = {k: getattr(net, k).copy() for k in language._PARTS}
    net = language.refine(net, rows.where("code is null"), {"en": 40})
    assert all((getattr(net, k) == none[k]).all() for k in language._PARTS)


def plain_fit(net, windows, labels, batch, rate):
    """One pass of Adam with every span written out."""
    rng, names, step, span, size = np.random.default_rng(7), language._PARTS, 0, language._SPAN, language.EMBED
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    order = rng.permutation(len(windows))
    for at in range(0, len(order), batch):
        xb, yb = windows[order[at : at + batch]], labels[order[at : at + batch]]
        each, length = np.arange(len(yb)), xb.shape[1] - span + 1
        e = net.embed[xb]
        cols = np.concatenate([e[:, o : o + length] for o in range(span)], axis=2)
        y = cols @ net.conv + net.bias
        arg, top = y.argmax(axis=1), y.max(axis=1)
        p = np.exp(net.log_probs(np.maximum(top, 0)))
        target = np.full_like(p, 0.04 / p.shape[1])
        target[each, yb] += 0.96
        dz = (p - target) / len(yb)
        dh = (dz @ net.out.T) * (top > 0)
        grads = {"out": np.maximum(top, 0).T @ dz, "out_bias": dz.sum(0), "bias": dh.sum(0), "embed": np.zeros_like(net.embed)}
        grads["conv"] = np.einsum("bfk,bf->kf", cols[each[:, None], arg], dh) * net.mask
        for o in range(span):
            np.add.at(grads["embed"], xb[each[:, None], arg + o].ravel(), (dh[:, :, None] * net.conv.T[None])[:, :, o * size : (o + 1) * size].reshape(-1, size))
        step += 1
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
            getattr(net, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)


def test_network_is_fitted_as_plainly_in_less_time():
    import time

    rng, took = np.random.default_rng(3), {plain_fit: [], language.ByteCNN.fit: []}
    rows = np.concatenate([language.windows_of(PROSE * 300), rng.integers(0, 256, (100, 48), np.uint8)])
    labels = rng.integers(0, len(LANGUAGES), len(rows))
    for _ in range(3):
        nets = []
        for f, more in ((plain_fit, {}), (language.ByteCNN.fit, {"epochs": 1})):
            nets.append(language.ByteCNN())
            began = time.thread_time()
            f(nets[-1], rows, labels, batch=256, rate=4e-3, **more)
            took[f].append(time.thread_time() - began)
        assert all(np.allclose(getattr(nets[0], k), getattr(nets[1], k), atol=1e-4) for k in language._PARTS)
    assert min(took[language.ByteCNN.fit]) < 0.6 * min(took[plain_fit])  # both alike before
    net, data = nets[1], np.ascontiguousarray(rows[:150]).reshape(-1)
    e = net.embed[np.concatenate([data, np.full(3, 32, np.uint8)])]
    y = np.concatenate([e[o : o + len(data)] for o in range(4)], axis=1) @ net.conv + net.bias
    assert np.allclose(net.pooled(data), np.maximum(y, 0).reshape(-1, language.BLOCK, y.shape[1]).max(axis=1), atol=1e-4)


def test_units_end_where_their_signs_do():
    import re

    plain = re.compile(rb"(?<=[.!?])[\"')\]]*\s+|\n\s*|\xe2\x80[\x9c\x9d\x9e]|\xc2[\xab\xbb]|\"|(?<=[,;:])\s+(?=\xe2\x80)")
    rng, signs = random.Random(2), [b".", b"!", b'"', b"'", b")", b" ", b"\n", b"\t", b"\xe2\x80\x9c", b"\xe2\x80", b"\xe2", b"\xc2\xab", b"\xc2", b",", b":", b"a"]
    for _ in range(20_000):
        data = b"".join(rng.choices(signs, k=rng.randint(1, 12)))
        assert [m.end() for m in language._UNIT.finditer(data)] == [m.end() for m in plain.finditer(data)], data


def test_nearest_profiles_are_those_of_the_divergences(profiles):
    rng = np.random.default_rng(5)
    x = np.concatenate([profiles.profiles, (profiles.profiles[:-1] + profiles.profiles[1:]) / 2, rng.dirichlet(np.full(quality._SIZE, 0.2), 200)])  # the second lie between two
    assert (quality.nearest(x, profiles.profiles) == quality.divergences(x, profiles.profiles).argmin(axis=1)).all()
    assert len(quality.nearest(x[:0], profiles.profiles)) == 0
    assert all(quality._words(t.lower()) == quality._WORD.findall(t.lower()) for t in ODD if t)
    letters = "".join(map(chr, range(128)))
    assert quality._words(letters) == quality._WORD.findall(letters)


def sentence(rng):
    words = "river stone valve copper garden silent window market lantern orbit spindle meadow harvest crystal pebble cannon ribbon turbine".split()
    return "The " + " ".join(rng.choice(words) for _ in range(9)) + " of " + rng.choice(words) + ". "


def leak_fixture(seed=4):
    rng = random.Random(seed)
    items = [(i, ("Pick the right one. " if i % 2 else "") + "".join(sentence(rng) for _ in range(4)) + "What does it do?") for i in range(12)]
    items += [(50, items[0][1].replace("What does it do?", "Why is that so?")), (51, None), (52, ""), (53, "Short?")]
    passages = leakage.passages_of(items)
    docs = []
    for k, (words, ids) in enumerate(passages):
        filler = "".join(sentence(rng) for _ in range(6))
        half = words[: len(words) * 6 // 10]
        typo = [w[:-1] + "x" if i % 14 == 9 else w for i, w in enumerate(words)]
        docs += [(len(docs), filler + " ".join(words) + ". " + filler), (len(docs) + 1, "<p>" + " ".join(half).upper() + "</p> " + filler), (len(docs) + 2, filler + " ".join(typo)), (len(docs) + 3, filler + " ".join(words[: len(words) // 4]))]
    docs += [(1000, None), (1001, ""), (1002, "few words"), (1003, "word " * 20_000)]
    return items, passages, docs


def test_leakage_against_brute_force(spark):
    items, passages, docs = leak_fixture()
    brute = set()
    for d, text in docs:
        words = leakage.words_of(text)[:3000]
        for words_p, ids in passages:
            if len(set(words) & set(words_p)) > 5 and leakage.reproduced(words_p, words) >= leakage.SHARE:
                brute |= {(d, i) for i in ids}
    got = {(r.doc_id, r.item_id) for r in leakage.found(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, c) for i, c in items], "item_id bigint, context string")).collect()}
    assert got == brute and len(got) >= 3 * len(passages) and {i for _, i in got} >= {0, 50}
    assert leakage.found(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, context string")).count() == 0


def test_evenly_altered_halves_are_found():
    _, passages, _ = leak_fixture()
    index, rng = leakage.PassageIndex(passages), random.Random(1)
    vocabulary = sorted({w for words, _ in passages for w in words})
    for k, (words, _) in enumerate(passages):
        half = [rng.choice(vocabulary) if i % 10 == k % 10 else w for i, w in enumerate(words[: len(words) * 6 // 10])]
        around = lambda: [rng.choice(vocabulary) for _ in range(60)]
        text = " ".join(around() + half + around())
        if leakage.reproduced(words, leakage.words_of(text)) >= leakage.SHARE:
            assert k in {p for p, _ in index.leaked([text])[0]}


def test_windows_are_sized_to_the_item():
    assert [leakage.window_of(n) for n in (12, 40, 48, 66, 90, 400)] == [4, 8, 12, 16, 20, 24]
    import math

    for size in range(leakage.GRAIN, leakage.LONGEST + 1, leakage.GRAIN):
        assert math.gcd(*leakage.steps_of(size)) == 1


def test_items_are_counted_before_any_is_left_out(spark, monkeypatch):
    items, passages, docs = leak_fixture()
    docs, table = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, context string")
    whole = {tuple(r) for r in leakage.found(docs, table).collect()}
    monkeypatch.setattr(leakage, "PASSAGES", 5)  # several blocks
    assert {tuple(r) for r in leakage.found(docs, table).collect()} == whole
    monkeypatch.setattr(leakage, "MAX_ITEMS", 10)
    with pytest.raises(ValueError):
        leakage.found(docs, table)


def test_hamming_index_is_exact():
    import numpy as np

    _, passages, _ = leak_fixture()
    index = leakage.PassageIndex(passages)
    rng = np.random.default_rng(1)
    for size, (own, owner, _) in index.sizes.items():
        prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
        bit = lambda: np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)
        prints[:150] = own[rng.integers(0, len(own), 150)] ^ bit() ^ bit() ^ bit()
        near = np.bitwise_count(prints[:, None] ^ own[None]) <= leakage.RADIUS
        assert set(index.candidates(size, prints)) == {(int(i), int(owner[j])) for i, j in zip(*np.nonzero(near))}
