"""Pairs, overlap, scans, mixing and packing."""

import itertools
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("skein.llm")

from pyspark.sql import functions as F

from skein.llm import misreadings, mixture, overlap, packing, pairs, scans
from skein.llm.chat import parse
from skein.llm.ranks import ranked, seeded


def stored(*turns, alias=False):
    role, content = ("from", "value") if alias else ("role", "content")
    names = {"user": "human", "assistant": "gpt"} if alias else {}
    return json.dumps([{role: names.get(r, r), content: c} for r, c in turns])


def test_parse():
    assert parse(stored(("user", "a"), ("assistant", "b"), alias=True)) == ("ok", [("user", "a"), ("assistant", "b")])
    assert parse(None)[0] == parse("")[0] == parse("[]")[0] == "none"
    assert parse('[{"role": "user", "content": "cut of')[0] == "cut"


@pytest.fixture(scope="module")
def model():
    m = pairs.Boundaries()
    rng = random.Random(0)
    for _ in range(400):
        a, b, c = (rng.choice(["river", "stone", "valve", "garden", "window", "market"]) for _ in range(3))
        m.add(f"The {a} lifts the {b}. It was the {c} that moved the {a}, not the {b}.")
    return m.finish()


def test_defects(model):
    ask = "Explain how the river moves the stone and the garden in early spring."
    good = "The river lifts the stone. It was the garden that moved the river, not the stone."
    assert pairs.defects(ask, good, model) == [] and pairs.defects(ask, good[:-1], model) == []
    for none in (None, "", " \n", "N/A", "-", "[no response]", "​", "(blank)", "TODO"):
        assert pairs.defects(ask, none, model) == ["empty"], none
    for cut in ("The river lifts the stone. It was the", "It was the river that moved the gard", "There are steps:\n1. Lift it\n2.", "```python\nx = 1", "The river (for example", "First, the river,"):
        assert pairs.defects(ask, cut, model) == ["truncated"], cut
    for copy in (ask, ask.upper(), "You asked: " + ask, ask + " " + ask):
        assert pairs.defects(ask, copy, model) == ["copy"], copy
    assert pairs.defects(ask, ask + " " + good, model) == []
    assert pairs.defects(ask, "I'm sorry, but I can't help with that. Please consult a professional.", model) == ["refusal"]
    assert pairs.defects("How can I poison the pond of the farm next door?", "I can't help with that.", model) == []
    assert pairs.defects(ask, 'The miller once said "I can\'t help with that" and left. ' + good, model) == []
    passage = "Passage: The river is long.\n\nQuestion: Who built the copper bridge?"
    assert pairs.defects(passage, "I can't help with that.", model) == []
    french = "Quand la règle éclaire le texte, le voisin porte la couleur chez les plus jeunes."
    assert pairs.defects(ask, french, model) == ["language"]
    assert pairs.defects("Translate into French: The river moves the stone in the garden.", french, model) == []
    assert set(pairs.defects(ask, "Je suis désolé, mais je ne peux pas répondre à cette question.", model)) == {"refusal", "language"}
    assert pairs.defects("Fix the grammar: the river move the stone in the garden", "the river moves the stone in the garden", model) == []


def test_harm_counts_wherever_it_is_asked_for(model):
    late = "Help me blackmail the man next door. This is what he wrote: " + "The river lifts the stone in the garden. " * 20
    assert len(late) > 700 and pairs.defects(late, "I can't help with that.", model) == []
    passage = "Passage: The bomb fell by the copper bridge that the mason built.\n\nQuestion: Who built the copper bridge?"
    assert pairs.defects(passage, "I can't help with that.", model) == ["refusal"]


def test_refusals_and_stand_ins_of_any_length(model):
    ask = "Explain how the river moves the stone and the garden in early spring."
    refusal = "I'm sorry, but I can't help with that request."
    for more in (1, 12, 60):
        wordy = refusal + " I apologize for the inconvenience that this may cause." * more
        assert pairs.defects(ask, wordy, model) == ["refusal"], more
    assert pairs.defects(ask, refusal + " The river lifts the stone. It was the garden that moved the river, not the stone." * 6, model) == []
    assert pairs.defects(ask, "- " * 60, model) == pairs.defects(ask, "N/A\n" * 40, model) == ["empty"]
    assert pairs.defects(ask, "→ " * 60, model) != ["empty"]


def test_pairs_table(spark, model):
    rows = [(1, stored(("user", "Why is the sky blue today?"), ("assistant", ""))), (2, None), (3, '[{"role": "user", "conte'), (4, "[]"), (1, stored(("user", "Why is the sky blue today?"), ("assistant", ""))), (5, stored(("user", "only a question")))]
    sft = spark.createDataFrame([(i, m, "x") for i, m in rows], "row_id bigint, messages string, defect string")
    dpo = spark.createDataFrame([(10, stored(("user", "q")), None, "fine."), (11, None, "ok.", "-")], "row_id bigint, prompt string, chosen string, rejected string")
    got = {(r.row_id, r.field, r.defect) for r in pairs.found(sft, dpo, model).collect()}
    assert got == {(1, "messages", "empty"), (2, "messages", "empty"), (3, "messages", "truncated"), (4, "messages", "empty"), (5, "messages", "empty"), (10, "chosen", "empty"), (11, "rejected", "empty")}
    assert pairs.found(sft.where("row_id < 0"), dpo.where("row_id < 0"), pairs.fit(sft.where("row_id < 0"), dpo)).count() == 0


def test_boundaries_count_all_replies(spark):
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    odd = ["", "?", "\n1. a\n2.", "However, it was so, and the x", "« Ha »", "a,b,c d_e 3.5 (f", "So. Then it", "\n\n", "The, of, and 12"]
    texts = odd + [f"The {word(k % 7)} of {word(k)}, which was {k}. {'It ' * (k % 3)}lifted the {word(k % 5)}s" + "." * (k % 2) for k in range(300)]
    model, tally = pairs.Boundaries(), pairs.Tally(np.full(1 << 13, 255, np.uint8))
    for text in texts:
        model.add(text)
    for lo in range(0, len(texts), 50):
        tally.add(texts[lo : lo + 50])
    keys, seen, ends = tally.gathered()
    assert tally.words == model.vocabulary
    assert sorted(zip(seen.tolist(), ends.tolist())) == sorted((n, model.ends[k]) for k, n in model.seen.items())
    counted = dict(zip(keys.view(np.int64).tolist(), zip(seen.tolist(), ends.tolist())))
    for text in filter(pairs.classes, texts):
        tags = pairs.classes(text)
        assert [counted.get(k, (0, 0)) for k in pairs.context_keys(tags)] == [(model.seen[k], model.ends[k]) for k in pairs._last_contexts(tags)], text

    # 41 replies of 48,000 say that a reply is cut: too few in 12,000 of them
    usual, telling, cut = (stored(("user", "Say it."), ("assistant", x)) for x in ("Fine.", "The copper river lifts seven stones.", "The copper river lifts seven"))
    text = F.when(F.col("id") == 1, cut).when(F.col("id") % 1200 == 0, telling).when(F.col("id") == 7, telling).otherwise(usual)
    sft = spark.range(48_000).select(F.col("id").alias("row_id"), text.alias("messages"))
    dpo = spark.createDataFrame([], "row_id bigint, prompt string, chosen string, rejected string")
    assert [tuple(r) for r in pairs.found(sft, dpo, pairs.fit(sft, dpo)).collect()] == [(1, "messages", "truncated")]


def test_lcs():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(2)
    for _ in range(200):
        a, b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        assert pairs.lcs(a, b) == plain(a, b)


# ---------------------------------------------------------------- overlap


def records_fixture(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(12)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    head = "answer the question with the passage below and nothing else at all".split()
    train, val, k = [], [], 1000
    for i in range(60):
        words = (head if i % 2 else []) + text(rng.randint(14, 60)) + ([str(rng.randint(1, 99))] if i % 3 else [])
        val.append((i, words))
        for _ in range(rng.randint(0, 3)):
            w = list(words)
            for _ in range(rng.randint(0, len(w) // 10 + 1)):
                p = rng.randrange(len(w))
                kind = rng.randrange(3)
                if kind == 0:
                    w[p] = "zz" + w[p]
                elif kind == 1 and not w[p].isdigit():
                    del w[p]
                else:
                    w.insert(p, "extra")
            train.append((k, w))
            k += 1
    train += [(k + i, head + text(20)) for i in range(150)] + [(k + 500 + i, val[3][1]) for i in range(5)]
    return val, train


@pytest.mark.parametrize("hot", [None, 3])
def test_overlap_against_brute_force(spark, monkeypatch, hot):
    if hot:  # so that boilerplate and copies give hot keys
        monkeypatch.setattr(overlap, "HOT_KEY", hot)
    val, train = records_fixture()
    brute = set()
    for (i, a), (j, b) in itertools.product(val, train):
        most = overlap.allowed_edits(len(a), len(b))
        same = overlap._NUMBER.findall(" ".join(a)) == overlap._NUMBER.findall(" ".join(b))
        if same and min(len(a), len(b)) >= 12 and overlap.word_edits(a, b, most) <= most:
            brute.add(("sft", i, j))
    make = lambda rows, odd: spark.createDataFrame([(i, "s", stored(("user", " ".join(w).upper()), ("assistant", "")), "clash") for i, w in rows] + odd, "row_id bigint, source string, messages string, class string")
    odd = [(9000, None, None, "c"), (9001, "s", "", "c"), (9002, "s", "[]", "c"), (9003, "s", stored(("user", "too few words here")), "c")]
    v, t = make(val + val[:2], odd), make(train, odd)
    tables = {("sft", "val"): (v, "messages"), ("sft", "train"): (t, "messages")}
    got = {tuple(r) for r in overlap.found(spark, tables).collect()}
    assert got == brute and len(brute) > 30
    report = {r.split: r.n_records for r in overlap.report(spark, tables).collect()}
    assert report == {"val": len({i for _, i, _ in brute}), "train": len({j for _, _, j in brute})}
    empty = {("sft", "val"): (v.where("row_id < 0"), "messages"), ("sft", "train"): (t, "messages")}
    assert overlap.found(spark, empty).count() == 0


def test_chaining_rejects_scrambled_seeds():
    words = [f"w{k}" for k in range(120)]
    parts = [words[k : k + 12] for k in range(0, 120, 12)]
    scrambled = [w for k in (5, 0, 8, 2, 9, 1, 7, 3, 6, 4) for w in parts[k]]
    place = {w: k for k, w in enumerate(words)}
    seeds = lambda b: [(place[b[j]], j) for j in range(0, len(b) - overlap.GRAM, overlap.SPAN) if [place[w] for w in b[j : j + overlap.GRAM]] == list(range(place[b[j]], place[b[j]] + overlap.GRAM))]
    least = 120 // overlap.SPAN - overlap.edits_within(120)
    assert len(seeds(scrambled)) >= least  # as many seeds as a partner has, but in no order
    assert len(overlap.chained(seeds(scrambled), 24)) < least and overlap.judged(words, scrambled, seeds(scrambled), least) is None
    typed = [w if k % 15 else w + "x" for k, w in enumerate(words)]
    near = [(k, k) for k in range(1, 115, 6) if words[k : k + 5] == typed[k : k + 5]]
    assert overlap.judged(words, typed, near, 4) == pytest.approx(1 - 8 / 120)
    assert overlap.extended(words, typed, near, 12) == 8 == overlap.word_edits(words, typed, 12)
    assert overlap.extended(words, words[:50] + words[53:], [(0, 0), (60, 57)], 12) == 3


def test_word_edits():
    rng = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for _ in range(300):
        a, b = [rng.choice("abc") for _ in range(rng.randint(0, 10))], [rng.choice("abc") for _ in range(rng.randint(0, 10))]
        for most in (0, 2, 20):
            assert overlap.word_edits(a, b, most) == min(plain(a, b), most + 1)


# ---------------------------------------------------------------- scans


def book(spark):
    nouns = "river stone valve copper garden window market lantern harbour meadow harvest crystal pebble ribbon turbine furnace".split()
    rng = random.Random(6)
    pages, truth = [], set()
    for no in range(1, 31):
        body = [" ".join(["the", rng.choice(nouns), "near", "the", rng.choice(nouns), "moves", "a", rng.choice(nouns), "and", "the", rng.choice(nouns)]) for _ in range(12)]
        lines = ["Notes on Rivers", *body, f"Page {no}"]
        truth |= {(no, 1, "header"), (no, 14, "page_number")}
        if no % 3 == 0:
            lines[4] = lines[4] + " har-"
            lines[5] = "bour and " + lines[5]
            truth.add((no, 5, "hyphen"))
        if no % 4 == 0:
            lines[7] = lines[7] + " furnacc"
            truth.add((no, 8, "misread"))
        if no % 5 == 0:
            lines[9] = "a long-term plan and a long-"
            lines[10] = "term view of the " + lines[10]
        if no == 7:
            lines[0] = "N0tes on Rlvers"
        pages.append((no, "b", None, no, "\n".join(lines)))
    pages += [(100, "b", None, None, None), (101, None, None, 1, ""), (1, "b", None, 1, pages[0][4])]
    df = spark.createDataFrame(pages, "page_id bigint, doc string, source string, page_no int, text string")
    return df, truth


def test_scans(spark):
    df, truth = book(spark)
    s = scans.Scans(spark, df)
    got = {tuple(r) for r in s.lines().collect()}
    assert got == truth
    text = "\n".join(r.text for r in s.paragraphs().orderBy("doc", "paragraph_no").collect())
    assert "harbour and" in text and "har-" not in text and "furnacc" not in text and "Notes on" not in text and "Page 3" not in text and "long-term view" in text
    empty = scans.Scans(spark, df.where("page_id < 0"))
    assert empty.lines().count() == 0 and empty.paragraphs().count() == 0


def pages_of(spark, lines, size=25):
    return spark.createDataFrame([(k, "book", k, "\n".join(["", *lines[i : i + size]])) for k, i in enumerate(range(0, len(lines), size))], "page_id bigint, doc string, page_no int, text string")


def test_each_occurrence_is_judged_by_its_context(spark):
    """A spelling that is a word of its own beside some words and a misreading beside others."""
    rng = random.Random(6)
    common = [a + b + "m" for a in "bdfgklnprv" for b in "aeiouyw"]
    sea, wood = [a + "oss" for a in "bdfgkp"], [a + "ugg" for a in "bdfgkp"]
    lines = [" ".join(rng.choice(common) for _ in range(8)) for _ in range(1500)]
    lines += [f"{rng.choice(sea)} {rng.choice(sea)} harden {rng.choice(sea)} {rng.choice(sea)}" for _ in range(1200)]
    lines += [f"{rng.choice(wood)} {rng.choice(wood)} hardcn {rng.choice(wood)} {rng.choice(wood)}" for _ in range(14)]
    lines += [f"{rng.choice(sea)} {rng.choice(sea)} hardcn {rng.choice(sea)} {rng.choice(sea)}" for _ in range(14)]
    rng.shuffle(lines)
    s = scans.Scans(spark, pages_of(spark, lines))
    at = {(k, i + 1): line for k, first in enumerate(range(0, len(lines), 25)) for i, line in enumerate(["", *lines[first : first + 25]])}
    marked = Counter(("sea" if "oss" in at[r.page_id, r.line_no] else "wood") for r in s.lines().where("kind = 'misread'").collect())
    assert marked["sea"] >= 12 and marked["wood"] <= 4, marked


def test_prior_and_links(spark):
    assert misreadings.prior(1, 500, 1) > 0 > misreadings.prior(400, 500, 1)
    assert misreadings.prior(60_000, 900_000, 1) < 0 < misreadings.prior(20, 900_000, 1)  # no underflow
    assert misreadings.edits("kcrnel", "kernel", 2) == 1 and misreadings.edits("foiiow", "follow", 2) == 1 and misreadings.edits("kernel", "kitten", 2) is None
    long = "unrecognisabilities"  # above the eighteen letters that were once tried for one edit only
    assert misreadings.edits(long.replace("rec", "rcc").replace("bil", "hil"), long, 2) == 2
    words = spark.createDataFrame([(long, 900), (long.replace("rec", "rcc").replace("bil", "hil"), 1), ("modem", 300), ("modern", 900), ("c1oud", 1), ("cloud", 50), ("", 3)], "word string, n bigint")
    got = {(r.word, r.correction): r.prior for r in misreadings.links(words).collect()}
    assert got[long.replace("rec", "rcc").replace("bil", "hil"), long] > 0 and got["c1oud", "cloud"] > 0
    assert got.get(("modem", "modern"), -1) < 0  # often seen: a word of its own, but for its context
    assert misreadings.links(words.where("n < 0")).count() == 0


def test_vectors_tell_contexts_apart():
    rng = random.Random(3)
    pages = [[rng.choice(("red", "blue")) if k % 2 else rng.choice(("paint", "wall")) for k in range(60)] for _ in range(80)] + [[rng.choice(("salt", "fish")) if k % 2 else rng.choice(("boat", "net")) for k in range(60)] for _ in range(80)]
    rows, v, u, n = misreadings.train(pages)
    model = misreadings.Model(np.zeros((misreadings.ROWS, misreadings.SIZE), np.float32), np.zeros((misreadings.ROWS, misreadings.SIZE), np.float32))
    model.v[rows], model.u[rows] = v, u
    fits = model.fit(["red", "salt"], ["paint", "wall"])
    assert fits[0] > fits[1] and len(model.fit(["red"], [])) == 1 and misreadings.train([])[0].size == 0


def test_vectors_are_learnt_on_all_pages(spark):
    name = lambda k: "w" + "".join(chr(97 + int(c)) for c in str(k))
    rows = [(k, f"{name(k)} river {name(k)}", []) for k in range(6000)]
    pages = spark.createDataFrame(rows, "page_id bigint, text string, drop array<int>")
    model = misreadings.learn(pages, lambda text, drop: text.split())
    assert all(model.of(name(k))[2] for k in range(6000))
    pairs, times = misreadings.pairs_of([[1, 2, 1], [2, 1], []])
    assert [(p >> 30, p & (1 << 30) - 1, n) for p, n in zip(pairs.tolist(), times.tolist())] == [(1, 1, 1), (1, 2, 3)]
    assert misreadings.learn(pages.where("page_id < 0"), lambda text, drop: text.split()).v.any() == False  # noqa: E712


def test_signs_within_words_are_corrected(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bdgkmp") + rng.choice("aeou") for _ in range(4))
    lines = [f"{word()} the grey cloud hung over the valley near {word()} {word()}" for _ in range(60)]
    lines[25] = f"{word()} the grey c1oud hung over the vaIIey near {word()}"
    lines[35] = f"{word()} played the sma|l mp3 player by the c1oud {word()}"
    s = scans.Scans(spark, spark.createDataFrame([(k, "b", k, "\n".join(lines[10 * k : 10 * k + 10])) for k in range(6)], "page_id bigint, doc string, page_no int, text string"))
    assert {(r.page_id, r.line_no) for r in s.lines().where("kind = 'misread'").collect()} == {(2, 6), (3, 6)}
    text = " ".join(r.text for r in s.paragraphs().collect())
    assert "c1oud" not in text and "vaIIey" not in text and "small mp3 player" in text, text


def test_long_lines_with_one_beginning_are_no_header(spark):
    opening = "the long account of the voyage that the surveyors of the northern province made "
    pages = [(k, "b", k, "\n".join([opening + w, *[f"line {w} {j}" for j in range(8)]])) for k, w in enumerate(("around the western cape", "under heavy sails in winter", "past nine quiet harbours"))]
    df = spark.createDataFrame(pages, "page_id bigint, doc string, page_no int, text string")
    assert scans.Scans(spark, df).lines().where("kind = 'header'").count() == 0


def test_line_kinds():
    for line in ("Page 4", "- 12 -", "17", ". 16 .", "xv", "Page 17 of 295", "[26]"):
        assert scans.is_page_number(line, 17), line
    for line in ("1719.", "490  581  21", "Chapter 4", "", "Page turner"):
        assert not scans.is_page_number(line, 17), line
    assert scans.skeleton("Chapter 10 | Protocols   12") == scans.skeleton("Chapter 10 | Protoco1s   13")
    assert scans.folded("foIIow,") == "fo||ow" and scans.folded("(Iron") == "iron"
    counts = {"harbour": 9, "long-term": 4}
    assert scans.is_break("har-", "bour", lambda w: counts.get(w, 0)) and not scans.is_break("long-", "term", lambda w: counts.get(w, 0))
    assert scans.is_break("wit¬", "hout", lambda w: 0)


# ---------------------------------------------------------------- mixing and packing


def test_knapsack():
    rng = random.Random(8)
    for _ in range(60):
        counts = {rng.randint(1, 12): rng.randint(1, 4) for _ in range(4)}
        budget = rng.randint(0, 60)
        best = max(s for c in itertools.product(*[range(k + 1) for k in counts.values()]) if (s := sum(n * x for n, x in zip(counts, c))) <= budget)
        got = mixture.knapsack(counts, budget)
        assert sum(n * k for n, k in got.items()) == best and all(k <= counts[n] for n, k in got.items())


def test_exact_fillings_are_found_among_all_lengths():
    lengths = [*range(9999, 9549, -1), 5500, 4500]
    assert ((5500, 4500), 1) in packing.plan(dict.fromkeys(lengths, 1), 10_000)


def test_tiers_steer_the_plan():
    """A container of a tier takes pieces of its tier first; a plan over one list of lengths fills it otherwise."""
    counts = {400: 2, 290: 2, 120: 10, 190: 4, 90: 20}
    plan = packing.plan(counts, 1000)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 1000
        top = packing.tier(lengths[0], 1000)
        left = 1000
        for n in lengths:
            if packing.tier(n, 1000) == top:
                left -= n
        used.update({n: k * times for n, k in Counter(lengths).items()})
        more = [n for n in counts if packing.tier(n, 1000) == top and n <= left and used[n] < counts[n]]
        assert not more, (lengths, more)  # none of its own tier that would still have fitted was left for a later one
    assert used == counts
    assert plan[0][0][:2] == (400, 400)  # 400 + 290 + 190 + 120 would fill it, too


def test_largest_remainders_leave_the_rest_to_the_knapsack():
    rng = random.Random(12)
    for _ in range(20):
        counts = {rng.randint(1, 9000): rng.randint(1, 400) for _ in range(300)}  # far beyond the 400,000 tokens of old
        available = sum(n * k for n, k in counts.items())
        target = rng.randint(available // 50, 2 * available)
        fit = mixture.fit_task("t", 1.0, counts, target, 3)
        assert target - 1 <= fit.used <= target and all(k <= counts[n] for n, k in fit.extra.items())


def test_a_shortfall_is_shared():
    got = mixture.budgets({"a": 100, "b": 1000, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 1, "c": None}, 1000)
    assert got == {"a": 200, "b": 480, "c": 320}
    assert mixture.budgets({"a": 10}, {"a": 1.0}, {"a": 1}, 1000) == {"a": 10} and mixture.budgets({}, {}, {}, 5) == {}


def test_mixture(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["Chat", " chat ", "sql", None, "", "odd"]), stored(("user", "w " * rng.randint(1, 30)))) for i in range(500)] + [(900, "chat", None), (901, "sql", "broken [")]
    rows += rows[:20]
    table = spark.createDataFrame(rows, "row_id bigint, task string, messages string")
    goals = spark.createDataFrame([("sft", "chat", 0.6, 2), ("sft", "sql", 0.3, 3), ("sft", "none", 0.1, None), ("dpo", "chat", 1.0, 1)], "stage string, task string, weight double, max_repeats int")
    sized = mixture.sized(table, "messages")
    out = mixture.mixture(sized, goals, "sft")
    used = out.collect()
    assert len({r.row_id for r in used}) == len(used) and all(r.copies <= (2 if r.task == "chat" else 3) for r in used)
    assert {r.task for r in used} == {"chat", "sql"} and 900 not in {r.row_id for r in used}
    share = {(r.stage, r.task): r.actual_share for r in mixture.shares(out, goals).collect()}
    assert share["sft", "chat"] == pytest.approx(2 / 3, abs=2e-3) and share["sft", "none"] == 0
    assert {(r.row_id, r.copies) for r in mixture.mixture(sized, goals, "sft").collect()} == {(r.row_id, r.copies) for r in used}
    assert mixture.mixture(sized.where("row_id < 0"), goals, "sft").count() == 0


def test_packing(spark):
    rng = random.Random(10)
    docs = [(i, rng.choice([rng.randint(1, 100), rng.randint(1, 30), 7])) for i in range(600)] + [(700, 0), (701, None), (702, 250), (703, 100)]
    specs = spark.createDataFrame([("a", "chars", 100), ("b", "chars", 40), ("c", "bytes", 90)], "spec string, unit string, capacity int")
    table = spark.createDataFrame([(i, None if n is None else "é" * n, 5) for i, n in docs], "doc_id bigint, text string, n_chars bigint")  # n_chars is not used
    out = packing.packed(table, specs)
    rows = out.collect()
    for spec, capacity in (("a", 100), ("b", 40)):
        own = [r for r in rows if r.spec == spec]
        assert Counter(r.doc_id for r in own) == {i: max(1, -(-(n or 0) // capacity)) for i, n in docs}
        fill = defaultdict(list)
        for r in own:
            if r.container is None:
                assert r.length == 0
            else:
                fill[r.container].append((r.place, r.place + r.length))
        for spans in fill.values():
            spans.sort()
            assert spans[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        total = sum(n or 0 for _, n in docs)
        assert len(fill) <= 1.03 * total / capacity + 1
    loads = packing.summary(out, specs).collect()
    assert {r.spec for r in loads} == {"a", "b", "c"} and all(r.largest_load - r.least_load <= 2 * r.capacity for r in loads)
    assert packing.packed(table.where("doc_id < 0"), specs).count() == 0
    assert sum(r.length for r in rows if r.spec == "c") == 2 * total
    with pytest.raises(ValueError):
        packing.packed(table, spark.createDataFrame([("d", "furlongs", 9)], "spec string, unit string, capacity int"))
    assert packing.plan({}, 10) == [] and packing.tier(60, 100) == 0 and packing.tier(20, 100) == 2


def test_ranks(spark, monkeypatch):
    monkeypatch.setattr("skein.llm.ranks.ROWS_OF_RANGE", 100)
    df = spark.range(2000).withColumn("g", F.when(F.col("id") < 1500, "hot").otherwise("cold")).withColumn("h", seeded(1, F.col("id")))
    for largest in (1500, 10):  # in ranges, and in one
        out = ranked(df, ["g"], "h", ["id"], largest).collect()
        for g in ("hot", "cold"):
            own = sorted((r.h, r.id, r["rank"]) for r in out if r.g == g)
            assert [r for _, _, r in own] == list(range(len(own)))
