"""Noise in text from scanned pages (problem 3).

1. Furniture: the first and last lines of a page, reduced to a skeleton that is
   blind to numbers and to characters that scanners confuse, are headers where
   their skeleton stands on several pages of the book; lone numbers there are page
   numbers.
2. Breaks: a word broken over two lines, also over two pages (joined by book and
   page number), is told from a compound parted at its own hyphen by the counts of
   both spellings.
3. Misreadings (``misreadings``): words that are written with the same pen strokes are
   linked where plausible glyph edits turn one into the other; skip-gram vectors with
   negative sampling are learnt on the neighbours of words in all pages, part by part, and averaged.
   Every occurrence of a doubtful word is judged by itself: the prior odds of a
   misreading, from the counts of both words in all pages, and the fit of both words
   to the words around this occurrence decide whether it stays and which word it is.
4. Reflow: furniture is dropped, breaks are joined, words corrected, lines and
   pages run on within a paragraph.

Pages are read by Python four times as a whole: for edges, words, neighbours and doubtful words.

Defined results: null and empty texts have no lines and no noise; pages without a
number are not joined to a following page; a page delivered twice counts once;
rows without a book are pages of their own; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import misreadings
from skein.operators.running import running
from skein.operators.workspace import shared_folder

EDGE = 3  # lines at either end of a page that may be furniture
HEADER_PAGES = 2
FREQUENT = 30_000  # words that a worker holds: the most frequent, with their counts
MEMO = 1 << 18  # tokens that a worker remembers

_HYPHENS = "-‐‑¬­"
_NUMBER = re.compile(
    r"^[\W_]*(?:(?:page|pg|p|seite|s)\b[.:]?\s*)?(?:\d[\dOolIi]{0,3}|[lIOo]\d{1,3}|[ivxlcIVXLC]{1,7}|[-–]\s*\d{1,4}\s*[-–])(?:\s*(?:of|/|von)\s*[\dOolI]{1,4})?[\W_]*$", re.I
)
_LEADING = re.compile(r"^[\W_]*(?:(?:page|pg|p)\b[.:]?\s*)?(?:\d{1,4}|[ivxlc]{1,7})(?:\s*(?:of|/)\s*\d+)?[\s.|:–-]+(?=\S)", re.I)
_TRAILING = re.compile(r"[\s.|:–-]+(?:(?:page|pg|p)\b[.:]?\s*)?(?:\d{1,4}|[ivxlc]{1,7})(?:\s*(?:of|/)\s*\d+)?[\W_]*$", re.I)
_INNER_I = re.compile(r"(?<=[a-z])I+(?=[a-z])")
_CORE = re.compile(r"^[\"'“”‘’(\[{«»]*(.*?)[\"'“”‘’)\]}«».,;:?]*$", re.S)
_SAME = str.maketrans({"0": "o", "1": "l", "i": "l", "!": "l", "|": "l", "5": "s", "$": "s", "9": "g", "q": "g", "6": "b", "8": "b", "e": "c", "f": "t", "h": "b", "4": "a", "3": "c", "7": "t"})


def skeleton(line: str) -> str:
    """Letters of a line, without numbers at its ends and blind to confusable characters."""
    text = line.strip()
    shorter = _LEADING.sub("", text)
    text = _TRAILING.sub("", shorter) or shorter
    text = text.lower()
    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w"), ("li", "h"), ("ii", "u")):
        text = text.replace(a, b)
    text = text.translate(_SAME)
    for a, b in (("m", "m"), ("cl", "d"), ("ll", "u")):
        text = text.replace(a, b)
    return re.sub(r"[\W\d_]+", "", text)


_BARE = re.compile(r"^[\W_]*([\dOolIi]{1,5})[\W_]*$")


def is_page_number(line: str, page_no: int | None = None) -> bool:
    """Only a page number; a bare number of four digits, or one that ends a sentence, must be that of the page."""
    text = line.strip()
    if not text or len(text) > 24 or not _NUMBER.match(text):
        return False
    if not any(c.isdigit() for c in text):
        return re.fullmatch(r"[\W_]*(?:page\s+)?[ivxlc]+[\W_]*", text, re.I) is not None
    bare = _BARE.match(text)
    if bare:
        value = int(bare[1].translate(str.maketrans("OolIi", "00111")))
        sentence_end = text[0].isalnum() and text[-1] in ".,;:!?\"'”)"
        if value > 999 or sentence_end:
            return page_no is not None and value == page_no
    return True


@lru_cache(1 << 17)
def core(token: str) -> str:
    """A token without the punctuation around it."""
    return _CORE.match(token)[1]


@lru_cache(1 << 17)
def folded(token: str) -> str:
    """The word of a token in lower case; a capital I between small letters, which none writes, is the stroke it is."""
    w = _CORE.match(token)[1]
    return (_INNER_I.sub(lambda m: "|" * len(m[0]), w) if "I" in w else w).lower()


@lru_cache(1 << 17)
def is_word(text: str) -> bool:
    """A word that may be misread: letters, perhaps with other signs read into it; no code or number."""
    if len(text) < 2 or not any(c.isalpha() for c in text):
        return False
    letters = sum(c.isalpha() for c in text)
    if letters < 0.5 * len(text) or (text.upper() == text and any(c.isdigit() for c in text)):
        return False
    return all(c.isalpha() or c in "0123456789!|$@'’-" for c in text) and not re.fullmatch(r"[A-Za-z]\d+|[A-Z]{2,}\d+|\d+(?:st|nd|rd|th|s)", text)


def ends_open(token: str) -> bool:
    """Whether a token ends in a hyphen after a letter or digit."""
    return token[-1] in _HYPHENS and len(token) > 1 and token[-2].isalnum()


class Page:
    """The lines of a page without furniture, and the words broken between them."""

    def __init__(self, text: str | None, furniture: set[int], next_word: str | None = None, inside: bool = False):
        self.lines = (text or "").split("\n") if text else []
        self.kept = [i for i, x in enumerate(self.lines) if x.strip() and i not in furniture]
        self.tokens = {i: self.lines[i].split() for i in self.kept}
        #: (line, first part, next line or -1 for the next page, second part)
        self.breaks: list[tuple[int, str, int, str]] = []
        self.inside = inside  # whether the page begins within a word of the page before
        for k, i in enumerate(self.kept):
            last = self.tokens[i][-1]
            if not ends_open(last):
                continue
            if k + 1 < len(self.kept):
                j = self.kept[k + 1]
                second, at = self.tokens[j][0], j
            else:
                second, at = next_word or "", -1
            self.breaks.append((i, last, at, second))

    def part_places(self) -> set[tuple[int, int]]:
        """(line, place) of the tokens that are parts of broken words."""
        out = {(i, len(self.tokens[i]) - 1) for i, *_ in self.breaks} | {(j, 0) for _, _, j, _ in self.breaks if j >= 0}
        if self.inside and self.kept:
            out.add((self.kept[0], 0))
        return out

    def parts(self) -> list[str]:
        """The tokens that are parts of broken words."""
        return [self.tokens[i][k] for i, k in self.part_places()]


def joined(first: str, second: str) -> tuple[str, str]:
    """(word joined, word as a compound) of the two parts of a break."""
    a, b = re.sub(r"^\W+", "", first[:-1]), core(second)
    return (a + b), f"{a}-{b}"


def is_break(first: str, second: str, count) -> bool:
    """Whether a line ends within a word broken for its sake; ``count`` gives a spelling's count."""
    if first[-1] in "¬­":
        return True
    a, b = re.sub(r"^\W+", "", first[:-1]), core(second)
    if not a or not a[-1].isalpha():
        return False
    if not b:
        return count(a.lower()) == 0
    if not b[0].islower() or "-" in a:
        return False
    whole, compound = count((a + b).lower()), count(f"{a}-{b}".lower())
    if whole or compound:
        return whole >= compound
    return not (count(a.lower()) and count(b.lower()))


# ---------------------------------------------------------------- tables


def _emit(rows: list[tuple], fields: str):
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.split()[1]] for x in fields.split(", ")]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def named(pages: DataFrame) -> DataFrame:
    """The columns used, with a book of its own for a page that has none."""
    return pages.select(F.col("page_id").cast("bigint"), F.coalesce(F.col("doc").cast("string"), F.concat(F.lit("#"), F.col("page_id").cast("string"))).alias("doc"), F.col("page_no").cast("int"), F.col("text").cast("string"))


def _edges(pages: DataFrame) -> DataFrame:
    """The first and last lines of each page: skeletons of those that may be furniture, and how the page begins and ends."""
    fields = "page_id bigint, doc string, page_no int, line int, edge boolean, skeleton string, number boolean, word string, open boolean"

    def run(batches):
        for batch in batches:
            rows = []
            for page, doc, text, no in zip(*(batch.column(k).to_pylist() for k in range(4))):
                lines = (text or "").split("\n")
                full = [i for i, x in enumerate(lines) if x and not x.isspace()]
                edge = {*full[:EDGE], *full[-EDGE:]}
                for i in sorted({*full[: EDGE + 1], *full[-EDGE - 1 :]}):
                    tokens = lines[i].split()
                    number = i in edge and is_page_number(lines[i], no)
                    rows.append((page, doc, no, i, i in edge, skeleton(lines[i]) if i in edge and not number else "", number, tokens[0], ends_open(tokens[-1])))
            yield _emit(rows, fields)

    return pages.select("page_id", "doc", "text", "page_no").mapInArrow(run, fields)


def furniture(edges: DataFrame) -> DataFrame:
    """``(page_id, line, kind)`` of headers and page numbers; lines count from 0."""
    edges = edges.where("edge")
    lines = edges.where("not number and length(skeleton) >= 4").select("page_id", "doc", "line", "skeleton")
    repeated = lines.groupBy("doc", "skeleton").agg(F.count_distinct("page_id").alias("n")).where(F.col("n") >= HEADER_PAGES).select("doc", "skeleton")
    exact = lines.join(repeated, ["doc", "skeleton"], "left_semi")
    # a header with a further misreading keeps one half of its skeleton
    half = lambda c: (F.length(c) / 2).cast("int")
    halves = lambda df, name: df.select(
        *df.columns,
        F.explode(F.array(F.concat(F.lit("<"), F.col(name).substr(F.lit(1), half(F.col(name)))), F.concat(F.lit(">"), F.reverse(F.reverse(F.col(name)).substr(F.lit(1), half(F.col(name))))))).alias("key"),
    )
    other = lines.join(repeated, ["doc", "skeleton"], "left_anti").where("length(skeleton) >= 8")
    near = halves(other, "skeleton").join(halves(repeated.withColumnRenamed("skeleton", "known"), "known").where("length(known) >= 8"), ["doc", "key"])
    near = near.where(F.levenshtein("skeleton", "known") <= F.greatest(F.lit(1), (F.length("known") * 0.15).cast("int")))
    headers = exact.select("page_id", "line").unionByName(near.select("page_id", "line")).distinct()
    return headers.select("page_id", "line", F.lit("header").alias("kind")).unionByName(edges.where("number").select("page_id", "line", F.lit("page_number").alias("kind")))


class Scans:
    """The tables that all results of a set of pages share, written once to the shared folder."""

    def __init__(self, spark: SparkSession, pages: DataFrame):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/scans-{uuid.uuid4().hex}"
        edges = self._write("edges", _edges(named(pages)).dropDuplicates(["page_id", "line"]))
        self.furniture = self._write("furniture", furniture(edges))
        drop = self.furniture.groupBy("page_id").agg(F.collect_list("line").alias("drop"))  # at most 2 * EDGE of a page
        kept = edges.join(self.furniture.select("page_id", "line"), ["page_id", "line"], "left_anti").where("page_no is not null")
        ends = kept.groupBy("page_id").agg(*[F.first(c).alias(c) for c in ("doc", "page_no")], F.min_by("word", "line").alias("word"), F.max_by("open", "line").alias("open"))
        ends = ends.select("page_id", "doc", "page_no", "word", "open")
        follow = ends.select("doc", (F.col("page_no") - 1).alias("page_no"), "word").groupBy("doc", "page_no").agg(F.min("word").alias("next_word"))
        before = ends.select("doc", (F.col("page_no") + 1).alias("page_no"), "open").groupBy("doc", "page_no").agg(F.max("open").alias("inside"))
        about = ends.select("page_id", "doc", "page_no").join(follow, ["doc", "page_no"], "left").join(before, ["doc", "page_no"], "left").drop("doc", "page_no")
        both = named(pages).dropDuplicates(["page_id"]).join(drop, "page_id", "left").join(about, "page_id", "left")
        none = F.array().cast("array<int>")
        self.pages = self._write("pages", both.select("page_id", "doc", "page_no", "text", F.coalesce("drop", none).alias("drop"), "next_word", F.coalesce("inside", F.lit(False)).alias("inside")))
        self.words = self._write("words", self._words())
        self.links = self._write("links", misreadings.links(self.words))
        self._judged: tuple[DataFrame, DataFrame] | None = None

    def _write(self, name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(table.schema).parquet(f"{self.base}/{name}")

    def _words(self) -> DataFrame:
        """Counts of all words, in lower case; the parts of broken words do not count."""

        def run(batches):
            counts: Counter = Counter()
            for batch in batches:
                for text, drop, inside in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    page = Page(text, set(drop), None, inside)
                    counts.update(t for own in page.tokens.values() for t in own)
                    counts.subtract(page.parts())
                if len(counts) > 300_000:
                    yield _emit(list(counts.items()), "token string, n bigint")
                    counts = Counter()
            yield _emit(list(counts.items()), "token string, n bigint")

        def read(batches):
            for batch in batches:
                counts: Counter = Counter()
                for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if is_word(w := folded(t)):
                        counts[w] += n
                yield _emit(list(counts.items()), "word string, n bigint")

        tokens = self.pages.select("text", "drop", "inside").mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).where("n > 0")
        return tokens.mapInArrow(read, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))

    def judged(self) -> tuple[DataFrame, DataFrame]:
        """(accepted readings, ends of lines in a hyphen), each occurrence judged by the words around it.

        Readings: ``page_id, line, place, role, word, correction``; role is ``word``, or
        ``first`` and ``second`` of a word broken over two lines.
        """
        if self._judged:
            return self._judged
        top = self.words.orderBy(F.desc("n"), "word").limit(FREQUENT)
        counts = {r["word"]: r["n"] for r in top.collect()}  # FREQUENT words
        near = top.select("word").join(self.links, "word").select("word", "correction", "prior", "n", "m").collect()  # their links
        model = misreadings.learn(self.pages.select("page_id", "text", "drop"), lambda text, drop: [folded(t) for own in Page(text, set(drop)).tokens.values() for t in own])
        judge = misreadings.Judge(model, [tuple(r) for r in near])
        usual = set(counts) - judge.words
        shared = self.spark.sparkContext.broadcast((judge, frozenset(usual)))
        fields = "page_id bigint, line int, place int, role string, word string, other string, correction string, context array<string>"

        def run(batches):
            judge, usual = shared.value
            memo: dict[str, str] = {}  # what a token is to be looked up as; empty where it is not
            for batch in batches:
                rows = []
                for page_id, text, drop, next_word, inside in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    page = Page(text, set(drop), next_word, inside)
                    flat = [(i, k, t) for i, own in page.tokens.items() for k, t in enumerate(own)]
                    parts = page.part_places()
                    if len(memo) > MEMO:
                        memo.clear()
                    doubtful = []
                    for at, (_, _, t) in enumerate(flat):
                        w = memo.get(t)
                        if w is None:
                            w = folded(t)
                            w = memo[t] = w if w not in usual and is_word(w) else ""
                        if w:
                            doubtful.append(at)
                    around = lambda at: [folded(flat[j][2]) for j in range(max(0, at - misreadings.REACH), min(len(flat), at + misreadings.REACH + 1)) if j != at]
                    for at in doubtful:
                        i, k, t = flat[at]
                        if (i, k) not in parts:
                            w = memo[t]
                            if w in judge.words:
                                if good := judge.reading(w, around(at)):
                                    rows.append((page_id, i, k, "word", w, "", good, None))
                            else:
                                rows.append((page_id, i, k, "word", w, "", None, around(at)))
                    for i, first, j, second in page.breaks:
                        rows.append((page_id, i, -1, "break", first, second, None, None))
                        whole = joined(first, second)[0].lower()
                        if whole not in usual and is_word(whole):
                            own = page.tokens[i]
                            context = [folded(t) for t in own[-1 - misreadings.REACH : -1]] + [folded(t) for t in (page.tokens[j][1 : 1 + misreadings.REACH] if j >= 0 else [])]
                            rows.append((page_id, i, len(own) - 1, "first", whole, str(len(first) - 1), None, context))
                            if j >= 0:
                                rows.append((page_id, j, 0, "second", whole, str(len(first) - 1), None, context))
                yield _emit(rows, fields)

        marks = self._write("marks", self.pages.select("page_id", "text", "drop", "next_word", "inside").mapInArrow(run, fields))
        open_ = marks.where("correction is null and role <> 'break'").drop("correction")
        linked = self.links.groupBy("word").agg(F.collect_list(F.struct("correction", "prior", "n", "m")).alias("links"))  # words written with the same strokes
        asked = open_.join(linked, "word")

        def decide(batches):
            judge, _ = shared.value
            for batch in batches:
                good = [judge.best(w, [(x["correction"], x["prior"], x["n"], x["m"]) for x in links], context) for w, context, links in zip(*(batch.column(n).to_pylist() for n in ("word", "context", "links")))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("page_id", "line", "place", "role", "word", "other")), pa.array(good, pa.string())], names=["page_id", "line", "place", "role", "word", "other", "correction"])

        names = ["page_id", "line", "place", "role", "word", "other", "correction"]
        late = asked.select("page_id", "line", "place", "role", "word", "other", "context", "links").mapInArrow(decide, "page_id bigint, line int, place int, role string, word string, other string, correction string")
        readings = marks.where("role <> 'break'").select(*names).unionByName(late).where("correction is not null")
        self._judged = self._write("readings", readings), marks.where("role = 'break'")
        return self._judged

    def lines(self) -> DataFrame:
        """``(page_id, line_no, kind)`` of every noisy line; lines count from 1."""
        readings, breaks = self.judged()
        part = F.length(F.expr("substring(word, 1, int(other))"))
        same = F.expr("substring(word, 1, int(other)) = substring(correction, 1, int(other))")
        wrong = readings.where((F.col("role") == "word") | ((F.col("role") == "first") & ~same) | ((F.col("role") == "second") & same & (part > 0)))
        return (
            wrong.select("page_id", "line", F.lit("misread").alias("kind"))
            .unionByName(self._broken(breaks))
            .unionByName(self.furniture)
            .select("page_id", (F.col("line") + 1).alias("line_no"), "kind")
            .distinct()
        )

    def _broken(self, marks: DataFrame) -> DataFrame:
        """Of the lines that end in a hyphen those that end within a broken word."""
        fields = "page_id bigint, line int, first string, second string, spelling string"

        def run(batches):
            for batch in batches:
                rows = []
                for page_id, line, first, second in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    whole, compound = joined(first, second)
                    a = re.sub(r"^\W+", "", first[:-1])
                    rows += [(page_id, line, first, second, s.lower()) for s in {whole, compound, a, core(second)} if s]
                yield _emit(rows, fields)

        spelt = marks.select("page_id", "line", F.col("word").alias("first"), F.col("other").alias("second")).mapInArrow(run, fields)
        counts = spelt.join(self.words, spelt["spelling"] == self.words["word"], "left")
        known = counts.groupBy("page_id", "line", "first", "second").agg(F.map_from_entries(F.collect_set(F.struct("spelling", F.coalesce("n", F.lit(0)).alias("n")))).alias("counts"))

        def judge(batches):
            for batch in batches:
                rows = []
                for page_id, line, first, second, counts in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    seen = dict(counts)
                    if is_break(first, second, lambda s: seen.get(s, 0)):
                        rows.append((page_id, line, "hyphen"))
                yield _emit(rows, "page_id bigint, line int, kind string")

        return known.mapInArrow(judge, "page_id bigint, line int, kind string")

    def paragraphs(self) -> DataFrame:
        """``(doc, paragraph_no, page_id, text)``: the running text of each book; page_id is where a paragraph begins."""
        readings, marks = self.judged()
        fixes = readings.where("role <> 'second'").groupBy("page_id").agg(F.collect_list(F.concat_ws("\t", "line", "place", "role", "correction")).alias("fixed"))
        breaks = self._broken(marks).groupBy("page_id").agg(F.collect_list("line").alias("broken"))
        ready = self.pages.join(breaks, "page_id", "left").join(fixes, "page_id", "left")
        fields = "doc string, page_no int, page_id bigint, part int, opens boolean, glued boolean, text string"

        def run(batches):
            for batch in batches:
                rows = []
                for doc, no, page_id, text, drop, broken, fixed in zip(*(batch.column(k).to_pylist() for k in range(7))):
                    fix = {(int(x[0]), int(x[1]), x[2] == "word"): x[3] for x in (f.split("\t") for f in fixed or [])}
                    for k, (opens, glued, piece) in enumerate(reflow(text, set(drop), set(broken or []), fix)):
                        rows.append((doc, no, page_id, k, opens, glued, piece))
                yield _emit(rows, fields)

        parts = self._write("parts", ready.select("doc", "page_no", "page_id", "text", "drop", "broken", "fixed").mapInArrow(run, fields))
        # paragraphs are numbered page by page: a running sum of the pages' openings, then a window within each page
        per = parts.groupBy("doc", "page_no", "page_id").agg(F.sum(F.col("opens").cast("int")).alias("opened"))
        placed_no = per.withColumn("no", F.coalesce("page_no", F.lit(2147483647)))
        earlier = running(placed_no, ["no", "page_id"], F.col("opened"), ["doc"], "earlier").select("page_id", "earlier")
        own = Window.partitionBy("page_id").orderBy("part")
        placed = parts.join(earlier, "page_id").withColumn("paragraph_no", F.col("earlier") + F.sum(F.col("opens").cast("int")).over(own))
        pieces = F.array_sort(F.collect_list(F.struct(F.coalesce("page_no", F.lit(2147483647)).alias("no"), "page_id", "part", "glued", "text")))
        joined_text = F.aggregate(pieces, F.lit(""), lambda a, p: F.concat(a, F.when((a == "") | p["glued"], "").otherwise(" "), p["text"]))
        text = F.regexp_replace(joined_text, "\u0001 ?", "")
        return placed.groupBy("doc", "paragraph_no").agg(F.min_by("page_id", F.struct(F.coalesce("page_no", F.lit(2147483647)), "page_id")).alias("page_id"), text.alias("text"))


def corrected(token: str, good: str | None) -> str:
    """A token with its word corrected, in the case it has."""
    w = core(token)
    if not good or not w:
        return token
    if w[0].isupper():
        good = good[0].upper() + good[1:]
    return token.replace(w, good, 1)


def reflow(text: str | None, drop: set[int], broken: set[int], fix: dict[tuple[int, int, bool], str]) -> list[tuple[bool, bool, str]]:
    """(begins a paragraph, is glued to what is before, text) of the runs of a page.

    ``fix`` maps (line, place, whole) to a correction; a word broken over two lines has its
    own at its first part.  A blank line between two kept lines begins a paragraph, as does
    the first line where a blank one stands before it; a run that ends within a word or
    compound ends in \\x01.
    """
    lines = (text or "").split("\n") if text else []
    runs: list[list[str]] = []
    opens: list[bool] = []
    blank, glue, compound = False, False, False
    seen, whole = False, None
    for i, line in enumerate(lines):
        if not line.strip():
            blank = blank or seen or i == 0
            continue
        if i in drop:
            continue
        tokens = line.split()
        if not runs or blank:
            runs.append([])
            opens.append(blank)
        out = [corrected(t, fix.get((i, k, True))) for k, t in enumerate(tokens)]
        if (glue or compound) and runs[-1]:
            before = runs[-1].pop()
            out[0] = corrected(before + tokens[0], whole) if glue else before + out[0]
        glue = i in broken
        whole = fix.get((i, len(tokens) - 1, False))
        compound = not glue and len(tokens[-1]) > 1 and tokens[-1][-1] in _HYPHENS and tokens[-1][-2].isalnum()
        if glue:
            out[-1] = out[-1][:-1] if len(tokens) == 1 else tokens[-1][:-1]
        runs[-1] += out
        blank, seen = False, True
    result = [(o, False, " ".join(r)) for o, r in zip(opens, runs) if r]
    if result and (glue or compound):
        o, g, t = result[-1]
        result[-1] = (o, g, t + "\u0001")
    return result
