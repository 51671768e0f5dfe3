"""Records that recur, exactly or nearly, across splits (problem 2).

Every record becomes its sequence of words; equal sequences form a class, of
which one record stands for all.  Each class is fingerprinted by winnowing: of
every ``WINDOW`` consecutive rolling hashes of ``GRAM`` words the smallest is kept,
where grams common among the hold-out records order last, so that a shared run of
``SPAN`` words always shares a kept fingerprint.  Fingerprints are joined across the
splits together with a hash of the record's numbers (records that differ in a
number are different).  The seeds of a pair are chained: the best collinear chain,
whose changes of offset count as edits, must be as long as a partner's would be (see
below), else the pair is dropped.  The chain is then extended: the words before it,
between its seeds and after it are aligned, and the edits so found give the coverage.
Only where a chain that is long enough extends to too many edits, as repeated phrases
can put a seed on a wrong diagonal, are the whole records aligned as an exact check.

A training record is cut into spans of ``SPAN`` words, each with one kept
fingerprint.  A partner differs in at most e words (``EDITS`` of the longer record),
each of which spoils one span, so all spans but e share their fingerprint with it.
Records whose spans meet fewer hold-out keys than that are left out in the pass that
reads them, pairs that share fewer before texts are fetched.  Keys of more than
``HOT_KEY`` training classes are left out of a record that has enough spans without
them (its bound falls by as many); others are joined by all their keys, the hot ones
spread over ``SALTS`` parts of the training classes.

Defined results: null, empty and wordless records and those below ``MIN_WORDS``
words have no partner; other columns are ignored; repeated deliveries count once,
copies under another id each for themselves.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.chat import parse
from skein.operators.workspace import shared_folder

GRAM, WINDOW = 5, 2
SPAN = GRAM + WINDOW - 1
HOT_KEY, SALTS = 1000, 32  # training classes beyond which a key is hot; parts that such a key is spread over
COMMON_MOST = 50_000  # common grams that order last; the bound of what is sent to every task
MIN_WORDS, EDITS = 12, 0.1
COMMON_SHARE = 0.001  # occurrences for each record of a part from which a gram counts as common
SIFT_BITS = (1 << 16, 1 << 28)  # least and most bits of the sieve of hold-out keys: at most 32 MB, however large the splits
MEMO_WORDS = 400_000

_WORD = re.compile(r"[^\W_]+")
_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ`](?=\w)")
_NUMBER = re.compile(r"\d+")
RECORD_SCHEMA = (
    "stage string, split string, row_id bigint, source string, class binary, numbers bigint, n int, text string, seeds array<bigint>, places array<int>, spans int"
)


def words_of(text: str) -> list[str]:
    if not text.isascii():
        text = text.replace("\u00ad", "").replace("\u200b", "")
    return _WORD.findall(_APOSTROPHE.sub("", text).casefold())


def record_words(stored: str | None) -> list[str]:
    """The words of all turns of a stored conversation."""
    out: list[str] = []
    for _, text in parse(stored)[1]:
        if text:
            out += words_of(text)
    return out


class Hasher:
    """64-bit hashes of words, and rolling hashes of GRAM words."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out = []
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, np.uint64)

    @staticmethod
    def grams(h: np.ndarray) -> np.ndarray:
        if len(h) < GRAM:
            return np.zeros(0, np.uint64)
        m = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            g = h[: len(h) - GRAM + 1].copy()
            for k in range(1, GRAM):
                g = g * m + h[k : len(h) - GRAM + 1 + k]
            g ^= g >> np.uint64(31)
            g *= np.uint64(0xBF58476D1CE4E5B9)
            g ^= g >> np.uint64(29)
        return g


class Batch:
    """The grams of a batch of records in one array, and those that winnowing keeps."""

    def __init__(self, records: list[list[str]], hasher: Hasher):
        n = np.array([len(r) for r in records], np.int64)
        h = hasher.words([w for r in records for w in r])
        self.n = n
        first = np.concatenate([[0], np.cumsum(n)])
        grams = hasher.grams(h)
        starts = np.repeat(np.arange(len(records)), np.maximum(n - GRAM + 1, 0))  # record of each gram
        count = np.maximum(n - GRAM + 1, 0)
        begin = np.cumsum(count) - count
        self.place = np.arange(len(starts)) - begin[starts] if len(starts) else np.zeros(0, np.int64)
        self.record = starts
        self.grams = grams[first[:-1][starts] + self.place] if len(starts) else np.zeros(0, np.uint64)
        self.begin, self.count = begin, count

    def winnowed(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the kept grams (the least of every WINDOW, common ones last, the rightmost of equals), and of those of the spans."""
        g = self.grams
        if not len(g):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        is_common = np.zeros(len(g), bool)
        if len(common):
            at = np.searchsorted(common, g)
            at[at == len(common)] = 0
            is_common = common[at] == g
        order = (g >> np.uint64(1)) | (is_common.astype(np.uint64) << np.uint64(63))
        last = len(g) - 1
        best, where = order.copy(), np.arange(len(g))
        end = (self.begin + self.count - 1)[self.record]  # last gram of the record
        for k in range(1, WINDOW):
            other = np.minimum(np.arange(len(g)) + k, last)
            inside = (np.arange(len(g)) + k <= end) & (order[other] <= best)
            best = np.where(inside, order[other], best)
            where = np.where(inside, other, where)
        # windows that are whole; a record of fewer grams than a window has one window
        whole = (np.arange(len(g)) + WINDOW - 1 <= end) | (self.place == 0)
        spans = (self.place % SPAN == 0) & (np.arange(len(g)) + WINDOW - 1 <= end)
        return np.unique(where[whole]), where[spans]


class Sieve:
    """Which (stage, numbers, seed) keys the hold-out records have, in a bounded number of bits."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(len(bits) * 64 - 1)

    @staticmethod
    def keys(stage: str, numbers: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            k = (seeds ^ (numbers * np.uint64(0x9E3779B97F4A7C15))) + np.uint64(xxhash.xxh3_64_intdigest(stage))
            k ^= k >> np.uint64(32)
            k *= np.uint64(0xD6E8FEB86659FD93)
            k ^= k >> np.uint64(32)
        return k

    @staticmethod
    def places(keys: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return keys & mask, (keys >> np.uint64(20) ^ keys << np.uint64(17)) & mask

    def holds(self, keys: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        out = np.ones(len(keys), bool)
        for p in self.places(keys, self.mask):
            out &= (self.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & one).astype(bool)
        return out


def build_sieve(seeds: DataFrame) -> Sieve:
    """The sieve of ``(stage, numbers, seeds)`` rows: bits are set in each part and joined by their words."""
    total = seeds.agg(F.sum(F.size("seeds"))).first()[0] or 0
    n_bits = SIFT_BITS[0]
    while n_bits < min(16 * total, SIFT_BITS[1]):
        n_bits *= 2
    mask = np.uint64(n_bits - 1)

    def run(batches):
        words = np.zeros(n_bits // 64, np.uint64)
        for batch in batches:
            for stage, numbers, own in zip(*(batch.column(k).to_pylist() for k in range(3))):
                keys = Sieve.keys(stage, np.array([numbers], np.int64).view(np.uint64), np.array(own, np.int64).view(np.uint64))
                for p in Sieve.places(keys, mask):
                    np.bitwise_or.at(words, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at].view(np.int64))], names=["at", "word"])

    parts = seeds.select("stage", "numbers", "seeds").mapInArrow(run, "at bigint, word bigint")
    table = parts.groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # at most SIFT_BITS / 64 rows
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[table.column("at").to_numpy()] = np.asarray(table.column("word").to_numpy(), np.int64).view(np.uint64)
    return Sieve(bits)


def edits_within(n: int) -> int:
    """Most edits to a partner of a record of n words, which may be longer by as many."""
    return int(n / (1 / EDITS - 1) + 1e-9)


def _common_grams(tables: list[DataFrame]) -> np.ndarray:
    """Grams that occur at least COMMON_SHARE times as often as there are records, in some part of the tables.

    A part gives only grams above its own share, so at most (grams of a record) /
    COMMON_SHARE of them; any gram above the share overall is above it in some part.
    The COMMON_MOST with the highest counts are taken.  They decide only which gram of a
    window is kept, on both sides alike; no pair depends on them.
    """

    def run(batches):
        hasher, held, size, records = Hasher(), [], 0, 0
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def fold():
            nonlocal values, counts, held, size
            v, n = np.unique(np.concatenate(held), return_counts=True)
            if len(values):
                at = np.searchsorted(values, v)
                at[at == len(values)] = 0
                old = values[at] == v
                counts[at[old]] += n[old]
                v, n = np.concatenate([values, v[~old]]), np.concatenate([counts, n[~old]])
                order = np.argsort(v)
                v, n = v[order], n[order]
            if len(v) > 2_000_000:  # bounds the memory of a task; what is seen once so far is rare
                v, n = v[n > 1], n[n > 1]
            values, counts, held, size = v, n, [], 0

        for batch in batches:
            words = [record_words(x) for x in batch.column(0).to_pylist()]
            own = Batch(words, hasher)
            held.append(own.grams)
            size += len(own.grams)
            records += len(words)
            if size > 1_000_000:
                fold()
        if held:
            fold()
        keep = counts >= max(4.0, COMMON_SHARE * records)
        yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep])], names=["g", "n"])

    parts = None
    for table in tables:
        one = table.mapInArrow(run, "g bigint, n bigint")
        parts = one if parts is None else parts.unionByName(one)
    rows = parts.groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(COMMON_MOST).select("g").toArrow()
    return np.sort(np.array(rows.column(0).to_numpy(), np.int64).view(np.uint64))


def records(table: DataFrame, stage: str, split: str, column: str, common: np.ndarray, sieve: Sieve | None = None) -> DataFrame:
    """RECORD_SCHEMA of the rows of a table that have enough words.

    Without a sieve the seeds are all kept grams; with one they are those of the spans
    that it holds, and rows with fewer than a partner would share are left out.
    """
    shared = table.sparkSession.sparkContext.broadcast((common, None if sieve is None else sieve.bits))

    def run(batches):
        hasher = Hasher()
        common, bits = shared.value
        sift = None if bits is None else Sieve(bits)
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32()]
        for batch in batches:
            ids, sources, stored = (batch.column(k).to_pylist() for k in range(3))
            words = [w if len(w := record_words(x)) >= MIN_WORDS else [] for x in stored]
            own = Batch(words, hasher)
            kept, spans = own.winnowed(common)
            numbers = np.array([xxhash.xxh3_64_intdigest(" ".join(_NUMBER.findall(" ".join(w)))) >> 1 if w else 0 for w in words], np.uint64)
            keep = kept
            total = np.bincount(own.record[spans], minlength=len(words))
            least = np.ones(len(words), np.int64)
            if sift is not None:
                keep = spans[sift.holds(Sieve.keys(stage, numbers[own.record[spans]], own.grams[spans]))]
                least = np.maximum(1, [t - edits_within(len(w)) for t, w in zip(total.tolist(), words)])
            cuts = np.searchsorted(own.record[keep], np.arange(len(words) + 1))
            rows = []
            for k in np.flatnonzero(cuts[1:] - cuts[:-1] >= least).tolist():
                at = keep[cuts[k] : cuts[k + 1]]
                text = " ".join(words[k])
                rows.append((stage, split, ids[k], sources[k], xxhash.xxh3_128_digest(text), int(numbers[k]), len(words[k]), text, own.grams[at].view(np.int64).tolist(), own.place[at].tolist(), int(total[k])))
            cols = list(zip(*rows)) or [()] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    cols = table.select(F.col("row_id").cast("bigint"), F.col("source").cast("string"), F.col(column).cast("string"))
    return cols.mapInArrow(run, RECORD_SCHEMA)


def chained(seeds: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """The best collinear chain of (val, train) seeds: most seeds, then least change of offset, which may be ``most`` in all.

    Seeds are runs of GRAM equal words; in a chain both places rise.
    """
    seeds = sorted(set(seeds))
    # best chain that ends in a seed, for each total change of offset
    ends: list[dict[int, tuple[int, int, int]]] = []  # drift -> (length, previous seed, its drift)
    top = (0, 0, -1, 0)
    reach = 0
    for k, (v, t) in enumerate(seeds):
        own = {min(most, abs(v - t)): (1, -1, 0)} if abs(v - t) <= most else {}
        for j in range(k - 1, -1, -1):
            pv, pt = seeds[j]
            if v - pv > reach and len(own) > 1 and v - pv > 40 * SPAN:
                break
            if pv >= v or pt >= t:
                continue
            step = abs((v - pv) - (t - pt))
            for drift, (length, _, _) in ends[j].items():
                d = drift + step
                if d <= most and (d not in own or own[d][0] <= length):
                    own[d] = (length + 1, j, drift)
            if v - pv > 4 * SPAN and any(x[0] > 4 for x in own.values()):
                break  # seeds further back are reached through nearer ones
        ends.append(own)
        for d, (length, _, _) in own.items():
            if (length, -d) > (top[0], top[1]):
                top = (length, -d, k, d)
    out, k, d = [], top[2], top[3]
    while k >= 0:
        out.append(seeds[k])
        _, k, d = ends[k][d]
    return out[::-1]


def extended(a: list[str], b: list[str], chain: list[tuple[int, int]], most: int) -> int:
    """Edits between a and b along a chain of seeds: the words before, between and after them are aligned; most + 1 where there are more."""
    total, i, j = 0, 0, 0
    for v, t in [*chain, (len(a), len(b))]:
        if v < len(a) and a[v : v + GRAM] != b[t : t + GRAM]:
            continue  # equal hashes of unequal words
        if v < i or t < j:  # overlaps the seed before: run on with it where it lies on the same diagonal
            if v - t == i - j and v < len(a):
                i, j = max(i, v + GRAM), max(j, t + GRAM)
                continue
            v, t = max(v, i), max(t, j)
        total += word_edits(a[i:v], b[j:t], most - total)
        if total > most:
            return most + 1
        if v < len(a):
            i, j = v, t
            while i < len(a) and j < len(b) and a[i] == b[j]:  # extend the seed as far as the words agree
                i, j = i + 1, j + 1
        else:
            i, j = v, t
    return total


def word_edits(a: list[str], b: list[str], most: int) -> int:
    """Words added, dropped or replaced between a and b; most + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return max(len(a), len(b)) if max(len(a), len(b)) <= most else most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        own = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                own[0] = i
                continue
            cost = row.get(j - 1, most + 1) + (a[i - 1] != b[j - 1])
            own[j] = min(cost, row.get(j, most + 1) + 1, own.get(j - 1, most + 1) + 1)
        row = own
        if min(row.values()) > most:
            return most + 1
    return min(row.get(len(b), most + 1), most + 1)


def allowed_edits(n_a: int, n_b: int) -> int:
    return int(max(n_a, n_b) * EDITS + 1e-9)


def judged(a: list[str], b: list[str], seeds: list[tuple[int, int]], least: int) -> float | None:
    """Coverage of two records by their chained and extended seeds; None where they are no partners.

    ``least`` is the number of seeds that the chain of a partner has.
    """
    most = allowed_edits(len(a), len(b))
    chain = chained(seeds, 2 * most)
    if len(chain) < least:
        return None
    edits = extended(a, b, chain, most)
    if edits > most:
        edits = word_edits(a, b, most)
    return 1.0 - edits / max(len(a), len(b)) if edits <= most else None


def _aligned(pairs: DataFrame) -> DataFrame:
    """The candidate class pairs whose chained seeds extend to an alignment within the edits, with their coverage."""

    def run(batches):
        for batch in batches:
            keep, cover = [], []
            for k, (a, b, places_a, places_b, least) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("val_text", "train_text", "val_places", "train_places", "least")))):
                share = judged(a.split(" "), b.split(" "), list(zip(places_a, places_b)), least)
                if share is not None:
                    keep.append(k)
                    cover.append(share)
            part = batch.select(["stage", "val_class", "train_class"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cover, pa.float64())], names=["stage", "val_class", "train_class", "coverage"])

    return pairs.mapInArrow(run, "stage string, val_class binary, train_class binary, coverage double")


def class_pairs(spark: SparkSession, tables: dict[tuple[str, str], tuple[DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """(pairs of classes with their coverage, membership of the classes).

    ``tables`` maps (stage, split) to a table and its column of stored turns.  The
    hold-out records and the training records that share a key with them are written
    once to the shared folder, so that losing an executor costs no second
    fingerprinting.
    """
    folder = f"{shared_folder(spark)}/overlap-{uuid.uuid4().hex}"
    common = _common_grams([t.select(F.col(c).cast("string")) for (_, split), (t, c) in tables.items() if split == "val"])
    def write(split: str, sieve: Sieve | None) -> DataFrame:
        every = None
        for (stage, side), (table, column) in tables.items():
            if side == split:
                one = records(table, stage, split, column, common, sieve)
                every = one if every is None else every.unionByName(one)
        every.write.mode("overwrite").parquet(f"{folder}/{split}")
        return spark.read.schema(RECORD_SCHEMA).parquet(f"{folder}/{split}")

    val = write("val", None)
    stored = val.unionByName(write("train", build_sieve(val)))
    members = stored.select("stage", "split", "row_id", "source", "class").dropDuplicates(["stage", "split", "row_id", "class"])
    first = members.groupBy("stage", "split", "class").agg(F.min("row_id").alias("row_id"))
    val_first, train_first = first.where("split = 'val'").drop("split"), first.where("split = 'train'").drop("split")
    same = val_first.select("stage", "class").join(train_first.select("stage", "class"), ["stage", "class"])
    same = same.select("stage", F.col("class").alias("val_class"), F.col("class").alias("train_class"), F.lit(1.0).alias("coverage"))

    def seeds(split: str, alone: DataFrame) -> DataFrame:
        # deliveries and copies of a representative are left out: it alone is fingerprinted
        of = stored.where(F.col("split") == split).select("stage", "row_id", "class", "numbers", "n", "spans", F.arrays_zip("seeds", "places").alias("z"))
        of = of.join(alone, ["stage", "class", "row_id"], "left_semi").dropDuplicates(["stage", "class"])
        return of.select("stage", F.col("class").alias(f"{split}_class"), "numbers", F.col("n").alias(f"{split}_n"), F.col("spans").alias(f"{split}_spans"), F.explode("z").alias("s")).select(
            "stage", f"{split}_class", "numbers", f"{split}_n", f"{split}_spans", F.col("s.seeds").alias("seed"), F.col("s.places").alias(f"{split}_place")
        )

    v, t = seeds("val", val_first).drop("val_spans"), seeds("train", train_first)
    key = ["stage", "numbers", "seed"]
    hot = t.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > HOT_KEY).select(*key, F.lit(1).alias("hot"))
    hot.write.mode("overwrite").parquet(f"{folder}/hot")
    hot = spark.read.schema("stage string, numbers bigint, seed bigint, hot int").parquet(f"{folder}/hot")
    join = key
    if not hot.isEmpty():
        t = _without_needless(t.join(hot, key, "left").withColumn("hot", F.coalesce("hot", F.lit(0))))
        # hot keys are spread over SALTS parts of the training classes, to each of which their few hold-out seeds go
        t = t.withColumn("salt", F.when(F.col("hot") == 1, F.pmod(F.xxhash64("train_class"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
        every = F.when(F.col("hot") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        v = v.join(hot, key, "left").select(*v.columns, F.explode(every).alias("salt"))
        join = [*key, "salt"]
    edits = F.floor(F.greatest("val_n", "train_n") * EDITS + 1e-9)
    hits = v.join(t, join).where((F.col("val_class") != F.col("train_class")) & (F.abs(F.col("val_n") - F.col("train_n")) <= edits))
    near = hits.groupBy("stage", "val_class", "train_class").agg(
        F.collect_list(F.struct("val_place", "train_place")).alias("z"),
        F.count_distinct("train_place").alias("shared"),
        F.max(F.col("train_spans") - edits).alias("least"),
    )
    near = near.where("shared >= least").select("stage", "val_class", "train_class", "z", F.greatest("least", F.lit(1)).cast("int").alias("least"))
    def texts(split: str) -> DataFrame:
        wanted = near.select("stage", F.col(f"{split}_class").alias("class")).distinct()
        of = stored.where(F.col("split") == split).select("stage", "class", "text").join(wanted, ["stage", "class"], "left_semi").dropDuplicates(["stage", "class"])
        return of.select("stage", F.col("class").alias(f"{split}_class"), F.col("text").alias(f"{split}_text"))

    near.write.mode("overwrite").parquet(f"{folder}/near")
    near = spark.read.schema("stage string, val_class binary, train_class binary, z array<struct<val_place:int,train_place:int>>, least int").parquet(f"{folder}/near")
    both = near.join(texts("val"), ["stage", "val_class"]).join(texts("train"), ["stage", "train_class"])
    found = _aligned(both.select("stage", "val_class", "train_class", "val_text", "train_text", F.col("z.val_place").alias("val_places"), F.col("z.train_place").alias("train_places"), "least"))
    return same.unionByName(found), members


def _without_needless(seeds: DataFrame) -> DataFrame:
    """The training seeds without the hot ones of records that have enough spans without them."""
    hot = seeds.groupBy("stage", "train_class").agg(F.sum("hot").alias("h"))
    bound = F.col("train_spans") - F.col("h")
    most = F.floor(F.col("train_n") / (1 / EDITS - 1) + 1e-9)
    spare = bound - most >= 1
    each = seeds.join(hot, ["stage", "train_class"]).withColumn("spare", spare)
    return each.where("hot = 0 or not spare").withColumn("train_spans", F.when(F.col("spare"), bound).otherwise(F.col("train_spans"))).drop("h", "spare")


def found(spark: SparkSession, tables: dict[tuple[str, str], tuple[DataFrame, str]]) -> DataFrame:
    """``(stage, val_id, train_id)`` of every pair of records, copies and near copies."""
    pairs, members = class_pairs(spark, tables)
    val = members.where("split = 'val'").select("stage", F.col("class").alias("val_class"), F.col("row_id").alias("val_id"))
    train = members.where("split = 'train'").select("stage", F.col("class").alias("train_class"), F.col("row_id").alias("train_id"))
    return pairs.join(val, ["stage", "val_class"]).join(train, ["stage", "train_class"]).select("stage", "val_id", "train_id").distinct()


def report(spark: SparkSession, tables: dict[tuple[str, str], tuple[DataFrame, str]]) -> DataFrame:
    """Records of each stage, split and source that have a partner in the other split, with their mean coverage.

    Counted over classes and their membership; pairs are not expanded.
    """
    pairs, members = class_pairs(spark, tables)
    sides = None
    for split in ("val", "train"):
        one = pairs.groupBy("stage", F.col(f"{split}_class").alias("class")).agg(F.max("coverage").alias("coverage")).withColumn("split", F.lit(split))
        sides = one if sides is None else sides.unionByName(one)
    return (
        members.join(sides, ["stage", "split", "class"])
        .groupBy("stage", "split", "source")
        .agg(F.countDistinct("row_id").alias("n_records"), F.avg("coverage").alias("mean_coverage"))
    )
