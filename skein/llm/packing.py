"""Packing of texts into containers of fixed capacity (problem 6).

Hierarchical packing by tiers.  A piece is routed to a tier by its length: tier 0
holds those above half the capacity, tier 1 those above a quarter, and so on.  Tiers
are packed from the longest pieces down: a container of a tier is opened by the
longest piece left in it and packed with pieces of the same tier while one fits; what
then is left of it is a gap, filled from the shorter tiers, by one or two pieces
exactly where there are such, else by the longest that fits, and so on.  Containers
are dealt to step groups of equal size so that their loads agree.

The plan is made on the histogram of lengths, at most ``capacity`` numbers whatever
the number of texts: a filling is used as often as the counts allow, which leaves of some
length fewer than it takes, so the fillings are a few for each length.  Texts find their
container by their seeded rank within their length, looked up in the sorted intervals
of the plan.

Defined results: lengths are those of the text itself, in the unit of the container
(``chars`` or ``bytes``; another unit raises an error); a text longer than the capacity
is cut into pieces of the capacity and one rest, no other is split; a null or empty text
has no container (null) and one piece of length 0; ties are ordered by the seeded hash and
the id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.ranks import ranked, seeded

SEED = 30
GROUP = 8  # containers of a step group
MAX_CAPACITY = 1 << 17
MAX_SPECS = 100  # container sizes
TRIES = 24  # longest pieces tried for a gap that three pieces would fill exactly
MAX_INTERVALS = 2_000_000  # of all plans, which travel to every task

UNITS = {"chars": F.length, "bytes": F.octet_length}


def tier(length: int, capacity: int) -> int:
    """0 for lengths above half the capacity, 1 above a quarter, and so on."""
    return max(0, (capacity // max(1, length)).bit_length() - 1) if length else 0


class _Stock:
    """Counts of the lengths left, and the longest one left up to a bound."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.count = np.zeros(capacity + 1, np.int64)
        for n, k in histogram.items():
            if 0 < n <= capacity:
                self.count[n] += k
        self.there = self.count > 0
        self.below = np.where(self.there, np.arange(capacity + 1), np.arange(capacity + 1) - 1).tolist()  # of a length used up: where to look next

    def longest(self, bound: int) -> int:
        """The longest length left that is at most ``bound``; 0 where there is none."""
        n, path = bound, []
        while n > 0 and not self.there[n]:
            path.append(n)
            n = self.below[n]
        for x in path:
            self.below[x] = n
        return max(0, n)

    def take(self, n: int, times: int = 1) -> None:
        self.count[n] -= times
        if not self.count[n]:
            self.there[n] = False
            self.below[n] = n - 1

    def give(self, n: int, times: int = 1) -> None:
        if not self.count[n]:
            self.there[n] = True
            self.below[n] = n
        self.count[n] += times

    def pair(self, total: int, most: int) -> int:
        """The longer of two lengths left that make up ``total``, neither above ``most``; 0 where there are none."""
        half = (total + 1) // 2
        top = min(total - 1, most)
        if top < half:
            return 0
        both = self.there[half : top + 1] & self.there[total - top : total - half + 1][::-1]
        at = np.flatnonzero(both)
        for k in at[::-1].tolist():
            n = half + k
            if 2 * n != total or self.count[n] > 1:
                return n
        return 0


def _filling(stock: _Stock, longest: int, capacity: int) -> list[int]:
    """The lengths of one container that ``longest`` opens, taken from the stock."""
    out, gap = [longest], capacity - longest
    stock.take(longest)
    floor = capacity >> (tier(longest, capacity) + 1)  # pieces of its own tier are longer than this

    def put(n: int) -> None:
        nonlocal gap
        stock.take(n)
        out.append(n)
        gap -= n

    while gap > floor:  # pack the tier
        n = gap if stock.there[gap] else stock.pair(gap, gap) or stock.longest(gap)
        if n <= floor:
            break
        put(n)
    while gap > 0:  # fill the gap from the shorter tiers
        top = min(gap, floor)
        if gap <= top and stock.there[gap]:
            put(gap)
        elif a := stock.pair(gap, top):
            put(a)
            put(gap)
        else:
            n = first = stock.longest(top)
            for _ in range(TRIES):  # a piece that leaves what two others make up exactly
                if not n or stock.pair(gap - n, min(n, gap - n)):
                    break
                n = stock.longest(n - 1)
            if not first:
                break
            put(n or first)
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a container, number of such containers), tier by tier from the longest pieces down."""
    stock = _Stock(histogram, capacity)
    patterns: list[tuple[tuple[int, ...], int]] = []
    while longest := stock.longest(capacity):
        filling = _filling(stock, longest, capacity)
        need = Counter(filling)
        times = 1 + min(int(stock.count[n]) // k for n, k in need.items())
        for n, k in need.items():
            if times > 1:
                stock.take(n, k * (times - 1))
        patterns.append((tuple(sorted(filling, reverse=True)), times))
    return patterns


def intervals(spec: str, capacity: int, patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple]:
    """Of each length and pattern the ranks it takes and the containers they go to.

    Rows: spec, length, first rank, one after the last, first container, items of
    this length in a container, offset of the first of them, containers of the spec,
    tier of the container (that of its longest piece).
    """
    total = sum(k for _, k in patterns)
    fullest = sorted(patterns, key=lambda p: (-sum(p[0]), p[0]))
    next_rank: Counter = Counter()
    rows, container = [], 0
    for lengths, times in fullest:
        offset = 0
        for n, per in sorted(Counter(lengths).items(), reverse=True):
            first = next_rank[n]
            rows.append((spec, n, first, first + per * times, container, per, offset, total, tier(lengths[0], capacity)))
            next_rank[n] = first + per * times
            offset += n * per
        container += times
    return rows


def step_group(container, n_containers):
    """Containers, fullest first, dealt to and fro over the groups."""
    groups = F.greatest(F.lit(1), F.ceil(n_containers / F.lit(GROUP))).cast("bigint")
    turn, place = F.floor(container / groups), F.pmod(container, groups)
    return F.when(turn % 2 == 0, place).otherwise(groups - 1 - place)


def pieces(docs: DataFrame, specs: DataFrame) -> DataFrame:
    """``(spec, capacity, doc_id, piece_no, start, length)``: a row for each piece of each text and spec."""
    kinds = specs.where("capacity > 0").select("spec", "unit", F.col("capacity").cast("int")).distinct().limit(MAX_SPECS + 1).collect()
    if len(kinds) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} container sizes")
    if unknown := sorted({str(r["unit"]) for r in kinds if r["unit"] not in UNITS}):
        raise ValueError(f"no such unit of container sizes: {', '.join(unknown)}")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = F.array(*[F.struct(F.lit(r["spec"]).alias("spec"), F.lit(r["capacity"]).alias("capacity"), UNITS[r["unit"]](text).cast("bigint").alias("n")) for r in kinds])
    if not kinds:
        each = F.array().cast("array<struct<spec:string,capacity:int,n:bigint>>")
    both = docs.select(F.col("doc_id").cast("bigint"), F.inline(each))
    last = F.greatest(F.ceil(F.col("n") / F.col("capacity")) - 1, F.lit(0))
    cut = both.select("spec", "capacity", "doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))).alias("piece_no"))
    start = F.col("piece_no") * F.col("capacity")
    return cut.select("spec", "capacity", "doc_id", F.col("piece_no").cast("int"), start.alias("start"), F.least(F.col("n") - start, F.col("capacity").cast("bigint")).cast("int").alias("length"))


def histograms(items: DataFrame) -> dict[tuple[str, int], dict[int, int]]:
    """Of each spec the counts of lengths (at most the capacities' sum of rows)."""
    table = items.where("length > 0").groupBy("spec", "capacity", "length").count().toArrow().to_pylist()
    by: dict[tuple[str, int], dict[int, int]] = {}
    for r in table:
        if r["capacity"] > MAX_CAPACITY:
            raise ValueError(f"capacity {r['capacity']} is above {MAX_CAPACITY}")
        by.setdefault((r["spec"], r["capacity"]), {})[r["length"]] = r["count"]
    return by


class Places:
    """The plans of all specs as sorted intervals of (length, rank)."""

    def __init__(self, by: dict[tuple[str, int], dict[int, int]]):
        self.of: dict[str, dict[str, np.ndarray]] = {}
        total = 0
        for (spec, capacity), histogram in sorted(by.items()):
            rows = sorted(r[1:] for r in intervals(spec, capacity, plan(histogram, capacity)))
            total += len(rows)
            if total > MAX_INTERVALS:
                raise ValueError(f"more than {MAX_INTERVALS} intervals")
            table = np.array(rows, np.int64).reshape(-1, 8)
            self.of[spec] = dict(zip(("length", "first", "after", "container", "per", "offset", "total", "tier"), table.T))

    def put(self, spec: str, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(container, place, containers of the spec, tier of the container) of pieces by their length and rank."""
        t = self.of[spec]
        begin, end = np.searchsorted(t["length"], length), np.searchsorted(t["length"], length, "right")
        low, high = begin.copy(), end  # the last interval of the length that begins at or before the rank
        while (wide := high - low > 1).any():
            middle = (low + high) // 2
            right = wide & (t["first"][np.minimum(middle, len(t["first"]) - 1)] <= rank)
            low, high = np.where(right, middle, low), np.where(wide & ~right, middle, high)
        nth = rank - t["first"][low]
        per = t["per"][low]
        return t["container"][low] + nth // per, t["offset"][low] + nth % per * length, t["total"][low], t["tier"][low]


def packed(docs: DataFrame, specs: DataFrame, seed: int = SEED) -> DataFrame:
    """``(spec, doc_id, piece_no, start, length, tier, container, container_tier, place, step_group)`` of every text and piece."""
    items = pieces(docs, specs)
    by = histograms(items)
    shared = docs.sparkSession.sparkContext.broadcast(Places(by))  # MAX_INTERVALS rows at most
    largest = max((k for h in by.values() for k in h.values()), default=0)
    held = items.where("length > 0").withColumn("h", seeded(seed, F.col("doc_id"), F.col("piece_no")))
    r = ranked(held, ["spec", "length"], "h", ["doc_id", "piece_no"], largest).select("spec", "doc_id", "piece_no", "start", "length", "capacity", "rank")
    fields = "spec string, doc_id bigint, piece_no int, start bigint, length int, capacity int, container bigint, place bigint, n_containers bigint, container_tier int"

    def run(batches):
        names = [x.split()[0] for x in fields.split(", ")]
        for batch in batches:
            spec, length, rank = np.array(batch.column(0).to_pylist(), object), batch.column(4).to_numpy().astype(np.int64), batch.column(6).to_numpy()
            out = np.zeros((4, len(spec)), np.int64)
            for one in sorted(set(spec.tolist())):
                at = np.flatnonzero(spec == one)
                out[:, at] = shared.value.put(one, length[at], rank[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], *(pa.array(x) for x in out[:3]), pa.array(out[3], pa.int32())], names=names)

    put = r.mapInArrow(run, fields)
    share = F.floor(F.log2(F.col("capacity") / F.col("length"))).cast("int")
    full = put.select("spec", "doc_id", "piece_no", "start", "length", share.alias("tier"), "container", "container_tier", "place", step_group(F.col("container"), F.col("n_containers")).alias("step_group"))
    none = F.lit(None)
    bare = items.where("length = 0").select("spec", "doc_id", "piece_no", "start", "length", none.cast("int").alias("tier"), none.cast("bigint").alias("container"), none.cast("int").alias("container_tier"), none.cast("bigint").alias("place"), none.cast("bigint").alias("step_group"))
    return full.unionByName(bare)


def summary(packs: DataFrame, specs: DataFrame) -> DataFrame:
    """Of each spec the containers, their unused share and the spread of step group loads."""
    per = packs.where("container is not null").groupBy("spec", "step_group", "container").agg(F.sum("length").alias("fill"), F.count("*").alias("items"))
    group = per.groupBy("spec", "step_group").agg(F.sum("fill").alias("load"), F.count("*").alias("containers"), F.sum("items").alias("items"))
    out = group.groupBy("spec").agg(
        F.sum("containers").alias("n_containers"), F.sum("items").alias("n_pieces"), F.sum("load").alias("n_chars"),
        F.count("*").alias("n_groups"), F.min("load").alias("least_load"), F.max("load").alias("largest_load"),
    )
    caps = specs.select("spec", "capacity")
    return out.join(caps, "spec").withColumn("unused_share", 1 - F.col("n_chars") / (F.col("n_containers") * F.col("capacity")))
