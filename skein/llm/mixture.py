"""Mixing tasks to target shares of the total size (problem 5).

Size is counted in white-space tokens of the contents.  A histogram of exact
lengths of each task goes to the driver (its size is checked), where the budget
of each task is fitted: whole passes first, then the same fraction of every
length, rounded by largest remainders until less than ``HELD`` of the longest
length is left, then a bounded knapsack over the lengths left for these last tokens.
The documents of a length are taken by a seeded rank, spread over partitions.

Defined results: tasks are compared in lower case without outer blanks; a record
without a task, of a task that has no target, or without tokens is not used; a
task that lacks rows leaves its weight to the others; ``max_repeats`` null is no
bound; repeated deliveries of a record count once; an empty table gives an empty
mixture.  The total is, unless given, the largest at which every task that has
rows meets its share within its repeats, at most one pass over all their rows
where nothing bounds it.  With a total given, what a task cannot give within its
repeats is shared by the others according to their weights.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.ranks import ranked, seeded
from skein.operators.workspace import shared_folder

SEED = 20
MAX_HISTOGRAM = 2_000_000  # (task, length) pairs that the driver may hold
MAX_TARGETS = 10_000
HELD = 8  # times the longest length that the knapsack is left to fill

_TURNS = "array<struct<role:string,content:string,from:string,value:string>>"


@dataclass
class Fit:
    """How one task meets its budget: each record ``passes`` times, and ``extra[length]`` records once more."""

    task: str
    weight: float
    target: int
    available: int
    passes: int
    extra: dict[int, int]

    @property
    def used(self) -> int:
        return self.passes * self.available + sum(n * k for n, k in self.extra.items())


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the largest that the budget holds.

    Reachable sums are bits of a whole number; counts enter by binary splitting.
    """
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], budget // length) if length else 0
        size = 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            size *= 2
        if reach >> budget & 1:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            out[length] = out.get(length, 0) + take
            total -= length * take
    return out


def fit_task(task: str, weight: float, counts: dict[int, int], target: int, repeats: int | None) -> Fit:
    available = sum(n * k for n, k in counts.items())
    if not available:
        return Fit(task, weight, target, 0, 0, {})
    passes, rest = divmod(target, available)
    if repeats is not None and passes >= repeats:
        return Fit(task, weight, target, available, repeats, {})
    extra = {n: k * rest // available for n, k in counts.items()}
    rest -= sum(n * k for n, k in extra.items())
    held = HELD * max(counts)
    for n in sorted(counts, key=lambda n: (-(counts[n] * (target - passes * available) % available), -n)):
        if rest - n < held:
            break
        if extra[n] < counts[n]:
            extra[n] += 1
            rest -= n
    for n, k in knapsack({n: counts[n] - extra[n] for n in counts if counts[n] > extra[n]}, rest).items():
        extra[n] += k
    return Fit(task, weight, target, available, passes, {n: k for n, k in extra.items() if k})


def largest_total(available: dict[str, int], weights: dict[str, float], repeats: dict[str, int | None]) -> int:
    """The largest total at which every task with rows meets its share."""
    have = {t: w for t, w in weights.items() if available.get(t) and w > 0}
    norm = sum(have.values())
    bounds = [available[t] * repeats[t] / (w / norm) for t, w in have.items() if repeats[t] is not None]
    return int(min(bounds)) if bounds else sum(available[t] for t in have)


def fit(counts: dict[str, dict[int, int]], targets: list[tuple[str, float, int | None]], total: int | None = None) -> list[Fit]:
    available = {t: sum(n * k for n, k in c.items()) for t, c in counts.items()}
    weights = {t: w for t, w, _ in targets}
    repeats = {t: r for t, _, r in targets}
    if total is None:
        total = largest_total(available, weights, repeats)
    goals = budgets(available, weights, repeats, total)
    return [fit_task(t, w, counts.get(t, {}), goals.get(t, 0), r) for t, w, r in targets]


def budgets(available: dict[str, int], weights: dict[str, float], repeats: dict[str, int | None], total: int) -> dict[str, int]:
    """Tokens of each task: shares of the total, tasks that cannot give theirs at their most and the rest shared again."""
    most = {t: None if repeats[t] is None else repeats[t] * available[t] for t, w in weights.items() if available.get(t) and w > 0}
    out: dict[str, int] = {}
    rest = total
    while open_ := [t for t in most if t not in out]:
        norm = sum(weights[t] for t in open_)
        over = [t for t in open_ if most[t] is not None and rest * weights[t] / norm > most[t] + 0.5]
        if not over:
            return out | {t: int(round(rest * weights[t] / norm)) for t in open_}
        out |= {t: most[t] for t in over}
        rest -= sum(most[t] for t in over)
    return out


def sized(table: DataFrame, column: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """``(row_id, task, n_tokens)`` of each record, once; ``extra`` names columns of plain text that count too."""
    turns = F.from_json(F.col(column).cast("string"), _TURNS)
    text = F.array_join(F.transform(turns, lambda t: F.coalesce(t["content"], t["value"], F.lit(""))), " ")
    whole = F.trim(F.regexp_replace(F.concat_ws(" ", F.coalesce(text, F.lit("")), *[F.col(c).cast("string") for c in extra]), r"\s+", " "))
    n = F.when(whole == "", 0).otherwise(F.length(whole) - F.length(F.replace(whole, F.lit(" "), F.lit(""))) + 1)
    task = F.lower(F.trim(F.regexp_replace(F.col("task").cast("string"), r"(?U)^\s+|\s+$", "")))
    rows = table.select(F.col("row_id").cast("bigint"), F.when(task != "", task).alias("task"), n.cast("int").alias("n_tokens"))
    return rows.dropDuplicates(["row_id"])


def stored(rows: DataFrame) -> DataFrame:
    """The sizes written once to the shared folder, so that histogram and choice need not read the contents again."""
    path = f"{shared_folder(rows.sparkSession)}/sizes-{uuid.uuid4().hex}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fits(rows: DataFrame, targets: DataFrame, stage: str, total: int | None = None) -> tuple[list[Fit], int]:
    """(how each task meets its budget, records of the most frequent length)."""
    goals = [
        (r["task"], float(r["weight"]), None if r["max_repeats"] is None else int(r["max_repeats"]))
        for r in targets.where((F.col("stage") == stage) & F.col("task").isNotNull() & F.col("weight").isNotNull())
        .select(F.lower(F.trim("task")).alias("task"), "weight", "max_repeats")
        .limit(MAX_TARGETS + 1)
        .collect()
    ]
    if len(goals) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    counts: dict[str, dict[int, int]] = {}
    wanted = rows.where(F.col("task").isin([g[0] for g in goals])).where("n_tokens > 0")
    table = wanted.groupBy("task", "n_tokens").count().limit(MAX_HISTOGRAM + 1).toArrow().to_pylist()
    if len(table) > MAX_HISTOGRAM:
        raise ValueError(f"more than {MAX_HISTOGRAM} lengths of tasks")
    for r in table:
        counts.setdefault(r["task"], {})[r["n_tokens"]] = r["count"]
    return fit(counts, sorted(goals), total), max((k for c in counts.values() for k in c.values()), default=0)


def mixture(rows: DataFrame, targets: DataFrame, stage: str, total: int | None = None, seed: int = SEED) -> DataFrame:
    """``(stage, task, row_id, n_tokens, copies)`` of every record used."""
    spark = rows.sparkSession
    plan, largest = fits(rows, targets, stage, total)
    passes = [(f.task, f.passes) for f in plan if f.available]
    extra = [(f.task, n, k) for f in plan for n, k in f.extra.items()]
    p = spark.createDataFrame(passes, "task string, passes int")
    e = spark.createDataFrame(extra, "task string, n_tokens int, extra bigint")
    used = rows.where("n_tokens > 0").join(F.broadcast(p), "task")  # one row a task
    order = used.withColumn("h", seeded(seed, F.col("row_id")))
    r = ranked(order, ["task", "n_tokens"], "h", ["row_id"], largest)
    copies = F.col("passes") + (F.col("rank") < F.coalesce("extra", F.lit(0))).cast("int")
    out = r.join(e, ["task", "n_tokens"], "left").withColumn("copies", copies).where("copies > 0")
    return out.select(F.lit(stage).alias("stage"), "task", "row_id", "n_tokens", F.col("copies").cast("int"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """The actual share of each target, from the mixture itself; a target that lacks rows has share 0."""
    per = mixed.groupBy("stage", "task").agg(
        F.sum(F.col("n_tokens").cast("bigint") * F.col("copies")).alias("used_tokens"),
        F.sum("copies").alias("n_used"),
        F.count("*").alias("n_records"),
        F.max("copies").alias("most_copies"),
    )
    goals = targets.select("stage", F.lower(F.trim("task")).alias("task"), "weight", "max_repeats")
    all_ = goals.join(per, ["stage", "task"], "left")
    total = mixed.groupBy("stage").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("copies")).alias("total"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("used_tokens", "n_used", "n_records", "most_copies")]
    return all_.join(total, "stage", "left").select(
        "stage", "task", "weight", "max_repeats", *zero, (F.coalesce("used_tokens", F.lit(0)) / F.col("total")).alias("actual_share")
    )
