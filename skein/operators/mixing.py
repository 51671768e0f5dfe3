"""Interleaving, allocation, quotas and resampling of sources and tasks.

Orders are made by md5(seed:key), so they are the same in every run and engine.
Allocation works on one row per task (checked); everything else is windows over
ranges or small groups, see ``running``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import chance, seeded_hash
from skein.operators.running import Ordered, running

MAX_TASKS = 10_000


def interleave(docs: DataFrame, source: str, order: str, size: Column, weights: DataFrame | None = None) -> DataFrame:
    """Adds ``served``, by which the rows of all sources are read in turn.

    The virtual time of a row is what its source has given before it as a share of
    the source's weight (its total size unless ``weights`` has one); rows are read by
    (served, source).  Null sources are a source of their own; ties go by source.
    """
    sized = docs.withColumn("_size", F.coalesce(size.cast("double"), F.lit(0.0)))
    before = running(sized, [order], F.col("_size"), [source], "_before")
    total = sized.groupBy(source).agg(F.sum("_size").alias("_weight")) if weights is None else weights.select(source, F.col("weight").alias("_weight"))
    joined = before.join(total, before[source].eqNullSafe(total[source])).drop(total[source])
    return joined.withColumn("served", F.when(F.col("_weight") > 0, F.col("_before") / F.col("_weight")).otherwise(0.0)).drop("_size", "_before", "_weight")


def interleave_blocks(rows: DataFrame, source: str, order: str) -> DataFrame:
    """Adds ``slot``, (place + 1/2) / rows of the source, by which sources of any length are mixed evenly."""
    placed = running(rows, [order], None, [source], "_place")
    total = rows.groupBy(source).agg(F.count("*").alias("_n"))
    joined = placed.join(total, placed[source].eqNullSafe(total[source])).drop(total[source])
    return joined.withColumn("slot", (F.col("_place") + 0.5) / F.col("_n")).drop("_place", "_n")


def round_robin(files: DataFrame, subset: str, name: str) -> DataFrame:
    """Adds ``cycle`` and ``subset_no``: one file of each subset a cycle, subsets by first appearance."""
    cycle = F.row_number().over(Window.partitionBy(subset).orderBy(name)) - 1
    first = files.groupBy(subset).agg(F.min(name).alias("_first"))
    ranked = first.withColumn("subset_no", F.row_number().over(Window.orderBy("_first")) - 1).drop("_first")  # one row a subset
    return files.withColumn("cycle", cycle).join(ranked, subset)


def water_fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, int]:
    """Draws of each task: shares of the total by weight, tasks beyond their cap pinned to it and the rest shared again."""
    if len(weights) > MAX_TASKS:
        raise ValueError(f"more than {MAX_TASKS} tasks")
    given: dict[str, int] = {}
    rest = total
    while open_ := [t for t in weights if t not in given]:
        norm = sum(weights[t] for t in open_)
        if rest <= 0 or norm <= 0:
            return given | dict.fromkeys(open_, 0)
        over = [t for t in open_ if rest * weights[t] / norm > caps[t]]
        if not over:
            return given | {t: int(rest * weights[t] / norm) for t in open_}
        for t in over:
            given[t] = int(caps[t])
        rest -= sum(given[t] for t in over)
    return given


def resample(rows: DataFrame, task: str, key: str, draws: dict[str, int], seed: int) -> DataFrame:
    """Each row as often as its task's draws need: whole copies, and one more of the first rows by hash.

    Adds ``copy`` (from 1).  Tasks without draws are left out.
    """
    plan = rows.sparkSession.createDataFrame(sorted(draws.items()), f"{task} string, _draws bigint")
    hashed = rows.withColumn("_h", seeded_hash(seed, F.col(key)))
    placed = running(hashed, ["_h", key], None, [task], "_place")
    pools = rows.groupBy(task).agg(F.count("*").alias("_pool"))
    sized = placed.join(pools.join(plan, task), task)
    copies = F.floor(F.col("_draws") / F.col("_pool")) + (F.col("_place") < F.col("_draws") % F.col("_pool")).cast("int")
    used = sized.withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return used.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))


def cap_ratio(rows: DataFrame, capped: Column, key: str, seed: int, share: float) -> DataFrame:
    """Keeps rows of the capped class only while they are at most ``share`` of what is kept, in hashed order.

    With A others before it, the t-th capped row is admitted exactly if the running
    total u_t = t + min(0, min over s <= t of floor(A_s * c) + 1 - s) rises, where
    c = share / (1 - share).  Sums, the minimum and the maximum are folds of one order.
    """
    c = share / (1 - share)
    is_capped = F.col("_un") == 1
    marked = rows.withColumn("_h", seeded_hash(seed, F.col(key))).withColumn("_key", F.col(key)).withColumn("_un", F.coalesce(capped.cast("int"), F.lit(0)))
    o = Ordered(marked, ["_h", "_key"]).add(inclusive=True, _a=(F.sum, 1 - F.col("_un")), _t=(F.sum, F.col("_un")))
    o.with_columns(_low=F.when(is_capped, F.floor(F.col("_a") * c) + 1 - F.col("_t"))).add(inclusive=True, _m=(F.min, F.col("_low")))
    o.with_columns(_u=F.when(is_capped, F.col("_t") + F.least(F.lit(0), F.col("_m")))).add(_p=(F.max, F.col("_u")))
    return o.df.where(~is_capped | (F.col("_u") > F.coalesce("_p", F.lit(0)))).select(*rows.columns)


def cap_heads(rows: DataFrame, task: str, head: str, key: str, caps: dict[str, float], seed: int) -> DataFrame:
    """At most max(1, floor(cap * task total)) rows of a head in the tasks that have a cap; empty heads stay."""
    share = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col(task)] if caps else F.lit(None)
    hashed = rows.withColumn("_h", seeded_hash(seed, F.col(key)))
    placed = running(hashed, ["_h", key], None, [task, head], "_place")
    total = rows.groupBy(task).agg(F.count("*").alias("_n"))
    sized = placed.join(total, placed[task].eqNullSafe(total[task])).drop(total[task])
    most = F.greatest(F.lit(1), F.floor(F.col("_n") * share + 1e-9))
    return sized.where(share.isNull() | (F.coalesce(F.col(head), F.lit("")) == "") | (F.col("_place") < most)).select(*rows.columns)


def donate(train: DataFrame, val: DataFrame, key: str, seed: int, per_task: int, divisor: str = "task") -> DataFrame:
    """The train rows that become hold-out rows, of (task, source) pairs that have none.

    A pair gives min(max(1, V // pairs), floor(n / 10)) of its rows in hashed order;
    pairs are counted within the task, or over all with ``divisor='all'``.
    """
    have = val.select("task", "source").distinct()
    pairs = train.groupBy("task", "source").agg(F.count("*").alias("_n"))
    if divisor == "task":
        sized = pairs.join(pairs.groupBy("task").agg(F.count("*").alias("_pairs")), "task")
    else:
        sized = pairs.withColumn("_pairs", F.lit(pairs.count()))
    quota = sized.join(have, ["task", "source"], "left_anti").withColumn("_q", F.least(F.greatest(F.lit(1), F.floor(F.lit(per_task) / F.col("_pairs"))), F.floor(F.col("_n") * 0.1)))
    placed = running(train.withColumn("_h", seeded_hash(seed, F.col(key))), ["_h", key], None, ["task", "source"], "_place")
    return placed.join(quota, ["task", "source"]).where("_place < _q").select(*train.columns)


def trim(val: DataFrame, key: str, seed: int, per_task: int) -> DataFrame:
    """Adds ``kept``: at most max(1, V // sources) rows of a source and V of a task, in hashed order; the rest return to train."""
    sources = val.groupBy("task").agg(F.count_distinct("source").alias("_sources"))
    placed = running(val.withColumn("_h", seeded_hash(seed, F.col(key))), ["_h", key], None, ["task", "source"], "_place")
    first = placed.join(sources, "task").withColumn("_in", F.col("_place") < F.greatest(F.lit(1), F.floor(F.lit(per_task) / F.col("_sources"))))
    second = running(first, ["_h", key], F.col("_in").cast("int"), ["task"], "_rank")
    return second.withColumn("kept", F.col("_in") & (F.col("_rank") < per_task)).select(*val.columns, "kept")


def sample_rows(rows: DataFrame, group: str, key: str, seed: int, most: int | None = None, share: float | None = None) -> DataFrame:
    """At most ``most`` rows of each group, or max(1, floor(share * n)) of them, the first by hash."""
    placed = running(rows.withColumn("_h", seeded_hash(seed, F.col(key))), ["_h", key], None, [group], "_place")
    if share is None:
        return placed.where(F.col("_place") < most).select(*rows.columns)
    n = rows.groupBy(group).agg(F.count("*").alias("_n"))
    sized = placed.join(n, placed[group].eqNullSafe(n[group])).drop(n[group])
    return sized.where(F.col("_place") < F.greatest(F.lit(1), F.floor(F.col("_n") * share))).select(*rows.columns)


def within_budget(rows: DataFrame, order: list[str], size: Column, budget: float, group: list[str] = (), crossing: bool = True) -> DataFrame:
    """The rows, in order, until the budget is reached; with ``crossing`` the row that reaches it, too."""
    placed = running(rows.withColumn("_s", F.coalesce(size.cast("double"), F.lit(0.0))), order, F.col("_s"), group, "_before")
    limit = F.col("_before") < budget if crossing else F.col("_before") + F.col("_s") <= budget
    return placed.where(limit).select(*rows.columns)


def select_files(files: DataFrame, weights: dict[str, float], budget: float) -> DataFrame:
    """The files of each source, by name, that fit its share of the budget: a prefix, of at least one file.

    ``files`` has source, name and bytes.
    """
    norm = sum(weights.values())
    share = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, budget * w / norm)])[F.col("source")]
    w = Window.partitionBy("source").orderBy("name")
    run = files.where(share.isNotNull()).withColumn("_rn", F.row_number().over(w)).withColumn("_upto", F.sum("bytes").over(w))
    return run.where((F.col("_rn") == 1) | (F.col("_upto") <= share)).select(*files.columns)


def replay_slots(slots: DataFrame, slot: str, share: float, seed: int) -> DataFrame:
    """Adds ``pool``: ``replay`` with the given chance, by the slot's hash, else ``fresh``."""
    return slots.withColumn("pool", F.when(chance(seed, F.col(slot)) < share, F.lit("replay")).otherwise(F.lit("fresh")))
