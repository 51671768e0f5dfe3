"""Evaluation aggregates over tables of scores: losses, perplexity, multiple choice, preference statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def perplexity(tokens: DataFrame, nll: Column, used: Column, by: list[str] = ()) -> DataFrame:
    """Mean loss, perplexity (exponent at most 20), bits and tokens over the used tokens; 0 tokens count as 1 in denominators."""
    n = F.sum(used.cast("bigint"))
    loss = F.sum(F.when(used, nll).otherwise(0.0)) / F.greatest(n, F.lit(1))
    out = tokens.groupBy(*by).agg(loss.alias("loss"), n.alias("n_tokens"))
    return out.withColumn("perplexity", F.exp(F.least(F.lit(20.0), F.col("loss")))).withColumn("bits_per_token", F.col("loss") / F.log(F.lit(2.0)))


def multiple_choice(scores: DataFrame) -> DataFrame:
    """Of (item_id, choice, score, length, answer, task) whether the best choice, raw and by length, is the answer; ties go to the first."""
    best = lambda c: F.max_by("choice", F.struct(c, -F.col("choice")))
    norm = F.col("score") / F.greatest(F.col("length"), F.lit(1))
    per = scores.groupBy("item_id", "task", "answer").agg(best(F.col("score")).alias("raw"), best(norm).alias("norm"))
    return per.withColumn("right_raw", (F.col("raw") == F.col("answer")).cast("int")).withColumn("right_norm", (F.col("norm") == F.col("answer")).cast("int"))


def accuracy(judged: DataFrame, by: list[str] = ()) -> DataFrame:
    return judged.groupBy(*by).agg(F.avg("right_raw").alias("acc_raw"), F.avg("right_norm").alias("acc_norm"), F.count("*").alias("n_items"))


def sequence_logprobs(tokens: DataFrame, key: str, logp: Column, used: Column) -> DataFrame:
    """Sum and mean of the log-probabilities of the used tokens; 0 where there are none."""
    total, n = F.sum(F.when(used, logp).otherwise(0.0)), F.sum(used.cast("bigint"))
    return tokens.groupBy(key).agg(total.alias("sum_logp"), (total / F.greatest(n, F.lit(1))).alias("mean_logp"), n.alias("n_tokens"))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)), without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def preference_loss(policy_c: Column, policy_r: Column, ref_c: Column, ref_r: Column, beta: float, smoothing: float = 0.0) -> Column:
    """-log sigmoid of the scaled margin of log-ratios, mixed with its opposite by ``smoothing``."""
    logit = beta * ((policy_c - ref_c) - (policy_r - ref_r))
    return (1 - smoothing) * softplus(-logit) + smoothing * softplus(logit)


def weighted_loss(rows: DataFrame, loss: Column, weight: Column, by: list[str] = ()) -> DataFrame:
    """Weighted mean with a denominator of at least 1."""
    return rows.groupBy(*by).agg((F.sum(loss * weight) / F.greatest(F.sum(weight), F.lit(1.0))).alias("loss"))


def regularised_loss(rows: DataFrame, loss: Column, log_z: Column, weight: Column, share: float, by: list[str] = ()) -> DataFrame:
    """Weighted mean loss plus ``share`` of the weighted mean of the squared log normaliser; both have one denominator of at least 1."""
    total = F.greatest(F.sum(weight), F.lit(1.0))
    return rows.groupBy(*by).agg((F.sum(loss * weight) / total + share * F.sum(weight * log_z * log_z) / total).alias("loss"))


def loss_by_position(tokens: DataFrame, position: str, loss: Column) -> DataFrame:
    """Mean loss of each position of a window."""
    return tokens.groupBy(position).agg(F.avg(loss).alias("loss"), F.count("*").alias("n_tokens"))


def loss_by_decile(tokens: DataFrame, token: str, loss: Column) -> DataFrame:
    """Mean loss of the tokens of each frequency decile; a decile without tokens has none."""
    counts = tokens.groupBy(token).agg(F.count("*").alias("_n"), F.sum(loss).alias("_loss"))
    placed = frequency_deciles(counts, token, "_n")
    return placed.groupBy("decile").agg((F.sum("_loss") / F.greatest(F.sum("_n"), F.lit(1))).alias("loss"), F.sum("_n").alias("n_tokens"))


def grouped_mean(rows: DataFrame, by: str, batch: str, value: Column, weighting: str = "batch") -> DataFrame:
    """Mean of a value by group: of batch means, of all tokens, or of examples."""
    if weighting == "batch":
        each = rows.groupBy(by, batch).agg(F.avg(value).alias("m"))
        return each.groupBy(by).agg(F.avg("m").alias("mean_value"))
    return rows.groupBy(by).agg(F.avg(value).alias("mean_value"))


def frequency_deciles(counts: DataFrame, token: str, n: str) -> DataFrame:
    """Adds the decile of each token's rank by falling count, of 0 to 9.  One row a token of a vocabulary."""
    rank = F.row_number().over(Window.orderBy(F.desc(n), token)) - 1
    return counts.withColumn("decile", F.least(F.lit(9), F.floor(rank * 10 / F.count("*").over(Window.partitionBy(F.lit(0))))))


def entropy(counts: DataFrame, n: str) -> DataFrame:
    """Entropy in nats of the distribution that the counts give."""
    total = counts.agg(F.sum(n)).first()[0] or 1
    p = F.col(n) / F.lit(float(total))
    return counts.agg(F.sum(-p * F.log(p)).alias("entropy"))


def log_window(rows: DataFrame, order: str, value: str, k: int, run: str | None = None) -> DataFrame:
    """Adds the mean of the last ``k`` values of a run."""
    w = (Window.partitionBy(run) if run else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(-(k - 1), 0)
    return rows.withColumn("window_mean", F.avg(value).over(w))


def nucleus(tokens: DataFrame, step: str, token: str, logit: str, temperature: float = 1.0, top_k: int = 0, min_p: float = 0.0, top_p: float = 1.0) -> DataFrame:
    """The tokens of each step that survive top-k (ties kept), min-p and top-p, with their renormalised chance."""
    w = Window.partitionBy(step)
    scaled = tokens.withColumn("_z", F.col(logit) / temperature)
    if top_k:
        scaled = scaled.withColumn("_rk", F.rank().over(w.orderBy(F.desc("_z")))).where(F.col("_rk") <= top_k).drop("_rk")
    soft = scaled.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w))).withColumn("_p", F.col("_e") / F.sum("_e").over(w))
    kept = soft.withColumn("_top", F.max("_p").over(w)).where(F.col("_p") >= min_p * F.col("_top"))
    order = w.orderBy(F.desc("_p"), token).rowsBetween(Window.unboundedPreceding, -1)
    cut = kept.withColumn("_before", F.coalesce(F.sum("_p").over(order), F.lit(0.0))).where((F.col("_before") <= top_p) | (F.col("_before") == 0))
    return cut.withColumn("chance", F.col("_p") / F.sum("_p").over(w)).select(step, token, "chance")


def mean_over_ranks(rows: DataFrame, rank: str, value: str) -> DataFrame:
    """Mean of the ranks' means, each rank with equal weight."""
    return rows.groupBy(rank).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean_value"))
