"""Queries that aggregate scores.  Scores are made from hashes of ids, so that SQL can make the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.text import pick_bits
from skein.operators import evaluate as E
from skein.operators import tokens as T
from skein.plans.base import query
from skein.plans.tokens import TURNS, _turns

NLL = "-ln((('0x' || substr(md5('{seed}:' || {key}), 1, 8))::bigint % 1000 + 1) / 1001.0)"


def nll(seed, *keys):
    return -F.log((pick_bits(seed, *keys) % 1000 + 1) / 1001.0)


def nll_sql(seed: str, key: str) -> str:
    return NLL.format(seed=seed, key=key)


@query(f"""
select l_linenumber as task, sum(case when l_returnflag <> 'N' then x else 0 end) / greatest(sum((l_returnflag <> 'N')::int), 1) as loss, sum((l_returnflag <> 'N')::int)::bigint as n_tokens,
exp(least(20, sum(case when l_returnflag <> 'N' then x else 0 end) / greatest(sum((l_returnflag <> 'N')::int), 1))) as perplexity,
sum(case when l_returnflag <> 'N' then x else 0 end) / greatest(sum((l_returnflag <> 'N')::int), 1) / ln(2) as bits_per_token
from (select *, {nll_sql('1', "l_orderkey || ':' || l_linenumber")} as x from lineitem) group by 1""")
def g13_perplexity(t):
    """Loss, perplexity and bits per token of each group; line items stand for tokens."""
    rows = t("lineitem").select(F.col("l_linenumber").alias("task"), nll(1, F.col("l_orderkey"), F.col("l_linenumber")).alias("x"), (F.col("l_returnflag") != "N").alias("used"))
    return E.perplexity(rows, F.col("x"), F.col("used"), ["task"])


CHOICES = f"""
c as (select item_id, coalesce(task, '') as task, answer, i - 1 as choice, -({nll_sql('2', "item_id || ':' || (i - 1)")}) as score, length(choices[i]) as len from eval_items, unnest(range(1, len(choices) + 1)) as r(i) where answer is not null),
j as (select item_id, task, answer, first(choice order by score desc, choice) as raw, first(choice order by score / greatest(len, 1) desc, choice) as norm from c group by all)"""


def _judged(t):
    items = t("eval_items").where("answer is not null").select("item_id", F.coalesce("task", F.lit("")).alias("task"), F.col("answer").cast("int").alias("answer"), F.posexplode("choices").alias("choice", "text"))
    scores = items.withColumn("score", -nll(2, F.col("item_id"), F.col("choice"))).withColumn("length", F.length("text"))
    return E.multiple_choice(scores)


@query(f"with {CHOICES} select task, avg((raw = answer)::int) as acc_raw, avg((norm = answer)::int) as acc_norm, count(*) as n_items from j group by task")
def g14_multiple_choice(t):
    """Accuracy by task, by raw and by length-normalised score."""
    return E.accuracy(_judged(t), ["task"])


PAIRS = f"""
p as (select distinct row_id, coalesce(source, '') as source, -50 * ({nll_sql('pc', 'row_id')}) as pc, -50 * ({nll_sql('pr', 'row_id')}) as pr, -50 * ({nll_sql('rc', 'row_id')}) as rc, -50 * ({nll_sql('rr', 'row_id')}) as rr from dpo_train),
m as (select *, 0.1 * ((pc - rc) - (pr - rr)) as z from p)"""


@query(f"""
with {PAIRS} select source, avg(0.9 * (greatest(-z, 0) + ln(1 + exp(-abs(z)))) + 0.1 * (greatest(z, 0) + ln(1 + exp(-abs(z))))) as loss, avg((z > 0)::int) as accuracy, avg(z) as margin,
avg(0.1 * (pc - rc)) as chosen_reward, avg(0.1 * (pr - rr)) as rejected_reward from m group by source""")
def g15_preference_loss(t):
    """Preference loss, reward accuracy and margin of each source."""
    rows = t("dpo_train").select("row_id", F.coalesce("source", F.lit("")).alias("source")).distinct()
    lp = {k: -50 * nll(k, F.col("row_id")) for k in ("pc", "pr", "rc", "rr")}
    s = rows.withColumns(lp)
    z = 0.1 * ((F.col("pc") - F.col("rc")) - (F.col("pr") - F.col("rr")))
    loss = E.preference_loss(F.col("pc"), F.col("pr"), F.col("rc"), F.col("rr"), 0.1, 0.1)
    return s.groupBy("source").agg(
        F.avg(loss).alias("loss"), F.avg((z > 0).cast("int")).alias("accuracy"), F.avg(z).alias("margin"),
        F.avg(0.1 * (F.col("pc") - F.col("rc"))).alias("chosen_reward"), F.avg(0.1 * (F.col("pr") - F.col("rr"))).alias("rejected_reward"),
    )


@query(f"""
select l_orderkey as seq, sum(case when l_returnflag <> 'N' then -x else 0 end) as sum_logp, sum(case when l_returnflag <> 'N' then -x else 0 end) / greatest(sum((l_returnflag <> 'N')::int), 1) as mean_logp, sum((l_returnflag <> 'N')::int)::bigint as n_tokens
from (select *, {nll_sql('1', "l_orderkey || ':' || l_linenumber")} as x from lineitem) group by 1""")
def g16_sequence_logprobs(t):
    """Sum and mean log-probability of each sequence."""
    rows = t("lineitem").select(F.col("l_orderkey").alias("seq"), (-nll(1, F.col("l_orderkey"), F.col("l_linenumber"))).alias("lp"), (F.col("l_returnflag") != "N").alias("used"))
    return E.sequence_logprobs(rows, "seq", F.col("lp"), F.col("used"))


@query("select l_linestatus as task, sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1) as loss from lineitem group by 1")
def g17_weighted_loss(t):
    """Weighted mean loss."""
    return E.weighted_loss(t("lineitem").withColumnRenamed("l_linestatus", "task"), F.col("l_discount"), F.col("l_quantity"), ["task"])


@query("select l_linestatus as task, avg(m) as mean_value from (select l_linestatus, l_suppkey, avg(l_discount) as m from lineitem group by all) group by 1")
def g18_task_loss(t):
    """Mean of batch means of each task."""
    return E.grouped_mean(t("lineitem").withColumnRenamed("l_linestatus", "task"), "task", "l_suppkey", F.col("l_discount"))


@query("""
with c as (select l_partkey as token, count(*) as n from lineitem group by 1) select token, n, least(9, (row_number() over (order by n desc, token) - 1) * 10 // count(*) over ())::int as decile from c""")
def g19_deciles(t):
    """Frequency decile of each token; parts stand for tokens."""
    counts = t("lineitem").groupBy(F.col("l_partkey").alias("token")).agg(F.count("*").alias("n"))
    return E.frequency_deciles(counts, "token", "n").withColumn("decile", F.col("decile").cast("int"))


@query("with c as (select l_partkey, count(*) as n from lineitem group by 1), p as (select n / sum(n) over () as p from c) select sum(-p * ln(p)) as entropy from p")
def g19_entropy(t):
    """Unigram entropy."""
    return E.entropy(t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), "n")


@query("select user_id, event_id, avg(value) over (partition by user_id order by event_id rows between 9 preceding and current row) as window_mean from events")
def g20_log_window(t):
    """Mean of the last ten values of each run."""
    return E.log_window(t("events"), "event_id", "value", 10, "user_id").select("user_id", "event_id", "window_mean")


@query("select l_linestatus as task, sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1) + 0.001 * sum(l_quantity * l_tax * l_tax) / greatest(sum(l_quantity), 1) as loss from lineitem group by 1")
def g17_regularised_loss(t):
    """Weighted mean loss with a share of the squared log normaliser; taxes stand for it."""
    return E.regularised_loss(t("lineitem").withColumnRenamed("l_linestatus", "task"), F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), 0.001, ["task"])


@query(f"select l_linenumber as position, avg(x) as loss, count(*) as n_tokens from (select *, {nll_sql('1', "l_orderkey || ':' || l_linenumber")} as x from lineitem) group by 1")
def g19_loss_by_position(t):
    """Mean loss of each position; line items stand for tokens."""
    rows = t("lineitem").select(F.col("l_linenumber").alias("position"), nll(1, F.col("l_orderkey"), F.col("l_linenumber")).alias("x"))
    return E.loss_by_position(rows, "position", F.col("x"))


@query(f"""
with k as (select l_partkey as token, {nll_sql('1', "l_orderkey || ':' || l_linenumber")} as x from lineitem), c as (select token, count(*) as n, sum(x) as s from k group by 1),
d as (select *, least(9, (row_number() over (order by n desc, token) - 1) * 10 // count(*) over ())::bigint as decile from c)
select decile, sum(s) / greatest(sum(n), 1) as loss, sum(n)::bigint as n_tokens from d group by 1""")
def g19_loss_by_decile(t):
    """Mean loss by frequency decile; parts stand for tokens."""
    rows = t("lineitem").select(F.col("l_partkey").alias("token"), nll(1, F.col("l_orderkey"), F.col("l_linenumber")).alias("x"))
    return E.loss_by_decile(rows, "token", F.col("x"))


@query(f"""
with {TURNS}, k as (select row_id, 1 + sum(1 + n + (role = 'assistant')::int) as whole, max(case when i = last then 2 + n end) as reply, max(case when i = last - 1 and role = 'user' then n end) as asked
  from (select *, max(i) over (partition by row_id) as last from z) group by row_id),
f as (select row_id, whole <= 256 or coalesce(1 + 1 + asked + reply <= 256 or 256 - (2 + reply) >= 48, false) as fits from k),
g as (select coalesce(d.task, '') as task, count(*) filter (where not fits) as dropped, count(*) as n from f join (select distinct row_id, task from dpo_train) d using (row_id) group by 1)
select task, n - dropped as kept, dropped, 100.0 * dropped / greatest(1, n) as lost_percent from g where dropped > 0""")
def g25_drop_rates(t):
    """Conversations of each task that cannot be rendered into 256 tokens."""
    turns = _turns(t)
    kept = T.rendered(turns, "row_id", "turns", 256).select("row_id", F.lit(1).alias("kept"))
    task = t("dpo_train").select("row_id", F.coalesce("task", F.lit("")).alias("task")).dropDuplicates(["row_id"])
    g = turns.select("row_id").join(task, "row_id").join(kept, "row_id", "left").groupBy("task").agg(F.count_if(F.col("kept").isNull()).alias("dropped"), F.count("*").alias("n"))
    return g.where("dropped > 0").select("task", (F.col("n") - F.col("dropped")).alias("kept"), "dropped", (100.0 * F.col("dropped") / F.greatest(F.lit(1), F.col("n"))).alias("lost_percent"))


@query("""
with s as (select l_orderkey as step, l_linenumber as token, l_quantity / 10.0 as z from lineitem),
k as (select * from (select *, rank() over (partition by step order by z desc) as rk from s) where rk <= 3),
p as (select *, exp(z - max(z) over (partition by step)) / sum(exp(z - mz)) over (partition by step) as p from (select *, max(z) over (partition by step) as mz from k)),
m as (select * from (select *, max(p) over (partition by step) as top from p) where p >= 0.05 * top),
c as (select *, coalesce(sum(p) over (partition by step order by p desc, token rows between unbounded preceding and 1 preceding), 0) as b from m)
select step, token, p / sum(p) over (partition by step) as chance from c where b <= 0.9 or b = 0""")
def i5_nucleus(t):
    """Tokens that survive top-k, min-p and top-p in each step; line items stand for tokens."""
    rows = t("lineitem").select(F.col("l_orderkey").alias("step"), F.col("l_linenumber").alias("token"), (F.col("l_quantity") / 10.0).alias("z"))
    return E.nucleus(rows, "step", "token", "z", top_k=3, min_p=0.05, top_p=0.9)


@query("select avg(m) as mean_value from (select l_suppkey, avg(l_discount) as m from lineitem group by 1)")
def k7_rank_mean(t):
    """Mean over ranks of equal weight; suppliers stand for ranks."""
    return E.mean_over_ranks(t("lineitem"), "l_suppkey", "l_discount")


@query(f"""
with {PAIRS}, b as (select row_id % 16 as batch, avg(greatest(-z, 0) + ln(1 + exp(-abs(z)))) as dpo, avg(-pc / 50) as nll from m group by 1)
select avg(dpo + 0.2 * nll) as total_loss, avg(dpo) as preference_loss from b""")
def g24_total_loss(t):
    """Preference loss with a share of the chosen replies' own loss, as a mean of batch means."""
    rows = t("dpo_train").select("row_id", F.coalesce("source", F.lit("")).alias("source")).distinct()
    s = rows.withColumns({k: -50 * nll(k, F.col("row_id")) for k in ("pc", "pr", "rc", "rr")})
    loss = E.preference_loss(F.col("pc"), F.col("pr"), F.col("rc"), F.col("rr"), 0.1)
    b = s.groupBy((F.col("row_id") % 16).alias("batch")).agg(F.avg(loss).alias("dpo"), F.avg(-F.col("pc") / 50).alias("nll"))
    return b.agg(F.avg(F.col("dpo") + 0.2 * F.col("nll")).alias("total_loss"), F.avg("dpo").alias("preference_loss"))
