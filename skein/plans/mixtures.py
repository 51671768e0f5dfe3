"""Queries that interleave, mix, cap, hold out and sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.chunking import with_similar
from skein.operators import mixing as M
from skein.operators import normalise as N
from skein.plans.base import query
from skein.plans.corpus import FOREIGN, strip_sql

TASKS = "(select *, lower(trim(task)) as t from (select distinct row_id, source, task, origin_file, messages from sft_train))"


def once(table, *columns):
    """Each record of a chat table once, with its task cleaned."""
    rows = table.select("row_id", "source", "task", "origin_file", *columns).dropDuplicates(["row_id"])
    return rows.withColumn("task", F.lower(F.trim("task")))


@query("""
with d as (select doc_id, source, coalesce(n_chars, 0)::double as n from documents),
p as (select *, coalesce(sum(n) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) as b, sum(n) over (partition by source) as w from d)
select doc_id, source, case when w > 0 then b / w else 0 end as served from p""")
def e1_interleave(t):
    """Size-weighted virtual-time order of the documents of all sources."""
    docs = t("documents").select("doc_id", "source", "n_chars")
    return M.interleave(docs, "source", "doc_id", F.col("n_chars")).select("doc_id", "source", "served")


@query("select doc_id, source, (row_number() over (partition by source order by doc_id) - 0.5) / count(*) over (partition by source) as slot from documents")
def e2_interleave_blocks(t):
    """Block order by count: sources of any length mixed evenly."""
    return M.interleave_blocks(t("documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "source", "slot")


@query("""
with f as (select distinct source, origin_file from sft_train where source is not null and origin_file is not null),
s as (select source, row_number() over (order by min(origin_file)) - 1 as subset_no from f group by source)
select source, origin_file, row_number() over (partition by source order by origin_file) - 1 as cycle, subset_no from f join s using (source)""")
def e3_round_robin(t):
    """One file of each subset a cycle."""
    files = t("sft_train").where("source is not null and origin_file is not null").select("source", "origin_file").distinct()
    return M.round_robin(files, "source", "origin_file").select("source", "origin_file", "cycle", "subset_no")


@query("select t.row_id, t.task, t.source from dpo_train t where not exists (select 1 from dpo_val v where v.task = t.task and v.source = t.source) and t.task is not null and t.source is not null")
def e5_without_validation(t):
    """Train rows of (task, source) pairs without a hold-out row."""
    have = t("dpo_val").select("task", "source").distinct()
    return t("dpo_train").where("task is not null and source is not null").join(have, ["task", "source"], "left_anti").select("row_id", "task", "source")


@query("""
with p(grp, prompt) as (values (1, 'hi'), (1, 'hello'), (2, 'thanks')), r(grp, reply) as (values (1, 'Hello!'), (1, 'Hi, what shall we do?'), (2, 'Gladly.'))
select grp, prompt, reply from p join r using (grp)""")
def e7_small_talk(t):
    """Each prompt of a small-talk group with each reply of the group: fixed, small pools joined on the group."""
    spark = t("region").sparkSession
    prompts = spark.createDataFrame([(1, "hi"), (1, "hello"), (2, "thanks")], "grp int, prompt string")
    replies = spark.createDataFrame([(1, "Hello!"), (1, "Hi, what shall we do?"), (2, "Gladly.")], "grp int, reply string")
    return prompts.join(replies, "grp").select("grp", "prompt", "reply")


@query("""
select event_id, case when ('0x' || substr(md5('7:' || event_id), 1, 8))::bigint / 4294967296.0 < 0.25 then 'replay' else 'fresh' end as pool from events""")
def e10_replay(t):
    """Slots that replay an older pool, with chance 1/4."""
    return M.replay_slots(t("events").select("event_id"), "event_id", 0.25, 7)


@query("""
with f as (select source, origin_file as name, sum(length(messages))::bigint as bytes from sft_train where source in ('dolly', 'xsum', 'coedit') and origin_file is not null group by all),
r as (select *, row_number() over w as rn, sum(bytes) over w as upto, 100000.0 * case source when 'dolly' then 0.5 when 'xsum' then 0.3 else 0.2 end as share from f window w as (partition by source order by name))
select source, name, bytes from r where rn = 1 or upto <= share""")
def a18_select_files(t):
    """Files of each source that fit its share of a byte budget."""
    files = t("sft_train").where("source in ('dolly', 'xsum', 'coedit') and origin_file is not null").groupBy("source", F.col("origin_file").alias("name")).agg(F.sum(F.length("messages")).alias("bytes"))
    return M.select_files(files, {"dolly": 0.5, "xsum": 0.3, "coedit": 0.2}, 100000.0)


H1_SQL = """
with recursive pool as (select t as task, count(*) as n from {tasks} where t <> '' group by t),
w as (select g.task, g.weight as w, p.n * coalesce(g.max_repeats, 1) * 1.0 as cap from mix_targets g join pool p using (task) where g.stage = 'sft'),
s as (select 0 as step, task, w, cap, null::bigint as al, (select sum(cap) * 0.9 from w) as rem from w
  union all
  select step + 1, task, w, cap,
    case when al is not null then al when rem <= 0 then 0 when any_over then case when over then floor(cap)::bigint end else floor(rem * w / nm)::bigint end,
    rem - case when any_over then pinned else 0 end
  from (select *, bool_or(over) over () as any_over, coalesce(sum(case when over then floor(cap) end) over (), 0) as pinned from
    (select *, sum(case when al is null then w end) over () as nm, al is null and rem * w / sum(case when al is null then w end) over () > cap as over from s where step < 20)))
select task, max(al) as draws from s group by task"""


@query(H1_SQL.replace("{tasks}", TASKS))
def h1_water_fill(t):
    """Draws of each task by weight, pinned at their caps; one row a task goes to the driver."""
    spark = t("region").sparkSession
    draws = _allocation(t)
    return spark.createDataFrame(sorted(draws.items()), "task string, draws bigint")


def _allocation(t) -> dict[str, int]:
    rows = once(t("sft_train")).where("task <> ''")
    goals = t("mix_targets").where("stage = 'sft'").select("task", "weight", "max_repeats")
    table = goals.join(rows.groupBy("task").agg(F.count("*").alias("n")), "task").limit(M.MAX_TASKS).collect()
    caps = {r["task"]: float(r["n"]) * (r["max_repeats"] or 1) for r in table}
    return M.water_fill({r["task"]: r["weight"] for r in table}, caps, sum(caps.values()) * 0.9)


@query("""
with r as (select row_id, t as task, md5('5:' || row_id) as h from """ + TASKS + """ where t in ('smalltalk', 'shell', 'sql')),
p as (select *, row_number() over (partition by task order by h, row_id) - 1 as k, count(*) over (partition by task) as n, case task when 'smalltalk' then 2 * count(*) over (partition by task) + 3 when 'shell' then 40 else 17 end as d from r)
select row_id, task, unnest(range(1, (d // n + (k < d % n)::int + 1)::bigint))::int as copy from p where d // n + (k < d % n)::int > 0""")
def h2_resample(t):
    """Whole copies and a hashed remainder of three tasks."""
    rows = once(t("sft_train")).where("task in ('smalltalk', 'shell', 'sql')").select("row_id", "task")
    n = rows.where("task = 'smalltalk'").count()
    return M.resample(rows, "task", "row_id", {"smalltalk": 2 * n + 3, "shell": 40, "sql": 17} if n else {"shell": 40, "sql": 17}, 5)


@query("""
with o as (select row_id, un, row_number() over (order by h, row_id) as rn from (select row_id, (source = 'hh-rlhf')::int as un, md5('9:' || row_id) as h from (select distinct row_id, source from dpo_train where source is not null))),
a as (select *, sum(1 - un) over (order by rn) as A, sum(un) over (order by rn) as t from o),
m as (select *, min(case when un = 1 then floor(A / 3.0) + 1 - t end) over (order by rn) as mm from a),
u as (select *, case when un = 1 then t + least(0, mm) end as ut from m),
p as (select *, coalesce(max(ut) over (order by rn rows between unbounded preceding and 1 preceding), 0) as pu from u)
select row_id from p where un = 0 or ut > pu""")
def h3_cap_ratio(t):
    """One source held to a quarter of what is kept, in hashed order."""
    rows = t("dpo_train").where("source is not null").select("row_id", "source").distinct()
    return M.cap_ratio(rows, F.col("source") == "hh-rlhf", "row_id", 9, 0.25).select("row_id")


HEADS = """
with c as (select row_id, t as task, json_extract_string(messages, '$[1].content') as command from """ + TASKS + """ where t = 'shell' and json_valid(messages)),
w as (select row_id, task, command, list_filter(string_split_regex(coalesce(command, ''), '[\\s|;&]+'), lambda x: x <> '') as words from c),
h as (select row_id, task, coalesce(case when len(words) > 1 and words[1] in ('sudo', 'env', 'time', 'nohup') then words[2] else words[1] end, '') as head from w)
"""


def _heads(t):
    shell = once(t("sft_train"), "messages").where("task = 'shell'").withColumn("turns", F.from_json("messages", "array<struct<content:string>>")).where("turns is not null")
    return shell.select("row_id", "task", X.head_command(F.get("turns", F.lit(1))["content"]).alias("head"))


@query(HEADS + "select * from h")
def d14_head_command(t):
    """The command that each shell reply runs first."""
    return _heads(t)


@query(HEADS + """, r as (select *, row_number() over (partition by task, head order by md5('3:' || row_id), row_id) as rn, count(*) over (partition by task) as n from h)
select row_id, head from r where head = '' or rn <= greatest(1, floor(0.15 * n + 1e-9))""")
def h4_cap_heads(t):
    """At most 15 % of the shell replies by one command."""
    return M.cap_heads(_heads(t), "task", "head", "row_id", {"shell": 0.15}, 3).select("row_id", "head")


DONATE = """
with tr as (select distinct row_id, task, source from sft_train where task is not null and source is not null), va as (select distinct task, source from dpo_val where task is not null and source is not null),
p as (select task, source, count(*) as n from tr group by all), q as (select p.*, {pairs} as pairs from p),
d as (select * from q where not exists (select 1 from va where va.task = q.task and va.source = q.source)),
r as (select tr.*, row_number() over (partition by task, source order by md5('11:' || row_id), row_id) as rn from tr)
select r.row_id from r join d using (task, source) where rn <= least(greatest(1, floor(150 / pairs)), floor(0.1 * n))"""


def _donated(t, divisor):
    # hold-out rows of the other stage: most pairs have none
    train = t("sft_train").where("task is not null and source is not null").select("row_id", "task", "source").distinct()
    val = t("dpo_val").where("task is not null and source is not null").select("task", "source")
    return M.donate(train, val, "row_id", 11, 150, divisor).select("row_id")


@query(DONATE.format(pairs="count(*) over (partition by task)"))
def h5_donate(t):
    """Hold-out rows of pairs that have none, shared within the task."""
    return _donated(t, "task")


@query(DONATE.format(pairs="count(*) over ()"))
def h6_donate_overall(t):
    """Hold-out rows of pairs that have none, shared over all pairs."""
    return _donated(t, "all")


@query("""
with v as (select distinct row_id, lower(trim(task)) as task, source from sft_val where trim(task) <> '' and source is not null),
a as (select *, row_number() over (partition by task, source order by md5('13:' || row_id), row_id) as rs, (select count(distinct source) from v v2 where v2.task = v.task) as ns from v),
b as (select *, rs <= greatest(1, floor(10 / ns)) as first from a),
c as (select *, sum(first::int) over (partition by task order by md5('13:' || row_id), row_id rows between unbounded preceding and 1 preceding) as before from b)
select row_id, first and coalesce(before, 0) < 10 as kept from c""")
def h7_trim(t):
    """Hold-out rows kept within the source and task limits."""
    val = once(t("sft_val")).where("task <> '' and source is not null").select("row_id", "task", "source")
    return M.trim(val, "row_id", 13, 10).select("row_id", "kept")


@query("select doc_id, md5('1337:' || doc_id) as place from documents")
def h8_shuffle(t):
    """The seeded order of the documents."""
    return t("documents").select("doc_id", X.seeded_hash(1337, F.col("doc_id")).alias("place"))


@query("""
select task, case task when 'smalltalk' then 4 when 'reasoning' then 2 when 'instruct' then 2 when 'writing' then 2 when 'shell' then 2 else 3 end as repeats
from (select distinct lower(trim(task)) as task from sft_train where trim(task) <> '')""")
def h9_repeat_caps(t):
    """How often a record of each task may be repeated: 3, unless the task says otherwise."""
    caps = {"smalltalk": 4, "reasoning": 2, "instruct": 2, "writing": 2, "shell": 2}
    cap = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col("task")]
    return t("sft_train").where("trim(task) <> ''").select(F.lower(F.trim("task")).alias("task")).distinct().select("task", F.coalesce(cap, F.lit(3)).alias("repeats"))


@query("select row_id from (select row_id, row_number() over (partition by source order by md5('1337:' || row_id), row_id) as rn from (select distinct row_id, source from dpo_train where source is not null)) where rn <= 50")
def h19_cap_rows(t):
    """At most fifty rows of each source: a sampling operator."""
    return M.sample_rows(t("dpo_train").where("source is not null").select("row_id", "source").distinct(), "source", "row_id", 1337, most=50).select("row_id")


@query("""
select row_id from (select row_id, row_number() over (partition by origin_file order by md5('1337:' || row_id), row_id) as rn, count(*) over (partition by origin_file) as n
from (select distinct row_id, origin_file from dpo_train where origin_file is not null)) where rn <= greatest(1, floor(n * 0.2))""")
def b12_subsample(t):
    """A fifth of the rows of each file, at least one: a sampling operator."""
    return M.sample_rows(t("dpo_train").where("origin_file is not null").select("row_id", "origin_file").distinct(), "origin_file", "row_id", 1337, share=0.2).select("row_id")


@query("""
select doc_id from (select doc_id, coalesce(sum(coalesce(n_chars, 0)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as b from documents) where b < 500000""")
def g10_tokenizer_sample(t):
    """Documents, in order, until half a million characters are reached, the crossing one included."""
    return M.within_budget(t("documents").select("doc_id", "n_chars"), ["doc_id"], F.col("n_chars"), 500000).select("doc_id")


# ---------------------------------------------------------------- normalised rows


@query(f"""
with d as (select distinct row_id, {strip_sql("coalesce(chosen, '')")} as c, {strip_sql("coalesce(rejected, '')")} as r from dpo_train)
select row_id, case when c = '' or r = '' then 'malformed' when length(c) not between 8 and 4000 or length(r) not between 8 and 4000 then 'length' else 'fits' end as state from d""")
def c21_reply_lengths(t):
    """Pairs by the first reason to drop them, but for similarity."""
    d = t("dpo_train").select("row_id", X.strip(F.coalesce("chosen", F.lit(""))).alias("c"), X.strip(F.coalesce("rejected", F.lit(""))).alias("r")).distinct()
    return d.select("row_id", F.coalesce(N.drop_reason(F.col("c"), F.col("r"), F.lit(False)), F.lit("fits")).alias("state"))


SIMILAR = """
s as (select *, least(length(a), length(b)) as short, greatest(length(a), length(b)) as longest from p),
h as (select *, (select max(i) from range(0, short + 1) x(i) where left(a, i::int) = left(b, i::int)) as head from s),
e as (select *, (select max(i) from range(0, short - head + 1) x(i) where right(a, i::int) = right(b, i::int)) as tail from h),
m as (select *, a = b or (longest - least(head + tail, short)) / longest < 0.02 as alike from e)"""


@query(f"""
with p as (select distinct row_id, source, {strip_sql(f"regexp_replace(coalesce(chosen, ''), '{FOREIGN}', '', 'g')")} as a, {strip_sql(f"regexp_replace(coalesce(rejected, ''), '{FOREIGN}', '', 'g')")} as b from dpo_train), {SIMILAR}
select source, case when a = '' or b = '' then 'malformed' when length(a) not between 8 and 4000 or length(b) not between 8 and 4000 then 'length' when alike then 'similar' else 'kept' end as reason, count(*) as n from m group by all""")
def f25_drop_reasons(t):
    """Counts of the preference pairs by reason: malformed, length, similar or kept."""
    d = t("dpo_train").dropDuplicates(["row_id"]).select("source", X.clean(F.col("chosen")).alias("c"), X.clean(F.col("rejected")).alias("r"))
    d = with_similar(d, "c", "r")
    return d.groupBy("source", F.coalesce(N.drop_reason(F.col("c"), F.col("r"), F.col("similar")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""
with p as (select distinct row_id, chosen as a, rejected as b from dpo_train where chosen is not null and rejected is not null), {SIMILAR}
select row_id from m where alike""")
def d16_similar_pairs(t):
    """Pairs whose replies differ in less than a fiftieth of the longer one."""
    d = t("dpo_train").where("chosen is not null and rejected is not null").select("row_id", "chosen", "rejected").dropDuplicates(["row_id"])
    return with_similar(d, "chosen", "rejected").where("similar").select("row_id")


@query(f"""
with m as (select distinct row_id, messages from sft_train where json_valid(messages) and json_type(messages) = 'ARRAY'),
e as (select row_id, i, lower(trim(coalesce(json_extract_string(messages, '$[' || i || '].role'), json_extract_string(messages, '$[' || i || '].from'), ''))) as role,
   coalesce(json_extract_string(messages, '$[' || i || '].content'), json_extract_string(messages, '$[' || i || '].value')) as content
   from m, unnest(range(0, json_array_length(messages)::bigint)) as r(i)),
c as (select row_id, i, case role when 'human' then 'user' when 'gpt' then 'assistant' else role end as role, {strip_sql("regexp_replace(coalesce(content, ''), '" + "[^\\P{L}\\x{0000}-\\x{024F}\\x{1E00}-\\x{1EFF}\\x{0250}-\\x{02AF}\\x{2C60}-\\x{2C7F}\\x{A720}-\\x{A7FF}]" + "', '', 'g')")} as content from e),
s as (select row_id, arg_max(content, i) as system from c where role = 'system' and content <> '' group by row_id),
n as (select c.row_id, role, content, row_number() over (partition by c.row_id order by i) as k, count(*) over (partition by c.row_id) as n from c where role in ('user', 'assistant') and content <> '')
select n.row_id, (k - 1)::int as turn, role, case when k = 1 and system is not null then system || chr(10) || chr(10) || content else content end as content
from n left join s using (row_id) where n >= 2 and exists (select 1 from n f where f.row_id = n.row_id and f.k = 1 and f.role = 'user')""")
def f1_conversations(t):
    """Turns of the normalised conversations, the system turn folded into the first user turn."""
    rows = t("sft_train").select("row_id", "messages").dropDuplicates(["row_id"])
    turns = rows.withColumn("turns", N.from_turns(N.parse_turns(F.col("messages")))).where("turns is not null")
    return turns.select("row_id", F.posexplode("turns").alias("turn", "m")).select("row_id", "turn", "m.role", "m.content")


@query("""
select item_id, array_to_string(list_transform(choices, lambda c, i: chr((64 + i)::int) || ') ' || c), chr(10)) as options, chr((65 + answer)::int) || ') ' || choices[answer + 1] as reply
from eval_items where answer is not null and answer < len(choices)""")
def d19_options(t):
    """Lettered choices and the lettered answer of each item."""
    items = t("eval_items").where("answer is not null and answer < size(choices)")
    return items.select("item_id", X.options(F.col("choices")).alias("options"), X.option(F.col("choices"), F.col("answer").cast("int")).alias("reply"))


@query("""
with p as (select ['Answer the question by choosing the correct option below.', 'Choose the option that best answers the question.', 'Pick the correct choice for the question below.'] as pool)
select item_id, pool[('0x' || substr(md5('1337-prompt:' || item_id), 1, 8))::bigint % 3 + 1] as prompt, ('0x' || substr(md5('1337-think:' || item_id), 1, 8))::bigint / 4294967296.0 < 0.75 as thinks from eval_items, p""")
def d20_prompt_choice(t):
    """The prompt wording and mode that each item draws."""
    from skein.operators.pools import REASONING_PROMPTS

    return t("eval_items").select("item_id", X.choose(REASONING_PROMPTS, f"{N.SEED}-prompt", F.col("item_id")).alias("prompt"), (X.chance(f"{N.SEED}-think", F.col("item_id")) < N.THINK_SHARE).alias("thinks"))


@query(rf"""
with r as (select item_id, case coalesce(answer, 3) when 0 then context when 1 then 'Thinking: ' || context when 2 then 'So. Thinking: ' || context || chr(10) || 'Answer: ' || choices[1] else 'Answer: ' || context end as reply from eval_items)
select item_id, case when instr(reply, 'Thinking:') = 0 then '' else {strip_sql("split_part(substr(reply, instr(reply, 'Thinking:') + 9), 'Answer:', 1)")} end as thinking,
case when instr(reply, 'Thinking:') = 0 then {strip_sql('reply')} when instr(substr(reply, instr(reply, 'Thinking:') + 9), 'Answer:') = 0 then ''
  else {strip_sql("substr(substr(reply, instr(reply, 'Thinking:') + 9), instr(substr(reply, instr(reply, 'Thinking:') + 9), 'Answer:') + 7)")} end as answer from r""")
def d11_split_thinking(t):
    """Scratchpad and answer of replies with both, with a scratchpad cut off, and with neither."""
    reply = F.expr("""case coalesce(answer, 3) when 0 then context when 1 then 'Thinking: ' || context when 2 then 'So. Thinking: ' || context || char(10) || 'Answer: ' || choices[0] else 'Answer: ' || context end""")
    return t("eval_items").select("item_id", X.split_thinking(reply).alias("p")).select("item_id", "p.thinking", "p.answer")


@query(f"""
with r as (select distinct row_id, json_extract_string(messages, '$[0].role') as role, {strip_sql("json_extract_string(messages, '$[0].content')")} as asked, {strip_sql("json_extract_string(messages, '$[1].content')")} as reply
  from sft_train where json_valid(messages) and json_array_length(messages) >= 2)
select row_id, asked, reply from r where role = 'user' and reply <> '' and len(list_filter(string_split_regex(reply, '\\s+'), lambda x: x <> '')) <= 45
and regexp_matches(asked, '(?i)^(hi|hello|hey|yo|howdy|greetings|good (morning|afternoon|evening|day)|how are you( doing)?|how''?s it going)\\b[\\s!.,?]*$')""")
def f26_greetings(t):
    """First exchanges that are a greeting and get a short reply."""
    rows = N.greetings(t("sft_train").select("row_id", "messages").dropDuplicates(["row_id"]))
    said = lambda k: F.get("messages", F.lit(k))["content"]
    return rows.select(F.col("id").alias("row_id"), said(0).alias("asked"), said(1).alias("reply"))


@query(f"""
with r as (select distinct row_id, json_extract_string(messages, '$[0].content') as src from sft_train where lower(trim(task)) = 'rewrite' and json_valid(messages))
select row_id, case when instr(src, ': ') > 0 and instr(src, ': ') - 1 <= 80 then {strip_sql("substr(src, instr(src, ': ') + 2)")} else src end as body from r where src is not null""")
def d18_split_instruction(t):
    """Texts to be rewritten, without the instruction before them."""
    r = t("sft_train").where(F.lower(F.trim("task")) == "rewrite").select("row_id", F.get(F.from_json("messages", "array<struct<content:string>>"), F.lit(0))["content"].alias("src")).distinct()
    return r.where("src is not null").select("row_id", X.split_instruction(F.col("src")).alias("body"))


@query(r"""
with r as (select distinct row_id, json_extract_string(messages, '$[1].content') as command from sft_train where lower(trim(task)) = 'shell' and json_valid(messages))
select row_id, not contains(command, chr(10)) and length(command) <= 400 as one_liner,
regexp_matches(command, '(?i)\brm\s+(?:-[-\w]+\s+)*/(?:\s|$|\*|(?:bin|boot|dev|etc|home|lib|proc|root|sbin|srv|sys|usr|var)\b)|\bmkfs(?:\.\w+)?\b|\bdd\s+[^;&|]*of=/dev/(?:sd|nvme|hd|vd|disk|mmcblk|loop)|:\(\)\s*\{|\b(?:shutdown|reboot|poweroff)\b|(?:^|[;&|]\s*|\bsudo\s+)halt\b|\bchmod\s+(?:-[-\w]+\s+)*777\s+/(?:\s|$)|>\s*/dev/(?:sd|nvme|hd|vd|mmcblk)|\bmv\s+[^;&|]*\s/dev/null\b') as destructive
from r where command is not null""")
def c10_shell_filters(t):
    """One-line and destructive shell replies."""
    r = t("sft_train").where(F.lower(F.trim("task")) == "shell").select("row_id", F.get(F.from_json("messages", "array<struct<content:string>>"), F.lit(1))["content"].alias("command")).distinct()
    c = F.col("command")
    return r.where("command is not null").select("row_id", X.is_one_liner(c).alias("one_liner"), X.is_destructive(c).alias("destructive"))


@query(f"""
with r as (select distinct row_id, {strip_sql(f"regexp_replace(chosen, '{FOREIGN}', '', 'g')")} as a, {strip_sql(f"regexp_replace(rejected, '{FOREIGN}', '', 'g')")} as b from dpo_train where chosen is not null and rejected is not null)
select row_id, (a <> '')::int + (b <> '')::int as n_turns, case when b <> '' then b when a <> '' then a end as last_turn from r""")
def d15_transcripts(t):
    """Turns of flat transcripts, made of the replies: empty turns are left out."""
    rows = t("dpo_train").where("chosen is not null and rejected is not null").select("row_id", "chosen", "rejected").distinct()
    flat = F.concat(F.lit("\n\nHuman: "), "chosen", F.lit("\n\nAssistant: "), "rejected")
    parsed = rows.select("row_id", F.transform(N.parse_transcript(flat), lambda m: m["content"]).alias("m"))
    return parsed.select("row_id", F.size("m").alias("n_turns"), F.try_element_at("m", F.lit(-1)).alias("last_turn"))


@query(f"""
with r as (select item_id, regexp_replace({strip_sql("context")}, '\\s+', ' ', 'g') as r, choices[answer + 1] as a from eval_items where answer is not null and answer < len(choices))
select item_id, case when length(r) < 16 or lower(r) = lower(a) then a else 'Thinking: ' || r || chr(10) || 'Answer: ' || a end as reply from r""")
def d10_think_replies(t):
    """Scratchpad replies made of the items' passages and answers."""
    r = t("eval_items").where("answer is not null and answer < size(choices)")
    return r.select("item_id", X.think_reply(F.col("context"), F.get("choices", F.col("answer").cast("int"))).alias("reply"))


@query(f"""
with r as (select item_id, {strip_sql("context")} as c, answer from eval_items where answer is not null)
select item_id, regexp_replace({strip_sql("rtrim(c, '.')")}, '^\\s+|\\s+$', '', 'g') as steps, (answer * 7)::bigint::varchar as final from r""")
def d12_worked_solutions(t):
    """Steps and final answer of solutions that close by naming it."""
    r = t("eval_items").where("answer is not null").select("item_id", F.concat(F.regexp_replace(X.strip(F.col("context")), r"\.+$", ""), F.lit(". So the answer is: "), (F.col("answer") * 7).cast("bigint").cast("string"), F.lit(".")).alias("s"))
    parts = r.select("item_id", X.worked_solution(X.solution_parts(F.col("s"))).alias("p"))
    return parts.select("item_id", "p.steps", "p.final")


@query(r"""
select item_id, trim(regexp_replace(replace(context, '.', ' \boxed{x}.'), '\\boxed\{([^{}]*)\}', '\1', 'g'), E' \t\n\r') as text from eval_items""")
def d13_strip_markup(t):
    """Texts without calculator notes and final marks, boxes unwrapped."""
    marked = F.concat(F.lit("<<1+1=2>>"), F.replace("context", F.lit("."), F.lit(" \\boxed{x}.")), F.lit(" #### 12"))
    return t("eval_items").select("item_id", X.strip(X.strip_markup(marked)).alias("text"))
