"""Queries that normalise tables shaped like each source: one for every conversation and pair schema.

The test tables are renamed to the columns of a source, in the same words for both
engines; the SQL states what the normaliser of that source must give.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from skein.operators import normalise as N
from skein.operators import pools as P
from skein.plans.base import query
from skein.plans.corpus import FOREIGN, WS, strip_sql
from skein.plans.mixtures import SIMILAR

# Shorthand for expressions that the engines write differently: (word, DuckDB, Spark).
_WORDS = (
    ("FIRST", "choices[1]", "try_element_at(choices, 1)"),
    ("SECOND", "choices[2]", "try_element_at(choices, 2)"),
    ("PICK", "choices[answer + 1]", "get(choices, cast(answer as int))"),
    ("NOTHING", "[]::varchar[]", "cast(array() as array<string>)"),
    ("ONE(", "list_value(", "array("),
    ("LABELS", "list_transform(choices, lambda c, i: chr((64 + i)::int))", "transform(choices, (c, i) -> char(i + 65))"),
    ("NEWLINE", "chr(10) || chr(10)", "char(10) || char(10)"),
    ("BACKSLASH", "chr(92)", "char(92)"),
    ("LETTER", "chr((65 + answer)::int)", "char(cast(answer as int) + 65)"),
)


#: each preference pair once
PAIRS = "(select distinct row_id, source, prompt, chosen, rejected from dpo_train)"


def _in(engine: int, text: str) -> str:
    for word, *both in _WORDS:
        text = text.replace(word, both[engine])
    if engine == 0:  # a struct is written in braces
        text = re.sub(r"named_struct\('text', (.*?), 'label', (.*)\)$", r"{'text': \1, 'label': \2}", text)
        text = re.sub(r"named_struct\('text', (.*)\)$", r"{'text': \1}", text)
    return text


def clean(c: str) -> str:
    return strip_sql(f"regexp_replace(coalesce({c}, ''), '{FOREIGN}', '', 'g')")


def collapse(c: str) -> str:
    return f"regexp_replace({strip_sql(c)}, '{WS}+', ' ', 'g')"


def chance(tag: str) -> str:
    return f"(('0x' || substr(md5('{N.SEED}-{tag}:' || id), 1, 8))::bigint / 4294967296.0)"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def draw(pool, tag: str = "prompt") -> str:
    texts = ", ".join(map(literal, pool))
    return f"(list_value({texts}))[('0x' || substr(md5('{N.SEED}-{tag}:' || id), 1, 8))::bigint % {len(pool)} + 1]"


def shaped(fields: dict[str, str], table: str = "eval_items", key: str = "item_id"):
    """(SQL of the source-shaped table, maker of it in Spark)."""
    duck = f"select {key} as id, " + ", ".join(f"{_in(0, e)} as {n}" for n, e in fields.items()) + f" from {table}"
    def make(t):
        rows = t("dpo_train").select("row_id", "source", "prompt", "chosen", "rejected").distinct() if table == PAIRS else t(table)
        return rows.selectExpr(f"{key} as id", *[f"{_in(1, e)} as {n}" for n, e in fields.items()])

    return duck, make


def conversation(name: str, source: str, fields: dict[str, str], sql: str, doc: str, table: str = "eval_items", key: str = "item_id") -> None:
    """Registers a query of ``(id, task, prompt, reply)`` of a source; ``sql`` selects them from s, the shaped table."""
    duck, spark = shaped(fields, table, key)

    def run(t):
        said = lambda k: F.get("messages", F.lit(k))["content"]
        return N.conversations(source, spark(t)).select("id", "task", said(0).alias("prompt"), said(1).alias("reply"))

    run.__name__, run.__doc__ = name, doc
    query(f"with s as ({duck})\n{sql}")(run)


_LINES = " || chr(10) || chr(10) || "
_PASSAGE = f"{draw(P.QA_PROMPTS)} || chr(10) || chr(10) || 'Passage:' || chr(10) || {{0}} || chr(10) || chr(10) || 'Question: ' || {{1}}"

conversation(
    "f4_squad", "squad-v2", {"question": "FIRST", "context": "context", "answers": "named_struct('text', case when answer is null then NOTHING else ONE(PICK) end)"},
    f"""select id, 'extractive_qa' as task, {_PASSAGE.format('c', 'q')} as prompt, a as reply from (
    select id, {clean('question')} as q, {clean('context')} as c, case when len(answers.text) = 0 then {draw(P.NO_ANSWER_REPLIES, 'reply')} else {clean('answers.text[1]')} end as a from s) where q <> '' and c <> '' and a <> ''""",
    "Passages and questions; those without an answer draw a reply that says so.",
)
conversation(
    "f5_sciq", "sciq", {"question": "FIRST", "correct_answer": "PICK", "support": "case when task is null then '' else context end"},
    f"""select id, 'extractive_qa' as task, {_PASSAGE.format('c', 'q')} as prompt, a as reply from (
    select id, {clean('question')} as q, {clean('support')} as c, {clean('correct_answer')} as a from s) where q <> '' and c <> '' and a <> ''""",
    "Questions with a support passage; rows without one are left out.",
)
conversation(
    "f6_dialogue_summary", "samsum", {"dialogue": "context", "summary": "PICK"},
    f"""select id, 'summarization' as task, {draw(P.SUMMARY_PROMPTS)}{_LINES}d as prompt, a as reply from (select id, {clean('dialogue')} as d, {clean('summary')} as a from s) where d <> '' and a <> ''""",
    "Dialogues and their summaries.",
)
conversation(
    "f7_xsum", "xsum", {"document": "text", "summary": "site"},
    f"""select id, 'summarization' as task, {literal(P.ARTICLE_PROMPT)}{_LINES}d as prompt, a as reply from (select id, {clean('document')} as d, {clean('summary')} as a from s) where d <> '' and a <> ''""",
    "Articles and one-sentence summaries, over all documents.", "documents", "doc_id",
)
_SQL = f"""select id, 'sql' as task, {draw(P.SQL_PROMPTS)} || chr(10) || chr(10) || 'Schema:' || chr(10) || c || chr(10) || chr(10) || 'Question: ' || q as prompt, a as reply from (
    select id, {clean('{0}')} as q, {clean('{1}')} as c, {clean('{2}')} as a from s {{where}}) where q <> '' and c <> '' and a <> ''"""


def _sql(question: str, schema: str, answer: str, where: str = "") -> str:
    text = _SQL.replace("{where}", where)
    for k, name in enumerate((question, schema, answer)):
        text = text.replace("{%d}" % k, name)
    return text


conversation("f8_sql_create_context", "sql-create-context", {"question": "FIRST", "context": "context", "answer": "PICK"}, _sql("question", "context", "answer"), "Questions and their SQL over a schema.")
conversation(
    "f9_text_to_sql", "synthetic-text-to-sql", {"sql_prompt": "FIRST", "sql_context": "context", "sql": "SECOND", "sql_complexity": "case answer when 0 then 'Window functions' when 1 then 'CTE with joins' when 2 then 'multiple_joins' else task end"},
    _sql("sql_prompt", "sql_context", "sql", "where not regexp_matches(lower(coalesce(sql_complexity, '')), 'window functions|set operations|multiple_joins|multiple joins|cte|cte with joins')"),
    "As above, without the complex kinds of query.",
)
conversation(
    "f10_dolly", "dolly", {"instruction": "FIRST", "context": "case when length(context) % 2 = 0 then null else context end", "response": "SECOND", "category": "case answer when 0 then 'closed_qa' when 1 then 'creative_writing' when 2 then 'summarization' else task end"},
    f"""select id, case coalesce(category, '') when 'creative_writing' then 'writing' when 'brainstorming' then 'writing' when 'summarization' then 'summarization' else 'instruct' end as task,
    case when c = '' then i else i{_LINES}c end as prompt, r as reply from (select id, category, {clean('instruction')} as i, {clean('context')} as c, {clean('response')} as r from s)
    where i <> '' and r <> '' and not (coalesce(category, '') in ('closed_qa', 'open_qa', 'general_qa') and c = '')""",
    "Instructions, routed by category; closed questions need a context.",
)

_MATHS = f"""select id, 'math' as task, p{_LINES}q as prompt, r as reply from (select *,
    case mode when 'think' then {draw(P.THINK_PROMPTS)} when 'direct' then {draw(P.DIRECT_PROMPTS)} else {draw(P.MATH_PROMPTS)} end as p,
    case mode when 'think' then case when length(thought) < 16 or lower(thought) = lower(final) then final else 'Thinking: ' || thought || chr(10) || 'Answer: ' || final end when 'direct' then final else fallback end as r
    from (select *, {collapse('steps')} as thought, case when coalesce(steps <> '' and final <> '', false) then case when {chance('think')} < {N.THINK_SHARE} then 'think' else 'direct' end else 'plain' end as mode from m)) where q <> '' and r <> ''"""
_WORKED = rf"""w as (select *, {strip_sql(r"regexp_extract(fallback, '(?is)\A(.*?)(?:^|\n|\.\s+)(?:so\s+|therefore,?\s+)?the\s+answer\s+is:?\s*(.+?)\s*\.?\s*$', 1)")} as s0,
    {collapse(r"regexp_extract(fallback, '(?is)\A(.*?)(?:^|\n|\.\s+)(?:so\s+|therefore,?\s+)?the\s+answer\s+is:?\s*(.+?)\s*\.?\s*$', 2)")} as f0 from b),
    m as (select id, q, fallback, case when f0 <> '' and length(f0) <= 120 and length(s0) >= 16 then s0 end as steps, case when f0 <> '' and length(f0) <= 120 and length(s0) >= 16 then f0 end as final from w)"""
conversation(
    "f11_gsm8k", "gsm8k", {"question": "FIRST", "answer": "context || ' so 3 + 4 = <<3+4=7>>7' || case when answer is null then '' else ' #### ' || cast(answer * 7 as string) end"},
    f""", m as (select id, {clean('question')} as q, {clean("regexp_replace(substr(answer, 1, instr(answer, '####') - 1), '<<[^>]*>>', '', 'g')")} as steps, {clean("substr(answer, instr(answer, '####') + 4)")} as final, '' as fallback
    from s where instr(answer, '####') > 0) {_MATHS.replace("from m)", "from m where steps <> '' and final <> '')")}""",
    "Worked problems with a marked result, with or without their working.",
)
_METAMATH_TEXT = rf"regexp_replace(regexp_replace(regexp_replace({clean('response')}, '<<[^>]*>>', '', 'g'), '####\s*\S+', '', 'g'), '^{WS}+|{WS}+$', '', 'g')"
conversation(
    "f12_metamath", "metamath", {"type": "case when task is null then 'MATH_Rephrased' else 'GSM_Rephrased' end", "query": "FIRST", "response": "context || case when answer is null then ' <<1>> no more' else '. The answer is: ' || cast(answer * 7 as string) end"},
    rf""", b as (select id, {clean('query')} as q, regexp_replace({_METAMATH_TEXT}, '\\boxed\{{([^{{}}]*)\}}', '\1', 'g') as fallback from s where type like 'GSM%'), {_WORKED.replace("from b)", "from b where length(fallback) >= 16)")} {_MATHS}""",
    "Rephrased problems of the grade-school kind, their closing sentence split off.",
)
conversation(
    "f13_orca_math", "orca-math", {"question": "FIRST", "answer": "case when answer is null then context else context || '. Therefore, the answer is ' || BACKSLASH || 'boxed{' || cast(answer * 7 as string) || '}.' end"},
    rf""", b as (select id, {clean('question')} as q, regexp_replace({clean('answer')}, '\\boxed\{{([^{{}}]*)\}}', '\1', 'g') as fallback from s where length({clean('answer')}) >= 16), {_WORKED} {_MATHS}""",
    "Word problems, boxes unwrapped, their closing sentence split off.",
)
_CHOICES = f"(select string_agg(l || ') ' || x, chr(10) order by i) from (select unnest(choices.label) as l, unnest(list_transform(choices.text, lambda x: {clean('x')})) as x, unnest(range(1, len(choices.text) + 1)) as i) where x <> '')"
conversation(
    "f15_choice_conversations", "arc-challenge", {"question": "context", "choices": "named_struct('text', choices, 'label', LABELS)", "answerKey": "LETTER"},
    f"""select id, 'reasoning' as task, {draw(P.REASONING_PROMPTS)}{_LINES}q{_LINES}o as prompt, "answerKey" || ') ' || a as reply from (
    select id, "answerKey", {clean('question')} as q, {_CHOICES} as o, {clean('choices.text[list_position(choices.label, "answerKey")]')} as a, len(choices.text) as n from s)
    where q <> '' and a <> '' and n >= 2 and "answerKey" <> ''""",
    "Multiple-choice items as conversations.",
)
_OPTIONS = "list_filter(list_value({}), lambda o: o <> '')".format(", ".join(clean(f"q_op{i}") for i in range(1, 6)))
conversation(
    "f16_ecqa", "ecqa",
    {"q_text": "context", "q_ans": "case when task is null then 'not an option' else PICK end", "q_op1": "FIRST", "q_op2": "SECOND", "q_op3": "cast(null as string)", "q_op4": "''", "q_op5": "task", "taskA_pos": "case when length(context) % 3 = 0 then 'short' else context end"},
    f"""select id, 'reasoning' as task, case when th then {draw(P.THINK_PROMPTS)} else {draw(P.DIRECT_PROMPTS)} end{_LINES}q{_LINES}array_to_string(list_transform(o, lambda x, i: chr((64 + i)::int) || ') ' || x), chr(10)) as prompt,
    case when not th or length(why) < 16 or lower(why) = lower(f) then f else 'Thinking: ' || why || chr(10) || 'Answer: ' || f end as reply from (select *, chr((64 + list_position(o, a))::int) || ') ' || a as f from (
    select id, {clean('q_text')} as q, {clean('q_ans')} as a, {_OPTIONS} as o, {collapse('coalesce("taskA_pos", ' + "''" + ')')} as why, {chance('think')} < {N.THINK_SHARE} as th from s) where q <> '' and a <> '' and len(o) >= 2 and list_contains(o, a))""",
    "Questions whose answer is one of their options, with the given reasons or without.",
)
_REWRITES = "case lower(trim(coalesce(task, ''))) " + " ".join(f"when {literal(k)} then {draw(v)}" for k, v in P.REWRITE_PROMPTS.items()) + f" else {draw(P.REWRITE_FALLBACK)} end"


def latin(c: str) -> str:
    return f"length(regexp_replace({c}, '{FOREIGN}', '', 'g')) >= 0.85 * length({c})"


conversation(
    "f17_coedit", "coedit", {"task": f"case answer when 0 then {literal(sorted(P.REWRITE_PROMPTS)[0])} when 1 then {literal(' ' + sorted(P.REWRITE_PROMPTS)[1].upper())} else task end", "src": "'Fix the text: ' || context", "tgt": "SECOND"},
    f"""select id, 'rewrite' as task, {_REWRITES}{_LINES}body as prompt, tgt2 as reply from (select *, case when instr(src2, ': ') > 0 and instr(src2, ': ') - 1 <= 80 then {strip_sql("substr(src2, instr(src2, ': ') + 2)")} else src2 end as body
    from (select id, task, {clean('src')} as src2, {clean('tgt')} as tgt2 from s)) where src2 <> '' and tgt2 <> '' and body <> '' and {latin('body')} and {latin('tgt2')}""",
    "Texts to be edited, the instruction before them replaced by one of a pool.",
)
_SHELL = r"""regexp_matches(c, '(?i)\brm\s+(?:-[-\w]+\s+)*/(?:\s|$|\*|(?:bin|boot|dev|etc|home|lib|proc|root|sbin|srv|sys|usr|var)\b)|\bmkfs(?:\.\w+)?\b|\bdd\s+[^;&|]*of=/dev/(?:sd|nvme|hd|vd|disk|mmcblk|loop)|:\(\)\s*\{|\b(?:shutdown|reboot|poweroff)\b|(?:^|[;&|]\s*|\bsudo\s+)halt\b|\bchmod\s+(?:-[-\w]+\s+)*777\s+/(?:\s|$)|>\s*/dev/(?:sd|nvme|hd|vd|mmcblk)|\bmv\s+[^;&|]*\s/dev/null\b')"""
conversation(
    "f18_shell", "nl2bash", {"nl_command": "prompt", "bash_code": "case when length(chosen) % 5 = 0 then 'sudo rm -rf /etc' else chosen end"},
    f"""select distinct id, 'shell' as task, {draw(P.SHELL_PROMPTS)}{_LINES}i as prompt, c as reply from (select id, {clean('nl_command')} as i, {clean('bash_code')} as c from s)
    where i <> '' and c <> '' and not contains(c, chr(10)) and length(c) <= 400 and not {_SHELL}""",
    "Instructions and their one-line commands, destructive ones left out.", PAIRS, "row_id",
)

_SQUAD = {"question": "FIRST", "context": "context", "answers": "named_struct('text', case when answer is null or length(context) % 2 = 0 then NOTHING else ONE(PICK) end)"}
_SQUAD_SQL, _squad = shaped(_SQUAD)


@query(f"""
with s as ({_SQUAD_SQL}),
r as (select id, len(answers.text) = 0 as un, md5('{N.SEED}:' || id) as h from s where {clean('question')} <> '' and {clean('context')} <> '' and (len(answers.text) = 0 or {clean('answers.text[1]')} <> '')),
a as (select *, sum((not un)::int) over w as A, sum(un::int) over w as t from r window w as (order by h, id)),
m as (select *, min(case when un then floor(A / 3.0) + 1 - t end) over (order by h, id) as mm from a),
u as (select *, case when un then t + least(0, mm) end as ut from m),
p as (select *, coalesce(max(ut) over (order by h, id rows between unbounded preceding and 1 preceding), 0) as pu from u),
d as (select item_id as id, case when {clean('choices[1]')} <> '' and {clean('choices[2]')} <> '' then case answer when 1 then 'writing' when 2 then 'summarization' else 'instruct' end end as task from eval_items)
select 'squad-v2' as source, 'extractive_qa' as task, count(*) as n from p where not un or ut > pu union all select 'dolly', task, count(*) from d where task is not null group by task""")
def g3_routed_counts(t):
    """Rows of each source and task in a cache of two sources, unanswerable passages held to a quarter."""
    dolly = t("eval_items").selectExpr("item_id as id", "choices[0] as instruction", "'given' as context", "choices[1] as response", "case answer when 1 then 'creative_writing' when 2 then 'summarization' else 'closed_qa' end as category")
    return N.routed_counts(N.conversation_cache({"squad-v2": _squad(t), "dolly": dolly}))


# ---------------------------------------------------------------- chat and dialogue

_TURNS = f"""m as (select distinct row_id as id, task, source, messages from sft_train where json_valid(messages) and json_type(messages) = 'ARRAY'),
e as (select id, i, lower(trim(coalesce(json_extract_string(messages, '$[' || i || '].role'), json_extract_string(messages, '$[' || i || '].from'), ''))) as r,
   {clean("coalesce(json_extract_string(messages, '$[' || i || '].content'), json_extract_string(messages, '$[' || i || '].value'))")} as content from m, unnest(range(0, json_array_length(messages)::bigint)) as x(i)),
c as (select id, i, case r when 'human' then 'user' when 'gpt' then 'assistant' else r end as role, content from e where content <> ''),
sy as (select id, arg_max(content, i) as system from c where role = 'system' group by id),
n as (select c.id, role, content, row_number() over (partition by c.id order by i) as k, count(*) over (partition by c.id) as n from c where role in ('user', 'assistant')),
g as (select n.id, k, role, case when k = 1 and system is not null then system || chr(10) || chr(10) || content else content end as content from n left join sy using (id)
  where n >= 2 and exists (select 1 from n f where f.id = n.id and f.k = 1 and f.role = 'user'))"""


@query(f"with {_TURNS} select id, case category when 'Generation' then 'writing' when 'Summarize' then 'summarization' else 'chat' end as task, count(*) as n_turns, string_agg(role || ': ' || content, chr(10) order by k) as talk from g join (select distinct row_id as id, case lower(trim(task)) when 'writing' then 'Generation' when 'summarization' then 'Summarize' else source end as category from sft_train) using (id) group by all")
def f2_no_robots(t):
    """Conversations with a category that names their task."""
    category = F.when(F.lower(F.trim("task")) == "writing", "Generation").when(F.lower(F.trim("task")) == "summarization", "Summarize").otherwise(F.col("source"))
    rows = t("sft_train").select("row_id", "task", "source", "messages").distinct().select(F.col("row_id").alias("id"), category.alias("category"), N.parse_turns(F.col("messages")).alias("messages"))
    out = N.conversations("no-robots", rows)
    return out.select("id", "task", F.size("messages").cast("bigint").alias("n_turns"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("talk"))


@query(f"""
with d as (select doc_id as id, string_split(text, chr(10)) as lines from documents where source = 'smoltalk' and text is not null),
e as (select id, i, case when i % 2 = 1 then 'user' else 'assistant' end as role, {clean('lines[i]')} as content from d, unnest(range(1, len(lines) + 1)) as x(i)),
n as (select *, row_number() over (partition by id order by i) as k, count(*) over (partition by id) as n from e where content <> ''),
g as (select *, first_value(role) over (partition by id order by k) as opens, max(case when k = n then role end) over (partition by id) as ends from n)
select id, count(*) as n_turns, string_agg(role || ': ' || content, chr(10) order by k) as talk from g where n >= 2 and opens = 'user' and (k < n or ends = 'assistant') group by id""")
def f3_soda(t):
    """Dialogues given as a list of lines: speakers alternate, a last line without an answer goes."""
    rows = t("documents").where("source = 'smoltalk' and text is not null").select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("dialogue"))
    out = N.conversations("soda", rows)
    return out.select("id", F.size("messages").cast("bigint").alias("n_turns"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("talk"))


# ---------------------------------------------------------------- preference pairs


def preference(name: str, schema: str, fields: dict[str, str], sql: str, doc: str) -> None:
    """Registers a query of ``(id, prompt, chosen, rejected)``; a prompt of several turns is one text."""
    duck, spark = shaped(fields, PAIRS, "row_id")

    def run(t):
        out = N.preferences(schema, spark(t), "some-source", "helpful")
        return out.select("id", F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("prompt"), "chosen", "rejected")

    run.__name__, run.__doc__ = name, doc
    query(f"with s as ({duck})\n{sql}")(run)


_ASKED = "'What of ' || source || '?'"
preference(
    "f19_hh_transcript", "hh_transcript",
    {"chosen": f"NEWLINE || 'Human: ' || {_ASKED} || NEWLINE || 'Assistant: ' || chosen", "rejected": f"NEWLINE || 'Human: ' || case when length(rejected) % 4 = 0 then 'Another' else {_ASKED} end || NEWLINE || 'Assistant: ' || rejected"},
    f"""select id, 'user: ' || q as prompt, c as chosen, r as rejected from (select row_id as id, {clean("'What of ' || source || '?'")} as q, {clean('chosen')} as c, {clean('rejected')} as r from {PAIRS}
    where chosen is not null and rejected is not null and source is not null and length(rejected) % 4 <> 0) where c <> '' and r <> '' and not regexp_matches(c || r, '\\n\\n(Human|Assistant):')""",
    "Flat transcripts that share their prompt; replies end them.",
)
preference(
    "f20_hh_prompt_pair", "hh_prompt_pair", {"prompt": f"NEWLINE || 'Human: ' || {_ASKED} || NEWLINE || 'Assistant: Well.' || NEWLINE || 'Human: Go on.' || NEWLINE || 'Assistant:'", "chosen": "chosen", "rejected": "rejected"},
    f"""select id, 'user: ' || q || chr(10) || 'assistant: Well.' || chr(10) || 'user: Go on.' as prompt, c as chosen, r as rejected from (select row_id as id, {clean("'What of ' || source || '?'")} as q, {clean('chosen')} as c, {clean('rejected')} as r from {PAIRS}
    where source is not null) where c <> '' and r <> ''""",
    "A transcript of several turns before two bare replies.",
)
preference(
    "f22_system_input_pair", "system_input_pair",
    {"system": "case when length(chosen) % 2 = 0 then 'Be brief.' else null end", "input": _ASKED, "chosen": "chosen", "rejected": "rejected", "status": "case when length(rejected) % 7 = 0 then 'tie' else null end", "rating": "ONE(length(chosen) % 10, length(rejected) % 10)"},
    f"""select id, 'user: ' || case when y <> '' then y{_LINES}q else q end as prompt, c as chosen, r as rejected from (select id, status, rating, {clean('system')} as y, {clean('"input"')} as q, {clean('chosen')} as c, {clean('rejected')} as r from s)
    where q <> '' and c <> '' and r <> '' and coalesce(status, '') <> 'tie' and not coalesce(rating[1] <= rating[2], false)""",
    "Pairs with a system text, a status and two ratings; ties and pairs rated the other way go.",
)
preference(
    "f23_shp", "shp", {"history": _ASKED, "human_ref_A": "chosen", "human_ref_B": "rejected", "labels": "case when length(chosen) % 5 = 0 then null else length(chosen) % 2 end"},
    f"""select id, 'user: ' || h as prompt, case when labels = 1 then a else b end as chosen, case when labels = 1 then b else a end as rejected
    from (select id, labels, {clean('history')} as h, {clean('"human_ref_A"')} as a, {clean('"human_ref_B"')} as b from s) where h <> '' and a <> '' and b <> '' and labels is not null""",
    "Two human replies and a label that names the better one.",
)


@query(f"""
with m as (select distinct row_id as id, prompt, chosen, rejected from dpo_train where json_valid(prompt) and json_type(prompt) = 'ARRAY' and chosen is not null and rejected is not null),
e as (select id, i, lower(trim(coalesce(json_extract_string(prompt, '$[' || i || '].role'), json_extract_string(prompt, '$[' || i || '].from'), ''))) as r,
   {clean("coalesce(json_extract_string(prompt, '$[' || i || '].content'), json_extract_string(prompt, '$[' || i || '].value'))")} as content from m, unnest(range(0, json_array_length(prompt)::bigint)) as x(i)),
k as (select id, i, case r when 'human' then 'user' when 'gpt' then 'assistant' else r end as role, content from e where content <> '' and r in ('user', 'assistant', 'human', 'gpt')),
p as (select id, arg_min(role, i) as first_role, string_agg(role || ': ' || content, chr(10) order by i) as prompt from k group by id)
select id, p.prompt, {clean('chosen')} as chosen, {clean('rejected')} as rejected from p join m using (id) where first_role = 'user' and {clean('chosen')} <> '' and {clean('rejected')} <> ''""")
def f21_pairs(t):
    """Preference rows rebuilt from full message lists, branches with one prompt only."""
    rows = t("dpo_train").select("row_id", "prompt", "chosen", "rejected").distinct().withColumn("p", N.parse_turns(F.col("prompt"))).where("p is not null")
    branch = lambda c: F.concat("p", F.array(N.message("assistant", F.col(c)))).cast(N.MESSAGES)
    made = rows.where("chosen is not null and rejected is not null").select(F.col("row_id").alias("id"), branch("chosen").alias("chosen"), branch("rejected").alias("rejected"))
    out = N.preferences("messages_pair", made, "ultrafeedback", "helpful")
    return out.select("id", F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("prompt"), "chosen", "rejected")


@query(f"""
with a as (select id, status, rating, {clean('system')} as y, {clean('"input"')} as q, {clean('chosen')} as a, {clean('rejected')} as b from ({shaped({"system": "'Be brief.'", "input": _ASKED, "chosen": "chosen", "rejected": "rejected", "status": "'ok'", "rating": "ONE(5, 1)"}, PAIRS, "row_id")[0]})),
p as (select * from a where q <> '' and a <> '' and b <> ''), {SIMILAR},
r as (select case when length(a) not between 8 and 4000 or length(b) not between 8 and 4000 then 'length' when alike then 'similar' else 'kept' end as reason from m)
select 'orca-dpo' as source, reason, count(*) as n from r group by reason union all select 'orca-dpo', 'malformed', (select count(*) from a) - (select count(*) from p) where (select count(*) from a) > (select count(*) from p)""")
def f25_preference_cache(t):
    """Counts by reason of a cache of one source: malformed, length, similar or kept."""
    rows = shaped({"system": "'Be brief.'", "input": _ASKED, "chosen": "chosen", "rejected": "rejected", "status": "'ok'", "rating": "ONE(5, 1)"}, PAIRS, "row_id")[1](t)
    return N.preference_cache({"orca-dpo": ("system_input_pair", "instruct", rows)})[1]
