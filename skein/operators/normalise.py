"""Source schemas to one conversation model and one preference model.

Each normaliser maps a table of its source to ``(id, source, task, messages)`` or
``(id, source, task, prompt, chosen, rejected)``; rows that lack a required field
are dropped.  Everything is a JVM-side expression.  Draws from a pool are made by
md5(seed:id), so a row gets the same wording in any run and engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.staging import stage
from skein.operators import pools as P

SEED, THINK_SHARE = 1337, 0.75
MESSAGES = "array<struct<role:string,content:string>>"
RAW = "array<struct<role:string,content:string,from:string,value:string>>"
MIN_REPLY, MAX_REPLY, MIN_DIFFERENCE = 8, 4000, 0.02


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def exchange(prompt: Column, reply: Column) -> Column:
    return F.array(message("user", prompt), message("assistant", reply))


def parse_turns(stored: Column) -> Column:
    """Stored JSON turns, the aliases from/value and human/gpt read as role and content."""
    names = F.create_map(F.lit("human"), F.lit("user"), F.lit("gpt"), F.lit("assistant"))
    raw = F.from_json(stored.cast("string"), RAW)
    role = lambda t: F.lower(F.trim(F.coalesce(t["role"], t["from"], F.lit(""))))
    return F.transform(raw, lambda t: F.struct(F.coalesce(names[role(t)], role(t)).alias("role"), F.coalesce(t["content"], t["value"]).alias("content")))


def from_turns(turns: Column) -> Column:
    """User and assistant turns, the last system turn folded into the first user turn; null where they make no conversation."""
    cleaned = F.transform(turns, lambda t: F.struct(t["role"].alias("role"), X.clean(t["content"]).alias("content")))
    full = F.filter(cleaned, lambda t: t["content"] != "")
    system = F.try_element_at(F.filter(full, lambda t: t["role"] == "system"), F.lit(-1))["content"]
    said = F.filter(full, lambda t: t["role"].isin("user", "assistant"))
    folded = F.transform(said, lambda t, i: F.when((i == 0) & system.isNotNull(), F.struct(t["role"].alias("role"), F.concat(system, F.lit("\n\n"), t["content"]).alias("content"))).otherwise(t))
    good = (F.size(said) >= 2) & (F.get(said, F.lit(0))["role"] == "user") & F.forall(folded, lambda t: X.mostly_latin(t["content"]))
    return F.when(good, folded)


def from_dialogue(utterances: Column) -> Column:
    """Utterances by turns of user and assistant (by original place), without a last unanswered one."""
    turns = F.transform(utterances, lambda u, i: F.struct(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), X.clean(u).alias("content")))
    full = F.filter(turns, lambda t: t["content"] != "")
    ended = F.when(F.try_element_at(full, F.lit(-1))["role"] == "assistant", full).otherwise(F.slice(full, F.lit(1), F.greatest(F.size(full) - 1, F.lit(0))))
    return F.when((F.size(utterances) >= 2) & (F.size(full) >= 2) & (F.get(full, F.lit(0))["role"] == "user"), ended)


def _given(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (c != "")
    return out


def _draw(pool, tag: str) -> Column:
    return X.choose(pool, f"{SEED}-{tag}", F.col("id"))


def passage_prompt(passage: Column, question: Column) -> Column:
    return F.concat(_draw(P.QA_PROMPTS, "prompt"), F.lit("\n\nPassage:\n"), passage, F.lit("\n\nQuestion: "), question)


def squad(df: DataFrame) -> DataFrame:
    q, c = X.clean(F.col("question")), X.clean(F.col("context"))
    texts = F.col("answers.text")
    none = F.coalesce(F.size(texts), F.lit(0)) <= 0
    answer = F.when(none, _draw(P.NO_ANSWER_REPLIES, "reply")).otherwise(X.clean(F.get(texts, F.lit(0))))
    return df.where(_given(q, c, answer)).withColumn("messages", exchange(passage_prompt(c, q), answer)).withColumn("answerable", ~none)


def sciq(df: DataFrame) -> DataFrame:
    q, a, s = (X.clean(F.col(x)) for x in ("question", "correct_answer", "support"))
    return df.where(_given(q, a, s)).withColumn("messages", exchange(passage_prompt(s, q), a))


def dialogue_summary(df: DataFrame) -> DataFrame:
    d, s = X.clean(F.col("dialogue")), X.clean(F.col("summary"))
    return df.where(_given(d, s)).withColumn("messages", exchange(F.concat(_draw(P.SUMMARY_PROMPTS, "prompt"), F.lit("\n\n"), d), s))


def xsum(df: DataFrame) -> DataFrame:
    d, s = X.clean(F.col("document")), X.clean(F.col("summary"))
    return df.where(_given(d, s)).withColumn("messages", exchange(F.concat(F.lit(P.ARTICLE_PROMPT + "\n\n"), d), s))


def _sql(df: DataFrame, question: str, schema: str, answer: str) -> DataFrame:
    q, s, a = (X.clean(F.col(x)) for x in (question, schema, answer))
    prompt = F.concat(_draw(P.SQL_PROMPTS, "prompt"), F.lit("\n\nSchema:\n"), s, F.lit("\n\nQuestion: "), q)
    return df.where(_given(q, s, a)).withColumn("messages", exchange(prompt, a))


def sql_create_context(df: DataFrame) -> DataFrame:
    return _sql(df, "question", "context", "answer")


def text_to_sql(df: DataFrame) -> DataFrame:
    return _sql(df.where(~X.is_complex_sql(F.col("sql_complexity"))), "sql_prompt", "sql_context", "sql")


def smoltalk(df: DataFrame) -> DataFrame:
    return df.withColumn("messages", from_turns(F.col("messages"))).where("messages is not null")


def no_robots(df: DataFrame) -> DataFrame:
    routes = {"Generation": "writing", "Brainstorm": "writing", "Rewrite": "rewrite", "Summarize": "summarization"}
    return smoltalk(df).withColumn("route", _route("category", routes))


def _route(column: str, routes: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in routes.items() for x in pair])[F.coalesce(F.col(column), F.lit(""))]


def soda(df: DataFrame) -> DataFrame:
    return df.withColumn("messages", from_dialogue(F.col("dialogue"))).where("messages is not null")


def dolly(df: DataFrame) -> DataFrame:
    i, c, r = (X.clean(F.col(x)) for x in ("instruction", "context", "response"))
    closed = F.coalesce(F.col("category"), F.lit("")).isin("closed_qa", "open_qa", "general_qa") & (c == "")
    prompt = F.when(c == "", i).otherwise(F.concat(i, F.lit("\n\n"), c))
    routes = {"creative_writing": "writing", "brainstorming": "writing", "summarization": "summarization"}
    return df.where(_given(i, r) & ~closed).withColumn("messages", exchange(prompt, r)).withColumn("route", _route("category", routes))


def _maths(df: DataFrame) -> DataFrame:
    """Rendered from the columns _q, _steps, _final and _fallback; staged, so that no expression is written out many times."""
    think = X.chance(f"{SEED}-think", F.col("id")) < THINK_SHARE
    split = F.coalesce((F.col("_steps") != "") & (F.col("_final") != ""), F.lit(False))
    mode = F.when(split & think, F.lit("think")).when(split, F.lit("direct")).otherwise(F.lit("plain"))
    staged = stage(df, _mode=mode)
    reply = F.when(F.col("_mode") == "think", X.think_reply(F.col("_steps"), F.col("_final"))).when(F.col("_mode") == "direct", F.col("_final")).otherwise(F.coalesce("_fallback", F.lit("")))
    prompt = F.when(F.col("_mode") == "think", _draw(P.THINK_PROMPTS, "prompt")).when(F.col("_mode") == "direct", _draw(P.DIRECT_PROMPTS, "prompt")).otherwise(_draw(P.MATH_PROMPTS, "prompt"))
    out = stage(staged, _reply=reply, _prompt=prompt).where("_q <> '' and coalesce(_reply, '') <> ''")
    return out.withColumn("messages", exchange(F.concat("_prompt", F.lit("\n\n"), "_q"), F.col("_reply")))


def gsm8k(df: DataFrame) -> DataFrame:
    kept = df.where("instr(answer, '####') > 0").withColumn("_at", F.instr("answer", "####")).withColumn("_q", X.clean(F.col("question")))
    split = kept.withColumn("_steps", X.clean(F.regexp_replace(F.col("answer").substr(F.lit(1), F.col("_at") - 1), X.CALCULATOR, "")))
    split = split.withColumn("_final", X.clean(F.col("answer").substr(F.col("_at") + 4, F.length("answer"))))
    return _maths(split.where("_steps <> '' and _final <> ''").withColumn("_fallback", F.lit("")))


def _split(df: DataFrame) -> DataFrame:
    """Adds _steps and _final of the worked solution in _fallback."""
    staged = stage(stage(df, _parts=X.solution_parts(F.col("_fallback"))), _split=X.worked_solution(F.col("_parts")))
    return staged.withColumn("_steps", F.col("_split.steps")).withColumn("_final", F.col("_split.final"))


def metamath(df: DataFrame) -> DataFrame:
    kept = df.where(F.col("type").startswith("GSM")).withColumn("_q", X.clean(F.col("query"))).withColumn("_raw", X.clean(F.col("response")))
    return _maths(_split(kept.withColumn("_fallback", X.strip_markup(F.col("_raw"))).where("length(_fallback) >= 16")))


def orca_math(df: DataFrame) -> DataFrame:
    kept = df.withColumn("_q", X.clean(F.col("question"))).withColumn("_raw", X.clean(F.col("answer"))).where("length(_raw) >= 16")
    return _maths(_split(kept.withColumn("_fallback", F.regexp_replace("_raw", X.BOXED, "$1"))))


def multiple_choice(df: DataFrame) -> DataFrame:
    q = X.clean(F.col("question"))
    texts, labels = F.col("choices.text"), F.col("choices.label")
    at = F.array_position(labels, F.col("answerKey"))
    answer = X.clean(F.get(texts, (at - 1).cast("int")))
    lines = F.filter(F.transform(F.arrays_zip(texts.alias("t"), labels.alias("l")), lambda z: F.when(X.clean(z["t"]) != "", F.concat(z["l"], F.lit(") "), X.clean(z["t"])))), lambda x: x.isNotNull())
    prompt = F.concat(_draw(P.REASONING_PROMPTS, "prompt"), F.lit("\n\n"), q, F.lit("\n\n"), F.array_join(lines, "\n"))
    good = _given(q) & (F.coalesce(F.col("answerKey"), F.lit("")) != "") & (F.size(texts) == F.size(labels)) & (F.size(texts) >= 2) & (at > 0) & (answer != "")
    return df.where(good).withColumn("messages", exchange(prompt, F.concat("answerKey", F.lit(") "), answer)))


def ecqa(df: DataFrame) -> DataFrame:
    q, a = X.clean(F.col("q_text")), X.clean(F.col("q_ans"))
    given = F.filter(F.array(*[X.clean(F.col(f"q_op{i}")) for i in range(1, 6)]), lambda o: o != "")
    at = F.array_position(given, a)
    final = F.concat(F.char(at + 64), F.lit(") "), a)
    think = X.chance(f"{SEED}-think", F.col("id")) < THINK_SHARE
    reply = F.when(think, X.think_reply(F.col("taskA_pos"), final)).otherwise(final)
    prompt = F.concat(F.when(think, _draw(P.THINK_PROMPTS, "prompt")).otherwise(_draw(P.DIRECT_PROMPTS, "prompt")), F.lit("\n\n"), q, F.lit("\n\n"), X.options(given))
    return df.where(_given(q, a) & (F.size(given) >= 2) & (at > 0)).withColumn("messages", exchange(prompt, reply))


def coedit(df: DataFrame) -> DataFrame:
    s, t = X.clean(F.col("src")), X.clean(F.col("tgt"))
    body = X.split_instruction(s)
    kind = F.lower(F.trim(F.coalesce(F.col("task"), F.lit(""))))
    prompt = _draw(P.REWRITE_FALLBACK, "prompt")
    for name, pool in P.REWRITE_PROMPTS.items():
        prompt = F.when(kind == name, _draw(pool, "prompt")).otherwise(prompt)
    return df.where(_given(s, t, body) & X.mostly_latin(body) & X.mostly_latin(t)).withColumn("messages", exchange(F.concat(prompt, F.lit("\n\n"), body), t))


def shell(df: DataFrame, instruction: str, command: str) -> DataFrame:
    i, c = X.clean(F.col(instruction)), X.clean(F.col(command))
    good = _given(i, c) & X.is_one_liner(c) & ~X.is_destructive(c)
    return df.where(good).withColumn("messages", exchange(F.concat(_draw(P.SHELL_PROMPTS, "prompt"), F.lit("\n\n"), i), c))


#: source key -> (task, normaliser of a table that has a column ``id``)
CONVERSATIONS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {
    "smoltalk": ("chat", smoltalk),
    "no-robots": ("chat", no_robots),
    "soda": ("chat", soda),
    "squad-v2": ("extractive_qa", squad),
    "sciq": ("extractive_qa", sciq),
    "samsum": ("summarization", dialogue_summary),
    "dialogsum": ("summarization", dialogue_summary),
    "xsum": ("summarization", xsum),
    "sql-create-context": ("sql", sql_create_context),
    "synthetic-text-to-sql": ("sql", text_to_sql),
    "dolly": ("instruct", dolly),
    "gsm8k": ("math", gsm8k),
    "metamath": ("math", metamath),
    "orca-math": ("math", orca_math),
    "arc-challenge": ("reasoning", multiple_choice),
    "arc-easy": ("reasoning", multiple_choice),
    "commonsense-qa": ("reasoning", multiple_choice),
    "ecqa": ("reasoning", ecqa),
    "coedit": ("rewrite", coedit),
    "nl2bash": ("shell", lambda df: shell(df, "nl_command", "bash_code")),
    "nl2sh": ("shell", lambda df: shell(df, "nl", "bash")),
}


def conversations(source: str, df: DataFrame) -> DataFrame:
    """``(id, source, task, messages)`` of a table of a source; an unknown source is an error."""
    if source not in CONVERSATIONS:
        raise KeyError(f"no normaliser for source {source!r}; known: {', '.join(CONVERSATIONS)}")
    task, fn = CONVERSATIONS[source]
    out = fn(df)
    routed = F.coalesce(F.col("route"), F.lit(task)) if "route" in out.columns else F.lit(task)
    extra = [F.col("answerable")] if "answerable" in out.columns else []
    return out.select("id", F.lit(source).alias("source"), routed.alias("task"), F.col("messages").cast(MESSAGES), *extra)


# ---------------------------------------------------------------- preference pairs


def parse_transcript(c: Column) -> Column:
    """Turns of a flat transcript with Human and Assistant marks, empty ones left out."""
    text = F.concat(F.lit("\n\n"), X.strip(F.coalesce(c, F.lit(""))))
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\n\n((?:Human|Assistant):.*?)(?=\n\n(?:Human|Assistant):|\z)"), F.lit(1))
    turns = F.transform(parts, lambda p: F.struct(F.when(p.startswith("Human:"), F.lit("user")).otherwise(F.lit("assistant")).alias("role"), X.clean(F.regexp_replace(p, r"^(Human|Assistant):\s*", "")).alias("content")))
    return F.filter(turns, lambda t: t["content"] != "")


def final_reply(turns: Column) -> Column:
    """(prompt turns, last reply); null unless an assistant ends turns that a user begins."""
    last = F.try_element_at(turns, F.lit(-1))
    prompt = F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0)))
    good = (last["role"] == "assistant") & (F.size(turns) >= 2) & (F.get(turns, F.lit(0))["role"] == "user")
    return F.when(good, F.struct(prompt.alias("prompt"), last["content"].alias("reply")))


def _contents(turns: Column) -> Column:
    return F.transform(turns, lambda t: t["content"])


def _branches(df: DataFrame, chosen: Column, rejected: Column) -> DataFrame:
    both = df.withColumn("_c", final_reply(chosen)).withColumn("_r", final_reply(rejected))
    same = both.where("_c is not null and _r is not null").where(_contents(F.col("_c.prompt")) == _contents(F.col("_r.prompt")))
    return same.withColumn("prompt", F.col("_c.prompt")).withColumn("chosen", F.col("_c.reply")).withColumn("rejected", F.col("_r.reply")).drop("_c", "_r")


def hh_transcript(df: DataFrame) -> DataFrame:
    return _branches(df, parse_transcript(F.col("chosen")), parse_transcript(F.col("rejected")))


def hh_prompt_pair(df: DataFrame) -> DataFrame:
    turns = parse_transcript(F.col("prompt"))
    asked = F.when(F.try_element_at(turns, F.lit(-1))["role"] == "assistant", F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)
    out = df.withColumn("prompt", asked).withColumn("chosen", X.clean(F.col("chosen"))).withColumn("rejected", X.clean(F.col("rejected")))
    return out.where((F.size("prompt") > 0) & (F.get("prompt", F.lit(0))["role"] == "user") & _given(F.col("chosen"), F.col("rejected")))


def messages_pair(df: DataFrame) -> DataFrame:
    kept = lambda c: F.filter(F.transform(c, lambda t: F.struct(t["role"].alias("role"), X.clean(t["content"]).alias("content"))), lambda t: t["role"].isin("user", "assistant") & (t["content"] != ""))
    return _branches(df, kept(F.col("chosen")), kept(F.col("rejected")))


def system_input_pair(df: DataFrame) -> DataFrame:
    has = set(df.columns)
    field = lambda n: F.col(n) if n in has else F.lit(None)
    system = X.clean(field("system"))
    asked = X.clean(F.coalesce(F.nullif(field("input").cast("string"), F.lit("")), field("question").cast("string")))
    chosen, rejected = X.clean(F.col("chosen")), X.clean(F.col("rejected"))
    keep = _given(asked, chosen, rejected)
    if "status" in has:
        keep = keep & (F.coalesce(F.col("status"), F.lit("")) != "tie")
    if "rating" in has:
        keep = keep & ~F.coalesce((F.size("rating") == 2) & (F.get("rating", F.lit(0)) <= F.get("rating", F.lit(1))), F.lit(False))
    content = F.when(system != "", F.concat(system, F.lit("\n\n"), asked)).otherwise(asked)
    return df.where(keep).select(*[c for c in df.columns if c not in ("prompt", "chosen", "rejected")], F.array(message("user", content)).alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"))


def shp(df: DataFrame) -> DataFrame:
    h, a, b = (X.clean(F.col(x)) for x in ("history", "human_ref_A", "human_ref_B"))
    first = F.col("labels") == 1
    out = df.where(_given(h, a, b) & F.col("labels").isNotNull())
    return out.withColumn("prompt", F.array(message("user", h))).withColumn("chosen", F.when(first, a).otherwise(b)).withColumn("rejected", F.when(first, b).otherwise(a))


PREFERENCES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "hh_transcript": hh_transcript,
    "hh_prompt_pair": hh_prompt_pair,
    "messages_pair": messages_pair,
    "system_input_pair": system_input_pair,
    "shp": shp,
}


def preferences(schema: str, df: DataFrame, source: str, task: str) -> DataFrame:
    """``(id, source, task, prompt, chosen, rejected)`` of a table in one of the pair schemas."""
    if schema not in PREFERENCES:
        raise KeyError(f"no normaliser for schema {schema!r}; known: {', '.join(PREFERENCES)}")
    return PREFERENCES[schema](df).select("id", F.lit(source).alias("source"), F.lit(task).alias("task"), "prompt", "chosen", "rejected")


def drop_reason(chosen: Column, rejected: Column, similar: Column) -> Column:
    """Why a pair is dropped: malformed, length or similar, the first that holds; null where it stays."""
    c, r = F.coalesce(chosen, F.lit("")), F.coalesce(rejected, F.lit(""))
    fits = F.length(c).between(MIN_REPLY, MAX_REPLY) & F.length(r).between(MIN_REPLY, MAX_REPLY)
    return F.when((c == "") | (r == ""), F.lit("malformed")).when(~fits, F.lit("length")).when(similar, F.lit("similar"))


def greetings(rows: DataFrame, id_col: str = "row_id", stored: str = "messages") -> DataFrame:
    """``(id, source, task, messages)``: first exchanges of stored conversations that are a greeting of the user and a short reply.

    Unreadable rows, those of fewer than two turns and those that another role opens give
    nothing; both turns lose their outer white space.
    """
    turns = F.from_json(F.col(stored).cast("string"), MESSAGES)
    first, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    pair = rows.select(F.col(id_col).alias("id"), turns.alias("t")).where(F.size("t") >= 2).where(first["role"] == "user")
    said = pair.select("id", X.strip(first["content"]).alias("asked"), X.strip(second["content"]).alias("reply"))
    kept = said.where(X.is_greeting(F.col("asked")) & (F.col("reply") != "") & (X.n_words(F.col("reply")) <= X.GREETING_REPLY_WORDS))
    return kept.select("id", F.lit("smoltalk-greetings").alias("source"), F.lit("smalltalk").alias("task"), exchange(F.col("asked"), F.col("reply")).cast(MESSAGES).alias("messages"))


UNANSWERABLE_SHARE = 0.25


def conversation_cache(tables: dict[str, DataFrame], seed: int = SEED) -> DataFrame:
    """``(id, source, task, messages)`` of all sources: normalised, routed, unanswerable passages held to a quarter of what is kept.

    The order in which unanswerable ones are admitted is a seeded shuffle; sources with
    no normaliser are an error, of no tables the result is empty.
    """
    from skein.operators.mixing import cap_ratio

    out = None
    for source, table in sorted(tables.items()):
        rows = conversations(source, table)
        if "answerable" in rows.columns:
            unanswered = F.get("messages", F.lit(1))["content"].isin(*P.NO_ANSWER_REPLIES)
            rows = cap_ratio(rows, unanswered, "id", seed, UNANSWERABLE_SHARE).drop("answerable")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no source tables")
    return out


def routed_counts(cache: DataFrame) -> DataFrame:
    """``(source, task, n)``: how many rows of each source went to each task."""
    return cache.groupBy("source", "task").agg(F.count("*").alias("n"))


def preference_cache(tables: dict[str, tuple[str, str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(pairs that stay, counts by source and reason) of ``{source: (schema, task, table)}``; rows a normaliser rejects count as malformed."""
    from skein.functions.chunking import with_similar

    pairs, counts = None, None
    for source, (schema, task, table) in sorted(tables.items()):
        rows = with_similar(preferences(schema, table, source, task), "chosen", "rejected", least=MIN_DIFFERENCE)
        rows = rows.withColumn("reason", F.coalesce(drop_reason(F.col("chosen"), F.col("rejected"), F.col("similar")), F.lit("kept")))
        named = (F.lit(source).alias("source"), F.lit("malformed").alias("reason"))
        read, left = table.agg(F.count("*").alias("n")).select(*named, "n"), rows.agg((-F.count("*")).alias("n")).select(*named, "n")
        own = rows.groupBy("source", "reason").agg(F.count("*").alias("n")).unionByName(read).unionByName(left)
        kept = rows.where("reason = 'kept'").drop("similar", "reason")
        pairs = kept if pairs is None else pairs.unionByName(kept)
        counts = own if counts is None else counts.unionByName(own)
    if pairs is None:
        raise ValueError("no source tables")
    return pairs, counts.groupBy("source", "reason").agg(F.sum("n").alias("n")).where("n > 0")
