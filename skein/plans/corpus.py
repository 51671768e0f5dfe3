"""Queries over the corpus: scans, filters, text functions, chunks, lines and source statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.functions import chunking as C
from skein.functions import geometry as G
from skein.functions import text as X
from skein.functions.merges import pretokens
from skein.plans.base import query

# DuckDB's \s is ASCII only; Python's and Spark's (?U) white space is spelt out.
WS = r"[\s\v\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
FOREIGN = r"[^\P{L}\x{0000}-\x{024F}\x{1E00}-\x{1EFF}\x{0250}-\x{02AF}\x{2C60}-\x{2C7F}\x{A720}-\x{A7FF}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


@query("select source, text from documents where (lang = 'en' or source in ('cosmopedia', 'python-edu')) and text is not null and source is not null")
def a3_english_scan(t):
    """The documents written to a folder a source and scanned: English rows, two sources passed unchecked; text only."""
    from skein.operators.workspace import shared_folder
    from skein.sources.corpus import parquet_documents
    from skein.sources.sinks import write_corpus

    docs = t("documents").select("source", "text", F.col("lang").alias("language"))
    root = f"{shared_folder(docs.sparkSession)}/corpus-{uuid.uuid4().hex}"
    write_corpus(docs, root)
    return parquet_documents(docs.sparkSession, root)


@query("""
select row_id, origin_file from sft_train
where regexp_matches(origin_file, 'train-0000[0-9]') and not regexp_matches(origin_file, 'shell|nl2')""")
def a8_path_predicate(t):
    """Files whose path has one pattern and lacks another."""
    f = F.col("origin_file")
    return t("sft_train").where(f.rlike("train-0000[0-9]") & ~f.rlike("shell|nl2")).select("row_id", "origin_file")


@query("""
select origin_file, case when regexp_matches(lower(origin_file), 'validation|valid|dev') then 'val' else 'train' end as split, count(*) as n_rows
from (select origin_file from sft_train union all select origin_file from sft_val) where origin_file is not null group by all""")
def a10_split_by_name(t):
    """Split of each file by its name, over the union of all files."""
    files = t("sft_train").select("origin_file").unionByName(t("sft_val").select("origin_file")).where("origin_file is not null")
    split = F.when(F.lower("origin_file").rlike("validation|valid|dev"), "val").otherwise("train")
    return files.groupBy("origin_file", split.alias("split")).agg(F.count("*").alias("n_rows"))


@query("""
with p as (select distinct origin_file, string_split_regex(lower(origin_file), '[^a-z0-9]') as tokens from dpo_val where origin_file is not null)
select origin_file, not list_contains(tokens, 'test') and len(list_intersect(tokens, ['train', 'validation', 'valid', 'dev'])) > 0 as wanted,
       regexp_matches(lower(origin_file), 'train|validation|valid|dev|test') as wanted_loosely from p""")
def a16_split_tokens(t):
    """Whether a path names a wanted split, by whole tokens and by substring."""
    p = t("dpo_val").where("origin_file is not null").select("origin_file").distinct()
    tokens = F.split(F.lower("origin_file"), "[^a-z0-9]")
    wanted = ~F.array_contains(tokens, "test") & F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in ("train", "validation", "valid", "dev")]))
    loose = F.lower("origin_file").rlike("train|validation|valid|dev|test")
    return p.select("origin_file", wanted.alias("wanted"), loose.alias("wanted_loosely"))


@query(f"""
select doc_id, length(text) > 1024 as long_enough,
       length(regexp_replace(text, '{FOREIGN}', '', 'g')) >= 0.85 * length(text) as mostly_latin,
       length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as ascii_letters,
       length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) as letters
from documents where text is not null""")
def c3_text_filters(t):
    """Length, script and letter filters of each document."""
    x = F.col("text")
    return t("documents").where("text is not null").select(
        "doc_id",
        (F.length(x) > 1024).alias("long_enough"),
        X.mostly_latin(x).alias("mostly_latin"),
        F.length(F.regexp_replace(x, "[^A-Za-z]", "")).cast("long").alias("ascii_letters"),
        F.length(F.regexp_replace(x, r"[^\p{L}]", "")).cast("long").alias("letters"),
    )


@query(f"""
with l as (select page_id, {strip_sql("unnest(string_split(text, chr(10)))")} as line from (select distinct page_id, text from textbook_pages where text is not null))
select page_id, count(*) as n_lines,
       count(*) filter (where regexp_matches(line, '(?i)^\\s*(page\\s+)?\\d{{1,4}}\\s*(of\\s+\\d{{1,4}})?\\s*$')) as page_numbers,
       count(*) filter (where regexp_matches(line, '^[^a-z]{{1,40}}$')) as shouted,
       count(*) filter (where line <> '' and length(regexp_replace(line, '[^A-Za-z]', '', 'g')) < 0.55 * length(line)) as letterless
from l group by page_id""")
def c6_line_filters(t):
    """Page numbers, shouted and letterless lines of each page."""
    lines = t("textbook_pages").where("text is not null").select("page_id", "text").distinct().select("page_id", F.explode(F.split("text", "\n")).alias("raw"))
    s = X.strip(F.col("raw"))
    clean = lines.select("page_id", s.alias("line"))
    x = F.col("line")
    return clean.groupBy("page_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if(X.is_page_number(x)).alias("page_numbers"),
        F.count_if(x.rlike(X.SHOUTED)).alias("shouted"),
        F.count_if((x != "") & (F.length(F.regexp_replace(x, "[^A-Za-z]", "")) < 0.55 * F.length(x))).alias("letterless"),
    )


@query(f"""
select doc_id, regexp_replace(text, '{FOREIGN}', '', 'g') as stripped, {strip_sql(f"regexp_replace(coalesce(text, ''), '{FOREIGN}', '', 'g')")} as cleaned,
       regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') as ascii, {strip_sql("text")} as trimmed,
       regexp_replace({strip_sql("text")}, '{WS}+', ' ', 'g') as collapsed, regexp_replace(text, '<[^>]+>', ' ', 'g') as untagged from documents""")
def d1_clean_text(t):
    """Script, white space and tag cleaning of each document."""
    x = F.col("text")
    return t("documents").select(
        "doc_id", X.strip_foreign(x).alias("stripped"), X.clean(x).alias("cleaned"), X.ascii_only(x).alias("ascii"), X.strip(x).alias("trimmed"), X.collapse(x).alias("collapsed"), X.strip_tags(x).alias("untagged")
    )


@query(f"""
with recursive s(doc_id, step, rest, piece) as (
  select doc_id, 0, text, null::varchar from documents where length(text) > 1024
  union all
  select doc_id, step + 1,
         case when length(rest) <= 12288 then null else {strip_sql("substr(rest, cut + 1)")} end,
         case when length(rest) <= 12288 then rest else {strip_sql("substr(rest, 1, cut)")} end
  from (select *, case when nn > 0 then nn when dot > 0 then dot + 1 else 12288 end as cut from (
    select *, case when instr(reverse(head), chr(10) || chr(10)) > 0 then length(head) - instr(reverse(head), chr(10) || chr(10)) - 1 else 0 end as nn,
              case when instr(reverse(head), chr(10) || '.') > 0 then length(head) - instr(reverse(head), chr(10) || '.') - 1 else 0 end as dot
    from (select *, substr(rest, 1, 12289) as head from s where rest is not null)))
)
select doc_id, (row_number() over (partition by doc_id order by step) - 1)::int as chunk_no, piece as chunk
from s where piece is not null and length(piece) > 1024""")
def d6_chunks(t):
    """Pieces of long documents, cut at blank lines, sentence ends or the limit."""
    docs = t("documents").select("doc_id", "text")
    return C.corpus_chunks(docs).select("doc_id", "chunk_no", "chunk")


RUNNING_HEADERS = f"""
p as (select distinct page_id, doc, text from textbook_pages), b as (select doc, count(*) as n_pages from p where doc is not null group by doc having count(*) >= 8),
l as (select distinct doc, page_id, {strip_sql("unnest(string_split(text, chr(10)))")} as line from p where text is not null),
h as (select doc, line, n, n_pages from (select doc, line, count(*) as n from l where length(line) between 1 and 80 group by doc, line) join b using (doc) where n >= greatest(3, floor(n_pages * 0.25)))"""


@query(rf"""
with recursive {RUNNING_HEADERS},
a as (select page_id, doc, i, {strip_sql("raw")} as line from (select page_id, doc, generate_subscripts(x, 1) as i, unnest(x) as raw from (select *, string_split_regex(text, '\r\n|[\n\r\v\x0C\x1C-\x1E\x{{0085}}\x{{2028}}\x{{2029}}]') as x from p where text is not null))),
k as (select page_id, line, row_number() over (partition by page_id order by i) as k from a where line = '' or not (exists (select 1 from h where h.doc = a.doc and h.line = a.line)
  or regexp_matches(line, '(?i)^\s*(page\s+)?\d{{1,4}}\s*(of\s+\d{{1,4}})?\s*$') or regexp_matches(line, '^[^a-z]{{1,40}}$') or length(regexp_replace(line, '[^A-Za-z]', '', 'g')) / length(line) < 0.55)),
r as (select page_id, 0::bigint as k, '' as open, []::varchar[] as done from p where text is not null
  union all
  select page_id, k, case when line = '' or closes then '' else grown end, case when line = '' then case when open = '' then done else list_append(done, open) end when closes then list_append(done, grown) else done end
  from (select *, not broken and regexp_matches(line, '[.!?:;"'')\]]\s*$') and length(grown) > 600 as closes from (
    select k.page_id, k.k, k.line, r.open, r.done, regexp_matches(r.open, '[\pL\pN_]-\s*$') as broken,
      case when r.open = '' then k.line when regexp_matches(r.open, '[\pL\pN_]-\s*$') then regexp_replace(r.open, '-\s*$', '') || k.line else r.open || ' ' || k.line end as grown
    from r join k on k.page_id = r.page_id and k.k = r.k + 1))),
e as (select page_id, list_append(arg_max(done, k), arg_max(open, k)) as done from r group by page_id),
f as (select page_id, list_filter(list_transform(done, lambda x: regexp_replace({strip_sql("x")}, '{WS}+', ' ', 'g')), lambda x: length(x) >= 200 and length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 0.9 * length(regexp_replace(x, '[^\p{{L}}]', '', 'g'))) as ps from e)
select page_id, (generate_subscripts(ps, 1) - 1)::int as paragraph_no, unnest(ps) as paragraph from f""")
def d7_paragraphs(t):
    """Paragraphs of the textbook pages, running headers dropped."""
    pages = t("textbook_pages").select("page_id", "doc", "text").dropDuplicates(["page_id"])
    heads = running_headers(pages).groupBy("doc").agg(F.collect_set("line").alias("drop"))
    both = pages.join(heads, "doc", "left")
    return both.select("page_id", F.posexplode(C.paragraphs(F.col("text"), F.coalesce("drop", F.array().cast("array<string>")))).alias("paragraph_no", "paragraph"))


def running_headers(pages):
    """Lines of 1 to 80 characters that stand on a quarter of a book's pages, at least 3, in books of 8 pages or more."""
    n = pages.where("doc is not null").groupBy("doc").agg(F.count("*").alias("n_pages")).where("n_pages >= 8")
    lines = pages.select("doc", "page_id", F.explode(F.split("text", "\n")).alias("raw")).select("doc", "page_id", X.strip(F.col("raw")).alias("line"))
    once = lines.where(F.length("line").between(1, 80)).distinct()
    counts = once.groupBy("doc", "line").agg(F.count("*").alias("n"))
    return counts.join(n, "doc").where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("n_pages") * 0.25))).select("doc", "line", "n", "n_pages")


@query(f"with {RUNNING_HEADERS} select doc, line, n, n_pages from h")
def g6_running_headers(t):
    """Document frequency of lines within each book."""
    return running_headers(t("textbook_pages").select("page_id", "doc", "text").dropDuplicates(["page_id"]))


@query(r"""
select doc_id, len(s) as n_sentences, array_to_string(s, '') = text as lossless, s[1] as first_sentence
from (select doc_id, text, regexp_extract_all(text, '([^.!?]*[.!?]|[^.!?]+)', 1) as s from documents where text is not null)""")
def d35_sentences(t):
    """Sentences of each document; joined they are the text."""
    s = t("documents").where("text is not null").select("doc_id", "text", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), (F.array_join("s", "") == F.col("text")).alias("lossless"), F.get("s", F.lit(0)).alias("first_sentence"))


@query(rf"""
with b as (select doc_id, string_split_regex(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '\n[\s\v]*\n') as blocks from documents where text is not null),
s as (select doc_id, list_filter(list_transform(flatten(list_transform(blocks, lambda x: regexp_extract_all(regexp_replace({strip_sql("x")}, '{WS}+', ' ', 'g'), '([^.!?]*[.!?]|[^.!?]+)', 1))), lambda y: {strip_sql("y")}), lambda z: z <> '') as ss from b)
select doc_id, (generate_subscripts(ss, 1) - 1)::int as no, unnest(ss) as sentence from s""")
def d36_training_sentences(t):
    """ASCII training sentences of each document."""
    return t("documents").where("text is not null").select("doc_id", F.posexplode(X.training_sentences(F.col("text"))).alias("no", "sentence"))


# DuckDB's patterns cannot look ahead: a text is parted before the last of several white spaces, where it joins the next word.
_WS = WS[1:-1]
PRETOKENS = rf"""
p as (select unnest(string_split(regexp_replace(text, '([{_WS}]+)([{_WS}])([^{_WS}])', '\1' || chr(57344) || '\2\3', 'g'), chr(57344))) as piece from documents where text is not null),
w as (select word, count(*) as n from (select unnest(regexp_extract_all(piece, '(''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+)', 1)) as word from p) group by word)"""


@query(f"with {PRETOKENS} select word, n from w")
def g7_word_counts(t):
    """Frequencies of all pre-tokens: words, numbers, signs, contractions and white space."""
    words = t("documents").where("text is not null").select(F.explode(pretokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query(f"""
with {PRETOKENS}, h as (select hex(encode(word)) as x, n from w)
select pair, sum(n)::bigint as n from (select substr(x, (2 * i - 1)::int, 4) as pair, n from h, unnest(range(1, (length(x) // 2)::bigint)) as r(i)) group by pair""")
def g8_pair_counts(t):
    """Adjacent bytes within pre-tokens, weighted by their frequencies; pre-tokens are counted before they are cut."""
    counts = g7_word_counts(t).select(F.hex(F.encode("word", "UTF-8")).alias("x"), "n").where(F.length("x") >= 4)
    pairs = counts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("x") - 3, F.lit(2)), lambda i: F.col("x").substr(i, F.lit(4)))).alias("pair"), "n")
    return pairs.groupBy("pair").agg(F.sum("n").alias("n"))


@query("""
select source, count(*) as n_docs, sum(length(text))::bigint as n_chars, (sum(length(text)) // 4)::bigint as n_tokens from documents where text is not null group by source""")
def g11_totals(t):
    """Documents, characters and rough tokens of each source."""
    n = F.sum(F.length("text"))
    return t("documents").where("text is not null").groupBy("source").agg(F.count("*").alias("n_docs"), n.alias("n_chars"), F.floor(n / 4).alias("n_tokens"))


@query("""
select task, source, n, n / sum(n) over () as share from (select task, source, count(*) as n from sft_train group by task, source)""")
def g1_task_counts(t):
    """Rows of each task and source and their share of all."""
    from pyspark.sql import Window

    counts = t("sft_train").groupBy("task", "source").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # one row a pair


@query("select task, count(distinct source) as n_sources, count(distinct lower(trim(task)) || ':' || source) as n_pairs from sft_train group by task")
def g5_sources(t):
    """Distinct sources of each task."""
    return t("sft_train").groupBy("task").agg(F.count_distinct("source").alias("n_sources"), F.count_distinct(F.concat(F.lower(F.trim("task")), F.lit(":"), F.col("source"))).alias("n_pairs"))


# Columns of the tables as their description gives them.
DESCRIBED = {
    "sft_train": "row_id source task messages origin_file collected_at loaded_at",
    "dpo_train": "row_id source task prompt chosen rejected origin_file collected_at loaded_at",
    "textbook_pages": "page_id doc source page_no text scanned_at",
    "documents": "doc_id text lang source n_chars site collected_at",
    "eval_items": "item_id context choices answer task",
    "mix_targets": "stage task weight max_repeats",
    "pack_specs": "spec unit capacity",
}


@query(" union all ".join(f"select '{name}' as name, (select count(*) from {name}) as n_rows, '{columns.replace(' ', ', ')}' as columns" for name, columns in DESCRIBED.items()))
def g2_describe(t):
    """Row counts and column names from the files' footers."""
    out = None
    for name in DESCRIBED:
        table = t(name)
        one = table.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(", ".join(table.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""
select row_id, 'train' as split from sft_train where lower(trim(task)) = 'shell' union all select row_id, 'val' from sft_val where lower(trim(task)) = 'shell'""")
def j1_union(t):
    """One task of both splits, columns by name."""
    pick = lambda n, s: t(n).where(F.lower(F.trim("task")) == "shell").select("row_id", F.lit(s).alias("split"))
    return pick("sft_train", "train").unionByName(pick("sft_val", "val"))


@query("""
with have as (select distinct lower(trim(task)) as task from sft_train where trim(task) <> ''), want as (select distinct task from mix_targets where stage = 'sft')
select task, 'missing' as state from (select task from want except select task from have) union all
select task, 'unused' from (select task from have except select task from want) union all
select task, 'present' from (select task from want intersect select task from have)""")
def j2_task_sets(t):
    """Tasks with a weight, with rows, and with both."""
    have = t("sft_train").where("trim(task) <> ''").select(F.lower(F.trim("task")).alias("task")).distinct()
    want = t("mix_targets").where("stage = 'sft'").select("task").distinct()
    tag = lambda d, s: d.withColumn("state", F.lit(s))
    return tag(want.subtract(have), "missing").unionByName(tag(have.subtract(want), "unused")).unionByName(tag(want.intersect(have), "present"))


@query("select distinct task, source from sft_train")
def j3_distinct(t):
    return t("sft_train").select("task", "source").distinct()


@query("select origin_file, count(*) as n from sft_train where origin_file is not null group by 1 order by n desc, origin_file limit 5")
def i2_top_files(t):
    """The five files with most rows: a top-k report."""
    return t("sft_train").where("origin_file is not null").groupBy("origin_file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "origin_file").limit(5)


@query("""
select user_id, date_trunc('hour', ts) as hour, event_type, count(*) as n, sum(value) as total from events group by all""")
def k1_event_windows(t):
    """Hourly windows of the event table, the batch form of the streaming job."""
    return t("events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("select vec_id, label, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)) as rms from embeddings")
def g21_norms(t):
    """Norm and root mean square of each embedding."""
    total = G.squares(F.col("embedding"))
    return t("embeddings").select("vec_id", "label", F.sqrt(total).alias("norm"), F.sqrt(total / F.size("embedding")).alias("rms"))


@query("""
with e as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings),
c as (select label, i, avg(x) as m from e group by all),
d as (select vec_id, label, sum(x * m) as dot, sqrt(sum(x * x)) as a, sqrt(sum(m * m)) as b from e join c using (label, i) group by all)
select label, avg(dot / (a * b)) as mean_cosine, count(*) as n from d group by label""")
def g22_cosine_to_centre(t):
    """Mean cosine of the embeddings of a label to their mean vector."""
    return G.cosine_to_centre(t("embeddings"), "label", "embedding")


@query("""
with n as (select label, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings)
select label, count(*) as n, quantile_cont(norm, 0.25) as lower_quartile, quantile_cont(norm, 0.5) as median, quantile_cont(norm, 0.75) as upper_quartile from n group by label""")
def g22_geometry(t):
    """Quartiles of the norms of each label."""
    norm = F.sqrt(G.squares(F.col("embedding")))
    q = lambda p: F.percentile("norm", F.lit(p))
    return t("embeddings").select("label", norm.alias("norm")).groupBy("label").agg(F.count("*").alias("n"), q(0.25).alias("lower_quartile"), q(0.5).alias("median"), q(0.75).alias("upper_quartile"))


@query("select event_id, user_id, event_type, value from events where value > 50 and event_type <> 'view'")
def k3_stream_filter(t):
    """A file stream of the event table, filtered and written as it arrives."""
    from skein.streaming import jobs

    table = t("events")
    stream = jobs.read_files(table.sparkSession, table.inputFiles()[0].rsplit("/", 1)[0] + "/*events*" if len(table.inputFiles()) == 1 else table.inputFiles()[0].rsplit("/", 1)[0], table.schema)
    return jobs.run_to_table(stream.where("value > 50 and event_type <> 'view'").select("event_id", "user_id", "event_type", "value"))
