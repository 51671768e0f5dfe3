"""Queries over token sequences: shards, windows, batches, rendering, masks and weights.

Bytes stand for tokens where a query needs ids, so that SQL can say the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions.staging import stage
from skein.operators import normalise as N
from skein.operators import tokens as T
from skein.plans.base import query

SIZE = "coalesce(octet_length(encode(text)), 0)"


def _sized(t):
    return t("documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n"))


@query(f"""
with o as (select doc_id, {SIZE} as n, coalesce(sum({SIZE}) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from documents)
select doc_id, "offset", "offset" // 100000 as first_shard, greatest("offset" + n - 1, "offset") // 100000 as last_shard from o""")
def b1_shards(t):
    """Token offset of each document and the shards it lies in."""
    return T.shard_tokens(_sized(t), ["doc_id"], F.col("n"), 100000).select("doc_id", "offset", "first_shard", "last_shard")


@query(f"""
with o as (select doc_id, {SIZE} as n, coalesce(sum({SIZE}) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as o, sum({SIZE}) over ()::bigint as total from documents),
b as (select unnest(range((o // 2049)::bigint, ((o + n - 1) // 2049 + 1)::bigint)) as block, o, n, total from o where n > 0)
select block, sum(least(o + n, (block + 1) * 2049) - greatest(o, block * 2049))::bigint as tokens, count(*) as documents from b where block < total // 2049 group by block""")
def h17_packed_blocks(t):
    """Full blocks of the packed stream; the rest at the end is left out."""
    return T.packed_blocks(_sized(t), ["doc_id"], F.col("n"), 2049)


SHARDS = f"""
s as (select (doc_id // 100)::bigint as shard, sum({SIZE})::bigint as n_tokens from documents group by 1),
w as (select shard, n_tokens, greatest(n_tokens - 1025, 0) as n_windows, coalesce(sum(greatest(n_tokens - 1025, 0)) over (order by shard rows between unbounded preceding and 1 preceding), 0)::bigint as first_window from s)"""


def _shards(t):
    return _sized(t).groupBy((F.floor(F.col("doc_id") / 100)).alias("shard")).agg(F.sum("n").alias("n_tokens"))


@query(f"with {SHARDS} select * from w")
def g12_windows(t):
    """Windows of each shard and the first window id."""
    return T.windows(_shards(t), 1024)


@query(f"with {SHARDS}, i as (select order_id * 37 as window_id from (select o_orderkey as order_id from orders)) select window_id, shard, window_id - first_window as start from i join w on window_id >= first_window and window_id < first_window + n_windows")
def e8_locate(t):
    """Shard and start of window ids, by a range join on the cumulative counts."""
    ids = t("orders").select((F.col("o_orderkey") * 37).alias("window_id"))
    return T.locate(ids, T.windows(_shards(t), 1024))


@query("""
select step, slot, (('0x' || substr(md5('1337:' || step || ':' || slot), 1, 8))::bigint % 1000000)::bigint as window_id
from (select unnest(range(0, 50)) as step), (select unnest(range(0, 8))::int as slot)""")
def h11_batch_windows(t):
    """Windows of each step, a function of seed and step alone."""
    steps = t("region").sparkSession.range(50).withColumnRenamed("id", "step")
    return T.batch_windows(steps, 1000000, 8, 1337)


@query(f"with {SHARDS} select shard, case when row_number() over (order by shard desc) <= least(2, count(*) over () - 1) then 'val' else 'train' end as split from w")
def h13_split_shards(t):
    """The last shards validate."""
    return T.split_shards(_shards(t), 2).select("shard", "split")


@query("select doc_id, (row_number() over (order by doc_id) - 1) // 32 as batch_id from documents")
def h14_batches(t):
    """Batches of 32 in order."""
    return T.batches(t("documents").select("doc_id"), ["doc_id"], 32)


@query("select doc_id from (select doc_id, row_number() over (order by md5('1337:' || doc_id), doc_id) - 1 as k from documents) where k % 4 = 1")
def h10_stride(t):
    """The documents of rank 1 of 4."""
    return T.stride(t("documents").select("doc_id"), "doc_id", 1337, 4, 1)


@query("""
with p as (select doc_id, coalesce(n_chars, 0) as n, (row_number() over (order by md5('21:' || doc_id), doc_id) - 1) // 128 as pool from documents)
select doc_id, n, pool * 16 + (row_number() over (partition by pool order by n, doc_id) - 1) // 8 as batch_id from p""")
def h16_length_buckets(t):
    """Batches of 8 of alike lengths, within pools of 16 batches."""
    return T.length_buckets(t("documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n")), "doc_id", "n", 21, 8, 16)


@query(f"select doc_id from (select doc_id, coalesce(sum({SIZE}) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as b, sum({SIZE}) over () as total from documents) where b < 0.9 * total")
def h21_head_split(t):
    """Documents that begin in the first nine tenths of the stream."""
    from skein.operators.mixing import within_budget

    docs = _sized(t)
    total = docs.agg(F.sum("n")).first()[0] or 0
    return within_budget(docs, ["doc_id"], F.col("n"), 0.9 * total).select("doc_id")


def _turns(t):
    rows = t("dpo_train").select("row_id", "prompt", "chosen").dropDuplicates(["row_id"]).withColumn("p", N.parse_turns(F.col("prompt")))
    good = rows.where("p is not null and chosen is not null and forall(p, x -> x.role in ('user', 'assistant') and x.content is not null)")
    return good.select("row_id", F.concat("p", F.array(N.message("assistant", F.col("chosen")))).cast(N.MESSAGES).alias("turns"))


def _rendered(t):
    return stage(_turns(t), r=T.render(F.col("turns"))).select("row_id", "r.ids", "r.mask")


@query("""
with m as (select distinct row_id, prompt, chosen from dpo_train where json_valid(prompt) and json_type(prompt) = 'ARRAY' and json_array_length(prompt) > 0 and chosen is not null),
e as (select row_id, chosen, lower(trim(coalesce(json_extract_string(prompt, '$[' || i || '].role'), json_extract_string(prompt, '$[' || i || '].from'), ''))) as role,
  coalesce(json_extract_string(prompt, '$[' || i || '].content'), json_extract_string(prompt, '$[' || i || '].value')) as content from m, unnest(range(0, json_array_length(prompt)::bigint)) as r(i)),
a as (select row_id, any_value(octet_length(encode(chosen))) as c, sum(octet_length(encode(content)) + 1 + (role in ('assistant', 'gpt'))::int) as n, sum(case when role in ('assistant', 'gpt') then octet_length(encode(content)) + 1 else 0 end) as s,
  bool_and(role in ('user', 'assistant', 'human', 'gpt') and content is not null) as good from e group by row_id)
select row_id, (1 + n + c + 2)::bigint as n_ids, (s + c + 1)::bigint as n_supervised from a where good""")
def d26_render(t):
    """Lengths of the rendered conversations and of their supervised part."""
    r = _rendered(t)
    total = F.aggregate("mask", F.lit(0), lambda a, m: a + m)
    return r.select("row_id", F.size("ids").cast("bigint").alias("n_ids"), total.cast("bigint").alias("n_supervised"))


TURNS = """
m as (select distinct row_id, prompt, chosen, rejected from dpo_train where json_valid(prompt) and json_type(prompt) = 'ARRAY' and json_array_length(prompt) > 0 and chosen is not null),
e as (select row_id, i, lower(trim(coalesce(json_extract_string(prompt, '$[' || i || '].role'), json_extract_string(prompt, '$[' || i || '].from'), ''))) as r,
  coalesce(json_extract_string(prompt, '$[' || i || '].content'), json_extract_string(prompt, '$[' || i || '].value')) as content from m, unnest(range(0, json_array_length(prompt)::bigint)) as x(i)),
ok as (select row_id from e group by row_id having bool_and(r in ('user', 'assistant', 'human', 'gpt') and content is not null)),
u as (select row_id, i, case r when 'human' then 'user' when 'gpt' then 'assistant' else r end as role, content from e semi join ok using (row_id)),
t as (select * from u union all select row_id, json_array_length(prompt), 'assistant', chosen from m semi join ok using (row_id)),
z as (select row_id, i, role, octet_length(encode(content)) as n, list_transform(range(0, octet_length(encode(content))), lambda k: ('0x' || substr(hex(encode(content)), (2 * k + 1)::int, 2))::int) as b from t)"""


@query(f"""
with {TURNS},
c as (select *, 1 + n + (role = 'assistant')::int as cost, case when role = 'assistant' then n + 1 else 0 end as sup, row_number() over (partition by row_id order by i) as k, count(*) over (partition by row_id) as turns from z),
f as (select *, 1 + sum(cost) over (partition by row_id order by k desc) as whole, sum(sup) over (partition by row_id order by k desc) as supervised, lead(n) over (partition by row_id order by k) as answer from c),
g as (select *, row_number() over (partition by row_id order by k) as tried from f where (k = 1 or role = 'user') and (whole <= 512 or turns - k + 1 <= 2))
select row_id, (case when whole <= 512 then whole else 512 end)::int as n_ids, supervised::int as n_supervised from g
where tried = 1 and (whole <= 512 or (turns - k + 1 = 2 and role = 'user' and 512 - (whole - n) >= 48))""")
def d26_truncated(t):
    """Conversations rendered into 512 tokens: oldest turns dropped, then the middle of the lone question."""
    r = T.rendered(_turns(t), "row_id", "turns", 512)
    return r.select("row_id", F.size("ids").alias("n_ids"), F.aggregate("mask", F.lit(0), lambda a, m: a + m).alias("n_supervised"))


@query(f"""
with {TURNS},
p as (select row_id, list_concat([256], flatten(list(list_concat(list_concat([case when role = 'user' then 260 else 261 end], b), case when role = 'assistant' then [257] else [] end) order by i))) as ids,
  list_concat([0], flatten(list(list_concat([0], list_transform(range(0, n + (role = 'assistant')::int), lambda k: (role = 'assistant')::int)) order by i))) as mask from z group by row_id)
select row_id, ids[1:len(ids) - 1] as xs, list_transform(ids[2:], lambda v, k: case when mask[k + 1] = 1 then v else -100 end) as ys from p""")
def d29_batch(t):
    """Inputs and targets of each conversation."""
    xy = stage(_rendered(t), b=T.shifted(F.col("ids"), F.col("mask")))
    return xy.select("row_id", "b.xs", "b.ys")


@query(f"""
with {TURNS},
p as (select row_id, sum(case when role = 'assistant' then n + 1 else 0 end) as s from z group by row_id),
w as (select row_id, s, case when s > 1 then least(4.0, greatest(1.0, 0.02 * (s - 1) / (1 - 0.02))) else 1.0 end as e from p)
select row_id, e::double as end_weight, (s - 1 + e)::double as total_weight from w""")
def d30_loss_weights(t):
    """Weight of the closing end of each conversation at a share of two hundredths."""
    w = stage(_rendered(t), w=T.loss_weights(F.col("ids"), F.col("mask"), 0.02, 4.0))
    return w.select("row_id", F.element_at("w", -1).alias("end_weight"), F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("total_weight"))


@query("""
select (o_orderkey // 8)::bigint as win, (o_orderkey % 8)::bigint as pos, (sum((o_orderstatus = 'F')::int) over (partition by o_orderkey // 8 order by o_orderkey) - (o_orderstatus = 'F')::int)::int as doc
from orders""")
def d31_document_ids(t):
    """Document of each token of packed windows; orders stand for tokens, finished ones for ends."""
    w = t("orders").select(F.floor(F.col("o_orderkey") / 8).alias("win"), (F.col("o_orderkey") % 8).alias("pos"), F.when(F.col("o_orderstatus") == "F", T.EOS).otherwise(1).alias("tok"))
    packed = w.groupBy("win").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("z"))  # 8 tokens a window
    ids = packed.select("win", "z", T.document_ids(F.col("z.tok")).alias("d"))
    return ids.select("win", F.explode(F.arrays_zip(F.col("z.pos").alias("pos"), F.col("d").alias("doc"))).alias("x")).select("win", "x.pos", "x.doc")


@query("""
select i as step, case when i < 100 then 0.001 * (i + 1) / 100 else 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(least(1.0, (i - 100) / 900.0) * pi()))) end as cosine,
case when i < 100 then 0.001 * (i + 1) / 100 when i < 800 then 0.001 else 0.001 * (1 - 0.9 * least(1.0, (i - 800) / 200.0)) end as wsd from (select unnest(range(0, 1001)) as i)""")
def d32_learning_rate(t):
    """The schedules over a thousand steps."""
    s = t("region").sparkSession.range(1001).withColumnRenamed("id", "step")
    x = F.col("step")
    return s.select("step", T.learning_rate(x, 1e-3, 1000, 100).alias("cosine"), T.learning_rate(x, 1e-3, 1000, 100, "wsd", decay=0.2).alias("wsd"))


@query(r"""
with e as (select user_id, event_id, length(props) as cost from events),
r as (select *, sum(cost) over (partition by user_id order by event_id desc) as s, row_number() over (partition by user_id order by event_id desc) as rn from e)
select user_id, event_id, cost from r where s <= 200 or rn = 1""")
def d28_prompt_window(t):
    """The newest turns that fit a budget; the last always.  Events stand for turns."""
    e = t("events").select("user_id", "event_id", F.length("props").cast("bigint").alias("cost"))
    return T.prompt_window(e, "user_id", "event_id", "cost", 200)


@query("""
with e as (select user_id as conv, event_id as place, case when event_type in ('view', 'click') then 'user' else 'assistant' end as role from events),
u as (select *, max(case when role = 'user' then place end) over (partition by conv) as lu from e) select conv, place, role from u where lu is null or place < lu""")
def k5_undo(t):
    """Conversations without their last exchange.  Events stand for turns."""
    e = t("events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("place"), F.when(F.col("event_type").isin("view", "click"), "user").otherwise("assistant").alias("role"))
    return T.undo(e, "conv", "place")


@query("select n, (n + 63) // 64 * 64 as padded, case when n <= 65536 then 2 else 4 end as width from (select unnest([1, 64, 50257, 65536, 65537]) as n)")
def d37_vocab(t):
    """Padded vocabulary and stored width."""
    rows = [(n, T.padded_vocab(n), T.storage_bytes(n)) for n in (1, 64, 50257, 65536, 65537)]
    return t("region").sparkSession.createDataFrame(rows, "n int, padded int, width int")


@query("""
select s_suppkey, case when b < 1024 then format('{:.1f}', b::double) || 'B' when b < 1048576 then format('{:.1f}', b / 1024.0) || 'KB' else format('{:.1f}', b / 1048576.0) || 'MB' end as size
from (select s_suppkey, s_suppkey * 3571 as b from supplier)""")
def d34_human_bytes(t):
    """Readable sizes."""
    return t("supplier").select("s_suppkey", X.human_bytes(F.col("s_suppkey") * 3571).alias("size"))


MERGES = [(105, 110), (97, 110), (262, 103), (111, 110), (111, 117)]  # in, an, ing, on, ou


@query("""
with a as (select doc_id, text, replace(replace(text, 'in', chr(57344)), 'an', chr(57345)) as x from documents where text is not null),
b as (select doc_id, text, replace(replace(replace(x, chr(57344) || 'g', chr(57346)), 'on', chr(57347)), 'ou', chr(57348)) as x from a)
select doc_id, octet_length(encode(text)) - (length(text) - length(x)) + 1 as n_ids, length(x) - length(replace(x, chr(57346), '')) as n_ing, true as lossless from b""")
def d23_encode(t):
    """Ids of every document by a table of merges, its end appended, and back."""
    from skein.functions.merges import decoder, encoder

    docs = t("documents").where("text is not null").select("doc_id", "text")
    coded = docs.withColumn("ids", encoder(MERGES, T.EOS)(F.col("text")))
    back = coded.withColumn("back", decoder(MERGES)(F.col("ids")))
    return back.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.size(F.filter("ids", lambda i: i == T.FIRST_MERGE + 2)).cast("bigint").alias("n_ing"), (F.col("back") == F.concat("text", F.lit("<|EOS|>"))).alias("lossless"))


@query(f"""
with {TURNS},
c as (select row_id, 2 + sum(1 + n) as p from z where (row_id, i) not in (select row_id, max(i) from z group by row_id) group by row_id),
d as (select c.row_id, p, octet_length(encode(chosen)) + 1 as a, octet_length(encode(rejected)) + 1 as b, greatest(octet_length(encode(chosen)), octet_length(encode(rejected))) + 1 as l from c join m using (row_id) where rejected is not null)
select row_id, case when p + l > 768 then 768 - l else p end as n_prompt, a as n_chosen, b as n_rejected from d where l + 8 < 768 and (p + l <= 768 or 768 - l - 2 >= 32)""")
def d27_pairs(t):
    """Preference pairs rendered into 768 tokens: one prompt, cut after its first two ids where it is too long, and two ended replies."""
    rows = t("dpo_train").select("row_id", "prompt", "chosen", "rejected").dropDuplicates(["row_id"]).withColumn("p", N.parse_turns(F.col("prompt")))
    good = rows.where("size(p) > 0 and chosen is not null and rejected is not null and forall(p, x -> x.role in ('user', 'assistant') and x.content is not null)")
    r = T.rendered_pairs(good, "row_id", "p", "chosen", "rejected", 768)
    return r.select("row_id", *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("prompt", "chosen", "rejected")])


@query(r"""
with a as (select doc_id, text, replace(replace(text, 'in', chr(57344)), 'an', chr(57345)) as x from documents where text is not null),
b as (select doc_id, text, replace(replace(replace(x, chr(57344) || 'g', chr(57346)), 'on', chr(57347)), 'ou', chr(57348)) as x from a),
c as (select *, octet_length(encode(text)) - (length(text) - length(x)) as n, length(x) - length(regexp_replace(x, '[\x{E000}-\x{E004}]', '', 'g')) as merged from b),
p as (select *, [k for k in range(5) if contains(x, chr((57344 + k)::int))] as ranks from c)
select doc_id, length(text) as n_chars, n as n_tokens, case when n > 0 then length(text) / n else 0 end as chars_per_token, n - merged as raw_bytes, list_max(ranks) as highest_rank from p""")
def g26_token_report(t):
    """Characters, tokens, bytes that no merge took and the highest merge rank of each text, by a table of merges."""
    from skein.functions.merges import encoder

    r = stage(t("documents").where("text is not null"), ids=encoder(MERGES)(F.col("text"))).select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "ids")
    n = F.size("ids").cast("bigint")
    rank = F.array_max(F.filter("ids", lambda i: i >= T.FIRST_MERGE)) - T.FIRST_MERGE
    return r.select("doc_id", "n_chars", n.alias("n_tokens"), F.when(n > 0, F.col("n_chars") / n).otherwise(0.0).alias("chars_per_token"), F.size(F.filter("ids", lambda i: i < 256)).cast("bigint").alias("raw_bytes"), rank.cast("bigint").alias("highest_rank"))


@query("""
with d as (select doc_id, list_transform(range(0, octet_length(encode(text))), lambda k: ('0x' || substr(hex(encode(text)), (2 * k + 1)::int, 2))::int) as b from documents where text is not null),
s as (select flatten(list(b order by doc_id)) as stream from d), n as (select (len(stream) // 100000)::bigint as full_shards, len(stream) as total, stream from s),
w as (select unnest(range(0, full_shards)) as shard, stream from n)
select shard * (100000 - 65) as window_id, stream[shard * 100000 + 1 : shard * 100000 + 65] as tokens from w""")
def h12_gathered_windows(t):
    """The first window of each full shard: documents are written to shards of bytes, indexed, located and read back."""
    from skein.operators.workspace import shared_folder
    from skein.sources import shards as S

    docs = t("documents").where("text is not null").select("doc_id", T.byte_ids(F.col("text")).alias("ids"))
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")
    index = S.write_shards(docs, ["doc_id"], "ids", folder, 256, 100_000)
    placed = T.windows(S.shard_table(spark, index), 64)
    firsts = placed.where("n_tokens = 100000").select(F.col("first_window").alias("window_id"))
    return S.gather(index, T.locate(firsts, placed), 64)
