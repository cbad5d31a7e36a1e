"""The registered queries of this package, each with the SQL it must equal where SQL can say it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import chat, exact, licences, lm, mixing, packing, phrases, pii, simhash, suffix, topk, toxicity, trie
from pagewright.llm.common import table
from pagewright.plans.registry import query
from pagewright.session import stored

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op4_exact_dedup", f"""
with d as (select doc_id, {_LOWER} t from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(t) as text_sha256
from d window w as (partition by t)""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_classes(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("_row")


@query("op3_kneser_ney")
def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexities(table(spark, sf_dir, "documents"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


_INT = "list_transform(embedding, lambda c: cast(floor(cast(c as double) * 256) as bigint))"


@query("op10_threshold_top_k", f"""
with v as (select vec_id, {_INT} x from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint score
      from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) "rank", vec_id, score from s)
select * from r where "rank" <= 5""")
def op10_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search_table(table(spark, sf_dir, "embeddings"))


@query("op6_chat_prefix_tree", r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, length(text) + len(regexp_extract_all(text, '</?\\*s>|\[/?\\*INST\]')) as n from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(case when role = 'assistant' then 7 + n else 14 + length(role) + n end) as bigint) as formatted_chars
from e group by conv_id""")
def op6_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    walked = stored(chat.paths(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)), "paths")
    return chat.read_back(walked, stored(chat.tree(walked), "tree"))


@query("op5_personal_data")
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


@query("op13_licence_scan")
def op13_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.labelled(table(spark, sf_dir, "documents"))


#: crc32 of a decimal number as text: each byte goes into the register, which then moves eight bits.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({0}::varchar, ''),
    lambda ch: [ord(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end))"""


@query("op12_conversation_trie", rf"""
with raw as (select conv_id, turn, length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '') as said,
               len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) as w from conversations where conv_id is not null),
t as (select conv_id, sha256(said) as mark, w, row_number() over (partition by conv_id order by turn nulls first, sha256(said)) - 1 as pos from raw),
c as (select conv_id, conv_id - conv_id % 20 as lead, count(*) as n, {_CRC.format("conv_id")} % 4 as h from t group by conv_id),
hd as (select c.conv_id, c.lead, c.h, least(c.h, coalesce(l.n, 0)) as head from c left join c l on l.conv_id = c.lead),
r as (select hd.conv_id, t.pos, mark, w from hd join t on t.conv_id = hd.lead and t.pos < hd.head
      union all select t.conv_id, t.pos - h + head, mark, w from t join hd on hd.conv_id = t.conv_id where t.pos >= h),
p as (select c.conv_id, coalesce(list(mark order by pos) filter (mark is not null), []) as path, coalesce(list(w order by pos) filter (mark is not null), []) as ws
      from c left join r on r.conv_id = c.conv_id group by c.conv_id),
pre as (select conv_id, d, path[1:d] as key, case when d > 0 then ws[d] else 0 end as w, d = len(path) as last from p, lateral (select unnest(range(0, len(path) + 1)) as d)),
node as (select d, key, count(*) as n, min(conv_id) as m, max(w) as w, string_agg(conv_id::varchar, ',' order by conv_id) filter (last) as ends from pre group by d, key),
kid as (select d - 1 as d, key[1:d - 1] as key, count(*) as k from node where d > 0 group by all),
f as (select node.*, coalesce(k, 0) as k from node left join kid on kid.d = node.d and kid.key = node.key),
up as (select a as d, key[1:a] as key, count(*) filter (k = 0) as leaves, sum((n - 1) * w) as saved from f, lateral (select unnest(range(0, d + 1)) as a) group by all)
select f.m as conv_id, f.d as depth, o.m as parent_conv_id, f.n as n_convs, f.k as n_children, up.leaves as n_leaves, cast(up.saved as bigint) as saved_tokens,
       sha256(coalesce(f.ends, '')) as ends_sha256
from f join up on up.d = f.d and up.key = f.key left join node o on o.d = f.d - 1 and o.key = f.key[1:f.d - 1]""")
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.led_trie(table(spark, sf_dir, "conversations"))


@query("op11_phrases", r"""
with w as (select coalesce(lang, 'und') as lang, list_transform(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]'),
    lambda p: regexp_extract_all(p, '[^\x20\x09]+')) as pieces from documents),
p as (select lang, unnest(pieces) as ws from w),
g as (select lang, ws[i:i + k - 1] as ph, k from p, lateral (select unnest(range(1, 5)) as k) x, lateral (select unnest(range(1, greatest(len(ws) - k + 2, 1))) as i) y),
f as (select lang, ph, k, count(*) as f from g group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select lang, ph, k, f as a from f where k > 1 and f >= 30),
cut as (select c.lang, c.ph, c.k, c.a, u.i, l.f as l, r.f as r, cast(2000000::hugeint * c.a // (l.f + r.f) as bigint) as score
    from c, lateral (select unnest(range(1, c.k)) as i) u join f l on l.lang = c.lang and l.ph = c.ph[1:u.i] join f r on r.lang = c.lang and r.ph = c.ph[u.i + 1:c.k]),
best as (select lang, ph, a, k, min(score) as score, arg_min(l, score * 10 + i) as l, arg_min(r, score * 10 + i) as r from cut group by lang, ph, a, k),
sub as (select lang, c.ph[i:i + s - 1] as ph, max(a) as most from c, lateral (select unnest(range(2, c.k)) as s) x, lateral (select unnest(range(1, c.k - s + 2)) as i) y group by all),
kept as (select best.* from best left join sub on sub.lang = best.lang and sub.ph = best.ph where coalesce(100 * most < 80 * a, true)),
o as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(ph, ' ')) as rank, array_to_string(ph, ' ') as phrase, a, l, r, score from kept)
select o.lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from o join n on n.lang = o.lang where rank <= 2000""")
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.listed(table(spark, sf_dir, "documents"))
