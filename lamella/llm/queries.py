"""One query per operator, over whole tables, and the SQL that some of them equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, language_id, language_model, licenses, packing, quality, secrets, simhash, token_scan
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, threshold=3)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "byte_share", "entropy"]
    return quality.rules(table(spark, sf_dir, "documents"), lang_col="lang").select(*names)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), exact=True)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, others = chat.exchanges(table(spark, sf_dir, "conversations"))
    found = chat.link(calls, results, chat.REPLY, others)
    return found.withColumnRenamed("conv", "conv_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.cross_fit(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("found")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.token_counts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_packing, op3_quality, op4_language_model, op5_chat, op6_decontaminate, op7_language_id, op8_secrets, op9_licenses, op10_token_counts)}

_WINDOWS = """
  split as (select *, case when len(words) = 0 then 0 else greatest(1, len(words) - 9) end as k from (
    select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from benchmark where text is not null)),
  windows as (select distinct item_id, words[i:i + 9] as w from (select *, unnest(range(1, k + 1)) as i from split)),
"""

ORACLE_SQL: dict[str, str] = {
    "op5_chat": """
with recursive calls as (select conv_id, turn, text, conv_id || '-' || turn as call_id, case when conv_id % 7 = 3 and turn >= 4 then 'search' else 'reply' end as name,
    case when turn >= 2 and not (conv_id % 4 = 1 and turn < 4) then conv_id || '-' || (turn - 2) end as after,
    case when conv_id % 4 in (1, 3) and turn < 2 then conv_id || '-' || (turn + 2) end as needs, (conv_id + turn) % 5 = 0 as as_text
    from conversations where role = 'user'),
  results as (select conv_id, turn as result_turn, text as content, conv_id || '-' || (turn - 1) as call_id,
    row_number() over (partition by conv_id, turn order by text nulls first) as result_no, count(*) over (partition by conv_id, turn) as n from conversations where role = 'assistant'),
  placed as (select *, row_number() over (partition by conv_id, call_id order by turn, name, text nulls first) as place from calls),
  nodes as (select conv_id, call_id, min(turn) as turn from calls group by all),
  edges as (select distinct e.* from (select conv_id, call_id, after as ref from calls union all select conv_id, call_id, needs from calls) e join nodes n on n.conv_id = e.conv_id and n.call_id = e.ref),
  reach as (select * from edges union select r.conv_id, r.call_id, e.ref from reach r join edges e on e.conv_id = r.conv_id and e.call_id = r.ref),
  cycles as (select distinct r.conv_id, r.call_id from reach r join reach s on s.conv_id = r.conv_id and s.call_id = r.ref and s.ref = r.ref),
  keys as (select n.conv_id, n.call_id, greatest(n.turn, max(m.turn)) as k from nodes n left join reach r using (conv_id, call_id) left join nodes m on m.conv_id = n.conv_id and m.call_id = r.ref
    where (n.conv_id, n.call_id) not in (select (conv_id, call_id) from cycles) group by n.conv_id, n.call_id, n.turn),
  depths as (select conv_id, call_id, k, 0::bigint as d from keys union select e.conv_id, e.call_id, c.k, p.d + 1 from depths p join edges e on e.conv_id = p.conv_id and e.ref = p.call_id join keys c on c.conv_id = e.conv_id and c.call_id = e.call_id and c.k = p.k),
  ordered as (select conv_id, call_id, k, max(d) as d from depths group by all),
  linked as (select p.*, result_no, result_turn, content, n from placed p left join results r on r.conv_id = p.conv_id and r.call_id = p.call_id and p.place = 1)
select conv_id, turn, call_id, case when place > 1 then 'duplicate' when result_no is not null then 'linked' else 'unanswered' end as status, coalesce(n, 0) as n_results, result_no, result_turn,
  case when name = 'search' then 'search: no schema' else concat_ws('; ', case when text is null then '$.prompt: missing' end, case when as_text then '$.turn: not integer' end) end as errors,
  coalesce(k, turn) as order_turn, coalesce(d, 0) as order_depth, k is null as cyclic,
  '{"arguments":{' || case when after is null then '' else '"after":{"$ref":"' || after || '"},' end || case when needs is null then '' else '"needs":{"$ref":"' || needs || '"},' end
    || case when text is null then '' else '"prompt":' || to_json(text) || ',' end || '"turn":' || case when as_text then '"' || turn || '"' else turn::varchar end || '},"id":"' || call_id
    || '","name":"' || name || '","result":' || coalesce(to_json(content)::varchar, 'null') || '}' as json
from linked left join ordered using (conv_id, call_id)
union all select conv_id, result_turn, call_id, 'orphan', 0, null, result_turn, '', result_turn, 0, false, '{"id":"' || call_id || '","result":' || coalesce(to_json(content)::varchar, 'null') || '}'
from results where (conv_id, call_id) not in (select (conv_id, call_id) from calls)
union all select conv_id, turn, null, 'message', 0, null, null, '', turn, 0, false, '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}'
from conversations where role is null or role not in ('user', 'assistant')""",
    "op6_decontaminate": f"""
with {_WINDOWS}
  docs as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as words from documents),
  sizes as (select distinct len(w) as n from windows),
  places as (select doc_id, i, n, words[i:i + n - 1] as w from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from docs, sizes where len(words) >= n)),
  found as (select doc_id, i, n, item_id from places join windows using (w)),
  hits as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from found) group by doc_id),
  items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from found group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hits using (doc_id) left join items using (doc_id)""",
}
