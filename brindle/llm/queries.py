"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import table
from brindle.llm.decontamination import decontaminate
from brindle.llm.lm_scoring import stupid_backoff
from brindle.llm.ngram_jaccard import ngram_jaccard_join
from brindle.llm.packing import pack
from brindle.llm.quality_rules import quality_rules
from brindle.llm.rule_ensemble import rule_ensemble
from brindle.llm.source_divergence import source_divergence
from brindle.llm.spelling_variants import spelling_variants
from brindle.llm.substring_dedup import repeated_spans
from brindle.llm.token_counts import count_tokens
from brindle.llm.tool_calls import CHAT_TOOLS, calls_of, link_tool_calls
from brindle.llm.toxicity import toxicity
from brindle.llm.warc import archive_and_read

WORD_BPE = "word_bpe_49k.json"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), within=True)


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = calls_of(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, CHAT_TOOLS).withColumn("errors", F.array_join("errors", ";"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(table(spark, sf_dir, "pages"))


def op11_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_token_counts": op2_token_counts,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_toxicity": op4_toxicity,
    "op5_tool_calls": op5_tool_calls,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_rule_ensemble": op11_rule_ensemble,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL = {
    "op5_tool_calls": """
        with recursive u as (select conv_id, turn, text, coalesce(length(text), 0) as n, conv_id || '-' || turn as call_id
                   from conversations where role = 'user'),
        c as (select *, case when turn % 2 = 0 then 'search' else 'translate' end as name from u),
        e as (select *, case when turn % 2 = 0
                then (case when n % 11 = 0 then 'extra:page' else '' end)
                     || (case when n % 11 = 0 and n % 7 = 0 then ';' else '' end)
                     || (case when n % 7 = 0 then 'missing:limit' else '' end)
                else (case when n % 5 = 0 then 'type:formal' else '' end) end as errors,
              case when turn % 2 = 0
                then '{' || (case when n % 7 <> 0 then '"limit":' || turn || ',' else '' end)
                     || (case when n % 11 = 0 then '"page":1,' else '' end) || '"query":' || to_json(text)::varchar || '}'
                else '{' || (case when n % 5 = 0 then '"formal":"yes",' else '' end) || '"target":"en","text":' || to_json(text)::varchar || '}'
              end as args from c),
        r as (select conv_id, turn as result_turn, text as content, conv_id || '-' || (turn - 1) as call_id
              from conversations where role = 'assistant'),
        edges as (select a.conv_id, a.turn, b.turn as before from u a join u b on a.conv_id = b.conv_id
              and ((a.turn % 8 >= 2 and b.turn = a.turn - 2) or (a.turn % 8 >= 6 and b.turn in (a.turn - 4, a.turn - 6)) or (a.conv_id % 9 = 4 and a.turn = 2 and b.turn = 4))),
        chains as (select conv_id, turn, 0 as depth from u union
              select e.conv_id, e.turn, depth + 1 from chains c join edges e on e.conv_id = c.conv_id and e.before = c.turn where depth < 20),
        levels as (select conv_id, turn, max(depth) as depth from chains group by all)
        select coalesce(e.conv_id, r.conv_id) as conv_id, coalesce(e.call_id, r.call_id) as call_id,
          case when e.call_id is null then 'no_call' when r.call_id is null then 'no_result' else 'linked' end as kind,
          case when depth < 20 then depth end::integer as level,
          coalesce(e.turn, r.result_turn) as turn, r.result_turn, (case when r.call_id is null then 0 else 1 end)::bigint as n_results,
          coalesce(e.errors, '') as errors,
          '{' || (case when e.call_id is null then '' else '"arguments":' || e.args || ',' end) || '"conversation":' || coalesce(e.conv_id, r.conv_id)
          || (case when coalesce(e.errors, '') = '' then '' else ',"errors":["' || replace(e.errors, ';', '","') || '"]' end)
          || ',"id":"' || coalesce(e.call_id, r.call_id) || '"' || (case when e.call_id is null then '' else ',"name":"' || e.name || '"' end)
          || (case when r.call_id is null then '' else ',"result":' || to_json(r.content)::varchar end) || '}' as json
        from e full join r on e.conv_id = r.conv_id and e.call_id = r.call_id
        left join levels l on l.conv_id = e.conv_id and l.turn = e.turn""",
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') as payload from pages),
        m as (select *, strlen(payload) >= 1000 and row_number() over w > 1 as again, first_value(page_id) over w as last from p
              window w as (partition by payload order by page_id desc nulls last))
        select page_id, strlen(payload)::bigint as payload_bytes, sha1(payload) as payload_digest,
               case when again then 'revisit' else 'response' end as record_type, case when again then last end as refers_to
        from m""",
    "op13_source_divergence": """
        with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text, row_number() over () as r from documents),
        w as (select lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
        k as (select lang, term, count(*) as n from w group by lang, term having count(distinct r) >= 10),
        l as (select lang, count(*) as v, sum(n) as total from k group by lang),
        c as (select w.lang, w.source, w.term, count(*) as n from w join k on w.lang = k.lang and w.term = k.term group by all),
        t as (select lang, source, sum(n) as total from c group by lang, source),
        g as (select g.lang, g.source, coalesce(t.total, 0) as total, coalesce(l.v, 0) as v
              from (select distinct lang, source from d) g left join t on t.lang = g.lang and t.source = g.source left join l on l.lang = g.lang),
        p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
                1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v)::hugeint as p,
                1 + (1000000000::hugeint * (k.n + 2)) // (l.total + 2 * l.v)::hugeint as q
              from g join k on k.lang = g.lang join l on l.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        two as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
                from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        pair as (select g.lang, g.source, 'pair' as part, h.source as item, coalesce(two.value, 0)::bigint as value
                 from g join g h on g.lang = h.lang and g.source <> h.source
                 left join two on two.lang = g.lang and two.source = g.source and two.item = h.source),
        term as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where n > 0 and p > q),
        r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from pair union all select * from term))
        select lang, source, part, item, value, rank::integer as rank from r where part = 'pair' or rank <= 10""",
}
