"""Queries of the operators on URLs, conversations, vectors and sources: op4, op5, op6 and op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat_format import chat_format
from .mixing import mix_sources, quality_weights, word_count
from .neighbours import nearest
from .shared import table
from .url_filter import ALLOW, BLOCK, Rule, judge


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"))
    docs = quality_weights(docs, table(spark, sf_dir, "labels"))
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
with lab as (select doc_id, max(quality) as q from labels group by doc_id),
d as (select d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) as size,
      -ln((('0x' || substr(md5('mix:' || d.doc_id::varchar), 1, 13))::bigint + 0.5) / 4503599627370496.0)
        / (case lab.q when 1 then 2.0 when 0 then 0.5 else 1.0 end) as key
      from documents d left join lab using (doc_id)),
s as (select source, sum(size)::bigint as s, row_number() over (order by source nulls last) - 1 as n from d group by source),
w as (select *, case n % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w, 2.0::double * s as cap from s),
l as (select *, (1.5::double * sum(s) over () - coalesce(sum(cap) over (order by cap / w, n rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (order by cap / w, n rows between current row and unbounded following) as level from w),
t as (select source, s, least(cap, w * (select arg_min(level, cap / w) from l where level * w <= cap)) as target from l),
e as (select *, case when s > 0 then floor(target / s) else 0 end as whole from t),
c as (select d.*, e.s, e.target, e.whole, e.target - e.whole * e.s as rest,
      sum(size) over (partition by d.source order by key, doc_id rows between unbounded preceding and current row) - size / 2.0 as middle
      from d join e on d.source is not distinct from e.source)
select doc_id, size::bigint as size, s as source_size, target, (size * (whole + case when middle <= rest then 1 else 0 end))::bigint as taken from c
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


OP4_SQL = r"""
with t as (select conv_id, turn, coalesce(lower(trim(role)), 'unknown') as role, coalesce(text, '') as text from conversations where conv_id is not null),
c as (select conv_id, count(*) as n_turns, list(struct_pack(r := role, x := text) order by turn nulls first, role, text) as ts from t group by conv_id),
p as (select distinct ts[1:k] as ts from (select ts, unnest(range(1, len(ts))) as k from c)),
e as (select ts, min(conv_id) as conv_id, any_value(n_turns) as n_turns from c group by ts)
select e.conv_id, e.n_turns, array_to_string(list_transform(e.ts, lambda t: '<|' || replace(replace(t.r, '\', '\\'), '|', '\|') || '|>' || chr(10)
       || replace(replace(t.x, '<\', '<\\'), '<|', '<\|') || chr(10) || '<|end|>' || chr(10)), '') as rendered
from e anti join p on e.ts = p.ts
"""

def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20, pivots=256, indexed=64, searched=32, rerank=0.25)


#: Host and path rules of the query.
RULES = [Rule(BLOCK, "com/en/"), Rule(ALLOW, "example.com/en/7"), Rule(ALLOW, "net/de/"), Rule(BLOCK, "example.net/de/8"), Rule(BLOCK, "org/es/")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


QUERIES = {"op4_chat_format": op4_chat_format, "op5_nearest_neighbours": op5_nearest_neighbours, "op6_url_filter": op6_url_filter, "op10_mix_sources": op10_mix_sources}
ORACLE_SQL = {"op4_chat_format": OP4_SQL, "op10_mix_sources": OP10_SQL}
