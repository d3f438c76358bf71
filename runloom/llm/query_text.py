"""Queries of the operators on repeated text: op1, op3 and op8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import decontaminate, items_digest
from .line_dedup import line_dedup
from .ngram_jaccard import link_counts, ngram_jaccard_join
from .shared import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members = ngram_jaccard_join(table(spark, sf_dir, "documents"), k=5, percent=80, every_link=False)
    return members.select("doc_id", "n_shingles", "component_id")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
             else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as gs from w),
g as (select doc_id, len(gs) as n, unnest(gs) as gram from s),
p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as o from g a join g b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
l as (select a, b from p where 100 * o >= 80 * (na + nb - o)),
e as (select a, b from l union select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a, min(b) as m from r group by a)
select s.doc_id, len(s.gs) as n_shingles, least(s.doc_id, coalesce(c.m, s.doc_id)) as component_id from s left join c on c.a = s.doc_id
"""


def op1_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = ngram_jaccard_join(table(spark, sf_dir, "documents"), k=5, percent=80)
    return link_counts(links, members).select("doc_id", "n_shingles", "n_links")


OP1_LINKS_SQL = OP1_SQL[: OP1_SQL.index("e as (")] + """e as (select a, b from l union all select b, a from l),
c as (select a, count(*) as n from e group by a)
select s.doc_id, len(s.gs) as n_shingles, coalesce(c.n, 0) as n_links from s left join c on c.a = s.doc_id
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=3)
    return docs.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP3_SQL = """
with l as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
w as (select doc_id, len(ls) as n, unnest(range(0, len(ls) - 2)) as p, ls from l where len(ls) >= 3),
k as (select doc_id, p, ls[p + 1:p + 3] as key from w),
r as (select doc_id, p, row_number() over (partition by key order by doc_id, p) as o from k),
c as (select doc_id, list_distinct(flatten(list([p, p + 1, p + 2]))) as places from r where o > 1 group by doc_id),
j as (select l.doc_id, l.ls, l.text, c.places,
      list_filter(l.ls, lambda x, i: not list_contains(c.places, i - 1)) as kept from l left join c on l.doc_id = c.doc_id)
select doc_id, coalesce(len(ls), 0)::bigint as n_lines,
       case when places is null or text is null then 0 else len(ls) - len(kept) end::bigint as n_removed,
       md5(case when places is null then text else array_to_string(kept, chr(10)) end) as text_md5 from j
"""


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10, locate=False)
    contaminated = (F.col("n_hit") > 0).alias("contaminated")
    return docs.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), items_digest().alias("items_sha256"), contaminated)


_PLAIN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = rf"""
with d as (select doc_id, {_PLAIN} as ws from documents),
b as (select item_id, {_PLAIN} as ws from benchmark),
bw as (select item_id, least(len(ws), 10) as n, unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) as w from b where len(ws) > 0),
n as (select distinct n from bw),
dw as (select doc_id, n, unnest(range(1, len(ws) - n + 2)) as p, ws from d, n where len(ws) >= n),
dk as (select doc_id, n, p, array_to_string(ws[p:p + n - 1], ' ') as w from dw),
h as (select dk.doc_id, dk.p, dk.n, bw.item_id from dk join bw on dk.w = bw.w and dk.n = bw.n),
c as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + n)) as x from h) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join i using (doc_id)
"""

QUERIES = {"op8_benchmark_decontamination": op8_benchmark_decontamination, "op3_line_dedup": op3_line_dedup, "op1_ngram_jaccard_join": op1_ngram_jaccard_join, "op1_ngram_jaccard_links": op1_ngram_jaccard_links}
ORACLE_SQL = {"op8_benchmark_decontamination": OP8_SQL, "op3_line_dedup": OP3_SQL, "op1_ngram_jaccard_join": OP1_SQL, "op1_ngram_jaccard_links": OP1_LINKS_SQL}
