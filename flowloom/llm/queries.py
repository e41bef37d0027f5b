"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import (
    alignment,
    decontaminate,
    exact_dedup,
    hard_negatives,
    jaccard_join,
    language,
    licences,
    line_dedup,
    mixing,
    quality,
    suffix_dedup,
    token_counts,
    url_filter,
)
from flowloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


OP2_SQL = """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "share", "n_windows")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
with d as (select doc_id, md5(coalesce(text, '')) as k, string_split(coalesce(text, ''), chr(10)) as l from documents),
w as (
  select doc_id, k, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] as w
  from (select doc_id, k, l, unnest(range(1, len(l) - 1)) as i from d where len(l) >= 3)),
again as (
  select doc_id, i from (
    select doc_id, i, row_number() over (partition by w order by doc_id, k, i) as place from w
    where regexp_matches(w, '[^\x20\x09-\x0D]'))
  where place > 1),
gone as (select distinct doc_id, unnest([i, i + 1, i + 2]) as i from again),
lines as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line from d),
kept as (
  select doc_id, count(*) as n, count(g.i) as n_removed,
         coalesce(string_agg(line, chr(10) order by l.i) filter (g.i is null), '') as t
  from lines l left join gone g using (doc_id, i) group by doc_id)
select doc_id, n::int as n_lines, n_removed::int as n_removed, sha256(t) as kept_sha256 from kept
"""


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents")).select(
        "doc_id", "licences", "n_sentences", "n_known", "spans")


def _op6_sql() -> str:
    of = licences.symbols()
    known = ", ".join(f"('{words}', '{of[name]}')" for name, words in licences.SENTENCES.items())
    patterns = licences.rule_patterns()
    names = ", ".join(f"('{p}', '{n}')" for p, n in patterns)
    rules = "|".join(p for p, _ in patterns)
    return rf"""
with known(words, c) as (values {known}), rule(p, name) as (values {names}),
d as (
  select doc_id, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{licences.SENTENCE_END}') as l
  from documents),
s as (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as t from d),
n as (select doc_id, i, trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) as words from s),
m as (
  select doc_id, coalesce(string_agg(coalesce(c, '-'), '' order by i) filter (words <> ''), '') as s
  from n left join known using (words) group by doc_id),
h as (
  select doc_id, s, regexp_extract_all(s, '{rules}') as hits, string_split_regex(s, '{rules}') as gaps from m),
p as (
  select doc_id, j, hits[j] as hit,
         len(array_to_string(gaps[1:j], '')) + len(array_to_string(hits[1:j - 1], '')) as place
  from (select *, unnest(range(1, len(hits) + 1)) as j from h)),
f as (
  select doc_id, string_agg(distinct name, ',' order by name) as licences,
         string_agg(name || '@' || place::int::varchar || '+' || len(hit)::varchar, ',' order by j) as spans
  from p join rule on p = hit group by doc_id)
select m.doc_id, coalesce(licences, '') as licences, len(s)::int as n_sentences, len(replace(s, '-', ''))::int as n_known,
       coalesce(spans, '') as spans
from m left join f on f.doc_id = m.doc_id
"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


OP7_SQL = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (
  select *, [5, 2, 1][1 + (row_number() over (order by source is null, source collate "binary") - 1) % 3] as w from s),
o as (select *, row_number() over (order by 3.0 * source_size / w, source) as place, sum(source_size) over () as total from r),
l as (
  select *, total - 3 * coalesce(sum(source_size) over (order by place rows between unbounded preceding and 1 preceding), 0)
    as remains, sum(w) over (order by place rows between current row and unbounded following) as w_left from o),
b as (select min(place) as place from l where remains::double * w / w_left::double <= 3 * source_size),
t as (
  select l.source, l.source_size,
         case when b.place is null or l.place < b.place then (3 * l.source_size)::double
              else c.remains::double * l.w / c.w_left::double end as target
  from l cross join b left join l c on c.place = b.place),
x as (select d.*, len(size::varchar) as weight from d),
g as (
  select g.*, target from (select source, weight, sum(size)::bigint as words from x group by source, weight) g
  join t on g.source is not distinct from t.source),
f as (
  select *, (target - 3 * coalesce(sum(words) over (partition by source order by weight desc
              rows between unbounded preceding and 1 preceding), 0))
          / nullif(sum(words * weight) over (partition by source order by weight desc
              rows between current row and unbounded following), 0)::double as factor from g),
c as (select source, max(weight) as chosen from f where factor * weight <= 3 group by source),
e as (
  select f.source, f.weight, f.words, f.target,
         case when f.weight <= c.chosen then least(k.factor * f.weight, 3.0) else 3.0 end as expected
  from f left join c on f.source is not distinct from c.source
  left join f k on k.source is not distinct from c.source and k.weight = c.chosen),
q as (
  select *, floor(expected + 1e-9)::bigint as copies, greatest(expected - floor(expected + 1e-9), 0.0) as odds,
         target - sum(floor(expected + 1e-9) * words) over (partition by source) as rest from e),
u as (
  select x.*, q.target, q.copies, q.odds, q.rest,
         (('0x' || substr(md5('{mixing.SEED}:' || coalesce(x.doc_id::varchar, '')), 1, 12))::bigint::double + 0.5)
           / 281474976710656.0 as u
  from x join q on x.source is not distinct from q.source and x.weight = q.weight),
v as (
  select *, case when odds <= 0 then 1.0 else u * (1.0 - odds) / (u * (1.0 - odds) + odds * (1.0 - u)) end as place from u),
z as (
  select *, coalesce(sum(size) over (partition by source order by place, doc_id rows between unbounded preceding
              and 1 preceding), 0) as before from v)
select doc_id, size, t.source_size, t.target,
       (size * (copies + case when odds > 0 and before + size / 2.0 <= rest then 1 else 0 end))::bigint as taken
from z join t on z.source is not distinct from t.source
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


OP8_SQL = r"""
with p as (
  select page_id, translate(coalesce(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1), '') as path
  from pages where instr(url, '://') > 0
  union all select page_id, '', '' from pages where url is null or instr(url, '://') = 0),
rule(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit as (
  select page_id, arg_max(rule.h || rule.p, len(rule.h || rule.p)) as rule, arg_max(verdict, len(rule.h || rule.p)) as verdict
  from p join rule on (host = rule.h or host like '%.' || rule.h) and starts_with(path, rule.p) group by page_id)
select p.page_id, host, path, rule,
       coalesce(verdict, case when list_contains(string_split(host, '.'), 'spam-farm') then 'block' else 'allow' end) as verdict
from p left join fit on p.page_id = fit.page_id
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, *language.fit(docs))


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"))


def op12_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
with r as (
  select vec_id, (case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end)::bigint as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, r.vec_id, r.label = a.label as same, list_inner_product(a.q, r.q)::bigint as score
  from r as a join r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over w)::int as rank, vec_id as negative_id, positive_score,
       score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 10
"""

QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_dedup": op5_line_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_mix_sources": op7_mix_sources,
    "op8_url_filter": op8_url_filter,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language_id": op10_language_id,
    "op11_align_tokens": op11_align_tokens,
    "op12_count_tokens": op12_count_tokens,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
    "op6_license_scan": _op6_sql(),
    "op7_mix_sources": OP7_SQL,
    "op8_url_filter": OP8_SQL,
    "op13_hard_negatives": OP13_SQL,
}
