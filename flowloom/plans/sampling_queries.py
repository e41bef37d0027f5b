"""Registered queries over labelled flows: counting, balancing, sampling, splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.functions.labels import binary_label, canon_label
from flowloom.operators import ranking as R
from flowloom.operators import sampling as SP
from flowloom.operators import statistics as ST
from flowloom.operators.bounded import small_side
from flowloom.plans.fixtures import FLOWS, ctes, flows
from flowloom.plans.registry import query

CANON = (
    "case when lower(trim(label)) like 'ddos%' then 'DDoS' when lower(trim(label)) = 'benigntraffic' then 'Benign' "
    "else trim(label) end"
)
WITH = ctes(
    raw=FLOWS,
    f=f"select * exclude (label), {CANON} as label from raw",
    r="select *, row_number() over (partition by label order by md5(concat(flow_id, ':42')), flow_id) as rn, "
      "row_number() over (order by md5(concat(flow_id, ':42')), flow_id) as grn from f",
    c="select label, count(*) as n from f group by label",
    t="select cast(sum(n) as bigint) as total, cast(sum(n) as bigint) // 12 as cap from c",
    plan="""select label, n as available,
      case when label = 'Benign' then least(n, need) else least(n, goal) end as kept,
      case when label = 'Benign' then need else goal end as target,
      case when label = 'Benign' then 'fill' when n >= goal then 'trim' when n >= 100 then 'synthesise'
        else 'duplicate' end as way
      from (select *, greatest(total - goal * attacks, 0) as need from (select c.*, total,
        least(cap, (select n from c where label = 'DDoS')) as goal,
        (select count(*) from c where label <> 'Benign') as attacks from c, t))""",
)


def clean_flows(spark, sf_dir) -> DataFrame:
    return flows(spark, sf_dir).withColumn(S.LABEL, canon_label(F.col(S.LABEL)))


def sizes(counts: dict[str, int]) -> tuple[int, int]:
    """Cap and total that use the whole table: a twelfth of it per class."""
    total = sum(counts.values())
    return total // 12, total


@query("b08_canon_label", ctes(raw=FLOWS) + f"select flow_id, {CANON} as label from raw")
def b08(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", canon_label(F.col("label")).alias("label"))


@query("b09_binary_label", ctes(raw=FLOWS) + """select flow_id,
  case when lower(trim(label)) like 'benign%' then 'Benign' else 'Attack' end as binary_label from raw""")
def b09(spark, sf_dir):
    return flows(spark, sf_dir).select("flow_id", binary_label(F.col("label")).alias("binary_label"))


@query("g01_label_counts", WITH + """select coalesce(label, 'TOTAL') as label, count(*) as n from f
  group by rollup (label)""")
def g01(spark, sf_dir):
    return ST.label_counts(clean_flows(spark, sf_dir), total=True)


@query("g02_class_distribution", WITH + """select label, n, round(100.0::double * n / total, 6) as percent from c, t""")
def g02(spark, sf_dir):
    df = ST.class_distribution(clean_flows(spark, sf_dir))
    return df.select("label", "n", F.round("percent", 6).alias("percent"))


@query("k01_order_counts", WITH + "select label, n, row_number() over (order by n desc, label) as place from c")
def k01(spark, sf_dir):
    from pyspark.sql import Window

    counts = ST.label_counts(clean_flows(spark, sf_dir))
    ordered = Window.orderBy(F.desc("n"), "label")  # one row per class
    return counts.withColumn("place", F.row_number().over(ordered).cast("bigint"))


@query("s01_balance_plan", WITH +
       "select label, available, kept, target, greatest(target - kept, 0) as need, way from plan")
def s01(spark, sf_dir):
    counts = R.class_counts(clean_flows(spark, sf_dir), S.LABEL)
    return SP.plan_table(spark, SP.balance_plan(counts, *sizes(counts)))


@query("s02_cap_per_class", WITH + "select flow_id, label from r, t where rn <= cap")
def s02(spark, sf_dir):
    df = clean_flows(spark, sf_dir).select("flow_id", S.LABEL)
    return SP.cap_per_class(df, "flow_id", df.count() // 12)


@query("s03_downsample_exact", WITH + "select flow_id, label from r, t where grn <= cap")
def s03(spark, sf_dir):
    df = clean_flows(spark, sf_dir).select("flow_id", S.LABEL)
    return SP.downsample_exact(df, "flow_id", df.count() // 12)


_DRAWS = """, d as (select label, available as size, unnest(range(1, target - kept + 1)) as draw from plan
    where way in ({ways}) and target > kept)"""


def _index(stream: int) -> str:
    text = f"concat_ws(':', d.label, d.draw, '{stream}', '42')"
    return f"1 + cast('0x' || substr(md5({text}), 1, 15) as bigint) % d.size"


@query("s04_oversample", WITH + _DRAWS.format(ways="'duplicate', 'fill'") + f"""
select d.label, d.draw, r.flow_id from d join r on r.label = d.label and r.rn = {_index(0)}""")
def s04(spark, sf_dir):
    df = clean_flows(spark, sf_dir).select("flow_id", S.LABEL)
    counts = R.class_counts(df, S.LABEL)
    plan = SP.balance_plan(counts, *sizes(counts))
    need = {p.label: p.need for p in plan if p.way in ("duplicate", "fill")}
    out = SP.oversample(df, "flow_id", need, counts)
    return out.select("label", F.col(SP.DRAW).alias("draw"), "flow_id")


_SHOWN = [c for g in SP.COLUMN_GROUPS for c in g]  # all 46 features, by column group
_STREAM = {c: i + 1 for i, g in enumerate(SP.COLUMN_GROUPS) for c in g}


_SYNTHETIC = f"""(select e.label, e.draw, """ + ", ".join(
    f'max(case when e.stream = {_STREAM[c]} then r."{c}" end) as "{c}"' for c in _SHOWN) + f"""
  from (select {{d}}.*, unnest([1, 2, 3, 4, 5, 6]) as stream from {{d}}) e join r on r.label = e.label
  and r.rn = 1 + cast('0x' || substr(md5(concat_ws(':', e.label, e.draw, e.stream, '42')), 1, 15) as bigint) % e.size
  group by 1, 2)"""


@query("s05_synthesise", WITH + _DRAWS.format(ways="'synthesise'") + " select label, draw, " + ", ".join(
    f'"{c}" as {S.snake(c)}' for c in _SHOWN) + " from " + _SYNTHETIC.format(d="d"))
def s05(spark, sf_dir):
    df = clean_flows(spark, sf_dir)
    counts = R.class_counts(df, S.LABEL)
    need = {p.label: p.need for p in SP.balance_plan(counts, *sizes(counts)) if p.way == "synthesise"}
    out = SP.synthesise(df, "flow_id", need, counts)
    return out.select("label", F.col(SP.DRAW).alias("draw"), *[F.col(S.q(c)).alias(S.snake(c)) for c in _SHOWN])


@query("s06_append_synthetic", WITH + _DRAWS.format(ways="'duplicate', 'fill'") + f"""
select label, is_synthetic, count(*) as n from (
  select r.label, false as is_synthetic from r join plan on r.label = plan.label where way in ('duplicate', 'fill')
  union all select d.label, true from d join r on r.label = d.label and r.rn = {_index(0)}) group by 1, 2""")
def s06(spark, sf_dir):
    df = clean_flows(spark, sf_dir).select("flow_id", S.LABEL)
    counts = R.class_counts(df, S.LABEL)
    plan = [p for p in SP.balance_plan(counts, *sizes(counts)) if p.way in ("duplicate", "fill")]
    real = df.filter(F.col(S.LABEL).isin([p.label for p in plan]))
    extra = SP.oversample(df, "flow_id", {p.label: p.need for p in plan}, counts)
    return SP.append_synthetic(real, extra).groupBy("label", "is_synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("s07_fill_benign", WITH + _DRAWS.format(ways="'fill'") + f""" select flow_id, count(*) as copies from (
  select r.flow_id from r join plan on r.label = plan.label where way = 'fill' and rn <= kept
  union all select r.flow_id from d join r on r.label = d.label and r.rn = {_index(0)}) group by flow_id""")
def s07(spark, sf_dir):
    df = clean_flows(spark, sf_dir).select("flow_id", S.LABEL)
    counts = R.class_counts(df, S.LABEL)
    fill = next(p for p in SP.balance_plan(counts, *sizes(counts)) if p.way == "fill")
    kept = R.take_random(df, S.LABEL, "flow_id", {fill.label: fill.kept}, counts)
    extra = SP.oversample(df, "flow_id", {fill.label: fill.need}, counts)
    both = SP.append_synthetic(kept, extra)
    return both.groupBy("flow_id").agg(F.count(F.lit(1)).alias("copies"))


_SHOWN_SQL = ", ".join(f'r."{c}"' for c in _SHOWN)


@query("s08_balanced_dataset", WITH + _DRAWS.format(ways="'duplicate', 'fill'")
       + _DRAWS.format(ways="'synthesise'").replace(", d as", ", d2 as") + f""",
  allrows as (select r.label, {_SHOWN_SQL} from r join plan on r.label = plan.label where rn <= kept
    union all select d.label, {_SHOWN_SQL} from d join r on r.label = d.label and r.rn = {_index(0)}
    union all select label, {_SHOWN_SQL.replace('r.', '')} from {_SYNTHETIC.format(d="d2")})
  select label, count(*) as n, """ + ", ".join(
    f'round(sum(cast("{c}" as decimal(28,9))), 3) as {S.snake(c)}' for c in _SHOWN) + " from allrows group by label")
def s08(spark, sf_dir):
    df = clean_flows(spark, sf_dir)
    counts = R.class_counts(df, S.LABEL)
    out = SP.balanced_dataset(df, "flow_id", *sizes(counts), counts=counts)
    sums = ST.decimal_sums(out, _SHOWN, "label")
    return sums.select("label", "n", *[F.round(F.col(S.q(c)), 3).alias(S.snake(c)) for c in _SHOWN])


@query("g09_kept_report", WITH + """select label, available, kept, target, target as written,
  target - kept as synthetic, way from plan""")
def g09(spark, sf_dir):
    df = clean_flows(spark, sf_dir)
    return SP.kept_report(df, "flow_id", *sizes(R.class_counts(df, S.LABEL)))


@query("s09_stratified_sample", WITH + """select flow_id, r.label from r join c on r.label = c.label, t
  where rn <= least(n, greatest(1, cap * n // total))""")
def s09(spark, sf_dir):
    df = clean_flows(spark, sf_dir).select("flow_id", S.LABEL)
    return SP.stratified_sample(df, "flow_id", df.count() // 12)


@query("s10_random_split", WITH + """, q as (select *, cast(ceil(0.3::double * total) as bigint) as rest,
    cast(ceil(0.5::double * ceil(0.3::double * total)) as bigint) as test from t)
select flow_id, case when grn <= total - rest then 'train' when grn <= total - test then 'validation' else 'test' end
  as split from r, q""")
def s10(spark, sf_dir):
    return SP.random_split(clean_flows(spark, sf_dir).select("flow_id"), "flow_id")


def _share(name: str, source: str, count: str, total: str) -> str:
    """Largest-remainder shares of ``total`` over the classes of ``source``."""
    return f"""{name}_a as (select label, {count} as m, {count} * {total} // sum({count}) over () as q,
      {count} * {total} % sum({count}) over () as rem from {source}),
    {name} as (select label, m, cast(q + case when row_number() over (order by rem desc, label)
      <= {total} - sum(q) over () then 1 else 0 end as bigint) as share from {name}_a)"""


_REST = "(select cast(ceil(0.3::double * total) as bigint) from t)"
_TEST = "(select cast(ceil(0.5::double * ceil(0.3::double * total)) as bigint) from t)"
SPLIT_CTE = ", " + _share("rest", "c", "n", _REST) + ", " + _share("test", "rest", "share", _TEST) + """,
  split as (select r.*, case when rn <= rest.m - rest.share then 'train' when rn <= rest.m - test.share
    then 'validation' else 'test' end as split from r join rest on r.label = rest.label join test on r.label = test.label)"""


@query("s11_stratified_split", WITH + SPLIT_CTE + " select flow_id, label, split from split")
def s11(spark, sf_dir):
    df = clean_flows(spark, sf_dir).select("flow_id", S.LABEL)
    return SP.stratified_split(df, "flow_id")


@query("g03_split_counts", WITH + SPLIT_CTE + """ select split, count(*) as n,
  round(100.0::double * count(*) / (select total from t), 6) as percent from split group by split""")
def g03(spark, sf_dir):
    df = SP.stratified_split(clean_flows(spark, sf_dir).select("flow_id", S.LABEL), "flow_id")
    out = ST.class_distribution(df, "split")
    return out.select("split", "n", F.round("percent", 6).alias("percent"))


@query("s12_stratified_split_80_20", """with d as (select doc_id, lang, row_number() over (partition by lang
    order by md5(concat(doc_id, ':42')), cast(doc_id as varchar)) as rn from documents),
  c as (select lang as label, count(*) as n from documents group by 1), t as (select sum(n) as total from c), """
       + _share("test", "c", "n", "(select cast(ceil(0.2::double * total) as bigint) from t)") + """
select doc_id, lang, case when rn <= m - share then 'train' else 'test' end as split from d join test on lang = label""")
def s12(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return SP.stratified_split(df, "doc_id", by="lang", test_share=0.2)


@query("s13_head", WITH + "select flow_id, label from f order by flow_id limit (select cap from t)")
def s13(spark, sf_dir):
    df = clean_flows(spark, sf_dir).select("flow_id", S.LABEL)
    return SP.head(df, "flow_id", df.count() // 12)


@query("s14_stratified_folds", WITH + "select flow_id, label, cast((rn - 1) % 3 as int) as fold from r")
def s14(spark, sf_dir):
    return SP.stratified_folds(clean_flows(spark, sf_dir).select("flow_id", S.LABEL), "flow_id")


@query("s15_cap_first_come", """with e as (select event_id, event_type, row_number() over (partition by event_type
  order by event_id) as rn from events) select event_id, event_type from e
  where rn <= (select count(*) // 12 from events)""")
def s15(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return SP.cap_first_come(df, "event_id", df.count() // 12, by="event_type")


@query("j01_rows_with_plan", WITH + """select f.label, way, count(*) as n, min(target) as target
  from f join plan on f.label = plan.label group by 1, 2""")
def j01(spark, sf_dir):
    df = clean_flows(spark, sf_dir).select("flow_id", S.LABEL)
    counts = R.class_counts(df, S.LABEL)
    plan = SP.plan_table(spark, SP.balance_plan(counts, *sizes(counts)))
    joined = df.join(small_side(plan), S.LABEL)
    return joined.groupBy("label", "way").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target"))


@query("a11_partition_by_label", WITH + "select label, n from c")
def a11(spark, sf_dir):
    from flowloom.session import new_folder
    from flowloom.sources.tables import read_label_partition, write_by_label

    path = new_folder(spark, "labels")
    write_by_label(clean_flows(spark, sf_dir).select("flow_id", S.LABEL), path)
    return read_label_partition(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("m15_label_index", WITH + "select label, cast(row_number() over (order by label) - 1 as int) as label_id from c")
def m15(spark, sf_dir):
    from flowloom.operators.selection import label_index

    return label_index(clean_flows(spark, sf_dir))
