"""Registered queries over predictions, scoring, task status and set operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.functions import text as X
from flowloom.operators import evaluation as EV
from flowloom.operators.bounded import bounded_rows
from flowloom.operators import features as FE
from flowloom.operators import packets as W
from flowloom.operators import sampling as SP
from flowloom.operators import scoring as SC
from flowloom.operators import statistics as ST
from flowloom.plans import sweep as SW
from flowloom.plans.fixtures import PREDICTIONS, packets, predictions, read
from flowloom.plans.packet_queries import WITH as PACKET_WITH
from flowloom.plans.registry import query
from flowloom.plans.sampling_queries import SPLIT_CTE, WITH as FLOW_WITH, clean_flows
from flowloom.session import new_folder
from flowloom.sources import tables as IO

# "true" is a keyword in SQL, so the twin works on renamed columns.
WITH = f"with pr as (select row_id, \"true\" as t, predicted as p, inference_time from ({PREDICTIONS})) "
PER_CLASS = """, l as (select t as label from pr union select p from pr),
  cn as (select t, p, count(*) as n from pr group by 1, 2),
  pc as (select label, coalesce((select sum(n) from cn where t = label and p = label), 0) as tp,
    coalesce((select sum(n) from cn where p = label), 0) as chosen,
    coalesce((select sum(n) from cn where t = label), 0) as support from l),
  pm as (select label, support, case when chosen > 0 then tp / chosen else 0 end as pre,
    case when support > 0 then tp / support else 0 end as rec from pc),
  m as (select label, cast(pre as double) as precision, cast(rec as double) as recall,
    cast(case when pre + rec > 0 then 2 * pre * rec / (pre + rec) else 0 end as double) as f1,
    cast(support as bigint) as support from pm)"""


@query("v01_accuracy", WITH + "select round(avg(case when t = p then 1.0::double else 0 end), 6) as accuracy from pr")
def v01(spark, sf_dir):
    return EV.accuracy(predictions(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"))


@query("v02_per_class", WITH + PER_CLASS + """ select label, round(precision, 6) as precision, round(recall, 6) as recall,
  round(f1, 6) as f1, support from m""")
def v02(spark, sf_dir):
    df = EV.per_class(EV.pair_counts(predictions(spark, sf_dir)))
    return df.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("v02_per_class_zero_division", """with pr as (select cast(quality as varchar) as t, cast(toxic as varchar) || '?' as p
  from labels)""" + PER_CLASS + " select label, precision, recall, f1, support from m")
def v02_zero(spark, sf_dir):
    df = read(spark, sf_dir, "labels").select(
        F.col("quality").cast("string").alias("true"), F.concat(F.col("toxic").cast("string"), F.lit("?")).alias("predicted"))
    return EV.per_class(EV.pair_counts(df))


_WEIGHTED = """select round(sum(precision * support) / sum(support), 6) as precision_weighted,
  round(sum(recall * support) / sum(support), 6) as recall_weighted,
  round(sum(f1 * support) / sum(support), 6) as f1_weighted, cast(sum(support) as bigint) as support_total from m"""


@query("v03_weighted_prf", WITH + PER_CLASS + _WEIGHTED)
def v03(spark, sf_dir):
    df = EV.weighted(EV.per_class(EV.pair_counts(predictions(spark, sf_dir))))
    return df.select(*[F.round(c, 6).alias(c) for c in ("precision_weighted", "recall_weighted", "f1_weighted")], "support_total")


_DENSE = """ select a.label as truth, b.label as predicted, coalesce(n, 0) as n from l a cross join l b
  left join cn on cn.t = a.label and cn.p = b.label"""


@query("v04_confusion_long", WITH + PER_CLASS + _DENSE)
def v04(spark, sf_dir):
    return EV.confusion(EV.pair_counts(predictions(spark, sf_dir))).withColumnRenamed("true", "truth")


@query("j06_dense_labels", """with pr as (select cast(quality as varchar) as t, cast(toxic as varchar) || '?' as p
  from labels)""" + PER_CLASS + _DENSE)
def j06(spark, sf_dir):
    df = read(spark, sf_dir, "labels").select(
        F.col("quality").cast("string").alias("true"), F.concat(F.col("toxic").cast("string"), F.lit("?")).alias("predicted"))
    return EV.confusion(EV.pair_counts(df)).withColumnRenamed("true", "truth")


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("v04_confusion_matrix", WITH + PER_CLASS + " select label as truth, " + ", ".join(
    f"count(*) filter (p = '{c}') as {c}" for c in _TYPES) + " from l left join pr on t = label group by label")
def v04_matrix(spark, sf_dir):
    return EV.confusion_matrix(EV.pair_counts(predictions(spark, sf_dir))).withColumnRenamed("true", "truth")


@query("v05_metrics_table", WITH + PER_CLASS + f""", w as ({_WEIGHTED})
select 'accuracy' as name, round(avg(case when t = p then 1.0::double else 0 end), 6) as value from pr
union all select 'precision_weighted', precision_weighted from w union all select 'recall_weighted', recall_weighted from w
union all select 'f1_weighted', f1_weighted from w union all select 'support_total', support_total from w""")
def v05(spark, sf_dir):
    return EV.metrics_table(predictions(spark, sf_dir)).withColumn("value", F.round("value", 6))


def _f4(e: str) -> str:
    return f"printf('%.4f', {e})"


@query("v06_report", WITH + PER_CLASS + f""", w as (select sum(precision * support) / sum(support) as p, sum(recall * support) / sum(support) as r,
    sum(f1 * support) / sum(support) as f, cast(sum(support) as bigint) as n from m),
  a as (select avg(case when t = p then 1.0::double else 0 end) as a from pr),
  i as (select avg(inference_time) as mean, median(inference_time) as median, min(inference_time) as low, max(inference_time) as high,
    stddev_pop(inference_time) as std, count(inference_time) / sum(inference_time) as rate from pr),
  o as (select *, cast(row_number() over (order by label) as int) as place, sum(support) over () as total from m)
select 'OVERALL PERFORMANCE' as section, 1 as line_no, 'Accuracy: ' || {_f4("a")} as text from a
union all select 'OVERALL PERFORMANCE', 2, 'Weighted Precision: ' || {_f4("p")} from w
union all select 'OVERALL PERFORMANCE', 3, 'Weighted Recall: ' || {_f4("r")} from w
union all select 'OVERALL PERFORMANCE', 4, 'Weighted F1-Score: ' || {_f4("f")} from w
union all select 'OVERALL PERFORMANCE', 5, 'Total Samples: ' || n from w
union all select 'PER-CLASS PERFORMANCE', 0, rpad('Class', 20, ' ') || ' ' || rpad('Precision', 10, ' ') || ' ' || rpad('Recall', 10, ' ')
  || ' ' || rpad('F1-Score', 10, ' ') || ' ' || rpad('Support', 10, ' ')
union all select 'PER-CLASS PERFORMANCE', place, rpad(label, 20, ' ') || ' ' || rpad({_f4("precision")}, 10, ' ') || ' '
  || rpad({_f4("recall")}, 10, ' ') || ' ' || rpad({_f4("f1")}, 10, ' ') || ' ' || rpad(cast(support as varchar), 10, ' ') from o
union all select 'INFERENCE PERFORMANCE', 1, 'Average Inference Time: ' || {_f4("mean")} || ' seconds' from i
union all select 'INFERENCE PERFORMANCE', 2, 'Median Inference Time: ' || {_f4("median")} || ' seconds' from i
union all select 'INFERENCE PERFORMANCE', 3, 'Min Inference Time: ' || {_f4("low")} || ' seconds' from i
union all select 'INFERENCE PERFORMANCE', 4, 'Max Inference Time: ' || {_f4("high")} || ' seconds' from i
union all select 'INFERENCE PERFORMANCE', 5, 'Standard Deviation: ' || {_f4("std")} || ' seconds' from i
union all select 'INFERENCE PERFORMANCE', 6, 'Throughput: ' || printf('%.2f', rate) || ' samples/second' from i
union all select 'CLASS DISTRIBUTION', place, label || ': ' || support || ' samples (' || printf('%.1f', support * 100.0::double / total) || '%)' from o""")
def v06(spark, sf_dir):
    return EV.report(predictions(spark, sf_dir), "inference_time")


@query("v07_plot_data", WITH + PER_CLASS + """, cut as (select min(inference_time) as a, max(inference_time) as b from pr),
  h as (select cast(least(floor((inference_time - a) / (b - a) * 30), 29) as int) as bin, count(*) as n from pr, cut group by 1)
select 'class' as chart, label as x, round(f1, 6) as y from m
union all select 'time', cast(i as varchar), cast(coalesce(n, 0) as double) from (select unnest(range(30)) as i)
  left join h on bin = i""")
def v07(spark, sf_dir):
    df = predictions(spark, sf_dir)
    classes = EV.per_class(EV.pair_counts(df)).select(F.lit("class").alias("chart"), F.col("label").alias("x"), F.round("f1", 6).alias("y"))
    times = ST.histogram(df, "inference_time").select(
        F.lit("time").alias("chart"), F.col("bin").cast("string").alias("x"), F.col("n").cast("double").alias("y"))
    return classes.unionByName(times)


_OUTCOME = "case when t = p then '[SUCCESS]' else '[FAILED]' end as outcome"


@query("v08_outcome_sample", WITH + f"select row_id, t as truth, p as predicted, {_OUTCOME} from pr order by row_id limit 10")
def v08(spark, sf_dir):
    return EV.outcome_sample(predictions(spark, sf_dir), "row_id").withColumnRenamed("true", "truth")


@query("v09_loss_curves", """select event_id as step, case when event_type = 'click' then 'loss' else 'eval_loss' end as curve,
  value from events where event_type in ('click', 'view')""")
def v09(spark, sf_dir):
    log = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("step"), F.when(F.col("event_type") == "click", F.col("value")).alias("loss"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("eval_loss"))
    return EV.loss_curves(log)


@query("v10_compare_configs", WITH + """, k as (select row_id % 3 as config, t, p from pr),
  cn as (select config, t, p, count(*) as n from k group by 1, 2, 3),
  su as (select config, t as label, sum(n) as support, sum(case when t = p then n else 0 end) as tp from cn group by 1, 2),
  ch as (select config, p as label, sum(n) as chosen from cn group by 1, 2),
  fc as (select su.*, 2.0::double * tp / (support + coalesce(chosen, 0)) as f1 from su left join ch
    on su.config = ch.config and su.label = ch.label)
select config, round(sum(tp) / sum(support), 6) as accuracy, round(sum(f1 * support) / sum(support), 6) as f1_weighted
  from fc group by 1""")
def v10(spark, sf_dir):
    df = predictions(spark, sf_dir).withColumn("config", F.col("row_id") % 3)
    out = EV.compare_configs(df, "config")
    return out.select("config", F.round("accuracy", 6).alias("accuracy"), F.round("f1_weighted", 6).alias("f1_weighted"))


@query("j04_predictions_with_truth", WITH + "select t as truth, p as predicted, count(*) as n from pr group by 1, 2")
def j04(spark, sf_dir):
    df = predictions(spark, sf_dir)
    joined = EV.join_truth(df.select("row_id", "predicted"), df.select("row_id", "true"), "row_id")
    return EV.pair_counts(joined).withColumnRenamed("true", "truth")


@query("k03_label_union", WITH + "select label from (select t as label from pr union select p from pr) order by 1")
def k03(spark, sf_dir):
    return EV.labels_of(EV.pair_counts(predictions(spark, sf_dir))).orderBy("label")


@query("k02_top_k", """select event_id, value from events order by value desc, event_id desc limit 25""")
def k02(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), F.desc("event_id")).limit(25)


@query("k04_first_outcomes", WITH + f"select row_id, {_OUTCOME} from pr order by row_id limit 100")
def k04(spark, sf_dir):
    return EV.outcome_sample(predictions(spark, sf_dir), "row_id", 100).select("row_id", "outcome")


# Packets that arrive up to six minutes late, so that time and position disagree.
_LATE = "ts_us - 60000000 * (packet_no % 7)"


@query("k05_flow_positions", PACKET_WITH + f"""select packet_no, row_number() over (partition by capture_id, ip_proto, flow
  order by {_LATE}, packet_no) as place from k where has_flow""")
def k05(spark, sf_dir):
    late = packets(spark, sf_dir).withColumn("ts_us", F.expr(_LATE))
    return W.flow_positions(late).select("packet_no", "place")


@query("u01_union", """select 'orders' as source, o_orderkey as id, o_totalprice as amount from orders
  union all select 'lineitem', l_orderkey, l_extendedprice from lineitem""")
def u01(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    b = read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("amount"), F.lit("lineitem").alias("source"), F.col("l_orderkey").alias("id"))
    return a.unionByName(b)


@query("u02_name_difference", WITH + """select distinct t as label, 'truth_only' as side from pr where t not in (select p from pr where p in ('view', 'error', 'purchase'))
  union all select distinct p, 'predicted_only' from pr where p not in (select t from pr where t <> 'click')""")
def u02(spark, sf_dir):
    """Names of one side that the other does not have, either way; both sides are whole columns, told apart by value."""
    df = predictions(spark, sf_dir)
    # A difference drops what is equal only after it has matched all rows by name, and a name may be most of them.
    truth, predicted = df.select(F.col("true").alias("label")).distinct(), df.select(F.col("predicted").alias("label")).distinct()
    left = truth.subtract(predicted.filter(F.col("label").isin("view", "error", "purchase"))).withColumn("side", F.lit("truth_only"))
    right = predicted.subtract(truth.filter(F.col("label") != "click")).withColumn("side", F.lit("predicted_only"))
    return left.unionByName(right)


# ---- scoring -------------------------------------------------------------------------------------


def load_rule():
    """A stand-in for a model: three answers by inter-arrival time, followed by more words."""

    def predict(batch: pd.DataFrame) -> pd.Series:
        iat = batch["IAT"].fillna(0.0)
        answer = pd.Series("Recon-PortScan and more", index=batch.index)
        answer[iat < 0.6] = " DDoS because of the rate"
        answer[iat < 0.3] = "Benign"
        answer[iat >= 1.0] = "   "
        return answer

    return predict


_RULE = """case when "IAT" >= 1.0 then 'Unknown' when "IAT" < 0.3 then 'Benign' when "IAT" < 0.6 then 'DDoS'
  else 'Recon-PortScan' end"""


@query("x01_score_table", FLOW_WITH + f"select flow_id, {_RULE} as predicted_class from f")
def x01(spark, sf_dir):
    return SC.score_table(clean_flows(spark, sf_dir), load_rule).select("flow_id", "predicted_class")


@query("x02_score_instructions", FLOW_WITH + f"select flow_id, label as truth, {_RULE} as predicted, true as timed from f")
def x02(spark, sf_dir):
    records = X.instruction_records(clean_flows(spark, sf_dir), keep=["flow_id"])
    out = SC.score_instructions(records, load_rule, S.FEATURES)
    return out.select("flow_id", F.col("true").alias("truth"), "predicted", (F.col("inference_time") >= 0).alias("timed"))


@query("x03_score_one", FLOW_WITH + f"""select label, {_RULE} as predicted_class from f
  where flow_id in (select min(flow_id) from f group by label)""")
def x03(spark, sf_dir):
    """One flow per class, each scored on its own, as the interactive form does."""
    df = clean_flows(spark, sf_dir)
    firsts = ST.first_rows_of(df, "label", "flow_id", S.FEATURES)
    rows = [(r["label"], SC.score_one(spark, {c: v for c, v in r["first"].asDict().items() if v is not None}, load_rule))
            for r in bounded_rows(firsts)]  # one row per class
    return spark.createDataFrame(rows, "label string, predicted_class string")


@query("x05_baseline_forest")
def x05(spark, sf_dir):
    """Learnt on four fifths of every class, scored on the rest."""
    df = SP.stratified_split(FE.clean_impute(clean_flows(spark, sf_dir)), "flow_id", test_share=0.2)
    model = SC.fit_baseline(df.filter("split = 'train'"), S.FEATURES, "flow_id")
    scored = SC.apply_baseline(model, df.filter("split = 'test'")).select(F.col("label").alias("true"), F.col("predicted_class").alias("predicted"))
    return EV.confusion(EV.pair_counts(scored)).withColumnRenamed("true", "truth")


@query("a12_write_evaluation", WITH + "select t as truth, p as predicted, count(*) as n from pr group by 1, 2")
def a12(spark, sf_dir):
    folder = new_folder(spark, "evaluation")
    EV.write_evaluation(predictions(spark, sf_dir), folder, "inference_time")
    back = spark.read.schema("true string, predicted string, inference_time double").json(f"{folder}/predictions")
    return EV.pair_counts(back).withColumnRenamed("true", "truth")


# ---- task tables -----------------------------------------------------------------------------------

STATUS = """(select cast(user_id as int) as n_features, case when event_type in ('click', 'signup') then 'preprocessing'
  else 'training' end as task_type, case when value < 20 then 'FAILED' when value < 40 then 'SKIPPED' else 'SUCCESS' end
  as status, event_id from events where event_type <> 'error')"""
LATEST = f"(select * from {STATUS} qualify row_number() over (partition by n_features, task_type order by event_id desc) = 1)"
PHASES = f"""(select n_features, coalesce(bool_or(status <> 'FAILED') filter (task_type = 'preprocessing'), false) as a,
  coalesce(bool_or(status <> 'FAILED') filter (task_type = 'training'), false) as b from {LATEST} group by 1)"""
REPORT = f"""(select n_features, case when a then 'OK' else 'KO' end as preprocessing,
  case when b then 'OK' when a then 'KO' else 'SKIP' end as training,
  case when a and b then 'COMPLETE' when a then 'PARTIAL' else 'FAILED' end as result from {PHASES})"""


def latest_status(spark, sf_dir):
    """The last status per (feature count, task): a max over a struct, so no group is sorted."""
    events = read(spark, sf_dir, "events").filter("event_type <> 'error'")
    status = F.when(F.col("value") < 20, SW.FAILED).when(F.col("value") < 40, SW.SKIPPED).otherwise(SW.SUCCESS)
    task = F.when(F.col("event_type").isin("click", "signup"), "preprocessing").otherwise("training")
    rows = events.select(F.col("user_id").cast("int").alias("n_features"), task.alias("task_type"), status.alias("status"), "event_id")
    return rows.groupBy("n_features", "task_type").agg(F.max_by("status", "event_id").alias("status"))


@query("q02_status_table", f"select n_features, task_type, status from {LATEST}")
def q02(spark, sf_dir):
    return latest_status(spark, sf_dir).select("n_features", "task_type", "status")


@query("q03_phase_report", f"select * from {REPORT}")
def q03(spark, sf_dir):
    return SW.phase_report(latest_status(spark, sf_dir))


@query("q03_phase_totals", f"""select count(*) as requested, count(*) filter (preprocessing = 'OK') as prep_success,
  count(*) filter (training = 'OK') as train_success, count(*) filter (result = 'COMPLETE') as complete from {REPORT}""")
def q03_totals(spark, sf_dir):
    return SW.phase_totals(SW.phase_report(latest_status(spark, sf_dir)))


@query("j05_phases_outer", f"""select coalesce(p.n_features, t.n_features) as n_features, p.status as prep, t.status as train
  from (select * from {LATEST} where task_type = 'preprocessing') p
  full outer join (select * from {LATEST} where task_type = 'training') t on p.n_features = t.n_features""")
def j05(spark, sf_dir):
    status = latest_status(spark, sf_dir)
    prep = status.filter("task_type = 'preprocessing'").select("n_features", F.col("status").alias("prep"))
    train = status.filter("task_type = 'training'").select("n_features", F.col("status").alias("train"))
    return prep.join(train, "n_features", "full_outer")


def _requested(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("n_features"))


def _published(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return orders.groupBy(F.col("o_custkey").cast("bigint").alias("n_features")).agg(F.count(F.lit(1)).alias("total_samples"))


@query("q04_dry_run", """select c_custkey as n_features from customer
  where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F')""")
def q04(spark, sf_dir):
    return SW.to_do(_requested(spark, sf_dir), _published(spark, sf_dir))


@query("q05_inventory", """select c_custkey as n_features, n is not null as present, coalesce(n, 0) as total_samples
  from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'F' group by 1) on c_custkey = o_custkey""")
def q05(spark, sf_dir):
    return SW.inventory(_requested(spark, sf_dir), _published(spark, sf_dir))


@query("q01_sweep", FLOW_WITH + SPLIT_CTE + """ select n_features, split, label as output, count(*) as n, n_features as n_values,
  'SUCCESS' as status from split cross join (select unnest([6, 10]) as n_features) group by 1, 2, 3""")
def q01(spark, sf_dir):
    folder = new_folder(spark, "sweep")
    status, _ = SW.sweep_table(clean_flows(spark, sf_dir), "flow_id", [6, 10], folder, "lineitem")
    rows = SW.read_sweep(spark, folder).withColumn("n_values", F.size(X.parse_features(F.col("input"))))
    out = rows.groupBy("n_features", "split", "output", "n_values").agg(F.count(F.lit(1)).alias("n"))
    return out.join(status.select("n_features", "status"), "n_features").select("n_features", "split", "output", "n", "n_values", "status")

