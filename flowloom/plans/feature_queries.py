"""Registered queries over feature engineering, scores, selection and scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.operators import columns as C
from flowloom.operators import features as FE
from flowloom.operators import selection as SEL
from flowloom.operators import statistics as ST
from flowloom.plans.fixtures import FLOW_ID, ctes, read
from flowloom.plans.registry import query
from flowloom.plans.sampling_queries import WITH, clean_flows
from flowloom.schemas import q, snake
from flowloom.session import materialise_wide

FLAGS = [c for c in S.FEATURES if "flag" in c]


def _id(c: str) -> str:
    return f'"{c}"'


# ---- column operators --------------------------------------------------------------------------


@query("b04_drop_missing", WITH + 'select flow_id, "Rate" as rate from f where "Rate" is not null and label is not null')
def b04(spark, sf_dir):
    df = C.drop_missing(clean_flows(spark, sf_dir), ["label", "Rate"])
    return df.select("flow_id", F.col("Rate").alias("rate"))


@query("b05_fill_zero", WITH + "select flow_id, label, " + ", ".join(
    f"coalesce({_id(c)}, 0) as {snake(c)}" for c in S.FEATURES) + " from f")
def b05(spark, sf_dir):
    df = FE.fill_zero(clean_flows(spark, sf_dir))
    return df.select("flow_id", "label", *[F.col(q(c)).alias(snake(c)) for c in S.FEATURES])


@query("b06_clean_impute", WITH + "select flow_id, label, " + ", ".join(
    f"coalesce({_id(c)}, (select median({_id(c)}) from f)) as {snake(c)}" for c in S.FEATURES) + " from f")
def b06(spark, sf_dir):
    df = FE.clean_impute(clean_flows(spark, sf_dir))
    return df.select("flow_id", "label", *[F.col(q(c)).alias(snake(c)) for c in S.FEATURES])


@query("b07_select_features", WITH + "select " + ", ".join(f"{_id(c)} as {snake(c)}" for c in S.FEATURES[:12]) + ", label from f")
def b07(spark, sf_dir):
    df = FE.selected_columns(clean_flows(spark, sf_dir), 12)
    return df.select(*[F.col(q(c)).alias(snake(c)) for c in df.columns])


@query("b10_detect_binary", WITH + "select feature, bool_and(x in (0, 1)) as is_binary from (unpivot (select " + ", ".join(
    _id(c) for c in S.FEATURES) + " from f) on columns(*) into name feature value x) group by feature")
def b10(spark, sf_dir):
    df = clean_flows(spark, sf_dir).select(*[q(c) for c in S.FEATURES])
    binary = set(C.detect_binary(df))
    return spark.createDataFrame([(c, c in binary) for c in df.columns], "feature string, is_binary boolean")


# Columns of the fixture that hold nothing but 0 and 1.
_BINARY = {c for c in S.FEATURES if c.endswith("_flag_number")} | set(
    S.FEATURES[S.FEATURES.index("HTTP"):S.FEATURES.index("LLC") + 1]) | {"Drate"}


@query("b11_cast_binary", WITH + "select flow_id, " + ", ".join(
    f"cast({_id(c)} as int) as {snake(c)}" if c in _BINARY else f"{_id(c)} as {snake(c)}" for c in S.FEATURES) + " from f")
def b11(spark, sf_dir):
    df = clean_flows(spark, sf_dir).select("flow_id", *[F.col(q(c)).alias(snake(c)) for c in S.FEATURES])
    binary = C.detect_binary(df)
    return C.uncast_binary(C.cast_binary(df, binary), binary)


@query("b12_detect_discrete", WITH + """, u as (select feature, bool_and(x in (0, 1)) as is_binary from (unpivot (select """ + ", ".join(
    _id(c) for c in S.FEATURES) + """ from f) on columns(*) into name feature value x) group by feature),
  d as (select pos, u.feature from u join (values """ + ", ".join(f"({i}, '{c}')" for i, c in enumerate(S.FEATURES)) + """) as o(pos, feature)
    on o.feature = u.feature where is_binary union all select 1000, 'label')
select cast(row_number() over (order by pos) - 1 as int) as place, feature from d""")
def b12(spark, sf_dir):
    names = C.detect_discrete(clean_flows(spark, sf_dir).drop("flow_id"))
    return spark.createDataFrame([(i, c) for i, c in enumerate(names)], "place int, feature string")


@query("b15_default_column", WITH + """select flow_id, "IAT" as iat_variance, "Tot size" / (flow_duration + 1e-6::double)
  as flow_intensity, 1 / (flow_duration + 1e-6::double) as flow_efficiency from f""")
def b15(spark, sf_dir):
    df = clean_flows(spark, sf_dir).drop("Variance", "Number")
    made = FE.temporal_columns(df)
    return df.select("flow_id", *[made[c].alias(c) for c in ("IAT_variance", "flow_intensity", "flow_efficiency")]).toDF(
        "flow_id", "iat_variance", "flow_intensity", "flow_efficiency")


# ---- statistics --------------------------------------------------------------------------------


@query("g04_column_statistics", WITH + """select feature, count(x) as n, round(median(x), 6) as median, round(avg(x), 6) as mean,
  round(quantile_cont(x, 0.8), 6) as q80, round(stddev_pop(x), 6) as std, round(var_pop(x), 4) as variance
  from (unpivot (select """ + ", ".join(_id(c) for c in S.FEATURES) + """ from f) on columns(*) into name feature value x)
  group by feature""")
def g04(spark, sf_dir):
    df = ST.column_statistics(clean_flows(spark, sf_dir), S.FEATURES)
    return df.select("feature", "n", *[F.round(c, 6).alias(c) for c in ("median", "mean", "q80", "std")],
                     F.round("variance", 4).alias("variance"))


@query("g05_shape", WITH + "select count(*) as n_rows, 48 as n_columns from f")
def g05(spark, sf_dir):
    return ST.shape(clean_flows(spark, sf_dir))


@query("g06_time_statistics", """select count(value) as n, round(avg(value), 6) as mean, median(value) as median,
  min(value) as min, max(value) as max, round(stddev_pop(value), 6) as std, round(count(value) / sum(value), 9) as throughput
  from events""")
def g06(spark, sf_dir):
    df = ST.time_statistics(read(spark, sf_dir, "events"), "value")
    return df.select("n", F.round("mean", 6).alias("mean"), "median", "min", "max", F.round("std", 6).alias("std"),
                     F.round("throughput", 9).alias("throughput"))


@query("g07_histogram", """with e as (select min(value) as a, max(value) as b from events),
  h as (select cast(least(floor((value - a) / (b - a) * 30), 29) as int) as bin, count(*) as n from events, e group by 1)
select cast(i as int) as bin, round(a + i * ((b - a) / 30), 6) as low, round(a + (i + 1) * ((b - a) / 30), 6) as high,
  coalesce(n, 0) as n from (select unnest(range(30)) as i) cross join e left join h on h.bin = i""")
def g07(spark, sf_dir):
    df = ST.histogram(read(spark, sf_dir, "events"), "value")
    return df.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@query("g08_box_statistics", """with s as (select quantile_cont(value, 0.25) as q1, median(value) as median,
    quantile_cont(value, 0.75) as q3 from events)
select round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
  min(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_low,
  max(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as whisker_high,
  count(*) filter (value not between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)) as n_outliers
  from events, s group by q1, median, q3""")
def g08(spark, sf_dir):
    df = ST.box_statistics(read(spark, sf_dir, "events"), "value")
    return df.select(*[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "whisker_low", "whisker_high", "n_outliers")


# ---- engineered columns --------------------------------------------------------------------------

E = "1e-6::double"
_ZS = ["flow_duration", "Header_Length", "Protocol Type"]
FORMULAS = {
    "Duration_log": 'ln(1 + "Duration")', "Duration_squared": '"Duration" * "Duration"',
    "IAT_log": 'ln(1 + "IAT")', "IAT_variance": '"IAT" * "Variance"',
    "Rate_ratio": f'"Rate" / ("Srate" + {E})', "Rate_deviation": 'abs("Rate" - "Srate")',
    "flow_intensity": f'"Tot size" / (flow_duration + {E})', "flow_efficiency": f'"Number" / (flow_duration + {E})',
    **{f"{a}_{b}_corr": f"{_id(a)} * {_id(b)}" for i, a in enumerate(FE.PRODUCTS) for b in FE.PRODUCTS[i + 1:]},
    "protocol_diversity": " + ".join(_id(c) for c in FE.PROTOCOLS),
    "protocol_switching": " + ".join(f"case when {_id(c)} > 0 then 1 else 0 end" for c in FE.PROTOCOLS),
    "avg_packet_size": f'"Tot size" / ("Number" + {E})', "packet_size_variance": '"Tot size" * "Variance"',
    "flag_complexity": " + ".join(_id(c) for c in FLAGS),
    "abnormal_flags": " + ".join(f"case when {_id(c)} > mean_{c} then 1 else 0 end" for c in FLAGS),
    "header_entropy": f'-"Header_Length" * log2("Header_Length" + {E})',
    "communication_density": '"Rate" * "Duration"', "burst_indicator": 'case when "Rate" > q_rate then 1 else 0 end',
    "network_load": f'"Tot size" / ("IAT" + {E})', "congestion_indicator": 'case when "IAT" > q_iat then 1 else 0 end',
    "connection_stability": '"ack_flag_number" / ("rst_count" + 1)', "connection_quality": '1 / ("rst_count" + 1)',
    "service_diversity": '"HTTP" + "HTTPS" + "DNS"', "secure_ratio": f'"HTTPS" / ("HTTP" + "HTTPS" + {E})',
    "anomaly_score": "(" + " + ".join(f"abs({_id(c)} - m_{i}) / s_{i}" for i, c in enumerate(_ZS)) + ") / 3",
}
FORMULAS["high_anomaly"] = f"case when {FORMULAS['anomaly_score']} > 2 then 1 else 0 end"
# Sums over the table and logarithms differ in the last digit between engines; plain arithmetic does not.
ROUNDED = ["Duration_log", "IAT_log", "header_entropy", "anomaly_score"]
ENGINEERED = (
    """, i as (select * replace (coalesce("Rate", (select median("Rate") from f)) as "Rate") from f),
  st as (select quantile_cont("Rate", 0.8) as q_rate, quantile_cont("IAT", 0.8) as q_iat, """
    + ", ".join(f"avg({_id(c)}) as mean_{c}" for c in FLAGS) + ", "
    + ", ".join(f"avg({_id(c)}) as m_{i}, stddev_pop({_id(c)}) as s_{i}" for i, c in enumerate(_ZS))
    + " from i), g as (select i.*, " + ", ".join(f"{e} as {_id(c)}" for c, e in FORMULAS.items()) + " from i, st)"
)


def engineered(spark, sf_dir) -> FE.Engineered:
    return FE.engineer(clean_flows(spark, sf_dir))


def _rounded(names: list[str]) -> str:
    cells = {c: f"cast({_id(c)} as double)" for c in names}
    return ", ".join(f"{f'round({x}, 6)' if c in ROUNDED else x} as {snake(c)}" for c, x in cells.items())


def _engineered_query(name: str, columns: list[str]) -> None:
    @query(name, WITH + ENGINEERED + f" select flow_id, {_rounded(columns)} from g")
    def run(spark, sf_dir, columns=columns) -> DataFrame:
        df = engineered(spark, sf_dir).df
        cells = {c: F.col(q(c)).cast("double") for c in columns}
        return df.select("flow_id", *[
            (F.round(x, 6) if c in ROUNDED else x).alias(snake(c)) for c, x in cells.items()])


_PRODUCT_NAMES = [c for c in FORMULAS if c.endswith("_corr")]
for _name, _columns in {
    "f01_duration": ["Duration_log", "Duration_squared"],
    "f02_iat": ["IAT_log", "IAT_variance"],
    "f03_rate": ["Rate_ratio", "Rate_deviation"],
    "f04_flow": ["flow_intensity", "flow_efficiency"],
    "f05_products": _PRODUCT_NAMES,
    "f06_protocols": ["protocol_diversity", "protocol_switching"],
    "f07_packet_size": ["avg_packet_size", "packet_size_variance"],
    "f08_flags": ["flag_complexity", "abnormal_flags"],
    "f09_header_entropy": ["header_entropy"],
    "f10_communication": ["communication_density", "burst_indicator"],
    "f11_network_load": ["network_load", "congestion_indicator"],
    "f12_connection": ["connection_stability", "connection_quality"],
    "f13_services": ["service_diversity", "secure_ratio"],
    "f14_anomaly": ["anomaly_score", "high_anomaly"],
    "f16_engineer": list(FORMULAS),
}.items():
    _engineered_query(_name, _columns)

_TEMPORAL, _BEHAVIOURAL = list(FORMULAS)[:8], list(FORMULAS)[8:21]
_FAMILY = {c: "Temporal" for c in _TEMPORAL} | {c: "Behavioral" for c in _BEHAVIOURAL} | {
    c: "Network" for c in list(FORMULAS)[21:]} | {c: "Critical" for c in S.CRITICAL_FEATURES}
NAMES = [*S.FEATURES, *FORMULAS]
POSITIONS = "(values " + ", ".join(
    f"({i}, '{c}', '{_FAMILY.get(c, 'Original')}')" for i, c in enumerate(NAMES)) + ") as p(pos, feature, family)"
LONG = ENGINEERED + """, long as (unpivot (select label, """ + ", ".join(
    f"cast({_id(c)} as double) as {_id(c)}" for c in NAMES) + """ from g) on columns(* exclude (label)) into name feature value x)"""


@query("f15_families", WITH + LONG + f"""select p.feature, family, count(x) as n from {POSITIONS}
  join long on long.feature = p.feature group by 1, 2""")
def f15(spark, sf_dir):
    made = engineered(spark, sf_dir)
    names = FE.feature_names(made.df.drop("flow_id"))
    counts = ST.value_counts(materialise_wide(made.df, "engineered"), names)  # see SEL.prepare
    return spark.createDataFrame(
        [(c, made.family(c), counts[c]) for c in names], "feature string, family string, n bigint")


# ---- scores and selection ------------------------------------------------------------------------

VARIED = LONG + """, va as (select feature, var_pop(x) as v from long group by 1),
  lv as (select long.* from long join va on va.feature = long.feature where v > 0.005)"""
F_SCORES = """, cl as (select feature, label, count(*) as n, avg(x) as m, var_pop(x) as v from lv group by 1, 2),
  gm as (select feature, sum(n) as n, count(*) as k, sum(n * m) / sum(n) as m from cl group by 1),
  fs as (select cl.feature, (sum(cl.n * (cl.m - gm.m) * (cl.m - gm.m)) / (min(k) - 1))
    / nullif(sum(cl.n * v) / (min(gm.n) - min(k)), 0) as f_score from cl join gm on cl.feature = gm.feature group by 1)"""
MI_SCORES = """, b as (select feature, label, cast(least(floor(32 * percent_rank() over (partition by feature order by x)), 31)
    as int) as bucket from lv),
  jc as (select feature, bucket, label, count(*) as n from b group by 1, 2, 3),
  mi as (select feature, greatest(sum(n / total * ln(n * total / (nb * nl))), 0) as mi_score from (
    select *, cast(sum(n) over (partition by feature) as double) as total,
      cast(sum(n) over (partition by feature, bucket) as double) as nb,
      cast(sum(n) over (partition by feature, label) as double) as nl from jc) group by 1)"""


def prepared(spark, sf_dir) -> tuple[SEL.Prepared, list[str]]:
    ready = SEL.prepare(clean_flows(spark, sf_dir), "flow_id")
    return ready, ready.varied()


def f_scores(ready: SEL.Prepared, names: list[str]) -> dict[str, float]:
    return {c: f or 0.0 for c, f in ready.f_scores(names).items()}


def choice(ready: SEL.Prepared, names: list[str]) -> list[SEL.Score]:
    ready.score(names)
    return SEL.union_cap(names, ready.f, ready.mi, 12)


@query("m01_variance_filter", WITH + LONG + """ select feature, case when var_pop(x) > 0 then round(ln(var_pop(x)), 6) end
  as log_variance, var_pop(x) > 0.005 as kept from long group by 1""")
def m01(spark, sf_dir):
    ready, kept = prepared(spark, sf_dir)
    found = ready.moments
    table = spark.createDataFrame(
        [(c, found[c]["var"], c in kept) for c in ready.names], "feature string, v double, kept boolean")
    return table.select("feature", F.round(F.when(F.col("v") > 0, F.ln("v")), 6).alias("log_variance"), "kept")


@query("m02_anova_f", WITH + VARIED + F_SCORES + " select feature, round(f_score, 4) as f_score from fs")
def m02(spark, sf_dir):
    ready, names = prepared(spark, sf_dir)
    scores = spark.createDataFrame(list(ready.f_scores(names).items()), "feature string, f_score double")
    return scores.select("feature", F.round("f_score", 4).alias("f_score"))


@query("m03_mutual_info", WITH + VARIED + MI_SCORES + " select feature, round(mi_score, 6) as mi_score from mi")
def m03(spark, sf_dir):
    ready, names = prepared(spark, sf_dir)
    counts = {c: m["n"] for c, m in ready.moments.items()}
    return SEL.mutual_information(ready.df, names, counts=counts).select("feature", F.round("mi_score", 6).alias("mi_score"))


_CHOICE = F_SCORES + MI_SCORES + f""", sc as (select pos, fs.feature, coalesce(f_score, 0) as f_score, mi_score,
    row_number() over (order by coalesce(f_score, 0) desc, pos desc) <= 12 as by_f,
    row_number() over (order by mi_score desc, pos desc) <= 12 as by_mi
    from fs join mi on fs.feature = mi.feature join {POSITIONS} on p.feature = fs.feature),
  ch as (select *, (by_f or by_mi) and row_number() over (order by
    case when by_f then f_score else 0 end + case when by_mi then mi_score else 0 end desc, pos desc) <= 12 as selected
    from sc)"""


@query("m04_union_cap", WITH + VARIED + _CHOICE +
       "select row_number() over (order by pos) as place, feature from ch where selected")
def m04(spark, sf_dir):
    chosen = [s.feature for s in choice(*prepared(spark, sf_dir)) if s.selected]
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(chosen)], "place bigint, feature string")


@query("m13_score_table", WITH + VARIED + _CHOICE + """select feature, round(f_score, 4) as f_score,
  round(mi_score, 6) as mi_score, selected from ch""")
def m13(spark, sf_dir):
    table = SEL.score_table(spark, choice(*prepared(spark, sf_dir)))
    return table.select("feature", F.round("f_score", 4).alias("f_score"), F.round("mi_score", 6).alias("mi_score"), "selected")


@query("m05_rf_importance")
def m05(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    names = [f"e{i}" for i in range(len(df.select("embedding").first()[0]))]  # all vectors are equally long
    wide = df.select("vec_id", F.col("label").cast("string").alias("label"), *[
        F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    found = SEL.rf_importance(wide, names, "vec_id")
    return spark.createDataFrame(list(found.items()), "feature string, importance double")


# A feature that is the class, one that is the class in every second line of an order, one in every fourth, and two that know nothing.
PLANTED = {
    "whole": "{c}", "half": "case when l_linenumber % 2 = 1 then {c} else 0 end", "quarter": "case when l_linenumber % 4 = 1 then {c} else 0 end",
    "noise": "l_suppkey % 13", "constant": "7"}
_CLASS = "(l_partkey % 100) % 6"


@query("m05_planted_ranks", ctes(p=f"select {_CLASS} as c, " + ", ".join(
    f"{e.format(c=f'({_CLASS})')} as {n}" for n, e in PLANTED.items()) + " from lineitem",
    long="select c, feature, x from p unpivot (x for feature in (whole, half, quarter, noise, constant))",
    cells="select feature, c, count(*) as n, avg(x) as m, var_pop(x) as v from long group by 1, 2",
    share="""select feature, coalesce(sum(n * v) / nullif(sum(n * v) + sum(n * (m - g) * (m - g)), 0), 1) as unexplained
      from (select *, sum(n * m) over (partition by feature) / sum(n) over (partition by feature) as g from cells) group by 1""") +
    "select feature, row_number() over (order by unexplained, feature desc) as place from share where feature in ('whole', 'half', 'quarter')")
def m05_planted(spark, sf_dir):
    """The forests rank features by how often they name the class: as the share of variance that classes explain does."""
    rows = read(spark, sf_dir, "lineitem").selectExpr(
        FLOW_ID.format(text="string") + " as flow_id", f"cast({_CLASS} as string) as label",
        *[f"cast({e.format(c=f'({_CLASS})')} as double) as {n}" for n, e in PLANTED.items()])
    found = SEL.rf_importance(rows, list(PLANTED), "flow_id", max_fit_rows=2_000)
    if max(found["noise"], found["constant"]) >= found["quarter"]:
        raise ValueError(f"features that know nothing rank above one that does: {found}")
    best = sorted(("whole", "half", "quarter"), key=lambda c: -found[c])
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(best)], "feature string, place bigint")


@query("m06_top_n", WITH + VARIED + F_SCORES + f"""select row_number() over (order by f_score desc, pos desc) as place, fs.feature
  from fs join {POSITIONS} on p.feature = fs.feature qualify place <= 8""")
def m06(spark, sf_dir):
    ready, names = prepared(spark, sf_dir)
    best = SEL.top_n(names, f_scores(ready, names), 8)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(best)], "place bigint, feature string")


_CRITICAL = "(values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(S.CRITICAL_FEATURES)) + ") as cr(pos, feature)"


@query("m07_complete_critical", WITH + VARIED + F_SCORES + f""", best as (
    select row_number() over (order by f_score desc, pos desc) as place, fs.feature
    from fs join {POSITIONS} on p.feature = fs.feature qualify place <= 8),
  fill as (select 8 + row_number() over (order by pos) as place, feature from {_CRITICAL}
    where feature not in (select feature from best))
select * from best union all select * from fill where place <= 20""")
def m07(spark, sf_dir):
    ready, names = prepared(spark, sf_dir)
    full = SEL.complete_critical(SEL.top_n(names, f_scores(ready, names), 8), ready.names, 20)
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(full)], "place bigint, feature string")


def _scaled_sql(c: str, source: str) -> str:
    return (f"round((cast({_id(c)} as double) - (select avg({_id(c)}) from {source})) / "
            f"(select case when stddev_pop({_id(c)}) = 0 then 1 else stddev_pop({_id(c)}) end from {source}), 6) as {snake(c)}")


@query("m08_standardise", WITH + "select flow_id, " + ", ".join(_scaled_sql(c, "f") for c in S.SCALED_FEATURES) + " from f")
def m08(spark, sf_dir):
    df = SEL.standardise(clean_flows(spark, sf_dir), S.SCALED_FEATURES)
    return df.select("flow_id", *[F.round(q(c), 6).alias(snake(c)) for c in S.SCALED_FEATURES])


FIT_ROWS = 1_000  # of m11, whose table has no variance: no forest is reached


@query("m09_fit_select")
def m09(spark, sf_dir):
    settings = SEL.SelectionSettings.for_count(8)
    fitted = SEL.fit_select(clean_flows(spark, sf_dir), "flow_id", settings)
    return spark.createDataFrame(
        [(i + 1, c, fitted.importance.get(c, 0.0)) for i, c in enumerate(fitted.features)],
        "place int, feature string, importance double")


_FITTED = ["IAT", "Rate", "Rate_ratio", "Duration_log", "flag_complexity", "abnormal_flags", "burst_indicator",
           "connection_quality", "anomaly_score", "Variance"]


def fitted_fixture(spark, sf_dir) -> SEL.FittedSelection:
    """A selection of fixed features, fitted on the whole table."""
    made = engineered(spark, sf_dir)
    f = {r["feature"]: r["f_score"] for r in SEL.anova_f(made.df, _FITTED).collect()}
    return SEL.FittedSelection(
        _FITTED, [], f, SEL.learn_scale(made.df, _FITTED), made.statistics, made.temporal, made.behavioural, made.network)


@query("m10_transform", WITH + ENGINEERED + "select flow_id, " + ", ".join(_scaled_sql(c, "g") for c in _FITTED) + " from g")
def m10(spark, sf_dir):
    out = fitted_fixture(spark, sf_dir).transform(clean_flows(spark, sf_dir), keep=["flow_id"])
    return out.select("flow_id", *[F.round(q(c), 6).alias(snake(c)) for c in _FITTED])


_LEFT = [c for c in _FITTED if c != "Variance"]


@query("b16_missing_features", WITH + ENGINEERED + "select flow_id, 'Variance' as missing, " + ", ".join(_scaled_sql(c, "g") for c in _LEFT) + " from g")
def b16(spark, sf_dir):
    """A table without one of the selected features: named, and the others transformed."""
    fitted, df = fitted_fixture(spark, sf_dir), clean_flows(spark, sf_dir).drop("Variance")
    _, gone = C.missing_features(df, [c for c in fitted.features if c in S.FEATURES])
    out = fitted.transform(df, keep=["flow_id"])
    return out.select("flow_id", F.lit(",".join(gone)).alias("missing"), *[F.round(q(c), 6).alias(snake(c)) for c in _LEFT])


@query("m11_fallback_original", WITH + """select label, count(*) as n, 0.0::double as drate, cast(count(*) as double) as llc
  from f group by 1""")
def m11(spark, sf_dir):
    constant = clean_flows(spark, sf_dir).select("flow_id", "Drate", "LLC", "label")
    out, fitted = SEL.select_or_original(constant, "flow_id", SEL.SelectionSettings.for_count(8, max_fit_rows=FIT_ROWS))
    if fitted is not None:
        raise ValueError("a table without variance cannot be fitted")
    return out.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Drate").alias("drate"), F.sum("LLC").alias("llc"))


_REPORT = {
    "Final": _FITTED,
    "Temporal": [c for c in _TEMPORAL if c in _FITTED],
    "Behavioral": [c for c in _BEHAVIOURAL if c in _FITTED],
    "Network Context": [c for c in list(FORMULAS)[21:] if c in _FITTED],
    "Original Critical": [c for c in _FITTED if c in S.CRITICAL_FEATURES],
}


@query("m12_feature_report", WITH + VARIED + F_SCORES + """select section, place, r.feature, round(f_score, 4) as importance,
  family from (values """ + ", ".join(
    f"('{s}', {i + 1}, '{c}', '{_FAMILY.get(c, 'Original')}')" for s, cs in _REPORT.items() for i, c in enumerate(cs)
) + ") as r(section, place, feature, family) join fs on fs.feature = r.feature")
def m12(spark, sf_dir):
    df = SEL.feature_report(spark, fitted_fixture(spark, sf_dir))
    return df.withColumn("importance", F.round("importance", 4))
