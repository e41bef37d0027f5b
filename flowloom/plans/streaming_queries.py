"""Registered streaming queries. Each drains a folder of packet files and returns what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import text as X
from flowloom.functions.formatting import rounded
from flowloom.operators import packets as W
from flowloom.plans.feature_queries import _FITTED, ENGINEERED, _scaled_sql, fitted_fixture
from flowloom.plans.fixtures import packets
from flowloom.plans.packet_queries import BY_CAPTURE, BY_FLOW, W18_CTE, WITH, _RATES, _W18, r6
from flowloom.plans.registry import query
from flowloom.plans.sampling_queries import WITH as FLOW_WITH, clean_flows
from flowloom.plans.text_queries import TEXT_SQL
from flowloom.schemas import q, snake
from flowloom.session import new_folder
from flowloom.streaming import stateful as ST

FILES = 7  # does not divide the captures evenly, so their state crosses micro-batches


def stream_of(spark, df: DataFrame, order: str, steps: int = FILES, tasks: int = 4) -> DataFrame:
    """``df`` as a file stream of ``steps`` micro-batches in key order.

    Each key range is one append of ``tasks`` files, which is also what one
    trigger takes; appends have growing modification times, so ranges do not mix.
    """
    folder = new_folder(spark, "stream")
    ends = df.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    width = (ends["b"] - ends["a"]) // steps + 1
    for i in range(steps):
        low = ends["a"] + i * width
        part = df.filter(F.col(order).between(low, low + width - 1))
        part.repartition(tasks).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", tasks).parquet(folder)


@query("st1_flow_state", WITH + _RATES.replace("select packet_no, has_flow", "select packet_no, frame_len, has_flow").replace(
    "count(*) over", f"sum(frame_len) over {BY_FLOW} as bytes, count(*) over", 1) + """ select packet_no,
  case when has_flow then d else 0 end as flow_us, cast(case when has_flow then n else 0 end as bigint) as flow_packets,
  cast(case when has_flow then bytes else 0 end as bigint) as flow_bytes,
  case when has_flow and d > 0 then round(n_tcp / (d / 1000000.0::double), 6) else 0.0::double end as rate,
  case when has_flow and d > 0 then round(n / (d / 1000000.0::double), 6) else 0.0::double end as srate from f""")
def st1(spark, sf_dir):
    folder = new_folder(spark, "st1")
    ST.flow_features(stream_of(spark, packets(spark, sf_dir), "packet_no"), folder).awaitTermination()
    df = ST.read_output(spark, folder)
    return df.select("packet_no", "flow_us", "flow_packets", "flow_bytes", r6("rate").alias("rate"), r6("srate").alias("srate"))


@query("st2_capture_state", WITH + f"""select packet_no, ts_us - coalesce(lag(ts_us) over (partition by capture_id
  order by packet_no), ts_us) as iat_us, ts_us - first(ts_us) over {BY_CAPTURE} as cumulative_us from k""")
def st2(spark, sf_dir):
    folder = new_folder(spark, "st2")
    ST.capture_features(stream_of(spark, packets(spark, sf_dir), "packet_no"), folder).awaitTermination()
    return ST.read_output(spark, folder).select("packet_no", "iat_us", "cumulative_us")


@query("st3_window_of_20", WITH + W18_CTE + " select n.packet_no, " + ", ".join(
    f"round(case when s.c = 20 and n.rn = s.last_rn then s.{c} else 0.0::double end, 6) as {c}" for c in _W18) +
    " from n join s on n.capture_id = s.capture_id and (n.rn - 1) // 20 = s.g")
def st3(spark, sf_dir):
    folder = new_folder(spark, "st3")
    ST.window_features(stream_of(spark, packets(spark, sf_dir), "packet_no"), folder).awaitTermination()
    return ST.read_output(spark, folder).select("packet_no", *[r6(c).alias(c) for c in _W18])


@query("w17_distinct_hosts_stream", WITH + """select capture_id, count(distinct ip) as n_hosts from (
  select capture_id, src_ip as ip from k where eth_type = 2048
  union all select capture_id, dst_ip from k where eth_type = 2048) group by capture_id""")
def w17_stream(spark, sf_dir):
    """Sketches per capture as streaming state; a capture of these tables has few addresses, which sketches hold exactly."""
    folder = new_folder(spark, "w17")
    sketches = W.host_sketches(stream_of(spark, packets(spark, sf_dir), "packet_no"))
    ST.write_complete(sketches, folder, "host_sketches").awaitTermination()
    return W.sketched_hosts(ST.read_output(spark, folder))


@query("st4_label_counts", "select event_type as label, count(*) as n from events group by 1")
def st4(spark, sf_dir):
    folder = new_folder(spark, "st4")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("label"))
    ST.write_complete(ST.label_counts(stream_of(spark, events, "event_id")), folder, "label_counts").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("st5_capped_rows", """select event_id, label from (select event_id, event_type as label,
  row_number() over (partition by event_type order by event_id) as rn from events)
  where rn <= (select count(*) // 12 from events)""")
def st5(spark, sf_dir):
    folder = new_folder(spark, "st5")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("event_type").alias("label"))
    stream = stream_of(spark, events, "event_id")
    ST.capped_rows(stream, folder, events.count() // 12, "label", "event_id").awaitTermination()
    return ST.read_output(spark, folder).select("event_id", "label")


def _flow_stream(spark, sf_dir) -> DataFrame:
    folder = new_folder(spark, "flow-stream")
    clean_flows(spark, sf_dir).write.parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)


@query("st6_stored_transform", FLOW_WITH + ENGINEERED + "select flow_id, " + ", ".join(_scaled_sql(c, "g") for c in _FITTED) + " from g")
def st6(spark, sf_dir):
    folder = new_folder(spark, "st6")
    fitted = fitted_fixture(spark, sf_dir)
    out = fitted.transform(_flow_stream(spark, sf_dir), mode="strict", keep=["flow_id"])
    renamed = out.select("flow_id", *[F.col(q(c)).alias(snake(c)) for c in _FITTED])  # file formats refuse blanks
    ST.write_rows(renamed, folder, "stored_transform").awaitTermination()
    df = spark.read.parquet(f"{folder}/out")
    return df.select("flow_id", *[rounded(F.col(snake(c)), 6).alias(snake(c)) for c in _FITTED])


@query("st6_text_rows", FLOW_WITH + f"""select flow_id, case when length(t) > 400 then left(t, 400) || '...' else t end as text
  from (select flow_id, {TEXT_SQL} as t from f)""")
def st6_text(spark, sf_dir):
    folder = new_folder(spark, "st6-text")
    out = X.text_table(_flow_stream(spark, sf_dir), keep=["flow_id"])
    ST.write_rows(out.select("flow_id", "text"), folder, "text_rows").awaitTermination()
    return spark.read.parquet(f"{folder}/out")
