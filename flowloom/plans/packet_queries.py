"""Registered queries over packets: scalar functions, running values, feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.functions import packets as P
from flowloom.functions.labels import run_label
from flowloom.operators import packets as W
from flowloom.plans.fixtures import PACKETS, ctes, packets
from flowloom.plans.registry import query
from flowloom.session import new_folder
from flowloom.sources.frames import decode_frames, encode_frames

TCP, UDP = "(eth_type = 2048 and ip_proto = 6)", "(eth_type = 2048 and ip_proto = 17)"
_SRC_FIRST = "(src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port))"
_SRC, _DST = "concat(src_ip, ':', src_port)", "concat(dst_ip, ':', dst_port)"
KEYED = (
    f"select *, ({TCP} or {UDP}) is true as has_flow, "
    f"case when ({TCP} or {UDP}) is true then case when {_SRC_FIRST} then concat({_SRC}, '-', {_DST}) "
    f"else concat({_DST}, '-', {_SRC}) end end as flow, {_SRC_FIRST} as forward, "
    f"({_SRC} = {_DST}) is true as same_ends, "
    "case when eth_type = 2048 then case ip_proto when 0 then 'IP' when 1 then 'ICMP' when 2 then 'IGMP' "
    "when 6 then 'TCP' when 17 then 'UDP' else 'Unknown for now' end "
    "when eth_type = 2054 then 'ARP' else 'UNKNOWN' end as protocol_name from p"
)
WITH = ctes(p=PACKETS, k=KEYED)
UPTO = "order by packet_no rows between unbounded preceding and current row"
BY_FLOW = f"(partition by capture_id, ip_proto, flow {UPTO})"
BY_CAPTURE = f"(partition by capture_id {UPTO})"


def flow_text() -> Column:
    def end(e: str) -> Column:
        return F.concat(F.col(f"flow.{e}.ip"), F.lit(":"), F.col(f"flow.{e}.port").cast("string"))

    return F.when(F.col("flow").isNotNull(), F.concat(end("a"), F.lit("-"), end("b")))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def blocks(spark, sf_dir):
    return W.blocks_of(packets(spark, sf_dir))


def frames(spark, sf_dir) -> DataFrame:
    """A written table of raw frames made from the packets."""
    path = new_folder(spark, "frames")
    encode_frames(packets(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


def big(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---- scalar functions ------------------------------------------------------------------------


@query("a09_decode_frames", ctes(p=PACKETS) + """
select packet_no, ts_us, eth_type, greatest(frame_len, 54 + opt_len) as frame_len,
  case when eth_type = 2048 then ip_proto end as ip_proto, case when eth_type = 2048 then 64 end as ttl,
  case when eth_type = 2048 then src_ip end as src_ip, case when eth_type = 2048 then dst_ip end as dst_ip,
  src_port, dst_port, tcp_flags, opt_len from p""")
def a09(spark, sf_dir):
    return decode_frames(frames(spark, sf_dir)).select(
        "packet_no", "ts_us", "eth_type", "frame_len", "ip_proto", "ttl", "src_ip", "dst_ip",
        "src_port", "dst_port", "tcp_flags", "opt_len",
    )


@query("b13_stamp_label", ctes(p=PACKETS) +
       "select 'DDOS-SYN_FLOOD-TCP' as label, cast(count(*) as bigint) as n from p group by 1")
def b13(spark, sf_dir):
    df = packets(spark, sf_dir).withColumn("label", run_label("DDOS", "SYN_FLOOD", "TCP"))
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("b14_keep_frames", ctes(p=PACKETS) + """
select eth_type, cast(count(*) as bigint) as n, cast(sum(case when packet_no % 11 in (0, 5) then 1 else 0 end) as bigint)
  as radio from (select * from p where packet_no % 11 not in (0, 5)) group by eth_type""")
def b14(spark, sf_dir):
    radio = F.col("packet_no") % 11
    df = packets(spark, sf_dir).withColumn(
        "link_type", F.when(radio == 0, "bluetooth").when(radio == 5, "zigbee").otherwise("ethernet")
    )
    return W.keep_frames(df).groupBy("eth_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("link_type") != "ethernet", 1).otherwise(0)).alias("radio"),
    )


@query("c01_ip_to_str", ctes(p=PACKETS) + "select packet_no, src_ip from p")
def c01(spark, sf_dir):
    quad = F.split("src_ip", r"\.")
    octets = F.unhex(F.concat(*[F.lpad(F.hex(quad[i].cast("int")), 2, "0") for i in range(4)]))
    return packets(spark, sf_dir).select("packet_no", P.ip_to_str(octets).alias("src_ip"))


@query("c02_protocol_name", WITH + "select packet_no, protocol_name from k")
def c02(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_no", P.protocol_name().alias("protocol_name"))


@query("c03_tcp_flags", WITH + "select packet_no, " + ", ".join(
    f"case when {TCP} then (tcp_flags // {2 ** b}) % 2 else 0 end as {f}" for f, b in S.TCP_FLAG_BITS.items()
) + " from k")
def c03(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_no", *[P.tcp_flag(f).alias(f) for f in S.TCP_FLAG_BITS])


_COUNTED = ("ack", "syn", "fin", "urg", "rst")


@query("c04_flag_counts", WITH + "select packet_no, " + ", ".join(
    f"cast(case when {TCP} then (tcp_flags // {2 ** S.TCP_FLAG_BITS[f]}) % 2 else 0 end as bigint) as {f}_count"
    for f in _COUNTED) + " from k")
def c04(spark, sf_dir):
    return W.flag_counts(blocks(spark, sf_dir)).df.select("packet_no", *[f"{f}_count" for f in _COUNTED])


@query("c04_flag_counts_strict", WITH + "select packet_no, " + ", ".join(
    f"cast(case when {TCP} then sum((tcp_flags // {2 ** S.TCP_FLAG_BITS[f]}) % 2) over {BY_FLOW} else 0 end as bigint) "
    f"as {f}_count" for f in _COUNTED) + " from k")
def c04_strict(spark, sf_dir):
    return W.flag_counts(blocks(spark, sf_dir), "strict").df.select("packet_no", *[f"{f}_count" for f in _COUNTED])


@query("c05_header_len", WITH +
       f"select packet_no, case when {TCP} then 20 + opt_len when {UDP} then 8 else 0 end as header_len from k")
def c05(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_no", P.header_len().alias("header_len"))


def _port_sql(name: str, port: int, proto: str) -> str:
    return f"case when {proto} and (src_port = {port} or dst_port = {port}) then 1 else 0 end as {name.lower()}"


@query("c06_tcp_services", WITH + "select packet_no, " + ", ".join(
    _port_sql(n, p, TCP) for n, p in S.TCP_SERVICES.items()) + " from k")
def c06(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_no", *[P.service(s).alias(s.lower()) for s in S.TCP_SERVICES])


@query("c07_udp_services", WITH + "select packet_no, " + ", ".join(
    _port_sql(n, p, UDP) for n, p in S.UDP_SERVICES.items()) + " from k")
def c07(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_no", *[P.service(s).alias(s.lower()) for s in S.UDP_SERVICES])


@query("c08_dhcp", WITH + f"""select packet_no, case when {UDP} and ((src_port = 67 and dst_port = 68)
  or (src_port = 68 and dst_port = 67)) then 1 else 0 end as dhcp from k""")
def c08(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_no", P.dhcp().alias("dhcp"))


@query("c09_transport_flags", WITH + "select packet_no, " + ", ".join(
    f"case when eth_type = 2048 and ip_proto = {n} then 1 else 0 end as {t}"
    for t, n in (("tcp", 6), ("udp", 17), ("icmp", 1), ("igmp", 2))) + " from k")
def c09(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_no", *[
        P.one_if(P.is_proto(n)).alias(t) for t, n in (("tcp", S.TCP), ("udp", S.UDP), ("icmp", S.ICMP), ("igmp", S.IGMP))
    ])


@query("c10_llc", WITH + """select packet_no, case when eth_type = 2048 then 1 else 0 end as llc,
  case when eth_type < 1536 then 1 else 0 end as llc_strict from k""")
def c10(spark, sf_dir):
    return packets(spark, sf_dir).select(
        "packet_no", P.llc().alias("llc"), P.llc("strict").alias("llc_strict"))


@query("c11_ethertype_flags", WITH + "select packet_no, " + ", ".join(
    f"case when eth_type = {v} then 1 else 0 end as {n}" for n, v in (("ipv", 2048), ("arp", 2054), ("rarp", 32821))
) + " from k")
def c11(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_no", *[
        P.one_if(F.col("eth_type") == v).alias(n)
        for n, v in (("ipv", S.ETH_IPV4), ("arp", S.ETH_ARP), ("rarp", S.ETH_RARP))
    ])


@query("c12_flow_key", WITH + "select packet_no, flow from k")
def c12(spark, sf_dir):
    df = packets(spark, sf_dir).withColumn("flow", P.endpoints())
    return df.select("packet_no", flow_text().alias("flow"))


@query("c13_ttl", ctes(p=PACKETS) + "select packet_no, 64 as ttl from p where eth_type = 2048")
def c13(spark, sf_dir):
    df = decode_frames(frames(spark, sf_dir))
    return df.filter(P.is_ipv4()).select("packet_no", "ttl")


@query("c14_http_status", """
select event_id as packet_no, 0 as status,
  case when event_type = 'click' then 200 + cast(json_extract_string(props, '$.k') as int) % 5 else 0 end as status_strict
from events""")
def c14(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    code = (200 + F.get_json_object("props", "$.k").cast("int") % 5).cast("string")
    payload = F.when(F.col("event_type") == "click", F.concat(F.lit("HTTP/1.1 "), code, F.lit(" OK\r\n"))).otherwise(
        F.concat(F.lit("GET /"), code))
    return df.select(
        F.col("event_id").alias("packet_no"), P.http_status(payload).alias("status"),
        P.http_status(payload, "strict").alias("status_strict"))


@query("c15_frame_size", ctes(p=PACKETS) + "select packet_no, greatest(frame_len, 54 + opt_len) as tot_size from p")
def c15(spark, sf_dir):
    return frames(spark, sf_dir).select("packet_no", F.length("frame").alias("tot_size"))


@query("c16_number", ctes(p=PACKETS) + "select capture_id, cast(count(*) as bigint) as number from p group by 1")
def c16(spark, sf_dir):
    df = packets(spark, sf_dir).withColumn("number", F.lit(1))
    return df.groupBy("capture_id").agg(F.sum("number").alias("number"))


# ---- running values --------------------------------------------------------------------------


@query("w01_iat", WITH + """select packet_no, ts_us - coalesce(lag(ts_us) over (partition by capture_id
  order by packet_no), ts_us) as iat_us from k""")
def w01(spark, sf_dir):
    return W.capture_times(blocks(spark, sf_dir)).df.select("packet_no", "iat_us")


@query("w02_cumulative_duration", WITH +
       f"select packet_no, ts_us - first(ts_us) over {BY_CAPTURE} as cumulative_us from k")
def w02(spark, sf_dir):
    return W.capture_times(blocks(spark, sf_dir)).df.select("packet_no", "cumulative_us")


@query("w03_flow_duration", WITH + f"""select packet_no, case when has_flow then
  max(ts_us) over {BY_FLOW} - min(ts_us) over {BY_FLOW} else 0 end as flow_us from k""")
def w03(spark, sf_dir):
    return W.flow_runs(blocks(spark, sf_dir)).df.select("packet_no", "flow_us")


@query("w04_flow_bytes", WITH + f"""select packet_no, cast(case when has_flow then
  sum(frame_len) over {BY_FLOW} else 0 end as bigint) as flow_bytes from k""")
def w04(spark, sf_dir):
    return W.flow_runs(blocks(spark, sf_dir)).df.select("packet_no", "flow_bytes")


@query("w05_flow_time_statistics", WITH + f""", b as (select *, ts_us - first(ts_us) over {BY_CAPTURE} as d,
    ts_us - min(ts_us) over (partition by capture_id, ip_proto, flow) as e from k)
select packet_no, min(ts_us) over {BY_FLOW} as ts_min_us, max(ts_us) over {BY_FLOW} as ts_max_us,
  round(cast(avg(e) over {BY_FLOW} as double), 3) as mean_offset_us,
  round(sqrt(cast(count(*) over {BY_FLOW} * sum(d::hugeint * d) over {BY_FLOW}
    - (sum(d) over {BY_FLOW}) * (sum(d) over {BY_FLOW}) as double)
    / (cast(count(*) over {BY_FLOW} as double) * cast(count(*) over {BY_FLOW} as double))), 3) as std_us
  from b where has_flow""")
def w05(spark, sf_dir):
    df = W.flow_time_statistics(blocks(spark, sf_dir)).df.filter("flow is not null")
    return df.select("packet_no", "ts_min_us", "ts_max_us",
                     F.round("ts_mean_offset_us", 3).alias("mean_offset_us"),
                     F.round("ts_std_us", 3).alias("std_us"))


@query("w06_idle_time", WITH + f"""select packet_no, case when not has_flow then 0
  else ts_us - coalesce(lag(ts_us) over (partition by capture_id, ip_proto, flow order by packet_no), 0) end as idle_us,
  case when not has_flow then 0 else coalesce(ts_us - lag(ts_us) over (partition by capture_id, ip_proto, flow
    order by packet_no), 0) end as idle_strict_us from k""")
def w06(spark, sf_dir):
    compat = W.idle_time(blocks(spark, sf_dir))
    alone = F.col("_n") == 1
    return compat.df.select("packet_no", "idle_us", F.when(F.col("flow").isNull() | alone, F.lit(0)).otherwise(
        F.col("idle_us")).cast("bigint").alias("idle_strict_us"))


@query("w07_active_time", WITH + f"""select packet_no, case when has_flow then
  max(ts_us) over {BY_FLOW} - min(ts_us) over {BY_FLOW} else 0 end as active_us from k""")
def w07(spark, sf_dir):
    return W.flow_runs(blocks(spark, sf_dir)).df.select("packet_no", F.col("flow_us").alias("active_us"))


@query("w08_src_to_dst", WITH + f"""select packet_no,
  cast(case when has_flow then count(*) over {BY_FLOW} else 0 end as bigint) as src_to_dst_pkt,
  cast(case when has_flow then sum(frame_len) over {BY_FLOW} else 0 end as bigint) as src_to_dst_byte from k""")
def w08(spark, sf_dir):
    df = W.directions(W.flow_runs(blocks(spark, sf_dir))).df
    return df.select("packet_no", "src_to_dst_pkt", "src_to_dst_byte")


@query("w09_dst_to_src", WITH + f"""select packet_no,
  cast(case when has_flow and same_ends then count(*) over {BY_FLOW} else 0 end as bigint) as dst_to_src_pkt,
  cast(case when has_flow and same_ends then sum(frame_len) over {BY_FLOW} else 0 end as bigint) as dst_to_src_byte
  from k""")
def w09(spark, sf_dir):
    df = W.directions(W.flow_runs(blocks(spark, sf_dir))).df
    return df.select("packet_no", *big(df, "dst_to_src_pkt", "dst_to_src_byte"))


@query("w09_directions_strict", WITH + "select packet_no, " + ", ".join(
    f"cast(case when has_flow then sum(case when {c} then {v} else 0 end) over {BY_FLOW} else 0 end as bigint) as {n}"
    for n, c, v in (("src_to_dst_pkt", "forward", "1"), ("src_to_dst_byte", "forward", "frame_len"),
                    ("dst_to_src_pkt", "not forward", "1"), ("dst_to_src_byte", "not forward", "frame_len"))
) + " from k")
def w09_strict(spark, sf_dir):
    df = W.directions(W.flow_runs(blocks(spark, sf_dir)), "strict").df
    return df.select("packet_no", *big(df, "src_to_dst_pkt", "src_to_dst_byte", "dst_to_src_pkt", "dst_to_src_byte"))


_RATES = f""", f as (select packet_no, has_flow, same_ends,
    max(ts_us) over {BY_FLOW} - min(ts_us) over {BY_FLOW} as d, count(*) over {BY_FLOW} as n,
    sum(case when ip_proto = 6 then 1 else 0 end) over (partition by capture_id, flow {UPTO}) as n_tcp from k)"""


@query("w10_rates", WITH + _RATES + """ select packet_no,
  case when has_flow and d > 0 then round(n_tcp / (d / 1000000.0::double), 6) else 0.0::double end as rate,
  case when has_flow and d > 0 then round(n / (d / 1000000.0::double), 6) else 0.0::double end as srate,
  case when has_flow and d > 0 and same_ends then round(n / (d / 1000000.0::double), 6) else 0.0::double end as drate
  from f""")
def w10(spark, sf_dir):
    df = W.rates(W.directions(W.flow_runs(blocks(spark, sf_dir)))).df
    return df.select("packet_no", r6("rate").alias("rate"), r6("srate").alias("srate"), r6("drate").alias("drate"))


def _count_over(*keys: str) -> str:
    return f"count(*) over (partition by capture_id, {', '.join(keys)} {UPTO})"


@query("w11_host_counters", WITH + f"""select packet_no,
  case when eth_type = 2048 then {_count_over('src_ip', 'eth_type')} else 0 end as src_pkts,
  case when eth_type = 2048 then {_count_over('dst_ip', 'eth_type')} else 0 end as dst_pkts from k""")
def w11(spark, sf_dir):
    return W.host_counters(blocks(spark, sf_dir)).df.select("packet_no", "src_pkts", "dst_pkts")


@query("w12_host_byte_counters", WITH + f"""select packet_no,
  case when eth_type = 2048 then {_count_over('src_ip', 'eth_type')} else 0 end as src_byte_count,
  case when eth_type = 2048 then {_count_over('dst_ip', 'eth_type')} else 0 end as dst_byte_count from k""")
def w12(spark, sf_dir):
    return W.host_counters(blocks(spark, sf_dir)).df.select("packet_no", "src_byte_count", "dst_byte_count")


@query("w12_host_bytes_strict", WITH + "select packet_no, " + ", ".join(
    f"cast(case when eth_type = 2048 then sum(frame_len) over (partition by capture_id, eth_type, {s}_ip {UPTO}) "
    f"else 0 end as bigint) as {s}_byte_count" for s in ("src", "dst")) + " from k")
def w12_strict(spark, sf_dir):
    return W.host_counters(blocks(spark, sf_dir), "strict").df.select("packet_no", "src_byte_count", "dst_byte_count")


@query("w13_protocol_host_counters", WITH + f"""select packet_no,
  case when eth_type = 2048 then {_count_over('protocol_name', 'src_ip')} else 0 end as src_proto_pkts,
  case when eth_type = 2048 then {_count_over('protocol_name', 'dst_ip')} else 0 end as dst_proto_pkts from k""")
def w13(spark, sf_dir):
    return W.protocol_host_counters(blocks(spark, sf_dir)).df.select("packet_no", "src_proto_pkts", "dst_proto_pkts")


@query("w14_protocol_port_counters", WITH + f"""select packet_no,
  case when has_flow then {_count_over('protocol_name', 'src_port')} else 0 end as src_port_pkts,
  cast(case when has_flow then 1 else 0 end as bigint) as dst_port_pkts,
  case when has_flow then {_count_over('protocol_name', 'dst_port')} else 0 end as dst_port_pkts_strict from k""")
def w14(spark, sf_dir):
    compat = W.protocol_port_counters(blocks(spark, sf_dir))
    where = P.is_proto(S.TCP) | P.is_proto(S.UDP)
    both = W.counter(compat, "dst_port_pkts_strict", ["protocol_name", "dst_port"], where)
    return both.df.select("packet_no", "src_port_pkts", "dst_port_pkts", "dst_port_pkts_strict")


_SYSTEM = "has_flow and (src_port between 1 and 1023 or dst_port between 1 and 1023)"


@query("w15_incoming_connections", WITH + "select packet_no, " + ", ".join(
    f"cast(case when {_SYSTEM} then sum(case when {_SYSTEM} then 1 else 0 end) over (partition by capture_id, {s}_ip "
    f"{UPTO}) else 0 end as bigint) as incoming_{s}" for s in ("src", "dst")) + " from k")
def w15(spark, sf_dir):
    return W.incoming_connections(blocks(spark, sf_dir)).df.select("packet_no", "incoming_src", "incoming_dst")


@query("w16_arp_counter", WITH + f"""select packet_no, cast(case when eth_type = 2054 then
  sum(case when eth_type = 2054 then 1 else 0 end) over {BY_CAPTURE} else 0 end as bigint) as arp_packets from k""")
def w16(spark, sf_dir):
    return W.arp_counter(blocks(spark, sf_dir)).df.select("packet_no", "arp_packets")


@query("w16_protocol_totals", WITH +
       "select capture_id, protocol_name, count(*) as n_packets from k group by capture_id, protocol_name")
def w16_totals(spark, sf_dir):
    return W.protocol_totals(packets(spark, sf_dir))


@query("w17_distinct_hosts", WITH + """select capture_id, count(distinct ip) as n_hosts from (
  select capture_id, src_ip as ip from k where eth_type = 2048
  union all select capture_id, dst_ip from k where eth_type = 2048) group by capture_id""")
def w17(spark, sf_dir):
    return W.distinct_hosts(packets(spark, sf_dir))


_W18 = {"w_sum": "sum(x)", "w_min": "min(x)", "w_max": "max(x)", "w_avg": "avg(x)", "w_std": "stddev_pop(x)",
        "w_magnitude": "sqrt(sum(x * x))", "w_radius": "max(x) - min(x)", "w_covariance": "var_pop(x)",
        "w_variance": "var_pop(x)", "w_weight": "avg(x)"}
W18_CTE = """, n as (select *, row_number() over (partition by capture_id order by packet_no) as rn from k),
  s as (select capture_id, (rn - 1) // 20 as g, max(rn) as last_rn, count(*) as c, """ + ", ".join(
    f"cast({e} as double) as {c}" for c, e in _W18.items()) + """ from (select *, cast(frame_len as double) as x from n)
  group by 1, 2)"""


@query("w18_window_of_20", WITH + W18_CTE + " select n.packet_no, " + ", ".join(
    f"round(case when s.c = 20 and n.rn = s.last_rn then s.{c} else 0.0::double end, 6) as {c}" for c in _W18) +
    " from n join s on n.capture_id = s.capture_id and (n.rn - 1) // 20 = s.g")
def w18(spark, sf_dir):
    df = W.window_statistics(W.capture_times(blocks(spark, sf_dir))).df
    return df.select("packet_no", *[r6(c).alias(c) for c in _W18])


@query("w19_remaining_time", WITH + f"""select packet_no, ts_us - first(ts_us) over {BY_CAPTURE} - case when has_flow
  then max(ts_us) over {BY_FLOW} - min(ts_us) over {BY_FLOW} else 0 end as remaining_us from k""")
def w19(spark, sf_dir):
    df = W.flow_runs(W.capture_times(blocks(spark, sf_dir))).df
    return df.select("packet_no", (F.col("cumulative_us") - F.col("flow_us")).alias("remaining_us"))


PAIRS_CTE = """, d as (select *, row_number() over (partition by capture_id, ip_proto, flow, forward order by packet_no)
    as pos from k where has_flow),
  pairs as (select capture_id, ip_proto, flow, pos, max(case when forward then frame_len end) as size_in,
    max(case when not forward then frame_len end) as size_out from d group by 1, 2, 3, 4)"""


@query("j03_paired_directions", WITH + PAIRS_CTE + """ select capture_id, ip_proto, flow, pos,
  cast(size_in as bigint) as size_in, cast(size_out as bigint) as size_out from pairs""")
def j03(spark, sf_dir):
    df = W.paired_directions(packets(spark, sf_dir))
    return df.select("capture_id", "ip_proto", flow_text().alias("flow"), "pos", "size_in", "size_out")


@query("w20_two_stream_statistics", WITH + PAIRS_CTE + """, m as (select capture_id, ip_proto, flow,
    avg(size_in) as mi, avg(size_out) as mo from pairs group by 1, 2, 3),
  t as (select capture_id, ip_proto, flow, count(size_in) as n_in, count(size_out) as n_out, min(mi) as mi, min(mo) as mo,
    var_pop(size_in) as vi, var_pop(size_out) as vo, corr(size_out, size_in) as r,
    sum((size_in - mi) * (size_out - mo)) as co from pairs join m using (capture_id, ip_proto, flow) group by 1, 2, 3)
select capture_id, ip_proto, flow, n_in, n_out,
  case when n_in > 0 and n_out > 0 then round(sqrt(mi + mo), 6) else 0.0::double end as magnitude,
  case when n_in > 0 and n_out > 0 then round(sqrt(vi + vo), 6) else 0.0::double end as radius,
  case when n_in > 0 and n_out > 0 then case when n_in = n_out and n_in >= 2 then
    case when vi > 0 and vo > 0 then round(r, 6) end else 0.0::double end else 0.0::double end as correlation,
  case when n_in > 0 and n_out > 0 then round(coalesce(co, 0) / n_in, 4) else 0.0::double end as covariance,
  case when n_in > 0 and n_out > 0 and vo > 0 then round(vi / vo, 6) else 0.0::double end as variance_ratio,
  case when n_in > 0 and n_out > 0 then n_in * n_out else 0 end as weight from t""")
def w20(spark, sf_dir):
    df = W.two_stream_statistics(packets(spark, sf_dir))
    return df.select(
        "capture_id", "ip_proto", flow_text().alias("flow"), "n_in", "n_out", r6("magnitude").alias("magnitude"),
        r6("radius").alias("radius"), r6("correlation").alias("correlation"),
        F.round("covariance", 4).alias("covariance"), r6("variance_ratio").alias("variance_ratio"),
        F.col("weight").cast("bigint").alias("weight"))


def _feature_sql() -> str:
    def flag(f: str) -> str:
        return f"case when {TCP} then (tcp_flags // {2 ** S.TCP_FLAG_BITS[f]}) % 2 else 0 end"

    def port(p: int, proto: str) -> str:
        return f"case when {proto} and (src_port = {p} or dst_port = {p}) then 1 else 0 end"

    def rate(n: str, also: str = "true") -> str:
        return f"case when has_flow and d > 0 and {also} then round({n} / (d / 1000000.0::double), 6) else 0.0::double end"

    at_last = "round(case when c = 20 and rn = last_rn then {} else 0.0::double end, 6)"
    values = {
        "flow_duration": "case when has_flow then round(d / 1e6, 6) else 0.0::double end",
        "Header_Length": f"case when {TCP} then 20 + opt_len when {UDP} then 8 else 0 end",
        "Protocol Type": "case when eth_type = 2048 then ip_proto else 0 end",
        "Duration": "round(cum / 1e6, 6)", "Rate": rate("n_tcp"), "Srate": rate("nf"), "Drate": rate("nf", "same_ends"),
        **{f"{f}_flag_number": flag(f) for f in ("fin", "syn", "rst", "psh", "ack", "ece", "cwr")},
        **{f"{f}_count": flag(f) for f in _COUNTED},
        **{s: port(p, TCP) for s, p in S.TCP_SERVICES.items()}, "DNS": port(53, UDP),
        "TCP": f"case when {TCP} then 1 else 0 end", "UDP": f"case when {UDP} then 1 else 0 end",
        "DHCP": f"case when {UDP} and least(src_port, dst_port) = 67 and greatest(src_port, dst_port) = 68 then 1 else 0 end",
        "ARP": "case when eth_type = 2054 then 1 else 0 end",
        "ICMP": "case when eth_type = 2048 and ip_proto = 1 then 1 else 0 end",
        "IPv": "case when eth_type = 2048 then 1 else 0 end", "LLC": "case when eth_type = 2048 then 1 else 0 end",
        "Tot sum": at_last.format("w_sum"), "Min": at_last.format("w_min"), "Max": at_last.format("w_max"),
        "AVG": at_last.format("w_avg"), "Std": at_last.format("w_std"), "Tot size": "frame_len",
        "IAT": "round(iat / 1e6, 6)", "Number": "1", "Magnitue": at_last.format("w_magnitude"),
        "Radius": at_last.format("w_radius"), "Covariance": at_last.format("w_covariance"),
        "Variance": at_last.format("w_variance"), "Weight": at_last.format("w_weight"),
        S.LABEL: "'DDOS-SYN_FLOOD-TCP'", "cumulative_duration": "round(cum / 1e6, 6)",
        "remaining_time": "round((cum - case when has_flow then d else 0 end) / 1e6, 6)",
    }
    columns = ", ".join(f"{values[c]} as {S.snake(c)}" for c in S.PACKET_FEATURE_COLUMNS)
    return WITH + W18_CTE + f""", f as (select n.*, s.* exclude (capture_id),
      max(ts_us) over {BY_FLOW} - min(ts_us) over {BY_FLOW} as d, count(*) over {BY_FLOW} as nf,
      sum(case when ip_proto = 6 then 1 else 0 end) over (partition by n.capture_id, flow {UPTO}) as n_tcp,
      ts_us - first(ts_us) over {BY_CAPTURE} as cum, ts_us - coalesce(lag(ts_us) over (partition by n.capture_id
      order by packet_no), ts_us) as iat
      from n join s on n.capture_id = s.capture_id and (n.rn - 1) // 20 = s.g)
      select packet_no, {columns} from f""".replace("partition by capture_id", "partition by n.capture_id")


@query("w21_packet_features", _feature_sql())
def w21(spark, sf_dir):
    df = W.packet_features(packets(spark, sf_dir))
    rounded = {"flow_duration", "Duration", "Rate", "Srate", "Drate", "Tot sum", "Min", "Max", "AVG", "Std", "IAT",
               "Magnitue", "Radius", "Covariance", "Variance", "Weight", "cumulative_duration"}

    def shown(c: str) -> Column:
        if c == "remaining_time":
            return F.round(F.col(c).cast("double"), 6)
        return r6(F.col(S.q(c))) if c in rounded else F.col(S.q(c))

    return df.select("packet_no", *[shown(c).alias(S.snake(c)) for c in S.PACKET_FEATURE_COLUMNS])


@query("w22_flow_summary", WITH + """select capture_id, ip_proto, flow, count(*) as flow_packets,
  cast(sum(frame_len) as bigint) as flow_bytes, min(ts_us) as first_us, max(ts_us) as last_us,
  max(ts_us) - min(ts_us) as flow_us from k where has_flow group by 1, 2, 3""")
def w22(spark, sf_dir):
    return W.flow_summary(packets(spark, sf_dir)).withColumn("flow", flow_text())


@query("j07_capture_labels", WITH + """select capture_id, packet_no,
  case capture_id % 3 when 0 then 'Benign' when 1 then 'DDoS' end as label from k""")
def j07(spark, sf_dir):
    rows = packets(spark, sf_dir)
    ids = rows.select("capture_id").distinct().filter("capture_id % 3 <> 2")
    labels = ids.withColumn("label", F.when(F.col("capture_id") % 3 == 0, "Benign").otherwise("DDoS"))
    return rows.join(labels, "capture_id", "left").select("capture_id", "packet_no", "label")
