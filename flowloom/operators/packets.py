"""Per-packet running features and per-flow summaries.

Input is a packet table: ``capture_id, packet_no, ts_us, link_type, eth_type,
ip_proto, src_ip, dst_ip, src_port, dst_port, frame_len, tcp_flags, opt_len``.
``packet_no`` is the position in the capture. Every running value covers the
packets up to and including its row. Times are whole microseconds; seconds are
made by one division at the very end.

All running features share the exchange on (capture, block): finer groups
(flow, host, port) are windows inside it, so they only add sorts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.functions import packets as P
from flowloom.functions.formatting import py_repr
from flowloom.functions.labels import run_label
from flowloom.operators.running import BLOCK, DEFAULT_BLOCK_ROWS, Blocks, Level, Run, cut_blocks, running, running_levels

CAPTURE, POSITION = "capture_id", "packet_no"
WINDOW_FRAMES = 20  # fixed value: frames per statistics window


def seconds(us: Column) -> Column:
    return us / F.lit(1_000_000.0)


def keep_frames(packets: DataFrame) -> DataFrame:
    """Drop Bluetooth, Zigbee and undecodable frames; IPv6 frames stay, as all-zero rows."""
    kept = packets.filter(~F.coalesce(F.col("link_type"), F.lit("ethernet")).isin("bluetooth", "zigbee"))
    return kept.filter(F.col("eth_type").isNotNull())


def blocks_of(packets: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS, multi: bool | None = None) -> Blocks:
    return cut_blocks(keep_frames(packets), [CAPTURE], POSITION, block_rows, multi)


def _with(blocks: Blocks, **columns: Column) -> Blocks:
    return Blocks(blocks.df.withColumns(columns), blocks.scope, blocks.order, blocks.multi)


# ---- capture level -------------------------------------------------------------------------

def capture_runs() -> list[Run]:
    ts = F.col("ts_us")
    return [Run("_prev_ts", "prev", ts), Run("_first_ts", "first", ts), Run("_frame_no", "count")]


def capture_times(blocks: Blocks, carry: DataFrame | None = None) -> Blocks:
    """``iat_us`` since the previous frame and ``cumulative_us`` since the first one."""
    return _times(running(blocks, [CAPTURE], capture_runs(), carry))


def _times(blocks: Blocks) -> Blocks:
    return _with(
        blocks,
        iat_us=F.coalesce(F.col("ts_us") - F.col("_prev_ts"), F.lit(0)),
        cumulative_us=F.col("ts_us") - F.col("_first_ts"),
    )


def window_statistics(blocks: Blocks) -> Blocks:
    """Statistics of every complete run of 20 frames, carried by its last frame; 0 elsewhere.

    Needs ``_frame_no`` from :func:`capture_times`.
    """
    blocks = _with(blocks, _window=F.floor((F.col("_frame_no") - 1) / F.lit(WINDOW_FRAMES)).cast("bigint"))
    # A window can straddle two blocks, so only a single-block capture may reuse the block exchange.
    keys = [CAPTURE, "_window"] if blocks.multi else [CAPTURE, BLOCK, "_window"]
    whole = Window.partitionBy(*keys)
    size = F.col("frame_len").cast("bigint")
    last = F.col("_frame_no") % WINDOW_FRAMES == 0

    def at_last(value: Column) -> Column:
        return F.when(last, value.cast("double")).otherwise(F.lit(0.0))

    total = F.sum(size).over(whole)
    std = F.stddev_pop(size).over(whole)
    blocks = _with(
        blocks,
        w_sum=at_last(total),
        w_min=at_last(F.min(size).over(whole)),
        w_max=at_last(F.max(size).over(whole)),
        w_avg=at_last(total / F.lit(float(WINDOW_FRAMES))),
        w_std=at_last(std),
        w_magnitude=at_last(F.sqrt(F.sum(size * size).over(whole).cast("double"))),
        w_covariance=at_last(F.var_pop(size).over(whole)),
    )
    return _with(
        blocks,
        w_radius=F.col("w_max") - F.col("w_min"),
        w_variance=F.col("w_std") * F.col("w_std"),
        w_weight=F.col("w_avg"),
    )


# ---- flow level ----------------------------------------------------------------------------

FLOW = "flow"


def flow_state_runs() -> list[Run]:
    """Running values of an endpoint pair, TCP and UDP kept apart.

    The pair is the window key, not (protocol, pair), because the rate of a UDP
    packet counts the TCP packets between the same endpoints.
    """
    runs = []
    for name, number in (("tcp", S.TCP), ("udp", S.UDP)):
        mine = P.is_proto(number)
        runs += [
            Run(f"_n_{name}", "count", F.when(mine, F.lit(1))),
            Run(f"_bytes_{name}", "sum", F.when(mine, F.col("frame_len").cast("bigint")).otherwise(F.lit(0))),
            Run(f"_lo_{name}", "min", F.when(mine, F.col("ts_us"))),
            Run(f"_hi_{name}", "max", F.when(mine, F.col("ts_us"))),
        ]
    return runs


def _own(prefix: str) -> Column:
    return F.when(P.is_proto(S.TCP), F.col(f"{prefix}_tcp")).when(P.is_proto(S.UDP), F.col(f"{prefix}_udp"))


def flow_runs(blocks: Blocks, carry: DataFrame | None = None) -> Blocks:
    """``flow_packets, flow_bytes, flow_us, tcp_packets`` of the row's flow; 0 outside TCP and UDP."""
    return _flow_values(running(_with(blocks, flow=P.endpoints()), [CAPTURE, FLOW], flow_state_runs(), carry))


def _flow_values(blocks: Blocks) -> Blocks:
    has_flow = F.col(FLOW).isNotNull()
    return _with(
        blocks,
        flow_packets=F.when(has_flow, _own("_n")).otherwise(F.lit(0)).cast("bigint"),
        flow_bytes=F.when(has_flow, _own("_bytes")).otherwise(F.lit(0)).cast("bigint"),
        flow_lo_us=F.when(has_flow, _own("_lo")),
        flow_hi_us=F.when(has_flow, _own("_hi")),
        flow_us=F.when(has_flow, _own("_hi") - _own("_lo")).otherwise(F.lit(0)).cast("bigint"),
        tcp_packets=F.when(has_flow, F.col("_n_tcp")).otherwise(F.lit(0)).cast("bigint"),
    )


def _same_ends() -> Column:
    return F.coalesce(F.col("flow.a") == F.col("flow.b"), F.lit(False))


def directions(blocks: Blocks, mode: str = "compat") -> Blocks:
    """Packets and bytes from source to destination and back.

    Compat: the forward pair counts both directions and the backward pair is 0,
    except when both endpoints are equal. Strict: forward counts the packets
    sent by the first endpoint of the pair, backward those of the second.
    """
    if mode == "compat":
        back = _same_ends()
        return _with(
            blocks,
            src_to_dst_pkt=F.col("flow_packets"),
            src_to_dst_byte=F.col("flow_bytes"),
            dst_to_src_pkt=F.when(back, F.col("flow_packets")).otherwise(F.lit(0)),
            dst_to_src_byte=F.when(back, F.col("flow_bytes")).otherwise(F.lit(0)),
        )
    return _strict_directions(running(blocks, [CAPTURE, FLOW, "ip_proto"], direction_runs()))


def direction_runs() -> list[Run]:
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").cast("int").alias("port"))
    forward = F.coalesce(src == F.col("flow.a"), F.lit(False))
    size = F.col("frame_len").cast("bigint")
    return [
        Run("src_to_dst_pkt", "sum", F.when(forward, F.lit(1)).otherwise(F.lit(0))),
        Run("src_to_dst_byte", "sum", F.when(forward, size).otherwise(F.lit(0))),
        Run("dst_to_src_pkt", "sum", F.when(forward, F.lit(0)).otherwise(F.lit(1))),
        Run("dst_to_src_byte", "sum", F.when(forward, F.lit(0)).otherwise(size)),
    ]


def _strict_directions(blocks: Blocks) -> Blocks:
    has_flow = F.col(FLOW).isNotNull()
    return _with(blocks, **{r.name: F.when(has_flow, F.col(r.name)).otherwise(F.lit(0)) for r in direction_runs()})


def rates(blocks: Blocks) -> Blocks:
    """Packets per second of the flow; 0 while the flow has no duration."""
    moving = F.col("flow_us") > 0

    def per_second(packets: str) -> Column:
        rate = F.try_divide(F.col(packets).cast("double"), seconds(F.col("flow_us")))
        return F.when(moving, rate).otherwise(F.lit(0.0))

    return _with(
        blocks,
        rate=per_second("tcp_packets"),
        srate=per_second("src_to_dst_pkt"),
        drate=per_second("dst_to_src_pkt"),
    )


def idle_time(blocks: Blocks, mode: str = "compat") -> Blocks:
    """Gap between the two largest timestamps the flow has had so far.

    The second largest of a prefix is the running maximum of
    ``min(ts, maximum before the row)``, so no timestamps are collected. With a
    single packet it is that packet's timestamp (strict: 0).
    """
    by = [CAPTURE, FLOW, "ip_proto"]
    blocks = _with(blocks, flow=P.endpoints()) if FLOW not in blocks.df.columns else blocks
    out = running(blocks, by, [Run("_max1", "max", F.col("ts_us")), Run("_n", "count")])
    out = running(out, by, [Run("_max_before", "prev", F.col("_max1"))])
    smaller = F.when(F.col("_max_before").isNotNull(), F.least(F.col("ts_us"), F.col("_max_before")))
    out = running(_with(out, _smaller=smaller), by, [Run("_max2", "max", F.col("_smaller"))])
    alone = F.col("ts_us") if mode == "compat" else F.lit(0)
    gap = F.when(F.col("_n") == 1, alone).otherwise(F.col("_max1") - F.col("_max2"))
    return _with(out, idle_us=F.when(F.col(FLOW).isNotNull(), gap).otherwise(F.lit(0)).cast("bigint"))


def flow_time_statistics(blocks: Blocks) -> Blocks:
    """Running min, max, sum, mean and population std of the flow's timestamps.

    Moments are taken relative to the first frame of the capture and summed as
    whole numbers, so the large epoch part cannot eat the digits.
    """
    by = [CAPTURE, FLOW, "ip_proto"]
    out = running(blocks, [CAPTURE], [Run("_base", "first", F.col("ts_us"))])
    out = _with(out, flow=P.endpoints(), _d=F.col("ts_us") - F.col("_base"))
    square = F.col("_d").cast("decimal(19,0)") * F.col("_d").cast("decimal(19,0)")
    out = running(
        out, by,
        [
            Run("_n", "count"), Run("_lo", "min", F.col("ts_us")), Run("_hi", "max", F.col("ts_us")),
            Run("_s1", "sum", F.col("_d")), Run("_s2", "sum", square.cast("decimal(28,0)")),
        ],
    )
    n, s1, s2 = F.col("_n"), F.col("_s1"), F.col("_s2")
    exact = F.try_subtract(
        F.try_multiply(s2, n.cast("decimal(10,0)")),
        F.try_multiply(s1.cast("decimal(19,0)"), s1.cast("decimal(19,0)")),
    ).cast("double") / (n.cast("double") * n.cast("double"))
    plain = F.greatest(s2.cast("double") / n - F.pow(s1.cast("double") / n, F.lit(2)), F.lit(0.0))
    flow = F.col(FLOW).isNotNull()

    def shown(value: Column) -> Column:
        return F.when(flow, value)

    return _with(
        out,
        ts_min_us=shown(F.col("_lo")),
        ts_max_us=shown(F.col("_hi")),
        ts_sum_us=shown(F.col("_base").cast("decimal(28,0)") * n.cast("decimal(10,0)") + s1),
        ts_mean_offset_us=shown(F.col("_base") - F.col("_lo") + s1.cast("double") / n),
        ts_std_us=shown(F.sqrt(F.coalesce(exact, plain))),
    )


# ---- host and port counters ----------------------------------------------------------------


def counter(blocks: Blocks, name: str, by: list[str], where: Column, value: Column | None = None) -> Blocks:
    """Running count (or sum of ``value``) of the rows matching ``where`` inside ``by``; 0 elsewhere."""
    amount = F.lit(1) if value is None else value.cast("bigint")
    run = Run(name, "sum", F.when(where, amount).otherwise(F.lit(0)))
    out = running(blocks, [CAPTURE, *by], [run])
    return _with(out, **{name: F.when(where, F.col(name)).otherwise(F.lit(0)).cast("bigint")})


def host_counters(blocks: Blocks, mode: str = "compat") -> Blocks:
    """Packets, and "bytes", per source and per destination address, IPv4 only.

    Compat: the byte counters add 1 per packet. Strict: they add the frame size.
    """
    size = None if mode == "compat" else F.col("frame_len")
    for side in ("src", "dst"):
        blocks = counter(blocks, f"{side}_pkts", [f"{side}_ip"], P.is_ipv4())
        blocks = counter(blocks, f"{side}_byte_count", [f"{side}_ip"], P.is_ipv4(), size)
    return blocks


def protocol_host_counters(blocks: Blocks) -> Blocks:
    blocks = _with(blocks, protocol_name=P.protocol_name())
    for side in ("src", "dst"):
        blocks = counter(blocks, f"{side}_proto_pkts", ["protocol_name", f"{side}_ip"], P.is_ipv4())
    return blocks


def protocol_port_counters(blocks: Blocks, mode: str = "compat") -> Blocks:
    """Packets per (protocol, port). Compat: the destination counter stays at 1."""
    blocks = _with(blocks, protocol_name=P.protocol_name())
    has_ports = P.is_proto(S.TCP) | P.is_proto(S.UDP)
    blocks = counter(blocks, "src_port_pkts", ["protocol_name", "src_port"], has_ports)
    if mode == "compat":
        return _with(blocks, dst_port_pkts=F.when(has_ports, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return counter(blocks, "dst_port_pkts", ["protocol_name", "dst_port"], has_ports)


def incoming_connections(blocks: Blocks) -> Blocks:
    """Running packets per host over packets where either port is a system port (1..1023)."""
    system = F.coalesce(F.col("src_port").between(1, 1023) | F.col("dst_port").between(1, 1023), F.lit(False))
    where = (P.is_proto(S.TCP) | P.is_proto(S.UDP)) & system
    blocks = counter(blocks, "incoming_src", ["src_ip"], where)
    return counter(blocks, "incoming_dst", ["dst_ip"], where)


def arp_counter(blocks: Blocks) -> Blocks:
    return counter(blocks, "arp_packets", [], F.coalesce(F.col("eth_type") == S.ETH_ARP, F.lit(False)))


def protocol_totals(packets: DataFrame) -> DataFrame:
    """Frames per protocol name and their share of the capture total."""
    named = keep_frames(packets).select(CAPTURE, P.protocol_name().alias("protocol_name"))
    return named.groupBy(CAPTURE, "protocol_name").agg(F.count(F.lit(1)).alias("n_packets"))


def distinct_hosts(packets: DataFrame) -> DataFrame:
    """Number of different IPv4 addresses seen on either side, per capture."""
    hosts = keep_frames(packets).filter(P.is_ipv4()).select(
        CAPTURE, F.explode(F.array("src_ip", "dst_ip")).alias("ip")
    )
    return hosts.groupBy(CAPTURE).agg(F.count_distinct("ip").alias("n_hosts"))


SKETCH_BITS = 12  # 2 ** 12 registers: an error of about 1.6 %


def host_sketches(packets: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """``capture_id, sketch``: what :func:`distinct_hosts` counts, as sketches of bounded size that can be merged.

    For streams, whose exact count would need a state of all addresses: a streaming aggregate with one sketch per capture. The
    relative standard error is 1.04 / sqrt(2 ** bits); small sets are exact.
    """
    hosts = keep_frames(packets).filter(P.is_ipv4()).select(CAPTURE, F.explode(F.array("src_ip", "dst_ip")).alias("ip"))
    return hosts.filter("ip is not null").groupBy(CAPTURE).agg(F.hll_sketch_agg("ip", F.lit(bits)).alias("sketch"))


def sketched_hosts(sketches: DataFrame) -> DataFrame:
    """``capture_id, n_hosts`` by the sketches of each capture; several sketches of a capture are merged."""
    return sketches.groupBy(CAPTURE).agg(F.hll_union_agg("sketch").alias("sketch")).select(
        CAPTURE, F.hll_sketch_estimate("sketch").alias("n_hosts"))


def sketched_hosts_of_all(sketches: DataFrame) -> DataFrame:
    """One row: different addresses over all captures, from the sketches alone."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_hosts"))


# ---- flow tables ---------------------------------------------------------------------------


def flow_summary(packets: DataFrame) -> DataFrame:
    """One row per flow. A hash aggregate with map-side combine, so hot flows cost nothing extra."""
    size = F.col("frame_len").cast("bigint")
    rows = keep_frames(packets).select(CAPTURE, "ip_proto", "ts_us", size.alias("size"), P.endpoints().alias(FLOW))
    out = rows.filter(F.col(FLOW).isNotNull()).groupBy(CAPTURE, "ip_proto", FLOW).agg(
        F.count(F.lit(1)).alias("flow_packets"),
        F.sum("size").alias("flow_bytes"),
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
    )
    return out.withColumn("flow_us", F.col("last_us") - F.col("first_us"))


def flow_positions(packets: DataFrame, span_us: int = 1_000_000) -> DataFrame:
    """``capture_id, packet_no, place``: the place of every packet of a flow by time; of equal times by ``packet_no``.

    Ranked inside stretches of ``span_us`` of a flow, to which the packets of all earlier stretches are added, so
    that a hot flow is spread over tasks.
    """
    rows = keep_frames(packets).select(CAPTURE, POSITION, "ts_us", "ip_proto", P.endpoints().alias(FLOW)).filter(
        F.col(FLOW).isNotNull()).withColumn("_stretch", F.floor(F.col("ts_us") / F.lit(span_us)))
    flow = [CAPTURE, "ip_proto", FLOW]
    earlier = Window.partitionBy(*flow).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*flow, "_stretch").agg(F.count(F.lit(1)).alias("_n")).select(
        *flow, "_stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*flow, "_stretch").orderBy("ts_us", POSITION))
    return rows.withColumn("_inside", inside).join(before, [*flow, "_stretch"]).select(
        CAPTURE, POSITION, (F.col("_before") + F.col("_inside")).cast("bigint").alias("place"))


def paired_directions(packets: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """The i-th packet sent by one endpoint next to the i-th packet sent by the other.

    A full outer pairing on (flow, position), written as one aggregate keyed by
    both so that the packets are scanned and shuffled once. Positions spread a
    hot flow over all tasks.
    """
    blocks = blocks_of(packets, block_rows)
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").cast("int").alias("port"))
    blocks = _with(blocks, flow=P.endpoints())
    blocks = _with(blocks, incoming=F.coalesce(src == F.col("flow.a"), F.lit(False)))
    out = running(blocks, [CAPTURE, "ip_proto", FLOW, "incoming"], [Run("pos", "count")]).df
    rows = out.filter(F.col(FLOW).isNotNull())
    size = F.col("frame_len").cast("bigint")
    return rows.groupBy(CAPTURE, "ip_proto", FLOW, "pos").agg(
        F.max(F.when(F.col("incoming"), size)).alias("size_in"),
        F.max(F.when(~F.col("incoming"), size)).alias("size_out"),
    )


def two_stream_statistics(packets: DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Statistics of the two directions of every flow; all 0 when a direction is empty.

    The covariance runs over the packets paired by position, with the mean of
    each whole direction, divided by the number of incoming packets. It is
    expanded into sums so that one pass over the pairs is enough. The
    correlation needs directions of equal length and at least two packets; it is
    NULL when a direction has one single size.
    """
    pairs = paired_directions(packets, block_rows)
    a, b = F.col("size_in"), F.col("size_out")
    both = a.isNotNull() & b.isNotNull()
    sums = pairs.groupBy(CAPTURE, "ip_proto", FLOW).agg(
        F.count(a).alias("n_in"), F.count(b).alias("n_out"),
        F.avg(a).alias("mean_in"), F.avg(b).alias("mean_out"),
        F.var_pop(a).alias("var_in"), F.var_pop(b).alias("var_out"),
        F.covar_pop(a.cast("double"), b.cast("double")).alias("together"),
        F.sum(F.when(both, a * b)).alias("ab"), F.sum(F.when(both, a)).alias("a"),
        F.sum(F.when(both, b)).alias("b"), F.count(F.when(both, F.lit(1))).alias("m"),
    )
    full = (F.col("n_in") > 0) & (F.col("n_out") > 0)
    co = (
        F.col("ab") - F.col("mean_in") * F.col("b") - F.col("mean_out") * F.col("a")
        + F.col("m") * F.col("mean_in") * F.col("mean_out")
    )
    r = F.try_divide(F.col("together"), F.sqrt(F.col("var_in") * F.col("var_out")))
    comparable = (F.col("n_in") == F.col("n_out")) & (F.col("n_in") >= 2)

    def shown(value: Column) -> Column:
        return F.when(full, value).otherwise(F.lit(0.0))

    return sums.select(
        CAPTURE, "ip_proto", FLOW, "n_in", "n_out",
        shown(F.sqrt(F.col("mean_in") + F.col("mean_out"))).alias("magnitude"),
        shown(F.sqrt(F.col("var_in") + F.col("var_out"))).alias("radius"),
        shown(F.when(comparable, r).otherwise(F.lit(0.0))).alias("correlation"),
        shown(F.try_divide(co, F.col("n_in"))).alias("covariance"),
        shown(F.coalesce(F.try_divide(F.col("var_in"), F.col("var_out")), F.lit(0.0))).alias("variance_ratio"),
        F.when(full, F.col("n_in") * F.col("n_out")).otherwise(F.lit(0)).alias("weight"),
    )


# ---- the whole feature row -----------------------------------------------------------------


def packet_features(
    packets: DataFrame,
    category: str = "DDOS", attack: str = "SYN_FLOOD", protocol: str = "TCP",
    labels: DataFrame | None = None,
    block_rows: int = DEFAULT_BLOCK_ROWS,
    mode: str = "compat",
) -> DataFrame:
    """The 49-column feature table, one row per kept frame, plus ``capture_id`` and ``packet_no``.

    The label is one constant for the run, or ``labels(capture_id, label)``. One exchange when no capture passes a block; else
    four over two scans: rows with their starting values, partials, prefixes, and windows of 20 frames that straddle blocks.
    """
    levels = [Level((), capture_runs()), Level((FLOW,), flow_state_runs())]
    if mode == "strict":
        levels.append(Level((FLOW, "ip_proto"), direction_runs()))
    blocks = running_levels(_with(blocks_of(packets, block_rows), flow=P.endpoints()), levels)
    blocks = _flow_values(_times(blocks))
    blocks = _strict_directions(blocks) if mode == "strict" else directions(blocks)
    df = window_statistics(rates(blocks)).df
    flags = {f: P.tcp_flag(f) for f in S.TCP_FLAG_BITS}
    cumulative = seconds(F.col("cumulative_us"))
    left = seconds(F.col("cumulative_us")) - seconds(F.col("flow_us"))
    if labels is not None:
        df = df.join(labels.select(CAPTURE, F.col(S.LABEL)), CAPTURE, "left")
        label = F.col(S.LABEL)
    else:
        label = run_label(category, attack, protocol)
    value = {
        "flow_duration": seconds(F.col("flow_us")),
        "Header_Length": P.header_len(),
        "Protocol Type": F.when(P.is_ipv4(), F.col("ip_proto")).otherwise(F.lit(0)).cast("int"),
        "Duration": cumulative,
        "Rate": F.col("rate"), "Srate": F.col("srate"), "Drate": F.col("drate"),
        **{f"{f}_flag_number": flags[f] for f in ("fin", "syn", "rst", "psh", "ack", "ece", "cwr")},
        **{f"{f}_count": flags[f] for f in ("ack", "syn", "fin", "urg", "rst")},
        **{s: P.service(s) for s in ("HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH", "IRC")},
        "TCP": P.one_if(P.is_proto(S.TCP)), "UDP": P.one_if(P.is_proto(S.UDP)), "DHCP": P.dhcp(),
        "ARP": P.one_if(F.col("eth_type") == S.ETH_ARP), "ICMP": P.one_if(P.is_proto(S.ICMP)),
        "IPv": P.one_if(P.is_ipv4()), "LLC": P.llc(mode),
        "Tot sum": F.col("w_sum"), "Min": F.col("w_min"), "Max": F.col("w_max"),
        "AVG": F.col("w_avg"), "Std": F.col("w_std"),
        "Tot size": F.col("frame_len"), "IAT": seconds(F.col("iat_us")), "Number": F.lit(1),
        "Magnitue": F.col("w_magnitude"), "Radius": F.col("w_radius"), "Covariance": F.col("w_covariance"),
        "Variance": F.col("w_variance"), "Weight": F.col("w_weight"),
        S.LABEL: label,
        "cumulative_duration": cumulative,
        "remaining_time": py_repr(left) if mode == "compat" else left,
    }
    return df.select(CAPTURE, POSITION, *[value[c].alias(c) for c in S.PACKET_FEATURE_COLUMNS])


def flag_counts(blocks: Blocks, mode: str = "compat") -> Blocks:
    """ACK, SYN, FIN, URG and RST counters.

    Compat: the counters restart at every packet, so each equals the packet's
    own flag. Strict: running counts over the flow.
    """
    names = ("ack", "syn", "fin", "urg", "rst")
    if mode == "compat":
        return _with(blocks, **{f"{f}_count": P.tcp_flag(f).cast("bigint") for f in names})
    blocks = _with(blocks, flow=P.endpoints())
    out = running(blocks, [CAPTURE, FLOW, "ip_proto"], [Run(f"{f}_count", "sum", P.tcp_flag(f)) for f in names])
    tcp = P.is_proto(S.TCP)
    return _with(out, **{f"{f}_count": F.when(tcp, F.col(f"{f}_count")).otherwise(F.lit(0)) for f in names})
