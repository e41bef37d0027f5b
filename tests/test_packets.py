"""Hand-computed values of the packet features."""

from pyspark.sql import functions as F

from flowloom.functions import packets as P
from flowloom.operators import packets as W
from flowloom.schemas import PACKET_FEATURE_COLUMNS, q
from flowloom.sources.frames import decode_frames, encode_frames


def features(df, *columns, **kw):
    rows = W.packet_features(df, **kw).orderBy("packet_no").select("packet_no", *[q(c) for c in columns]).collect()
    return [tuple(r)[1:] for r in rows]


def test_columns_and_first_rows(make_packets):
    df = make_packets([
        dict(ts_us=1_000_000, tcp_flags=0x12),
        dict(ts_us=1_500_000, src_ip="10.0.0.2", dst_ip="10.0.0.1", src_port=2000, dst_port=1000, opt_len=12),
        dict(ts_us=3_000_000, ip_proto=17),
    ])
    assert W.packet_features(df).columns == ["capture_id", "packet_no", *PACKET_FEATURE_COLUMNS]
    got = features(df, "flow_duration", "Header_Length", "Rate", "Srate", "Drate", "syn_count", "ack_count", "IAT", "remaining_time")
    assert got[0] == (0.0, 20, 0.0, 0.0, 0.0, 1, 1, 0.0, "0.0")
    assert got[1] == (0.5, 32, 4.0, 4.0, 0.0, 0, 0, 0.5, "0.0")
    assert got[2] == (0.0, 8, 0.0, 0.0, 0.0, 0, 0, 1.5, "2.0")


def test_rate_of_udp_counts_tcp_packets(make_packets):
    df = make_packets([dict(ts_us=0), dict(ts_us=1_000_000, ip_proto=17), dict(ts_us=2_000_000, ip_proto=17)])
    assert features(df, "Rate", "Srate")[2] == (1.0, 2.0)


def test_equal_endpoints_count_both_ways(make_packets):
    same = dict(src_ip="10.0.0.1", dst_ip="10.0.0.1", src_port=5, dst_port=5)
    df = make_packets([dict(ts_us=0, **same), dict(ts_us=500_000, **same)])
    assert features(df, "Srate", "Drate")[1] == (4.0, 4.0)


def test_services_and_quirks(make_packets):
    df = make_packets([
        dict(dst_port=21), dict(dst_port=53), dict(dst_port=53, ip_proto=17), dict(src_port=68, dst_port=67, ip_proto=17),
        dict(src_port=67, dst_port=67, ip_proto=17), dict(eth_type=2054), dict(eth_type=34525), dict(ip_proto=1)])
    got = features(df, "IRC", "DNS", "DHCP", "ARP", "IPv", "LLC", "ICMP", "TCP", "UDP")
    assert got[0] == (1, 0, 0, 0, 1, 1, 0, 1, 0)
    assert got[1] == (0, 0, 0, 0, 1, 1, 0, 1, 0)  # DNS is looked for on UDP only
    assert got[2] == (0, 1, 0, 0, 1, 1, 0, 0, 1)
    assert got[3][2] == 1 and got[4][2] == 0
    assert got[5] == (0, 0, 0, 1, 0, 0, 0, 0, 0)
    assert got[6] == (0, 0, 0, 0, 0, 0, 0, 0, 0)  # IPv6 stays, with zeros
    assert got[7] == (0, 0, 0, 0, 1, 1, 1, 0, 0)


def test_endpoint_order_is_by_text_then_number(make_packets):
    df = make_packets([
        dict(src_ip="10.0.0.2", dst_ip="10.0.0.10"), dict(src_ip="10.0.0.1", dst_ip="10.0.0.1", src_port=100, dst_port=20)])
    rows = df.select(P.endpoints().alias("f")).collect()
    assert rows[0].f.a.ip == "10.0.0.10"
    assert (rows[1].f.a.port, rows[1].f.b.port) == (20, 100)


def test_window_of_twenty(make_packets):
    df = make_packets([dict(frame_len=60 + i) for i in range(45)])
    got = features(df, "Tot sum", "Min", "Max", "AVG", "Radius", "Weight")
    assert got[18] == (0.0,) * 6 and got[20] == (0.0,) * 6
    assert got[19] == (sum(range(60, 80)), 60, 79, 69.5, 19, 69.5)
    assert got[39] == (sum(range(80, 100)), 80, 99, 89.5, 19, 89.5)
    assert all(g == (0.0,) * 6 for g in got[40:])


def test_dropped_frames_do_not_count(make_packets):
    df = make_packets([dict(link_type="bluetooth"), dict(ts_us=5), dict(link_type="zigbee"), dict(ts_us=9)])
    rows = W.packet_features(df).select("packet_no", "IAT").orderBy("packet_no").collect()
    assert [tuple(r) for r in rows] == [(1, 0.0), (3, 4e-06)]


def test_labels_per_capture(spark, make_packets):
    labels = spark.createDataFrame([("c", "XSS")], "capture_id string, label string")
    assert features(make_packets([{}]), "label", labels=labels) == [("XSS",)]
    assert features(make_packets([{}]), "label") == [("DDOS-SYN_FLOOD-TCP",)]


def test_frames_round_trip_and_vlan(spark, make_packets):
    df = make_packets([dict(tcp_flags=0x29, opt_len=8, frame_len=90), dict(ip_proto=17, frame_len=70, tcp_flags=None), dict(
        eth_type=2054, ip_proto=None, src_port=None, dst_port=None, tcp_flags=None)])
    back = decode_frames(encode_frames(df)).orderBy("packet_no").collect()
    assert (back[0].src_ip, back[0].dst_port, back[0].tcp_flags, back[0].opt_len) == ("10.0.0.1", 2000, 0x29, 8)
    assert (back[1].src_port, back[1].tcp_flags, back[1].frame_len) == (1000, None, 70)
    assert (back[2].eth_type, back[2].src_ip) == (2054, None)
    frames = encode_frames(df)
    tagged = frames.withColumn("frame", F.unhex(F.concat(
        F.substr(F.hex("frame"), F.lit(1), F.lit(24)), F.lit("81000005"), F.substr(F.hex("frame"), F.lit(25), F.length("frame") * 2))))
    again = decode_frames(tagged).orderBy("packet_no").collect()
    assert (again[0].eth_type, again[0].dst_port, again[0].opt_len) == (2048, 2000, 8)
    short = frames.withColumn("frame", F.substr("frame", F.lit(1), F.lit(13)))
    assert decode_frames(short).count() == 0


def test_http_status(spark):
    df = spark.createDataFrame([("HTTP/1.1 404 Not Found",), ("GET / HTTP/1.1",), (None,)], "p string")
    got = [tuple(r) for r in df.select(P.http_status(F.col("p")), P.http_status(F.col("p"), "strict")).collect()]
    assert got == [(0, 404), (0, 0), (0, 0)]
