"""Link, network and transport header fields from frame bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom import schemas as S
from flowloom.functions.packets import byte_at, ip_to_str, uint


def decode_frames(frames: DataFrame) -> DataFrame:
    """Packets from ``frames(capture_id, packet_no, ts_us, link_type, frame)``.

    A pure projection. A frame that is too short for an Ethernet header yields
    no row; one 802.1Q tag is stepped over. Fields a frame does not have are NULL.
    """
    b = F.col("frame")
    tag = F.when(F.hex(F.substr(b, F.lit(13), F.lit(2))) == f"{S.ETH_VLAN:04X}", F.lit(4)).otherwise(F.lit(0))
    df = frames.filter(F.length(b) >= F.lit(14) + tag).withColumn("_tag", tag)
    ip = F.col("_tag") + 15  # 1-based position of the first network-layer byte
    df = df.withColumn("eth_type", uint(b, ip - 2, 2))
    v4 = (F.col("eth_type") == S.ETH_IPV4) & (F.length(b) >= F.col("_tag") + 34)

    def field(value: Column) -> Column:
        return F.when(v4, value)

    df = df.withColumns({
        "ip_proto": field(byte_at(b, ip + 9)),
        "ttl": field(byte_at(b, ip + 8)),
        "src_ip": field(ip_to_str(F.substr(b, ip + 12, F.lit(4)))),
        "dst_ip": field(ip_to_str(F.substr(b, ip + 16, F.lit(4)))),
        "_l4": ip + F.pmod(byte_at(b, ip), F.lit(16)) * 4,
    })
    l4 = F.col("_l4")
    tcp = v4 & (F.col("ip_proto") == S.TCP)
    ports = tcp | (v4 & (F.col("ip_proto") == S.UDP))
    return df.withColumns({
        "src_port": F.when(ports, uint(b, l4, 2)),
        "dst_port": F.when(ports, uint(b, l4 + 2, 2)),
        "tcp_flags": F.when(tcp, byte_at(b, l4 + 13)),
        "opt_len": F.when(tcp, F.shiftright(byte_at(b, l4 + 12), 4) * 4 - 20).otherwise(F.lit(0)),
        "frame_len": F.length(b),
    }).drop("_tag", "_l4", "frame")


def encode_frames(packets: DataFrame) -> DataFrame:
    """Ethernet frames with the header fields of a packet table, zero padded to ``frame_len``."""

    def hexed(value: Column, n: int) -> Column:
        return F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")

    def address(ip: str) -> Column:
        quad = F.split(ip, r"\.")
        return F.concat(*[hexed(quad[i].cast("int"), 1) for i in range(4)])

    v4 = F.col("eth_type") == S.ETH_IPV4
    link = F.concat(F.lit("02" * 12), hexed(F.col("eth_type"), 2))
    network = F.concat(
        F.lit("4500"), hexed(F.col("frame_len") - 14, 2), F.lit("0000000040"),
        hexed(F.col("ip_proto"), 1), F.lit("0000"), address("src_ip"), address("dst_ip"),
    )
    ports = F.concat(hexed(F.col("src_port"), 2), hexed(F.col("dst_port"), 2))
    tcp = F.concat(
        ports, F.lit("00" * 8), hexed((F.col("opt_len") + 20) * 4, 1), hexed(F.col("tcp_flags"), 1), F.lit("00" * 6),
        F.repeat(F.lit("00"), F.col("opt_len")),
    )
    udp = F.concat(ports, F.lit("00080000"))
    transport = F.when(F.col("ip_proto") == S.TCP, tcp).when(F.col("ip_proto") == S.UDP, udp).otherwise(F.lit(""))
    header = F.when(v4, F.concat(link, network, transport)).otherwise(link)
    length = F.greatest(F.col("frame_len"), F.lit(54) + F.col("opt_len"))
    frame = F.unhex(F.rpad(header, length * 2, F.lit("0")))
    return packets.select("capture_id", "packet_no", "ts_us", "link_type", frame.alias("frame"))
