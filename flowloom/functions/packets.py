"""Column functions over one packet: addresses, ports, flags, service tests.

``mode="compat"`` gives the values found in existing datasets, defects
included; ``mode="strict"`` gives what the column name promises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom import schemas as S


def byte_at(b: Column, pos: Column | int) -> Column:
    """Unsigned value of the byte at 1-based ``pos``."""
    return uint(b, pos, 1)


def uint(b: Column, pos: Column | int, n: int) -> Column:
    """Big-endian unsigned integer of ``n`` bytes from 1-based ``pos``; NULL past the end."""
    pos = F.lit(pos) if isinstance(pos, int) else pos
    part = F.substr(b, pos, F.lit(n))
    return F.when(F.length(part) == n, F.conv(F.hex(part), 16, 10).cast("int"))


def ip_to_str(b: Column) -> Column:
    """Dotted-quad text of four address bytes."""
    return F.concat_ws(".", *[byte_at(b, i).cast("string") for i in range(1, 5)])


def is_ipv4(eth_type: Column | str = "eth_type") -> Column:
    return F.col(eth_type) == S.ETH_IPV4 if isinstance(eth_type, str) else eth_type == S.ETH_IPV4


def is_proto(number: int) -> Column:
    """True for IPv4 packets of the protocol; never NULL."""
    return F.coalesce(is_ipv4() & (F.col("ip_proto") == number), F.lit(False))


def one_if(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def protocol_name() -> Column:
    name = F.lit("Unknown for now")
    for number, text in S.PROTOCOL_NAMES.items():
        name = F.when(F.col("ip_proto") == number, F.lit(text)).otherwise(name)
    return (
        F.when(is_ipv4(), name)
        .when(F.col("eth_type") == S.ETH_ARP, F.lit("ARP"))
        .otherwise(F.lit("UNKNOWN"))
    )


def tcp_flag(flag: str) -> Column:
    """0/1 value of one TCP flag, 0 for packets that are not TCP."""
    bit = F.getbit(F.col("tcp_flags").cast("int"), F.lit(S.TCP_FLAG_BITS[flag])).cast("int")
    return F.when(is_proto(S.TCP), F.coalesce(bit, F.lit(0))).otherwise(F.lit(0))


def header_len() -> Column:
    return (
        F.when(is_proto(S.TCP), F.lit(20) + F.coalesce(F.col("opt_len"), F.lit(0)))
        .when(is_proto(S.UDP), F.lit(8))
        .otherwise(F.lit(0))
        .cast("int")
    )


def either_port(port: int) -> Column:
    return F.coalesce((F.col("src_port") == port) | (F.col("dst_port") == port), F.lit(False))


def service(name: str) -> Column:
    """0/1 service flag by port, for the transport the service is looked for on."""
    if name in S.TCP_SERVICES:
        return one_if(is_proto(S.TCP) & either_port(S.TCP_SERVICES[name]))
    return one_if(is_proto(S.UDP) & either_port(S.UDP_SERVICES[name]))


def dhcp() -> Column:
    a, b = S.DHCP_PORTS
    pair = ((F.col("src_port") == a) & (F.col("dst_port") == b)) | (
        (F.col("src_port") == b) & (F.col("dst_port") == a)
    )
    return one_if(is_proto(S.UDP) & F.coalesce(pair, F.lit(False)))


def llc(mode: str = "compat") -> Column:
    """Compat: 1 for every IPv4 packet. Strict: 1 when the type field is an 802.3 length."""
    return one_if(is_ipv4() if mode == "compat" else F.col("eth_type") < 1536)


def http_status(payload: Column | None = None, mode: str = "compat") -> Column:
    """Compat: always 0, as no response is ever parsed. Strict: code of the status line."""
    if mode == "compat" or payload is None:
        return F.lit(0)
    code = F.regexp_extract(payload, r"^HTTP/\d\.\d (\d{3})", 1)
    return F.coalesce(F.when(code != "", code).try_cast("int"), F.lit(0))


def endpoints() -> Column:
    """Both endpoints in a fixed order: address as text first, then port as number."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").cast("int").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").cast("int").alias("port"))
    has_flow = is_proto(S.TCP) | is_proto(S.UDP)
    return F.when(has_flow, F.struct(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")))
