import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from flowloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores="8", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def small():
    return SMALL


PACKET = (
    "capture_id string, packet_no bigint, ts_us bigint, link_type string, eth_type int, ip_proto int, src_ip string, "
    "dst_ip string, src_port int, dst_port int, frame_len int, tcp_flags int, opt_len int"
)


@pytest.fixture(scope="session")
def make_packets(spark):
    """Packets from dicts; anything left out is a plain TCP packet."""

    def make(rows):
        base = dict(
            capture_id="c", ts_us=0, link_type="ethernet", eth_type=2048, ip_proto=6, src_ip="10.0.0.1",
            dst_ip="10.0.0.2", src_port=1000, dst_port=2000, frame_len=60, tcp_flags=0, opt_len=0)
        names = [c.split()[0] for c in PACKET.split(", ")]
        full = [{**base, "packet_no": i, **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r[c] for c in names) for r in full], PACKET)

    return make
