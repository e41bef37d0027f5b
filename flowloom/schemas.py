"""Column lists, label lists and StructTypes.

Everything in this file is a fixed value of the data format: the names, their
order and their spelling (including the blanks and ``Magnitue``) are what
existing datasets carry, so they are stated plainly and never derived.
"""

from __future__ import annotations

from pyspark.sql import types as T

# The 46 numeric flow features, in file order.
FEATURES = [
    "flow_duration", "Header_Length", "Protocol Type", "Duration", "Rate", "Srate", "Drate",
    "fin_flag_number", "syn_flag_number", "rst_flag_number", "psh_flag_number",
    "ack_flag_number", "ece_flag_number", "cwr_flag_number",
    "ack_count", "syn_count", "fin_count", "urg_count", "rst_count",
    "HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH", "IRC", "TCP", "UDP", "DHCP", "ARP", "ICMP",
    "IPv", "LLC", "Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "IAT", "Number",
    "Magnitue", "Radius", "Covariance", "Variance", "Weight",
]
LABEL = "label"
FLOW_COLUMNS = [*FEATURES, LABEL]
PACKET_FEATURE_COLUMNS = [*FLOW_COLUMNS, "cumulative_duration", "remaining_time"]

# The features that are standardised when no features are engineered.
SCALED_FEATURES = [
    "flow_duration", "Header_Length", "Duration", "Rate", "Srate", "Drate",
    "ack_count", "syn_count", "fin_count", "urg_count", "rst_count",
    "Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "IAT", "Number",
    "Magnitue", "Radius", "Covariance", "Variance", "Weight",
]

# Features used to fill a short selection, in fill order.
CRITICAL_FEATURES = [
    "Protocol Type", "Duration", "Rate", "Srate", "Drate",
    "syn_flag_number", "fin_flag_number", "rst_flag_number", "ack_flag_number",
    "TCP", "UDP", "ICMP", "HTTP", "HTTPS", "DNS", "Tot sum", "Tot size", "IAT", "Variance",
]

# Class names, in the order in which the instruction lists them.
CLASSES = [
    "Benign", "BrowserHijacking", "DoS-UDP_Flood", "Mirai-greeth_flood", "XSS",
    "Backdoor_Malware", "Uploading_Attack", "Mirai-udpplain", "MITM-ArpSpoofing",
    "DNS_Spoofing", "DoS-TCP_Flood", "DictionaryBruteForce", "Recon-OSScan", "DoS-HTTP_Flood",
    "SqlInjection", "CommandInjection", "Recon-PortScan", "DDoS", "Mirai-greip_flood",
    "VulnerabilityScan", "Recon-HostDiscovery", "Recon-PingSweep", "DoS-SYN_Flood",
]

# Service ports. IRC on 21 is what the data format uses.
TCP_SERVICES = {"HTTP": 80, "HTTPS": 443, "SSH": 22, "IRC": 21, "SMTP": 25, "Telnet": 23, "MQTT": 1883}
UDP_SERVICES = {"DNS": 53, "CoAP": 5683}
DHCP_PORTS = (67, 68)

# Ethertypes and IP protocol names.
ETH_IPV4, ETH_ARP, ETH_RARP, ETH_VLAN, ETH_IPV6 = 2048, 2054, 32821, 33024, 34525
PROTOCOL_NAMES = {0: "IP", 1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP"}
TCP, UDP, ICMP, IGMP = 6, 17, 1, 2

# TCP flag bit positions.
TCP_FLAG_BITS = {"fin": 0, "syn": 1, "rst": 2, "psh": 3, "ack": 4, "urg": 5, "ece": 6, "cwr": 7}

FLOW_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in FEATURES] + [T.StructField(LABEL, T.StringType())]
)
FRAME_SCHEMA = T.StructType([
    T.StructField("capture_id", T.StringType()),
    T.StructField("packet_no", T.LongType()),
    T.StructField("ts_us", T.LongType()),
    T.StructField("link_type", T.StringType()),
    T.StructField("frame", T.BinaryType()),
])
INSTRUCTION_SCHEMA = T.StructType([
    T.StructField(c, T.StringType()) for c in ("instruction", "input", "output")
])
STATUS_SCHEMA = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("n_features", T.IntegerType()),
    T.StructField("task_type", T.StringType()),
])


def q(name: str) -> str:
    """Back-quoted column name, for names that hold blanks."""
    return f"`{name}`"


def snake(name: str) -> str:
    """Column name without blanks or upper case, for result tables."""
    return name.replace(" ", "_").lower()
