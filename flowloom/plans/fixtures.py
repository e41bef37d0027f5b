"""Packet, flow and prediction tables derived from the TPC-H-like input tables.

Every derived table is a list of (column, expression) in a spelling that Spark
and ANSI SQL engines share; the few spots where the dialects differ are
placeholders. ``packets(spark, dir)`` builds the DataFrame, ``PACKETS`` is the
same table as a SQL query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowloom import schemas as S

SPARK = {
    "k": "cast(get_json_object(props, '$.k') as int)",
    "us": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)",
    "text": "string",
    "quote": "`",
}
SQL = {
    "k": "cast(json_extract_string(props, '$.k') as int)",
    "us": "epoch_us(ts)",
    "text": "varchar",
    "quote": '"',
}

_SERVICE_PORTS = [80, 443, 53, 23, 25, 22, 21, 1883, 5683, 67, 9999, 8080]
_PROTO = (
    "case when event_type in ('click', 'view') then 6 when event_type = 'purchase' then 17 "
    "when event_type = 'signup' then 1 end"
)
_HAS_PORTS = "event_type in ('click', 'view', 'purchase')"
_SERVICE = "case {k} % 12 " + " ".join(f"when {i} then {p}" for i, p in enumerate(_SERVICE_PORTS)) + " end"
_CLIENT = "case when {k} % 12 = 9 then 68 else cast(40000 + user_id % 4 as int) end"
_A = "concat('10.0.0.', cast(user_id % 4 as {text}))"
_B = "concat('10.0.1.', cast({k} % 3 as {text}))"

PACKET_EXPRESSIONS = [
    ("capture_id", "cast(floor(event_id / 500) as bigint)"),
    ("packet_no", "event_id"),
    ("ts_us", "{us}"),
    ("link_type", "'ethernet'"),
    ("eth_type", "case when event_type = 'error' then case when {k} % 2 = 0 then 2054 else 34525 end else 2048 end"),
    ("ip_proto", _PROTO),
    ("src_ip", f"case when event_id % 3 = 0 then {_A} else {_B} end"),
    ("dst_ip", f"case when event_id % 3 = 0 then {_B} else {_A} end"),
    ("src_port", f"case when {_HAS_PORTS} then case when event_id % 3 = 0 then {_CLIENT} else {_SERVICE} end end"),
    ("dst_port", f"case when {_HAS_PORTS} then case when event_id % 3 = 0 then {_SERVICE} else {_CLIENT} end end"),
    ("frame_len", "cast(60 + floor(value * 3) as int)"),
    ("tcp_flags", "case when event_type in ('click', 'view') then ({k} * 37) % 256 end"),
    ("opt_len", "case when event_type in ('click', 'view') then 4 * ({k} % 3) else 0 end"),
]

_M = "(l_partkey % 100)"
FLOW_ID = (
    "concat_ws('|', cast(l_orderkey as {text}), cast(l_partkey as {text}), cast(l_suppkey as {text}), "
    "cast(l_linenumber as {text}), cast(cast(l_quantity as int) as {text}), "
    "cast(cast(round(l_extendedprice * 100) as bigint) as {text}))"
)
RAW_LABEL = (
    f"case when {_M} < 30 then 'BenignTraffic' when {_M} < 45 then 'DDoS-ICMP_Flood' "
    f"when {_M} < 55 then ' ddos-UDP_Flood ' when {_M} < 65 then 'DoS-SYN_Flood' "
    f"when {_M} < 75 then 'Mirai-udpplain' when {_M} < 85 then 'Recon-PortScan' when {_M} < 93 then 'XSS' "
    f"when {_M} < 98 then 'SqlInjection' when {_M} = 98 then 'DNS_Spoofing' "
    "when l_linenumber = 1 then 'Uploading_Attack' else 'Benign' end"
)


def _flow_expressions() -> list[tuple[str, str]]:
    """The 46 features as double-valued forms of the order line."""
    duration = "l_quantity / 8"
    plain = {
        "flow_duration": duration,
        "Header_Length": "20 + 4 * (l_linenumber % 6)",
        "Protocol Type": "case l_suppkey % 4 when 0 then 6.0 when 1 then 17.0 when 2 then 1.0 else 6.5 end",
        "Duration": f"case when l_linenumber % 2 = 1 then {duration} else l_quantity / 4 end",
        "Rate": "case when l_orderkey % 97 <> 0 then l_extendedprice / 100 end",
        "Srate": "l_extendedprice * (1 - l_discount) / 100",
        "Drate": "0",
        "LLC": "1",
        "Tot sum": "l_quantity * 10", "Min": "l_tax * 100 - 1", "Max": "l_quantity * 2 + 60",
        "AVG": "l_quantity + l_tax", "Std": "l_quantity / 4", "Tot size": "l_extendedprice / 50",
        "IAT": f"round(l_tax + {_M} / 100, 2)", "Number": "l_linenumber",
        "Magnitue": "l_quantity * (1 + l_discount)", "Radius": "l_quantity * l_discount",
        "Covariance": "(l_discount - 0.05) * l_quantity", "Variance": "l_quantity * l_quantity / 16",
        "Weight": "l_quantity * l_linenumber",
    }
    flags = [c for c in S.FEATURES if c.endswith("_flag_number")]
    counts = [c for c in S.FEATURES if c.endswith("_count")]
    services = S.FEATURES[S.FEATURES.index("HTTP"):S.FEATURES.index("LLC")]
    plain |= {c: f"floor({_M} / {j + 1}) % 2" for j, c in enumerate(flags)}
    plain |= {c: f"floor({_M} / {j + 1}) % 2 * l_linenumber" for j, c in enumerate(counts)}
    plain |= {c: f"case when (l_suppkey + {j}) % 7 = 0 then 1 else 0 end" for j, c in enumerate(services)}
    return [(c, f"cast({plain[c]} as double)") for c in S.FEATURES]


FLOW_EXPRESSIONS = [("flow_id", FLOW_ID), *_flow_expressions(), (S.LABEL, RAW_LABEL)]

PREDICTION_EXPRESSIONS = [
    ("row_id", "event_id"),
    ("true", "event_type"),
    ("predicted", "coalesce(lag(event_type) over (partition by floor(event_id / 100) order by event_id), event_type)"),
    ("inference_time", "value"),
]


def _columns(expressions: list[tuple[str, str]], dialect: dict[str, str]) -> list[str]:
    quote = dialect["quote"]
    return [f"{e.format(**dialect)} as {quote}{name}{quote}" for name, e in expressions]


def sql_table(expressions: list[tuple[str, str]], source: str) -> str:
    return f"select {', '.join(_columns(expressions, SQL))} from {source}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a source that has fewer splits than the cluster has cores.

    A table of many files is left as it is; a single small file would otherwise
    keep all the work that follows in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _derived(spark: SparkSession, sf_dir: str, expressions: list[tuple[str, str]], source: str) -> DataFrame:
    return spread(read(spark, sf_dir, source)).selectExpr(*_columns(expressions, SPARK))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, PACKET_EXPRESSIONS, "events")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, FLOW_EXPRESSIONS, "lineitem")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, PREDICTION_EXPRESSIONS, "events")


PACKETS = sql_table(PACKET_EXPRESSIONS, "events")
FLOWS = sql_table(FLOW_EXPRESSIONS, "lineitem")
PREDICTIONS = sql_table(PREDICTION_EXPRESSIONS, "events")


def ctes(**tables: str) -> str:
    """``with a as (...), b as (...)`` in the given order."""
    return "with " + ", ".join(f"{name} as ({body})" for name, body in tables.items()) + " "
