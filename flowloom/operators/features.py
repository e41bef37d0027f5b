"""Engineered features.

Each step adds its columns with one projection, and only those whose inputs
exist. What depends on the whole table (medians, means, quantiles) is read once
into :class:`TableStatistics` and then used as literals, so engineering itself
is a projection with no shuffle and also runs on a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom import schemas as S
from flowloom.operators.statistics import filled_quantiles, finite, moments, quantiles
from flowloom.schemas import q

EPSILON = 1e-6
PROTOCOLS = ["TCP", "UDP", "ICMP", "HTTP", "HTTPS", "DNS"]
PRODUCTS = ["Rate", "Srate", "IAT", "Tot size"]


def num(name: str) -> Column:
    return F.col(q(name)).cast("double")


def has(df: DataFrame, *names: str) -> bool:
    return all(n in df.columns for n in names)


def default_column(df: DataFrame, name: str, value: float) -> Column:
    """The column, or a constant where the table does not have it."""
    return num(name) if name in df.columns else F.lit(float(value))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != S.LABEL]


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "flag" in c.lower()]


@dataclass
class TableStatistics:
    """Everything engineering needs to know about the whole table."""

    medians: dict[str, float] = field(default_factory=dict)
    flag_means: dict[str, float] = field(default_factory=dict)
    q80: dict[str, float] = field(default_factory=dict)
    z: dict[str, tuple[float, float]] = field(default_factory=dict)


# ---- cleaning --------------------------------------------------------------------------------


def fill_zero(df: DataFrame) -> DataFrame:
    """Every missing value becomes 0 (``"0"`` in text columns)."""
    zero = {
        f.name: F.coalesce(F.nanvl(F.col(q(f.name)), F.lit(0.0)), F.lit(0.0))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.coalesce(F.col(q(f.name)), F.lit("0" if isinstance(f.dataType, T.StringType) else 0))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.NumericType, T.StringType))
    }
    return df.select(*[zero.get(c, F.col(q(c))).alias(c) for c in df.columns])


def _as_missing(df: DataFrame) -> DataFrame:
    """NaN and infinities of the numeric columns as NULL."""
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[(finite(F.col(q(c))) if c in fractional else F.col(q(c))).alias(c) for c in df.columns])


def _known(plain: DataFrame, columns: list[str]) -> tuple[dict[str, int], int]:
    """Known values per column, and rows. One count per column needs no long form: it is a few instructions."""
    row = plain.agg(F.count(F.lit(1)), *[F.count(q(c)) for c in columns]).first()
    return dict(zip(columns, row[1:])), row[0]


def learn_medians(df: DataFrame) -> dict[str, float]:
    """Exact medians of the numeric columns that have gaps; complete columns cost nothing."""
    plain = _as_missing(df)
    columns = numeric_columns(plain)
    if not columns:
        return {}
    counts, rows = _known(plain, columns)
    gaps = [c for c in columns if counts[c] < rows]
    found = quantiles(plain, {c: [0.5] for c in gaps}, counts=counts)
    return {c: found[(c, 0.5)] for c in gaps}


def clean_impute(df: DataFrame, medians: dict[str, float | None] | None = None) -> DataFrame:
    """Infinite and missing numbers become the column median; the label stays as it is.

    With the medians of this very table, columns without a median are complete
    and pass through. Stored medians may meet new gaps elsewhere; those become NULL.
    """
    own = medians is None
    medians = learn_medians(df) if own else medians
    plain = df if own else _as_missing(df)
    return _imputed(df, plain, medians)


def _imputed(df: DataFrame, plain: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}

    def filled(c: str) -> Column:
        x = finite(F.col(q(c))) if c in fractional else F.col(q(c))
        return F.coalesce(x.cast("double"), F.lit(medians[c]).cast("double"))

    return plain.select(*[(filled(c) if c in medians else F.col(q(c))).alias(c) for c in plain.columns])


# ---- steps -----------------------------------------------------------------------------------


def temporal_columns(df: DataFrame) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if has(df, "Duration"):
        out["Duration_log"] = F.log1p(num("Duration"))
        out["Duration_squared"] = num("Duration") * num("Duration")
    if has(df, "IAT"):
        out["IAT_log"] = F.log1p(num("IAT"))
        out["IAT_variance"] = num("IAT") * default_column(df, "Variance", 1)
    if has(df, "Rate", "Srate"):
        out["Rate_ratio"] = F.try_divide(num("Rate"), num("Srate") + EPSILON)
        out["Rate_deviation"] = F.abs(num("Rate") - num("Srate"))
    if has(df, "flow_duration"):
        out["flow_intensity"] = F.try_divide(default_column(df, "Tot size", 0), num("flow_duration") + EPSILON)
        out["flow_efficiency"] = F.try_divide(default_column(df, "Number", 1), num("flow_duration") + EPSILON)
    return out


def behavioural_columns(df: DataFrame, stats: TableStatistics) -> dict[str, Column]:
    out: dict[str, Column] = {}
    available = [c for c in PRODUCTS if c in df.columns]
    for i, a in enumerate(available):
        for b in available[i + 1:]:
            out[f"{a}_{b}_corr"] = num(a) * num(b)
    protocols = [c for c in df.columns if c in PROTOCOLS]
    if len(protocols) >= 2:
        out["protocol_diversity"] = _row_sum([num(c) for c in protocols])
        out["protocol_switching"] = _row_count([num(c) > 0 for c in protocols])
    if has(df, "Tot size", "Number"):
        out["avg_packet_size"] = F.try_divide(num("Tot size"), num("Number") + EPSILON)
        out["packet_size_variance"] = num("Tot size") * default_column(df, "Variance", 1)
    flags = flag_columns(df)
    if len(flags) >= 2:
        out["flag_complexity"] = _row_sum([num(c) for c in flags])
        out["abnormal_flags"] = _row_count([num(c) > F.lit(stats.flag_means.get(c)) for c in flags])
    if has(df, "Header_Length"):
        h = num("Header_Length")
        out["header_entropy"] = -h * F.log2(h + EPSILON)
    return out


def network_columns(df: DataFrame, stats: TableStatistics) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if has(df, "Rate", "Duration"):
        out["communication_density"] = num("Rate") * num("Duration")
        out["burst_indicator"] = _flag(num("Rate") > F.lit(stats.q80.get("Rate")))
    if has(df, "Tot size", "IAT"):
        out["network_load"] = F.try_divide(num("Tot size"), num("IAT") + EPSILON)
        out["congestion_indicator"] = _flag(num("IAT") > F.lit(stats.q80.get("IAT")))
    if has(df, "rst_count", "ack_flag_number"):
        out["connection_stability"] = F.try_divide(num("ack_flag_number"), num("rst_count") + 1)
        out["connection_quality"] = F.try_divide(F.lit(1.0), num("rst_count") + 1)
    services = [c for c in ("HTTP", "HTTPS", "DNS") if c in df.columns]
    if len(services) >= 2:
        http, https = default_column(df, "HTTP", 0), default_column(df, "HTTPS", 0)
        out["service_diversity"] = _row_sum([num(c) for c in services])
        out["secure_ratio"] = F.try_divide(https, http + https + EPSILON)
    if len(stats.z) >= 3:
        parts = [
            F.abs(F.try_divide(num(c) - F.lit(mean), F.lit(std))) for c, (mean, std) in stats.z.items()
        ]
        score = _sum(parts) / F.lit(float(len(parts)))
        out["anomaly_score"] = score
        out["high_anomaly"] = _flag(score > 2.0)
    return out


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _row_sum(parts: list[Column]) -> Column:
    """Row sum that skips missing values."""
    return _sum([F.coalesce(p, F.lit(0.0)) for p in parts])


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def _row_count(conditions: list[Column]) -> Column:
    return _sum([_flag(c) for c in conditions])


# ---- the whole chain ---------------------------------------------------------------------------


def learn(df: DataFrame, key: str | None = None) -> TableStatistics:
    """Read everything engineering needs from the table: counts, one search for all quantiles, and moments. ``key`` names rows and is no feature."""
    plain = _as_missing(df)
    columns = numeric_columns(plain)
    counts, rows = _known(plain, columns)
    gaps = [c for c in columns if counts[c] < rows]
    cut = {c: [0.8] for c in ("Rate", "IAT") if c in columns}
    medians, high = filled_quantiles(plain, gaps, cut, counts, rows)
    clean = _imputed(df, df, medians)
    other = {c: [0.8] for c in ("Rate", "IAT") if c in clean.columns and c not in cut}  # not numbers by type
    high |= quantiles(clean, other)
    cut |= other
    flags = flag_columns(clean)
    # Anomaly columns are the first three numeric ones in schema order.
    first = [c for c in numeric_columns(clean) if c != key][:3]
    m = moments(clean, list(dict.fromkeys([*flags, *first])))
    return TableStatistics(
        medians=medians,
        flag_means={c: m[c]["mean"] for c in flags},
        q80={c: high[(c, 0.8)] for c in cut},
        z={c: (m[c]["mean"], m[c]["std"] or None) for c in first},
    )


@dataclass
class Engineered:
    """The widened table and the names each step added."""

    df: DataFrame
    temporal: list[str]
    behavioural: list[str]
    network: list[str]
    statistics: TableStatistics

    def family(self, feature: str) -> str:
        return feature_family(feature, self.temporal, self.behavioural, self.network)


def feature_family(feature: str, temporal: list[str], behavioural: list[str], network: list[str]) -> str:
    for name, members in (
        ("Temporal", temporal), ("Behavioral", behavioural), ("Network", network), ("Critical", S.CRITICAL_FEATURES)
    ):
        if feature in members:
            return name
    return "Original"


def engineer(df: DataFrame, stats: TableStatistics | None = None, key: str | None = None) -> Engineered:
    """Clean the table, then add the temporal, behavioural and network columns.

    Compat: the statistics are those of the table passed in. Strict: pass the
    statistics learnt when the selection was fitted.
    """
    if stats is None:
        stats = learn(df, key)
        clean = _imputed(df, df, stats.medians)
    else:
        clean = clean_impute(df, stats.medians)
    temporal = temporal_columns(clean)
    behavioural = behavioural_columns(clean, stats)
    network = network_columns(clean, stats)
    # No step reads a column of an earlier step, so one projection adds them all.
    wide = clean.withColumns({**temporal, **behavioural, **network})
    return Engineered(wide, list(temporal), list(behavioural), list(network), stats)


def feature_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != S.LABEL]


def selected_columns(df: DataFrame, n: int | None = None) -> DataFrame:
    """The known features the table has, in their fixed order, first ``n`` if given; then the label."""
    known = [c for c in S.FEATURES if c in df.columns]
    known = known[:n] if n and n < len(known) else known
    return df.select(*[q(c) for c in known], S.LABEL)


