"""Label clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canon_label(label: Column) -> Column:
    """Trimmed label; the DDoS variants become one class, ``BenignTraffic`` becomes ``Benign``."""
    text = F.trim(label)
    lower = F.lower(text)
    return (
        F.when(lower.startswith("ddos"), F.lit("DDoS"))
        .when(lower == "benigntraffic", F.lit("Benign"))
        .otherwise(text)
    )


def binary_label(label: Column) -> Column:
    """``Benign`` or ``Attack``."""
    return F.when(F.lower(F.trim(label)).startswith("benign"), F.lit("Benign")).otherwise(F.lit("Attack"))


def run_label(category: str, attack: str, protocol: str) -> Column:
    """The label every row of one capture run gets."""
    return F.concat_ws("-", F.lit(category), F.lit(attack), F.lit(protocol))
