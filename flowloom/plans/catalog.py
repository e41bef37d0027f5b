"""Loads every module that registers queries."""

from __future__ import annotations

from flowloom.plans import (  # noqa: F401
    evaluation_queries,
    feature_queries,
    packet_queries,
    sampling_queries,
    streaming_queries,
    text_queries,
)
from flowloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
