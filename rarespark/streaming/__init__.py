"""Scoring of streams: with fixed control points relevance is a stateless projection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rarespark.functions.relevance import ControlPoints, phi


def score_stream(stream: DataFrame, value: str, cp: ControlPoints, rel_threshold: float = 0.9) -> DataFrame:
    """``stream`` (or a batch) with phi and rare."""
    got = stream.withColumn("phi", phi(value, cp))
    return got.withColumn("rare", got["phi"] >= rel_threshold)
