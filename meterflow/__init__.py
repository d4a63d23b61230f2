"""Spark-native governance and analytics of telemetry datapoints."""

from __future__ import annotations

import os


def shipped(spark):
    """The session, whose Python workers started from now on find this package where the driver found it."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return spark
