"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from cadenza.plans.registry import ORACLES, QUERIES

MODULES = ["q_series", "q_segment", "q_pose", "q_measure", "q_joins", "q_results", "q_motion", "q_rules", "q_text"]
for _module in MODULES:
    import_module(f"cadenza.plans.{_module}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["flagship_rep_summary"](spark, d)
