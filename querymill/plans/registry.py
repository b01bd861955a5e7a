"""Queries of the core by name."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from querymill.plans.base import ORACLES, QUERIES

MODULES = ("dialect_queries", "profile_queries", "corpus_queries", "sampling_queries", "match_queries", "workload_queries", "text_queries", "form_queries", "wording_queries", "draw_queries")
for _m in MODULES:
    importlib.import_module(f"querymill.plans.{_m}")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return QUERIES["flagship_top_groups"](spark, d)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
