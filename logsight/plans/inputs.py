"""Shared Spark inputs for the catalogue (derived from the driver tables)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsight.functions.lineparse import parse_lines, to_canonical_events
from logsight.operators.clean import preprocess
from logsight.sources.fixtures import log_lines

FIXTURE_YEAR = 2026  # the fixture's syslog lines carry no year


def parsed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_lines(log_lines(spark, sf_dir))


def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_canonical_events(parsed_lines(spark, sf_dir))


def clean_lines(spark: SparkSession, sf_dir: str, with_features: bool = True) -> DataFrame:
    return preprocess(canonical_lines(spark, sf_dir), assume_year=FIXTURE_YEAR, with_features=with_features)
