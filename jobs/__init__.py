"""Runnable jobs, and their queries: each runs a job twice into one new folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import customer_values, word_ranks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_word_ranks": word_ranks.job1_word_ranks, "job2_customer_values": customer_values.job2_customer_values}
ORACLE_SQL: dict[str, str] = {"job1_word_ranks": word_ranks.SQL, "job2_customer_values": customer_values.SQL}
