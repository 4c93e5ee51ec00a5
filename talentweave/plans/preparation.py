"""Queries of the general operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.operators.pay_units import CONFIDENT, to_monthly
from talentweave.operators.value_split import split_field
from talentweave.session import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_field(table(spark, folder, "job_raw"), "raw_no", "jobtags")


def _paid(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "job_raw")
    return to_monthly(jobs, table(spark, folder, "source_note"), "raw_no", "salarymin", "salarymax", "jobdescribe", "source", "industrytype1str", "_job_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    sure = _paid(spark, folder).where(F.col("monthly_yuan").isNotNull() & (F.col("confidence") >= CONFIDENT))
    return sure.select(F.col("id").alias("raw_no"), "bound", "monthly_yuan")


def p7_review(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts whose unit nobody wrote and the model isn't sure of."""
    unsure = _paid(spark, folder).where(F.col("monthly_yuan").isNull() | (F.col("confidence") < CONFIDENT))
    return unsure.select(F.col("id").alias("raw_no"), "bound", "amount", "scale", "period", F.round("confidence", 4).alias("confidence"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p3_found": p3_found, "p7_found": p7_found, "p7_review": p7_review}
ORACLE: dict[str, str] = {}
