"""Raw postings to normalized ones, and the ways to drop repeated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.functions import normalize as N
from talentweave.functions.text import dedup_key, normalize_text, safe_salary, salary_mid, stable_job_id
from talentweave.operators.extract import extraction


def _or(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def normalize_jobs(raw: DataFrame, id_col: str = "raw_no") -> DataFrame:
    """The nineteen fields of a normalized posting and the row's id, in one narrow projection.

    Null and blank fields take the documented defaults; unreadable salaries are 0. Repeated rows
    stay, other columns are dropped, an empty table gives an empty result.
    """
    title = normalize_text(F.col("jobname"))
    low, high = safe_salary(F.col("salarymin")), safe_salary(F.col("salarymax"))
    return extraction(raw, "jobname", "jobtags", "jobdescribe").select(
        F.col(id_col), title.alias("title"), _or(N.company(F.col("companyname")), "未知公司").alias("company_name"), _or(N.city(F.col("jobareastring")), "未知").alias("city_name"),
        _or(N.industry(F.col("industrytype1str")), "未知行业").alias("industry_name"), N.degree(F.col("degreestring")).alias("degree_name"), N.experience(F.col("workyearstring")).alias("experience_name"),
        low.alias("salary_min"), high.alias("salary_max"), salary_mid(low, high).alias("salary_mid"), _or(normalize_text(F.col("source")), "51job").alias("source"),
        normalize_text(F.col("jobdescribe")).alias("description"), normalize_text(F.col("_detail_link")).alias("detail_link"), normalize_text(F.col("companytypestring")).alias("company_type"),
        normalize_text(F.col("companysizestring")).alias("company_size"), "skills", "benefits", "keywords", "raw_tags",
        stable_job_id(F.col("_job_id"), title, normalize_text(F.col("companyname")), normalize_text(F.col("jobareastring"))).alias("job_id"),
    )


def first_wins(df: DataFrame, order_col: str, title: str = "jobname", company: str = "companyname") -> DataFrame:
    """The first row of each (title, company), blanks and case aside; rows without one of them leave.
    Ranks are cut within each task before the shuffle, so a hot key moves a row a task."""
    named = df.where(F.col(title).rlike(r"\S") & F.col(company).rlike(r"\S")).withColumn("_key", dedup_key(F.col(title), F.col(company)))
    ranked = named.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(order_col)))
    return ranked.where("_rank = 1").drop("_rank", "_key")


def last_wins(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """The last row of each key; null keys leave. Aggregated by task before the shuffle."""
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*df.columns), F.col(order_col)).alias("_row"))
    return kept.select("_row.*")
