"""Salary ranges as three sites write them, in thousands a month; (0, 0) where none is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pair(text: Column, pattern: str) -> tuple[Column, Column]:
    return tuple(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("int") for k in (1, 2))


def qiancheng(text: Column) -> tuple[Column, Column]:
    """Both ends times ten if one is below ten; swapped ends are put right."""
    a, b = _pair(F.translate(F.lower(F.coalesce(text, F.lit(""))), ", 万", ""), r"(\d+)\s*[-–~]\s*(\d+)")
    times = F.when(F.least(a, b) < 10, 10).otherwise(1)
    return F.coalesce(F.least(a, b) * times, F.lit(0)), F.coalesce(F.greatest(a, b) * times, F.lit(0))


def liepin(text: Column) -> tuple[Column, Column]:
    """Ten thousands are a year's pay."""
    yearly = F.contains(text, F.lit("万"))
    a, b = _pair(F.coalesce(text, F.lit("")), r"(\d+)-(\d+)")
    return tuple(F.coalesce(F.when(yearly, F.floor(x * 10 / 12).cast("int")).otherwise(x), F.lit(0)) for x in (a, b))


def zhaopin(text: Column) -> tuple[Column, Column]:
    """Ten thousands are a month's pay."""
    a, b = _pair(F.coalesce(text, F.lit("")), r"(\d+)-(\d+)")
    times = F.when(F.contains(text, F.lit("万")), 10).otherwise(1)
    return F.coalesce(a * times, F.lit(0)), F.coalesce(b * times, F.lit(0))
