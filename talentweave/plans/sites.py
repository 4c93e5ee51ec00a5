"""Queries about what sites deliver, with their SQL."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.plans.postings import _A, _B, _BLANK, _X, _Y, query
from talentweave.session import table
from talentweave.sources import readers
from talentweave.sources import sites as S

_STRIP = f"regexp_replace(coalesce({{x}}, ''), '^{_BLANK}|{_BLANK}$', '', 'g')"
_PIECE = f"trim(regexp_split_to_array(coalesce(jobareastring, ''), '[·/]|{_BLANK[:-1]}')[1])"


def _strip(x: str) -> str:
    return _STRIP.replace("{x}", x)


def _raw(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job_raw").withColumn("salary", F.col("salarymin"))


@query("F28_first_piece", f"SELECT raw_no, {_PIECE} AS city FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job_raw").select("raw_no", S.first_piece(F.col("jobareastring")).alias("city"))


@query("F29_joined_tags", "SELECT job_no, coalesce(array_to_string(list_filter(raw_tags, lambda x: x IS NOT NULL AND x <> ''), ','), '') AS tags FROM normalized_job")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "normalized_job").select("job_no", S.joined_tags(F.col("raw_tags")).alias("tags"))


_LOW = "CASE WHEN least(a, b) < 10 THEN least(a, b) * 10 ELSE least(a, b) END"
_STRIPPED = ", ".join(f"{_strip(c)} AS {c}" for c in ("jobname", "companyname", "degreestring", "workyearstring", "jobdescribe", "companytypestring", "companysizestring", "industrytype1str"))
_PLAIN = ", ".join(f"coalesce({c}, '') AS {c}" for c in ("jobname", "companyname", "jobareastring", "degreestring", "workyearstring", "jobtags", "jobdescribe", "companytypestring", "companysizestring", "industrytype1str", "_detail_link"))


@query(
    "F30_unified_51job",
    f"WITH s AS (SELECT raw_no, {_A} AS a, {_B} AS b FROM job_raw), t AS (SELECT raw_no, CASE WHEN least(a, b) < 10 THEN a * 10 ELSE a END AS a, CASE WHEN least(a, b) < 10 THEN b * 10 ELSE b END AS b FROM s) "
    f"SELECT raw_no, {_STRIPPED}, {_PIECE} AS jobareastring, coalesce(jobtags, '') AS jobtags, coalesce(least(a, b), 0) AS salarymin, coalesce(greatest(a, b), 0) AS salarymax, '51job' AS source, coalesce(_job_id, '') AS _job_id, coalesce(_detail_link, '') AS _detail_link FROM job_raw JOIN t USING (raw_no)",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return S.from_51job(_raw(spark, folder), keep=("raw_no",))


@query("F30_unified_liepin", f"SELECT raw_no, {_PLAIN}, coalesce(CASE WHEN contains(salarymin, '万') THEN floor({_X} * 10 / 12)::INTEGER ELSE {_X} END, 0) AS salarymin, coalesce(CASE WHEN contains(salarymin, '万') THEN floor({_Y} * 10 / 12)::INTEGER ELSE {_Y} END, 0) AS salarymax, 'liepin' AS source, NULL::VARCHAR AS _job_id FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return S.from_liepin(_raw(spark, folder), keep=("raw_no",))


_SHORT = ", ".join(f"coalesce({c}, '') AS {c}" for c in ("jobname", "companyname", "jobareastring", "jobdescribe", "_detail_link")) + ", " + ", ".join(f"'' AS {c}" for c in ("degreestring", "workyearstring", "jobtags", "companytypestring", "companysizestring", "industrytype1str"))


@query("F30_unified_zhaopin", f"SELECT raw_no, {_SHORT}, coalesce(CASE WHEN contains(salarymin, '万') THEN {_X} * 10 ELSE {_X} END, 0) AS salarymin, coalesce(CASE WHEN contains(salarymin, '万') THEN {_Y} * 10 ELSE {_Y} END, 0) AS salarymax, 'zhaopin' AS source, NULL::VARCHAR AS _job_id FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return S.from_zhaopin(_raw(spark, folder), keep=("raw_no",))


_KEYWORDS, _CITIES = ["python", "java", "sql"], ["a", "b", "c", "d"]


@query("J15_crawl_requests", f"SELECT keyword, city, (p + 1)::INTEGER AS page FROM (SELECT unnest({_KEYWORDS}) AS keyword), (SELECT unnest({_CITIES}) AS city), range(5) r(p)")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return readers.crawl_requests(spark, _KEYWORDS, _CITIES, 5)


def _fetch(keyword: str, city: str, page: int) -> list[dict[str, Any]]:
    """A stand-in for a site: pages get shorter, some cities end early, some rows lack a name."""
    return [{"jobname": "" if k == 2 else f"{keyword}-{city}-{page}-{k}"} for k in range((len(keyword) + ord(city) - page) % 5)]


_FOUND = (
    f"WITH r AS (SELECT keyword, city, p AS page, (len(keyword) + ascii(city) - p) % 5 AS n FROM (SELECT unnest({_KEYWORDS}) AS keyword), (SELECT unnest({_CITIES}) AS city), range(1, 6) x(p)), "
    "o AS (SELECT *, min(CASE WHEN n = 0 THEN page END) OVER (PARTITION BY keyword, city) AS ends FROM r), f AS (SELECT keyword, city, page::INTEGER AS page, k::INTEGER AS place, keyword || '-' || city || '-' || page || '-' || k AS jobname FROM o, range(5) y(k) WHERE k < n AND k <> 2 AND page < coalesce(ends, 99)) "
)


@query("S8_crawl", _FOUND + "SELECT * FROM f")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return S.crawl(readers.crawl_requests(spark, _KEYWORDS, _CITIES, 5), _fetch, ["jobname"])


@query("L14_crawl_capped", _FOUND + "SELECT * FROM f ORDER BY keyword, city, page, place LIMIT 25")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return S.crawl(readers.crawl_requests(spark, _KEYWORDS, _CITIES, 5), _fetch, ["jobname"], 25)


@query("U3_union_of_sources", "SELECT source, count(*) AS n, count(_job_id) AS with_id FROM (SELECT '51job' AS source, coalesce(_job_id, '') AS _job_id FROM job_raw UNION ALL SELECT 'liepin', NULL FROM job_raw UNION ALL SELECT 'zhaopin', NULL FROM job_raw) GROUP BY source")
def _(spark: SparkSession, folder: str) -> DataFrame:
    raw = _raw(spark, folder)
    every = readers.union_sources(S.from_51job(raw), S.from_liepin(raw).drop("_job_id"), S.from_zhaopin(raw).drop("_job_id"))
    return every.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("_job_id").alias("with_id"))


@query("A16_with_description", "SELECT count(*) AS jobs, count(*) FILTER (regexp_replace(jobdescribe, '" + _BLANK + "', '', 'g') <> '') AS described FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job_raw").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("jobdescribe").rlike(r"(?U)\S")).alias("described"))
