"""The three sites' postings as one table: fields of their cards and pages, projections, crawling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.functions.salary_texts import liepin, qiancheng, zhaopin

UNIFIED = (
    "jobname companyname jobareastring degreestring workyearstring jobtags jobdescribe companytypestring companysizestring industrytype1str salarymin salarymax source _job_id _detail_link"
).split()
# Classes of a card and of its fields on each site.
CARDS = {
    "51job": ("joblist-item-job", {"jobname": "jname", "companyname": "cname", "jobareastring": "shrink-0", "salary": "sal", "jobtags": "tag", "company_facts": "dc"}),
    "liepin": ("job-detail-box", {"jobname": "ellipsis-1", "companyname": "company-name", "jobareastring": "job-dq", "salary": "job-salary", "jobtags": "job-labels"}),
    "zhaopin": ("joblist-box__item", {"jobname": "jobinfo__name", "companyname": "companyinfo__name", "jobareastring": "jobinfo__other-item", "salary": "jobinfo__salary", "jobtags": "joblist-box__item-tag"}),
}
# Classes of a page's description on each site, in the order in which they are tried.
DESCRIPTIONS = {
    "51job": ["job_msg", "bmsg", "job-detail"],
    "liepin": ["content", "job-intro-container", "main-description", "job-description", "job-intro", "job-detail-content"],
    "zhaopin": ["job-detail", "descript__detail", "pos-info-tit", "job-desc", "job-description", "pos-info-content"],
}


def first_piece(area: Column) -> Column:
    """The city of an area: what stands before a middle dot, blank or slash."""
    return F.trim(F.split(F.coalesce(area, F.lit("")), r"(?U)[·\s/]")[0])


def joined_tags(tags: Column) -> Column:
    """Array of tags as one text, without null and empty ones."""
    return F.coalesce(F.array_join(F.filter(tags, lambda t: t.isNotNull() & (t != "")), ","), F.lit(""))


def _text(raw: DataFrame, name: str, stripped: bool = False) -> Column:
    value = F.coalesce(F.col(name), F.lit("")) if name in raw.columns else F.lit("")
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "") if stripped else value


def _unified(raw: DataFrame, source: str, salary: tuple[Column, Column], given: dict[str, Column], keep: tuple[str, ...]) -> DataFrame:
    fields = {c: F.lit("") for c in UNIFIED} | {"_job_id": F.lit(None).cast("string")} | given
    fields |= {"salarymin": salary[0], "salarymax": salary[1], "source": F.lit(source)}
    return raw.select(*keep, *[fields[c].alias(c) for c in UNIFIED])


def from_51job(raw: DataFrame, salary: str = "salary", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cards of the first site: city before the first dot or blank, tags as one text, texts stripped.
    Missing columns and nulls are empty, an unreadable salary is (0, 0)."""
    tags = joined_tags(F.col("jobtags")) if "array" in raw.schema["jobtags"].dataType.simpleString() else _text(raw, "jobtags")
    stripped = ("jobname", "companyname", "degreestring", "workyearstring", "jobdescribe", "companytypestring", "companysizestring", "industrytype1str")
    given = {c: _text(raw, c, True) for c in stripped} | {"jobareastring": first_piece(_text(raw, "jobareastring")), "jobtags": tags} | {c: _text(raw, c) for c in ("_job_id", "_detail_link")}
    return _unified(raw, "51job", qiancheng(_text(raw, salary)), given, keep)


def from_liepin(raw: DataFrame, salary: str = "salary", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cards of the second site, fields as they stand; it gives no id of its own."""
    return _unified(raw, "liepin", liepin(_text(raw, salary)), {c: _text(raw, c) for c in UNIFIED if c not in ("_job_id", "salarymin", "salarymax", "source")}, keep)


def from_zhaopin(raw: DataFrame, salary: str = "salary", keep: tuple[str, ...] = ()) -> DataFrame:
    """Cards of the third site, which show neither degree, experience, tags nor what the company is."""
    return _unified(raw, "zhaopin", zhaopin(_text(raw, salary)), {c: _text(raw, c) for c in ("jobname", "companyname", "jobareastring", "jobdescribe", "_detail_link")}, keep)


def crawl(requests: DataFrame, fetch: Callable[[str, str, int], list[dict[str, Any]]], fields: list[str], most: int | None = None) -> DataFrame:
    """Rows of ``requests`` (keyword, city, page), asked for page by page.

    A (keyword, city) is one task's work, as its pages end with the first empty or failing one.
    Rows without a name leave. ``most`` keeps the first rows in the order of the requests; it is
    the cap that a crawl is given, not one on data that is there.
    """
    schema = "keyword string, city string, page int, place int, " + ", ".join(f"`{f}` string" for f in fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for keyword, city, page in pdf.sort_values("page")[["keyword", "city", "page"]].itertuples(index=False):
            try:
                found = fetch(keyword, city, int(page))
            except Exception:  # noqa: BLE001, a page that fails ends its city
                found = []
            if not found:
                break
            rows += [(keyword, city, page, k, *(None if r.get(f) is None else str(r[f]) for f in fields)) for k, r in enumerate(found) if r.get("jobname")]
        return pd.DataFrame(rows, columns=["keyword", "city", "page", "place", *fields])

    found = requests.select("keyword", "city", F.col("page").cast("int")).groupBy("keyword", "city").applyInPandas(run, schema)
    return found if most is None else found.orderBy("keyword", "city", "page", "place").limit(most)


def described(pages: DataFrame, id_col: str, html_col: str, source: str, least: int = 0) -> DataFrame:
    """(id, jobdescribe) of saved pages: the text of the first class of DESCRIPTIONS that a page has, of
    more than ``least`` characters; empty where there is none."""
    from talentweave.sources.readers import read_classes

    wanted = DESCRIPTIONS[source]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [read_classes(p, wanted) for p in pdf["page"]]
            yield pd.DataFrame({"id": pdf["id"], "jobdescribe": [next((t[c] for c in wanted if len(t.get(c, "")) > least), "") for t in texts]})

    return pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).alias("page")).mapInPandas(run, "id bigint, jobdescribe string")
