"""Sources: posting files, recognized records, requests of a crawl, and cards on saved pages."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS = "_job_id jobname companyname jobareastring industrytype1str degreestring workyearstring salarymin salarymax jobtags jobdescribe companytypestring companysizestring source _detail_link".split()
#: Unified posting; everything is text, as sites write it.
POSTING = T.StructType([T.StructField(c, T.StringType()) for c in _TEXTS])
#: Posting with recognized entities; a null array means that nothing was asked, an empty one that nothing was found.
RECOGNIZED = T.StructType([
    *[T.StructField(c, T.StringType()) for c in "jobid jobname companyname jobarea degree experience jobdescription industry source detaillink".split()],
    T.StructField("salarymin", T.IntegerType()), T.StructField("salarymax", T.IntegerType()),
    T.StructField("namedentity", T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("word", T.StringType())]))),
])
#: What a card on a page holds.
CARD = "page_id bigint, card int, jobname string, companyname string, jobareastring string, salary string, jobtags string, _detail_link string"


def read_json(spark: SparkSession, path: str, schema: T.StructType = POSTING) -> DataFrame:
    """Files that hold one JSON array each; keys that the schema lacks are left out."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def union_sources(*sources: DataFrame) -> DataFrame:
    """Rows of all sources; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def crawl_requests(spark: SparkSession, keywords: list[str], cities: list[str], pages: int) -> DataFrame:
    """Every (keyword, city, page) to ask for, generated by the executors."""
    grid = spark.range(len(keywords) * len(cities) * pages)
    k = (F.col("id") / (len(cities) * pages)).cast("int")
    c = (F.pmod(F.col("id"), F.lit(len(cities) * pages)) / pages).cast("int")
    return grid.select(F.array(*map(F.lit, keywords))[k].alias("keyword"), F.array(*map(F.lit, cities))[c].alias("city"), (F.pmod("id", F.lit(pages)) + 1).cast("int").alias("page"))


class _Cards(HTMLParser):
    """Collects the text of classed elements within elements of one class."""

    def __init__(self, card: str, fields: dict[str, str]) -> None:
        super().__init__(convert_charrefs=True)
        self.card, self.fields, self.depth, self.stack = card, fields, 0, []
        self.found: list[dict[str, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        own = {k: v or "" for k, v in attrs}
        names = own.get("class", "").split()
        if self.card in names:
            self.found.append({})
            self.depth = len(self.stack) + 1
        self.stack.append(next((f for f, c in self.fields.items() if c in names), None) if self.depth else None)
        if self.depth and self.found:
            if own.get("sensorsdata"):
                self.found[-1].setdefault("json", []).append(own["sensorsdata"])
            if tag == "a" and own.get("href"):
                self.found[-1].setdefault("_detail_link", []).append(own["href"])

    def handle_endtag(self, tag: str) -> None:
        if self.stack:
            self.stack.pop()
            if self.depth and len(self.stack) < self.depth:
                self.depth = 0

    def handle_data(self, data: str) -> None:
        if self.depth and self.stack and data.strip() and (own := next((s for s in reversed(self.stack) if s), None)):
            self.found[-1].setdefault(own, []).append(data.strip())


def read_cards(page: str | None, card: str, fields: dict[str, str]) -> list[dict[str, str]]:
    """Cards of a page: the text of each field, tags joined by commas, the first link. What the page
    lacks is taken from the JSON that a card may carry. Cards without title and company leave."""
    parser = _Cards(card, fields)
    parser.feed(page or "")
    cards = []
    for raw in parser.found:
        try:
            extra = json.loads(html.unescape(raw["json"][0])) if "json" in raw else {}
        except ValueError:
            extra = {}
        own = {f: ("," if f == "jobtags" else " ").join(raw.get(f, [])) for f in fields}
        own["_detail_link"] = raw.get("_detail_link", [""])[0]
        for ours, theirs in (("jobname", "jobTitle"), ("companyname", "companyName"), ("jobareastring", "jobArea"), ("salary", "jobSalary")):
            own[ours] = own.get(ours) or str(extra.get(theirs) or "")
        if own["jobname"] or own["companyname"]:
            cards.append(own)
    return cards


def cards(pages: DataFrame, id_col: str, html_col: str, card: str, fields: dict[str, str]) -> DataFrame:
    """One row per card of every saved page; null and broken pages have what can be read."""
    names = [c.split()[0] for c in CARD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, k, *(c.get(n, "") for n in names[2:])) for i, p in zip(pdf["id"], pdf["page"], strict=True) for k, c in enumerate(read_cards(p, card, fields))]
            yield pd.DataFrame(rows, columns=names)

    return pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(html_col).alias("page")).mapInPandas(run, CARD)


class _Classes(HTMLParser):
    """Collects the text within the first element of each wanted class."""

    def __init__(self, wanted: list[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted, self.stack, self.open = wanted, 0, {}
        self.found: dict[str, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        self.stack += 1
        for name in (dict(attrs).get("class") or "").split():
            if name in self.wanted and name not in self.found:
                self.found[name] = []
                self.open[name] = self.stack

    def handle_endtag(self, tag: str) -> None:
        self.open = {n: d for n, d in self.open.items() if d < self.stack}
        self.stack = max(0, self.stack - 1)

    def handle_data(self, data: str) -> None:
        for name in self.open:
            self.found[name].append(data)


def read_classes(page: str | None, wanted: list[str]) -> dict[str, str]:
    """Text of the first element of each class that a page has."""
    parser = _Classes(wanted)
    parser.feed(page or "")
    return {n: " ".join("".join(t).split()) for n, t in parser.found.items()}


def first_long_text(*candidates: str, least: int = 50):
    """First of several columns whose text is longer than ``least``, as a column; null if none is."""
    return F.coalesce(*[F.when(F.length(c) > least, F.col(c)) for c in candidates])
