"""Queries of this package's operators, each over its whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm.canonical import field_names, map_values, posted_values
from talentweave.llm.cooccurrence import pair_statistics
from talentweave.llm.entity_match import matches, one_to_one
from talentweave.llm.leakage import leaks
from talentweave.llm.name_variants import employers, variant_pairs
from talentweave.llm.near_duplicates import classes_with_links, similar_pairs
from talentweave.llm.packing import containers, unused_space
from talentweave.llm.quality import NAMES, text_classes, text_statistics
from talentweave.session import table

# What TESTDATA.md fixes for its cases.
SIMILAR, LEAST_CHARS = 0.6, 60
PAIR_ROWS, PAIR_SHARE, PAIR_LIFT = 5, 1 / 200, 3


def _places(reference: DataFrame) -> list[str]:
    return field_names(reference, "city_name")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    values = posted_values(table(spark, folder, "normalized_job"), "job_no", ["city_name", "degree_name"], ["skills"])
    return map_values(values, table(spark, folder, "canonical_ref")).select("job_no", "field_name", "item_pos", "ref_id")


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values without an entry and how often they were typed."""
    values = posted_values(table(spark, folder, "normalized_job"), "job_no", ["city_name", "degree_name"], ["skills"])
    found = map_values(values, table(spark, folder, "canonical_ref")).where("ref_id = -1")
    return found.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("times"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return variant_pairs(employers(table(spark, folder, "normalized_job"), _places(table(spark, folder, "canonical_ref"))))


def p2_employers(spark: SparkSession, folder: str) -> DataFrame:
    """The employer of every spelling."""
    return employers(table(spark, folder, "normalized_job"), _places(table(spark, folder, "canonical_ref")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = similar_pairs(table(spark, folder, "normalized_job"), "job_no", "description", SIMILAR, LEAST_CHARS)
    return found.select(F.col("a").alias("job_no_a"), F.col("b").alias("job_no_b"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per posting: the class of its description and how many other classes are alike."""
    return classes_with_links(table(spark, folder, "normalized_job"), "job_no", "description", SIMILAR, LEAST_CHARS).withColumnRenamed("id", "job_no")


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    return matches(table(spark, folder, "normalized_job"), "job_no", table(spark, folder, "partner_job"), "listing_no", table(spark, folder, "canonical_ref"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _matched(spark, folder).select(F.col("id_a").alias("job_no"), F.col("id_b").alias("listing_no"))


def p5_assigned(spark: SparkSession, folder: str) -> DataFrame:
    """One partner at most for each posting and each listing, with its confidence."""
    return one_to_one(_matched(spark, folder)).select(F.col("id_a").alias("job_no"), F.col("id_b").alias("listing_no"), "confidence")


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs with enough rows and their measures."""
    found = pair_statistics(table(spark, folder, "normalized_job"), "skills", PAIR_ROWS, PAIR_SHARE)
    return found.select(
        F.col("item_a").alias("skill_a"), F.col("item_b").alias("skill_b"), "n_both", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio")
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pair_statistics(table(spark, folder, "normalized_job"), "skills", PAIR_ROWS, PAIR_SHARE)
    return found.where(F.col("n_both") * F.col("n_rows") >= PAIR_LIFT * F.col("n_a") * F.col("n_b")).select(F.col("item_a").alias("skill_a"), F.col("item_b").alias("skill_b"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return containers(table(spark, folder, "documents"), table(spark, folder, "container_spec"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each size are."""
    return unused_space(p8_containers(spark, folder), table(spark, folder, "container_spec"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), "doc_id", table(spark, folder, "eval_item"), "item_id").select("item_id", "doc_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Test items that leaked, in how many documents and with what share at most."""
    found = leaks(table(spark, folder, "documents"), "doc_id", table(spark, folder, "eval_item"), "item_id")
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.max("share"), 4).alias("greatest_share"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return text_classes(table(spark, folder, "documents"), table(spark, folder, "common_word")).where("text_class <> 'prose'").select("doc_id", "text_class")


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document."""
    found = text_statistics(table(spark, folder, "documents"), table(spark, folder, "common_word"))
    return found.select("doc_id", *[F.round(n, 6).alias(n) for n in NAMES])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_unmatched": p1_unmatched, "p2_found": p2_found, "p2_employers": p2_employers, "p4_found": p4_found, "p4_classes": p4_classes,
    "p5_found": p5_found, "p5_assigned": p5_assigned, "p6_found": p6_found, "p6_pairs": p6_pairs,
    "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_statistics": p10_statistics,
}

_PAIRS = """
WITH d AS (SELECT job_no, list_distinct(list_filter(skills, lambda x: x IS NOT NULL AND x <> '')) AS s FROM normalized_job),
e AS (SELECT job_no, unnest(s) AS skill FROM d),
c AS (SELECT skill, count(*) AS n FROM e GROUP BY skill),
p AS (SELECT a.skill AS skill_a, b.skill AS skill_b, count(*) AS n_both FROM e a JOIN e b ON a.job_no = b.job_no AND a.skill < b.skill GROUP BY 1, 2),
t AS (SELECT count(*) AS n_rows FROM normalized_job),
m AS (SELECT p.*, x.n AS n_a, y.n AS n_b, n_rows FROM p JOIN c x ON x.skill = skill_a JOIN c y ON y.skill = skill_b, t
      WHERE n_both >= 5 AND n_both * 200 >= n_rows)
"""
ORACLE: dict[str, str] = {
    "p6_found": _PAIRS + "SELECT skill_a, skill_b FROM m WHERE n_both * n_rows >= 3 * n_a * n_b",
    "p6_pairs": _PAIRS
    + """SELECT skill_a, skill_b, n_both, n_a, n_b, round(n_both::DOUBLE * n_rows / (n_a::DOUBLE * n_b), 6) AS lift,
    round(((n_both + 0.5::DOUBLE) * (n_rows - n_a - n_b + n_both + 0.5::DOUBLE)) / ((n_a - n_both + 0.5::DOUBLE) * (n_b - n_both + 0.5::DOUBLE)), 6) AS odds_ratio FROM m""",
}
