"""Sinks: the graph's tables, triples by stage, and appends that survive a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.operators import around as A
from talentweave.operators import graph as G


def write_graph(jobs: DataFrame, folder: str, similar: bool = False) -> None:
    """Replaces the tables of the graph: postings, companies, nodes, edges in a folder for each
    relation, and on demand the similar pairs. Keys are checked before anything is written."""
    nodes, edges = G.nodes(jobs), G.edges(jobs)
    for table, key in ((nodes, ["id"]), (edges, ["source", "target", "relation"])):
        if not G.broken_keys(table, *key).isEmpty():
            raise ValueError(f"{key} isn't unique")
    own = jobs.select("job_id", "title", "salary_min", "salary_max", "salary_mid", "source", "detail_link")
    own.write.mode("overwrite").parquet(f"{folder}/jobs")
    G.companies(jobs).write.mode("overwrite").parquet(f"{folder}/companies")
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{folder}/edges")
    if similar:
        write_similar(jobs, folder)


def write_similar(jobs: DataFrame, folder: str) -> None:
    """Replaces the similar pairs."""
    A.similar_to(jobs).write.mode("overwrite").parquet(f"{folder}/similar_to")


def ensure_similar(jobs: DataFrame, folder: str) -> None:
    """Writes the similar pairs only if there are none yet."""
    try:
        missing = jobs.sparkSession.read.parquet(f"{folder}/similar_to").isEmpty()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        missing = True
    if missing:
        write_similar(jobs, folder)


def read_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Postings from the graph's tables; raises where there is no posting."""
    own, nodes, edges = (spark.read.parquet(f"{folder}/{t}") for t in ("jobs", "nodes", "edges"))
    found = G.postings_from_graph(own, nodes, edges)
    if found.isEmpty():
        raise ValueError(f"no posting in {folder}")
    return found


def write_stages(triples: DataFrame, folder: str) -> None:
    """Triples in a folder for each stage; reading the whole is the final result."""
    triples.write.mode("overwrite").partitionBy("stage").parquet(folder)


def write_unless_there(df: DataFrame, folder: str) -> None:
    """Writes only if nothing has been written yet."""
    df.write.mode("ignore").parquet(folder)


def append_new(df: DataFrame, folder: str, key: str) -> int:
    """Appends the rows whose key isn't there yet, each key once, and returns their number: a run that
    was broken off goes on where it ended. The keys that are there are read, not their rows."""
    spark = df.sparkSession
    fresh = df.where(F.col(key).isNotNull()).dropDuplicates([key])
    try:
        fresh = fresh.join(spark.read.parquet(folder).select(key), key, "left_anti").select(*df.columns)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    before = _rows(spark, folder)
    fresh.write.mode("append").parquet(folder)
    return _rows(spark, folder) - before


def _rows(spark: SparkSession, folder: str) -> int:
    try:
        return spark.read.parquet(folder).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return 0


def write_processed(jobs: DataFrame, folder: str, order_col: str, most: int = 1000) -> None:
    """Collected postings as they came, and deduplicated ones, of which the first ``most`` by their order
    are kept (a fixed size of the report, not of the work)."""
    from talentweave.operators.postings import first_wins

    jobs.write.mode("overwrite").json(f"{folder}/interim")
    first_wins(jobs, order_col).orderBy(order_col).limit(most).write.mode("overwrite").json(f"{folder}/processed")


def write_disambiguation(words: DataFrame, mapping: DataFrame, id_col: str, folder: str) -> None:
    """The steps of a disambiguation: words by record, rule matches, clusters, the records' words
    after it, words nobody resolved, and the summary."""
    from talentweave.operators import entities as E

    steps = {
        "preprocessed": words, "rule_matched": E.rule_match(E.word_counts(words)), "clustered": E.cluster_report(mapping), "mapping": mapping,
        "result": E.apply_mapping(words, mapping, id_col), "unresolved": E.unresolved(mapping), "summary": E.mapping_summary(mapping),
    }
    for name, table in steps.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
