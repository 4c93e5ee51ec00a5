"""Property graph of postings: nodes, edges, indexes, and questions about all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.functions.text import node_id
from talentweave.operators.postings import last_wins

# Label and relation of each field of a posting.
SCALARS = {"company_name": ("Company", "POSTED_BY"), "city_name": ("City", "LOCATED_IN"), "industry_name": ("Industry", "IN_INDUSTRY"), "degree_name": ("Degree", "REQUIRES_DEGREE"), "experience_name": ("Experience", "REQUIRES_EXPERIENCE")}
LISTS = {"skills": ("Skill", "REQUIRES_SKILL"), "benefits": ("Benefit", "HAS_BENEFIT"), "keywords": ("Keyword", "HAS_KEYWORD")}
# What stands for a blank field.
DEFAULTS = {"company_name": "未知公司", "city_name": "未知", "industry_name": "未知行业", "degree_name": "不限", "experience_name": "不限"}


def postings(normalized: DataFrame) -> DataFrame:
    """One row for each job_id, the one loaded last, with defaults and clean lists."""
    kept = last_wins(normalized, "job_id", "job_no")
    scalars = {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) for c, d in DEFAULTS.items()}
    lists = {c: F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))) for c in LISTS}
    return kept.withColumns({**scalars, **lists})


def job_entities(jobs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(job_id, relation, label, name) of every entity of a posting: one scan, one explode. Fields that
    the table lacks have no entities; the columns ``keep`` are carried along."""
    one = [F.array(F.struct(F.lit(r).alias("relation"), F.lit(lb).alias("label"), F.col(c).alias("name"))) for c, (lb, r) in SCALARS.items() if c in jobs.columns]
    many = []
    for c, (label, relation) in LISTS.items():
        if c in jobs.columns:
            many.append(F.expr(f"transform(`{c}`, x -> struct('{relation}' AS relation, '{label}' AS label, x AS name))"))
    return jobs.select("job_id", *keep, F.explode(F.concat(*one, *many)).alias("_e")).select("job_id", *keep, "_e.*")


def nodes(jobs: DataFrame) -> DataFrame:
    """(id, label, name): postings and their entities, each once."""
    own = jobs.select(F.concat(F.lit("job:"), "job_id").alias("id"), F.lit("Job").alias("label"), F.coalesce("title", "job_id").alias("name"))
    entities = job_entities(jobs).select("label", "name").distinct()
    return own.unionByName(entities.select(node_id(F.col("label"), F.col("name")).alias("id"), "label", "name"))


def edges(jobs: DataFrame) -> DataFrame:
    """(source, target, relation), each once; companies belong to their industries."""
    own = job_entities(jobs).select(F.concat(F.lit("job:"), "job_id").alias("source"), node_id(F.col("label"), F.col("name")).alias("target"), "relation")
    belongs = jobs.select("company_name", "industry_name").distinct().select(
        node_id(F.lit("Company"), F.col("company_name")).alias("source"), node_id(F.lit("Industry"), F.col("industry_name")).alias("target"), F.lit("BELONGS_TO").alias("relation")
    )
    return own.distinct().unionByName(belongs)


def index_sizes(jobs: DataFrame) -> DataFrame:
    """(label, name, jobs): how many postings each entity has; the index itself is job_entities."""
    return job_entities(jobs).groupBy("label", "name").agg(F.count(F.lit(1)).alias("jobs"))


def top_entities(jobs: DataFrame, label: str, limit: int) -> DataFrame:
    """The entities of a label in most postings, ties by name."""
    return index_sizes(jobs).where(F.col("label") == label).select("name", F.col("jobs").alias("count")).orderBy(F.desc("count"), "name").limit(limit)


def insights(jobs: DataFrame, limit: int) -> DataFrame:
    """The most frequent skills, cities, industries and benefits."""
    kinds = {"skills": "Skill", "cities": "City", "industries": "Industry", "benefits": "Benefit"}
    parts = [top_entities(jobs, label, limit).select(F.lit(kind).alias("kind"), "name", "count") for kind, label in kinds.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def stats(jobs: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """One row: how many postings and entities of each label, and averages per posting; with a row
    ``similar`` (see similar_pairs) also what that counts."""
    counts = index_sizes(jobs).groupBy().agg(*[F.count_if(F.col("label") == lb).alias(f"total_{lb.lower()}") for lb, _ in [*SCALARS.values(), *LISTS.values()]])
    average = jobs.agg(F.count(F.lit(1)).alias("total_jobs"), F.round(F.avg(F.size("skills")), 2).alias("avg_skills_per_job"), F.round(F.avg(F.size("benefits")), 2).alias("avg_benefits_per_job"))
    whole = average.crossJoin(F.broadcast(counts))
    if similar is None:
        return whole
    return whole.crossJoin(F.broadcast(similar))


def entities_around(jobs: DataFrame, job_id: str, limit: int = 80) -> DataFrame:
    """(relation, label, name, node) of a posting's entities, by weight of the relation and name."""
    # Relations in the order in which they are shown.
    order = F.expr("CASE relation WHEN 'REQUIRES_SKILL' THEN 1 WHEN 'LOCATED_IN' THEN 2 WHEN 'IN_INDUSTRY' THEN 3 WHEN 'POSTED_BY' THEN 4 WHEN 'HAS_BENEFIT' THEN 5 WHEN 'HAS_KEYWORD' THEN 6 ELSE 7 END")
    own = job_entities(jobs.where(F.col("job_id") == job_id)).withColumn("rank", order)
    return own.orderBy("rank", "name", "label").limit(limit).select("relation", "label", "name", node_id(F.col("label"), F.col("name")).alias("node"))


def summary(jobs: DataFrame) -> DataFrame:
    """The seventeen fields by which a posting is shown, with defaults; lists are sorted."""
    # What stands for a missing field.
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("salary_min", "salary_max")} | {"salary_mid": F.coalesce("salary_mid", F.lit(0.0))}
    text = {c: F.coalesce(c, F.lit("")) for c in ("company_type", "company_size", "detail_link")} | {"source": F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("51job"))}
    return jobs.withColumns({**zero, **text}).select("job_id", "title", *DEFAULTS, "salary_min", "salary_max", "salary_mid", "company_type", "company_size", *LISTS, "source", "detail_link")


# What a node shows of its properties, by label; other labels show their name.
SHOWN = {"Job": ["job_id", "title", "salary_min", "salary_max", "salary_mid", "source", "detail_link"], "Company": ["name", "company_type", "company_size"]}


def shown(fields: list[str]) -> Column:
    """Map of those fields of a row that are neither null nor empty, as texts."""
    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (e["value"] != "")))


def companies(jobs: DataFrame) -> DataFrame:
    """(name, company_type, company_size) of each company, as its last posting (by job_no) has it."""
    last = jobs.groupBy(F.col("company_name").alias("name")).agg(F.max_by(F.struct("company_type", "company_size"), "job_no").alias("_c"))
    return last.select("name", "_c.*")


def node_properties(jobs: DataFrame) -> DataFrame:
    """(id, label, name, properties) of every node, with what it shows."""
    own = jobs.select(F.concat(F.lit("job:"), "job_id").alias("id"), F.lit("Job").alias("label"), F.coalesce("title", "job_id").alias("name"), shown(SHOWN["Job"]).alias("properties"))
    firms = companies(jobs).select(node_id(F.lit("Company"), F.col("name")).alias("id"), F.lit("Company").alias("label"), "name", shown(SHOWN["Company"]).alias("properties"))
    others = job_entities(jobs).where(F.col("label") != "Company").select("label", "name").distinct()
    return own.unionByName(firms).unionByName(others.select(node_id(F.col("label"), F.col("name")).alias("id"), "label", "name", shown(["name"]).alias("properties")))


def postings_from_graph(own: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Postings put together again from a graph's tables: ``own`` (job_id, title, salaries, source,
    detail_link), nodes (id, label, name), edges (source, target, relation).

    Postings without a company leave, other missing fields take the defaults, lists come sorted.
    Every posting's entities are grouped once, with no product of its lists. Of several
    entities of one field the first by name counts.
    """
    named = edges.join(nodes.where(F.col("label") != "Job").select(F.col("id").alias("target"), "label", "name"), "target")
    by = named.where(F.col("source").startswith("job:")).select(F.substring("source", F.lit(5), F.lit(1 << 20)).alias("job_id"), "label", "name").distinct()
    one = [F.min(F.when(F.col("label") == label, F.col("name"))).alias(c) for c, (label, _) in SCALARS.items()]
    many = [F.array_sort(F.collect_set(F.when(F.col("label") == label, F.col("name")))).alias(c) for c, (label, _) in LISTS.items()]
    grouped = by.groupBy("job_id").agg(*one, *many).where(F.col("company_name").isNotNull())
    filled = grouped.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in DEFAULTS.items()})
    return own.join(filled, "job_id")


def broken_keys(table: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once; empty for a sound table."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
