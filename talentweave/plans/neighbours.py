"""Queries about one posting's surroundings, recommendations, and the graph's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.operators import around as A
from talentweave.operators import graph as G
from talentweave.operators import ranking as R
from talentweave.plans.postings import _ENTITIES, _JOBS, _WITH, _jobs, _node, _q, _seed, query, similar_sql

_FIRST = "(SELECT min(job_id) FROM jobs)"
_EVERY = "SELECT job_id FROM jobs"


def paths_sql(hops: int, most: int | None, entities: int | None, mids: int | None, limit: int | None, targets: str | None = None) -> str:
    """CTEs after jobs and je that end in paths (job_id, hops, relations, nodes, score) from the first
    posting; with ``targets`` the best ones to each of these. What is None is not cut."""
    goal = f" AND {{}} IN ({targets})" if targets else ""
    cut = "" if targets or most is None else f"ORDER BY score DESC, title, job_id, p, q LIMIT {most}"
    named = "SELECT job_id, title, hops, relations, list_filter([st, p, q, title], lambda x: x IS NOT NULL) AS nodes, score FROM"
    parts = [
        f"b1 AS ({named} (SELECT y AS job_id, title, 1 AS hops, ['SIMILAR_TO'] AS relations, st, NULL AS p, NULL AS q, round(sup / sqrt(1.0::DOUBLE), 4) AS score FROM sim JOIN sd ON x = s JOIN t ON t.job_id = y WHERE TRUE{goal.format('y')} {cut}))",
        f"b2 AS ({named} (SELECT via.job_id, title, 2 AS hops, [relation, relation] AS relations, st, name AS p, NULL AS q, round(rarity / sqrt(2.0::DOUBLE), 4) AS score FROM via JOIN t USING (job_id), sd WHERE TRUE{goal.format('via.job_id')} {cut}))",
        f"b3 AS ({named} (SELECT b.y AS job_id, t.title, 2 AS hops, ['SIMILAR_TO', 'SIMILAR_TO'] AS relations, st, m.title AS p, NULL AS q, round((a.sup + b.sup) / sqrt(2.0::DOUBLE), 4) AS score "
        f"FROM near a JOIN sim b ON b.x = a.y JOIN t m ON m.job_id = a.y JOIN t ON t.job_id = b.y, sd WHERE b.y <> {_FIRST}{goal.format('b.y')} {cut}))",
        f"b4 AS ({named} (SELECT b.y AS job_id, t.title, 3 AS hops, [relation, relation, 'SIMILAR_TO'] AS relations, st, name AS p, m.title AS q, round((rarity + b.sup) / sqrt(3.0::DOUBLE), 4) AS score "
        f"FROM few JOIN sim b ON b.x = few.job_id JOIN t m ON m.job_id = few.job_id JOIN t ON t.job_id = b.y, sd WHERE b.y <> {_FIRST}{goal.format('b.y')} {cut}))",
    ]
    used = ["b1", "b2", "b3", "b4"][: 1 if hops == 1 else 3 if hops == 2 else 4]
    union = " UNION ALL ".join(f"SELECT * FROM {b}" for b in used)
    last = "QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY score DESC, hops, nodes) <= " if targets else "ORDER BY score DESC, hops, title, job_id, nodes LIMIT "
    last = "" if limit is None else f"{last}{limit}"
    rare, few = ["" if n is None else f"ORDER BY {by} LIMIT {n}" for by, n in (("df, name, label", entities), ("rarity DESC, job_id, name, label", mids))]
    return (
        f"sd AS (SELECT job_id AS s, coalesce(title, job_id) AS st FROM jobs WHERE job_id = {_FIRST}), t AS (SELECT job_id, coalesce(title, job_id) AS title FROM jobs), n AS (SELECT count(*) AS total FROM jobs), "
        "df AS (SELECT label, name, count(*) AS df FROM je GROUP BY ALL), rare AS (SELECT DISTINCT relation, label, name, df, ln((total + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) AS rarity FROM je JOIN sd ON job_id = s JOIN df USING (label, name), n "
        f"{rare}), via AS (SELECT e.job_id, r.relation, r.label, r.name, rarity FROM rare r JOIN je e USING (label, name), sd WHERE e.job_id <> s), "
        "near AS MATERIALIZED (SELECT y, sup FROM sim JOIN sd ON x = s), "
        f"few AS MATERIALIZED (SELECT * FROM via {few}), {', '.join(parts)}, paths AS (SELECT * FROM ({union}) {last})"
    )


_EXPLAINED = "array_to_string(list_transform(range(1, len(relations) + 1), lambda i: nodes[i] || ' -[' || relations[i] || ']- ' || nodes[i + 1]), '；')"
_START = f"WITH {_JOBS}, {_ENTITIES}, {similar_sql(_EVERY)}, "


def _path_rows(found: DataFrame) -> DataFrame:
    return R.explanation(found).select("job_id", "hops", "score", "explanation")


@query("G16_paths_one_hop", _START + paths_sql(1, 50, 40, 60, 10) + f" SELECT job_id, hops, score, {_EXPLAINED} AS explanation FROM paths")
def _(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return _path_rows(R.paths(jobs, _seed(jobs), 1, 10))


@query("G16_paths_two_hops", _START + paths_sql(2, 200, 120, 160, 50) + f" SELECT job_id, hops, score, {_EXPLAINED} AS explanation FROM paths")
def _(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return _path_rows(R.paths(jobs, _seed(jobs), 2, 50))


@query("G18_reasoning_paths", _START + paths_sql(3, 50, 40, 60, 10) + f" SELECT job_id, hops, score, {_EXPLAINED} AS explanation FROM paths")
def _(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return _path_rows(R.paths(jobs, _seed(jobs), 3, 10))


_BEST = paths_sql(3, 400, 120, 160, 600)


@query("G17_path_scores", _START + paths_sql(3, None, None, None, None) + " SELECT job_id, max(score) AS path_score FROM paths GROUP BY job_id")
def _(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return R.best_paths(jobs, _seed(jobs))


_TOP = "SELECT y FROM (SELECT y, row_number() OVER (ORDER BY round(raw, 4) DESC, salary_mid DESC, y) AS r FROM sim JOIN jobs ON job_id = y WHERE x = (SELECT min(job_id) FROM jobs)) WHERE r <= 10"


@query("G16_paths_to_similar", _START + paths_sql(3, 50, 40, 40, 2, _TOP) + f" SELECT job_id, hops, score, {_EXPLAINED} AS explanation FROM paths")
def _(spark: SparkSession, folder: str) -> DataFrame:
    """The two best paths to each of the ten most similar postings."""
    jobs = _jobs(spark, folder)
    seed = _seed(jobs)
    top = R.similar_jobs(jobs.where(F.col("job_id") == seed), jobs, 10)
    return _path_rows(R.paths_to(jobs, seed, top, 3, 2))


_PROFILE = R.Profile(skills=["Python", "机器学习", "Kafka"], keywords=["低代码", "Docker"], benefits=["带薪年休", "年度体检"], city="上海", industry="金融科技", least_salary=15)
_COLD = R.Profile(keywords=["低代码"], city="上海")
_SEEDED = {"skills": ["Python", "机器学习"], "benefits": ["带薪年休"], "city": "上海"}


def recommend_sql(profile: R.Profile, limit: int, path: bool = False) -> str:
    """A SELECT over jobs (and best, the path scores) as recommend scores it."""

    def array(values: list[str]) -> str:
        return "[" + ", ".join(map(_q, values)) + "]::VARCHAR[]"

    parts = {
        "skill_score": "len(matched_skills) * 4.0::DOUBLE", "coverage_score": f"len(matched_skills) / {float(len(profile.skills))}::DOUBLE * 2.0::DOUBLE" if profile.skills else "0.0::DOUBLE", "keyword_score": "len(matched_keywords) * 1.5::DOUBLE",
        "benefit_score": "len(matched_benefits) * 1.2::DOUBLE", "city_score": f"CASE WHEN city_name = {_q(profile.city)} THEN 3.0::DOUBLE ELSE 0 END" if profile.city else "0.0::DOUBLE",
        "industry_score": f"CASE WHEN industry_name = {_q(profile.industry)} THEN 2.5::DOUBLE ELSE 0 END" if profile.industry else "0.0::DOUBLE", "salary_score": "1.0::DOUBLE" if profile.least_salary is not None else "0.0::DOUBLE",
        "path_part": "path_score * 0.35::DOUBLE",
    }
    where = [f"salary_max >= {profile.least_salary}"] if profile.least_salary is not None else []
    where += [f"job_id <> {_FIRST}"] if path else []
    some = "" if not profile.skills else " AND (len(matched_skills) > 0 OR len(matched_keywords) > 0 OR len(matched_benefits) > 0 OR path_score > 0)"
    said = (
        "list_filter([CASE WHEN len(matched_skills) > 0 THEN '匹配技能 ' || array_to_string(matched_skills, ', ') END, CASE WHEN len(matched_keywords) > 0 THEN '关键词命中 ' || array_to_string(matched_keywords[1:4], ', ') END, "
        "CASE WHEN len(matched_benefits) > 0 THEN '福利匹配 ' || array_to_string(matched_benefits[1:4], ', ') END, CASE WHEN city_score > 0 THEN '城市匹配 ' || city_name END, CASE WHEN industry_score > 0 THEN '行业匹配 ' || industry_name END, "
        "CASE WHEN salary_score > 0 THEN '薪资满足 ' || salary_min || '-' || salary_max || 'k' END, CASE WHEN path_score > 0 THEN '3 跳内图谱关联度 ' || printf('%.1f', path_score) END], lambda r: r IS NOT NULL)"
    )
    return (
        f"m AS (SELECT jobs.*, {'coalesce(path_score, 0.0::DOUBLE)' if path else '0.0::DOUBLE'} AS path_score, list_sort(list_filter({array(profile.skills)}, lambda x: list_contains(skills, x))) AS matched_skills, "
        f"list_sort(list_filter({array(profile.skills)}, lambda x: NOT list_contains(skills, x))) AS missing_skills, list_sort(list_filter({array(profile.keywords)}, lambda x: list_contains(keywords, x) OR list_contains(skills, x))) AS matched_keywords, "
        f"list_sort(list_filter({array(profile.benefits)}, lambda x: list_contains(benefits, x))) AS matched_benefits FROM jobs {'LEFT JOIN best USING (job_id)' if path else ''} {'WHERE ' + ' AND '.join(where) if where else ''}), "
        f"p AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in parts.items())} FROM m), c AS (SELECT *, {' + '.join(parts)} AS pre FROM p WHERE {' + '.join(parts)} > 0{some} ORDER BY pre DESC, salary_mid DESC, len(skills) DESC, job_id LIMIT {min(max(limit * 8, 30), 200)}), "
        f"r AS (SELECT * EXCLUDE ({', '.join(parts)}), {', '.join(f'round({c}, 2) AS {c}' for c in parts)} FROM c), q AS (SELECT *, round({' + '.join(parts)}, 2) AS score FROM r) "
        f"SELECT job_id, title, score, {', '.join(parts)}, array_to_string(matched_skills, '¦') AS matched_skills, array_to_string(missing_skills, '¦') AS missing_skills, "
        f"array_to_string(CASE WHEN len({said}) > 0 THEN {said} ELSE ['综合得分 ' || printf('%.1f', score)] END, '；') AS reasons FROM q ORDER BY score DESC, salary_mid DESC, len(skills) DESC, job_id LIMIT {limit}"
    )


def _recommended(found: DataFrame) -> DataFrame:
    lists = {"matched_skills": "¦", "missing_skills": "¦", "reasons": "；"}
    parts = [c for c in found.columns if c.endswith("_score") and c != "path_score"]
    return found.select("job_id", "title", "score", *parts, "path_part", *[F.array_join(c, by).alias(c) for c, by in lists.items()])


@query("G11_recommend", f"WITH {_JOBS}, {recommend_sql(_PROFILE, 10)}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _recommended(R.recommend(_jobs(spark, folder), _PROFILE))


@query("G11_recommend_cold", f"WITH {_JOBS}, {recommend_sql(_COLD, 50)}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _recommended(R.recommend(_jobs(spark, folder), _COLD, 50))


@query("G11_recommend_by_seed", f"{_START}{_BEST}, best AS (SELECT job_id, max(score) AS path_score FROM paths GROUP BY job_id), {recommend_sql(R.Profile(**_SEEDED), 20, True)}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return _recommended(R.recommend(jobs, R.Profile(**_SEEDED, seed=_seed(jobs)), 20))


@query("G13_reasons", f"WITH {_JOBS}, whole AS (WITH {recommend_sql(_PROFILE, 25)}) SELECT job_id, reasons FROM whole")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _recommended(R.recommend(_jobs(spark, folder), _PROFILE, 25)).select("job_id", "reasons")


@query(
    "G12_recommend_linear",
    f"WITH {_JOBS}, m AS (SELECT *, list_filter(['Python', '机器学习', 'Kafka'], lambda x: list_contains(skills, x)) AS matched, list_filter(['低代码', 'Docker'], lambda x: list_contains(keywords, x) OR list_contains(skills, x)) AS words FROM jobs WHERE salary_max >= 15), "
    "s AS (SELECT *, len(matched) * 4.0::DOUBLE + len(words) * 1.5::DOUBLE + CASE WHEN city_name = '上海' THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN industry_name = '金融科技' THEN 2.5::DOUBLE ELSE 0 END + 1.0::DOUBLE AS score FROM m) "
    "SELECT job_id, score, array_to_string(list_sort(matched), '¦') AS matched_skills FROM s WHERE score > 0 AND (len(matched) > 0 OR score >= 4.0) ORDER BY score DESC, salary_mid DESC, len(skills) DESC, job_id LIMIT 10",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return A.recommend_linear(_jobs(spark, folder), _PROFILE).select("job_id", "score", F.array_join(F.array_sort("matched_skills"), "¦").alias("matched_skills"))


@query(
    "G15_similar_linear",
    f"WITH {_JOBS}, o AS (SELECT * FROM jobs WHERE job_id = {_FIRST}), m AS (SELECT j.*, list_sort(list_filter(j.skills, lambda x: list_contains(o.skills, x))) AS matched, list_sort(list_filter(o.skills, lambda x: NOT list_contains(j.skills, x))) AS missing, "
    "(CASE WHEN j.city_name = o.city_name THEN 2.0::DOUBLE ELSE 0 END) + (CASE WHEN j.industry_name = o.industry_name THEN 2.0::DOUBLE ELSE 0 END) + (CASE WHEN j.company_name = o.company_name THEN 1.0::DOUBLE ELSE 0 END) AS rest FROM jobs j, o WHERE j.job_id <> o.job_id) "
    "SELECT job_id, len(matched) * 3.0::DOUBLE + rest AS score, array_to_string(matched, '¦') AS matched_skills, array_to_string(missing, '¦') AS missing_skills FROM m WHERE len(matched) * 3.0::DOUBLE + rest > 0 ORDER BY score DESC, salary_mid DESC, job_id LIMIT 10",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return A.similar_linear(jobs, _seed(jobs)).select("job_id", "score", *[F.array_join(F.array_sort(c), "¦").alias(c) for c in ("matched_skills", "missing_skills")])


_RANK = "CASE relation WHEN 'REQUIRES_SKILL' THEN 1 WHEN 'LOCATED_IN' THEN 2 WHEN 'IN_INDUSTRY' THEN 3 WHEN 'POSTED_BY' THEN 4 WHEN 'HAS_BENEFIT' THEN 5 WHEN 'HAS_KEYWORD' THEN 6 ELSE 7 END"


@query(
    "G19_job_graph",
    f"WITH {_JOBS}, {_ENTITIES}, {similar_sql('SELECT min(job_id) FROM jobs')}, e AS (SELECT relation, label, name, {_node('label', 'name')} AS node, NULL::DOUBLE AS score FROM je WHERE job_id = {_FIRST} AND name <> '' ORDER BY {_RANK}, name, label LIMIT 80), "
    "s AS (SELECT 'SIMILAR_TO', 'Job', coalesce(title, job_id) AS name, 'job:' || job_id, round(raw, 4) AS score FROM sim JOIN jobs ON job_id = y ORDER BY score DESC, name, job_id LIMIT 16) SELECT * FROM e UNION ALL SELECT * FROM s",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return A.job_graph(jobs, _seed(jobs))


@query("G20_job_graph_linear", _WITH + f"SELECT relation, label, name, {_node('label', 'name')} AS node FROM je WHERE job_id = {_FIRST}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return A.job_graph_linear(jobs, _seed(jobs))


@query(
    "K8_similar_to",
    f"WITH {_JOBS}, {_ENTITIES}, {similar_sql(_EVERY)} SELECT x AS source, y AS target, round(raw, 4) AS score, coalesce(array_to_string(shared_skills, '¦'), '') AS shared_skills, coalesce(array_to_string(shared_benefits, '¦'), '') AS shared_benefits, city = 1 AS same_city, industry = 1 AS same_industry, company = 1 AS same_company FROM sim WHERE x < y",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return A.similar_to(_jobs(spark, folder), **{c: lambda x: F.array_join(x, "¦") for c in ("shared_skills", "shared_benefits")})


_TOTALS = ", ".join(f"(SELECT count(DISTINCT name) FROM je WHERE label = '{lb}') AS total_{lb.lower()}" for lb, _ in [*G.SCALARS.values(), *G.LISTS.values()])


@query("G21_stats_with_similarity", f"WITH {_JOBS}, {_ENTITIES}, {similar_sql(_EVERY)} SELECT count(*) AS total_jobs, round(avg(len(skills)), 2) AS avg_skills_per_job, round(avg(len(benefits)), 2) AS avg_benefits_per_job, {_TOTALS}, (SELECT count(*) FROM sim WHERE x < y) AS total_similarity_edges FROM jobs")
def _(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return G.stats(jobs, R.similar_pairs(jobs))


_LISTED = ", ".join(f"array_to_string({c}, '¦') AS {c}" for c in G.LISTS)
_TEXTS = ", ".join(f"coalesce({c}, '') AS {c}" for c in ("company_type", "company_size", "detail_link"))


def _joined(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.array_join(c, "¦") for c in G.LISTS})


_SUMMARY = f"SELECT job_id, title, {', '.join(G.DEFAULTS)}, coalesce(salary_min, 0) AS salary_min, coalesce(salary_max, 0) AS salary_max, coalesce(salary_mid, 0.0::DOUBLE) AS salary_mid, {_TEXTS}, coalesce(nullif(source, ''), '51job') AS source, {_LISTED} FROM jobs"


@query("G7_summary", f"WITH {_JOBS} {_SUMMARY}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(G.summary(_jobs(spark, folder)))


@query("G6_get_job", f"WITH {_JOBS} {_SUMMARY} WHERE job_id = {_FIRST}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    return _joined(G.summary(jobs.where(F.col("job_id") == _seed(jobs))))


@query("S7_postings_from_graph", f"WITH {_JOBS} SELECT job_id, title, salary_min, salary_max, salary_mid, {', '.join(G.DEFAULTS)}, {_LISTED} FROM jobs")
def _(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    own = jobs.select("job_id", "title", "salary_min", "salary_max", "salary_mid")
    return _joined(G.postings_from_graph(own, G.nodes(jobs), G.edges(jobs)))


@query("K7_companies", f"WITH {_JOBS} SELECT company_name AS name, arg_max({{t: company_type}}, job_no).t AS company_type, arg_max({{t: company_size}}, job_no).t AS company_size FROM jobs GROUP BY company_name")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return G.companies(_jobs(spark, folder))


def _shown(fields: list[str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"'{f}=' || CAST(nullif(CAST({f} AS VARCHAR), '') AS VARCHAR)" for f in fields) + "], lambda x: x IS NOT NULL), '¦')"


@query(
    "F34_node_properties",
    f"WITH {_JOBS}, {_ENTITIES}, firms AS (SELECT company_name AS name, arg_max({{t: company_type}}, job_no).t AS company_type, arg_max({{t: company_size}}, job_no).t AS company_size FROM jobs GROUP BY company_name) "
    f"SELECT 'job:' || job_id AS id, 'Job' AS label, coalesce(title, job_id) AS name, {_shown(G.SHOWN['Job'])} AS properties FROM jobs UNION ALL SELECT {_node(_q('Company'), 'name')}, 'Company', name, {_shown(G.SHOWN['Company'])} FROM firms "
    f"UNION ALL SELECT {_node('label', 'name')}, label, name, {_shown(['name'])} FROM (SELECT DISTINCT label, name FROM je WHERE label <> 'Company')",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = G.node_properties(_jobs(spark, folder))
    return found.withColumn("properties", F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "¦"))
