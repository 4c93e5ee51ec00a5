"""Queries over postings, each with the SQL that says the same where SQL can say it.

Arrays come out as joined texts, so that both engines compare alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave import dictionaries as D
from talentweave.functions import normalize as N
from talentweave.functions.salary_texts import liepin, qiancheng, zhaopin
from talentweave.functions.text import dedup_key, ned_key, node_id, normalize_text, safe_salary, salary_mid
from talentweave.operators import extract as X
from talentweave.operators import graph as G
from talentweave.operators import postings as P
from talentweave.operators import ranking as R
from talentweave.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# SQL pieces that the statements below share.
_BLANK = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NORM = "trim(regexp_replace(translate(coalesce({x}, ''), '" + D.PUNCTUATION + "', '" + D.PLAIN.replace("'", "''") + f"'), '{_BLANK}', ' ', 'g'))"


def _norm(x: str) -> str:
    return _NORM.replace("{x}", x)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fold(text: str) -> str:
    return text.translate(str.maketrans(D.PUNCTUATION, D.PLAIN)).lower()


def _alias_sql(key: str, entries: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {key} IN ({', '.join(_q(_fold(n)) for n in (c, *a))}) THEN {_q(c)}" for c, a in entries.items()) + " END"


def _within_sql(key: str, entries: dict[str, list[str]]) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({key}, {_q(_fold(n))})" for n in (c, *a)) + f" THEN {_q(c)}" for c, a in entries.items()) + " END"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Postings once each, without the columns that no query over them asks for."""
    return G.postings(table(spark, folder, "normalized_job").drop("description", "raw_tags", "crawled_at"))


_CLEAN = "list_sort(list_distinct(list_filter(coalesce({c}, []), lambda x: x IS NOT NULL AND x <> '')))"
_JOBS = (
    "jobs AS (SELECT job_no, job_id, title, "
    + ", ".join(f"coalesce(nullif({c}, ''), {_q(d)}) AS {c}" for c, d in G.DEFAULTS.items())
    + ", salary_min, salary_max, salary_mid, source, detail_link, company_type, company_size, "
    + ", ".join(_CLEAN.replace("{c}", c) + f" AS {c}" for c in G.LISTS)
    + " FROM normalized_job WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY job_no DESC) = 1)"
)
_ENTITIES = (
    "je AS ("
    + " UNION ALL ".join(f"SELECT job_id, '{r}' AS relation, '{lb}' AS label, {c} AS name FROM jobs" for c, (lb, r) in G.SCALARS.items())
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT job_id, '{r}' AS relation, '{lb}' AS label, unnest({c}) AS name FROM jobs" for c, (lb, r) in G.LISTS.items())
    + ")"
)
_WITH = f"WITH {_JOBS}, {_ENTITIES} "
_NODE = "lower({l}) || ':' || substr(md5({l} || ':' || {n}), 1, 12)"


def _node(label: str, name: str) -> str:
    return _NODE.replace("{l}", label).replace("{n}", name)


# --- scalar functions -------------------------------------------------------------------------


@query("F1_normalize_text", f"SELECT raw_no, {_norm('jobname')} AS title, lower({_norm('companyname')}) AS company_key FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job_raw").select("raw_no", normalize_text(F.col("jobname")).alias("title"), F.lower(normalize_text(F.col("companyname"))).alias("company_key"))


_SAFE = "coalesce(CAST(trunc(TRY_CAST({x} AS DOUBLE)) AS INTEGER), 0)"


@query(
    "F5_salary_numbers",
    f"WITH s AS (SELECT raw_no, {_SAFE.replace('{x}', 'salarymin')} AS low, {_SAFE.replace('{x}', 'salarymax')} AS high FROM job_raw) "
    "SELECT raw_no, low, high, CASE WHEN high <> 0 THEN round((low + high) / 2, 1) ELSE low::DOUBLE END AS mid FROM s",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    low, high = safe_salary(F.col("salarymin")), safe_salary(F.col("salarymax"))
    return table(spark, folder, "job_raw").select("raw_no", low.alias("low"), high.alias("high"), salary_mid(low, high).alias("mid"))


_GIVEN = f"regexp_replace(coalesce(_job_id, ''), '^{_BLANK}|{_BLANK}$', '', 'g')"


_JOB_ID = f"coalesce(nullif({_GIVEN}, ''), md5({_norm('jobname')} || '|' || {_norm('companyname')} || '|' || {_norm('jobareastring')}))"


@query("F7_stable_job_id", f"SELECT raw_no, {_JOB_ID} AS job_id FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return P.normalize_jobs(table(spark, folder, "job_raw")).select("raw_no", "job_id")


@query("F8_node_id", "SELECT DISTINCT city_name, " + _node("'City'", "city_name") + " AS node FROM normalized_job WHERE city_name IS NOT NULL")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "normalized_job").where("city_name IS NOT NULL").select("city_name", node_id(F.lit("City"), F.col("city_name")).alias("node")).distinct()


_N = _norm("degreestring")
_DEGREE = f"CASE WHEN {_N} IN ('', '无要求', '不限') THEN '不限' " + " ".join(f"WHEN contains({_N}, '{d}') THEN '{d}'" for d in ("博士", "硕士", "本科", "大专")) + f" ELSE {_N} END"
_W = _norm("workyearstring")
_YEARS = f"CASE WHEN {_W} IN ('', '无经验', '不限') THEN '不限' WHEN contains({_W}, '应届') OR contains({_W}, '在校') THEN '应届/在校' ELSE replace({_W}, '年以上', '+年') END"


@query("F9_degree", f"SELECT raw_no, {_DEGREE} AS degree_name FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job_raw").select("raw_no", N.degree(F.col("degreestring")).alias("degree_name"))


@query(
    "F10_experience",
    f"WITH e AS (SELECT raw_no, {_YEARS} AS experience_name FROM job_raw) SELECT raw_no, experience_name, CASE WHEN experience_name IN ('不限', '应届/在校') THEN 0 ELSE "
    r"coalesce(TRY_CAST(nullif(regexp_extract(experience_name, '(\d+)\s*[-~]\s*(\d+)', 1), '') AS INTEGER), TRY_CAST(nullif(regexp_extract(experience_name, '(\d+)\+?年', 1), '') AS INTEGER), 0) END AS least_years FROM e",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job_raw").select("raw_no", N.experience(F.col("workyearstring")).alias("experience_name"), N.least_years(F.col("workyearstring")).alias("least_years"))


_C, _CK = _norm("jobareastring"), "lower(" + _norm("jobareastring") + ")"


_CITY = f"coalesce({_alias_sql(_CK, D.CITIES)}, {_within_sql(_CK, D.CITIES)}, list_filter(list_transform(regexp_split_to_array({_C}, '[/,;|-]'), lambda x: trim(x)), lambda x: x <> '')[1], {_C})"


@query("F12_city", f"SELECT raw_no, {_CITY} AS city_name FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job_raw").select("raw_no", N.city(F.col("jobareastring")).alias("city_name"))


_F = r"regexp_replace(regexp_replace(" + _norm("companyname") + r", '\(\s*', '(', 'g'), '\s*\)', ')', 'g')"


_COMPANY = f"coalesce(nullif(trim(regexp_replace({_F}, '({'|'.join(D.LEGAL_ENDINGS)})$', '')), ''), {_F})"


@query("F13_company", f"SELECT raw_no, {_COMPANY} AS company_name FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job_raw").select("raw_no", N.company(F.col("companyname")).alias("company_name"))


_I = f"replace({_norm('industrytype1str')}, ',', '/')"


_INDUSTRY = f"coalesce({_alias_sql(f'lower({_I})', D.INDUSTRIES)}, {_I})"


@query("F14_industry", f"SELECT raw_no, {_INDUSTRY} AS industry_name FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job_raw").select("raw_no", N.industry(F.col("industrytype1str")).alias("industry_name"))


_TOKENS = f"list_filter(list_transform(regexp_split_to_array({_norm('jobtags')}, '[,，/|、;；]+'), lambda x: {_norm('x')}), lambda x: x <> '')"


@query("F17_split_tags", f"SELECT raw_no, array_to_string({_TOKENS}, '¦') AS tokens, len({_TOKENS})::INTEGER AS n FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    tokens = X.split_tags(F.col("jobtags"))
    return table(spark, folder, "job_raw").select("raw_no", F.array_join(tokens, "¦").alias("tokens"), F.size(tokens).alias("n"))


def _named_sql(content: str, name: str) -> str:
    import re

    key = _fold(name)
    if re.search("[a-z0-9+#]", key):
        return f"regexp_matches({content}, {_q('(^|[^a-z0-9+#])' + re.escape(key).replace(chr(92) + ' ', ' ') + '([^a-z0-9+#]|$)')})"
    return f"contains({content}, {_q(key)})"


_CONTENT = f"lower({_norm('jobname')} || ' ' || {_norm('jobdescribe')})"
_SCAN = "list_filter([" + ", ".join("CASE WHEN " + " OR ".join(_named_sql("content", a) for a in dict.fromkeys((n, *al))) + f" THEN {_q(n)} END" for n, al in D.SKILLS.items()) + "], lambda x: x IS NOT NULL)"


@query(
    "F22_extract_entities",
    f"WITH t AS (SELECT raw_no, {_TOKENS} AS tokens, {_CONTENT} AS content FROM job_raw), u AS (SELECT raw_no, tokens, {_SCAN} AS scanned, "
    f"list_filter(list_transform(tokens, lambda x: {_alias_sql('lower(x)', D.SKILLS)}), lambda x: x IS NOT NULL) AS tagged, list_filter(tokens, lambda x: ({_alias_sql('lower(x)', D.SKILLS)}) IS NULL) AS others FROM t) "
    "SELECT raw_no, array_to_string(list_sort(list_distinct(list_concat(tagged, scanned))), '¦') AS skills, "
    f"array_to_string(list_sort(list_distinct(list_filter(list_transform(others, lambda x: {_alias_sql('lower(x)', D.BENEFITS)}), lambda x: x IS NOT NULL))), '¦') AS benefits, "
    f"array_to_string(list_sort(list_distinct(list_filter(others, lambda x: ({_alias_sql('lower(x)', D.BENEFITS)}) IS NULL AND x NOT IN ({', '.join(map(_q, D.STOP_KEYWORDS))}) AND len(x) > 1 AND len(x) <= 20))), '¦') AS keywords FROM u",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = X.extraction(table(spark, folder, "job_raw"), "jobname", "jobtags", "jobdescribe")
    return found.select("raw_no", *[F.array_join(c, "¦").alias(c) for c in ("skills", "benefits", "keywords")])


@query("F23_ned_key", rf"SELECT ner_no, regexp_replace(replace(regexp_replace(lower(jobname), '^{_BLANK}|{_BLANK}$', '', 'g'), '/', ' '), '{_BLANK}', ' ', 'g') AS key FROM ner_record")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "ner_record").select("ner_no", ned_key(F.col("jobname")).alias("key"))


_S1 = "translate(lower(coalesce(salarymin, '')), ', 万', '')"
_A, _B = (rf"TRY_CAST(nullif(regexp_extract({_S1}, '(\d+)\s*[-–~]\s*(\d+)', {k}), '') AS INTEGER)" for k in (1, 2))


@query("F25_salary_range", f"WITH s AS (SELECT raw_no, {_A} AS a, {_B} AS b FROM job_raw), t AS (SELECT raw_no, CASE WHEN least(a, b) < 10 THEN a * 10 ELSE a END AS a, CASE WHEN least(a, b) < 10 THEN b * 10 ELSE b END AS b FROM s) SELECT raw_no, coalesce(least(a, b), 0) AS low, coalesce(greatest(a, b), 0) AS high FROM t")
def _(spark: SparkSession, folder: str) -> DataFrame:
    low, high = qiancheng(F.col("salarymin"))
    return table(spark, folder, "job_raw").select("raw_no", low.alias("low"), high.alias("high"))


_X, _Y = (rf"TRY_CAST(nullif(regexp_extract(coalesce(salarymin, ''), '(\d+)-(\d+)', {k}), '') AS INTEGER)" for k in (1, 2))


@query("F26_salary_yearly", f"SELECT raw_no, coalesce(CASE WHEN contains(salarymin, '万') THEN floor({_X} * 10 / 12)::INTEGER ELSE {_X} END, 0) AS low, coalesce(CASE WHEN contains(salarymin, '万') THEN floor({_Y} * 10 / 12)::INTEGER ELSE {_Y} END, 0) AS high FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    low, high = liepin(F.col("salarymin"))
    return table(spark, folder, "job_raw").select("raw_no", low.alias("low"), high.alias("high"))


@query("F27_salary_monthly", f"SELECT raw_no, coalesce(CASE WHEN contains(salarymin, '万') THEN {_X} * 10 ELSE {_X} END, 0) AS low, coalesce(CASE WHEN contains(salarymin, '万') THEN {_Y} * 10 ELSE {_Y} END, 0) AS high FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    low, high = zhaopin(F.col("salarymin"))
    return table(spark, folder, "job_raw").select("raw_no", low.alias("low"), high.alias("high"))


_KEY = "md5(" + " || '|' || ".join(f"lower(regexp_replace(coalesce({c}, ''), '{_BLANK}', '', 'g'))" for c in ("jobname", "companyname")) + ")"


@query("F31_dedup_key", f"SELECT raw_no, {_KEY} AS key FROM job_raw")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "job_raw").select("raw_no", dedup_key(F.col("jobname"), F.col("companyname")).alias("key"))


def _or(x: str, default: str) -> str:
    return f"coalesce(nullif({x}, ''), {_q(default)})"


_MID = "CASE WHEN salary_max <> 0 THEN round((salary_min + salary_max) / 2, 1) ELSE salary_min::DOUBLE END"
_NORMALIZED = (
    "WITH n AS (SELECT raw_no, " + ", ".join(f"{x} AS {c}" for c, x in {
        "title": _norm("jobname"), "company_name": _or(_COMPANY, "未知公司"), "city_name": _or(_CITY, "未知"), "industry_name": _or(_INDUSTRY, "未知行业"), "degree_name": _DEGREE, "experience_name": _YEARS,
        "salary_min": _SAFE.replace("{x}", "salarymin"), "salary_max": _SAFE.replace("{x}", "salarymax"), "source": _or(_norm("source"), "51job"), "description": _norm("jobdescribe"),
        "detail_link": _norm("_detail_link"), "company_type": _norm("companytypestring"), "company_size": _norm("companysizestring"), "job_id": _JOB_ID,
    }.items()) + f" FROM job_raw), e AS ({ORACLE['F22_extract_entities']}), g AS (SELECT raw_no, array_to_string(list_sort(list_distinct({_TOKENS})), '¦') AS raw_tags FROM job_raw) "
    f"SELECT n.*, {_MID} AS salary_mid, e.skills, e.benefits, e.keywords, g.raw_tags FROM n JOIN e USING (raw_no) JOIN g USING (raw_no)"
)


@query("G1_normalize_jobs", _NORMALIZED)
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = P.normalize_jobs(table(spark, folder, "job_raw"))
    lists = ("skills", "benefits", "keywords", "raw_tags")
    return found.withColumns({c: F.array_join(c, "¦") for c in lists})


# --- repeated rows ----------------------------------------------------------------------------


@query("X1_first_wins", rf"SELECT raw_no, jobname, companyname FROM job_raw WHERE regexp_matches(jobname, '\S') AND regexp_matches(companyname, '\S') QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY raw_no) = 1")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return P.first_wins(table(spark, folder, "job_raw"), "raw_no").select("raw_no", "jobname", "companyname")


@query("X2_last_wins", "SELECT job_id, job_no, title FROM normalized_job WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY job_no DESC) = 1")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return P.last_wins(table(spark, folder, "normalized_job"), "job_id", "job_no").select("job_id", "job_no", "title")


# --- the graph --------------------------------------------------------------------------------


@query("G2_nodes", _WITH + "SELECT 'job:' || job_id AS id, 'Job' AS label, coalesce(title, job_id) AS name FROM jobs UNION ALL SELECT DISTINCT " + _node("label", "name") + ", label, name FROM je")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return G.nodes(_jobs(spark, folder))


@query(
    "G2_edges",
    _WITH + "SELECT DISTINCT 'job:' || job_id AS source, " + _node("label", "name") + " AS target, relation FROM je UNION ALL SELECT DISTINCT " + _node("'Company'", "company_name") + ", " + _node("'Industry'", "industry_name") + ", 'BELONGS_TO' FROM jobs",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return G.edges(_jobs(spark, folder))


@query("A17_index_sizes", _WITH + "SELECT label, name, count(*) AS jobs FROM je GROUP BY ALL")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return G.index_sizes(_jobs(spark, folder))


@query("A5_top_skills", _WITH + "SELECT name, count(*) AS count FROM je WHERE label = 'Skill' GROUP BY name ORDER BY count DESC, name LIMIT 20")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return G.top_entities(_jobs(spark, folder), "Skill", 20)


@query(
    "G22_insights",
    _WITH + "SELECT CASE label WHEN 'Skill' THEN 'skills' WHEN 'City' THEN 'cities' WHEN 'Industry' THEN 'industries' ELSE 'benefits' END AS kind, name, count(*) AS count FROM je "
    "WHERE label IN ('Skill', 'City', 'Industry', 'Benefit') GROUP BY label, name QUALIFY row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, name) <= 10",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return G.insights(_jobs(spark, folder), 10)


_TOTALS = ", ".join(f"(SELECT count(DISTINCT name) FROM je WHERE label = '{lb}') AS total_{lb.lower()}" for lb, _ in [*G.SCALARS.values(), *G.LISTS.values()])


@query("G21_stats", _WITH + f"SELECT count(*) AS total_jobs, round(avg(len(skills)), 2) AS avg_skills_per_job, round(avg(len(benefits)), 2) AS avg_benefits_per_job, {_TOTALS} FROM jobs")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return G.stats(_jobs(spark, folder))


@query("K10_broken_node_keys", _WITH + "SELECT id, count(*) AS times FROM (SELECT DISTINCT " + _node("label", "name") + " AS id, label, name FROM je) GROUP BY id HAVING count(*) > 1")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return G.broken_keys(G.nodes(_jobs(spark, folder)), "id")


# --- search, similarity, recommendation -------------------------------------------------------


@query("G5_search", _WITH + "SELECT job_id, title, company_name, salary_mid FROM jobs WHERE list_contains(skills, 'Python') AND salary_max >= 20 AND (contains(lower(title), '工程师') OR contains(lower(company_name), '工程师') OR len(list_filter(skills, lambda x: contains(lower(x), '工程师'))) > 0 OR len(list_filter(keywords, lambda x: contains(lower(x), '工程师'))) > 0) ORDER BY salary_mid DESC, len(skills) DESC, title, job_id LIMIT 20")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return R.search(_jobs(spark, folder), keyword="工程师", skills=["Python"], least_salary=20).select("job_id", "title", "company_name", "salary_mid")


def _seed(jobs: DataFrame) -> str:
    return jobs.agg(F.min("job_id")).first()[0] or ""


_SIMILAR = (
    "pairs AS (SELECT a.job_id AS x, b.job_id AS y, " + ", ".join(f"count(*) FILTER (a.label = '{lb}') AS {c}" for lb, c in (("Skill", "skills"), ("Benefit", "benefits"), ("City", "city"), ("Industry", "industry"), ("Company", "company")))
    + ", list_sort(list(a.name) FILTER (a.label = 'Skill')) AS shared_skills, list_sort(list(a.name) FILTER (a.label = 'Benefit')) AS shared_benefits "
    "FROM je a JOIN je b ON a.label = b.label AND a.name = b.name AND a.job_id <> b.job_id WHERE a.label IN ('Skill', 'Benefit', 'City', 'Industry', 'Company') AND a.job_id IN ({seeds}) GROUP BY a.job_id, b.job_id), "
    "sim AS MATERIALIZED (SELECT *, skills * 3.0::DOUBLE + benefits * 0.6::DOUBLE + city * 1.5::DOUBLE + industry * 1.5::DOUBLE + company * 1.0::DOUBLE AS raw, ln(1.0::DOUBLE + skills + benefits + city + industry + company) AS sup "
    "FROM pairs WHERE skills * 3.0::DOUBLE + benefits * 0.6::DOUBLE + city * 1.5::DOUBLE + industry * 1.5::DOUBLE + company * 1.0::DOUBLE >= 3.0)"
)


def similar_sql(seeds: str) -> str:
    return _SIMILAR.replace("{seeds}", seeds)


_SHARED = (
    "array_to_string(list_filter([CASE WHEN len(sim.shared_skills) > 0 THEN '共享技能 ' || array_to_string(sim.shared_skills, ', ') END, CASE WHEN len(sim.shared_benefits) > 0 THEN '共享福利 ' || array_to_string(sim.shared_benefits[1:3], ', ') END, "
    "CASE WHEN city = 1 THEN '同城候选 ' || city_name END, CASE WHEN industry = 1 THEN '行业关联 ' || industry_name END, CASE WHEN company = 1 THEN '同公司 ' || company_name END], lambda r: r IS NOT NULL), '；')"
)


@query(
    "G14_similar_jobs",
    f"WITH {_JOBS}, {_ENTITIES}, {similar_sql('SELECT job_id FROM jobs WHERE job_no % 100 = 0')} SELECT x AS seed_id, (row_number() OVER (PARTITION BY x ORDER BY round(raw, 4) DESC, salary_mid DESC, y))::INTEGER AS rank, y AS job_id, round(raw, 4) AS score, sim.skills, sim.benefits, {_SHARED} AS reasons "
    "FROM sim JOIN jobs ON job_id = y QUALIFY rank <= 10",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _jobs(spark, folder)
    found = R.similar_jobs(jobs.where(F.col("job_no") % 100 == 0), jobs)
    return found.select("seed_id", "rank", "job_id", "score", "skills", "benefits", F.array_join("reasons", "；").alias("reasons"))
