from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talentweave.operators import around as A
from talentweave.operators import entities as E
from talentweave.operators import graph as G
from talentweave.operators import overlap as O
from talentweave.operators import ranking as R
from talentweave.operators import relations as L
from talentweave.operators.extract import extraction, rule_entities
from talentweave.operators.postings import first_wins, last_wins, normalize_jobs
from talentweave.sources.readers import POSTING, cards, crawl_requests, union_sources
from talentweave.session import numbered
from talentweave.sources import sinks
from talentweave.sources import sites as S
from talentweave.streaming.dedupe import first_seen

JOB = "job_no long, job_id string, title string, company_name string, city_name string, industry_name string, degree_name string, experience_name string, salary_min int, salary_max int, salary_mid double, skills array<string>, benefits array<string>, keywords array<string>"


def _jobs(spark, n=40, seed=3):
    r = random.Random(seed)
    rows = [
        (k, f"j{k % (n - 4)}", f"t{r.randint(1, 9)}", r.choice(["甲", "乙", None]), r.choice(["上海", "北京", ""]), r.choice(["x", "y"]), "本科", "不限", 10, r.randint(10, 40), float(r.randint(10, 30)),
         r.choice([None, [], r.sample("abcdef", 2), ["a", "a", None, ""]]), r.sample("pqrs", r.randint(0, 3)), ["k"])
        for k in range(n)
    ]
    return spark.createDataFrame(rows, JOB)


def test_extraction(spark):
    rows = [
        ("大模型算法工程师", "python,pytorch,带薪年假,弹性工作,数据分析", "负责 LLM 应用与机器学习模型训练"), ("前端开发工程师", "javascript,css,html", "负责 JavaScript 前端交互开发"),
        ("算法工程师", "年终奖,双休,有餐补", "负责机器学习系统开发"), (None, None, None), ("", "", ""),
    ]
    found = extraction(spark.createDataFrame(rows, "t string, g string, d string"), "t", "g", "d").collect()
    assert {"Python", "PyTorch", "大模型", "机器学习", "数据分析"} <= set(found[0]["skills"]) and {"带薪年假", "弹性工作"} <= set(found[0]["benefits"])
    assert "JavaScript" in found[1]["skills"] and "Java" not in found[1]["skills"]
    assert {"年终奖金", "周末双休", "餐饮补贴"} <= set(found[2]["benefits"])
    assert found[3]["skills"] == found[4]["keywords"] == []


def test_normalized_and_empty(spark):
    raw = spark.createDataFrame([(1, "job-1", "机器学习工程师", "甲公司有限公司", "上海-浦东新区", "电子技术/半导体/集成电路", "本科", "3-5年", "20", "35", "python,年终奖", "PyTorch", "民营", None, None, "")], "raw_no long, " + POSTING.simpleString()[7:-1].replace(":", " "))
    row = normalize_jobs(raw).first()
    assert (row["company_name"], row["city_name"], row["industry_name"], row["source"], row["salary_mid"]) == ("甲公司", "上海", "电子/半导体/集成电路", "51job", 27.5)
    assert "年终奖金" in row["benefits"] and row["skills"] == ["PyTorch", "Python", "机器学习"]
    assert normalize_jobs(raw.limit(0)).count() == 0


def test_first_and_last_wins(spark):
    df = spark.createDataFrame([(1, "A b", "x"), (2, "ab", " X"), (3, None, "x"), (4, "", "x"), (5, "c", "x")], "raw_no long, jobname string, companyname string")
    assert sorted(r["raw_no"] for r in first_wins(df, "raw_no").collect()) == [1, 5]
    assert sorted(r["raw_no"] for r in last_wins(df, "companyname", "raw_no").collect()) == [2, 5]


def test_graph_keys_and_counts(spark):
    jobs = G.postings(_jobs(spark))
    assert G.broken_keys(G.nodes(jobs), "id").count() == G.broken_keys(G.edges(jobs), "source", "target", "relation").count() == 0
    assert G.stats(jobs).first()["total_jobs"] == 36
    assert G.nodes(jobs.limit(0)).count() == 0 and G.stats(jobs.limit(0)).first()["total_skill"] == 0


def test_similarity_equals_comparing_all_pairs(spark):
    jobs = G.postings(_jobs(spark))
    rows = [r.asDict() for r in jobs.collect()]
    wanted = {}
    for a in rows:
        for b in rows:
            if a["job_id"] != b["job_id"]:
                s = len(set(a["skills"]) & set(b["skills"])) * 3.0 + len(set(a["benefits"]) & set(b["benefits"])) * 0.6
                s += 1.5 * (a["city_name"] == b["city_name"]) + 1.5 * (a["industry_name"] == b["industry_name"]) + 1.0 * (a["company_name"] == b["company_name"])
                if s >= 3.0:
                    wanted[a["job_id"], b["job_id"]] = round(s, 4)
    assert {(r["seed_id"], r["job_id"]): r["score"] for r in R.similarity(jobs, jobs).collect()} == wanted
    top = R.similar_jobs(jobs, jobs, 3).collect()
    assert max(r["rank"] for r in top) == 3


def test_similar_postings_in_blocks(spark, monkeypatch):
    jobs = G.postings(_jobs(spark, 60, 5)).localCheckpoint()
    monkeypatch.setattr(R, "COLUMNS", 7)
    monkeypatch.setattr(O, "HELD", 20)
    pay = {r["job_id"]: r["salary_mid"] for r in jobs.collect()}
    wanted = {}
    for r in R.similarity(jobs, jobs).collect():
        wanted.setdefault(r["seed_id"], []).append((-r["score"], -pay[r["job_id"]], r["job_id"]))
    found = R.similar_jobs(jobs, jobs, 3).collect()
    assert {(r["seed_id"], r["rank"]): (r["job_id"], r["score"]) for r in found} == {(s, k + 1): (j, -x) for s, all_ in wanted.items() for k, (x, _, j) in enumerate(sorted(all_)[:3])}


def test_similar_pairs_are_counted_in_blocks(spark, monkeypatch):
    jobs = G.postings(_jobs(spark, 60, 5))
    jobs = jobs.unionByName(jobs.where("job_no > 30").withColumn("job_id", F.concat(F.lit("again-"), "job_id"))).localCheckpoint()
    monkeypatch.setattr(R, "COUNTED", 9)
    assert R.similar_pairs(jobs).first()[0] * 2 == R.similarity(jobs, jobs).count() > 0
    assert G.stats(jobs, R.similar_pairs(jobs)).first()["total_similarity_edges"] > 0 == R.similar_pairs(jobs.limit(0)).first()[0]


def test_similar_pairs_meet_in_blocks_without_a_shuffle(spark, monkeypatch):
    jobs = G.postings(_jobs(spark, 60, 5))
    # more than 16 values, which no code of 16 bits holds
    jobs = jobs.withColumn("skills", F.when(F.col("job_no") % 7 == 0, F.array(*map(F.lit, "abcdefghijklmnopqrstu"))).otherwise(F.col("skills"))).localCheckpoint()
    monkeypatch.setattr(R, "LEAST_BLOCK", 9)
    monkeypatch.setattr(O, "SENT", 5)
    for columns in (7, 1000):
        monkeypatch.setattr(R, "COLUMNS", columns)
        wanted = R.similarity(jobs, jobs).where("seed_id < job_id").collect()
        wanted = sorted((r["seed_id"], r["job_id"], r["score"], r["shared_skills"], r["shared_benefits"], r["city"] == 1, r["industry"] == 1, r["company"] == 1) for r in wanted)
        found = A.similar_to(jobs)
        assert sorted(map(tuple, found.collect())) == wanted and any(len(r[3]) > 16 for r in wanted)
        assert "CartesianProduct" in _plan(found) and "Exchange" not in _plan(found)
    assert A.similar_to(jobs.limit(0)).count() == A.similar_to(jobs.limit(1)).count() == 0


def test_recommend_and_paths(spark):
    jobs = G.postings(_jobs(spark))
    found = R.recommend(jobs, R.Profile(skills=["a"], city="上海", least_salary=12)).collect()
    assert found and all("a" in r["matched_skills"] for r in found) and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)
    paths = R.explanation(R.paths(jobs, "j5", 3, 10)).collect()
    assert len(paths) == 10 and all(r["job_id"] != "j5" and len(r["nodes"]) == r["hops"] + 1 and r["explanation"] for r in paths)
    assert R.paths(jobs, "nobody").count() == 0 == R.paths_to(jobs, "nobody", jobs.limit(2)).count()
    near = R.recommend(jobs, R.Profile(skills=["a"], seed="j5")).collect()
    assert near and all(r["job_id"] != "j5" for r in near) and any(r["path_score"] > 0 and "跳内图谱关联度" in r["reasons"][-1] for r in near)
    assert R.recommend(jobs.limit(0), R.Profile(skills=["a"])).count() == A.similar_linear(jobs.limit(0), "j5").count() == A.job_graph(jobs, "nobody").count() == 0


def _all_paths(rows: list[dict], seed: str, entities: int, mids: int) -> list[tuple]:
    """Every path from a posting by its definition, (score, hops, job, nodes), without cuts of the branches."""
    by = {r["job_id"]: r for r in rows}

    def names(r: dict) -> set:
        return {(f, r[f]) for f in ("company_name", "city_name", "industry_name", "degree_name", "experience_name")} | {(f, x) for f in ("skills", "benefits", "keywords") for x in r[f]}

    def support(a: dict, b: dict) -> float | None:
        n = [len(set(a["skills"]) & set(b["skills"])), len(set(a["benefits"]) & set(b["benefits"])), *(a[f] == b[f] for f in ("city_name", "industry_name", "company_name"))]
        return math.log(1 + sum(n)) if n[0] * 3.0 + n[1] * 0.6 + n[2] * 1.5 + n[3] * 1.5 + n[4] >= 3.0 else None

    label = {f: lb for f, (lb, _) in {**G.SCALARS, **G.LISTS}.items()}
    df = Counter(x for r in rows for x in names(r))
    own, title = by[seed], {j: r["title"] for j, r in by.items()}
    near = {j: s for j, r in by.items() if j != seed and (s := support(own, r)) is not None}
    out = [(round(s, 4), 1, j, [title[seed], title[j]]) for j, s in near.items()]
    rare = sorted(names(own), key=lambda x: (df[x], x[1], label[x[0]]))[:entities]
    via = [(math.log((len(rows) + 1) / (df[x] + 1)), j, x) for x in rare for j, r in by.items() if j != seed and x in names(r)]
    out += [(round(s / 2**0.5, 4), 2, j, [title[seed], x[1], title[j]]) for s, j, x in via]
    for first, mid, way, hops in [(s, j, [title[j]], 2) for j, s in near.items()] + [(s, j, [x[1], title[j]], 3) for s, j, x in sorted(via, key=lambda v: (-v[0], v[1], v[2][1], label[v[2][0]]))[:mids]]:
        out += [(round((first + s) / hops**0.5, 4), hops, j, [title[seed], *way, title[j]]) for j, r in by.items() if j not in (seed, mid) and (s := support(by[mid], r)) is not None]
    return sorted(out, key=lambda p: (-p[0], p[1], p[3][-1], p[2], p[3]))


def test_paths_equal_their_definition(spark):
    jobs = G.postings(_jobs(spark, 60, 8))
    rows = [r.asDict() for r in jobs.collect()]
    for seed, limit in (("j5", 10), ("j7", 40)):
        wanted = _all_paths(rows, seed, min(max(4 * limit, 40), 120), min(max(6 * limit, 40), 160))[:limit]
        found = [(r["score"], r["hops"], r["job_id"], r["nodes"]) for r in R.paths(jobs, seed, 3, limit).collect()]
        assert [(s, h, n) for s, h, _, n in found] == [(pytest.approx(s, abs=1e-4), h, n) for s, h, _, n in wanted]


@pytest.mark.parametrize("hops", [2, 3])
def test_paths_over_blocks_of_postings_in_between(spark, monkeypatch, hops):
    jobs = G.postings(_jobs(spark, 60, 8))
    rows = [r.asDict() for r in jobs.collect()]
    monkeypatch.setattr(R, "FIRST_MIDS", 160 if hops == 3 else 2)
    monkeypatch.setattr(R, "COLUMNS", 3)
    wanted = [p for p in _all_paths(rows, "j7", 120, 160) if p[1] <= hops][:40]
    found = [(r["score"], r["hops"], r["nodes"]) for r in R.paths(jobs, "j7", hops, 40).collect()]
    assert found == [(pytest.approx(s, abs=1e-4), h, n) for s, h, _, n in wanted]


@pytest.mark.parametrize(("hops", "columns"), [(1, 3), (2, 3), (3, 3), (3, 50), (3, 8192)])
def test_best_of_all_paths_without_a_cap(spark, monkeypatch, hops, columns):
    jobs = G.postings(_jobs(spark, 90, 8))
    rows = [r.asDict() for r in jobs.collect()]
    monkeypatch.setattr(R, "COLUMNS", columns)
    wanted: dict[str, float] = {}
    for score, n, job, _ in _all_paths(rows, "j7", 10**9, 10**9):
        if n <= hops:
            wanted[job] = max(score, wanted.get(job, 0.0))
    found = {r["job_id"]: r["path_score"] for r in R.best_paths(jobs, "j7", hops).collect()}
    assert found == {j: pytest.approx(s, abs=1e-4) for j, s in wanted.items()}
    assert R.best_paths(jobs, "nobody").count() == R.best_paths(jobs.where("job_id = 'j7'"), "j7").count() == 0


def test_postings_with_no_common_entity_have_no_path(spark):
    row = {"job_no": 1, "title": "t", "company_name": "甲", "city_name": "上海", "industry_name": "x", "degree_name": "本科", "experience_name": "不限", "salary_min": 1, "salary_max": 2, "salary_mid": 1.5, "skills": ["a"], "benefits": [], "keywords": []}
    other = {"company_name": "乙", "city_name": "北京", "industry_name": "y", "degree_name": "大专", "experience_name": "3+年", "skills": ["b"]}
    jobs = G.postings(spark.createDataFrame([row | {"job_id": "a"}, row | {"job_id": "b", "skills": ["a", "b"]}, row | other | {"job_id": "c"}, row | other | {"job_id": "d", "skills": ["c"], "industry_name": "z"}], JOB))
    found = {r["job_id"]: r["path_score"] for r in R.best_paths(jobs, "a").collect()}
    assert set(found) == {"b", "c"} and found["b"] == pytest.approx(math.log(5), abs=1e-4) and found["c"] == pytest.approx((math.log(5) + math.log(2)) / 2**0.5, abs=1e-4)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_onward_paths_need_no_shuffle(spark):
    jobs = G.postings(_jobs(spark)).localCheckpoint()
    row = next(r for r in jobs.collect() if r["job_id"] == "j5")
    mids = [{"id": "j5", "content": O.content(row), "bound": 9.0, "first": 1.0, "relations": ["r"], "names": ["n"]}]
    found = O.best_onward(jobs, mids, R.UNITS, R.LEAST_UNITS, 1.0, 1000, 0.0)
    assert "Exchange" not in _plan(found)
    assert {r["job_id"] for r in found.collect()} == {r["job_id"] for r in R.similarity(jobs.where("job_id = 'j5'"), jobs).collect()}


def test_recommendation_joins_paths_without_a_shuffle(spark):
    jobs = G.postings(_jobs(spark)).localCheckpoint()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in _plan(R.recommend(jobs, R.Profile(skills=["a"], seed="j5")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_graph_tables_come_back(spark, tmp_path):
    jobs = G.postings(_jobs(spark).withColumns({c: F.lit("q") for c in ("source", "detail_link", "company_type", "company_size")}))
    folder = str(tmp_path / "graph")
    sinks.write_graph(jobs, folder)
    back = {r["job_id"]: r for r in sinks.read_graph(spark, folder).collect()}
    for r in jobs.collect():
        assert all(back[r["job_id"]][c] == r[c] for c in ("company_name", "city_name", "skills", "benefits", "keywords", "salary_max", "title"))
    sinks.ensure_similar(jobs, folder)
    assert spark.read.parquet(f"{folder}/similar_to").count() * 2 == R.similarity(jobs, jobs).count()
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k long, v string")
    assert [sinks.append_new(df, f"{folder}/log", "k"), sinks.append_new(df, f"{folder}/log", "k"), sinks.append_new(df.withColumn("k", F.col("k") + 1), f"{folder}/log", "k")] == [2, 0, 1]


def test_numbers_within_keys(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 7 % 1000).alias("x"))
    got = numbered(df, "k", [F.desc("x")]).where("k = 'hot'").orderBy("number").collect()
    assert [r["number"] for r in got] == list(range(700)) and [r["x"] for r in got] == sorted((r["x"] for r in got), reverse=True)


def test_recognizer_merge_and_triples(spark):
    rows = [(1, "a", "c", "熟悉 Python；负责系统设计。博士优先", [("SKILL", "Go")]), (2, "b", "c", "掌握 Python、SQL 等", []), (3, "b", "c", " ", None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "n long, jobname string, companyname string, jobdescription string, namedentity array<struct<entity:string,word:string>>")
    ruled = df.withColumn("namedentity", rule_entities(F.col("jobdescription")))
    merged = {r["n"]: [e["word"] for e in r["namedentity"]] for r in E.merge_recognized(df, ruled, "n").collect()}
    assert merged[1] == ["Go"] and 3 not in merged and 4 not in merged
    text = "支持包括Python、SQL在内的语言，多传感器融合用于视觉检测"
    one = spark.createDataFrame([(1, text, [("S", w) for w in ("Python", "SQL", "多传感器融合", "视觉检测")])], "n long, jobdescription string, namedentity array<struct<entity:string,word:string>>")
    triples = {(r["subject"], r["relation"], r["object"]) for r in L.relation_triples(one, "n").collect()}
    assert ("Python", "Co_Occurrence", "SQL") in triples and ("多传感器融合", "Apply_To", "视觉检测") in triples
    stub = E.with_provider(df, "jobdescription", lambda texts: [[("X", t[:1])] for t in texts]).collect()
    assert stub[3]["namedentity"] is None and stub[0]["namedentity"][0]["word"] == "熟"


def test_disambiguation(spark):
    words = [("SKILL", w) for w in ["LoRA", "QLoRA", "pytorch", "结构化数据", "非结构化数据"]] + [("DEGREE", "PhD"), ("DEGREE", "研究生")]
    df = spark.createDataFrame([(1, [{"entity": e, "word": w} for e, w in words]), (2, [])], "n long, namedentity array<struct<entity:string,word:string>>")
    own = E.entity_words(df, "n")
    mapping = E.disambiguate(E.word_counts(own))
    table = {r["word"]: r["canonical"] for r in mapping.collect()}
    assert table["QLoRA"] == table["LoRA"] and table["pytorch"] == "PyTorch" and table["PhD"] == "博士" and table["研究生"] == "硕士"
    assert table["结构化数据"] == table["非结构化数据"]
    assert E.apply_mapping(own, mapping, "n").count() == 5
    assert {r["etype"]: r["merged_groups"] for r in E.mapping_summary(mapping).collect()} == {"SKILL": 2, "DEGREE": 0, "(all)": 2}


def test_clustering_equals_one_by_one(spark):
    r = random.Random(4)
    words = sorted({"".join(r.choice("数据分析模型") for _ in range(r.randint(1, 9))) for _ in range(260)} | {"w" * 3000, "w" * 2999 + "x", " "})
    rows = [("S", w, r.randint(1, 4)) for w in words] + [("T", w, 1) for w in words[:40]]
    counted = spark.createDataFrame(rows, "etype string, word string, freq long").withColumn("key", F.col("word"))
    found = {(x["etype"], x["word"]): x["canonical"] for x in E.disambiguate(counted, 0.6).collect()}
    for etype in ("S", "T"):
        own = sorted(((f, w) for e, w, f in rows if e == etype), key=lambda x: (-x[0], x[1]))
        listed = [w for _, w in own]
        ruled = {x["word"] for x in E.rule_match(counted.where(F.col("etype") == etype)).where("canonical is not null").collect()}
        listed = [w for w in listed if w not in ruled]
        assert [found[etype, w] for w in listed] == E.cluster_words(listed, listed, 0.6)
    assert E.disambiguate(counted.limit(0)).count() == 0


def test_asked_models_that_fail(spark):
    words = spark.createDataFrame([("S", w, f) for w, f in (("a", 9), ("b", 8), ("c", 7), ("d", 6), ("e", 5))] + [("T", "x", 1)], "etype string, word string, freq long")

    def model(etype: str, batch: list[str]) -> str:
        if etype == "T":
            raise RuntimeError("away")
        return json.dumps({"groups": [{"canonical": "A", "variants": [batch[0], "zz"]}, {"canonical": "", "variants": ["e"]}] if batch[0] != "c" else [{"canonical": "C", "variants": ["c", "zz", "a"]}]})

    found = {r["word"]: r["canonical"] for r in E.asked_mapping(words, model, 2).collect()}
    assert found == {"a": "C", "b": "b", "c": "C", "d": "d", "e": "A", "zz": "A", "x": "x"}
    df = spark.createDataFrame([(1, "t", [("S", "p"), ("S", "q")]), (2, "", [("S", "p")]), (3, "t", None), (4, "u", [("S", "p")])], "n long, jobdescription string, namedentity array<struct<entity:string,word:string>>")
    said = {r["n"]: r["relations"] for r in L.asked_relations(df, lambda asked: ['```json\n[{"subject":"p","relation":"Include","object":"q"}]\n```' if t == "t" else "no" for t, _ in asked]).collect()}
    assert [tuple(x) for x in said[1]] == [("p", "Include", "q")] and said[2] == said[3] == said[4] == []


def test_layers_of_relations(spark):
    text = "甲系统" + "很" * 22 + "，乙组件；选用丙语言写丁模块；戊：己。庚辛无关壬癸的话"
    words = ["甲系统", "乙组件", "丙语言", "丁模块", "庚辛", "壬癸"]
    one = spark.createDataFrame([(1, text, [("S", w) for w in words]), (2, None, None)], "n long, jobdescription string, namedentity array<struct<entity:string,word:string>>")

    def parser(texts: list[str]) -> list[list[L.Token]]:
        out = []
        for t in texts:
            tokens = [L.Token(t.index(w), t.index(w) + len(w), 0, "nsubj" if k == 0 else "dobj") for k, w in enumerate([w for w in words if w in t])] if "选用" in t else []
            out.append(tokens)
        return out

    rules = L.relation_triples(one, "n").count()
    found = {r["stage"]: (r["subject"], r["relation"], r["object"]) for r in L.relation_triples(one, "n", parser=parser, classifier=lambda asked: [(4, 0.9 if "庚" in s else 0.3) for s, _, _ in asked]).collect()}
    assert rules == 0 and found == {"Syntax": ("丁模块", "Apply_To", "丙语言"), "Semantic": ("壬癸", "Include", "庚辛")}
    chain = [L.Token(k, k + 1, max(0, k - 1), "conj" if k == 2 else "x") for k in range(7)]
    assert L.tree_path(chain, 1, 4) == [1, 2, 3, 4] and L.syntax_kind(chain, (1, 2), (3, 4)) == ("Co_Occurrence", False) and L.syntax_kind(chain, (0, 1), (6, 7)) is None
    assert L.syntax_kind([L.Token(0, 1, 0, "a"), L.Token(1, 2, 1, "b")], (0, 1), (1, 2)) is None


def test_sites(spark):
    raw = spark.createDataFrame([(1, " 算法 ", "甲", "上海·浦东", "1.5-2万", ["a", None, "", "b"]), (2, None, None, None, None, None)], "n long, jobname string, companyname string, jobareastring string, salary string, jobtags array<string>")
    first = {r["n"]: r for r in S.from_51job(raw, keep=("n",)).collect()}
    assert (first[1]["jobname"], first[1]["jobareastring"], first[1]["jobtags"], first[1]["salarymin"], first[1]["salarymax"]) == ("算法", "上海", "a,b", 20, 50) and first[2]["salarymin"] == 0 and first[2]["jobname"] == ""
    assert S.from_zhaopin(raw).first()["jobtags"] == "" and S.from_liepin(raw.drop("jobtags")).first()["_job_id"] is None
    pages = spark.createDataFrame([(1, '<div class="main-description">x</div><p class="content">后端 <b>开发</b><br>要求</p>'), (2, "<div class='other'>z</div>"), (3, None)], "id long, html string")
    assert {r["id"]: r["jobdescribe"] for r in S.described(pages, "id", "html", "liepin").collect()} == {1: "后端 开发要求", 2: "", 3: ""}


def test_sources_and_stream(spark, tmp_path):
    page = '<div class="joblist-item" sensorsdata=\'{"jobTitle":"算法","jobSalary":"2万"}\'><a href="/j/1"><span class="nm">&amp;工程师</span></a><i class="tag">a</i><i class="tag">b</i></div><div class="joblist-item"></div>'
    pages = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    found = cards(pages, "id", "html", "joblist-item", {"jobname": "nm", "jobtags": "tag", "companyname": "cn", "jobareastring": "ar", "salary": "sal"}).collect()
    assert [(r["jobname"], r["jobtags"], r["salary"], r["_detail_link"]) for r in found] == [("&工程师", "a,b", "2万", "/j/1")]
    assert crawl_requests(spark, ["a", "b"], ["x", "y", "z"], 2).distinct().count() == 12
    a, b = spark.createDataFrame([("1",)], "x string"), spark.createDataFrame([("2", "3")], "x string, y string")
    assert union_sources(a, b).count() == 2
    rows = spark.createDataFrame([("A", "x", "2030-01-01 00:00:00"), ("a ", "X", "2030-01-01 01:00:00"), ("b", "x", "2030-01-01 02:00:00")], "jobname string, companyname string, t string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = first_seen(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t")
    run = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("seen").count() == 2
