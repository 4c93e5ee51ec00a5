"""Queries about recognized entities, their names, relations and graph, with their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave import dictionaries as D
from talentweave.operators import entities as E
from talentweave.operators import extract as X
from talentweave.operators import relations as L
from talentweave.plans.postings import _BLANK, _q, query
from talentweave.session import table

_BLANKFREE = "regexp_replace({x}, '" + _BLANK + "', '', 'g') <> ''"


def _full(x: str) -> str:
    return _BLANKFREE.replace("{x}", x)


def _list(values: list[str]) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


# --- rules of recognition ---------------------------------------------------------------------

_EDGE = "[a-zA-Z一-鿿]"
_ALL_RULES = " UNION ALL ".join([
    f"SELECT ner_no, 'SKILL' AS entity, w AS word FROM ner_record, (SELECT unnest({_list(D.NER_SKILLS)}) AS w) WHERE regexp_matches(jobdescription, '(?i)(^|[^a-zA-Z一-鿿])' || w || '([^a-zA-Z一-鿿]|$)') AND {_full('jobdescription')}",
    *(f"SELECT ner_no, '{t}', w FROM ner_record, (SELECT unnest({_list(words)}) AS w) WHERE contains(jobdescription, w) AND {_full('jobdescription')}" for t, words in (("EDUCATION", D.NER_EDUCATION), ("MAJOR", D.NER_MAJORS))),
    f"SELECT DISTINCT ner_no, 'DUTY', d FROM (SELECT ner_no, v || trim(unnest(regexp_extract_all(jobdescription, v || '([^。\\n；;]+)', 1))) AS d FROM ner_record, (SELECT unnest({_list(D.NER_DUTY_VERBS)}) AS v) WHERE {_full('jobdescription')}) WHERE len(d) > 3",
])


def _ruled(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "ner_record").select("ner_no", F.explode(X.rule_entities(F.col("jobdescription"))).alias("e"))
    return found.select("ner_no", F.col("e.entity").alias("entity"), F.col("e.word").alias("word"))


@query("NR1_rule_entities", _ALL_RULES)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _ruled(spark, folder)


@query("NR2_education_majors", f"SELECT * FROM ({_ALL_RULES}) WHERE entity IN ('EDUCATION', 'MAJOR')")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _ruled(spark, folder).where("entity IN ('EDUCATION', 'MAJOR')")


@query("NR4_duties", f"SELECT * FROM ({_ALL_RULES}) WHERE entity = 'DUTY'")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _ruled(spark, folder).where("entity = 'DUTY'")


def _years(texts: list[str]) -> list[list[tuple[str, str]]]:
    """A stand-in for a recognizer: runs of digits are times, runs of capitals something else."""
    return [[("TIME", w) for w in re.findall("[0-9]+", t)] + [("CODE", w) for w in re.findall("[A-Z]{2,}", t)] for t in texts]


@query(
    "NR5_recognizer_in_chunks",
    "WITH c AS (SELECT ner_no, unnest(list_transform(range(0, (len(jobdescription) + 499) // 500), lambda i: substr(jobdescription, i * 500 + 1, 500))) AS piece FROM ner_record WHERE " + _full("jobdescription") + ") "
    "SELECT DISTINCT ner_no, 'TIME' AS entity, unnest(regexp_extract_all(piece, '[0-9]+')) AS word FROM c",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "ner_record").select("ner_no", "jobdescription")
    found = E.with_provider(records, "jobdescription", E.in_chunks(_years, {"TIME", "ORG", "LOC", "PER"}))
    return found.select("ner_no", F.explode("namedentity").alias("e")).select("ner_no", F.col("e.entity").alias("entity"), F.col("e.word").alias("word")).distinct()


_CLEAN = "replace(e.word, ' ', '')"
_VALID = rf"len({_CLEAN}) >= 2 AND {_full(_CLEAN)} AND NOT regexp_matches({_CLEAN}, '^([^\pL\pM\p{{Nd}}\p{{Nl}}]|_)+$')"


@query("NR6_valid_entities", f"SELECT DISTINCT ner_no, e.entity AS entity, {_CLEAN} AS word FROM (SELECT ner_no, unnest(namedentity) AS e FROM ner_record) WHERE {_VALID}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "ner_record").select("ner_no", F.explode(X.valid_entities(F.col("namedentity"))).alias("e"))
    return found.select("ner_no", F.col("e.entity").alias("entity"), F.col("e.word").alias("word"))


_KEYED = "coalesce(jobname, '') || '|' || coalesce(companyname, '')"
_RULE_LISTS = f"SELECT ner_no, {_KEYED} AS key, coalesce(list_sort(list(entity || ':' || word) FILTER (entity IS NOT NULL)), []) AS rules FROM ner_record LEFT JOIN ({_ALL_RULES}) USING (ner_no) GROUP BY ALL"
_MERGED = (
    f"WITH r AS ({_RULE_LISTS}), k AS (SELECT key, arg_max(rules, ner_no) AS rules FROM r GROUP BY key), m AS (SELECT ner_no, jobdescription, list_sort(list_transform(namedentity, lambda e: concat_ws(':', e.entity, e.word))) AS own, k.rules FROM ner_record LEFT JOIN k ON key = {_KEYED}) "
)


def _merge_inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "ner_record")
    return rows, rows.withColumn("namedentity", X.rule_entities(F.col("jobdescription")))


@query("NM1_merge_recognized", _MERGED + f"SELECT ner_no, array_to_string(CASE WHEN len(own) > 0 THEN own ELSE rules END, '¦') AS entities FROM m WHERE {_full('jobdescription')} AND len(CASE WHEN len(own) > 0 THEN own ELSE rules END) > 0")
def _(spark: SparkSession, folder: str) -> DataFrame:
    model, rules = _merge_inputs(spark, folder)
    named = F.array_sort(F.transform("namedentity", lambda e: F.concat_ws(":", e["entity"], e["word"])))
    return E.merge_recognized(model, rules, "ner_no").select("ner_no", F.array_join(named, "¦").alias("entities"))


@query(
    "A14_merge_counts",
    _MERGED + f"SELECT count(*) FILTER (NOT coalesce({_full('jobdescription')}, FALSE)) AS skipped_empty_desc, count(*) FILTER ({_full('jobdescription')} AND coalesce(len(CASE WHEN len(own) > 0 THEN own ELSE rules END), 0) = 0) AS skipped_no_entity, "
    f"count(*) FILTER ({_full('jobdescription')} AND coalesce(len(CASE WHEN len(own) > 0 THEN own ELSE rules END), 0) > 0) AS merged FROM m",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.merge_counts(*_merge_inputs(spark, folder), "ner_no")


# --- names ------------------------------------------------------------------------------------

_WORDS = f"w AS (SELECT ner_no, pos, e.entity AS etype, e.word AS word, regexp_replace(replace(regexp_replace(lower(e.word), '^{_BLANK}|{_BLANK}$', '', 'g'), '/', ' '), '{_BLANK}', ' ', 'g') AS key FROM (SELECT ner_no, generate_subscripts(namedentity, 1) - 1 AS pos, unnest(namedentity) AS e FROM ner_record) WHERE e.entity IS NOT NULL AND " + _full("e.word") + ") "
_RULES = "CASE " + " ".join(f"WHEN etype = {_q(t)} AND key = {_q(k)} THEN {_q(v)}" for (t, k), v in E._rules().items()) + " END"
_MAPPING = f"c AS (SELECT etype, word, min(key) AS key, count(*) AS freq FROM w GROUP BY etype, word), m AS (SELECT etype, word, freq, key, coalesce({_RULES}, word) AS canonical, CASE WHEN {_RULES} IS NULL THEN 'fuzzy' ELSE 'rule' END AS how FROM c) "


def _words(spark: SparkSession, folder: str) -> DataFrame:
    return E.entity_words(table(spark, folder, "ner_record"), "ner_no")


def _mapping(spark: SparkSession, folder: str, clustered: bool) -> DataFrame:
    return E.disambiguate(E.word_counts(_words(spark, folder)), clustered=clustered)


@query("A9_word_counts", "WITH " + _WORDS + "SELECT etype, word, count(*) AS freq FROM w GROUP BY ALL")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.word_counts(_words(spark, folder)).select("etype", "word", "freq")


@query("N2_rule_match", f"WITH {_WORDS}, c AS (SELECT etype, word, key, count(*) AS freq FROM w GROUP BY ALL) SELECT etype, word, freq, {_RULES} AS canonical FROM c")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.rule_match(E.word_counts(_words(spark, folder))).select("etype", "word", "freq", "canonical")


@query("A13_rule_hits", f"WITH {_WORDS}, c AS (SELECT etype, word, key FROM w) SELECT etype, count({_RULES}) AS matched, count(*) - count({_RULES}) AS unmatched FROM c GROUP BY etype")
def _(spark: SparkSession, folder: str) -> DataFrame:
    ruled = E.rule_match(_words(spark, folder))
    return ruled.groupBy("etype").agg(F.count("canonical").alias("matched"), F.count_if(F.col("canonical").isNull()).alias("unmatched"))


@query("N3_disambiguate")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _mapping(spark, folder, True)


@query("N3_rule_mapping", f"WITH {_WORDS}, {_MAPPING} SELECT etype, word, freq, canonical, how FROM m")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _mapping(spark, folder, False)


_FOLDED = f"regexp_replace(replace(regexp_replace(lower(canonical), '^{_BLANK}|{_BLANK}$', '', 'g'), '/', ' '), '{_BLANK}', ' ', 'g')"


@query("N5_apply_rule_mapping", f"WITH {_WORDS}, {_MAPPING} SELECT ner_no, pos::INTEGER AS pos, etype, canonical FROM w JOIN m USING (etype, word) QUALIFY row_number() OVER (PARTITION BY ner_no, etype, {_FOLDED} ORDER BY pos) = 1")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.apply_mapping(_words(spark, folder), _mapping(spark, folder, False), "ner_no")


@query("N5_apply_mapping")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.apply_mapping(_words(spark, folder), _mapping(spark, folder, True), "ner_no")


_SUMMED = (
    "g AS (SELECT etype, canonical, count(*) AS n, count(*) FILTER (how = 'rule') AS ruled, count(*) FILTER (how = 'fuzzy' AND word <> canonical) AS merged, count(*) FILTER (how = 'fuzzy' AND freq <= 1) AS rare FROM m GROUP BY etype, canonical), "
    "a AS (SELECT * FROM g UNION ALL SELECT '(all)', canonical, n, ruled, merged, rare FROM g) "
    "SELECT etype, sum(n)::BIGINT AS total_unique, sum(ruled)::BIGINT AS rule_resolved, sum(merged)::BIGINT AS fuzzy_merged, count(*) FILTER (n > 1) AS merged_groups, sum(CASE WHEN n = 1 THEN rare ELSE 0 END)::BIGINT AS unresolved_low_freq, sum(n)::BIGINT AS mapping_size FROM a GROUP BY etype"
)


@query("N7_rule_mapping_summary", f"WITH {_WORDS}, {_MAPPING}, {_SUMMED}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.mapping_summary(_mapping(spark, folder, False))


@query("N7_mapping_summary")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.mapping_summary(_mapping(spark, folder, True))


@query("A11_rule_groups", f"WITH {_WORDS}, {_MAPPING} SELECT etype, canonical, array_to_string(list_sort(list(word)), '¦') AS words, count(*) AS n FROM m GROUP BY etype, canonical HAVING count(*) > 1")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.cluster_report(_mapping(spark, folder, False)).withColumn("words", F.array_join("words", "¦"))


@query("K14_unresolved_by_rules", f"WITH {_WORDS}, {_MAPPING} SELECT etype, word, freq FROM m QUALIFY count(*) OVER (PARTITION BY etype, canonical) = 1 AND how = 'fuzzy' AND freq <= 1")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.unresolved(_mapping(spark, folder, False))


def _same_key(etype: str, words: list[str]) -> str:
    """A stand-in for a language model: words that are equal without case and blanks are one."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w.lower().replace(" ", ""), []).append(w)
    return json.dumps({"groups": [{"canonical": own[0], "variants": own} for own in groups.values() if len(own) > 1]})


_ASKED = (
    f"WITH {_WORDS}, c AS (SELECT etype, word, count(*) AS freq FROM w GROUP BY etype, word), r AS (SELECT *, row_number() OVER (PARTITION BY etype ORDER BY freq DESC, word) - 1 AS n FROM c), "
    "a AS (SELECT etype, word, trim(first_value(word) OVER (PARTITION BY etype, n // 100, replace(lower(word), ' ', '') ORDER BY n)) AS first, count(*) OVER (PARTITION BY etype, n // 100, replace(lower(word), ' ', '')) AS k FROM r), "
    "m AS (SELECT etype, word, CASE WHEN k > 1 THEN first ELSE word END AS canonical FROM a) "
)


@query("N9_asked_mapping", _ASKED + "SELECT * FROM m")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.asked_mapping(E.word_counts(_words(spark, folder)), _same_key)


@query("N10_apply_asked_mapping", _ASKED + "SELECT ner_no, pos::INTEGER AS pos, etype, canonical FROM w JOIN m USING (etype, word) QUALIFY row_number() OVER (PARTITION BY ner_no, etype, lower(canonical) ORDER BY pos) = 1")
def _(spark: SparkSession, folder: str) -> DataFrame:
    words = _words(spark, folder)
    return E.apply_mapping(words, E.asked_mapping(E.word_counts(words), _same_key), "ner_no", F.lower)


@query("A12_asked_summary", _ASKED + "SELECT count(*) AS total_entities, count(*) FILTER (word <> canonical) AS merged, count(DISTINCT (etype, canonical)) AS groups FROM m")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.asked_summary(E.asked_mapping(E.word_counts(_words(spark, folder)), _same_key))


# --- relations --------------------------------------------------------------------------------

_SENTENCES = rf"sn AS (SELECT ner_no, generate_subscripts(p, 1) - 1 AS sentence_no, unnest(p) AS s FROM (SELECT ner_no, regexp_split_to_array(jobdescription, '[。；;\n]+') AS p FROM ner_record)), st AS (SELECT ner_no, sentence_no::INTEGER AS sentence_no, regexp_replace(s, '^{_BLANK}|{_BLANK}$', '', 'g') AS s FROM sn), se AS (SELECT ner_no, sentence_no, regexp_replace(s, '^\d+[、\.]\s*', '') AS sentence FROM st WHERE len(s) > 5)"
_NAMED = (
    f"wd AS (SELECT DISTINCT ner_no, word FROM ({_ALL_RULES}) WHERE entity <> 'DUTY' AND word <> '' UNION SELECT ner_no, e.word FROM (SELECT ner_no, unnest(namedentity) AS e FROM ner_record) WHERE e.word <> '' "
    "UNION SELECT ner_no, canonical FROM ner_record JOIN canonical_ref ON field_name = 'skills' AND contains(jobdescription, canonical))"
)
_GAP = "strpos(sentence, r) - strpos(sentence, l) - len(l)"
_LR = (
    "pr AS (SELECT se.ner_no, sentence_no, sentence, a.word AS l, b.word AS r FROM se JOIN wd a USING (ner_no) JOIN wd b ON b.ner_no = se.ner_no AND a.word <> b.word WHERE contains(sentence, a.word) AND contains(sentence, b.word) "
    "AND NOT contains(a.word, b.word) AND NOT contains(b.word, a.word) AND (strpos(sentence, a.word), a.word) < (strpos(sentence, b.word), b.word))"
)


def _trigger(words: str, before: str = "{0,20}?", behind: str = "{0,20}?") -> str:
    gap = r"[^,。;；\n]"
    return f"regexp_matches(sentence, regexp_escape(l) || {_q(gap + before + words + gap + behind)} || regexp_escape(r))"


_KIND = (
    f"CASE WHEN {_trigger(D.TOGETHER)} THEN 'Co_Occurrence' WHEN {_trigger(D.INCLUDES)} THEN 'Include' WHEN {_trigger(D.INCLUDED)} THEN 'Include back' WHEN {_trigger(D.APPLIES)} THEN 'Apply_To' "
    f"WHEN {_trigger('[:：]', '{0,5}?', '{0,30}?')} THEN 'Include' END"
)
_PARTED = f"(regexp_matches(substr(sentence, strpos(sentence, l) + len(l), greatest({_GAP}, 0)), '[:：]') OR (regexp_matches(substr(sentence, strpos(sentence, l) + len(l), greatest({_GAP}, 0)), '[,，]') AND {_GAP} > 15))"
_GUESS = "(len(l) + len(r)) % 6"
_TRIPLES = (
    f"{_SENTENCES}, {_NAMED}, {_LR}, kd AS (SELECT *, {_KIND} AS kind FROM pr WHERE {_GAP} <= 35), "
    "tr AS (SELECT ner_no, sentence_no, sentence, CASE WHEN kind LIKE '% back' THEN r ELSE l END AS subject, replace(kind, ' back', '') AS relation, CASE WHEN kind LIKE '% back' THEN l ELSE r END AS object, 'Rule' AS stage FROM kd WHERE kind IS NOT NULL), "
    f"sm AS (SELECT ner_no, sentence_no, sentence, CASE WHEN {_GUESS} IN (2, 4) THEN r ELSE l END AS subject, ['Co_Occurrence', 'Apply_To', 'Apply_To', 'Include', 'Include'][{_GUESS} + 1] AS relation, CASE WHEN {_GUESS} IN (2, 4) THEN l ELSE r END AS object, 'Semantic' AS stage "
    f"FROM kd WHERE kind IS NULL AND NOT {_PARTED} AND len(sentence) % 2 = 0 AND {_GUESS} < 5), al AS (SELECT * FROM tr UNION ALL SELECT * FROM sm) "
)


def _guess(asked: list[tuple[str, str, str]]) -> list[tuple[int, float]]:
    """A stand-in for a classifier."""
    return [((len(a) + len(b)) % 6, 0.9 if len(s) % 2 == 0 else 0.5) for s, a, b in asked]


def _with_words(spark: SparkSession, folder: str) -> DataFrame:
    """Records with the words of both recognizers, and the skills of the reference list that their texts name."""
    rules = F.filter(F.coalesce(X.rule_entities(F.col("jobdescription")), F.array().cast("array<struct<entity:string,word:string>>")), lambda e: e["entity"] != "DUTY")
    own = F.coalesce("namedentity", F.array().cast("array<struct<entity:string,word:string>>"))
    records = table(spark, folder, "ner_record")
    return records.withColumn("namedentity", F.concat(own, rules, X.listed_entities(F.col("jobdescription"), _skills(spark, folder), "SKILL")))


def _skills(spark: SparkSession, folder: str, most: int = 10_000) -> list[str]:
    """Skills of the reference list, whose number is checked."""
    rows = table(spark, folder, "canonical_ref").where("field_name = 'skills'").select("canonical").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} skills")
    return sorted(r[0] for r in rows)


def _triples(spark: SparkSession, folder: str) -> DataFrame:
    return L.relation_triples(_with_words(spark, folder), "ner_no", classifier=_guess)


@query("R1_sentences", f"WITH {_SENTENCES} SELECT * FROM se")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.sentences(table(spark, folder, "ner_record"), "ner_no", "jobdescription")


@query("R2_entity_pairs", f"WITH {_SENTENCES}, {_NAMED}, {_LR} SELECT ner_no, sentence_no, l AS left_word, r AS right_word, ({_GAP})::INTEGER AS gap FROM pr")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = L.pairs_of_sentences(_with_words(spark, folder), "ner_no")
    return found.select("ner_no", "sentence_no", F.col("l.word").alias("left_word"), F.col("r.word").alias("right_word"), "gap")


@query("R4_rule_triples", f"WITH {_TRIPLES} SELECT ner_no, sentence_no, subject, relation, object FROM tr")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return L.relation_triples(_with_words(spark, folder), "ner_no").select("ner_no", "sentence_no", "subject", "relation", "object")


@query("R5_triples_by_layers", f"WITH {_TRIPLES} SELECT ner_no, sentence_no, subject, relation, object, stage FROM al")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _triples(spark, folder).drop("sentence")


@query("K4_triples_by_stage", f"WITH {_TRIPLES} SELECT stage, count(*) AS triples FROM al GROUP BY stage UNION ALL SELECT 'Final', count(*) FROM al HAVING count(*) > 0")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return L.stage_counts(_triples(spark, folder))


@query("A15_triples_by_relation", f"WITH {_TRIPLES} SELECT relation, count(*) AS triples FROM tr GROUP BY relation")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return L.relation_triples(_with_words(spark, folder), "ner_no").groupBy("relation").agg(F.count(F.lit(1)).alias("triples"))


def _first_two(asked: list[tuple[str, list[str]]]) -> list[str | None]:
    """A stand-in for a language model: the first two words belong together; some replies are broken."""
    said = ["```json\n" + json.dumps([{"subject": w[0], "relation": "Co_Occurrence", "object": w[1]}], ensure_ascii=False) + "\n```" if len(w) > 1 else "[]" for _, w in asked]
    return [None if len(t) % 7 == 0 else "no json" if len(t) % 5 == 0 else r for (t, _), r in zip(asked, said, strict=True)]


@query(
    "R10_asked_relations",
    "WITH e AS (SELECT ner_no, jobdescription AS t, list_filter(list_transform(namedentity, lambda e: e.word), lambda x: x <> '') AS w FROM ner_record) SELECT ner_no, w[1] AS subject, 'Co_Occurrence' AS relation, w[2] AS object FROM e WHERE t <> '' AND len(w) > 1 AND len(t) % 7 <> 0 AND len(t) % 5 <> 0",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = L.asked_relations(table(spark, folder, "ner_record"), _first_two)
    return found.select("ner_no", F.explode("relations").alias("r")).select("ner_no", "r.subject", "r.relation", "r.object")


# --- the graph of entities --------------------------------------------------------------------

_RELATION = "CASE e.entity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.ENTITY_RELATIONS.items()) + " ELSE 'RELATED_TO' END"


@query("G8_entity_jobs", "SELECT detaillink AS link, " + ", ".join(f"arg_max({{t: {c}}}, ner_no).t AS {c}" for c in ("jobname", "companyname", "jobarea", "degree", "experience", "salarymin", "salarymax")) + " FROM ner_record WHERE detaillink IS NOT NULL GROUP BY detaillink")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.entity_jobs(table(spark, folder, "ner_record"), "ner_no")


@query("G9_entity_edges", f"SELECT DISTINCT link, {_RELATION} AS relation, e.word AS name FROM (SELECT detaillink AS link, unnest(namedentity) AS e FROM ner_record WHERE detaillink IS NOT NULL) WHERE {_full('e.word')}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.entity_edges(table(spark, folder, "ner_record"))


@query("G10_relation_edges", f"WITH {_TRIPLES} SELECT DISTINCT subject, relation, object FROM tr")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.relation_edges(L.relation_triples(_with_words(spark, folder), "ner_no"))


@query("A19_entity_labels", f"SELECT e.word AS name, array_to_string(list_sort(list_distinct(list(e.entity))), '¦') AS labels FROM (SELECT unnest(namedentity) AS e FROM ner_record) WHERE {_full('e.word')} GROUP BY e.word")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return E.entity_labels(table(spark, folder, "ner_record")).withColumn("labels", F.array_join("labels", "¦"))
