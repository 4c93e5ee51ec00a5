"""Recognized entities: merging of recognizers, disambiguation of words, the entity graph."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentweave.dictionaries import ENTITY_RELATIONS, NED_DEGREES, NED_MAJORS, SKILLS
from talentweave.functions.text import ned_key
from talentweave.session import cut_lineage, numbered

def _job_key(title: str, company: str) -> Column:
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("|"), F.coalesce(F.col(company), F.lit("")))


def merge_recognized(model: DataFrame, rules: DataFrame, order_col: str, entities: str = "namedentity", description: str = "jobdescription") -> DataFrame:
    """The model's entities, or those of the rules where it found none; rows without a description
    or any entity leave. Of several rule rows for a posting the last counts."""
    keyed = rules.withColumn("_key", _job_key("jobname", "companyname")).groupBy("_key").agg(F.max_by(entities, order_col).alias("_rules"))
    joined = model.where(F.col(description).rlike(r"(?U)\S")).withColumn("_key", _job_key("jobname", "companyname")).join(keyed, "_key", "left")
    merged = F.when(F.size(entities) > 0, F.col(entities)).otherwise(F.col("_rules"))
    return joined.withColumn(entities, merged).where(F.size(entities) > 0).drop("_key", "_rules")


def merge_counts(model: DataFrame, rules: DataFrame, order_col: str, entities: str = "namedentity", description: str = "jobdescription") -> DataFrame:
    """One row: how many records of the model lack a description, lack entities, and were merged."""
    full = F.coalesce(F.col(description).rlike(r"(?U)\S"), F.lit(False))
    merged = merge_recognized(model, rules, order_col, entities, description).agg(F.count(F.lit(1)).alias("merged"))
    seen = model.agg(F.count_if(~full).alias("skipped_empty_desc"), F.count_if(full).alias("_full"))
    return seen.crossJoin(F.broadcast(merged)).select("skipped_empty_desc", (F.col("_full") - F.col("merged")).alias("skipped_no_entity"), "merged")


def entity_words(records: DataFrame, id_col: str, entities: str = "namedentity") -> DataFrame:
    """(id, pos, etype, word, key) of every word that isn't blank."""
    rows = records.select(F.col(id_col), F.posexplode(entities).alias("pos", "_e")).select(id_col, "pos", F.col("_e.entity").alias("etype"), F.col("_e.word").alias("word"))
    return rows.where(F.col("etype").isNotNull() & F.col("word").rlike(r"(?U)\S")).withColumn("key", ned_key(F.col("word")))


def word_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("etype", "word").agg(F.count(F.lit(1)).alias("freq"), F.min("key").alias("key"))


def _rules() -> dict[tuple[str, str], str]:
    def key(text: str) -> str:
        return " ".join(text.lower().strip().replace("/", " ").split())

    table = {("SKILL", key(n)): canonical for canonical, aliases in SKILLS.items() for n in (canonical, *aliases)}
    table |= {("DEGREE", key(k)): v for k, v in NED_DEGREES.items()}
    return table | {("MAJOR", key(k)): v for k, v in NED_MAJORS.items()}


def rule_match(counted: DataFrame) -> DataFrame:
    """Adds ``canonical`` from the word lists, null where they don't know a word: a literal map."""
    pairs = F.create_map(*[F.lit(x) for (etype, key), v in _rules().items() for x in (f"{etype}|{key}", v)])
    return counted.withColumn("canonical", F.try_element_at(pairs, F.concat_ws("|", "etype", "key")))


def cluster_words(words: list[str], keys: list[str], threshold: float) -> list[str]:
    """Greedy clustering in the given order: each word joins the first cluster whose first word is
    similar enough; returns that first word. Compares words one by one: what disambiguate must equal."""
    heads: list[tuple[str, str]] = []
    found = []
    for word, key in zip(words, keys, strict=True):
        for head, head_key in heads:
            if likeness(key, head_key, threshold) is not None:
                found.append(head)
                break
        else:
            heads.append((word, key))
            found.append(word)
    return found


def likeness(a: str, b: str, least: float = 0.0) -> float | None:
    """Share of two texts that lies in common blocks (twice the common letters by both lengths), None
    below ``least``. The order of the two matters."""
    match = SequenceMatcher(None, a, b)
    if match.real_quick_ratio() < least or match.quick_ratio() < least:
        return None
    ratio = match.ratio()
    return ratio if ratio >= least else None


def _alike(rest: DataFrame, threshold: float) -> DataFrame:
    """(etype, word, head): pairs of a type's words, the head being the more frequent one (ties by text),
    whose likeness reaches the threshold.

    Common blocks hold no more letters than both words have in common. A word of n letters
    therefore shares at least n t / (2 - t) of them with any that is similar enough, and so one of
    its n - that + 1 rarest; only words that meet on such a letter are compared. Words of a type
    that share letters are few in comparison with all, and none is gathered in one task.
    """

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*row, len(row[3]), f"{x}|{k}") for row in pdf.itertuples(index=False) for x, n in Counter(row[3]).items() for k in range(n)]
            yield pd.DataFrame(rows, columns=["etype", "word", "freq", "key", "n", "letter"])

    spread = rest.select("etype", "word", "freq", "key").mapInPandas(spell, "etype string, word string, freq bigint, key string, n int, letter string")
    seen = spread.groupBy("etype", "letter").agg(F.count(F.lit(1)).alias("times"))
    rarest = Window.partitionBy("etype", "word").orderBy("times", "letter")
    kept = spread.join(seen, ["etype", "letter"]).withColumn("_r", F.row_number().over(rarest))
    prefix = cut_lineage(kept.where(F.col("_r") <= F.col("n") - F.ceil(F.col("n") * threshold / (2 - threshold) - 1e-9) + 1).drop("times", "_r"))
    other = prefix.select("etype", "letter", F.col("word").alias("head"), F.col("freq").alias("head_freq"), F.col("key").alias("head_key"), F.col("n").alias("m"))
    earlier = (F.col("head_freq") > F.col("freq")) | ((F.col("head_freq") == F.col("freq")) & (F.col("head") < F.col("word")))
    close = F.least("n", "m") * 2 >= threshold * (F.col("n") + F.col("m")) - 1e-9
    met = prefix.join(other, ["etype", "letter"]).where(earlier & close).select("etype", "word", "key", "head", "head_freq", "head_key").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            good = [likeness(a, b, threshold) is not None for a, b in zip(pdf["key"], pdf["head_key"], strict=True)]
            yield pdf.loc[good, ["etype", "word", "head", "head_freq"]]

    return met.mapInPandas(run, "etype string, word string, head string, head_freq bigint")


def disambiguate(counted: DataFrame, threshold: float = 0.85, clustered: bool = True) -> DataFrame:
    """(etype, word, freq, canonical, how): by the word lists, else by greedy clustering of a type's
    words, the frequent ones first, ties by text.

    Greedy clustering in that order means: a word heads a cluster if no earlier head is similar
    to it, else it belongs to the earliest such head. This is settled in rounds over the pairs
    of similar words: who has an earlier similar head belongs to it, who has only earlier words that
    belong elsewhere is a head. The result is that of cluster_words, whatever the number of words.
    Without ``clustered`` the words that the lists don't know stand for themselves.
    """
    ruled = cut_lineage(rule_match(counted)) if clustered else rule_match(counted)
    done = ruled.where(F.col("canonical").isNotNull()).select("etype", "word", "freq", "canonical", F.lit("rule").alias("how"))
    rest = ruled.where(F.col("canonical").isNull()).select("etype", "word", "freq", "key")
    if not clustered:
        return done.unionByName(rest.select("etype", "word", "freq", F.col("word").alias("canonical"), F.lit("fuzzy").alias("how")))
    near = cut_lineage(_alike(rest, threshold))
    names = near.select("etype", "word").distinct()
    heads = near.select("etype", F.col("head").alias("word")).distinct().join(names, ["etype", "word"], "left_anti").withColumn("leads", F.lit(True))
    known = cut_lineage(heads)
    left = names
    while not left.isEmpty():
        state = near.join(left, ["etype", "word"], "left_semi").join(known.select("etype", F.col("word").alias("head"), "leads"), ["etype", "head"], "left")
        judged = state.groupBy("etype", "word").agg(F.max("leads").alias("some"), F.count_if(F.col("leads").isNull()).alias("open"))
        settled = judged.where(F.coalesce("some", F.lit(False)) | (F.col("open") == 0)).select("etype", "word", (~F.coalesce("some", F.lit(False))).alias("leads"))
        known = cut_lineage(known.unionByName(settled))
        left = cut_lineage(left.join(known, ["etype", "word"], "left_anti"))
    first = near.join(known.where("leads").select("etype", F.col("word").alias("head")), ["etype", "head"]).groupBy("etype", "word").agg(F.min_by("head", F.struct(-F.col("head_freq"), "head")).alias("canonical"))
    members = first.join(known.where("leads"), ["etype", "word"], "left_anti")
    fuzzy = rest.join(members, ["etype", "word"], "left").select("etype", "word", "freq", F.coalesce("canonical", "word").alias("canonical"), F.lit("fuzzy").alias("how"))
    return done.unionByName(fuzzy)


def apply_mapping(words: DataFrame, mapping: DataFrame, id_col: str, same: Callable[[Column], Column] = ned_key) -> DataFrame:
    """(id, pos, etype, canonical): words replaced by the mapping, each once a record, the first one.
    ``same`` is the key under which two words of a record are one."""
    named = words.join(mapping.select("etype", "word", "canonical"), ["etype", "word"], "left").withColumn("canonical", F.coalesce("canonical", "word"))
    first = Window.partitionBy(id_col, "etype", same(F.col("canonical"))).orderBy("pos")
    return named.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(id_col, "pos", "etype", "canonical")


def cluster_report(mapping: DataFrame) -> DataFrame:
    """(etype, canonical, words, n) of every canonical word that stands for several, words sorted."""
    grouped = mapping.groupBy("etype", "canonical").agg(F.array_sort(F.collect_set("word")).alias("words"), F.count(F.lit(1)).alias("n"))
    return grouped.where(F.col("n") > 1)


def unresolved(mapping: DataFrame, most_freq: int = 1) -> DataFrame:
    """(etype, word, freq) of rare words that no list knows and no other word joins, for people to look at."""
    alone = mapping.groupBy("etype", "canonical").agg(F.count(F.lit(1)).alias("n"), F.max("freq").alias("freq"), F.max("how").alias("how"), F.max("word").alias("word"))
    return alone.where((F.col("n") == 1) & (F.col("how") == "fuzzy") & (F.col("freq") <= most_freq) & (F.col("word") == F.col("canonical"))).select("etype", "word", "freq")


def mapping_summary(mapping: DataFrame, most_freq: int = 1) -> DataFrame:
    """(etype, total_unique, rule_resolved, fuzzy_merged, merged_groups, unresolved_low_freq, mapping_size);
    the etype (all) stands for all of them."""
    by = mapping.groupBy("etype", "canonical").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("how") == "rule").alias("ruled"), F.count_if((F.col("how") == "fuzzy") & (F.col("word") != F.col("canonical"))).alias("merged"),
        F.count_if((F.col("how") == "fuzzy") & (F.col("freq") <= most_freq)).alias("rare"),
    )
    both = by.withColumn("etype", F.explode(F.array("etype", F.lit("(all)"))))
    return both.groupBy("etype").agg(
        F.sum("n").alias("total_unique"), F.sum("ruled").alias("rule_resolved"), F.sum("merged").alias("fuzzy_merged"), F.count_if(F.col("n") > 1).alias("merged_groups"),
        F.sum(F.when(F.col("n") == 1, F.col("rare")).otherwise(0)).alias("unresolved_low_freq"), F.sum("n").alias("mapping_size"),
    )


def asked_mapping(counted: DataFrame, model: Callable[[str, list[str]], str], batch: int = 100) -> DataFrame:
    """(etype, word, canonical) that a language model replies with, asked about a type's words in batches,
    the frequent ones first.

    A reply is a JSON object with groups of a canonical word and its variants. Variants that nobody
    asked about enter the mapping too; of several groups with one variant the last batch's counts.
    Words in no group, and all words of a failed or unreadable reply, stand for themselves.
    """
    ranked = numbered(counted.select("etype", "word", "freq"), "etype", [F.desc("freq"), F.asc("word")])
    batched = ranked.withColumn("batch", F.floor(F.col("number") / batch))

    def ask(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("number")
        etype, number = pdf["etype"].iloc[0], int(pdf["batch"].iloc[0])
        rows = [(etype, number, -1, w, w) for w in pdf["word"]]
        try:
            groups = json.loads(model(etype, pdf["word"].tolist())).get("groups", [])
            for k, group in enumerate(groups):
                canonical, variants = str(group.get("canonical") or "").strip(), group.get("variants") or []
                if canonical:
                    rows += [(etype, number, k, str(v), canonical) for v in variants]
        except Exception:  # noqa: BLE001, a reply that fails in any way leaves the words as they are
            rows = rows[: len(pdf)]
        return pd.DataFrame(rows, columns=["etype", "batch", "pos", "word", "canonical"])

    said = batched.groupBy("etype", "batch").applyInPandas(ask, "etype string, batch bigint, pos int, word string, canonical string")
    return said.groupBy("etype", "word").agg(F.max_by("canonical", F.struct(F.col("pos") >= 0, "batch", "pos", "canonical")).alias("canonical"))


def asked_summary(mapping: DataFrame) -> DataFrame:
    """One row: total_entities, merged, groups of a mapping."""
    return mapping.agg(F.count(F.lit(1)).alias("total_entities"), F.count_if(F.col("word") != F.col("canonical")).alias("merged"), F.count_distinct("etype", "canonical").alias("groups"))


def sentences(records: DataFrame, id_col: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, sentence_no, sentence): pieces between full stops, semicolons and line breaks, of more than
    five characters, without leading numbers. The columns ``keep`` are carried along."""
    rows = records.select(F.col(id_col), *keep, F.posexplode(F.split(text, r"[。；;\n]+")).alias("sentence_no", "_s")).withColumn("_s", F.regexp_replace("_s", r"(?U)^\s+|\s+$", ""))
    return rows.where(F.length("_s") > 5).select(id_col, *keep, "sentence_no", F.regexp_replace("_s", r"^\d+[、\.]\s*", "").alias("sentence"))


def entity_edges(records: DataFrame, link: str = "detaillink", entities: str = "namedentity") -> DataFrame:
    """(link, relation, name) of the entity graph, each once; null links and blank words leave."""
    table = F.create_map(*[F.lit(x) for pair in ENTITY_RELATIONS.items() for x in pair])
    rows = records.where(F.col(link).isNotNull()).select(F.col(link).alias("link"), F.explode(entities).alias("_e"))
    named = rows.where(F.col("_e.word").rlike(r"(?U)\S"))
    return named.select("link", F.coalesce(F.try_element_at(table, F.col("_e.entity")), F.lit("RELATED_TO")).alias("relation"), F.col("_e.word").alias("name")).distinct()


def entity_jobs(records: DataFrame, order_col: str, link: str = "detaillink") -> DataFrame:
    """One posting node for each link, with the fields of the last record; null links leave."""
    fields = [c for c in ("jobname", "companyname", "jobarea", "degree", "experience", "salarymin", "salarymax") if c in records.columns]
    last = records.where(F.col(link).isNotNull()).groupBy(F.col(link).alias("link")).agg(F.max_by(F.struct(*fields), F.col(order_col)).alias("_j"))
    return last.select("link", "_j.*")


def relation_edges(triples: DataFrame) -> DataFrame:
    """(subject, relation, object) between entities, each once; blank ends leave."""
    named = triples.where(F.col("subject").rlike(r"(?U)\S") & F.col("object").rlike(r"(?U)\S") & F.col("relation").isNotNull())
    return named.select("subject", "relation", "object").distinct()


def entity_labels(records: DataFrame, entities: str = "namedentity") -> DataFrame:
    """(name, labels): entities by name with all their types."""
    rows = records.select(F.explode(entities).alias("_e")).where(F.col("_e.word").rlike(r"(?U)\S"))
    return rows.groupBy(F.col("_e.word").alias("name")).agg(F.array_sort(F.collect_set("_e.entity")).alias("labels"))


def in_chunks(model: Callable[[list[str]], list[list[tuple[str, str]]]], kinds: set[str], size: int = 500) -> Callable[[list[str]], list[list[tuple[str, str]]]]:
    """A recognizer that sees texts in chunks of ``size`` characters and keeps some kinds of entities."""

    def run(texts: list[str]) -> list[list[tuple[str, str]]]:
        chunks = [(k, t[at : at + size]) for k, t in enumerate(texts) for at in range(0, len(t), size)]
        found: list[list[tuple[str, str]]] = [[] for _ in texts]
        for (k, _), own in zip(chunks, model([c for _, c in chunks]), strict=True):
            found[k] += [(e, w) for e, w in own if e in kinds]
        return found

    return run


def with_provider(records: DataFrame, text: str, provider: Callable[[list[str]], list[list[tuple[str, str]]]], out: str = "namedentity") -> DataFrame:
    """Adds entities that a recognizer finds, called with a batch of texts at a time; blank texts get
    null. The recognizer is any picklable callable: a model, a service, or a stub."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in records.drop(out).schema), f"{out} array<struct<entity:string,word:string>>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            full = pdf[text].fillna("").str.strip() != ""
            found = iter(provider(pdf.loc[full, text].tolist()) if full.any() else [])
            yield pdf.assign(**{out: [[{"entity": e, "word": w} for e, w in next(found)] if f else None for f in full]})

    return records.drop(out).mapInPandas(run, schema)
