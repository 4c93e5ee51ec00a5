"""Relations between entities of a sentence: a cascade of rules, syntax and meaning.

Each layer sees only the pairs that the layers before it left open. The rules are column
expressions; parser and classifier are callables that come with batches of texts, as are
language models.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.dictionaries import APPLIES, INCLUDED, INCLUDES, TOGETHER
from talentweave.operators.entities import sentences

# Distance of two entities at most, distance across a comma at most, confidence of a meaning.
MOST_DISTANCE, COMMA_DISTANCE, CONFIDENT = 35, 15, 0.65
#: A classifier's labels: relation, and whether the right entity is its subject.
LABELS = [("Co_Occurrence", False), ("Apply_To", False), ("Apply_To", True), ("Include", False), ("Include", True), (None, False)]
_TRIPLE = "sentence_no int, sentence string, subject string, relation string, object string, stage string"


@dataclass
class Token:
    """A token of a parsed sentence: where it starts and ends, its head's number (its own for the
    root), and its dependency label."""

    start: int
    end: int
    head: int
    dep: str


Parser = Callable[[list[str]], list[list[Token]]]
#: Gets (sentence, left, right) triples, returns a label's number (see LABELS) and its confidence for each.
Classifier = Callable[[list[tuple[str, str, str]]], list[tuple[int, float]]]


def pairs_of_sentences(records: DataFrame, id_col: str, text: str = "jobdescription", entities: str = "namedentity") -> DataFrame:
    """(id, sentence_no, sentence, l, r, gap) of every two entity words of one sentence, in the order of
    their first places; words that contain one another make no pair. The words travel with the
    sentences, so that nothing is joined. Null texts and arrays give nothing."""
    words = F.array_distinct(F.transform(entities, lambda e: e["word"]))
    own = sentences(records.select(F.col(id_col), F.col(text).alias("_t"), words.alias("_w")), id_col, "_t", ("_w",))
    placed = F.expr("array_sort(transform(filter(_w, w -> w is not null and w <> '' and instr(sentence, w) > 0), w -> struct(instr(sentence, w) AS at, length(w) AS size, w AS word)))")
    rows = own.select(id_col, "sentence_no", "sentence", placed.alias("_p")).where(F.size("_p") > 1)
    left = rows.select(id_col, "sentence_no", "sentence", "_p", F.posexplode("_p").alias("_i", "l"))
    pairs = left.select(id_col, "sentence_no", "sentence", "l", F.explode(F.expr("slice(_p, _i + 2, size(_p))")).alias("r"))
    pairs = pairs.where(~F.contains(F.col("l.word"), F.col("r.word")) & ~F.contains(F.col("r.word"), F.col("l.word")))
    return pairs.withColumn("gap", F.col("r.at") - F.col("l.at") - F.col("l.size"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))


def rule_kind() -> Column:
    """Struct (relation, back) of the first rule that joins l and r, null if none does; ``back`` says that
    the right entity is the subject."""
    between = r"[^,。;；\n]{0,20}?"
    left, right, text = _quoted(F.col("l.word")), _quoted(F.col("r.word")), F.col("sentence")
    named = F.contains(text, F.col("l.word")) & F.contains(text, F.col("r.word"))

    def joined(trigger: str, before: str = between, behind: str = between) -> Column:
        return named & F.rlike(text, F.concat(left, F.lit(before + trigger + behind), right))

    def kind(relation: str, back: bool) -> Column:
        return F.struct(F.lit(relation).alias("relation"), F.lit(back).alias("back"))

    colon = joined("[:：]", r"[^,。;；\n]{0,5}?", r"[^,。;；\n]{0,30}?")
    found = F.when(joined(TOGETHER), kind("Co_Occurrence", False)).when(joined(INCLUDES), kind("Include", False)).when(joined(INCLUDED), kind("Include", True))
    return found.when(joined(APPLIES), kind("Apply_To", False)).when(colon, kind("Include", False))


def _said(found: DataFrame, id_col: str, stage: str) -> DataFrame:
    swap, left, right = F.col("_k.back"), F.col("l.word"), F.col("r.word")
    return found.select(
        id_col, "sentence_no", "sentence", F.when(swap, right).otherwise(left).alias("subject"), F.col("_k.relation").alias("relation"), F.when(swap, left).otherwise(right).alias("object"), F.lit(stage).alias("stage")
    )


def tree_path(tokens: list[Token], a: int, b: int) -> list[int] | None:
    """Numbers of the tokens on the way between two tokens of a dependency tree, ends included; None
    if they aren't connected."""
    up: list[list[int]] = []
    for start in (a, b):
        chain, at = [start], start
        while tokens[at].head != at and tokens[at].head not in chain:
            at = tokens[at].head
            chain.append(at)
        up.append(chain)
    meet = next((x for x in up[0] if x in up[1]), None)
    if meet is None:
        return None
    return up[0][: up[0].index(meet) + 1] + up[1][: up[1].index(meet)][::-1]


def head_token(tokens: list[Token], start: int, end: int) -> int | None:
    """The token within a span whose head lies outside of it, the first one if several do."""
    inside = [k for k, t in enumerate(tokens) if t.start < end and t.end > start]
    return next((k for k in inside if tokens[k].head == k or tokens[k].head not in inside), None)


def syntax_kind(tokens: list[Token], left: tuple[int, int], right: tuple[int, int]) -> tuple[str, bool] | None:
    """(relation, back) that the dependency path between two spans tells: coordination, or a tool of a
    verb or preposition within three steps. None for paths of more than four steps."""
    a, b = head_token(tokens, *left), head_token(tokens, *right)
    path = tree_path(tokens, a, b) if a is not None and b is not None else None
    if path is None or len(path) > 5:
        return None
    labels, steps = {tokens[k].dep for k in path}, len(path) - 1
    if "conj" in labels:
        return "Co_Occurrence", False
    if steps <= 3 and labels & {"prep", "pobj", "dobj", "nmod"}:
        return "Apply_To", tokens[b].dep in ("dobj", "pobj")
    if steps == 1 and "compound" in labels:
        return "Apply_To", False
    return None


def _asked(pairs: DataFrame, id_col: str, ask: Callable[[pd.DataFrame], list[tuple[str, bool] | None]]) -> DataFrame:
    """Adds _k from a callable, in batches; the pairs that it decides nothing of keep a null."""
    schema = f"`{id_col}` {pairs.schema[id_col].dataType.simpleString()}, sentence_no int, sentence string, lw string, la int, rw string, ra int, gap int, relation string, back boolean"
    flat = pairs.select(id_col, "sentence_no", "sentence", F.col("l.word").alias("lw"), F.col("l.at").alias("la"), F.col("r.word").alias("rw"), F.col("r.at").alias("ra"), "gap")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = ask(pdf) if len(pdf) else []
            yield pdf.assign(relation=[f[0] if f else None for f in found], back=[f[1] if f else None for f in found])

    done = flat.mapInPandas(run, schema)
    kind = F.when(F.col("relation").isNotNull(), F.struct("relation", "back"))
    return done.select(id_col, "sentence_no", "sentence", F.struct(F.col("la").alias("at"), F.length("lw").alias("size"), F.col("lw").alias("word")).alias("l"), F.struct(F.col("ra").alias("at"), F.length("rw").alias("size"), F.col("rw").alias("word")).alias("r"), "gap", kind.alias("_k"))


def open_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that no rule joins and no punctuation parts: no colon between them, no comma over a distance."""
    gap = F.substring(F.col("sentence"), F.col("l.at") + F.col("l.size"), F.greatest(F.col("gap"), F.lit(0)))
    parted = F.rlike(gap, F.lit("[:：]")) | (F.rlike(gap, F.lit("[,，]")) & (F.col("gap") > COMMA_DISTANCE))
    return pairs.where(~parted)


def relation_triples(
    records: DataFrame, id_col: str, text: str = "jobdescription", entities: str = "namedentity", parser: Parser | None = None, classifier: Classifier | None = None,
    most_distance: int = MOST_DISTANCE, confident: float = CONFIDENT,
) -> DataFrame:
    """(id, sentence_no, sentence, subject, relation, object, stage) of all layers: Rule, Syntax, Semantic.

    Without a parser or a classifier its layer finds nothing. A pair has one row at most. Null and
    blank texts, null arrays and single words give none; an empty table gives an empty result.
    """
    pairs = pairs_of_sentences(records, id_col, text, entities).where(F.col("gap") <= most_distance).withColumn("_k", rule_kind())
    result = _said(pairs.where(F.col("_k").isNotNull()), id_col, "Rule")
    left = open_pairs(pairs.where(F.col("_k").isNull()))
    if parser is not None:

        def parse(pdf: pd.DataFrame) -> list[tuple[str, bool] | None]:
            texts = list(dict.fromkeys(pdf["sentence"]))
            trees = dict(zip(texts, parser(texts), strict=True))
            return [syntax_kind(trees[s], (a - 1, a - 1 + len(x)), (b - 1, b - 1 + len(y))) for s, x, a, y, b in zip(pdf["sentence"], pdf["lw"], pdf["la"], pdf["rw"], pdf["ra"], strict=True)]

        seen = _asked(left, id_col, parse)
        result = result.unionByName(_said(seen.where(F.col("_k").isNotNull()), id_col, "Syntax"))
        left = seen.where(F.col("_k").isNull())
    if classifier is not None:

        def classify(pdf: pd.DataFrame) -> list[tuple[str, bool] | None]:
            said = classifier(list(zip(pdf["sentence"], pdf["lw"], pdf["rw"], strict=True)))
            return [LABELS[k] if p > confident and LABELS[k][0] is not None else None for k, p in said]  # type: ignore[misc]

        result = result.unionByName(_said(_asked(left, id_col, classify).where(F.col("_k").isNotNull()), id_col, "Semantic"))
    return result


def stage_counts(triples: DataFrame) -> DataFrame:
    """(stage, triples), Final being all of them."""
    return triples.select(F.explode(F.array("stage", F.lit("Final"))).alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("triples"))


def without_fences(reply: Column) -> Column:
    """A language model's reply without the marks of a code block around it."""
    return F.regexp_replace(F.replace(F.replace(reply, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")), r"(?U)^\s+|\s+$", "")


def read_triples(reply: Column) -> Column:
    """Array of (subject, relation, object) of a reply that is a JSON array of objects, else empty."""
    kind = "array<struct<subject:string,relation:string,object:string>>"
    found = F.from_json(without_fences(reply), kind)
    whole = F.filter(found, lambda t: t["subject"].isNotNull() & t["relation"].isNotNull() & t["object"].isNotNull())
    return F.coalesce(whole, F.array().cast(kind))


def asked_relations(records: DataFrame, model: Callable[[list[tuple[str, list[str]]]], list[str | None]], text: str = "jobdescription", entities: str = "namedentity") -> DataFrame:
    """Adds ``relations`` that a language model replies with, called with batches of (text, words).

    Records without a text or without entities aren't asked about and have an empty array, as
    have failed and unreadable replies. A column of this name is replaced.
    """
    rest = records.drop("relations", "_reply")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema), "_reply string"])
    asked = rest.withColumn("_reply", F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [[e["word"] for e in own if e["word"]] if own is not None else [] for own in pdf[entities]]
            full = [k for k, (t, w) in enumerate(zip(pdf[text], words, strict=True)) if isinstance(t, str) and t and w]
            replies: list[str | None] = [None] * len(pdf)
            if full:
                for k, reply in zip(full, model([(pdf[text].iloc[k], words[k]) for k in full]), strict=True):
                    replies[k] = reply
            yield pdf.assign(_reply=replies)

    return asked.mapInPandas(run, schema).withColumn("relations", read_triples(F.col("_reply"))).drop("_reply")
