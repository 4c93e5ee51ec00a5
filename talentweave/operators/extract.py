"""Skills, benefits and keywords of a posting, from its tags, title and description."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.dictionaries import NER_DUTY_VERBS, NER_EDUCATION, NER_MAJORS, NER_SKILLS, SKILLS, STOP_KEYWORDS
from talentweave.functions.normalize import _fold, benefit, skill
from talentweave.functions.text import normalize_text


def split_tags(tags: Column) -> Column:
    """Tokens between commas, slashes, bars and semicolons, without blank ones."""
    return F.filter(F.transform(F.split(normalize_text(tags), "[,，/|、;；]+"), normalize_text), lambda x: x != "")


def named_within(content: Column, alias: str) -> Column:
    """Whether a lower-case text names an alias; Latin ones must not touch letters or digits."""
    key = _fold(alias)
    if re.search("[a-z0-9+#]", key):
        edged = F.rlike(content, F.lit(r"(?<![a-z0-9+#])\Q" + key + r"\E(?![a-z0-9+#])"))
        return F.contains(content, F.lit(key)) & edged
    return F.contains(content, F.lit(key))


def scanned_skills(content: Column) -> Column:
    """Canonical skills named in a lower-case text, one projection without a UDF."""
    found = [F.when(reduce(lambda a, b: a | b, [named_within(content, a) for a in dict.fromkeys((name, *aliases))]), name) for name, aliases in SKILLS.items()]
    return F.array_compact(F.array(*found))


def extraction(df: DataFrame, title: str, tags: str, description: str) -> DataFrame:
    """Adds skills, benefits, keywords and raw_tags: sorted, each once.

    In steps, so that a text is folded and a tag looked up once a row, not once for each alias.
    Null fields hold nothing; columns of these names are replaced.
    """
    content = F.lower(F.concat_ws(" ", normalize_text(F.col(title)), normalize_text(F.col(description))))
    step = df.withColumns({"_tokens": split_tags(F.col(tags)), "_content": content})
    read = F.transform("_tokens", lambda t: F.struct(t.alias("t"), skill(t).alias("s"), benefit(t).alias("b")))
    step = step.withColumns({"_read": read, "_scanned": scanned_skills(F.col("_content"))})
    others = F.filter("_read", lambda r: r["s"].isNull())
    keywords = F.filter(others, lambda r: r["b"].isNull() & ~r["t"].isin(STOP_KEYWORDS) & (F.length(r["t"]) > 1) & (F.length(r["t"]) <= 20))
    tagged = F.array_compact(F.transform("_read", lambda r: r["s"]))
    return step.withColumns({
        "skills": F.array_sort(F.array_union(tagged, F.col("_scanned"))),
        "benefits": F.array_sort(F.array_distinct(F.array_compact(F.transform(others, lambda r: r["b"])))),
        "keywords": F.array_sort(F.array_distinct(F.transform(keywords, lambda r: r["t"]))),
        "raw_tags": F.array_sort(F.array_distinct("_tokens")),
    }).drop("_tokens", "_content", "_read", "_scanned")


def _led_by(verb: str) -> Callable[[Column], Column]:
    def join(rest: Column) -> Column:
        return F.concat(F.lit(verb), F.trim(rest))

    return join


def rule_entities(text: Column) -> Column:
    """Array of (entity, word) that the word lists and patterns find in a description, each once, in
    the order of the lists. Blank and null texts have none."""
    edge = "[a-zA-Z一-鿿]"
    low = F.lower(text)
    skills = [F.when(F.contains(low, F.lit(p.replace("\\", "").lower())) & F.rlike(text, F.lit(f"(?i)(?<!{edge}){p}(?!{edge})")), F.struct(F.lit("SKILL").alias("entity"), F.lit(p).alias("word"))) for p in NER_SKILLS]
    education = [F.when(F.contains(text, F.lit(w)), F.struct(F.lit("EDUCATION").alias("entity"), F.lit(w).alias("word"))) for w in NER_EDUCATION]
    majors = [F.when(F.contains(text, F.lit(w)), F.struct(F.lit("MAJOR").alias("entity"), F.lit(w).alias("word"))) for w in NER_MAJORS]
    duties = [F.transform(F.regexp_extract_all(text, F.lit(verb + r"([^。\n；;]+)"), 1), _led_by(verb)) for verb in NER_DUTY_VERBS]
    named = F.array_compact(F.array(*skills, *education, *majors))
    done = F.transform(F.filter(F.flatten(F.array(*duties)), lambda d: F.length(d) > 3), lambda d: F.struct(F.lit("DUTY").alias("entity"), d.alias("word")))
    return F.when(F.rlike(text, F.lit(r"(?U)\S")), F.array_distinct(F.concat(named, done)))


def listed_entities(text: Column, words: list[str], entity: str) -> Column:
    """Array of (entity, word) of the listed words that a text holds, letter by letter; null texts have none."""
    kind = "array<struct<entity:string,word:string>>"
    found = F.filter(F.array(*map(F.lit, words)) if words else F.array().cast("array<string>"), lambda w: F.contains(F.coalesce(text, F.lit("")), w))
    return F.transform(found, lambda w: F.struct(F.lit(entity).alias("entity"), w.alias("word"))).cast(kind)


def valid_entities(entities: Column) -> Column:
    """Array of (entity, word) without blanks in the words, each once, the first one; words of fewer than two
    characters or without letters and digits leave. A null array stays null."""
    clean = F.transform(entities, lambda e: F.struct(e["entity"].alias("entity"), F.replace(e["word"], F.lit(" "), F.lit("")).alias("word")))
    good = F.filter(clean, lambda e: F.rlike(e["word"], F.lit(r"(?U)\S")) & (F.length(e["word"]) >= 2) & ~F.rlike(e["word"], F.lit(r"(?U)^[\W_]+$")))
    return F.array_distinct(good)
