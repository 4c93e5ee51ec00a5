"""Normal forms of the fields of a posting, as column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentweave.dictionaries import BENEFITS, CITIES, DEGREES, INDUSTRIES, LEGAL_ENDINGS, SKILLS
from talentweave.functions.text import lookup_key, normalize_text


def _alias(key: Column, entries: dict[str, list[str]], fold: bool = True) -> Column:
    """Canonical form of the first entry that has the key, else null: one literal map, no join."""
    pairs: dict[str, str] = {}
    for canonical, aliases in entries.items():
        for name in (canonical, *aliases):
            pairs.setdefault(_fold(name), canonical)
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.try_element_at(table, key)


def _fold(name: str) -> str:
    from talentweave.dictionaries import PLAIN, PUNCTUATION

    return name.translate(str.maketrans(PUNCTUATION, PLAIN)).lower()


def city(text: Column) -> Column:
    """Alias, else the first entry named within the text, else the first piece."""
    clean, key = normalize_text(text), lookup_key(text)
    within = reduce(lambda c, e: c.when(reduce(lambda a, b: a | b, [F.contains(key, F.lit(_fold(n))) for n in (e[0], *e[1])]), e[0]), list(CITIES.items())[1:],
                    F.when(reduce(lambda a, b: a | b, [F.contains(key, F.lit(_fold(n))) for n in ("北京", *CITIES["北京"])]), "北京"))
    pieces = F.filter(F.transform(F.split(clean, r"[/,;|\-]"), F.trim), lambda x: x != "")
    return F.coalesce(_alias(key, CITIES), within, F.try_element_at(pieces, F.lit(1)), clean)


def company(text: Column) -> Column:
    """Without one legal ending; a name that is nothing else stays."""
    clean = F.regexp_replace(F.regexp_replace(normalize_text(text), r"\(\s*", "("), r"\s*\)", ")")
    bare = F.trim(F.regexp_replace(clean, "(" + "|".join(LEGAL_ENDINGS) + ")$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), clean)


def industry(text: Column) -> Column:
    clean = F.translate(normalize_text(text), ",", "/")
    return F.coalesce(_alias(F.lower(clean), INDUSTRIES), clean)


def benefit(text: Column) -> Column:
    """Canonical benefit, null if unknown."""
    return _alias(lookup_key(text), BENEFITS)


def skill(token: Column) -> Column:
    """Canonical skill, null if unknown."""
    return _alias(lookup_key(token), SKILLS)


def degree(text: Column) -> Column:
    """Highest degree named, 不限 for nothing or no requirement, else the text itself."""
    clean = normalize_text(text)
    named = F.when(clean.isin("", "无要求", "不限"), "不限")
    for name in sorted((d for d in DEGREES if DEGREES[d]), key=lambda d: -DEGREES[d]):
        named = named.when(F.contains(clean, F.lit(name)), name)
    return named.otherwise(clean)


def experience(text: Column) -> Column:
    clean = normalize_text(text)
    named = F.when(clean.isin("", "无经验", "不限"), "不限").when(F.contains(clean, F.lit("应届")) | F.contains(clean, F.lit("在校")), "应届/在校")
    return named.otherwise(F.replace(clean, F.lit("年以上"), F.lit("+年")))


def least_years(text: Column) -> Column:
    """Lower bound of an experience in years, 0 if none is named."""
    named = experience(text)
    span = F.regexp_extract(named, r"(\d+)\s*[-~]\s*(\d+)", 1)
    plus = F.regexp_extract(named, r"(\d+)\+?年", 1)
    found = F.coalesce(F.nullif(span, F.lit("")), F.nullif(plus, F.lit(""))).try_cast("int")
    return F.when(named.isin("不限", "应届/在校"), 0).otherwise(F.coalesce(found, F.lit(0)))


def degree_rank(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DEGREES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit(0))
