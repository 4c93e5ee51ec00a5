"""Column functions on text, and keys made of it. Null counts as the empty text where said so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentweave.dictionaries import PLAIN, PUNCTUATION


def normalize_text(text: Column) -> Column:
    """Punctuation folded to half width, runs of blanks of any kind to one, outer blanks off; null is empty."""
    folded = F.translate(F.coalesce(text, F.lit("")), PUNCTUATION, PLAIN)
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def lookup_key(text: Column) -> Column:
    return F.lower(normalize_text(text))


def safe_salary(text: Column) -> Column:
    """Whole part of a number written as text, towards 0; 0 for anything else."""
    return F.coalesce(text.try_cast("double").try_cast("int"), F.lit(0))


def salary_mid(low: Column, high: Column) -> Column:
    return F.when(high != 0, F.round((low + high) / 2, 1)).otherwise(low.cast("double"))


def node_id(label: Column, name: Column) -> Column:
    return F.concat(F.lower(label), F.lit(":"), F.substring(F.md5(F.concat(label, F.lit(":"), name)), 1, 12))


def stable_job_id(given: Column, title: Column, company: Column, city: Column) -> Column:
    """The source's own id, else a hash of title, company and city."""
    own = F.trim(F.regexp_replace(F.coalesce(given, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.nullif(own, F.lit("")), F.md5(F.concat_ws("|", title, company, city)))


def dedup_key(title: Column, company: Column) -> Column:
    def squeeze(c: Column) -> Column:
        return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))

    return F.md5(F.concat(squeeze(title), F.lit("|"), squeeze(company)))


def ned_key(word: Column) -> Column:
    """Key under which entity words are compared: lower case, / as a blank, blanks folded."""
    trimmed = F.regexp_replace(F.lower(word), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.replace(trimmed, F.lit("/"), F.lit(" ")), r"(?U)\s+", " ")
