"""Pay in several units and scales, brought to yuan per month.

The unit comes from the field, else from the other bound, else from the end of the
description, else from what the source says of itself. Bare numbers that have none of these
go to a calibrated tree ensemble, which learns from bare numbers whose unit is known; what it
isn't sure of goes to review instead of the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.functions.forest import Forest
from talentweave.functions.pay import Unit, complete, monthly_yuan, note_unit, read_pay, source_unit

#: Rows of the training sample, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 6000
#: Confidence from which a predicted unit counts.
CONFIDENT = 0.95
#: Source notes at most; they travel with the tasks.
MOST_NOTES = 100_000
CLASSES = [Unit(s, p) for s in ("yuan", "k", "wan") for p in ("month", "year", "day", "hour")]
SCHEMA = "id bigint, bound string, amount double, scale string, period string, origin string, confidence double, monthly_yuan bigint"
_NONE = Unit(None, None)


def _features(amount: Decimal, other: Decimal | None, source: int, level: float, listed: bool) -> list[float]:
    """Magnitude, the other bound, roundness, source, the category's usual pay, and whether the site gave an id."""
    a, b = float(amount), float(other) if other else 0.0
    return [
        math.log10(a), math.log10(b) if b > 0 else -1.0, math.log10(a / b) if b > 0 else 0.0, float(amount != amount.to_integral_value()),
        float(a % 1000 == 0), float(a % 10 == 0), float(source), level, float(listed),
    ]


class Levels:
    """What categories usually pay: the mean logarithm of yuan a month of the sample's amounts with a known
    unit, drawn to the mean of all by as many as ``weight`` amounts; that for unknown categories."""

    def __init__(self, known: list[tuple[str | None, int]], weight: float = 20.0) -> None:
        logs = [math.log10(max(1, yuan)) for _, yuan in known]
        self.all = sum(logs) / len(logs) if logs else 0.0
        sums: dict[str | None, list[float]] = {}
        for (category, _), value in zip(known, logs, strict=True):
            own = sums.setdefault(category, [0.0, 0.0])
            own[0], own[1] = own[0] + value, own[1] + 1
        self.of = {c: (total + weight * self.all) / (n + weight) for c, (total, n) in sums.items()}

    def __call__(self, category: str | None) -> float:
        return self.of.get(category, self.all)


def _bounds(low: str | None, high: str | None, tail: str | None, note: Unit) -> list[tuple[str, Decimal, Decimal | None, Unit | None, str]]:
    """Of each readable bound above 0: name, amount, the other's amount, unit and its origin."""
    (a, ua), (b, ub) = read_pay(low), read_pay(high)
    found = []
    for name, amount, own, other_amount, other in (("min", a, ua, b, ub), ("max", b, ub, a, ua)):
        if amount is None or amount <= 0:
            continue
        for unit, origin in ((own, "field"), (other, "other bound"), (None, "description"), (note, "source")):
            if unit is None:
                unit = note_unit(tail)
            if full := complete(unit, amount):
                found.append((name, amount, other_amount, full, origin))
                break
        else:
            found.append((name, amount, other_amount, None, "none"))
    return found


def train_units(rows: list[Any], notes: dict[str, Unit], codes: dict[str, int]) -> tuple[Forest, Levels] | None:
    """Ensemble from sampled rows (id, low, high, tail, source, category, listed): bare amounts whose unit is
    known, and the categories' levels.

    Every amount is shown with its source and without it, as the rows in question lack it. All rows of a
    posting lie on one side of the split that calibrates the confidence.
    """
    seen = []
    for key, low, high, tail, source, category, listed in rows:
        for _, amount, other, unit, origin in _bounds(low, high, tail, notes.get(source, _NONE)):
            if unit is not None and unit in CLASSES:
                seen.append((key, amount, other, unit, origin, source, category, listed))
    levels = Levels([(s[6], monthly_yuan(s[1], s[3])) for s in seen])
    x, y, groups = [], [], []
    for key, amount, other, unit, origin, source, category, listed in seen:
        if origin != "field":
            for code in (codes.get(source, -1), -1):
                x.append(_features(amount, other, code, levels(category), listed))
                y.append(CLASSES.index(unit))
                groups.append(key)
    if len(y) < 40:
        return None
    return Forest().fit(np.array(x), np.array(y), len(CLASSES), np.array(groups)), levels


def last_clause(text: str) -> Column:
    """The last clause of a text column, of any length: what stands behind the last line break, full stop or
    semicolon, closing marks left out."""
    clause = F.expr(f"rtrim(' .。\n\r\t', `{text}`)")
    for mark in ("\n", "。", ";", "；", ". "):
        clause = F.substring_index(clause, mark, -1)
    return clause


def to_monthly(
    df: DataFrame, notes: DataFrame, id_col: str, low: str, high: str, description: str, source: str, category: str, listing: str,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row for each bound with a readable amount above 0.

    ``origin`` says where the unit comes from: field, other bound, description, source,
    model, or none (no model could be fitted). ``confidence`` is 1 for written units.
    Unreadable, zero, blank and null fields give no row; repeated ids give rows each; an empty
    table gives an empty result; other columns are dropped. A source noted twice takes the
    note that comes first by text.
    """
    said = notes.where(F.col("source").isNotNull()).groupBy("source").agg(F.min("note_text").alias("note_text")).limit(MOST_NOTES + 1).collect()
    if len(said) > MOST_NOTES:
        raise ValueError(f"more than {MOST_NOTES} source notes")
    units = {r["source"]: source_unit(r["note_text"]) for r in said}
    codes = {s: k for k, s in enumerate(sorted(units))}
    part = df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(low).cast("string").alias("low"), F.col(high).cast("string").alias("high"),
        last_clause(description).alias("tail"), F.col(source).alias("source"), F.col(category).alias("category"), F.col(listing).isNotNull().alias("listed"),
    )
    # A cut of the hash that lets through half as many rows again, so that a task sends few.
    share = min(1.0, 1.5 * sample_rows / max(1, df.count()))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = part.where(drawn).orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    trained = train_units([tuple(r) for r in sample], units, codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[Any]] = []
            x, spots = [], []
            for key, a, b, tail, src, cat, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for name, amount, other, unit, origin in _bounds(a, b, tail, units.get(src, _NONE)):
                    row = [key, name, float(amount), *(unit or _NONE), origin, 1.0 if unit else 0.0, monthly_yuan(amount, unit) if unit else None]
                    if unit is None and trained is not None:
                        x.append(_features(amount, other, codes.get(src, -1), trained[1](cat), listed))
                        spots.append((len(out), amount))
                    out.append(row)
            if x and trained is not None:
                for (k, amount), c, p in zip(spots, *trained[0].predict(np.array(x)), strict=True):
                    out[k][3:] = [*CLASSES[c], "model", float(p), monthly_yuan(amount, CLASSES[c])]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(8)]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return part.mapInArrow(run, SCHEMA)
