"""Pay as typed by people: amounts, units and periods read from short texts."""

from __future__ import annotations

import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from typing import NamedTuple

# Periods in months, a working month has 21.75 days of 8 hours, a year 12 months.
MONTHS = {"month": (Decimal(1), Decimal(1)), "year": (Decimal(1), Decimal(12)), "day": (Decimal("21.75"), Decimal(1)), "hour": (Decimal(174), Decimal(1))}
SCALES = {"yuan": 1, "k": 1000, "wan": 10000}
_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
_POWERS = {"十": 10, "百": 100, "千": 1000}

_NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?")
_HANZI = re.compile("[零〇一二两三四五六七八九十百千万]+")
_YEAR = re.compile(r"年|/\s*(?:y|yr|year|annum)|per\s*year|annual")
_HOUR = re.compile(r"时|小时|/\s*h|per\s*hour|hourly")
_DAY = re.compile(r"日|天|/\s*d|per\s*day|daily")
_MONTH = re.compile(r"月|/\s*m|per\s*month|monthly")
_WAN = re.compile(r"万|w")
_THOUSAND = re.compile(r"千|k")
_YUAN = re.compile(r"元|块|圆|rmb|cny|￥|¥")
_EXTRA = re.compile(r"[·*x×,]?\s*\d+\s*薪")
_PAY_NOTE = re.compile("薪|报酬|待遇|酬劳|工资|所列金额")
_UNIT_NOTE = re.compile("单位|元计|万计|计[，,：:]|为[年月日时]薪|[（(]万?元[）)]|元/|万/|千/|k/")


class Unit(NamedTuple):
    """scale is None where only a period is written, period None where only a scale is."""

    scale: str | None
    period: str | None


def _hanzi_number(text: str) -> Decimal | None:
    """三十五, 一万五 (15000), 六千. None if it isn't one."""
    wan, _, low = text.partition("万")
    if "万" not in text:
        low, wan = text, ""

    def below(part: str) -> int | None:
        total, digit, power = 0, 0, 0
        for char in part:
            if char in _DIGITS:
                digit = _DIGITS[char]
            elif char in _POWERS:
                power = _POWERS[char]
                total += (digit or 1) * power
                digit = 0
            else:
                return None
        return total + (digit * power // 10 if power >= 100 and len(part) > 2 and part[-2] in _POWERS else digit)

    high, rest = below(wan) if wan else (1 if "万" in text else 0), below(low) if low else 0
    if high is None or rest is None:
        return None
    if "万" in text and len(low) == 1 and low in _DIGITS:
        rest *= 1000
    return Decimal(high * 10000 + rest)


def unit_of(text: str) -> Unit:
    """Scale and period written in a folded text."""
    period = "year" if _YEAR.search(text) else "hour" if _HOUR.search(text) else "day" if _DAY.search(text) else "month" if _MONTH.search(text) else None
    scale = "wan" if _WAN.search(text) else "k" if _THOUSAND.search(text) else "yuan" if _YUAN.search(text) else None
    return Unit(scale, period)


def read_pay(text: str | None) -> tuple[Decimal | None, Unit]:
    """Amount and written unit of a pay field; (None, no unit) where nothing can be read.

    Extra monthly salaries (14薪) are left out, width and case don't matter, thousands
    separators are taken off. Of two amounts in one field the first counts.
    """
    nothing = None, Unit(None, None)
    if text is None or not text.strip():
        return nothing
    folded = _EXTRA.sub("", unicodedata.normalize("NFKC", text).lower().strip())
    if found := _NUMBER.search(folded):
        try:
            amount = Decimal(found[0].replace(",", ""))
        except InvalidOperation:
            return nothing
        rest = folded[: found.start()] + folded[found.end() :]
        return amount, unit_of(rest)
    if found := _HANZI.search(folded):
        amount = _hanzi_number(found[0])
        if amount is None or not any(c in _DIGITS for c in found[0]):
            return nothing
        rest = folded[: found.start()] + folded[found.end() :]
        unit = unit_of(rest)
        if unit.scale is None and any(c in "千万" for c in found[0]):
            unit = Unit("yuan", unit.period)
        return amount, unit
    return nothing


def note_unit(text: str | None) -> Unit:
    """Unit stated in the last clause of a description, whatever its length, if that clause speaks of
    pay units."""
    if not text:
        return Unit(None, None)
    tail = unicodedata.normalize("NFKC", text).lower().rstrip(" .。\n\r\t")
    clause = re.split(r"[\n。;]|\.\s", tail)[-1]
    if _PAY_NOTE.search(clause) and _UNIT_NOTE.search(clause):
        unit = unit_of(clause)
        if unit.scale or unit.period:
            return unit
    return Unit(None, None)


def source_unit(text: str | None) -> Unit:
    """Unit that a site's note gives for its bare numbers."""
    if not text:
        return Unit(None, None)
    return unit_of(unicodedata.normalize("NFKC", text).lower())


def complete(unit: Unit, amount: Decimal) -> Unit | None:
    """A unit of account without a period is per month; a period without one is in yuan,
    but bare yearly figures under 1000 are ten thousands. None if nothing is written."""
    if unit.scale is None and unit.period is None:
        return None
    period = unit.period or "month"
    scale = unit.scale or ("wan" if period == "year" and amount < 1000 else "yuan")
    return Unit(scale, period)


def monthly_yuan(amount: Decimal, unit: Unit) -> int:
    """Yuan per month, rounded half up to whole yuan."""
    times, parts = MONTHS[unit.period or "month"]
    return int((amount * SCALES[unit.scale or "yuan"] * times / parts).quantize(Decimal(1), ROUND_HALF_UP))
