from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from talentweave.functions import normalize as N
from talentweave.functions.salary_texts import liepin, qiancheng, zhaopin
from talentweave.functions.text import ned_key, normalize_text, safe_salary

CASES = [
    (N.city, "上海市", "上海"), (N.city, "上海-浦东新区", "上海"), (N.city, "远程", "远程办公"), (N.city, "苏州-园区", "苏州"), (N.city, None, ""),
    (N.company, "前锦网络信息技术（上海）有限公司", "前锦网络信息技术(上海)"), (N.company, "美团", "美团"), (N.company, "有限公司", "有限公司"),
    (N.industry, "电子技术/半导体/集成电路", "电子/半导体/集成电路"), (N.industry, "通信/电信运营、增值服务", "通信/电信"),
    (N.benefit, "年终奖", "年终奖金"), (N.benefit, "双休", "周末双休"), (N.benefit, "无此福利", None), (N.skill, "pytorch", "PyTorch"), (N.skill, "ml", "机器学习"), (N.skill, "unknown", None),
    (N.degree, "博士/硕士", "博士"), (N.degree, None, "不限"), (N.degree, "统招本科", "本科"), (N.experience, "5年以上", "5+年"), (N.experience, "在校生", "应届/在校"),
    (N.least_years, "3-5年", 3), (N.least_years, "5年以上", 5), (N.least_years, "应届", 0), (N.least_years, "1年以下", 1), (N.least_years, None, 0),
    (normalize_text, "　Ａ　b（c） ", "Ａ b(c)"), (normalize_text, None, ""), (safe_salary, "12.9", 12), (safe_salary, "abc", 0), (safe_salary, "", 0), (safe_salary, None, 0), (safe_salary, "-3.7", -3),
    (ned_key, " A/B  c ", "a b c"),
    (lambda c: F.array(*qiancheng(c)), "15-20K", [15, 20]), (lambda c: F.array(*qiancheng(c)), "面议", [0, 0]), (lambda c: F.array(*qiancheng(c)), "1.5-2万", [20, 50]),
    (lambda c: F.array(*liepin(c)), "20-40k·14薪", [20, 40]), (lambda c: F.array(*liepin(c)), "30-50万", [25, 41]), (lambda c: F.array(*zhaopin(c)), "1-2万", [10, 20]),
    (lambda c: F.array(*zhaopin(c)), "15k-30k", [0, 0]), (lambda c: F.array(*zhaopin(c)), None, [0, 0]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_scalar(spark, k):
    function, given, expected = CASES[k]
    assert spark.createDataFrame([(given,)], "x string").select(function(F.col("x"))).first()[0] == expected
