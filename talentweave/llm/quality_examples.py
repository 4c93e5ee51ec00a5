"""Inspected examples of each kind of text, after which the mixture's components are named.

Written for this purpose; several per kind, in both languages and in different lengths.
"""

from __future__ import annotations

import random

_R = random.Random(5)

# Words of which the examples are made.
_ITEMS = "单元测试 接口设计 报表开发 数据标注 Python Linux 客户回访 年度旅游 餐补 仓库盘点 质量巡检 Docker 交通补贴 视觉检测 样本清洗 日志分析 语音合成 Redis 设备保养 Kafka".split()
_ENGLISH_ITEMS = "unit tests|report design|Python|sample cleaning|Linux|warehouse audit|model tuning|Docker|travel allowance|speech corpus|log parser|Kafka".split("|")
_ROLES = "测试工程师 产品经理 运维工程师 数据分析师 嵌入式工程师 算法研究员 前端开发 客服主管".split()
_CITIES = "北京 上海 成都 武汉 厦门 苏州 长沙 青岛".split()
_SENTENCES = [
    "上个月，项目组把旧的排班表换成了新系统，大家都说录入比以前快了很多。", "不过现场的同事认为，如果网络不稳定，这套流程未必能够坚持到年底。", "为了减少返工，质检员和班长一起花了三天时间核对每一批样本。",
    "候选人问：“这个岗位平时需要出差吗？”面试官回答说一年大约两次。", "因此，部门决定先在一个站点试运行，等数据齐全以后再推广到其他地区。", "这份报告主要说明了模型上线以后的效果，也记录了几次没有成功的尝试。",
    "去年秋天，实习生提到仓库的编号规则已经没有人记得是谁定下来的。", "我们希望新来的同事能够自己阅读代码，并且愿意把经验写成文档。", "换句话说，只要接口的定义不变，两个小组就可以分别修改自己的部分。", "会议结束之前，经理又强调了一次合同的期限，要求大家按时提交材料。",
]
_ENGLISH = [
    "Last year the team moved its planning sheet to a new tool, and most people found that the change saved them an hour a day.", "If the network is slow, we may not be able to keep the promise that was made to the client.",
    "The person in this role will review the reports of two teams and write down what could be done better.", "\"How often do we travel?\" asked one candidate; the manager said that it was about twice a year.", "Before the rainy season, the engineers had already replaced the oldest machines in the hall.",
    "It was not clear who had written the first version of the rules, but nobody wanted to change them.", "In the end, the pilot was extended by a month so that the auditors could see all of the data.", "To reduce the number of errors, the trainee asked us to check every sample by hand.",
]
_PAGE = "登录 注册 首页 上一页 下一页 返回顶部 版权说明 收藏 分享 投递 关闭".split()
_ENGLISH_PAGE = "Login Home Share Next Menu Terms Back Close Apply".split()


def _some(words: list[str], n: int) -> list[str]:
    return [_R.choice(words) for _ in range(n)]


def _prose(source: list[str], n: int, between: str = "") -> str:
    return between.join(_some(source, n))


def _record() -> list[str]:
    return [_R.choice(_CITIES), _R.choice(_ROLES), f"{_R.randint(8, 60)}k", f"203{_R.randint(0, 3)}-0{_R.randint(1, 9)}-1{_R.randint(0, 9)}", f"{_R.randint(1, 99)}"]


_HEAD = ["城市", "岗位", "月薪", "截止", "人数"]


def _rows(n: int, width: int = 5) -> list[list[str]]:
    return [_HEAD[:width], *(_record()[:width] for _ in range(n))]


def _grid(rows: list[list[str]]) -> str:
    bar = "+" + "+".join("-" * 12 for _ in rows[0]) + "+"
    return "\n".join(x for r in rows for x in (bar, "|" + "|".join(c.center(12) for c in r) + "|")) + "\n" + bar


_SIZES = (4, 8, 15, 40)
_MARKERS = ["* {}", "- {}", "• {}", "{k}. {}", "（{k}）{}；", "[ ] {}", "a) {}", "<li>{}</li>", "\t→ {}", "{k}、{}", "* {}。"]


def _list(marker: str, words: list[str], n: int, heading: str = "") -> str:
    return heading + "\n".join(marker.format(w, k=k + 1) for k, w in enumerate(_some(words, n)))


_SHUFFLED = ["".join(_R.sample(t, len(t))) for t in (_prose(_SENTENCES, k) for k in (2, 4, 8, 12))]
_SHUFFLED_EN = ["".join(_R.sample(t, len(t))) for t in (_prose(_ENGLISH, k, " ") for k in (2, 4, 8))]
_SYMBOLS = "★%]!</{+*>}●|?=~^_[#@$◆■·&"
_ASCII = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789%@;><()#\"_+/="

_RANDOM = ["".join(_some(list(_ASCII), n)) for n in (20, 60, 200, 500)]

EXAMPLES: list[tuple[str, list[str]]] = [
    ("prose", [_prose(_SENTENCES, n) for n in (1, 1, 2, 2, 3, 5, 8, 15)]),
    ("prose", [_prose(_SENTENCES, n, "\n") for n in (3, 5, 8, 15)] + ["岗位说明\n" + _prose(_SENTENCES, n, "\n\n") for n in (3, 6)]),
    ("prose", [_prose(_ENGLISH, n, " ") for n in (1, 2, 3, 5, 8, 15)]),
    ("prose", [_prose(_ENGLISH, n, "\n") for n in (3, 5, 8, 15)] + ["Notes on the vacancy\n" + _prose(_ENGLISH, n, "\n\n") for n in (3, 6)]),
    ("prose", [_prose(_SENTENCES, n).replace("。", "～") for n in (2, 5)] + [_prose(_SENTENCES, n).replace("。", " ").replace("，", " ") for n in (3, 6)]),
    ("prose", [_prose(_SENTENCES, 5, "\n") + "\n" + _list("- {}", _ITEMS, 3) + "\n" + _prose(_SENTENCES, 3) for _ in range(4)]),
    ("prose", [a + s + b for n in (2, 4, 7) for s in ("", "\n") for a, b in ((_prose(_SENTENCES, n), _prose(_ENGLISH, n, " ")), (_prose(_ENGLISH, n, " "), _prose(_SENTENCES, n)), ("<p>" + _prose(_SENTENCES, n) + "</p>", "<p>" + _prose(_ENGLISH, n, " ") + "</p>"))]),
    ("prose", ["<p>" + _prose(_SENTENCES, n, "</p><p>") + "</p>" for n in (3, 6)] + ["<p>" + _prose(s, n) + "</p><p>" + _prose(s, n) + "</p>" for s in (_SENTENCES, _ENGLISH) for n in (2, 3, 5)]),
    ("list", [_list(m, _ITEMS, n) for m in _MARKERS for n in _SIZES]),
    ("list", [_list(m, _ENGLISH_ITEMS, n) for m in _MARKERS for n in _SIZES]),
    ("list", [_list(m, _ITEMS, n, "任职条件\n") for m in _MARKERS for n in _SIZES]),
    ("list", [_list("{}", w, n, h) for w in (_ITEMS, _ROLES) for n in _SIZES for h in ("", "开放方向：\n")]),
    ("list", [_list("{}", _ENGLISH_ITEMS, n, h) for n in _SIZES for h in ("", "Requirements\n")]),
    ("list", [_list("* 负责{}，覆盖三个站点，缩短等待时间。", _ITEMS, n) for n in _SIZES] + [_list("{k}、参与{}的日常维护；", _ITEMS, n) for n in _SIZES]),
    ("list", [_list("{}", w, n, h) for w in (_ITEMS, _ROLES, _ENGLISH_ITEMS) for n in (60, 120) for h in ("", "开放方向：\n")]),
    ("list", [_list(m, _ITEMS, n, h) for m in ("面向门店与仓库，负责{}，缩短一线同事的等待时间", "协助完成{}，覆盖三个站点，理顺客户的交接缺口") for n in _SIZES for h in ("", "任职条件\n")]),
    ("table", ["\n".join(",".join(r) for r in _rows(n, w)) for n in _SIZES for w in (3, 5)]),
    ("table", ["\n".join(";".join(f'"{c}"' for c in r) for r in _rows(n, w)) for n in _SIZES for w in (3, 5)]),
    ("table", ["\n".join("\t".join(r) for r in _rows(n, w)) for n in _SIZES for w in (3, 5)]),
    ("table", ["\n".join("| " + " | ".join(r) + " |" for r in _rows(n, w)) for n in _SIZES for w in (3, 5)]),
    ("table", [_grid(_rows(n, w)) for n in _SIZES for w in (3, 5)]),
    ("table", ["<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in _rows(n, w)) + "</table>" for n in _SIZES for w in (3, 5)]),
    ("table", ["\n".join("".join(c.ljust(18) for c in r).rstrip() for r in _rows(n, w)) for n in _SIZES for w in (3, 5)]),
    ("table", ["\n".join(" ".join(f"{h}：{c}" for h, c in zip(_HEAD, r, strict=True)) for r in _rows(n)[1:]) for n in _SIZES]),
    ("junk", [s.join(_some(_PAGE, n)) for n in (8, 20, 50) for s in (" ", " > ", " | ", "\n")]),
    ("junk", [s.join(_some(_ENGLISH_PAGE, n)) for n in (8, 20, 50) for s in (" ", " > ", " | ", "\n")]),
    ("junk", ["&nbsp;".join(f'<div class="c{_R.randint(1, 99)}"></div>' + "{{v" + str(_R.randint(1, 9)) + "}}" for _ in range(n)) for n in (4, 10, 40)]),
    ("junk", [_R.choice(_SENTENCES) * n for n in (8, 20, 60)] + ["\n".join([_R.choice(_SENTENCES)] * n) for n in (8, 20, 60)]),
    ("junk", [(_R.choice(_ENGLISH) + s) * n for n in (6, 12, 40) for s in ("", " ", "\n")]),
    ("junk", [_prose(_SENTENCES, n).encode().decode("latin-1") for n in (1, 3, 8)]),
    ("junk", ["�".join(_prose(_ENGLISH, n, " ")) for n in (1, 3, 8)] + ["�".join(_prose(_SENTENCES, n)) for n in (1, 3, 8)]),
    ("junk", ["".join(_R.choice(_SYMBOLS) * _R.randint(1, 4) for _ in range(n)) for n in (20, 60, 150)]),
    ("junk", _RANDOM),
    ("junk", [s.join(_some(["高薪", "急招", "云原生", "Scala", "包住"], n)) for n in (20, 60, 150) for s in (" ", "")] + [" ".join(_some(["urgent", "hiring", "pay", "Scala"], n)) for n in (20, 60, 150)]),
    ("junk", [" ".join(str(_R.randint(0, 10 ** _R.randint(1, 12))) for _ in range(n)) for n in (12, 30, 80)]),
    ("junk", ["loading...", "见附件", "点击查看", "404 not found", "页面不存在", "……", "。", "-", "undefined", "null", "暂无内容", "加载中"]),
    ("junk", _SHUFFLED),
    ("junk", _SHUFFLED_EN),
]

#: Numbers of the groups whose neighbouring letters no corpus knows.
UNFAMILIAR = {k for k, (_, texts) in enumerate(EXAMPLES) if texts is _SHUFFLED or texts is _SHUFFLED_EN or "\x80" in "".join(texts) or any(texts[0] == t for t in _RANDOM)}
