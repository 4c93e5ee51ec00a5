"""Free-entered values mapped to a reference list: a trie walked by Levenshtein automata.

Every entry stands in the trie under its canonical spelling and under each alias. A value is
folded, tried as it is, then without remarks, then by its leading part; what still isn't an
entry goes through the automaton, which returns all entries within a distance that depends on
the length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.functions.hanzi import fold, is_hanzi

#: Entries of the reference list at most; the list travels with the tasks.
MOST_ENTRIES = 200_000
#: Distinct values that a task keeps its answers for.
MEMO = 200_000

# Remarks before and after a value, by field.
BEFORE = {
    "city_name": ["中国", "base", "坐标", "工作地点", "工作地", "地点", "现居", "位于"],
    "degree_name": ["全日制", "统招", "至少", "不低于", "最低", "要求", "学历", "需"],
    "skills": ["熟练使用", "熟练掌握", "熟练", "熟悉", "精通", "掌握", "了解", "擅长", "会用"],
}
AFTER = {
    "city_name": ["市", "附近", "周边", "地区", "可远程", "优先"],
    "degree_name": ["及以上学历", "以上学历", "及以上", "以上", "学历", "优先", "毕业", "学位", "文凭", "制", "双证"],
    "skills": ["优先", "技术", "相关", "编程", "方向", "经验", "必备", "基础", "框架"],
}
# Names that lie near an entry in spelling but mean something else.
OTHERS = {
    "city_name": (
        "nanning nanchong nanyang nanping jining jinzhou jinhua jincheng jinzhong jingzhou changzhi changde chengde chaozhou chuzhou huzhou xuzhou quzhou "
        "taizhou wenzhou quanzhou zhangzhou yangzhou binzhou cangzhou dezhou ganzhou hanzhong hezhou lanzhou liuzhou luzhou meizhou qinzhou suizhou wuzhou "
        "xinzhou yongzhou zhuzhou chenzhou dazhou bozhou guilin guigang guangan guangyuan huaian huanan huainan huaihua huanggang huangshan huangshi heyuan "
        "hefeng wuhu wuhai wuwei wuzhong xining xianyang xiangyang xiangtan xianning zhoushan zhongwei zhuzhi dandong dalimu datong fushun fuyang fuxin "
        "foshun leshan tangshan baoshan yushan anshan tongshan shenyan shaoyang shangrao shangqiu shanwei shantou qinhuangdao qingyang qingyuan kunshan "
        "changji changxing changshu ningde ningxia ningbao luoyang anyang deyang guyuan guiping tianshui tianmen chongzuo chongming zhengding haikou sanya"
    ).split(),
    "degree_name": [],
    "skills": "nosql sqlite scalar perl fortran cobol ruby rails lua julia dart swift spark storm hive hbase kudu keras caffe caffe2 angular svelte ansible tensorrt reactive juniper nomad".split(),
}
# Characters often written for one another, by sound or by shape.
CONFUSED = {
    "学": "孝刁", "本": "奔木", "专": "砖", "硕": "砚", "博": "搏", "科": "料", "士": "土", "高": "膏", "中": "忠", "大": "太", "识": "织", "型": "形", "模": "膜",
    "数": "素", "据": "距", "仓": "苍", "库": "苦", "器": "气", "机": "几", "觉": "决", "果": "过", "测": "侧", "试": "式", "化": "花", "系": "糸", "统": "桶",
}

_BRACKETS = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|【[^【】]*】|\{[^{}]*\}|<[^<>]*>")
_WHOLE = re.compile(r"^\s*(?:\((.*)\)|\[(.*)\]|【(.*)】)\s*$", re.S)
_PIECES = re.compile(r"[-/·,;|、，；\s]+")
_YEARS = re.compile(r"\d+年\+?(?:以上)?(?:经验)?$")
_NOISE = re.compile(r"[\W_]+")


def key_of(text: str) -> str:
    """Letters and digits of a folded text; + stays, and # behind a letter."""
    out = []
    for char in text:
        if char.isalnum() or (char == "+" and out) or (char == "#" and out):
            out.append(char)
    return "".join(out)


class Trie:
    """Terms with the numbers of their entries; search returns all within a distance."""

    def __init__(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.exact: dict[str, list[int]] = {}

    def add(self, term: str, ref: int) -> None:
        node = 0
        for char in term:
            if (step := self.children[node].get(char)) is None:
                step = len(self.children)
                self.children[node][char] = step
                self.children.append({})
                self.ends.append([])
            node = step
        if ref not in self.ends[node]:
            self.ends[node].append(ref)
            self.exact.setdefault(term, []).append(ref)

    def search(self, word: str, most: int) -> list[tuple[int, int, str]]:
        """(distance, entry, term) of every term within ``most`` edits; swapping two neighbours is
        one edit. The automaton's state is a row of the edit matrix; a branch ends as soon as
        the whole row exceeds ``most``."""
        first = list(range(len(word) + 1))
        found: list[tuple[int, int, str]] = []
        stack = [(node, char, first, None, "", char) for char, node in self.children[0].items()]
        while stack:
            node, char, above, before, last, term = stack.pop()
            row = [above[0] + 1]
            for k, own in enumerate(word, 1):
                cost = min(row[k - 1] + 1, above[k] + 1, above[k - 1] + (own != char))
                if before is not None and k > 1 and own == last and word[k - 2] == char:
                    cost = min(cost, before[k - 2] + 1)
                row.append(cost)
            if row[-1] <= most:
                found.extend((row[-1], ref, term) for ref in self.ends[node])
            if min(row) <= most or min(above) <= most:
                stack.extend((step, c, row, above, char, term + c) for c, step in self.children[node].items())
        return found


class Mapper:
    """Resolves values of one field."""

    def __init__(self, field: str, entries: Iterable[tuple[int, str, list[str] | None]]) -> None:
        self.field, self.trie = field, Trie()
        self.before, self.after = BEFORE.get(field, []), AFTER.get(field, [])
        self.others = frozenset(OTHERS.get(field, []))
        for ref, canonical, aliases in sorted(entries):
            for term in (canonical, *(aliases or [])):
                if term and (key := key_of(fold(term))):
                    self.trie.add(key, ref)
        self.leads = sorted((t for t in self.trie.exact if len(t) > 1 and all(map(is_hanzi, t))), key=lambda t: (-len(t), t)) if field == "city_name" else []
        self.memo: dict[str, int] = {}

    def limit(self, key: str, term: str) -> int:
        """Edits allowed between a value and a term, by the longer's length."""
        if any(map(is_hanzi, term)):
            return 0 if self.field == "city_name" or min(len(term), len(key)) < 2 else 1 if len(term) < 8 else 2
        longer = max(len(key), len(term))
        return 0 if longer < 5 else 1 if longer < 12 else 2

    def near(self, key: str) -> int:
        """Entry closest in edits, the likelier misspelling first, then the smaller number."""
        if key in self.others or len(key) < 2:
            return -1
        best: tuple[int, int, int] | None = None
        for distance, ref, term in self.trie.search(key, 2 if len(key) > 7 else 1):
            if distance <= self.limit(key, term):
                likely = len(key) == len(term) and any(a != b and b in CONFUSED.get(a, "") for a, b in zip(term, key, strict=True))
                rank = (distance, 0 if likely else 1, ref)
                best = rank if best is None else min(best, rank)
        return best[2] if best else -1

    def bare(self, key: str) -> str:
        """Key without remarks before and behind it."""
        again = True
        while again:
            again = False
            for mark in self.before:
                if key.startswith(mark) and len(key) > len(mark):
                    key, again = key[len(mark) :], True
            for mark in self.after:
                if key.endswith(mark) and len(key) > len(mark):
                    key, again = key[: -len(mark)], True
            if (cut := _YEARS.sub("", key)) != key and cut:
                key, again = cut, True
        return key

    def resolve(self, value: str) -> int:
        """Entry that a value means, -1 if none."""
        if (known := self.memo.get(value)) is None:
            known = self._resolve(value)
            if len(self.memo) < MEMO:
                self.memo[value] = known
        return known

    def _resolve(self, value: str) -> int:
        text = fold(value)
        if whole := _WHOLE.match(text):
            text = next(g for g in whole.groups() if g is not None)
        plain = _BRACKETS.sub(" ", text)
        keys = [key_of(text), key_of(plain)]
        keys += [self.bare(k) for k in keys]
        if self.field == "degree_name":
            keys += [k.replace("学历", "") for k in keys]
        pieces = [key_of(p) for p in _PIECES.split(plain) if p.strip()]
        lead = [self.bare(pieces[0])] if len(pieces) > 1 and len(pieces[0]) > 1 else []
        keys = [k for k in dict.fromkeys(keys) if k]
        for key in keys:
            if refs := self.trie.exact.get(key):
                return refs[0]
        for key in keys[::-1]:
            for term in self.leads:
                if key.startswith(term):
                    return self.trie.exact[term][0]
        for key in lead:
            if refs := self.trie.exact.get(key):
                return refs[0]
        for key in (*keys, *lead):
            if key in self.others:
                return -1
            if (ref := self.near(key)) >= 0:
                return ref
        return -1


def mappers(reference: DataFrame, most: int = MOST_ENTRIES) -> dict[str, Mapper]:
    """A mapper for each field of the reference list, whose size is checked first."""
    rows = reference.select("ref_id", "field_name", "canonical", "aliases").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the reference list has more than {most} entries")
    fields: dict[str, list[tuple[int, str, list[str] | None]]] = {}
    for r in rows:
        if r["field_name"] is not None and r["canonical"] is not None and r["ref_id"] is not None:
            fields.setdefault(r["field_name"], []).append((r["ref_id"], r["canonical"], [a for a in r["aliases"] or [] if a]))
    return {field: Mapper(field, entries) for field, entries in fields.items()}


def field_names(reference: DataFrame, field: str, most: int = MOST_ENTRIES) -> list[str]:
    """Canonical spellings of a field, whose number is checked first."""
    rows = reference.where((F.col("field_name") == field) & F.col("canonical").isNotNull()).select("canonical").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the reference list has more than {most} entries")
    return sorted(r[0] for r in rows)


def map_values(values: DataFrame, reference: DataFrame, field_col: str = "field_name", value_col: str = "value", keep_exact: bool = False) -> DataFrame:
    """Adds ``ref_id`` (bigint) to rows of (field, value, anything else).

    A narrow map without a shuffle, whatever the frequency of a value. ``ref_id`` is -1 where
    the list has no entry for the value, also for blank and null values and unknown fields.
    Values that are, letter for letter, a canonical spelling are left out unless
    ``keep_exact``. Repeated rows stay; an empty table gives an empty result. A column that is
    already called ref_id is replaced.
    """
    by_field = mappers(reference)
    if not keep_exact:
        dirty: Column = F.lit(True)
        for r in sorted(by_field):
            dirty = dirty & ~((F.col(field_col) == r) & F.col(value_col).isin(field_names(reference, r)))
        values = values.where(F.coalesce(dirty, F.lit(True)))
    values = values.drop("ref_id")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema), "ref_id bigint"])
    at_field, at_value = values.columns.index(field_col), values.columns.index(value_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = [
                by_field[f].resolve(v) if f in by_field and v is not None else -1
                for f, v in zip(batch.column(at_field).to_pylist(), batch.column(at_value).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(refs, pa.int64())], [*batch.schema.names, "ref_id"])

    return values.mapInArrow(run, schema)


def posted_values(jobs: DataFrame, id_col: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """(id, field_name, item_pos, value) of every value that is neither null nor blank; item_pos
    is the index in the array from 0, and 0 for scalar fields."""
    parts = [F.array(F.struct(F.lit(c).alias("field_name"), F.lit(0).alias("item_pos"), F.col(c).alias("value"))) for c in scalars]
    for c in lists:
        typed = F.expr(f"transform(`{c}`, (v, k) -> struct('{c}' AS field_name, k AS item_pos, v AS value))")
        parts.append(F.coalesce(typed, F.array().cast("array<struct<field_name:string,item_pos:int,value:string>>")))
    rows = jobs.select(F.col(id_col), F.explode(F.concat(*parts)).alias("_v")).select(id_col, "_v.*")
    return rows.where(F.col("value").rlike(r"(?U)\S"))
