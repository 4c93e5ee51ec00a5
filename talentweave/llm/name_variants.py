"""Variant spellings of organisation names, linked by a pigeonhole segment join.

A name is read as place, trade name, line of business and legal form. Trade names of one line
of business are the same employer if they are equal, or one edit apart (a swap of neighbours is
one edit): each trade name is cut into k+1 segments, position-shifted substrings are looked up
in the inverted index of segments, and candidates are verified by banded edit distance. Latin
spellings are read through syllables learnt from names that give both scripts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.functions.hanzi import fold, is_hanzi
from talentweave.session import cut_lineage

#: Distinct characters whose syllables are learnt, at most (Unicode has fewer Han characters).
MOST_CHARS = 120_000
#: Edits between spellings of one trade name.
EDITS = 1

# Lines of business, with English words for them.
BUSINESS = {
    "网络科技": "network", "信息技术": "infotech", "数据科技": "datatech", "智能科技": "intelligence", "医疗科技": "meditech", "半导体": "semiconductor",
    "机器人": "robotics", "自动化": "automation", "软件": "software", "科技": "technology", "酒店管理": "hotels", "餐饮管理": "catering", "教育咨询": "education",
    "物流": "logistics", "建材": "materials", "电子": "electronics", "通信": "telecom", "生物": "biotech", "能源": "energy", "新材料": "newmaterials", "传媒": "media",
    "贸易": "trading", "咨询": "consulting", "文化": "culture", "物业": "property", "金融": "finance", "汽车": "auto", "环保": "environment", "食品": "foods",
    "人才派遣": "staffing", "人力资源": "hr", "服饰": "apparel", "旅游": "travel", "广告": "advertising", "投资": "investment", "保险": "insurance",
}
# Legal forms and other endings, remarks, and stand-ins for an unknown employer.
FORMS = ["股份有限公司", "有限责任公司", "集团有限公司", "集团股份有限公司", "有限公司", "责任公司", "集团公司", "总公司", "分公司", "公司", "集团", "有限", "股份", "服务部", "工作室", "中心"]
REMARKS = ["校招组", "社招组", "招聘组", "人事部", "招聘", "急招", "直招", "诚聘", "hr", "官方", "认证"]
PLACEHOLDERS = ["未知公司", "匿名企业", "匿名公司", "某公司", "某企业", "某知名企业", "某知名公司", "知名企业", "保密公司", "保密", "公司保密", "未知", "不详", "无", "暂无", "测试公司"]
LATIN_FORMS = {"co", "ltd", "inc", "corp", "llc", "group", "limited", "company", "corporation"}

_LATIN = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"[A-Z][a-z]*|[a-z]+")
_BRACKETED = re.compile(r"[(【\[]([^()【】\[\]]*)[)】\]]")
_BY_WORD = {w: b for b, w in BUSINESS.items()}
_LINES = sorted(BUSINESS, key=lambda b: (-len(b), b))
_FORMS = sorted(FORMS, key=lambda f: (-len(f), f))
_KINDS = "brand string, line string, place string, latin string, syllables array<string>, hanzi array<string>"


def read_name(name: str, places: tuple[str, ...]) -> tuple[str, str, str, str, list[str], list[str]] | None:
    """(trade name, line, place, Latin trade name, syllables, characters) of a name, None for
    blank names and stand-ins. ``places`` stands longest first. The last two are filled where a
    name gives its trade name in both scripts with as many syllables as characters."""
    text = unicodedata.normalize("NFKC", name).strip()
    folded = "".join(c for c in fold(text) if not c.isspace())
    if not folded or re.sub(r"[\W_]", "", folded) in PLACEHOLDERS or folded.startswith("某"):
        return None
    if not any(map(is_hanzi, folded)) or (len(_LATIN.findall(text)) >= 2 and sum(c.isascii() and c.isalpha() for c in text) > sum(map(is_hanzi, text))):
        return _read_latin(text)
    place = ""
    for inner in _BRACKETED.findall(folded):
        bare = inner[:-1] if inner.endswith("市") else inner
        place = place or (bare if bare in places else "")
    core = _BRACKETED.sub("", folded)
    parts = [p for p in re.split(r"[·|/\\-]", core.strip("。.,;；，、!！·|-")) if p]
    parts = [p for p in parts if p not in REMARKS]
    if len(parts) > 1 and parts[0].removesuffix("市") in places:
        place, parts = parts[0].removesuffix("市"), parts[1:]
    core = "".join(parts)
    again = True
    while again:
        again = False
        for mark in REMARKS:
            if core.endswith(mark) and len(core) > len(mark) + 1:
                core, again = core[: -len(mark)], True
    core = re.sub(r"[\W_]", "", core)
    if not place:
        for p in places:
            if core.startswith(p) and len(core) > len(p) + 1:
                place, core = p, core[len(p) :]
                if core.startswith("市") and len(core) > 2:
                    core = core[1:]
                break
    elif core.startswith(place) and len(core) > len(place) + 1:
        core = core[len(place) :].removeprefix("市")
    for line in _LINES:
        if core.startswith(line + "公司") and len(core) > len(line) + 2:
            return _trim(core[len(line) + 2 :]), line, place, "", [], []
    core = _trim(core)
    for line in _LINES:
        if core.endswith(line) and len(core) > len(line):
            return _trim(core[: -len(line)]), line, place, "", [], []
    return (core, "", place, "", [], []) if core else None


def _trim(core: str) -> str:
    again = True
    while again:
        again = False
        for form in _FORMS:
            if core.endswith(form) and len(core) > len(form) + 1:
                core, again = core[: -len(form)], True
                break
    return core


def _read_latin(text: str) -> tuple[str, str, str, str, list[str], list[str]] | None:
    hanzi = "".join(c for c in fold(text) if is_hanzi(c))
    words = [w for w in _LATIN.findall(text) if w.lower() not in LATIN_FORMS]
    line = next((_BY_WORD[w.lower()] for w in reversed(words) if w.lower() in _BY_WORD), "")
    own = [w for w in words if w.lower() not in _BY_WORD]
    syllables = [s.lower() for w in own for s in _CAMEL.findall(w)]
    if not syllables and not hanzi:
        return None
    latin = "".join(syllables)
    if hanzi and len(hanzi) == len(syllables):
        return hanzi, line, "", latin, syllables, list(hanzi)
    return hanzi, line, "", latin, [], []


def one_edit(a: str, b: str) -> bool:
    """Whether two texts are at most one edit apart, a swap of neighbours being one (the band of
    the edit matrix is one cell wide on each side)."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    k = 0
    while k < la and k < lb and a[k] == b[k]:
        k += 1
    if la == lb:
        return a[k + 1 :] == b[k + 1 :] or (a[k + 2 :] == b[k + 2 :] and a[k : k + 2] == b[k : k + 2][::-1])
    return a[k + 1 :] == b[k:] if la > lb else a[k:] == b[k + 1 :]


def segments(text: str, parts: int) -> list[tuple[int, str]]:
    """(start, segment) of an even cut into ``parts``."""
    size, extra = divmod(len(text), parts)
    found, at = [], 0
    for k in range(parts):
        step = size + (k >= parts - extra)
        found.append((at, text[at : at + step]))
        at += step
    return found


def index_keys(text: str) -> list[str]:
    """Keys under which a trade name stands in the inverted index: its length, the number and
    the text of each segment, and the whole text for probes with swapped neighbours."""
    keys = [f"{len(text)}|{n}|{s}" for n, (_, s) in enumerate(segments(text, EDITS + 1)) if s]
    return [*keys, f"{len(text)}|x|{text}"]


def probe_keys(text: str) -> list[str]:
    """Keys that reach every trade name within one edit: for each length the substrings at
    shifted positions, and the text with each pair of neighbours swapped."""
    keys = set()
    for length in range(max(2, len(text) - EDITS), len(text) + EDITS + 1):
        for n, (start, segment) in enumerate(segments("?" * length, EDITS + 1)):
            for shift in range(-EDITS, EDITS + 1):
                at = start + shift
                if segment and at >= 0 and at + len(segment) <= len(text):
                    keys.add(f"{length}|{n}|{text[at : at + len(segment)]}")
    for k in range(len(text) - 1):
        if text[k] != text[k + 1]:
            keys.add(f"{len(text)}|x|{text[:k]}{text[k + 1]}{text[k]}{text[k + 2 :]}")
    return sorted(keys)


def _read_all(names: DataFrame, places: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k, name in enumerate(batch.column(0).to_pylist()):
                if (read := read_name(name, places)) is not None:
                    rows.append(k)
                    out.append(read)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(6)]
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["name", "weight", *(f.split()[0] for f in _KINDS.split(", "))])

    return names.mapInArrow(run, f"name string, weight bigint, {_KINDS}")


def _index(keys: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            entries: list[str] = []
            for k, (brand, line) in enumerate(zip(batch.column("brand").to_pylist(), batch.column("line").to_pylist(), strict=True)):
                for key in index_keys(brand):
                    rows.append(k)
                    entries.append(f"{line}|{key}")
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), *taken], ["entry", "brand", "line", "places", "weight"])

    return keys.select("brand", "line", "places", "weight").mapInArrow(run, "entry string, brand string, line string, places array<string>, weight bigint")


def _probes(keys: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            entries: list[str] = []
            for k, (brand, line) in enumerate(zip(batch.column("brand").to_pylist(), batch.column("line").to_pylist(), strict=True)):
                for key in probe_keys(brand):
                    rows.append(k)
                    entries.append(f"{line}|{key}")
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), *taken], ["entry", "p_brand", "p_line", "p_places", "p_weight"])

    return keys.select("brand", "line", "places", "weight").mapInArrow(run, "entry string, p_brand string, p_line string, p_places array<string>, p_weight bigint")


def _verified(candidates: DataFrame) -> DataFrame:
    """Candidates at most one edit apart, in bands of the edit matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [one_edit(a, b) for a, b in zip(batch.column("p_brand").to_pylist(), batch.column("brand").to_pylist(), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return candidates.mapInArrow(run, candidates.schema)


def _roots(keys: DataFrame) -> DataFrame:
    """(brand, line, root): each trade name's heaviest relative within one edit, followed until it ends;
    every round doubles the steps. Heavier means more rows, then the smaller text, so that there are
    no rings."""
    small = (F.size("places") == 0) | (F.size("p_places") == 0) | F.arrays_overlap("places", "p_places")
    heavier: Column = (F.col("weight") > F.col("p_weight")) | ((F.col("weight") == F.col("p_weight")) & (F.col("brand") < F.col("p_brand")))
    long = keys.where(F.length("brand") >= 3)
    near = _verified(_probes(long).join(_index(long), "entry").where(heavier & small).select("p_brand", "p_line", "brand", "weight").distinct())
    parents = near.groupBy(F.col("p_brand").alias("brand"), F.col("p_line").alias("line")).agg(F.max_by("brand", F.struct("weight", "brand")).alias("parent"))
    known = keys.join(parents, ["brand", "line"], "left").select("brand", "line", "weight", "places", F.coalesce("parent", "brand").alias("parent"))
    known, moved = cut_lineage(known), True
    while moved:
        up = known.select(F.col("brand").alias("parent"), "line", F.col("parent").alias("above"))
        higher = cut_lineage(known.join(up, ["parent", "line"]).select("brand", "line", "weight", "places", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
        moved = not higher.where("moved").isEmpty()
        known = higher.drop("moved")
    return known.withColumnRenamed("parent", "root")


def employers(names: DataFrame, places: list[str], name_col: str = "company_name") -> DataFrame:
    """(name, employer) for every name that means somebody: names of one employer share it.

    ``names`` may repeat; they are counted before anything is shuffled. Null, blank and
    placeholder names are left out. A trade name without a line of business belongs to the
    line that has most rows under this trade name (or one an edit away). Trade names that are
    only alike, not equal, must not stand for different places.
    """
    ordered = tuple(sorted({p for p in places if p}, key=lambda p: (-len(p), p)))
    counted = names.where(F.col(name_col).isNotNull()).groupBy(F.col(name_col).alias("name")).agg(F.count(F.lit(1)).alias("weight"))
    read = cut_lineage(_read_all(counted, ordered))

    both = read.where(F.size("hanzi") > 0).select(F.explode(F.arrays_zip("hanzi", "syllables")).alias("_z")).select(F.col("_z.hanzi").alias("c"), F.col("_z.syllables").alias("s"))
    heard = both.groupBy("c", "s").count().groupBy("c").agg(F.max_by("s", F.struct("count", "s")).alias("s")).limit(MOST_CHARS + 1).collect()
    if len(heard) > MOST_CHARS:
        raise ValueError(f"more than {MOST_CHARS} characters")
    sound = {r["c"]: r["s"] for r in heard}

    lined = read.where((F.col("brand") != "") & (F.col("line") != "")).groupBy("brand", "line").agg(
        F.sum("weight").alias("weight"), F.array_distinct(F.array_compact(F.collect_set(F.nullif("place", F.lit(""))))).alias("places")
    )
    roots = _roots(lined)

    spelt = _spell(roots.groupBy("root", "line").agg(F.sum("weight").alias("root_weight")), sound)
    by_brand = read.where((F.col("brand") != "") & (F.col("line") != "")).join(roots.select("brand", "line", "root"), ["brand", "line"]).select("name", "root", "line")
    only_latin = read.where((F.col("brand") == "") & (F.col("latin") != ""))
    heard_lined = spelt.where(F.col("latin").isNotNull()).groupBy("latin", "line").agg(F.max_by("root", F.struct("root_weight", "root")).alias("root"))
    heard_any = spelt.where(F.col("latin").isNotNull()).groupBy("latin").agg(F.max_by(F.struct("root", "line"), F.struct("root_weight", "root", "line")).alias("_r"))
    latin = only_latin.where(F.col("line") != "").join(heard_lined, ["latin", "line"], "left").select("name", F.coalesce("root", F.concat(F.lit("~"), "latin")).alias("root"), "line")
    latin_any = only_latin.where(F.col("line") == "").join(heard_any, "latin", "left").select(
        "name", F.coalesce("_r.root", F.concat(F.lit("~"), "latin")).alias("root"), F.coalesce("_r.line", F.lit("")).alias("line")
    )

    bare = read.where((F.col("brand") != "") & (F.col("line") == "")).groupBy("brand").agg(
        F.sum("weight").alias("weight"), F.array_compact(F.collect_set(F.nullif("place", F.lit("")))).alias("places")
    )
    own = bare.withColumn("line", F.lit(""))
    every = roots.select("brand", F.lit("").alias("line"), "places", "weight", "root", F.col("line").alias("of"))
    heads = every.groupBy("root", "of").agg(F.sum("weight").alias("root_weight"))
    same = own.select("brand").join(every.select("brand", "root", "of"), "brand")
    like = _verified(
        _probes(own.where(F.length("brand") >= 3)).join(_index(every.where(F.length("brand") >= 3).select("brand", "line", "places", "weight").distinct()), "entry").select("p_brand", "brand").distinct()
    ).join(every.select("brand", "root", "of"), "brand").select(F.col("p_brand").alias("brand"), "root", "of")
    chosen = same.withColumn("exact", F.lit(1)).unionByName(like.withColumn("exact", F.lit(0))).join(heads, ["root", "of"])
    chosen = chosen.groupBy("brand").agg(F.max_by(F.struct("root", "of"), F.struct("exact", "root_weight", "root", "of")).alias("_c"))
    lone = read.where((F.col("brand") != "") & (F.col("line") == "")).join(chosen, "brand", "left").select(
        "name", F.coalesce("_c.root", "brand").alias("root"), F.coalesce("_c.of", F.lit("")).alias("line")
    )
    found = by_brand.unionByName(latin).unionByName(latin_any).unionByName(lone)
    return found.select("name", F.concat_ws("|", "root", "line").alias("employer"))


def _spell(roots: DataFrame, sound: dict[str, str]) -> DataFrame:
    """Adds the Latin spelling of a root where all its characters' syllables are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for brand in batch.column("root").to_pylist():
                heard = [sound.get(c) for c in brand]
                out.append("".join(heard) if heard and all(heard) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], ["root", "line", "root_weight", "latin"])

    return roots.select("root", "line", "root_weight").mapInArrow(run, "root string, line string, root_weight bigint, latin string")


def variant_pairs(found: DataFrame) -> DataFrame:
    """(name_a, name_b) for every two different names of one employer, name_a < name_b.

    Names come in once each, so a group holds spellings, not rows.
    """
    a = found.select("employer", F.col("name").alias("name_a"))
    b = found.select("employer", F.col("name").alias("name_b"))
    return a.join(b, "employer").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
