"""Records of two sources that describe the same posting, without a common key.

Sorted neighbourhood over several composite sort keys. Employers and roles that are written alike
are found first, over their own sort keys and over deletion variants. Then every record stands
under composite keys of employer, role, city and salary; which of city and salary a key holds
depends on what both sides know, so that a pair meets under one key. Within a key, records are
sorted by salary and a window slides over them that is bounded by the salary distance, not by a
number of rows, so that no neighbour is lost. In the window the similarities of employer, role,
seniority, city and salary are weighted to a confidence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from heapq import heappop, heappush
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.functions.hanzi import fold
from talentweave.llm.canonical import field_names, mappers
from talentweave.llm.name_variants import employers, one_edit
from talentweave.session import cut_lineage

#: Distance of salaries (k a month) up to which they may be the same posting's.
SALARY_GAP = 2
#: Width of the salary bands that split large groups.
BAND = 8
#: Weights of employer, role, seniority, city and salary; the confidence is the weighted mean over
#: what both sides know.
WEIGHTS = (0.35, 0.2, 0.2, 0.1, 0.15)
#: Confidence from which a pair counts. With these weights another seniority or a salary further
#: away than the gap falls below it, a letter more or less in the role doesn't.
CONFIDENT = 0.87
#: A role is taken for a misspelling of another, one letter away, that is at least so many times
#: as frequent; letters that such roles have at least.
RARE, LEAST_LETTERS = 10, 3
#: Share of letter pairs that trade names have in common at least to be neighbours.
NAMES_ALIKE = 0.6
#: Rows of a key that one task compares on each side; keys with more are split into blocks.
PART = 1 << 14
#: Pairs that a task scores at a time.
AT_ONCE = 1 << 19

# Seniority words, remarks of titles, wordings of one role, blanks of a city.
SENIORITY = ["实习", "初级", "中级", "高级", "资深", "首席"]
TITLE_REMARKS = ["诚聘", "急聘", "急招", "双休", "可居家", "五险一金", "包吃住"]
WORDINGS = [("工程岗", "工程师"), ("研究岗", "研究员"), ("研发", "开发"), ("分析岗", "分析师"), ("设计岗", "设计师")]
UNKNOWN_CITIES = {"", "na", "未知", "待定", "面议", "见正文"}

_NOTES = re.compile(r"[(（【\[][^()（）【】\[\]]*[)）】\]]")
_SPLIT = re.compile(r"[/·|]|-|\s")
_READ = "id bigint, company string, role string, seniority int, city string, low int, high int"


def read_title(title: str | None) -> tuple[str, str]:
    """(role, seniority) of a title; both are keys, not texts to show.

    The role's letters are sorted, which makes swapped neighbours equal; wordings of one role
    are brought together; remarks, places and numbers are taken off.
    """
    if title is None:
        return "", ""
    text = fold(title)
    level = ""
    for inner in _NOTES.findall(text):
        bare = inner[1:-1].strip()
        level = level or (bare if bare in SENIORITY else "")
    text = _NOTES.sub(" ", text).strip()
    parts = [p for p in _SPLIT.split(text) if p]
    kept = []
    for part in parts:
        if part in SENIORITY:
            level = level or part
        elif part not in TITLE_REMARKS:
            kept.append(part)
    core = kept[0] if kept else ""
    if "·" not in title and "/" not in title and "-" not in title:
        core = "".join(kept)
    again = True
    while again:
        again = False
        for mark in TITLE_REMARKS:
            if core.startswith(mark) and len(core) > len(mark):
                core, again = core[len(mark) :], True
            if core.endswith(mark) and len(core) > len(mark):
                core, again = core[: -len(mark)], True
    for word in SENIORITY:
        if core.startswith(word) and len(core) > len(word):
            level, core = level or word, core[len(word) :]
            break
        if len(core) > 3 and core[0] == word[0] and core[2] == word[1]:
            level, core = level or word, core[1] + core[3:]
            break
    core = re.sub(r"[\W_]", "", core)
    for wording, usual in WORDINGS:
        if core.endswith(wording):
            core = core[: -len(wording)] + usual
    letters = "".join(sorted(core))
    for usual in ("工程师",):
        if core.endswith(usual) and len(core) > len(usual) + 1:
            letters = "".join(sorted(core[: -len(usual)]))
        elif len(core) > len(usual) + 1 and sorted(core[-3:]) == sorted(usual):
            letters = "".join(sorted(core[:-3]))
        elif all(core.count(c) for c in usual) and len(core) > len(usual) + 1:
            rest = core
            for c in usual:
                at = rest.rfind(c)
                rest = rest[:at] + rest[at + 1 :]
            letters = "".join(sorted(rest))
    return letters, level


def _read(df: DataFrame, id_col: str, reference: DataFrame) -> DataFrame:
    by_field = mappers(reference.where(F.col("field_name") == "city_name"))
    city = by_field.get("city_name")
    levels = {word: k + 1 for k, word in enumerate(SENIORITY)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles = [read_title(t) for t in batch.column(1).to_pylist()]
            places: list[str | None] = []
            for c in batch.column(2).to_pylist():
                bare = re.sub(r"[\W_]", "", fold(c)) if c is not None else ""
                ref = city.resolve(c) if c is not None and city is not None else -1
                places.append(None if bare in UNKNOWN_CITIES else f"#{ref}" if ref >= 0 else bare)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array([t[0] for t in titles], pa.string()), pa.array([levels.get(t[1], 0) for t in titles], pa.int32()), pa.array(places, pa.string()), batch.column(4), batch.column(5)],
                ["id", "company", "role", "seniority", "city", "low", "high"],
            )

    salary = [F.when(F.col(c) > 0, F.col(c).cast("int")).alias(c) for c in ("salary_min", "salary_max")]
    return df.where(F.col("company_name").isNotNull()).select(F.col(id_col).cast("bigint"), "title", "city_name", "company_name", *salary).mapInArrow(run, _READ).where(F.col("role") != "")


def near_roles(roles: DataFrame) -> DataFrame:
    """(role, root, role_sim) of every misspelt role among ``roles`` (role, n): the most frequent
    role one letter away (added, left out or replaced), if it is RARE times as frequent.

    Roles one letter apart share a variant with a letter left out. Only different roles are
    joined, not rows.
    """
    long = roles.where(F.length("role") >= LEAST_LETTERS)
    shorter = "transform(sequence(1, length(role)), i -> concat(substr(role, 1, i - 1), substr(role, i + 1)))"
    under = long.select("role", "n", F.explode(F.array_distinct(F.expr(f"array_append({shorter}, role)"))).alias("variant"))
    heavy = under.select("variant", F.col("role").alias("root"), F.col("n").alias("root_n"))
    near = under.join(heavy, "variant").where((F.col("role") != F.col("root")) & (F.col("root_n") >= RARE * F.col("n")))
    best = near.groupBy("role").agg(F.max_by("root", F.struct("root_n", "root")).alias("root"))
    return best.withColumn("role_sim", 1 - 1 / F.greatest(F.length("role"), F.length("root")))


def name_likeness(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of two names; 0 where they are one edit apart at most,
    which is for name_variants to judge."""
    x, y = ({t[k : k + 2] for k in range(len(t) - 1)} for t in (a, b))
    return 0.0 if not x or not y or one_edit(a, b) else 2 * len(x & y) / (len(x) + len(y))


def near_employers(known: DataFrame) -> DataFrame:
    """(employer, other, employer_sim) of employers of one line of business whose trade names are
    alike, but further than an edit apart.

    Sorted neighbourhood over two keys, the trade name read forwards and backwards; the window
    holds the neighbours that agree in half of the shorter name. Names are joined, not rows.
    """
    cut = known.select("employer", F.substring_index("employer", "|", 1).alias("brand"), F.substring_index("employer", "|", -1).alias("line")).where(F.length("brand") >= 4)
    half = F.ceil(F.length("brand") / 2).cast("int")
    keys = F.array(F.concat(F.lit("<"), F.substring("brand", F.lit(1), half)), F.concat(F.lit(">"), F.substring(F.reverse("brand"), F.lit(1), half)))
    longer = F.array(F.concat(F.lit("<"), F.substring("brand", F.lit(1), half - 1)), F.concat(F.lit(">"), F.substring(F.reverse("brand"), F.lit(1), half - 1)))
    sorted_by = cut.select("employer", "brand", "line", F.explode(F.array_distinct(F.concat(keys, F.when(F.length("brand") > 5, longer).otherwise(F.array().cast("array<string>"))))).alias("key"))
    other = sorted_by.select("line", "key", F.col("employer").alias("other"), F.col("brand").alias("other_brand"))
    pairs = sorted_by.join(other, ["line", "key"]).where(F.col("employer") < F.col("other")).select("employer", "other", "brand", "other_brand").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = pa.array([name_likeness(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.float64())
            rows = np.flatnonzero(alike.to_numpy(zero_copy_only=False) >= NAMES_ALIKE)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(rows)) for c in (batch.column(0), batch.column(1), alike)], ["employer", "other", "employer_sim"])

    return pairs.mapInArrow(run, "employer string, other string, employer_sim double")


def _state(city: bool, paid: bool) -> int:
    return 2 * city + paid


def _key(fields: tuple[Column, ...]) -> Callable[[Column], Column]:
    return lambda band: F.xxhash64(*fields, band)


def _under_keys(side: DataFrame, own: int) -> DataFrame:
    """A row for each composite key that a record stands under.

    What a record knows of city and salary is its state. For each state of the other side there
    is one key: both states, employer and role, the city if both know it, and a band of the
    salary if both know it. A pair therefore meets under exactly one key, which holds all that
    both know.
    """
    named, paid = F.col("city").isNotNull(), F.col("low").isNotNull() & F.col("high").isNotNull()
    mine = named.cast("int") * 2 + paid.cast("int")
    band = F.floor(F.col("low") / BAND).cast("int")
    bands = F.array_distinct(F.array(F.floor((F.col("low") - SALARY_GAP) / BAND).cast("int"), F.floor((F.col("low") + SALARY_GAP) / BAND).cast("int"))) if own else F.array(band)
    options = []
    for city, pay in product((False, True), (False, True)):
        theirs = F.lit(_state(city, pay))
        states = (theirs, mine) if own else (mine, theirs)
        spread = F.when(paid, bands).otherwise(F.array(F.lit(0))) if pay else F.array(F.lit(0))
        place = F.when(named, F.col("city")) if city else F.lit(None).cast("string")
        options.append(F.transform(spread, _key((*states, F.col("employer"), F.col("root"), place))))
    spread = side.select(
        F.explode(F.flatten(F.array(*options))).alias("key"), F.lit(own).cast("tinyint").alias("side"), "id", named.alias("named"), paid.alias("paid"), "seniority",
        F.when(paid, F.col("low")).otherwise(0).alias("low"), F.when(paid, F.col("high")).otherwise(0).alias("high"), F.col("role_sim").cast("float").alias("role_sim"), F.col("employer_sim").cast("float").alias("employer_sim"), "hot",
    )
    return spread


def _in_blocks(rows: DataFrame, part: int) -> DataFrame:
    """Adds ``part``: the rows of a key with more than ``part`` rows on a side are cut into blocks, and
    every block of one side meets every block of the other. Only employers with more rows than
    that can have such keys, so only their rows are counted; there are fewer than one such key
    in ``part`` rows."""
    hot = rows.where("hot").groupBy("key").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")).where((F.col("a") > part) | (F.col("b") > part))
    parts = hot.select("key", F.ceil(F.greatest(F.col("a"), F.lit(1)) / part).cast("int").alias("parts_a"), F.ceil(F.greatest(F.col("b"), F.lit(1)) / part).cast("int").alias("parts_b"))
    joined = rows.join(F.broadcast(parts), "key", "left")
    a, b = F.coalesce("parts_a", F.lit(1)), F.coalesce("parts_b", F.lit(1))
    left = F.transform(F.sequence(F.lit(0), b - 1), lambda k: F.pmod(F.xxhash64("id"), a).cast("int") * b + k)
    right = F.transform(F.sequence(F.lit(0), a - 1), lambda k: k * b + F.pmod(F.xxhash64("id"), b).cast("int"))
    return joined.withColumn("part", F.explode(F.when(F.col("side") == 0, left).otherwise(right))).drop("parts_a", "parts_b", "hot")


def _scored(a: dict[str, np.ndarray], b: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, confident: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows x of a and y of b whose weighted similarity is at least ``confident``."""
    city, paid = a["named"][x] & b["named"][y], a["paid"][x] & b["paid"][y]
    gap = np.maximum(np.abs(a["low"][x] - b["low"][y]), np.abs(a["high"][x] - b["high"][y]))
    salary = np.where(gap <= SALARY_GAP, 1 - gap / (2 * SALARY_GAP), 0.0)
    employer, role = a["employer_sim"][x] * b["employer_sim"][y], a["role_sim"][x] * b["role_sim"][y]
    w = WEIGHTS
    known = w[0] + w[1] + w[2] + w[3] * city + w[4] * paid
    total = w[0] * employer + w[1] * role + w[2] * (a["seniority"][x] == b["seniority"][y]) + w[3] * city + w[4] * salary * paid
    sure = total / known
    good = np.flatnonzero(sure >= confident)
    return a["id"][x[good]], b["id"][y[good]], sure[good]


def _windows(x: dict[str, np.ndarray], confident: float) -> Iterator[pa.RecordBatch]:
    """Pairs of the windows of whole keys, of rows sorted by key, part and salary."""
    fresh = np.concatenate([[True], (x["key"][1:] != x["key"][:-1]) | (x["part"][1:] != x["part"][:-1])])
    group = fresh.cumsum().astype(np.int64) << 32
    a, b = ({n: v[x["side"] == k] for n, v in x.items()} for k in (0, 1))
    if not len(a["id"]) or not len(b["id"]):
        return
    at_a, at_b = group[x["side"] == 0], group[x["side"] == 1]
    place = at_a + a["low"] + SALARY_GAP
    # Under a key of a salary band both sides know the salary; under others the salary orders, but decides nothing.
    first, last = np.searchsorted(at_a, at_b, "left"), np.searchsorted(at_a, at_b, "right")
    some = last > first
    bounded = np.zeros(len(at_b), bool)
    bounded[some] = b["paid"][some] & a["paid"][first[some]]
    first[bounded] = np.searchsorted(place, at_b[bounded] + b["low"][bounded], "left")
    last[bounded] = np.searchsorted(place, at_b[bounded] + b["low"][bounded] + 2 * SALARY_GAP, "right")
    sizes = np.maximum(last - first, 0)
    edges = np.concatenate([[0], sizes.cumsum()])
    start = 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(edges, edges[start] + AT_ONCE, "right")) - 1)
        own = sizes[start:end]
        which = np.repeat(first[start:end], own) + np.arange(own.sum()) - np.repeat(own.cumsum() - own, own)
        ids_a, ids_b, sure = _scored(a, b, which, np.repeat(np.arange(start, end), own), confident)
        if len(sure):
            yield pa.RecordBatch.from_arrays([pa.array(ids_a), pa.array(ids_b), pa.array(np.round(sure, 4))], ["id_a", "id_b", "confidence"])
        start = end


def _neighbours(rows: DataFrame, confident: float) -> DataFrame:
    """Pairs of windows that slide over the rows of each key, sorted by salary. Whole keys are
    worked on as they come; a key that isn't complete yet is kept in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def together() -> dict[str, np.ndarray]:
            return {n: np.concatenate([h[n] for h in held]) for n in held[0]}

        for batch in batches:
            if not batch.num_rows:
                continue
            now = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            last = (now["key"] == now["key"][-1]) & (now["part"] == now["part"][-1])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                held.append({n: v[:cut] for n, v in now.items()})
                yield from _windows(together(), confident)
                held = [{n: v[cut:] for n, v in now.items()}]
            elif held and (held[0]["key"][-1] != now["key"][0] or held[0]["part"][-1] != now["part"][0]):
                yield from _windows(together(), confident)
                held = [now]
            else:
                held.append(now)
        if held:
            yield from _windows(together(), confident)

    ordered = rows.repartition("key", "part").sortWithinPartitions("key", "part", "low", "side", "id")
    return ordered.mapInArrow(run, "id_a bigint, id_b bigint, confidence double")


def matches(left: DataFrame, left_id: str, right: DataFrame, right_id: str, reference: DataFrame, confident: float = CONFIDENT, part: int = PART) -> DataFrame:
    """(id_a, id_b, confidence) of every two records, one of each side, that agree well enough.

    Employers (see name_variants) and roles must be the same or alike; cities that both know
    must be equal; how far seniority, salaries and alike names weigh is for the confidence. Null
    and unreadable cities and null or 0 salaries decide nothing. Records without an employer or title take
    no part. Ids are taken as unique within a side, a repeated one gives its pairs again; other
    columns are ignored; an empty table gives an empty result.
    """
    names = cut_lineage(employers(left.select("company_name").unionByName(right.select("company_name")), field_names(reference, "city_name")).select(F.col("name").alias("company"), "employer"))
    sides = [cut_lineage(_read(df, id_col, reference).join(names, "company").drop("company")) for df, id_col in ((left, left_id), (right, right_id))]
    both = sides[0].select("employer", "role").unionByName(sides[1].select("employer", "role"))
    roots = near_roles(both.groupBy("role").agg(F.count(F.lit(1)).alias("n")))
    hot = both.groupBy("employer").count().where(F.col("count") > part).select("employer", F.lit(True).alias("hot"))
    others = near_employers(names.select("employer").distinct())
    either = others.unionByName(others.select(F.col("other").alias("employer"), F.col("employer").alias("other"), "employer_sim"))

    def keyed(rows: DataFrame, own: int) -> DataFrame:
        known = rows.join(roots, "role", "left").join(F.broadcast(hot), "employer", "left")
        known = known.withColumns({"root": F.coalesce("root", "role"), "role_sim": F.coalesce("role_sim", F.lit(1.0)), "employer_sim": F.lit(1.0), "hot": F.coalesce("hot", F.lit(False))})
        if own:
            more = known.join(either.withColumnRenamed("employer_sim", "alike"), "employer").withColumns({"employer": F.col("other"), "employer_sim": F.col("alike")}).drop("other", "alike")
            known = known.unionByName(more)
        return _under_keys(known, own)

    rows = keyed(sides[0], 0).unionByName(keyed(sides[1], 1))
    return _neighbours(_in_blocks(rows, part), confident)


def best_assignment(w: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of a one-to-one assignment of the greatest total weight; weights are at
    least 0 and pairs of weight 0 are left out. Shortest augmenting paths with potentials."""
    if w.shape[0] > w.shape[1]:
        return [(r, c) for c, r in best_assignment(w.T)]
    n, m = w.shape
    cost = w.max() - w if w.size else w
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match, way = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = ~used
            free[0] = False
            reach = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free.copy()
            better[1:] &= reach < least[1:]
            least[better] = reach[better[1:]]
            way[better] = j0
            j1 = int(np.flatnonzero(free)[least[free].argmin()])
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = int(way[j0])
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j] and w[match[j] - 1, j - 1] > 0]


def best_sparse_assignment(rows: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> list[int]:
    """Places of the pairs (row, column, weight), each given once, that make up a one-to-one assignment of the greatest
    total weight. Shortest augmenting paths with potentials over the pairs alone, in whole numbers: a double
    between 0.5 and 1 is one exactly. What stays single goes to a column of its own, of weight 0."""
    n, m = (int(x.max()) + 1 if len(x) else 0 for x in (rows, columns))
    worth = [round(w * (1 << 53)) for w in weights.tolist()]
    most = max(worth, default=0)
    reach: list[list[tuple[int, int]]] = [[(m + r, most)] for r in range(n)]
    place: dict[tuple[int, int], int] = {}
    for k, (r, c) in enumerate(zip(rows.tolist(), columns.tolist(), strict=True)):
        if worth[k] > 0:
            reach[r].append((c, most - worth[k]))
            place[r, c] = k
    u, v, match = [0] * n, [0] * (m + n), [-1] * (m + n)
    for start in range(n):
        r, far = start, 0
        seen, least, way, settled, heap = [(start, 0)], {}, {}, {}, []
        while True:
            base = far - u[r]
            for c, cost in reach[r]:
                d = base + cost - v[c]
                if c not in settled and (c not in least or d < least[c]):
                    least[c], way[c] = d, r
                    heappush(heap, (d, match[c] >= 0, c))
            far, _, c = heappop(heap)
            while c in settled:
                far, _, c = heappop(heap)
            settled[c] = far
            if match[c] < 0:
                break
            r = match[c]
            seen.append((r, far))
        for k, d in seen:
            u[k] += far - d
        for k, d in settled.items():
            v[k] -= far - d
        back = {match[k]: k for k in settled if match[k] >= 0}
        while True:
            r = way[c]
            match[c] = r
            if r == start:
                break
            c = back[r]
    return [place[r, c] for c, r in enumerate(match[:m]) if r >= 0]


def components(pairs: DataFrame) -> DataFrame:
    """Adds ``component`` to (id_a, id_b, ...): the smallest id_a that a chain of pairs reaches. Labels
    fall to the smallest neighbour's and are followed one step further in each round, until
    nothing changes; nothing is collected."""
    pairs = cut_lineage(pairs)
    label = cut_lineage(pairs.groupBy("id_a").agg(F.min("id_a").alias("label")))
    changed = True
    while changed:
        by_b = pairs.join(label, "id_a").groupBy("id_b").agg(F.min("label").alias("low"))
        low = pairs.select("id_a", "id_b").join(by_b, "id_b").groupBy("id_a").agg(F.min("low").alias("low"))
        above = low.select(F.col("id_a").alias("low"), F.col("low").alias("further"))
        now = low.join(above, "low", "left").select("id_a", F.least("low", F.coalesce("further", F.col("low"))).alias("label"))
        now = cut_lineage(now)
        changed = not now.join(label.withColumnRenamed("label", "old"), "id_a").where("label <> old").isEmpty()
        label = now
    return pairs.join(label.withColumnRenamed("label", "component"), "id_a")


def one_to_one(pairs: DataFrame, exact: int | None = None) -> DataFrame:
    """(id_a, id_b, confidence) with each record in one pair at most, of the greatest total confidence.

    Connected components are assigned exactly, each in one task, whatever its size and the table's: the
    same component always has the same assignment. ``exact``, once the size from which another method
    was taken, is no longer looked at. Repeated pairs count once, with their highest confidence.
    """
    once = pairs.groupBy("id_a", "id_b").agg(F.max("confidence").alias("confidence"))
    known = components(once)

    def assign(table: pa.Table) -> pa.Table:
        table = table.select(["id_a", "id_b", "confidence"]).sort_by([("id_a", "ascending"), ("id_b", "ascending")])
        ids_a, ids_b, w = (table.column(c).to_numpy() for c in ("id_a", "id_b", "confidence"))
        chosen = best_sparse_assignment(np.unique(ids_a, return_inverse=True)[1], np.unique(ids_b, return_inverse=True)[1], w)
        return table.take(pa.array(chosen, pa.int64()))

    return known.groupBy("component").applyInArrow(assign, "id_a bigint, id_b bigint, confidence double")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Each record in one pair at most, until no pair of two free records is left.

    In every round the pairs that are the best of both their records are taken and their records
    leave, so that the total is at least half the greatest possible. Ties go by a hash of the
    pair that is another one in each round: about half of a block of equally confident pairs is
    taken in a round, so the rounds grow as the logarithm of the block.
    """
    left, rounds = cut_lineage(pairs), []
    while not left.isEmpty():
        ranked = left.select("id_a", "id_b", F.struct("confidence", F.xxhash64(F.lit(len(rounds)), "id_a", "id_b").alias("tie"), "id_a", "id_b").alias("_p"))
        a, b = (ranked.groupBy(side).agg(F.max("_p").alias("_p")).select("_p.id_a", "_p.id_b", "_p.confidence") for side in ("id_a", "id_b"))
        chosen = cut_lineage(a.join(b.select("id_a", "id_b"), ["id_a", "id_b"]))
        rounds.append(chosen)
        left = cut_lineage(left.join(chosen.select("id_a"), "id_a", "left_anti").join(chosen.select("id_b"), "id_b", "left_anti").select("id_a", "id_b", "confidence"))
    return reduce(lambda x, y: x.unionByName(y), rounds, left)
