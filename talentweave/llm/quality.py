"""Statistics of texts, and a Gaussian mixture over them that tells prose from lists, tables and junk.

Statistics are taken from whole texts, batch by batch, as arrays of characters. The mixture is
fitted by expectation-maximization over all documents: every round each task returns the
sufficient statistics of its documents per component, which are added up before they reach the
driver. Components start at inspected examples and are named by them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.charstream import codes, folding, pieces
from talentweave.llm.quality_examples import EXAMPLES, UNFAMILIAR
from talentweave.session import cut_lineage

#: Rounds of EM, weight of the examples in a component (as a share of all documents, and as so many
#: at least), least variance of a standardized statistic.
ROUNDS, ANCHOR_SHARE, ANCHOR, LEAST_VARIANCE = 8, 0.003, 30.0, 0.02
#: Characters below which a text holds nothing to read.
LEAST_TEXT = 12
#: Bins of the corpus-wide counts of neighbouring letters.
BINS = 1 << 16

NAMES = [
    "n_chars", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_share", "sentence_rate", "mean_line_length", "marker_share", "field_share",
    "cell_ratio", "tag_ratio", "common_word_share", "linking_word_share", "odd_ratio", "variety", "page_word_ratio", "familiarity",
]
#: Statistics that the mixture sees, all but the sizes.
SEEN = [k for k, n in enumerate(NAMES) if n not in ("n_chars", "n_words", "mean_word_length")]

# Words of page furniture.
PAGE_WORDS = (
    "登录 注册 首页 上一页 下一页 返回顶部 返回 版权说明 版权所有 收藏 分享 投递 关闭 更多 菜单 搜索 举报 客服 隐私政策 用户协议 "
    "login home share next prev previous menu sign up terms back close apply search copyright privacy more"
).split()
_MARKS = "*•●·◆■○→▪‣☐☑✓◇□★-–—+>#①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
_ENDS = "。！？!?…～~.;；"
_TAG = re.compile(r"<[^<>]{1,200}>|&[a-z#0-9]{2,8};|\{\{[^{}]{0,60}\}\}")
_CELL = re.compile(r"</?(?:td|tr|th|table)\b")
_PAGE = re.compile("|".join(sorted(map(re.escape, [w for w in PAGE_WORDS if not w.isascii()]), key=len, reverse=True)) + r"|\b(?:" + "|".join(w for w in PAGE_WORDS if w.isascii()) + r")\b")
_WORD = re.compile(r"[a-z]+")


def _table(chars: str) -> np.ndarray:
    found = np.zeros(0x10000, bool)
    found[[ord(c) for c in chars]] = True
    return found


_IS_MARK, _IS_END, _IS_CLOSE = _table(_MARKS), _table(_ENDS), _table("、.)）．")
_QUOTE = _table("”\"』」’'）)")
_SENTENCE = _table("。！？!?…～")


def _kinds() -> np.ndarray:
    """0 blank, 1 Han, 2 Latin letter, 3 digit, 4 other letter, 5 everything else."""
    kinds = np.full(0x10000, 5, np.uint8)
    for code in range(0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        if c.isspace():
            kinds[code] = 0
        elif "一" <= c <= "鿿" or "㐀" <= c <= "䶿":
            kinds[code] = 1
        elif c.isascii() and c.isalpha():
            kinds[code] = 2
        elif c.isascii() and c.isdigit():
            kinds[code] = 3
        elif c.isalnum():
            kinds[code] = 4
    return kinds


_KINDS = _kinds()


def pair_bins(c: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place) of neighbouring folded characters within a text, digits and blanks left out."""
    low = np.minimum(c, 0xFFFF)
    plain = np.where(c < 0x10000, folding()[low], 0).astype(np.uint32)
    plain[(plain >= 48) & (plain <= 57)] = 0
    if len(c) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = (plain[:-1] != 0) & (plain[1:] != 0)
    inner = ends[:-1] - 1
    both[inner[(inner >= 0) & (inner < len(both))]] = False
    at = np.flatnonzero(both)
    h = plain[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + plain[at + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64), at


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[starts]


def statistics(texts: list[str], linking: dict[str, set[str]], known: np.ndarray) -> np.ndarray:
    """One row of NAMES per text. ``linking`` has the common words by script (han, latin), ``known``
    the logarithm of the corpus share of each bin of neighbouring letters."""
    n = len(texts)
    out = np.zeros((n, len(NAMES)))
    if not n:
        return out
    c, ends = codes(texts)
    starts = np.concatenate([[0], ends[:-1]])
    low = np.minimum(c, 0xFFFF)
    kind = _KINDS[low]
    size = np.maximum(ends - starts, 1).astype(float)
    full = _sums(kind != 0, starts, ends)
    ink = np.maximum(full, 1)
    han = _sums(kind == 1, starts, ends)
    latin = _sums(kind == 2, starts, ends)
    digits = _sums(kind == 3, starts, ends)
    word = (kind >= 2) & (kind <= 4)
    begins = word & np.concatenate([[True], ~word[:-1]])
    begins[starts[starts < len(c)]] = word[starts[starts < len(c)]]
    runs = _sums(begins, starts, ends)
    words = runs + np.ceil(han / 2)
    letters = _sums(word, starts, ends) + han
    sentence = _SENTENCE[low].copy()
    dot = np.flatnonzero(low == 46)
    after = np.minimum(dot + 1, len(c) - 1)
    sentence[dot[(kind[after] == 0) | (dot + 1 >= len(c))]] = True

    breaks = np.unique(np.concatenate([np.flatnonzero(low == 10), ends - 1]))
    breaks = breaks[breaks >= 0]
    line_starts = np.concatenate([[0], breaks[:-1] + 1])
    line_ends = np.where(low[breaks] == 10, breaks, breaks + 1) if len(c) else breaks
    inked = np.flatnonzero(kind != 0)
    first, last = np.searchsorted(inked, line_starts), np.searchsorted(inked, line_ends) - 1
    real = first <= last
    line_starts, line_ends, p, q = line_starts[real], line_ends[real], inked[first[real]], inked[last[real]]
    owner = np.searchsorted(ends, line_starts, "right")
    lines = np.bincount(owner, minlength=n).astype(float)
    some = np.maximum(lines, 1)
    at = [np.where(p + k < line_ends, low[np.minimum(p + k, max(0, len(c) - 1))], 0) for k in range(5)] if len(c) else [np.zeros(0, int)] * 5
    digit = [(a >= 48) & (a <= 57) for a in at]
    alpha = ((at[0] | 32) >= 97) & ((at[0] | 32) <= 122)
    dash = np.isin(at[0], [ord(x) for x in "*-–—+>#"])
    marked = _IS_MARK[at[0]] & (~dash | (at[1] == 32) | (at[1] == 9))
    marked |= digit[0] & (_IS_CLOSE[at[1]] | (digit[1] & _IS_CLOSE[at[2]]) | (digit[1] & digit[2] & _IS_CLOSE[at[3]])) & ~((at[1] == 46) & digit[2])
    marked |= alpha & ((at[1] == 41) | (at[1] == 0xFF09))
    marked |= np.isin(at[0], [40, 0xFF08]) & digit[1] & (np.isin(at[2], [41, 0xFF09]) | (digit[2] & np.isin(at[3], [41, 0xFF09])) | (digit[3] & np.isin(at[4], [41, 0xFF09])))
    marked |= (at[0] == 91) & (at[2] == 93)
    marked |= (at[0] == 60) & ((at[1] | 32) == 108) & ((at[2] | 32) == 105)
    tail = low[q] if len(c) else np.zeros(0, int)
    back = low[np.maximum(q - 1, 0)] if len(c) else tail
    closed = _IS_END[tail] | (_QUOTE[tail] & _IS_END[back] & (q > p))
    ended = np.bincount(owner, closed, n)

    field = np.zeros(n)
    blank = (kind == 0) & (low != 10)
    gap = blank[:-1] & blank[1:] if len(c) > 1 else np.zeros(0, bool)
    wide = np.zeros(len(c), bool)
    if len(gap):
        wide[:-1] = gap & np.concatenate([[True], ~gap[:-1]])
    for delimiter in (low == 44, low == 59, low == 9, low == 124, (low == 58) | (low == 0xFF1A), low == 61, wide, (low == 0xFF0C) | (low == 0x3001)):
        counts = _sums(delimiter, p, np.minimum(q + 1, len(c)))
        same = np.zeros(len(counts), bool)
        for step in (1, 2):
            if len(counts) > step:
                same[step:] |= (counts[step:] == counts[:-step]) & (counts[step:] >= 1) & (owner[step:] == owner[:-step])
        field = np.maximum(field, np.bincount(owner, same, n) / np.maximum(lines - 1, 2))

    bins, places = pair_bins(c, ends)
    whose = np.searchsorted(ends, places, "right")
    pairs = np.bincount(whose, minlength=n).astype(float)
    familiar = np.bincount(whose, known[bins], n) / np.maximum(pairs, 1)
    edges = np.searchsorted(whose, np.arange(n + 1))
    odd = _sums(((low >= 0x80) & (low <= 0x2FF) & (low != 0xB7)) | (low == 0xFFFD) | ((low < 32) & (kind != 0)) | (c > 0xFFFF), starts, ends)

    for k, text in enumerate(texts):
        own = bins[edges[k] : edges[k + 1]]
        if len(own):
            sorted_bins = np.sort(own.astype(np.uint16))
            out[k, 15] = np.log(1 + np.count_nonzero(sorted_bins[1:] != sorted_bins[:-1])) - 0.75 * np.log(len(own))
        if "<" in text or "&" in text or "{{" in text:
            tags = [m[0] for m in _TAG.finditer(text.lower())]
            cells = sum(len(t) for t in tags if _CELL.match(t))
            out[k, 10], out[k, 11] = cells / size[k], (sum(map(len, tags)) - cells) / size[k]
        lowered = text.lower() if latin[k] else text
        out[k, 16] = sum(len(m) for m in _PAGE.findall(lowered)) / ink[k]
        units, common, links = max(1.0, words[k]), 0, 0
        if latin[k] > 0.3 * ink[k]:
            own_words = _WORD.findall(lowered)
            common = links = sum(w in linking["latin"] for w in own_words)
            units = max(1.0, len(own_words) + han[k] / 2)
        if han[k]:
            for w in linking["han"]:
                times = text.count(w)
                common += times
                links += times if len(w) > 1 else 0
        out[k, 12], out[k, 13] = common / units, links / units
    out[:, 0], out[:, 1], out[:, 2] = ends - starts, words, letters / np.maximum(words, 1)
    out[:, 3] = (full - letters) / ink
    out[:, 4] = digits / ink
    out[:, 5] = ended / some
    out[:, 6] = np.minimum(1, 20 * _sums(sentence, starts, ends) / ink)
    out[:, 7] = np.log1p(full / some)
    out[:, 8] = np.bincount(owner, marked, n) / some
    out[:, 9] = field
    out[:, 14] = odd / ink
    out[:, 17] = familiar
    return out


def _linking(words: DataFrame, most: int = 100_000) -> dict[str, set[str]]:
    rows = words.where(F.col("word").isNotNull() & (F.col("word") != "")).select("word").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} common words")
    found: dict[str, set[str]] = {"han": set(), "latin": set()}
    for r in rows:
        found["latin" if r["word"].isascii() else "han"].add(r["word"].lower())
    return found


def _pair_shares(docs: DataFrame) -> np.ndarray:
    """Logarithm of the corpus share of each bin of neighbouring letters, from all texts; every
    task adds its own up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for _, piece in pieces(batch.column(0).to_pylist()):
                total += np.bincount(pair_bins(*codes(piece))[0], minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])

    rows = docs.select("text").mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BINS)
    total[rows["bin"].to_numpy(int)] = rows["n"].to_numpy(float)
    return np.log((total + 0.5) / (total.sum() + 0.5 * BINS))


def text_statistics(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the statistics of NAMES), one row per document, repeated ids too.

    Shares lie between 0 and 1. A word is a run of letters or digits, or two Han characters. Null
    and empty texts have all statistics 0. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    linking, known = _linking(words), _pair_shares(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.concatenate([np.zeros((0, len(NAMES))), *(statistics(piece, linking, known) for _, piece in pieces(batch.column(1).to_pylist()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, k]) for k in range(len(NAMES)))], ["doc_id", *NAMES])

    return own.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} double" for n in NAMES))


class Mixture:
    """Gaussian mixture with diagonal covariances; a component has a class."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, examples: list[tuple[str, np.ndarray]]) -> None:
        self.center, self.scale = center, scale
        self.kinds = [kind for kind, _ in examples]
        self.start = np.array([self.standard(x).mean(0) for _, x in examples])
        self.spread = np.array([np.maximum(self.standard(x).var(0), 0.1) for _, x in examples])
        self.mean, self.var = self.start.copy(), np.maximum(self.spread, 0.25)
        self.weight = np.full(len(examples), 1 / len(examples))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -6, 6)

    def posterior(self, z: np.ndarray) -> np.ndarray:
        log = np.log(self.weight)[None, :] - 0.5 * np.log(self.var).sum(1)[None, :]
        log = log - 0.5 * ((z**2) @ (1 / self.var).T - 2 * z @ (self.mean / self.var).T + (self.mean**2 / self.var).sum(1)[None, :])
        log -= log.max(1, keepdims=True)
        p = np.exp(log)
        return p / p.sum(1, keepdims=True)

    def update(self, n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> None:
        """M step; the examples count as documents of their component, in proportion to all, so that
        the outcome is alike at every size."""
        anchor = max(ANCHOR, ANCHOR_SHARE * float(n.sum()))
        weight = n + anchor
        self.mean = (total + anchor * self.start) / weight[:, None]
        second = (squares + anchor * (self.start**2 + self.spread)) / weight[:, None]
        self.var = np.maximum(second - self.mean**2, LEAST_VARIANCE)
        self.weight = weight / weight.sum()

    def classes(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Class with the greatest posterior, and that posterior."""
        if not len(x):
            return [], np.zeros(0)
        p = self.posterior(self.standard(x))
        names = sorted(set(self.kinds))
        by = np.stack([p[:, [k == name for k in self.kinds]].sum(1) for name in names], 1)
        return [names[k] for k in by.argmax(1)], by.max(1)


def fit_mixture(stats: DataFrame, words: DataFrame, known: np.ndarray | None = None, rounds: int = ROUNDS) -> Mixture:
    """EM over all rows of ``stats``; the driver holds a few numbers per component."""
    columns = [NAMES[k] for k in SEEN]
    row = stats.select(*[f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.avg, F.stddev_pop)]).first()
    center = np.array([row[f"avg_{c}"] or 0.0 for c in columns])
    scale = np.maximum(np.array([row[f"stddev_pop_{c}"] or 0.0 for c in columns]), 0.02)
    linking = _linking(words)
    shares = known if known is not None else np.full(BINS, -11.0)
    examples = [(kind, statistics(texts, linking, shares)[:, SEEN]) for kind, texts in EXAMPLES]
    # The corpus doesn't know the examples' words: theirs is the corpus average, or far below it.
    familiar = columns.index("familiarity")
    for k, (_, x) in enumerate(examples):
        x[:, familiar] = center[familiar] - (3 * scale[familiar] if k in UNFAMILIAR else 0)
    mixture = Mixture(center, scale, examples)
    d, kinds = len(SEEN), len(examples)
    names = ["k", "n", *(f"s{k}" for k in range(d)), *(f"q{k}" for k in range(d))]
    schema = "k int, " + ", ".join(f"{n} double" for n in names[1:])
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], m: Mixture = mixture) -> Iterator[pa.RecordBatch]:
            total = np.zeros((kinds, 1 + 2 * d))
            for batch in batches:
                z = m.standard(np.stack([c.to_numpy() for c in batch.columns], 1)) if batch.num_rows else np.zeros((0, d))
                p = m.posterior(z) if len(z) else np.zeros((0, kinds))
                total += np.concatenate([p.sum(0)[:, None], p.T @ z, p.T @ z**2], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(kinds, dtype=np.int32)), *(pa.array(total[:, k]) for k in range(1 + 2 * d))], names)

        rows = stats.select(*columns).mapInArrow(run, schema).groupBy("k").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()
        got = np.zeros((kinds, 1 + 2 * d))
        for r in rows:
            got[r["k"]] = [r[n] for n in names[1:]]
        mixture.update(got[:, 0], got[:, 1 : 1 + d], got[:, 1 + d :])
    return mixture


def text_classes(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_class, confidence): prose, list, table or junk for every document.

    Null, blank and very short texts (LEAST_TEXT) are junk with confidence 1. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    linking, known = _linking(words), _pair_shares(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.concatenate([np.zeros((0, len(NAMES))), *(statistics(piece, linking, known) for _, piece in pieces(batch.column(1).to_pylist()))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, k]) for k in range(len(NAMES)))], ["doc_id", *NAMES])

    stats = cut_lineage(own.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{n} double" for n in NAMES)))
    mixture = fit_mixture(stats, words, known)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns[1:]], 1) if batch.num_rows else np.zeros((0, len(NAMES)))
            kinds, sure = mixture.classes(x[:, SEEN])
            empty = (x[:, 1] + x[:, 3] == 0) | (x[:, 0] < LEAST_TEXT)
            kinds = ["junk" if e else k for k, e in zip(kinds, empty, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(np.where(empty, 1.0, sure))], ["doc_id", "text_class", "confidence"])

    return stats.mapInArrow(name, "doc_id bigint, text_class string, confidence double")
