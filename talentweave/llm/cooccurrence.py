"""Items that stand together: sorted runs of packed pair codes, merged and run-length counted.

Only items that can reach the support asked for are paired (a pair is never more frequent than
its rarer item), which bounds their number. Each task packs the pairs of its rows into 64-bit
codes, sorts a buffer of them at a time and emits it as a run of (code, count); runs are
merged by Spark's external sort, and equal neighbours are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes that a task sorts at a time.
BUFFER = 1 << 21
#: Frequent items that travel with the tasks, at most; beyond, pairs of texts are counted instead.
MOST_ITEMS = 500_000
RUNS = "code bigint, n bigint"


def row_codes(offsets: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Packed codes (smaller id in the upper half) of all pairs of different ids in each row.
    Ids below 0 take no part, repeated ones count once."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = ids >= 0
    packed = np.unique((row[keep].astype(np.int64) << 32) | ids[keep])
    row, ids = packed >> 32, packed & 0xFFFFFFFF
    codes = []
    step = 1
    while step < len(row):
        same = np.flatnonzero(row[step:] == row[:-step])
        if not len(same):
            break
        codes.append((ids[same] << 32) | ids[same + step])
        step += 1
    return np.concatenate(codes) if codes else np.zeros(0, np.int64)


def run_lengths(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(code, count) of sorted codes, whose own counts are added up if given."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(codes)]])) if counts is None else np.add.reduceat(counts, starts)
    return codes[starts], sizes


def _batch(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["code", "n"])


def _runs(rows: DataFrame, items: list[str]) -> DataFrame:
    index = {item: k for k, item in enumerate(items)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            lists = batch.column(0)
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            coded = lists.flatten().dictionary_encode()
            own = np.array([index.get(v, -1) for v in coded.dictionary.to_pylist()] + [-1], np.int64)
            ids = own[pc.fill_null(coded.indices, len(own) - 1).to_numpy(zero_copy_only=False)]
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            codes = row_codes(np.concatenate([[0], sizes.cumsum()]), ids)
            held.append(codes)
            size += len(codes)
            if size >= BUFFER:
                yield _batch(*run_lengths(np.sort(np.concatenate(held))))
                held, size = [], 0
        if size:
            yield _batch(*run_lengths(np.sort(np.concatenate(held))))

    return rows.mapInArrow(run, RUNS)


def _merged(runs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            code = np.concatenate([code, batch.column(0).to_numpy()])
            n = np.concatenate([n, batch.column(1).to_numpy()])
            code, n = run_lengths(code, n)
            if len(code) > 1:
                yield _batch(code[:-1], n[:-1])
                code, n = code[-1:], n[-1:]
        if len(code):
            yield _batch(code, n)

    return runs.repartition("code").sortWithinPartitions("code").mapInArrow(run, RUNS)


def pair_statistics(df: DataFrame, items_col: str, min_rows: int = 1, min_share: float = 0.0, most_items: int = MOST_ITEMS) -> DataFrame:
    """(item_a, item_b, n_both, n_a, n_b, n_rows, lift, odds_ratio) for every pair of different,
    non-empty items, item_a < item_b by code point, in at least ``min_rows`` rows and
    ``min_share`` of all rows.

    A row counts once for a pair and for an item. Null arrays and null or empty items hold
    nothing, but their rows count in n_rows. The odds ratio has a continuity correction of a
    half in each cell. An empty table gives an empty result.
    """
    rows = df.select(F.col(items_col).alias("items"))
    total = rows.count()
    least = max(min_rows, int(np.ceil(min_share * total - 1e-9)), 1)
    listed = rows.where(F.size("items") > 1) if min_rows > 1 else rows
    single = rows.select(F.explode(F.array_distinct("items")).alias("item")).where(F.col("item") != "").groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    frequent = single.limit(most_items + 1).collect()
    if len(frequent) > most_items:
        return _by_text(rows, single, total, least)
    frequent.sort(key=lambda r: r["item"])
    items = [r["item"] for r in frequent]
    counted = _merged(_runs(listed.where(F.size("items") > 1), items)).where(F.col("n") >= least)
    if not items:
        items = [""]
    count = np.array([r["n"] for r in frequent] or [0], np.int64)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(items, pa.string())
        for batch in batches:
            code, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b = code >> 32, code & 0xFFFFFFFF
            arrays = [names.take(pa.array(a)), names.take(pa.array(b)), pa.array(n), pa.array(count[a]), pa.array(count[b])]
            yield pa.RecordBatch.from_arrays(arrays, ["item_a", "item_b", "n_both", "n_a", "n_b"])

    return _measured(counted.mapInArrow(decode, "item_a string, item_b string, n_both bigint, n_a bigint, n_b bigint"), total)


def _by_text(rows: DataFrame, single: DataFrame, total: int, least: int) -> DataFrame:
    """The same for more frequent items than may travel: pairs of texts, pre-aggregated by task."""
    own = F.array_sort(F.filter(F.array_distinct("items"), lambda x: x.isNotNull() & (x != "")))
    once = rows.select(own.alias("items")).where(F.size("items") > 1)
    pairs = once.select(F.posexplode("items").alias("k", "item_a"), "items").select("item_a", F.explode(F.expr("slice(items, k + 2, size(items))")).alias("item_b"))
    counted = pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_both")).where(F.col("n_both") >= least)
    a, b = single.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), single.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    return _measured(counted.join(a, "item_a").join(b, "item_b").select("item_a", "item_b", "n_both", "n_a", "n_b"), total)


def _measured(pairs: DataFrame, total: int) -> DataFrame:
    both, a, b, n = (F.col(c).cast("double") for c in ("n_both", "n_a", "n_b", "n_rows"))
    odds = ((both + 0.5) * (n - a - b + both + 0.5)) / ((a - both + 0.5) * (b - both + 0.5))
    return pairs.withColumn("n_rows", F.lit(total).cast("bigint")).withColumn("lift", both * n / (a * b)).withColumn("odds_ratio", odds)
