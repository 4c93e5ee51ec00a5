"""Records that share most of their wording: MinHash banding, then exact verification.

A text's class is a number of 64 bits, 48 of which are the lowest bits of its first minima, so
that two classes can be compared by counting bits. Classes that agree in a band and in enough
of these bits are candidates; a longer row of such bits thins them out, and the full sets of
n-grams decide. Copies fall into one class before anything is shuffled, band keys take 13 bytes,
and only the texts of likely pairs travel.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentweave.session import cut_lineage

#: Characters of an n-gram, rows of a band, recall aimed at for a pair that lies exactly on the
#: threshold.
GRAM, ROWS, RECALL = 3, 5, 0.97
#: Bits of a class that come from minima, bits of the longer row, and how many standard
#: deviations below its expectation a pair on the threshold may lie there.
SHORT, LONG, SLACK = 48, 112, 2.8
_CHUNK = 2048
_PAIRS = 1 << 16


def bands_for(similarity: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """Fewest bands of ``rows`` of which a pair of that similarity shares one with probability
    ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def bits_for(similarity: float, bits: int) -> int:
    """Fewest equal bits, of ``bits`` one-bit minima, that a pair of that similarity may have."""
    p = (1 + similarity) / 2
    return math.floor(bits * p - SLACK * math.sqrt(bits * p * (1 - p)))


def plain(text: Column) -> Column:
    """Lower case, without blanks, punctuation and symbols."""
    return F.regexp_replace(F.lower(text), r"(?U)[\W_]+", "")


def grams(text: str) -> np.ndarray:
    """Different three-character pieces, packed exactly into 63 bits each."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]) if len(c) >= GRAM else np.zeros(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def minima(texts: list[str], hashes: int, seed: int = 11) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the texts, minima: hashes x texts) in chunks, for texts of three characters and
    more."""
    rng = np.random.default_rng(seed)
    draws = rng.integers(0, 1 << 32, (hashes, 2), dtype=np.uint32)
    for start in range(0, len(texts), _CHUNK):
        chunk = texts[start : start + _CHUNK]
        own = np.array([k for k, t in enumerate(chunk) if len(t) >= GRAM], np.int64)
        if not len(own):
            continue
        c = np.frombuffer("".join(chunk[k] for k in own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(chunk[k]) for k in own])
        ends = sizes.cumsum()
        keep = np.ones(len(c) - GRAM + 1, bool)
        for back in range(1, GRAM):
            at = ends[:-1] - back
            keep[at[at < len(keep)]] = False
        h = _mixed((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[keep].astype(np.uint32)
        starts = np.concatenate([[0], (sizes - GRAM + 1).cumsum()[:-1]])
        low = np.empty((hashes, len(own)), np.uint32)
        for k, (times, plus) in enumerate(draws):
            np.minimum.reduceat(h * (times | np.uint32(1)) + plus, starts, out=low[k])
        yield own + start, low


def class_ids(texts: list[str], low: np.ndarray) -> np.ndarray:
    """Classes of texts from their minima: SHORT lowest bits, then 16 bits of a checksum."""
    found = np.zeros(len(texts), np.uint64)
    for k in range(SHORT):
        found = (found << np.uint64(1)) | (low[k] & np.uint32(1)).astype(np.uint64)
    checks = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) & 0xFFFF for t in texts], np.uint64)
    return ((found << np.uint64(16)) | checks).view(np.int64)


def _equal_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return SHORT - np.bitwise_count((a ^ b).view(np.uint64) >> np.uint64(16)).astype(np.int64)


def _bands(docs: DataFrame, bands: int) -> DataFrame:
    """(band, class), each pair once in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(dict.fromkeys(batch.column(0).to_pylist()))
            for own, low in minima(texts, bands * ROWS):
                ids = class_ids([texts[k] for k in own], low)
                keys = []
                for band in range(bands):
                    key = np.full(len(own), band + 1, np.uint64)
                    for row in range(band * ROWS, band * ROWS + ROWS):
                        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ low[row].astype(np.uint64))
                    keys.append((key >> np.uint64(24)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(ids, bands))], ["band", "class"])

    return docs.select("text").mapInArrow(run, "band bigint, class bigint")


def _members(docs: DataFrame) -> DataFrame:
    """(id, class, bits) of every record; bits are LONG one-bit minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for own, low in minima(texts, LONG):
                bits = np.packbits((low & np.uint32(1)).astype(np.uint8).T, axis=1)
                ids = class_ids([texts[k] for k in own], low)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(ids), pa.array([r.tobytes() for r in bits], pa.binary())], ["id", "class", "bits"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, class bigint, bits binary")


def run_pairs(keys: np.ndarray, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a < b) of different ids that stand under one key, of rows sorted by key and id,
    in pieces of bounded size."""
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[fresh], ids[fresh]
    step = 1
    while step < len(keys):
        same = np.flatnonzero(keys[step:] == keys[:-step])
        if not len(same):
            break
        for at in range(0, len(same), _PAIRS):
            part = same[at : at + _PAIRS]
            yield ids[part], ids[part + step]
        step += 1


def _candidates(bands: DataFrame, least: int) -> DataFrame:
    """Pairs of classes that share a band and have enough equal bits. Rows come sorted by band;
    only the run that a batch ends in is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out(k: np.ndarray, i: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in run_pairs(k, i):
                good = _equal_bits(a, b) >= least
                if good.any():
                    yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            ids = np.concatenate([ids, batch.column(1).to_numpy()])
            if len(keys):
                cut = int(np.searchsorted(keys, keys[-1]))
                yield from out(keys[:cut], ids[:cut])
                keys, ids = keys[cut:], ids[cut:]
        yield from out(keys, ids)

    return bands.repartition("band").sortWithinPartitions("band", "class").mapInArrow(run, "a bigint, b bigint").distinct()


def _likely(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b, xa, xb) whose longer rows of bits, xa and xb, are equal in enough places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("xa", "xb"))
            equal = LONG - np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(equal >= least))

    return pairs.select("a", "b", "xa", "xb").mapInArrow(run, "a bigint, b bigint")


def _verify(pairs: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            memo: dict[int, np.ndarray] = {}
            good, found = [], []
            for k, (a, b, ta, tb) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if a not in memo:
                    memo[a] = grams(ta)
                if b not in memo:
                    memo[b] = grams(tb)
                x, y = memo[a], memo[b]
                if not len(x) or not len(y) or min(len(x), len(y)) < least * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= least * (len(x) + len(y) - both) - 1e-9:
                    good.append(k)
                    found.append(both / (len(x) + len(y) - both))
            rows = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, similarity double")


def similar_classes(df: DataFrame, id_col: str, text_col: str, similarity: float, least_chars: int = 0) -> tuple[DataFrame, DataFrame]:
    """(membership, links) of records whose texts overlap by ``similarity`` or more.

    membership: (id, class), one row per record that takes part. Copies share a class; different
    texts share one with a probability of 2^-16 at most, and only if they are near duplicates. links: (a, b, similarity), a < b, between different classes. Null and too
    short texts, and texts of fewer than three letters or digits, take no part. Repeated ids
    stay as they are; an empty table gives two empty results.
    """
    docs = df.where(F.length(text_col) >= least_chars).select(F.col(id_col).alias("id"), plain(F.col(text_col)).alias("text"))
    docs = docs.where(F.length("text") >= GRAM)
    members = cut_lineage(_members(docs))
    heads = members.groupBy("class").agg(F.min("id").alias("head"), F.min("bits").alias("bits"))
    pairs = _candidates(_bands(docs, bands_for(similarity)), bits_for(similarity, SHORT))
    pairs = pairs.join(heads.select(F.col("class").alias("a"), F.col("bits").alias("xa")), "a").join(heads.select(F.col("class").alias("b"), F.col("bits").alias("xb")), "b")
    pairs = cut_lineage(_likely(pairs, bits_for(similarity, LONG)))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(heads, "class").select("class", F.col("head").alias("id"))
    texts = docs.join(wanted, "id").groupBy("class").agg(F.first("text").alias("text"))
    left = pairs.join(texts.select(F.col("class").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("class").alias("b"), F.col("text").alias("tb")), "b")
    return members.select("id", "class"), _verify(both, similarity)


def similar_pairs(df: DataFrame, id_col: str, text_col: str, similarity: float, least_chars: int = 0) -> DataFrame:
    """(a, b) of every two records, a < b, whose texts overlap enough, copies one by one."""
    members, links = similar_classes(df, id_col, text_col, similarity, least_chars)
    one = members.select(F.col("id").alias("x"), F.col("class").alias("a"))
    two = members.select(F.col("id").alias("y"), F.col("class").alias("b"))
    across = links.join(one, "a").join(two, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    many = members.groupBy("class").count().where("count > 1").select("class")
    again = members.join(many, "class", "left_semi")
    within = again.select("class", F.col("id").alias("a")).join(again.select("class", F.col("id").alias("b")), "class").where(F.col("a") < F.col("b")).select("a", "b")
    return across.unionByName(within)


def classes_with_links(df: DataFrame, id_col: str, text_col: str, similarity: float, least_chars: int = 0) -> DataFrame:
    """(id, class_id, copies, links): one row per record that takes part; class_id is the
    smallest id of its class, copies the size of the class, links the other classes alike."""
    members, links = similar_classes(df, id_col, text_col, similarity, least_chars)
    heads = members.groupBy("class").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    return members.join(heads, "class").join(degree, "class", "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
