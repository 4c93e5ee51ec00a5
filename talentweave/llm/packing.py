"""Texts put into containers of a fixed number of tokens, together with texts they resemble.

Documents are cut into shards by content: texts that share terms share a shard as often as their sets of
terms overlap. In each shard a BM25 inverted index over all terms of all texts and pieces returns unused
neighbours for a seed, the longest text left; they fill the seed's container in the order of their
scores until none fits any more, then the text that fits the rest best closes it. Only texts longer
than a container are divided.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.charstream import folded, mixed, pieces, shingles

#: Vocabulary of the public tokenizer; a parameter of the operators.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how byte-level BPE vocabularies of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents of a shard.
SHARD_DOCS = 2000
#: Tasks that the shards are spread over, at most.
MOST_TASKS = 20_000
#: Container sizes at most; they travel with the tasks.
MOST_SPECS = 10_000
#: Characters of a term, bins of its hash, terms of a seed that are asked for (the index holds all): those
#: that can add most to all scores together.
TERM, BINS, QUERY_TERMS = 3, 1 << 17, 64
#: Bins of the sketch by which texts are brought together.
SKETCHES = 1 << 16
#: BM25 parameters.
K1, B = 1.2, 0.75
SCHEMA = "spec_id bigint, container string, doc_id bigint, piece int, first_token bigint, n_tokens bigint"


@cache
def tokenizer(vocabulary: str) -> Any:
    """Tokenizer of a vocabulary file, one in each Python process."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def term_bins(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(different bins, times) of each text's terms."""
    for _, piece in pieces(texts):
        chars, ends = folded(piece)
        h, places = shingles(chars, ends, TERM)
        bins = (h >> np.uint64(47)).astype(np.uint32)
        start = 0
        for end in np.searchsorted(places, ends).tolist():
            own = np.sort(bins[start:end])
            start = end
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            yield own[first], np.diff(np.concatenate([first, [len(own)]]))


def sketch(bins: np.ndarray) -> int:
    """Sketch of a set of terms: the smallest hash, hashed again. Two sets have the same with the
    probability of their overlap. Without terms it is 0."""
    return int(mixed(mixed(bins.astype(np.uint64) + np.uint64(1)).min(keepdims=True))[0] >> np.uint64(48)) if len(bins) else 0


def _corpus(docs: DataFrame) -> np.ndarray:
    """What the index needs of all documents, added up by task first: for each bin in how many texts it
    stands, for each sketch how many texts have it, the number of texts, and of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS + SKETCHES + 2, np.int64)
        for batch in batches:
            for bins, times in term_bins(batch.column(0).to_pylist()):
                total[bins] += 1
                total[BINS + sketch(bins)] += 1
                total[-1] += int(times.sum())
            total[-2] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bin", "n"])

    rows = docs.select("text").mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BINS + SKETCHES + 2, np.int64)
    total[rows["bin"].to_numpy(int)] = rows["n"].to_numpy(np.int64)
    return total


def shards_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, number of shards) of each sketch: neighbouring sketches are put together until
    ``size`` texts are reached, a sketch of more texts is spread over shards of its own."""
    first, parts = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // size))
    shard, held = 0, 0
    for k, n in enumerate(counts.tolist()):
        if held and held + n > size:
            shard, held = shard + 1, 0
        first[k] = shard
        if n > size:
            shard += int(parts[k])
        else:
            held += n
    return first, parts


def tail_bytes(coder: Any, tokens: list[int], capacities: list[int]) -> list[int]:
    """Bytes of the last piece of a text for each of the capacities that divide it with a rest."""
    n = len(tokens)
    return [len(coder.decode_bytes(tokens[n - n % c :])) for c in capacities if n > c and n % c]


def _sharded(docs: DataFrame, shards: tuple[np.ndarray, np.ndarray], vocabulary: str, capacities: list[int]) -> DataFrame:
    """(doc_id, n_tokens, text, tails, shard) of every document, ``tails`` as tail_bytes gives them: texts are encoded once."""
    first, parts = shards

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes, tails = [], []
            for text in texts:
                tokens = coder.encode_ordinary(text)
                sizes.append(len(tokens))
                tails.append(tail_bytes(coder, tokens, capacities))
            kinds = np.array([sketch(bins) for bins, _ in term_bins(texts)], np.int64)
            own = mixed(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) % parts[kinds].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(1), pa.array(tails, pa.list_(pa.int64())), pa.array(first[kinds] + own.astype(np.int64))], ["doc_id", "n_tokens", "text", "tails", "shard"])

    return docs.mapInArrow(run, "doc_id bigint, n_tokens bigint, text string, tails array<bigint>, shard bigint")


class Neighbours:
    """BM25 inverted index over texts: for a seed the scores of all of them."""

    def __init__(self, terms: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, mean: float) -> None:
        self.terms, self.idf = terms, idf
        owner = np.repeat(np.arange(len(terms), dtype=np.int32), [len(b) for b, _ in terms])
        bins = np.concatenate([np.zeros(0, np.uint32), *(b for b, _ in terms)]).astype(np.int64)
        times = np.concatenate([np.zeros(0, np.int64), *(t for _, t in terms)]).astype(np.float64)
        norm = K1 * (1 - B + B * np.bincount(owner, times, len(terms)) / max(mean, 1.0)) if len(terms) else np.zeros(0)
        order = np.sort(bins << 32 | np.arange(len(bins))) & 0xFFFFFFFF  # whole numbers are sorted faster than their places
        self.owner = owner[order]
        self.impact = (idf[bins] * times * (K1 + 1) / (times + norm[owner]))[order]
        self.texts = np.bincount(bins, minlength=len(idf))
        self.starts = np.concatenate([[0], self.texts.cumsum()])

    def query(self, seed: int) -> np.ndarray:
        """The terms of a text that are asked for: of those that another text has, the ones with the
        greatest product of weight and texts."""
        bins, times = self.terms[seed]
        shared = self.texts[bins] > 1
        bins, times = bins[shared], times[shared]
        if len(bins) <= QUERY_TERMS:
            return bins
        return bins[np.argpartition(-self.idf[bins] * times / (times + K1) * self.texts[bins], QUERY_TERMS)[:QUERY_TERMS]]

    def scores(self, query: np.ndarray) -> np.ndarray:
        runs = list(zip(self.starts[query].tolist(), self.starts[query + 1].tolist(), strict=True))
        owner, impact = (np.concatenate([x[a:b] for a, b in runs]) for x in (self.owner, self.impact))
        return np.bincount(owner, impact, len(self.terms))


#: Neighbours that are put in order at a time.
RANKED = 64


def ranking(near: np.ndarray, score: np.ndarray) -> Iterator[np.ndarray]:
    """``near`` by falling score, equal ones as they come, in parts: what nobody asks for isn't sorted."""
    own = score[near]
    while len(near) > 4 * RANKED:
        first = own >= np.partition(own, len(own) - RANKED)[len(own) - RANKED]
        yield near[first][np.argsort(-own[first], kind="stable")]
        near, own = near[~first], own[~first]
    yield near[np.argsort(-own, kind="stable")]


def pieces_of(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(document, piece, first token, tokens); only documents longer than a container have more
    than one piece, of which all but the last are full."""
    out = []
    for k, n in enumerate(sizes):
        out.extend((k, p, at, min(capacity, n - at)) for p, at in enumerate(range(0, max(n, 1), capacity)))
    return out


def pack(sizes: list[int], terms: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, capacity: int, mean: float = 1.0, tails: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> list[list[tuple[int, int, int, int]]]:
    """Containers of pieces. Full pieces stand alone; the rest is filled from the longest down. ``terms`` has
    (bins, times) of each text, ``tails`` those of the last piece of divided ones."""
    pieces = pieces_of(sizes, capacity)
    full = [[p] for p in pieces if p[3] == capacity]
    rest = [p for p in pieces if p[3] < capacity]
    if not rest:
        return full
    order = sorted(range(len(rest)), key=lambda k: (rest[k][3], k))
    by_size = [(rest[k][3], k) for k in order]
    lengths = np.array([p[3] for p in rest])
    used = np.zeros(len(rest), bool)
    index = Neighbours([(tails or {}).get(p[0], terms[p[0]]) if p[1] else terms[p[0]] for p in rest], idf, mean)
    containers = full
    while by_size:
        size, seed = by_size.pop()
        used[seed] = True
        mine, room = [rest[seed]], capacity - size
        if by_size and room >= by_size[0][0]:
            query = index.query(seed)
            if len(query):
                score = index.scores(query)
                score[used] = 0
                near = np.flatnonzero((score > 0) & (lengths <= room))
                for part in ranking(near, score):
                    while len(part) and by_size and room >= by_size[0][0]:
                        fits = np.flatnonzero(lengths[part] <= room)
                        if not len(fits):
                            break
                        k = int(part[fits[0]])
                        part = part[fits[1:]]
                        used[k] = True
                        mine.append(rest[k])
                        room -= rest[k][3]
                        del by_size[bisect_left(by_size, (rest[k][3], k))]
                    if not by_size or room < by_size[0][0]:
                        break
        while by_size and by_size[0][0] <= room:
            at = bisect_right(by_size, (room, len(rest))) - 1
            size, k = by_size.pop(at)
            used[k] = True
            mine.append(rest[k])
            room -= size
        containers.append(mine)
    return containers


def containers(docs: DataFrame, specs: DataFrame, vocabulary: str = VOCABULARY, shard_docs: int = SHARD_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every text, or piece of a longer one, and size of container.

    ``container`` names the container within its spec_id. Null and empty texts have 0 tokens and
    stand in a container too. Ids are taken as unique; specs with null or no capacity are left
    out; empty tables give an empty result.
    """
    wanted = specs.where((F.col("capacity_tokens") > 0) & F.col("spec_id").isNotNull()).select("spec_id", "capacity_tokens").distinct().limit(MOST_SPECS + 1).collect()
    if len(wanted) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container sizes")
    sizes = sorted((r["spec_id"], r["capacity_tokens"]) for r in wanted)
    capacities = sorted({capacity for _, capacity in sizes})
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = _corpus(own)
    total = int(counts[-2])
    idf = np.log(1 + (total - counts[:BINS] + 0.5) / (counts[:BINS] + 0.5)).astype(np.float32)
    mean = float(counts[-1]) / max(total, 1)
    shards = shards_of(counts[BINS:-2], shard_docs)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids = table.column("doc_id").to_pylist()
        lengths = table.column("n_tokens").to_pylist()
        shard = table.column("shard")[0].as_py()
        texts = table.column("text").to_pylist()
        terms = list(term_bins(texts))
        rows = []
        divided = [(k, c) for k, n in enumerate(lengths) for c in capacities if n > c and n % c]
        ends = dict(zip(divided, chain.from_iterable(table.column("tails").to_pylist()), strict=True))
        for spec, capacity in sizes:
            cut = [k for k, n in enumerate(lengths) if n > capacity and n % capacity]
            tails = dict(zip(cut, term_bins([texts[k].encode()[-ends[k, capacity] :].decode(errors="replace") for k in cut]), strict=True))
            packed = pack(lengths, terms, idf, capacity, mean, tails)
            rows += [(spec, f"{shard}-{c}", ids[k], piece, at, n) for c, inner in enumerate(packed) for k, piece, at, n in inner]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["spec_id", "container", "doc_id", "piece", "first_token", "n_tokens"])

    last = int((shards[0] + shards[1]).max())
    return _sharded(own, shards, vocabulary, capacities).repartition(max(1, min(last, MOST_TASKS)), "shard").groupBy("shard").applyInArrow(run, SCHEMA)


def unused_space(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, containers, texts, tokens, fill) of a packing."""
    by = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
    total = by.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))
    sized = total.join(specs.select("spec_id", "capacity_tokens").distinct(), "spec_id")
    fill = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6)
    return sized.select("spec_id", "capacity_tokens", "containers", "texts", "tokens", fill.alias("fill"))
