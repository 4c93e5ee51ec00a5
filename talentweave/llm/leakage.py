"""Passages of test items inside a training corpus.

The sentences of the test items stand in an inverted index of character shingles, each under its
rarest ones. Every document is a query: a sentence may be in it only if enough of these are, on
neighbouring lines, an item only if enough of its letters lie in such sentences. Both bounds follow from what the
verification accepts, so that nothing is lost before it. What is retrieved is verified sentence
by sentence against the whole document and gets a BM25 score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.charstream import folded, pieces, shingles

#: Characters of an index term and of a term in verification.
TERM, FINE = 5, 3
#: BM25 parameters.
K1, B = 1.2, 0.75
#: Share of a sentence's terms that are indexed beyond those that may be missing; it decides how
#: much is verified, not what is found.
BEYOND = 0.2
#: Index entries that are added up at a time.
AT_ONCE = 1 << 20
#: Share of a sentence's terms found in one place, and share of an item found in sentences.
SENTENCE_SHARE, ITEM_SHARE = 0.7, 0.5
#: Letters that a place may be off its line through inserted or left out words.
DRIFT = 12
#: Lines of a band; two neighbouring bands hold any run of DRIFT + 1 lines.
BAND = 16
#: Items in one index; more items are searched shard by shard.
MOST_ITEMS = 20_000

_END = re.compile(r"(?<=[。！？!?；;\n])|(?<=\.)(?=\s)")


def body_of(text: str) -> str:
    """Passage and question: all behind the first line, or the whole of a text of one line."""
    first, _, rest = text.partition("\n")
    return rest if rest.strip() else first


class Item:
    """Verification data of a test item: the terms of each sentence with their places."""

    def __init__(self, body: str) -> None:
        self.sentences: list[tuple[np.ndarray, np.ndarray, int]] = []
        for sentence in _END.split(body):
            chars, ends = folded([sentence])
            if len(chars) >= 2 * FINE:
                self.sentences.append((*shingles(chars, ends, FINE), len(chars)))
        self.length = sum(n for _, _, n in self.sentences)


class Index:
    """Sentences of the items by their rarest fine terms, and BM25 weights of each item's terms."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        self.items = [Item(body) for _, body in items]
        self.lengths = np.array([i.length for i in self.items], np.int64)
        chars, ends = folded([body for _, body in items])
        h, places = shingles(chars, ends, TERM)
        owner = np.searchsorted(ends, places, "right")
        lengths = np.diff(np.concatenate([[0], ends])).astype(float)
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean() if len(lengths) else 1.0))
        kept, tf = np.unique(np.rec.fromarrays([h, owner]), return_counts=True)
        df = np.unique(kept.f0, return_counts=True)[1]
        n = len(items)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[kept.f1])
        order = np.argsort(kept.f1, kind="stable")
        self.words, self.impact = kept.f0[order], impact[order]
        self.word_first = np.searchsorted(kept.f1[order], np.arange(n + 1))
        self._index_sentences()

    def _index_sentences(self) -> None:
        sentences = [(k, *sentence) for k, item in enumerate(self.items) for sentence in item.sentences]
        self.item_of = np.array([k for k, *_ in sentences], np.int64)
        self.sizes = np.array([size for *_, size in sentences], np.int64)
        every = np.concatenate([np.zeros(0, np.uint64), *(terms for _, terms, _, _ in sentences)])
        different, back, times = np.unique(every, return_inverse=True, return_counts=True)
        hits, number, owner, spot, at = [], [], [], [], 0
        for k, (_, terms, spots, _) in enumerate(sentences):
            most, need = len(terms), int(np.ceil(SENTENCE_SHARE * len(terms)))
            hits.append(min(need, max(1, round(BEYOND * most))))
            own = back[at : at + most]
            at += most
            rarest = np.argsort(times[own], kind="stable")[: most - need + hits[-1]]
            number.append(own[rarest])
            spot.append(spots[rarest])
            owner.append(np.full(len(rarest), k, np.int64))
        self.hits = np.array(hits, np.int64)
        number, owner, spot = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (number, owner, spot))
        order = np.argsort(number, kind="stable")
        used, self.first, self.df = np.unique(number[order], return_index=True, return_counts=True)
        self.terms, self.owner, self.spot = different[used], owner[order], spot[order]
        self.longest = int(self.spot.max()) if len(spot) else 0
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.terms >> np.uint64(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of h that are index terms, their numbers)."""
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), max(0, len(self.terms) - 1))
        good = self.terms[at] == h[maybe] if len(self.terms) else np.zeros(0, bool)
        return maybe[good], at[good]

    def retrieve(self, text: np.ndarray, place: np.ndarray, term: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(text, item) of all that verification can find ``least`` of, of (text, place, term) rows
        sorted by text.

        Of a sentence's m terms r must be found on DRIFT + 1 lines, so m - r may be missing there,
        and of any m - r + x at least x are found there.
        """
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        edges = np.concatenate([starts, [len(text)]])
        work = np.concatenate([[0], self.df[term].cumsum()])[edges]
        texts, items, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < len(starts):
            end = max(at + 1, int(np.searchsorted(work, work[at] + AT_ONCE, "right")) - 1)
            rows = slice(edges[at], edges[end])
            sizes = self.df[term[rows]]
            spread = np.repeat(self.first[term[rows]], sizes) + np.arange(sizes.sum()) - np.repeat(sizes.cumsum() - sizes, sizes)
            band = (np.repeat(place[rows], sizes) - self.spot[spread] + self.longest) // BAND
            bands = int(band.max()) + 2
            code = np.sort((np.repeat(text[rows], sizes) * len(self.hits) + self.owner[spread]) * bands + band)
            fresh = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            found, code = np.diff(np.concatenate([fresh, [len(code)]])), code[fresh]
            found[:-1] += np.where(code[1:] == code[:-1] + 1, found[1:], 0)
            code = code // bands
            code = _different(code[found >= self.hits[code % len(self.hits)]])
            sentence = code % len(self.hits)
            pair = code // len(self.hits) * len(self.ids) + self.item_of[sentence]
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            covered = np.add.reduceat(self.sizes[sentence], first) if len(pair) else first
            who, item = pair[first] // len(self.ids), pair[first] % len(self.ids)
            enough = covered / self.lengths[item] >= least
            texts.append(who[enough])
            items.append(item[enough])
            at = end
        return np.concatenate(texts), np.concatenate(items)

    def score(self, item: int, words: np.ndarray) -> float:
        """BM25 score of an item's terms that stand among a document's, as a share of its own."""
        own = slice(self.word_first[item], self.word_first[item + 1])
        total = self.impact[own].sum()
        return float(self.impact[own][np.isin(self.words[own], words)].sum() / total) if total else 0.0

    def verified(self, item: int, h: np.ndarray, places: np.ndarray) -> float:
        """Share of an item that stands, sentence by sentence, in a document of sorted fine terms."""
        own, covered = self.items[item], 0
        for terms, spots, size in own.sentences:
            left, right = np.searchsorted(h, terms, "left"), np.searchsorted(h, terms, "right")
            sizes = right - left
            need = SENTENCE_SHARE * len(terms)
            if np.count_nonzero(sizes) < need:
                continue
            total = int(sizes.sum())
            at = np.repeat(left, sizes) + np.arange(total) - np.repeat(sizes.cumsum() - sizes, sizes)
            which = np.repeat(np.arange(len(terms)), sizes)
            line = places[at] - np.repeat(spots, sizes)
            order = np.lexsort((which, line))
            line, which = line[order], which[order]
            ends = np.searchsorted(line, line + DRIFT, "right")
            fresh = np.concatenate([[True], line[1:] != line[:-1]])
            for k in np.flatnonzero(fresh & (ends - np.arange(total) >= need)):
                if len(_different(which[k : ends[k]])) >= need:
                    covered += size
                    break
        return covered / own.length if own.length else 0.0


def search(index: Index, texts: list[str], least: float = ITEM_SHARE) -> list[tuple[int, int, float, float]]:
    """(text, item number, score share, share found) of what the texts may contain ``least`` of."""
    chars, ends = folded(texts)
    h, places = shingles(chars, ends, FINE)
    rows, term = index.find(h)
    if not len(rows):
        return []
    text = np.searchsorted(ends, places[rows], "right")
    starts = np.concatenate([[0], ends[:-1]])
    found, last = [], -1
    for t, i in zip(*(x.tolist() for x in index.retrieve(text, places[rows] - starts[text], term, least)), strict=True):
        if t != last:
            own = slice(*np.searchsorted(places, [starts[t], ends[t]]))
            by = np.argsort(h[own], kind="stable")
            fine, spots, last = h[own][by], (places[own] - starts[t])[by], t
            words = shingles(chars[starts[t] : ends[t]], np.array([ends[t] - starts[t]]), TERM)[0]
        found.append((t, i, index.score(i, words), index.verified(i, fine, spots)))
    return found


def _different(x: np.ndarray) -> np.ndarray:
    """Sorted different values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def leaks(docs: DataFrame, doc_id: str, items: DataFrame, item_id: str, text_col: str = "text", least: float = ITEM_SHARE) -> DataFrame:
    """(item_id, doc_id, score, share) for each document that contains at least ``least`` of an
    item's passage and question, in sentences.

    Whole texts are searched, in a narrow map; copies of a document are found each. Null texts
    and items without letters hold nothing; empty tables give an empty result; other columns
    are dropped. The index of one shard of items travels with the tasks; more items than
    MOST_ITEMS make more shards, each a pass over the documents.
    """
    schema = "item_id bigint, doc_id bigint, score double, share double"
    known = items.where(F.col("text").isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col("text").alias("t"))
    total = known.count()
    shards = max(1, -(-total // MOST_ITEMS))
    result = None
    for shard in range(shards):
        part = known.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == shard) if shards > 1 else known
        index = Index(sorted((r["i"], body_of(r["t"])) for r in part.collect()))

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                texts = batch.column(1).to_pylist() if len(index.terms) else []
                out = [(k + x[0], *x[1:]) for k, piece in pieces(texts) for x in search(index, piece, least) if x[3] >= least]
                t, i, score, share = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index.ids[list(i)]), pa.array(ids[list(t)], pa.int64()), pa.array(score, pa.float64()), pa.array(share, pa.float64())], ["item_id", "doc_id", "score", "share"]
                )

        found = docs.where(F.col(text_col).isNotNull()).select(F.col(doc_id).cast("bigint"), text_col).mapInArrow(run, schema)
        result = found if result is None else result.unionByName(found)
    return result
