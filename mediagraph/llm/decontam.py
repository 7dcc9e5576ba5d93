"""Benchmark decontamination: rare seeds join passages to test items, Smith-Waterman alignment scores them.

Test items go out in blocks of bounded size; each block is held against all documents, so no shuffle carries text and no two
documents are compared. Seeds are n-grams of one word, the rarest of each item: an edit of every second or third word leaves no longer
n-gram whole. They miss nothing: an alignment that reaches the least score matches so many of the item's words that it must
match some of its rarest ones, within a bounded stretch of the document. Rarity is taken among the items, so a passage is found
however many documents repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.llm.common import kept, saved
from mediagraph.llm.minhash import WordHashes

#: Words of test items that go out at once: 8 bytes each, with as many for their seeds.
BLOCK_WORDS = 2_000_000
#: A word is a seed beyond those that the bound needs if it is at most this part of all words of the items.
COMMON = 1 / 500
#: And if it stands in the items no more often than this.
MOST = 50
#: Words and seed hits of texts that are looked at together (one text at least), and cells of their alignments.
HITS_AT_ONCE, CELLS = 1_000_000, 400_000
MATCH, MISMATCH, GAP = 2, -1, -1
_BLANK = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))


def words_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words, lower-cased, ASCII punctuation counting as white space."""
    return np.array(list(map(hashes.__getitem__, (text or "").lower().encode().translate(_BLANK).split())), dtype=np.uint64)


def align_many(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best local alignment's score of each row of items with its row of passages, and where it ends in the passage (exclusive).

    Shorter rows are filled up with negative codes that differ between items and passages."""
    j = np.arange(1, passages.shape[1] + 1, dtype=np.int32)
    above = np.zeros((len(passages), passages.shape[1] + 1), dtype=np.int32)
    best, end = np.zeros(len(passages), np.int32), np.zeros(len(passages), np.int64)
    for i in range(items.shape[1]):
        here = above[:, :-1] + np.where(passages == items[:, i : i + 1], np.int32(MATCH), np.int32(MISMATCH))
        np.maximum(here, above[:, 1:] + np.int32(GAP), out=here)
        np.maximum(here, 0, out=here)
        here -= GAP * j  # gaps along the passage
        np.maximum.accumulate(here, axis=1, out=here)
        here += GAP * j
        above[:, 1:] = here
        more = np.flatnonzero(here.max(axis=1, initial=0) > best)
        if len(more):
            best[more], end[more] = here[more].max(axis=1), here[more].argmax(axis=1) + 1
    return best, end


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score of two sequences, and where it ends in the passage."""
    _, codes = np.unique(np.concatenate([item, passage]), return_inverse=True)
    best, end = align_many(codes[None, : len(item)], codes[None, len(item) :])
    return int(best[0]), int(end[0])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... (counts[k] of them) for each k in turn."""
    return np.arange(counts.sum()) + np.repeat(starts - np.cumsum(counts) + counts, counts)


class Block:
    """The items of one block: their words one after another, and their seeds.

    A score of least needs matches of ceil(least * size) of the item's words, in at most span words of the document (each match
    gives MATCH, each other step takes one away). So at most size - need words are missed, and of the size - need + k rarest ones
    at least k are matched, whichever k is taken.
    """

    def __init__(self, ids: list, words: list[np.ndarray], least: float):
        self.ids, self.least = ids, least
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.vocabulary, codes, counts = np.unique(np.concatenate([*words, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        self.codes = codes.astype(np.int32)
        self.need = np.maximum(np.ceil(least * self.sizes - 1e-9), 1).astype(np.int64)
        self.span = self.sizes + np.floor(MATCH * self.sizes * (1 - least) + 1e-9).astype(np.int64)
        held, item = counts[codes], np.repeat(np.arange(len(words)), self.sizes)
        order = np.lexsort((codes, held, item))
        rank = np.arange(len(order)) - np.repeat(self.starts, self.sizes)
        needed = rank < np.repeat(self.sizes - self.need + 1, self.sizes)
        seed = order[needed | (held[order] <= max(2, min(COMMON * len(codes), MOST)))]
        self.k = np.bincount(item[seed], minlength=len(words)) - (self.sizes - self.need)
        by_word = np.argsort(codes[seed], kind="stable")
        self.items = item[seed][by_word]
        self.degree = np.bincount(codes[seed], minlength=len(self.vocabulary) + 1)
        self.first = np.cumsum(self.degree) - self.degree
        self.members = np.unique(item * (len(self.vocabulary) + 1) + codes)

    def coded(self, words: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary; behind its end for others."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at, len(self.vocabulary)).astype(np.int32)

    def windows(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, item, low and high of each stretch of words in which as many of an item's seeds as needed lie within its span."""
        degree = self.degree[codes]
        at = np.flatnonzero(degree)
        item, at = self.items[spread(self.first[codes[at]], degree[at])], np.repeat(at, degree[at])
        group = doc[at] * len(self.ids) + item
        order = np.argsort(group, kind="stable")
        group, at, item = group[order], at[order], item[order]
        last = np.arange(len(item)) + self.k[item] - 1
        there = np.minimum(last, len(item) - 1)
        use = (last < len(item)) & (group[there] == group) & (at[there] - at < self.span[item])
        group, item, low, high = group[use], item[use], (at[there] - self.span[item] + 1)[use], (at + self.span[item])[use]
        return joined(group, item, low, high, starts[group // max(len(self.ids), 1)], ends[group // max(len(self.ids), 1)])

    def able(self, codes: np.ndarray, group: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which stretches could reach the least score if each word that the item holds were a match."""
        size = high - low
        cell = codes[spread(low, size)].astype(np.int64) + np.repeat(item, size) * (len(self.vocabulary) + 1)
        at = np.minimum(np.searchsorted(self.members, cell), len(self.members) - 1)
        gain = np.where(self.members[at] == cell, MATCH, -1)
        starts = np.cumsum(size) - size
        # the best run of each stretch: running sums less the least one so far; each stretch begins far below the one before
        sums = np.cumsum(gain) - np.repeat(np.arange(len(size)), size) * (1 << 40)
        least = np.minimum.accumulate(np.minimum(sums - gain, sums))
        return np.maximum.reduceat(sums - least, starts) >= MATCH * self.least * self.sizes[item] - 1e-9

    def matches(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, int, int]]:
        """Text, item, score and word span of the best passage, for each text and item that reach the least score."""
        codes = [self.coded(w) for w in texts]
        load = np.array([len(c) + int(self.degree[c].sum()) for c in codes])
        part = np.cumsum(load) // HITS_AT_ONCE
        for k in np.unique(part):
            own = np.flatnonzero(part == k)
            for d, *rest in self._matches([codes[i] for i in own]):
                yield int(own[d]), *rest

    def _matches(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, float, int, int]]:
        lengths = np.array([len(t) for t in texts], np.int64)
        codes, ends = np.concatenate(texts), np.cumsum(lengths)
        starts = ends - lengths
        group, item, low, high = self.windows(codes, starts, ends, np.repeat(np.arange(len(texts)), lengths))
        if not len(group):
            return
        use = self.able(codes, group, item, low, high)
        order = np.flatnonzero(use)
        order = order[np.argsort((high - low)[order], kind="stable")]
        group, item, low, high = group[order], item[order], low[order], high[order]
        found: dict[int, tuple[int, int, int]] = {}
        at = 0
        while at < len(group):
            # as many as fit; they are ordered by length
            n = 1
            while at + n < len(group) and n < 4096 and (n + 1) * (high[at + n] - low[at + n]) <= CELLS:
                n += 1
            b = slice(at, at + n)
            best, end = align_many(self._table(self.codes, self.starts[item[b]], self.sizes[item[b]], -1), self._table(codes, low[b], high[b] - low[b], -2))
            for g, score, a, e in zip(group[b].tolist(), best.tolist(), low[b].tolist(), (low[b] + end).tolist(), strict=True):
                found[g] = max(found.get(g, (0, 0, 0)), (score, a, e))
            at += n
        for g, (score, a, e) in sorted(found.items()):
            d, i = divmod(g, len(self.ids))
            m = int(self.sizes[i])
            if score >= self.least * MATCH * m - 1e-9:
                yield d, i, score / (MATCH * m), max(a, e - int(self.span[i])) - int(starts[d]), e - int(starts[d])

    @staticmethod
    def _table(codes: np.ndarray, low: np.ndarray, size: np.ndarray, fill: int) -> np.ndarray:
        """A row of codes for each stretch, filled up to the longest one."""
        out = np.full((len(low), int(size.max())), fill, np.int32)
        out[np.repeat(np.arange(len(low)), size), spread(np.zeros(len(low), np.int64), size)] = codes[spread(low, size)]
        return out


def joined(group: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one group that meet are one; none goes beyond its text. They come in order."""
    new = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (low[1:] > high[:-1]))[: len(group)])
    last = np.append(new, len(group))[1:] - 1
    return group[new], item[new], np.maximum(low[new], starts[new]), np.minimum(high[last], ends[new])


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    least: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, item_id, score, start_word and end_word for each document and item whose alignment scores least or more of the item's own.

    The score is that of the best local alignment over that of the whole item with itself; every pair that reaches least is found.
    The span ends where the alignment does and reaches back as far as it may; of passages of one score it is one. Null texts have
    no words, and an item without words matches nothing; an item of one word matches every text that has it. Repeated documents or
    items give a row each; a null id is kept as null; other columns are not read; without items or documents there are no rows.
    """
    if not 0 < least <= 1:
        raise ValueError(f"least is {least}, not above 0 and up to 1")
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    tests = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    size = tests.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-size // block_words))
    found = None
    for k in range(blocks):
        rows = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # bounded: block_words words
        hashes = WordHashes()
        block = Block([r["item_id"] for r in rows], [words_of(r["text"], hashes) for r in rows], least)
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes, block = kept("word hashes", WordHashes), shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = [words_of(cell.as_py(), hashes) for cell in batch.column(1)]
                rows = [(ids[d], block.ids[i], score, start, end) for d, i, score, start, end in block.matches(texts)]
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                kinds = (batch.schema.field(0).type, pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "start_word", "end_word"])

        part = source.mapInArrow(search, "doc_id long, item_id long, score double, start_word long, end_word long")
        found = part if found is None else found.unionByName(part)
    return found


def without_contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no passage of an item; rows without id stay."""
    gone = saved(contaminated(docs, items, least, id_col=id_col, **options).select(F.col("doc_id").alias("_gone")).filter("_gone is not null").distinct(), "contaminated")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
