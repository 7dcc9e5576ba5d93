"""Periodic runs of words, found online by dyadic square catchers.

A run is a stretch of words with smallest period q that can't be made longer. Whenever a block of 2^k words is complete, it gets a
catcher: for as long as the period can be 2^(k+1) - 1 to 2^(k+2) - 2, the block is compared with the suffix of as many words after each
appended word. Any stretch of that many words holds a whole block, so a square with such a period is caught by one of its level's
catchers, and exactly two catchers of a level are alive at a time. A suffix equal to the block at distance p proposes period p; once
as many blocks in a row propose it as the wanted exponent needs, words are compared to both sides, the squares merge into one run, and
the run grows with the words appended after. A period whose stretch already has a period that divides it is no smallest one.

Words may be appended one by one or by the thousand: comparisons are arrays over what was appended. Time is n log n in the words.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Odd factors that mix the hashes of two halves into that of a window. Equal hashes are only proposals: words decide.
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Growing:
    """An array that words are appended to."""

    def __init__(self, dtype):
        self.room, self.n = np.empty(256, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.empty(self.n + len(values), self.room.dtype)])
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


@dataclass
class Run:
    start: int
    end: int
    period: int


class Level:
    """Catchers of blocks of size words, for the periods 2 * size - 1 to 4 * size - 2."""

    def __init__(self, size: int):
        self.size, self.windows = size, Growing(np.uint64)
        #: By period, the first and the last block of the latest row of blocks that propose it.
        self.rows: dict[int, tuple[int, int]] = {}

    def proposals(self, first: int) -> Iterator[tuple[int, int, int]]:
        """Period, first and last block of rows of neighbouring blocks that are equal to a suffix that ends in words appended since the
        windows from first on; rows go on where they ended before. Short periods come first."""
        b, h = self.size, self.windows.values
        at = np.arange(max(first, 2 * b - 1), len(h))
        blocks = [(at - (2 * b - 1)) // b - k for k in (0, 1)]
        hits = [(at[ok], m[ok]) for m in blocks if len(at) for ok in [(m >= 0) & (h[at] == h[np.maximum(m, 0) * b])]]
        if not hits:
            return
        at, block = np.concatenate([x for x, _ in hits]), np.concatenate([m for _, m in hits])
        if not len(at):
            return
        period = at - block * b
        order = np.lexsort((block, period))
        period, block = period[order], block[order]
        cuts = np.flatnonzero((np.diff(period) != 0) | (np.diff(block) != 1)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(period)]]) - 1
        for p, one, two in zip(period[starts].tolist(), block[starts].tolist(), block[ends].tolist(), strict=True):
            begun, last = self.rows.get(p, (one, one - 1))
            self.rows[p] = row = (begun if last == one - 1 else one, two)
            yield p, *row


class Catcher:
    """Runs of at least exponent periods in the words appended so far; exponent is 2 (every square) or more."""

    def __init__(self, exponent: int = 2):
        if exponent < 2:
            raise ValueError("a run repeats at least once")
        self.exponent, self.words, self.levels = exponent, Growing(np.uint64), []
        #: By period, the starts of runs in order and the runs, some still too short; runs that end at the last word may grow.
        self.starts: dict[int, list[int]] = {}
        self.found: dict[int, list[Run]] = {}
        self.open: list[Run] = []

    def append(self, words: np.ndarray) -> None:
        """Takes the ids of the next words."""
        self.words.extend(np.asarray(words, dtype=np.uint64))
        n = self.words.n
        self.open = [r for r in self.open if self._grown(r)]
        size, below = 1, None
        while self.exponent * (2 * size - 1) <= n:
            if len(self.levels) < size.bit_length():
                self.levels.append(Level(size))
            level = self.levels[size.bit_length() - 1]
            first, half = level.windows.n, size // 2
            if below is None:
                level.windows.extend(mixed(self.words.values[first:] * LEFT))
            else:
                new = below[first:]
                level.windows.extend(mixed(new[: len(new) - half] * LEFT + new[half:] * RIGHT))
            for p, one, two in level.proposals(first):
                self._propose(p, one * size, (two + 1) * size)
            size, below = size * 2, level.windows.values

    def _grown(self, run: Run) -> bool:
        w, p = self.words.values, run.period
        run.end += self._equal_from(w, run.end - p, p)
        return run.end == len(w)

    def _propose(self, p: int, start: int, end: int) -> None:
        """Blocks from start up to end are equal to what comes p words later."""
        if end - start < max(self.size_of_proof(p), 1):
            return
        if any(p % q == 0 and self._inside(q, start, end + p) for q in self.found):
            return
        w = self.words.values
        if not np.array_equal(w[start:end], w[start + p : end + p]):
            return
        left = start - self._equal_before(w, start, p)
        right = end + self._equal_from(w, end, p) + p
        run = Run(left, right, p)
        at = bisect.bisect_left(self.starts.setdefault(p, []), left)
        self.starts[p].insert(at, left)
        self.found.setdefault(p, []).insert(at, run)
        if right == len(w):
            self.open.append(run)

    def size_of_proof(self, p: int) -> int:
        """Words of the whole blocks that any run of period p has, at least, where it is compared with itself p later."""
        b = 1 << ((p + 1).bit_length() - 2)
        return max(1, ((self.exponent - 1) * p - b + 1) // b) * b

    def _inside(self, q: int, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.starts[q], start) - 1
        return at >= 0 and self.found[q][at].end >= end

    @staticmethod
    def _equal_from(w: np.ndarray, at: int, p: int) -> int:
        """How many words from at on are equal to those p later."""
        n, step = 0, 16
        while True:
            later = w[at + n + p : at + n + p + step]
            same = w[at + n : at + n + len(later)] == later
            if not same.all():
                return n + int(same.argmin())
            n += len(later)
            if len(later) < step:
                return n
            step *= 2

    @staticmethod
    def _equal_before(w: np.ndarray, at: int, p: int) -> int:
        n, step = 0, 16
        while n < at:
            low = max(0, at - n - step)
            same = (w[low : at - n] == w[low + p : at - n + p])[::-1]
            if not same.all():
                return n + int(same.argmin())
            n, step = at - low, step * 2
        return n

    def runs(self, least: int = 0) -> list[tuple[int, int, int]]:
        """start, length and period of the runs of at least so many words, by start, then period."""
        return sorted((r.start, r.end - r.start, r.period) for rs in self.found.values() for r in rs if r.end - r.start >= max(least, self.exponent * r.period))


def word_runs(words: list, exponent: int, least: int) -> list[tuple[int, int, int]]:
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    catcher = Catcher(exponent)
    catcher.append(np.fromiter(map(index.__getitem__, words), np.uint64, len(words)))
    return catcher.runs(least)


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """words without those that a run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def planted(doc_id: int | None, words: list) -> list:
    """The words of a document, with a periodic stretch up to the end in one of ten documents, by the CRC-32 of the id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


RUNS = "n_runs long, start long, length long, period long, exponent_milli long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text", change=None) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (start, length, period and exponent_milli, null without runs), all runs as
    structs, and collapsed, the text's words joined by blanks without repetitions of runs.

    Words are what ASCII white space leaves apart. change(id, words) gives the words to look at. A run is in one text, so nothing is
    shuffled; a task holds one text and about 60 bytes a word of it. A null or empty text has no runs and an empty collapsed text;
    repeated rows give repeated rows; a row without id is treated like others; other columns are left out, so none clashes; an empty
    table gives no rows. Among runs of one exponent the first start, then the shortest period wins.
    """
    types = {f.name: f.dataType for f in docs.schema.fields}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name: [] for name in ("n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed")}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words = change(key, words) if change else words
                runs = word_runs(words, exponent, least)
                best = None
                for run in runs:
                    if best is None or run[1] * best[2] > best[1] * run[2]:
                        best = run
                start, length, period = best or (None, None, None)
                out["n_runs"].append(len(runs))
                out["start"].append(start)
                out["length"].append(length)
                out["period"].append(period)
                out["exponent_milli"].append(1000 * length // period if best else None)
                out["runs"].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                out["collapsed"].append(b" ".join(collapsed(words, runs)))
            kinds = [pa.int64()] * 5 + [RUN_TYPE, pa.binary()]
            arrays = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
            arrays[-1] = arrays[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *out])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(find, f"doc_id {types[id_col].simpleString()}, {RUNS}")


def digests(found: DataFrame) -> DataFrame:
    """found with hashes in place of runs and texts. A document's runs are one line each."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    hashed = found.withColumn("runs_sha256", F.sha2(F.encode(F.array_join(lines, ""), "utf-8"), 256)).withColumn("collapsed_sha256", F.sha2(F.encode("collapsed", "utf-8"), 256))
    return hashed.drop("runs", "collapsed")
