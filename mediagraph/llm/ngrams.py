"""Modified Kneser-Ney trigram models over small integer ids, counted by Spark and stored in sorted hash arrays.

An n-gram's key is its ids, 16 bits each. Spark counts all trigrams; what the shorter n-grams need is grouped from these. Every task
holds the n-grams that make up at least 1 / ENTRIES of all there are, so at most ENTRIES of each order at any size of the corpus, with
their probabilities under the counts of all n-grams (whole). The others stay in Spark's tables: texts ask for those they have, packed
and dealt by context (asked), and their counts answer (answered), so each probability is that of the model of all n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.llm.common import saved
from mediagraph.llm.minhash import mixed

BITS = 16
IDS = 1 << BITS
MASK = IDS - 1
#: The id that ends a text, and that stands before its first id.
END = 0
#: An n-gram is kept in the model if it is at least this part of all: at most so many are kept.
ENTRIES = 1 << 22
#: Distinct trigrams that one task holds before it sends their counts on.
HELD = 400_000
#: Counts and questions, about so many, that one task of the answers holds.
ROWS_PER_RANGE = 1_500_000
#: Contexts are dealt to ranges by their remainder; a prime.
REMAINDERS = 1_000_003


def keys_of(*ids: np.ndarray) -> np.ndarray:
    key = ids[0].astype(np.int64)
    for x in ids[1:]:
        key = (key << BITS) | x
    return key


def before(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id before each id of its text, and the one before that; END before the first."""
    one, two = np.zeros_like(ids), np.zeros_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    starts = np.cumsum(lengths) - lengths
    one[starts], two[starts] = END, END
    second = starts[lengths > 1] + 1
    two[second] = END
    return one, two


def summed_keys(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Counter:
    """Counts of int64 keys; adds arrays up and is emptied when it holds many."""

    def __init__(self, most: int = HELD):
        self.most = most
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, times: np.ndarray | None = None) -> None:
        if len(keys):
            self.parts.append(summed_keys(keys, times) if times is not None else np.unique(keys, return_counts=True))
            self.size += len(self.parts[-1][0])

    def settled(self) -> int:
        """How many keys are held, once those added are brought together."""
        self.parts = [self.total()]
        self.size = len(self.parts[0][0])
        return self.size

    def full(self) -> bool:
        return self.size > self.most and self.settled() > self.most // 2

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) == 1:
            return self.parts[0]
        keys = np.concatenate([k for k, _ in self.parts] or [np.zeros(0, np.int64)])
        counts = np.concatenate([n for _, n in self.parts] or [np.zeros(0, np.int64)])
        return summed_keys(keys, counts)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.total()
        self.parts, self.size = [], 0
        return out


def cut(keys: np.ndarray, counts: np.ndarray, *more, rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Batches key, n of bounded length; more: (name, value) columns of one value."""
    for at in range(0, len(keys), rows):
        k = keys[at : at + rows]
        extra = [pa.array(np.full(len(k), v)) for _, v in more]
        yield pa.RecordBatch.from_arrays([*extra, pa.array(k), pa.array(counts[at : at + rows])], names=[*[name for name, _ in more], "key", "n"])


class HashArrays:
    """Values by key: the keys' hashes in order, and where each range of hashes begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        h = mixed(keys.astype(np.uint64))
        order = np.argsort(h)
        self.hashes, self.values = h[order], values[order].astype(np.float32)
        bits = max(1, int(len(h)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def get(self, keys: np.ndarray, default: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The values of the keys, the default where there is none; and the places of the latter."""
        h = mixed(keys.astype(np.uint64))
        group = (h >> self.shift).astype(np.int64)
        at, end = self.first[group], self.first[group + 1]
        out = np.full(len(h), default, np.float32)
        hit = np.zeros(len(h), bool)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            same = self.hashes[at[open_]] == h[open_]
            found = open_[same]
            out[found], hit[found] = self.values[at[found]], True
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out, np.flatnonzero(~hit)


def discounts(ones: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and over 2, from how many n-grams have counts 1, 2, 3 and 4; fixed ones where these are missing."""
    if not all(ones):
        return np.array([0, 0.5, 0.75, 0.9])
    y = ones[0] / (ones[0] + 2 * ones[1])
    return np.clip([0, *(c - (c + 1) * y * ones[c] / ones[c - 1] for c in (1, 2, 3))], [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


class KneserNey:
    """Log10 probabilities: p1 and b2 (weights of contexts of one id) by id, trigrams, bigrams and contexts of two ids in hash arrays."""

    def __init__(self, known_ids: int, one: dict, two: dict, three: dict):
        """Each order: keys and counts of the n-grams kept, context keys and totals, ones (how many counts are 1, 2, 3, 4); left, the
        contexts' discounts over all n-grams, where not all are kept: then trigrams are held if their bigram is too, and exact says
        which aren't held."""
        n1 = np.zeros(IDS)
        n1[one["keys"]] = one["counts"]
        d = discounts(one["ones"])
        taken = np.minimum(d[np.minimum(n1, 3).astype(int)], n1)
        total = max(n1.sum(), 1)
        p1 = (n1 - taken) / total + max(taken.sum(), 0.5) / total / max(known_ids, 1)
        p1 /= p1[:known_ids].sum()
        p2, contexts, back2 = self._order(two, lambda k: p1[k & MASK])
        self.b2 = np.zeros(IDS, np.float32)
        self.b2[contexts] = np.log10(back2)
        self.two, self.p1 = HashArrays(two["keys"], np.log10(p2)), np.log10(np.maximum(p1, 1e-300)).astype(np.float32)
        if "left" in three:
            held = np.delete(np.arange(len(three["keys"])), self.two.get(three["keys"] & (IDS * IDS - 1))[1])
            three = {**three, "keys": three["keys"][held], "counts": three["counts"][held]}
        p3, contexts, back3 = self._order(three, lambda k: 10.0 ** self._lower(k & (IDS * IDS - 1)))
        self.three, self.b3 = HashArrays(three["keys"], np.log10(p3)), HashArrays(contexts, np.log10(back3))
        if "left" in three:
            self.b3 = HashArrays(contexts[:0], back3[:0])  # what isn't held is asked for

    def exact(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probabilities of the trigrams that are held, and the places of the others."""
        return self.three.get(key)

    @staticmethod
    def _order(given: dict, lower) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, counts = given["keys"], given["counts"].astype(float)
        by = np.argsort(given["contexts"])
        contexts, totals = given["contexts"][by], given["totals"][by].astype(float)
        kept = counts - discounts(given["ones"])[np.minimum(counts, 3).astype(int)]
        at = np.searchsorted(contexts, keys >> BITS)
        left = given["left"][by] if "left" in given else totals - np.bincount(at, kept, len(contexts))
        back = np.maximum(np.where(totals > 0, left / np.maximum(totals, 1), 1), 1e-9)
        return kept / totals[at] + back[at] * lower(keys), contexts, back

    def _lower(self, key: np.ndarray) -> np.ndarray:
        out, missing = self.two.get(key)
        k = key[missing]
        out[missing] = self.b2[k >> BITS] + self.p1[k & MASK]
        return out

    def log10(self, key: np.ndarray) -> np.ndarray:
        """Log10 probability of the last id of each trigram after the first two."""
        out, missing = self.three.get(key)
        if len(missing):
            k = key[missing]
            back, _ = self.b3.get(k >> BITS)
            out[missing] = back + self._lower(k & (IDS * IDS - 1))
        return out


def summed(parts: DataFrame, name: str) -> DataFrame:
    """key and n of all trigrams, from partial counts; saved."""
    return saved(parts.groupBy("key").agg(F.sum("n").alias("n")), name)


def train(counted: DataFrame, known_ids: int, entries: int = ENTRIES) -> tuple[KneserNey, dict]:
    """The model of the counted trigrams (key, n) over the ids below known_ids, and the raw counts of the bigrams kept.

    What comes to the driver is bounded by entries for each order; without any trigram all ids are equally likely.
    """
    bigrams = saved(counted.groupBy(F.expr(f"key & {IDS * IDS - 1}L").alias("key")).agg(F.count("*").alias("n"), F.sum("n").alias("c")), "bigrams")
    one = bigrams.groupBy(F.expr(f"key & {MASK}").alias("key")).agg(F.count("*").alias("n"))

    def arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
        t = df.select(*[F.col(c).cast("long") for c in columns]).toArrow()
        return [t[c].to_numpy() for c in columns]

    def order(df: DataFrame) -> tuple[dict, int]:
        totals = df.agg(F.sum("n"), *[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
        least = max(1, -(-(totals[0] or 0) // entries))
        keys, counts = arrays(df.filter(F.col("n") >= least), "key", "n")
        context = df.groupBy(F.shiftright("key", BITS).alias("key")).agg(F.sum("n").alias("total"), F.max("n").alias("most"))
        contexts, sums = arrays(context.filter(F.col("most") >= least), "key", "total")
        return {"keys": keys, "counts": counts, "contexts": contexts, "totals": sums, "ones": [int(x) for x in totals[1:]]}, least

    three, _ = order(counted)
    two, least = order(bigrams.select("key", "n"))
    ones = one.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    keys, counts = arrays(one, "key", "n")
    model = KneserNey(known_ids, {"keys": keys, "counts": counts, "ones": [int(x) for x in ones]}, two, three)
    raw_keys, raw = arrays(bigrams.filter(F.col("n") >= least), "key", "c")
    before, sums = arrays(bigrams.groupBy(F.shiftright("key", BITS).alias("key")).agg(F.sum("c").alias("total")), "key", "total")
    return model, {"keys": raw_keys, "counts": raw, "contexts": before, "totals": sums}


# -- the model of all n-grams ----------------------------------------------------------------------------------------------------


class Whole:
    """The model of all counted trigrams: model, what every task holds; trigrams and bigrams (key, n; the bigrams' raw counts c), the
    tables of all; discounts by order; ranges, how many parts answer; raw, the raw counts of the bigrams held, as Classes takes them."""

    def __init__(self, model: KneserNey, trigrams: DataFrame, bigrams: DataFrame, by_order: dict[int, np.ndarray], ranges: int, raw: dict):
        self.model, self.trigrams, self.bigrams, self.discounts, self.ranges, self.raw = model, trigrams, bigrams, by_order, ranges, raw


#: What raw counts of bigrams lose, and keep at least; their order is named RAW.
RAW, RAW_LOSS, RAW_LEAST = 0, 0.75, 0.1


def whole(counted: DataFrame, known_ids: int, entries: int | None = None) -> Whole:
    """The model of all counted trigrams (saved key, n). What comes to the driver is bounded by entries and by the ids."""
    entries = entries or ENTRIES
    bigrams = saved(counted.groupBy(F.expr(f"key & {IDS * IDS - 1}L").alias("key")).agg(F.count("*").alias("n"), F.sum("n").alias("c")), "bigrams")
    one = bigrams.groupBy(F.expr(f"key & {MASK}").alias("key")).agg(F.count("*").alias("n"))
    context = F.shiftright("key", BITS).alias("key")

    def arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
        t = df.select(*columns).toArrow()
        return [t[c].to_numpy() for c in columns]

    def ones_of(df: DataFrame) -> list[int]:
        return [int(x or 0) for x in df.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)], F.sum("n"), F.count("*")).first()]

    def order(df: DataFrame, bound: bool) -> tuple[dict, int, list[int]]:
        """The n-grams held and their contexts: those of an n-gram that is held, or all, where the ids bound them."""
        found = ones_of(df)
        least, d = max(1, -(-found[4] // entries)), discounts(found[:4])
        loss = F.when(F.col("n") == 1, d[1]).when(F.col("n") == 2, d[2]).otherwise(d[3])
        keys, counts = arrays(df.filter(F.col("n") >= least).select("key", "n"), "key", "n")
        contexts = df.groupBy(context).agg(F.sum("n").alias("total"), F.sum(loss).alias("left"), F.max("n").alias("most"))
        if bound:
            contexts = contexts.filter(F.col("most") >= least)
        names, totals, left = arrays(contexts, "key", "total", "left")
        return {"keys": keys, "counts": counts, "contexts": names, "totals": totals, "left": left, "ones": found[:4]}, least, found

    three, _, found = order(counted.select("key", "n"), True)
    two, least, _ = order(bigrams.select("key", "n"), False)
    keys, counts = arrays(one, "key", "n")
    model = KneserNey(known_ids, {"keys": keys, "counts": counts, "ones": ones_of(one)[:4]}, two, three)
    raw_keys, raw = arrays(bigrams.filter(F.col("n") >= least).select("key", "c"), "key", "c")
    kept = F.greatest(F.col("c") - RAW_LOSS, F.lit(RAW_LEAST))
    before, sums, stay = arrays(bigrams.groupBy(context).agg(F.sum("c").alias("total"), F.sum(kept).alias("stay")), "key", "total", "stay")

    def by_class(of: np.ndarray, common: list[int], other) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the bigrams of each context and class keep: common ids have classes of their own, other gives those of the rest."""
        last = F.expr(f"key & {MASK}")
        named = F.create_map(*[F.lit(int(x)) for i in common for x in (i, of[i])])[last.cast("int")] if common else F.lit(None).cast("int")
        return tuple(arrays(bigrams.groupBy(context, F.coalesce(named, other(last)).cast("int").alias("class")).agg(F.sum(kept).alias("stay")), "key", "class", "stay"))

    raw = {"keys": raw_keys, "counts": raw, "contexts": before, "totals": sums, "stay": stay, "by_class": by_class}
    ranges = max(1, -(-(found[5] + found[4] // 3) // ROWS_PER_RANGE))
    return Whole(model, counted, bigrams, {3: discounts(three["ones"]), 2: discounts(two["ones"])}, ranges, raw)


def dealt(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys by the range of their context, in order in each; and where each range begins."""
    keys = np.unique(keys)
    part = (keys >> BITS) % REMAINDERS % ranges
    by = np.argsort(part, kind="stable")
    return keys[by], np.searchsorted(part[by], np.arange(ranges + 1))


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then their second ones, and so on: keys in order share most of their upper bytes, so these shrink
    when they are shuffled."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


ASKED = "array<struct<ngram: int, part: int, keys: binary>>"
ASKED_ARROW = pa.list_(pa.struct([("ngram", pa.int32()), ("part", pa.int32()), ("keys", pa.binary())]))
ANSWERS = "unit string, ngram int, part int, own binary, back binary"


def asked(wanted: dict[int, np.ndarray], ranges: int) -> list[dict]:
    """What a unit of text asks: ngram, part and keys for each order and range."""
    rows: list[dict] = []
    for order, keys in wanted.items():
        keys, cuts = dealt(keys, ranges)
        rows += [{"ngram": order, "part": r, "keys": planes(keys[cuts[r] : cuts[r + 1]])} for r in range(ranges) if cuts[r] < cuts[r + 1]]
    return rows


def _packed(counts: DataFrame, order: int, ranges: int) -> DataFrame:
    """ngram, part, keys and n: the counts (key, n), packed by range, some ROWS_PER_RANGE rows of a task at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= ROWS_PER_RANGE:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        keys, n = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1))
        part = (keys >> BITS) % REMAINDERS % ranges
        by = np.lexsort((keys, part))
        cuts = np.searchsorted(part[by], np.arange(ranges + 1))
        parts = [r for r in range(ranges) if cuts[r] < cuts[r + 1]]
        packs = [pa.array([planes(x[by[cuts[r] : cuts[r + 1]]]) for r in parts], pa.binary()) for x in (keys, n)]
        return pa.RecordBatch.from_arrays([pa.array([order] * len(parts), pa.int32()), pa.array(parts, pa.int32()), *packs], names=["ngram", "part", "keys", "n"])

    return counts.mapInArrow(pack, "ngram int, part int, keys binary, n binary")


def answered(questions: DataFrame, model: Whole, p1: dict[int, np.ndarray]) -> DataFrame:
    """For each question, in the order of its keys: of trigrams, what their own count gives and their context's back-off weight; of
    bigrams, their probability. p1: probabilities of single ids under the bigrams (2, RAW)."""
    every = _packed(model.trigrams.select("key", "n"), 3, model.ranges).unionByName(_packed(model.bigrams.select("key", "n"), 2, model.ranges))
    if RAW in p1:
        every = every.unionByName(_packed(model.bigrams.select("key", F.col("c").alias("n")), RAW, model.ranges))
    by_order, single = model.discounts, questions.sparkSession.sparkContext.broadcast(p1)

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        order = key[0].as_py()
        k, n = (np.concatenate([np.zeros(0, np.int64), *(from_planes(x.as_py(), np.int64) for x in right[c])]) for c in ("keys", "n"))
        by = np.argsort(k)
        k, n = k[by], n[by].astype(float)
        if order == RAW:
            own, least = np.maximum(n - RAW_LOSS, RAW_LEAST), 1e-6
        else:
            own, least = n - by_order[order][np.minimum(n, 3).astype(int)], 1e-9
        contexts, first, at = np.unique(k >> BITS, return_index=True, return_inverse=True)
        totals, stay = (np.add.reduceat(x, first) if len(k) else x for x in (n, own))
        own, back = own / totals[at], np.maximum(1 - stay / totals, least)
        owns, backs = [], []
        for cell in left["keys"]:
            q = from_planes(cell.as_py(), np.int64)
            mine, behind = np.zeros(len(q)), np.ones(len(q))
            if len(k):
                place = np.minimum(np.searchsorted(k, q), len(k) - 1)
                mine = np.where(k[place] == q, own[place], 0)
                place = np.minimum(np.searchsorted(contexts, q >> BITS), len(contexts) - 1)
                behind = np.where(contexts[place] == q >> BITS, back[place], 1)
            if order != 3:
                mine, behind = mine + behind * single.value[order][q & MASK], behind[:0]
            owns.append(planes(mine.astype(np.float32)))
            backs.append(planes(behind.astype(np.float32)))
        return pa.table({"unit": left["unit"], "ngram": left["ngram"], "part": left["part"], "own": pa.array(owns, pa.binary()), "back": pa.array(backs, pa.binary())})

    return questions.groupBy("ngram", "part").cogroup(every.groupBy("ngram", "part")).applyInArrow(answer, ANSWERS)


class Told:
    """The answers that a unit of text got: rows (ngram, part, own, back); a row that repeats says the same again."""

    def __init__(self, rows, ranges: int):
        self.rows, self.ranges = {(order, part): (own, back) for order, part, own, back in rows}, ranges

    def in_turn(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """own and back of all that the unit asked of this order, as dealt put it."""
        mine = [self.rows[k] for k in sorted(self.rows) if k[0] == order]
        return tuple(np.concatenate([np.zeros(0, np.float32), *(from_planes(x[i], np.float32) for x in mine)]) for i in (0, 1))

    def of(self, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """own and back of each of the keys; keys hold all that the unit asked of this order, and nothing else."""
        own, back = self.in_turn(order)
        distinct, _ = dealt(keys, self.ranges)
        by = np.argsort(distinct)
        place = by[np.searchsorted(distinct[by], keys)]
        return own[place], back[place] if len(back) else back

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probabilities of the trigrams that the unit asked for."""
        own, back = self.of(3, keys)
        lower, _ = self.of(2, keys & (IDS * IDS - 1))
        return np.log10(own.astype(float) + back.astype(float) * lower)
