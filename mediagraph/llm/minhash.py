"""MinHash near-duplicate detection: banded minima find candidates, signatures and then full shingle sets verify them, and
alternating large-star and small-star steps join the links into components.

Texts with equal shingle sets share one node, so that a group of copies costs one row. Inside a bucket, nodes are first compared with
the node that shares most buckets, then, for as long as that finds links and in a few more rounds at most, those still outside the
others' component with another one; only pairs
whose ends are then still in different components are compared with each other, and in large buckets these pairs come from an exact
prefix and position filter. No bucket is cut short and no link between different texts is lost but for
the miss rate of the bands: (1 - s^rows)^bands, below 5e-8 at a similarity s of 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.llm.common import kept, saved
from mediagraph.operators.graph import stars

BANDS, ROWS = 32, 4
#: Candidates whose estimated similarity is this far below the threshold are dropped: over five standard errors of the estimate.
SLACK = 0.2
#: Buckets of more nodes than this find their remaining pairs by the prefix filter.
PAIRED_BUCKET = 24
#: Rounds in which the nodes of a bucket are compared with one of them.
STAR_ROUNDS = 3
#: Ids that go to every task to pick rows by; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words whose hashes one call remembers before it starts over.
WORDS_REMEMBERED = 150_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS_REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of the distinct shingles: runs of size words, or all words if they are fewer. ASCII letters are lower-cased."""
    words = np.array(list(map(hashes.__getitem__, text.lower().split())), dtype=np.uint64)
    if not len(words):
        return words
    k = min(size, len(words))
    n = len(words) - k + 1
    odd = np.random.default_rng(size).integers(0, 1 << 63, size + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.repeat(odd[size:] * np.uint64(k), n)
    for i in range(k):
        total += words[i : i + n] * odd[i]
    return np.unique(mixed(total))


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of multiply-add-shift hashes, each a universal hash of the shingles' upper 32 bits."""
    x, out = shingles >> np.uint64(32), np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(x), 2048):
        h = np.multiply.outer(a, x[at : at + 2048])
        h += b[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def universal(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def signatures(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key (a 128-bit digest of the shingle set) and sig, null where there are no words."""
    a, b = universal(BANDS * ROWS)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("word hashes", WordHashes)
        for batch in batches:
            counts, keys, sigs = [], [], []
            for cell in batch.column(1):
                shingles = shingle_set((cell.as_py() or "").encode(), size, hashes)
                counts.append(len(shingles))
                keys.append(xxhash.xxh3_128_hexdigest(shingles.tobytes()) if len(shingles) else None)
                sigs.append(signature(shingles, a, b).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.string()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(sign, "doc_id long, n_shingles long, set_key string, sig binary")


def ends_among(df: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is an end of one of the saved pairs, without a shuffle of df while the ends are few enough to send."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias(key))
    few = 2 * pairs.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ends) if few else ends.distinct(), key, "left_semi")


def full_sets(docs: DataFrame, size: int, id_col: str, text_col: str, pairs: DataFrame) -> DataFrame:
    """node and its whole shingle set, packed, for the documents at the ends of pairs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = kept("word hashes", WordHashes)
        for batch in batches:
            packed = [shingle_set((cell.as_py() or "").encode(), size, hashes).tobytes() for cell in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "shingles"])

    source = ends_among(docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")), pairs, "node")
    return source.mapInArrow(sets, "node long, shingles binary").filter(F.length("shingles") > 0)


def buckets(nodes: DataFrame) -> DataFrame:
    """bucket and node for each band of each node."""
    odd = np.random.default_rng(11).integers(0, 1 << 63, ROWS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
            h = mixed((sigs * odd[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * odd[ROWS])
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(ids)], names=["bucket", "node"])

    return nodes.select("node", "sig").mapInArrow(band, "bucket long, node long")


def alike(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The saved pairs whose signatures agree in enough places; a pair comes again for each text of an id that has several."""
    least = threshold - SLACK

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
                ok = pa.array((a == b).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])

    left, right = (sigs.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}")) for end in ("u", "v"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "sig_u", "sig_v").mapInArrow(compare, "u long, v long")


def confirmed(pairs: DataFrame, sets: DataFrame, hundredths: int) -> DataFrame:
    """The pairs with 100 * |intersection| >= hundredths * |union| on full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                ok.append(100 * both >= hundredths * (len(p) + len(q) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["u", "v"])

    left, right = (sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")) for end in ("u", "v"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "set_u", "set_v").mapInArrow(compare, "u long, v long")


def prefix_pairs(sets: DataFrame, comps: DataFrame, hundredths: int) -> DataFrame:
    """All pairs of different components that can reach the threshold: ordered by how many sets hold a shingle, rarest first, two
    sets that are alike enough share one of their first |set| - ceil(threshold * |set|) + 1 shingles, and behind the first one they
    share both have enough left for the overlap they need."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = np.frombuffer(packed, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node)), pa.array(np.full(len(s), len(s))), pa.array(s)], names=["node", "n", "shingle"])

    rows = sets.mapInArrow(explode, "node long, n long, shingle long")
    ranked = rows.join(rows.groupBy("shingle").agg(F.count("*").alias("held")).filter("held > 1"), "shingle")
    # shingles of one set only come first in the order, and can't be shared
    alone = rows.groupBy("node").agg(F.count("*").alias("all_n"))
    by_rank = ranked.withColumn("shared", F.count("*").over(_window("node"))).withColumn("rank", F.row_number().over(_window("node", "held", "shingle")))
    placed = by_rank.join(alone, "node").withColumn("pos", F.expr("rank + n - shared"))
    first = placed.filter(F.expr(f"pos <= n - ceil({hundredths} * n / 100.0) + 1")).select("node", "n", "shingle", "pos").join(comps, "node")
    a, b = first.alias("a"), first.alias("b")
    overlap = f"{100 + hundredths} * (1 + least(a.n - a.pos, b.n - b.pos)) >= {hundredths} * (a.n + b.n)"
    ok = F.expr(f"a.shingle = b.shingle and a.node < b.node and a.comp <> b.comp and {overlap}")
    return a.join(b, ok).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def _window(key: str, *order: str):
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    return w.orderBy(*order) if order else w


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node it reaches) for every node of edges (u, v), by alternating large-star and small-star."""
    return stars(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("id").alias("node"), F.col("component").alias("comp"))


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id and kept.

    Texts of at least threshold Jaccard similarity on shingles of size words are linked; component_id is the smallest doc_id of the
    component. A null, empty or blank text has no shingles and is linked with nothing; with fewer than size words the whole sequence
    is the one shingle. A row without id lends no id to its group: its component is that of a row with id and the same set, else
    null, and it is kept only in the latter case. Rows that repeat an id are judged each by its own text, and the component joins
    what either is linked with. Other columns are not read.
    """
    hundredths = round(100 * threshold)
    rows = saved(signatures(docs, size, id_col, text_col), "signatures")
    # equal sets have equal signatures, so one shuffle finds the node of each set and its signature
    by_set = rows.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    by_set = saved(by_set, "nodes")
    copied = by_set.filter("copies > 1 or node is null").select("set_key", "node")
    nodes = by_set.filter("node is not null").select("node", "sig")
    in_bucket = buckets(nodes)
    shared = in_bucket.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = saved(in_bucket.join(shared, "bucket").distinct(), "members")
    # a node that shares much stands in the middle of its group, so most of the group is within reach of it
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))

    def links(pairs: DataFrame) -> DataFrame:
        near = saved(alike(pairs, ends_among(nodes, pairs, "node"), threshold), "candidates")
        return saved(confirmed(near, full_sets(docs, size, id_col, text_col, near), hundredths), "links")

    placed = members.join(weight, "node").withColumn("comp", F.col("node"))
    # joined has the edges that matter to what is connected: of the rounds so far, each node's with its component
    tested, joined = None, None
    for k in range(STAR_ROUNDS):
        first = F.struct("weight", -F.col("node")) if not k else F.struct(F.xxhash64("node", F.lit(k)), "node")
        center = placed.groupBy("bucket").agg(F.max(F.struct(first.alias("by"), F.col("node").alias("center"), F.col("comp").alias("center_comp"))).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        pairs = placed.join(center.filter("lo <> hi").select("bucket", "c.center", "c.center_comp"), "bucket").filter("comp <> center_comp")
        pairs = pairs.select(F.least("node", "center").alias("u"), F.greatest("node", "center").alias("v")).distinct()
        pairs = saved(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        tested = pairs if tested is None else tested.unionByName(pairs)
        more = links(pairs)
        if more.isEmpty():
            break
        comp = components(more if joined is None else joined.unionByName(more))
        joined = comp.select(F.col("comp").alias("u"), F.col("node").alias("v"))
        placed = saved(placed.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    mixed_buckets = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    # two nodes alone in a bucket have been compared already
    left = saved(placed.filter("size > 2").join(mixed_buckets, "bucket"), "left")
    a, b = left.filter(f"size <= {PAIRED_BUCKET}").alias("a"), left.alias("b")
    near_pairs = a.join(b, F.expr("a.bucket = b.bucket and a.node < b.node and a.comp <> b.comp")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()
    hot = saved(left.filter(f"size > {PAIRED_BUCKET}").select("node", "comp").distinct(), "hot")
    if not hot.isEmpty():
        sets = saved(full_sets(docs, size, id_col, text_col, hot.select(F.col("node").alias("u"), F.col("node").alias("v"))), "sets")
        near_pairs = near_pairs.unionByName(prefix_pairs(sets, hot, hundredths)).distinct()
    if tested is not None:
        more = links(saved(near_pairs.join(tested, ["u", "v"], "left_anti"), "pairs"))
        joined = more if joined is None else joined.unionByName(more)
    if joined is None:
        joined = placed.select(F.col("node").alias("u"), F.col("comp").alias("v")).limit(0)
    repeated = rows.filter("doc_id is not null and set_key is not null").groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo <> hi").select("doc_id")
    if not repeated.isEmpty():
        own = rows.join(repeated, "doc_id").join(copied, "set_key", "left").select("doc_id", F.coalesce("node", "doc_id").alias("node")).filter("doc_id <> node")
        joined = joined.unionByName(own.select(F.col("node").alias("u"), F.col("doc_id").alias("v")))
    comp = components(joined)
    found = rows.join(copied, "set_key", "left").withColumn("node", F.coalesce("node", "doc_id")).join(comp, "node", "left")
    found = found.withColumn("component_id", F.coalesce("comp", "node"))
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that near_duplicates doesn't keep; rows without id or words stay."""
    gone = near_duplicates(docs, size, threshold, id_col, text_col).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
