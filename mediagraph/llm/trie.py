"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns. From the deepest shared turn on, each round takes the conversations that end there and
the nodes that have survived from the turn below, strips the last turn of the latter, and groups both by what is left: one row for each
node, with counts, sums and smallest ids of all below it, found while the nodes are. What has moved up is one row a node, however many
conversations run through it.

Conversations that are equal in all turns are one row before the first round, and the part of a conversation that no other shares is
laid out without rounds: prefixes are counted at depths that are powers of two, and from the first such depth at which a conversation
is alone it stays alone. So there are as many rounds as turns that different conversations have in common, up to the next power of two,
however long single ones are.

Turns are known by a 128-bit digest of role and text, prefixes by a chain of them; texts move once, to be ordered.

Edge cases: rows without conv_id belong to no conversation and are left out; turns are ordered by number, a null one first, ties by role,
then text; a null role or text is an empty one; repeated rows are turns each; a conversation without turns is a member of the root; an
empty table has no nodes, not even a root; other columns are not read. The turns of one conversation are ordered in one task (which
spills) and are one row of 24 bytes a turn from then on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.llm.common import saved, scratch_path

#: Ids of one row of the lists that are hashed: 2^10 at most. Such rows are made by all tasks, and streamed in order by one a node.
ID_BITS = 10
#: A parent with more than one in so many of all links is sent to every task: fewer than so many can be.
HEAVY_SHARE = 20_000
TURN = "array<struct<digest:binary,words:int>>"
PREFIXES = "conv_id long, path array<binary>, words array<int>"


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id (long) and its turns in order, each as digest and number of words."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    turns = rows.select("conv_id", F.row_number().over(order).alias("pos"), digest.alias("digest"), words.alias("words"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"))
    return listed.select("conv_id", F.expr("transform(turns, t -> named_struct('digest', t.digest, 'words', t.words))").cast(TURN).alias("turns"))


def rebuilt(arrays: DataFrame, span: int = 20, most: int = 4) -> DataFrame:
    """Saved conv_id and turns where the first h turns of conversation c come from the first of its span (c - c % span), h being the
    CRC-32 of the decimal id by remainder of most."""
    heads = arrays.filter(F.col("conv_id") % span == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = arrays.withColumn("base", F.col("conv_id") - F.col("conv_id") % span).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"))
    met = own.join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.array().cast(TURN)).otherwise(F.expr("slice(head, 1, h)"))
    return met.select("conv_id", F.concat(head, F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")).alias("turns"))


def prefixes(arrays: DataFrame) -> DataFrame:
    """conv_id, the key of each of its prefixes (path) and the words of each turn."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, words = [], []
            for turns in batch.column(1).to_pylist():
                key, path = b"", []
                for turn in turns:
                    key = hashlib.blake2b(key + turn["digest"], digest_size=16).digest()
                    path.append(key)
                paths.append(path)
                words.append([turn["words"] for turn in turns])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int32()))], names=["conv_id", "path", "words"])

    return arrays.select("conv_id", "turns").mapInArrow(chain, PREFIXES)


def key_at(depth) -> object:
    """The key of the first depth turns of path; the root's is empty."""
    return F.coalesce(F.get("path", depth - 1), F.lit("").cast("binary"))


def endings(paths: DataFrame) -> DataFrame:
    """One row for each distinct conversation: key, depth, n_convs (equal ones), conv_id (the smallest), ends_sha256, path and words."""
    parts = (
        paths.withColumn("depth", F.size("path")).withColumn("key", key_at(F.size("path"))).withColumn("part", F.expr(f"shiftright(conv_id, {ID_BITS})"))
        .groupBy("key", "part").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"), F.first("depth").alias("depth"), F.first("path").alias("path"), F.first("words").alias("words"))
    )
    parts = parts.select("key", "part", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("conv_id"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "depth", "path", "words")
    schema = "key binary, depth int, n_convs long, conv_id long, ends_sha256 string, path array<binary>, words array<int>"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by key, then part: only the hash of the key at hand is held."""
        now, digest = None, None

        def done() -> dict:
            return now | {"ends_sha256": digest.hexdigest()}

        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if now is not None and row["key"] == now["key"]:
                    digest.update(b"," + row["ids"].encode())
                    now["n_convs"] += row["n"]
                    continue
                if now is not None:
                    rows.append(done())
                digest = hashlib.sha256(row["ids"].encode())
                now = {"key": row["key"], "depth": row["depth"], "n_convs": row["n"], "conv_id": row["conv_id"], "path": row["path"], "words": row["words"]}
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if now is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=arrow)

    arrow = pa.schema([("key", pa.binary()), ("depth", pa.int32()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string()), ("path", pa.list_(pa.binary())), ("words", pa.list_(pa.int32()))])
    return parts.repartition("key").sortWithinPartitions("key", "part").mapInArrow(hashed, schema)


def with_alone(ends: DataFrame) -> DataFrame:
    """ends with alone: the first power of two of turns at which no other distinct conversation runs along, else null."""
    powers = F.expr("filter(transform(sequence(0, 30), j -> shiftleft(1, j)), d -> d <= depth)")
    anchors = ends.select("key", "path", F.explode(powers).alias("d")).select("key", "d", key_at(F.col("d")).alias("prefix"))
    lonely = anchors.groupBy("d", "prefix").agg(F.count("*").alias("n"), F.min("key").alias("key")).filter("n = 1")
    return ends.join(lonely.groupBy("key").agg(F.min("d").alias("alone")), "key", "left")


NODE = "key binary, up binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def tails(ends: DataFrame) -> DataFrame:
    """The nodes of single conversations, as NODE with known_parent: the parent's id where that is the conversation itself."""

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in NODE.split(", ")] + ["known_parent"]
        kinds = [pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.int64()]
        for batch in batches:
            for row in batch.to_pylist():
                path, n, conv, last, first = row["path"], row["n_convs"], row["conv_id"], row["depth"], row["alone"]
                spared, out = 0, []
                for d in range(last, first - 1, -1):
                    spared += (n - 1) * row["words"][d - 1]
                    out.append((path[d - 1], path[d - 2] if d > 1 else b"", d, conv, n, int(d < last), 1, spared, row["ends_sha256"] if d == last else None, conv if d > first else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return ends.filter("alone is not null").select("path", "n_convs", "conv_id", "depth", "alone", "words", "ends_sha256").mapInArrow(laid_out, f"{NODE}, known_parent long")


def peeled(ends: DataFrame) -> DataFrame | None:
    """Saved nodes of the shared depths, as NODE, level by level from the deepest; None without conversations."""
    spark = ends.sparkSession
    saved_below = F.expr("(n_convs - 1) * aggregate(slice(words, alone, depth - alone + 1), 0L, (s, w) -> s + w)")
    alone = F.col("alone").isNotNull()
    entering = ends.select(
        F.when(alone, F.col("alone") - 1).otherwise(F.col("depth")).alias("level"), "path", "words", "conv_id", "n_convs",
        alone.cast("long").alias("n_children"), alone.cast("long").alias("n_leaves"), F.when(alone, saved_below).otherwise(0).cast("long").alias("saved_tokens"), F.when(~alone, F.col("ends_sha256")).alias("ends_sha256"),
    )
    entering = entering.withColumns({c: F.expr(f"slice({c}, 1, level)") for c in ("path", "words")})
    start, folder = scratch_path(spark, "endings"), scratch_path(spark, "levels")
    entering.write.partitionBy("level").parquet(start)
    arriving = spark.read.schema(entering.schema).parquet(start)
    levels = [r[0] for r in arriving.select("level").distinct().collect()]
    if not levels:
        return None
    columns, below = ["path", "words", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"], None
    for depth in range(max(levels), -1, -1):
        rows = arriving.filter(F.col("level") == depth).select(columns) if depth in levels else None
        if below is not None:
            stripped = below.select(F.slice("path", 1, depth).alias("path"), F.slice("words", 1, depth).alias("words"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
            rows = stripped if rows is None else rows.unionByName(stripped)
        merged = rows.groupBy(key_at(F.lit(depth)).alias("key")).agg(
            F.first("path").alias("path"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("below"), F.sum("saved_tokens").alias("spared"), F.max("ends_sha256").alias("ends_sha256"),
        )
        last = F.coalesce(F.get("words", F.lit(depth - 1)), F.lit(0)) if depth else F.lit(0)
        nodes = merged.select(
            "key", key_at(F.lit(depth - 1)).alias("up"), F.lit(depth).alias("depth"), "path", "words", "conv_id", "n_convs", "n_children",
            F.when(F.col("n_children") == 0, 1).otherwise(F.col("below")).cast("long").alias("n_leaves"), (F.col("spared") + (F.col("n_convs") - 1) * last).alias("saved_tokens"), "ends_sha256",
        )
        at = f"{folder}/depth_{depth}"
        nodes.write.parquet(at)
        below = spark.read.schema(nodes.schema).parquet(at)
    return spark.read.schema(nodes.schema).parquet(*[f"{folder}/depth_{d}" for d in range(max(levels) + 1)]).select([f.split()[0] for f in NODE.split(", ")])


def with_parents(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """nodes with parent_conv_id from upper, all nodes that can have been met by several conversations. Parents of very many nodes are
    told to every task."""
    total = upper.agg(F.sum("n_children")).first()[0] or 0
    named = upper.select(F.col("key").alias("up"), F.col("depth").alias("up_depth"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    is_heavy = F.col("n_children") * HEAVY_SHARE > F.lit(total)
    heavy, others = (named.filter(c).drop("n_children") for c in (is_heavy, ~is_heavy))
    own = nodes.withColumn("up_depth", F.col("depth") - 1)
    at_root, inner = own.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")), own.filter("depth > 0 and known_parent is null")
    alone = own.filter("known_parent is not null").withColumn("parent_conv_id", F.col("known_parent"))
    on = ["up", "up_depth"]
    met = inner.join(F.broadcast(heavy), on)
    rest = inner.join(F.broadcast(heavy.select(on)), on, "left_anti").join(others, on)
    return at_root.unionByName(alone).unionByName(met).unionByName(rest).drop("up_depth", "known_parent")


def trie(arrays: DataFrame) -> DataFrame:
    """One row for each node of the conversations in arrays (conv_id and turns, as turn_arrays gives them; ids are distinct):
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens (of its subtree, itself included),
    ends_sha256 (over the ascending ids of members that end there), and key, the digest of its turns."""
    ends = saved(endings(prefixes(arrays)), "distinct_conversations")
    ends = saved(with_alone(ends), "alone")
    upper, single = peeled(ends), tails(ends)
    if upper is not None:
        shared = upper.withColumn("known_parent", F.lit(None).cast("long"))
        nodes = with_parents(saved(shared.unionByName(single), "nodes"), upper)
    else:
        nodes = single.withColumn("parent_conv_id", F.col("known_parent")).drop("known_parent")
    empty = hashlib.sha256().hexdigest()
    counts = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return nodes.select(*counts, F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), F.hex("key").alias("key"))
