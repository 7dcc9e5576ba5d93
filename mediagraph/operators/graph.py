"""Album grouping: a weighted graph of files that share candidate releases, and its components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of which one task makes groups or pairs: larger tables are dealt out over more tasks.
ROWS_AT_ONCE = 1_000_000

_LOCAL_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, in the shared folder that the session names in spark.checkpoint.dir.

    Where the session names none, a temporary folder serves a local master only: on a cluster, executors would write to their own disks.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL_ROOTS.setdefault(app, tempfile.mkdtemp(prefix="spark-"))
    return f"{root}/mediagraph/{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}/{name}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables. Results that are still to be computed from them are lost, so call it at the end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared scratch folder and read again: a cut in the lineage that outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left joined with right by sorting both. Spark judges a table by its files, which for names that repeat are a small part of its rows:
    to broadcast them would bring them to the driver."""
    return left.join(right.hint("merge"), on, how)


def stars(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id it reaches) of each end of edges (a, b), by alternating large-star and small-star steps.

    An edge of an id with itself is none. Each round is written to the shared scratch folder. A component is done when every edge of it
    joins its smallest id with one that has no other; later rounds leave it out, and rounds end when none is left.
    """
    e = saved(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    done: list[DataFrame] = []
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v")
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lower, "v").filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        e = saved(small.unionByName(lower.select(F.col("m").alias("u"), "v")).distinct(), "edges")
        sides = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u")
        ends = sides.agg(F.count_if(F.expr("v < u")).alias("below"), F.count_if(F.expr("v > u")).alias("above"))
        mixed = saved(ends.filter("below > 1 or below = 1 and above > 0").select("u"), "mixed")
        if mixed.isEmpty():
            break
        # of a component that isn't done, each edge begins at such an id or at one that is joined with such an id
        begun = mixed.unionByName(e.join(mixed.select(F.col("u").alias("v")), "v", "left_semi").select("u"))
        begun = saved(begun.distinct(), "begun")
        done.append(e.join(begun, "u", "left_anti"))
        e = saved(e.join(begun, "u", "left_semi"), "edges")
    for one in done:
        e = e.unionByName(one)
    roots = e.select("u").distinct().select(F.col("u").alias("id"), F.col("u").alias("component"))
    return e.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)


def connected(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of each vertex; edges: a, b."""
    known = vertices.select("id").distinct()
    return known.join(stars(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def shared_weights(candidates: DataFrame, least: int = 2) -> DataFrame:
    """a, b and weight: 2 for each shared release, 1 for each shared release group, 1 more for one parent folder; from least up.

    candidates: file, release, release_group, parent. The exact pair table is for reports; grouping itself uses stars in album_groups.
    """
    rows = candidates.join(candidates.groupBy("file").agg(F.min("parent").alias("_parent")), "file").select("file", "release", "release_group", "_parent")
    rows = saved(rows.distinct(), "files")

    def own(key: str) -> DataFrame:
        return rows.select("file", "_parent", F.col(key).alias("key")).filter("key is not null").distinct()

    sizes = [own(key).groupBy("key").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.expr("n * (n - 1) div 2"))).first() for key in ("release", "release_group")]
    files, linked = (sum(x[i] or 0 for x in sizes) for i in (0, 1))
    parts = lambda n: max(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_AT_ONCE))

    def pairs(key: str, w: int) -> DataFrame:
        # a file's folder goes with it, so that pairs, of which there are more, aren't joined with folders
        dealt = own(key).repartition(parts(files), "key")
        same = F.coalesce((F.col("a._parent") == F.col("b._parent")).cast("int"), F.lit(0))
        return dealt.alias("a").join(dealt.alias("b"), F.expr("a.key = b.key and a.file < b.file")).select(F.col("a.file").alias("a"), F.col("b.file").alias("b"), F.lit(w).alias("w"), same.alias("same"))

    every = pairs("release", 2).unionByName(pairs("release_group", 1)).repartition(parts(linked), "a", "b")
    return every.groupBy("a", "b").agg((F.sum("w") + F.max("same")).alias("weight")).filter(F.col("weight") >= least)


def _hub_edges(rows: DataFrame, node: str, *key: str) -> DataFrame:
    """Edges (a, b) that join the nodes of each key with its smallest one."""
    own = rows.select(node, *key).dropna(subset=list(key)).distinct()
    hub = own.groupBy(*key).agg(F.min(node).alias("a"), F.max(node).alias("_last")).filter(F.col("a") < F.col("_last")).drop("_last")
    return own.join(hub, list(key)).filter(F.col(node) != F.col("a")).select("a", F.col(node).alias("b"))


def album_groups(candidates: DataFrame) -> DataFrame:
    """file and cluster for each file with candidates, as by the edges of shared_weights from 2 up; a cluster is named by its smallest file.

    First come the files that share a release, or a group in a folder. Two groups can only join further clusters if both of them lie
    in more than one of those, so only such groups are paired, and the pairs join clusters instead of files.
    """
    parents = candidates.groupBy("file").agg(F.min("parent").alias("parent"))
    groups = saved(candidates.select("file", F.col("release_group").alias("g")).filter("g is not null").distinct(), "groups")
    near = _hub_edges(candidates, "file", "release").unionByName(_hub_edges(groups.join(parents, "file"), "file", "g", "parent"))
    near = saved(connected(candidates.select(F.col("file").alias("id")), near).select(F.col("id").alias("file"), "component"), "near")
    placed = groups.join(near, "file")
    spread = placed.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("g")
    held = placed.join(spread, "g", "left_semi").groupBy("file").agg(F.min("component").alias("component"), F.array_sort(F.collect_set("g")).alias("gs")).filter(F.size("gs") > 1)
    pairs = held.select("component", "gs", F.explode("gs").alias("x")).select("component", "x", F.explode("gs").alias("y")).filter("x < y")
    far = stars(_hub_edges(pairs, "component", "x", "y")).select(F.col("id").alias("component"), F.col("component").alias("cluster"))
    return near.join(far, "component", "left").select("file", F.coalesce("cluster", "component").alias("cluster"))


def candidate_counts(candidates: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, release and the number of the cluster's files that have it."""
    return candidates.filter("release is not null").join(clusters, "file").groupBy("cluster", "release").agg(F.count_distinct("file").alias("files"))
