"""Ingest of lookup results, releases, transcripts and fingerprint texts; media file listing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagraph.functions.text import clean, distinct_clean
from mediagraph.sources.releases import canonical_tracks

#: Extensions of media files.
MEDIA_EXTENSIONS = (".mp3", ".flac", ".m4a", ".ogg", ".opus", ".wav", ".aiff", ".wma")


def media_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = MEDIA_EXTENSIONS) -> DataFrame:
    """path, extension, size_bytes and mtime of the files of these kinds under root; contents aren't read, a missing root raises."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return listed.withColumn("extension", ext).filter(F.col("extension").isin(*extensions))


def fingerprint_text(text: Column) -> Column:
    """duration and fingerprint of KEY=VALUE lines, or an error."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    value = lambda k: F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, rf"^{k}=(.*)$", 1)), lambda x: x != ""), F.lit(0))
    duration, mark = value("DURATION").try_cast("double"), value("FINGERPRINT")
    bad = F.exists(lines, lambda x: ~F.contains(x, F.lit("="))) | duration.isNull() | mark.isNull()
    return F.struct(F.when(~bad, duration).alias("duration"), F.when(~bad, mark).alias("fingerprint"), F.when(bad, "unreadable fingerprint text").alias("error"))


#: The keys whose lists name recordings, releases and release groups.
ID_LISTS = {"recordings": "recordings", "releases": "releases", "groups": "releasegroups"}


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def ids_in(text: str, names: list[str]) -> list[list[str]]:
    """For each of names, the distinct ids of the objects in lists of that name at any depth of a JSON text, those of an object before
    those of what it holds, else in the order of the text; ids that aren't texts, or are blank, don't count."""
    found: dict[str, dict[str, None]] = {n: {} for n in names}
    ahead = [json.loads(text, parse_int=float)]
    while ahead:
        node = ahead.pop()
        if isinstance(node, dict):
            for name in names:
                listed = node.get(name)
                if isinstance(listed, list):
                    ids = (x["id"].strip(" ") for x in listed if isinstance(x, dict) and isinstance(x.get("id"), str))
                    found[name].update((x, None) for x in ids if x)
            node = list(node.values())
        ahead += [x for x in reversed(node) if isinstance(x, (dict, list))] if isinstance(node, list) else []
    # half of a surrogate pair becomes a question mark, as in Spark's own texts
    return [[x if x.isascii() else x.encode("utf-8", "replace").decode() for x in ids] for ids in found.values()]


def nested_ids(nodes: DataFrame, json: str, lists: dict[str, str]) -> DataFrame:
    """nodes without their column of JSON texts and, for each of lists, what ids_in finds under that name; none for a null text. Texts
    are as from_json gives them back. Each is read once, where its row is: no row moves."""
    kept = [c for c in nodes.columns if c != json]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(lists.values())
        for batch in batches:
            found = [ids_in(x, names) if x is not None else [[] for _ in names] for x in batch.column(json).to_pylist()]
            ids = [pa.array([x[i] for x in found], pa.list_(pa.string())) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *ids], names=[*kept, *lists])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name != json] + [f"`{c}` array<string>" for c in lists]
    return nodes.mapInArrow(read, ", ".join(fields))


def lookup_results(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, index, id, score and r (its JSON text) of each result with an id that is a text."""
    results = df.select(key, F.posexplode(F.from_json(json, "struct<results:array<string>>")["results"]).alias("index", "r"))
    results = results.withColumn("v", F.from_json("r", "struct<id:variant,score:string>")).filter(_is(F.col("v.id"), "STRING"))
    return results.select(key, "index", clean(F.col("v.id").cast("string")).alias("id"), F.col("v.score").try_cast("double").alias("score"), "r").filter("id is not null")


def lookup_candidates(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, index, id, score, recordings, releases and groups of each result with an id; ids of recordings, releases and release groups
    are taken from any depth of the result."""
    return nested_ids(lookup_results(df, key, json), "r", ID_LISTS).select(key, "index", "id", "score", *ID_LISTS)


def recording_lookup(json: Column) -> Column:
    """Recording and release ids of a lookup by recording or by code."""
    p = F.from_json(json, "struct<recording:struct<id:string,`release-list`:array<struct<id:string>>>,isrc:struct<`recording-list`:array<struct<id:string,`release-list`:array<struct<id:string>>>>>,`recording-list`:array<struct<id:string>>,releases:array<struct<id:string>>>")
    own = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    recordings = F.concat(F.array(p["recording"]["id"]), own(p["isrc"]["recording-list"]["id"]), own(p["recording-list"]["id"]))
    releases = F.concat(own(p["recording"]["release-list"]["id"]), own(p["releases"]["id"]))
    kept = lambda a: distinct_clean(F.filter(a, lambda x: x.isNotNull()))
    return F.struct(kept(recordings).alias("recordings"), kept(releases).alias("releases"))


def release_tracks(df: DataFrame, json: str) -> DataFrame:
    """A row for each track of each release: release, disc, discs, position, track, title, recording; either spelling of the lists."""
    rows = canonical_tracks(df, json)
    return rows.select(F.col("release_mbid").alias("release"), F.col("disc_number").alias("disc"), F.col("total_discs").alias("discs"), F.col("track_number").alias("position"), F.col("track_mbid").alias("track"), "title", F.col("recording_mbid").alias("recording"))


def release_summary(json: Column) -> Column:
    """album, album_artist and date of a selected release: its credit phrase, else the names of its credits one after the other."""
    shape = "struct<title:string,date:string,`artist-credit-phrase`:string,`artist-credit`:array<string>>"
    r = F.from_json(json, shape)
    # a credit is a text between names or an object with an artist
    part = lambda x: F.when(x.startswith("{"), F.coalesce(F.trim(F.get_json_object(x, "$.artist.name")), F.lit(""))).otherwise(x)
    joined = F.array_join(F.transform(r["artist-credit"], lambda x: F.coalesce(part(x), F.lit(""))), "")
    return F.struct(r["title"].alias("album"), F.coalesce(clean(r["artist-credit-phrase"]), clean(joined)).alias("album_artist"), r["date"].alias("date"))


def transcript_segments(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, seg_no, start_s, end_s and text; blank texts are left out, bad offsets make both 0."""
    p = df.select(key, F.posexplode(F.from_json(json, "struct<segments:array<struct<text:string,start:string,end:string>>>")["segments"]).alias("seg_no", "s")).filter(clean(F.col("s.text")).isNotNull())
    start, end = F.col("s.start").try_cast("double") / 1000, F.col("s.end").try_cast("double") / 1000
    bad = start.isNull() | end.isNull()
    return p.select(key, "seg_no", F.when(bad, 0.0).otherwise(start).alias("start_s"), F.when(bad, 0.0).otherwise(end).alias("end_s"), F.trim("s.text").alias("text"))


def lyrics_search(df: DataFrame, json: str) -> DataFrame:
    """Catalogue rows from search results with either naming of their fields; without title or artist a row is left out."""
    p = F.from_json(json, "array<struct<id:long,trackName:string,name:string,title:string,artistName:string,artist:string,albumName:string,album:string,duration:double,plainLyrics:string,plain_lyrics:string,syncedLyrics:string,synced_lyrics:string,instrumental:boolean>>")
    r = df.select(F.explode(p).alias("r"))
    pick = lambda *n: F.coalesce(*[clean(F.col(f"r.{x}")) for x in n])
    out = r.select("r.id", pick("trackName", "name", "title").alias("title"), pick("artistName", "artist").alias("artist"), pick("albumName", "album").alias("album"), "r.duration", pick("plainLyrics", "plain_lyrics").alias("plain"), pick("syncedLyrics", "synced_lyrics").alias("synced"), F.coalesce("r.instrumental", F.lit(False)).alias("instrumental"))
    return out.filter("title is not null and artist is not null")
