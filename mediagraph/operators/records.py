"""Records of files put together from several sources: duplicates, cached resolutions, durations, sidecars, release matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagraph.functions.text import clean, first_clean

#: The columns of a file's record in the search for duplicates, in order.
RECORD_COLUMNS = (
    "file_id", "path", "extension", "codec", "size_bytes", "duration_seconds", "bitrate_bps", "sample_rate_hz", "channels", "bits_per_sample", "content_hash", "acoustid_id", "acoustid_score", "recording_mbid",
    "release_mbid", "source", "title", "artist",
)
#: The fields that may hold a track's duration, the first known one counts.
DURATION_FIELDS = ("duration_seconds", "duration", "track_duration_seconds", "audio_duration_seconds", "length_seconds")
#: Texts and lists of a cached resolution.
RESOLUTION_TEXTS = ("status", "source", "recording_mbid", "isrc", "acoustid_id", "error")
RESOLUTION_LISTS = ("candidate_recording_mbids", "candidate_release_mbids", "candidate_release_group_mbids")


def only_one(candidates: Column) -> Column:
    """The one text of a list that isn't blank; null where there are none or several, equal ones too."""
    named = F.array_compact(F.transform(candidates, clean))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def duplicate_records(metadata: DataFrame, resolutions: DataFrame, file: str = "file_id") -> DataFrame:
    """A row of RECORD_COLUMNS for each row of metadata; content hashes are still unknown.

    metadata: file and the columns of the same names (the file's own recording as musicbrainz_recording_id); resolutions: file, source,
    recording_mbid, acoustid_id, acoustid_score and candidate_release_mbids. What resolution found goes before what the tags say. A file
    without a release of its own has that of its candidates, if it is the only one. Files without a resolution keep what their tags say.
    """
    found = resolutions.select(file, *[F.col(c).alias(f"_{c}") for c in ("source", "recording_mbid", "acoustid_id", "acoustid_score", "candidate_release_mbids")])
    made = {
        "content_hash": F.lit(None).cast("string"), "acoustid_id": first_clean(F.col("_acoustid_id"), F.col("acoustid_id")), "acoustid_score": F.col("_acoustid_score").cast("string").try_cast("double"),
        "recording_mbid": first_clean(F.col("_recording_mbid"), F.col("musicbrainz_recording_id")), "release_mbid": F.coalesce("release_mbid", only_one(F.col("_candidate_release_mbids"))),
        "source": first_clean(F.col("_source"), F.lit("embedded_tags")),
    }
    return metadata.join(found, file, "left").select(*[made.get(c, F.col(file if c == "file_id" else c)).alias(c) for c in RECORD_COLUMNS])


def cached_resolution(payload: Column) -> Column:
    """A cached resolution from its JSON text, with what is missing filled in; null for a miss.

    A miss is a text that is no JSON object, one without a status or source, and one with a field for a list that is something else.
    Texts are trimmed, blank ones null; lists lose what is null or blank.
    """
    v = F.try_parse_json(payload)
    text = {f: clean(F.try_variant_get(v, f"$.{f}", "string")) for f in RESOLUTION_TEXTS}
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    items = {f: F.when(kind(f"$.{f}") != "VOID", F.transform(F.try_variant_get(v, f"$.{f}", "array<variant>"), lambda x: clean(F.try_variant_get(x, "$", "string")))) for f in RESOLUTION_LISTS}
    lists = {f: F.array_compact(F.coalesce(c, F.array().cast("array<string>"))) for f, c in items.items()}
    bad = F.lit(False)
    for f in RESOLUTION_LISTS:
        bad = bad | ~(kind(f"$.{f}").startswith("ARRAY") | (kind(f"$.{f}") == "VOID"))
    hit = kind("$").startswith("OBJECT") & text["status"].isNotNull() & text["source"].isNotNull() & ~bad
    numbers = [F.try_variant_get(v, "$.acoustid_score", "double").alias("acoustid_score"), *[F.try_variant_get(v, f"$.{f}", "int").alias(f) for f in ("track_number", "disc_number")]]
    return F.when(hit, F.struct(*[c.alias(f) for f, c in text.items()], *numbers, *[c.alias(f) for f, c in lists.items()]))


def first_duration(df: DataFrame) -> Column:
    """The first of DURATION_FIELDS that isn't null, of those that df has."""
    return F.coalesce(*[F.col(c).cast("double") for c in DURATION_FIELDS if c in df.columns], F.lit(None).cast("double"))


def lyrics_sidecars(rows: DataFrame, path: str, lyrics: str) -> DataFrame:
    """lrc_path and text of each row that has synced lyrics: the audio file's path with another extension (or with one, where it has
    none; a name that begins with its only dot has none)."""
    named = F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit(".lrc"))
    return rows.filter(clean(F.col(lyrics)).isNotNull()).select(named.alias("lrc_path"), F.col(lyrics).alias("text"))


def release_matches(local: DataFrame, tracks: DataFrame) -> DataFrame:
    """cluster, release, matched, local_primary and release_primary: how many of a cluster's files have a candidate among the release's
    recordings, how many have their own recording there, and how many of the release's tracks have one of these recordings.

    local: cluster, file, recording, candidates (texts); tracks: release, place, recording. Files and recordings are joined by
    recording, never a cluster with a release; repeats of a file's candidates and of a release's recording count once for a file.
    """
    on = tracks.select("release", "recording").distinct()
    wanted = local.select("cluster", "file", F.explode(F.array_distinct("candidates")).alias("recording")).join(on, "recording")
    matched = wanted.groupBy("cluster", "release").agg(F.count_distinct("file").alias("matched"))
    primary = local.groupBy("cluster", "recording").agg(F.count("*").alias("n")).filter(clean(F.col("recording")).isNotNull())
    times = tracks.groupBy("release", "recording").agg(F.count("*").alias("m"))
    both = primary.join(times, "recording").groupBy("cluster", "release").agg(F.sum("n").alias("local_primary"), F.sum("m").alias("release_primary"))
    out = matched.join(both, ["cluster", "release"], "full")
    return out.select("cluster", "release", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matched", "local_primary", "release_primary")])
