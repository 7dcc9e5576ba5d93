"""Queries on records: container tags, duplicate records, cached resolutions, durations, sidecars, release matches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mediagraph.operators import records as R
from mediagraph.operators import tags as T
from mediagraph.operators.skew import dealt_out
from mediagraph.plans.registry import query, table
from mediagraph.sources import reports

#: Fields with texts and lists, by their place; a field's value depends on it.
_OWN = ("artist", "website", "url", "rating", "rating_email", "syncedlyrics", "musicip_fingerprint", "total_tracks", "total_discs", "track_number", "disc_number")
_FIELDS = sorted({f for pairs in T.key_map().values() for f, _ in pairs} - set(_OWN)) + ["artist", "website", "url", "musicip_fingerprint"]
_LISTS = ("artists", "album_artists", "performer", "label", "releasetype", "musicbrainz_artistid")
_KEYS = ", ".join(f"('{family}', '{key}', {_FIELDS.index(f)}, {f in _LISTS})" for family, pairs in T.key_map().items() for f, key in pairs if f in _FIELDS and not (family == "vorbis" and f == "musicip_fingerprint"))
_AT = _FIELDS.index
_VAL = "CASE (p_partkey + {0}) % 4 WHEN 2 THEN p_brand || CAST({0} AS VARCHAR) WHEN 3 THEN CAST(p_size AS VARCHAR) || CAST({0} AS VARCHAR) END"
_EXT = ("flac", "OGG", "opus", "mp3", "wav", "aiff", "m4a", "wma", "ape")

_TAGS = f"""WITH k(family, key, i, listed) AS (VALUES {_KEYS}),
t AS (SELECT *, p_size AS tn, CASE WHEN p_size % 2 = 0 THEN p_size + 3 END AS tt, CASE WHEN p_size % 3 > 0 THEN p_size % 3 END AS dn, CASE WHEN p_size % 5 > 0 THEN 2 END AS td,
  CASE WHEN p_partkey % 9 < 3 THEN 'vorbis' WHEN p_partkey % 9 < 6 THEN 'frames' WHEN p_partkey % 9 = 6 THEN 'atoms' WHEN p_partkey % 9 = 7 THEN 'attributes' END AS family,
  {_VAL.format(_AT("artists"))} AS a, {_VAL.format(_AT("artist"))} AS b, {_VAL.format(_AT("website"))} AS w, {_VAL.format(_AT("url"))} AS u, {_VAL.format(_AT("musicip_fingerprint"))} AS fp FROM part),
o AS (SELECT p_partkey, key, CASE WHEN listed THEN concat_ws('|', {_VAL.format("i")}, p_type, p_type) ELSE {_VAL.format("i")} END AS v FROM t JOIN k USING (family)
UNION ALL SELECT p_partkey, unnest(['TRACKTOTAL', 'TOTALTRACKS']), tt::VARCHAR FROM t WHERE family = 'vorbis' UNION ALL SELECT p_partkey, unnest(['DISCTOTAL', 'TOTALDISCS']), td::VARCHAR FROM t WHERE family = 'vorbis'
UNION ALL SELECT p_partkey, 'TRACKNUMBER', tn::VARCHAR FROM t WHERE family = 'vorbis' UNION ALL SELECT p_partkey, 'DISCNUMBER', dn::VARCHAR FROM t WHERE family = 'vorbis'
UNION ALL SELECT p_partkey, 'WEBSITE', CASE WHEN (p_partkey + {_AT("website")}) % 4 = 1 THEN NULL ELSE coalesce(w, u) END FROM t WHERE family = 'vorbis'
UNION ALL SELECT p_partkey, 'FINGERPRINT', 'MusicMagic Fingerprint ' || fp FROM t WHERE family = 'vorbis'
UNION ALL SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'RATING:' || p_brand ELSE 'RATING' END, (p_size % 6)::VARCHAR FROM t WHERE family = 'vorbis'
UNION ALL SELECT p_partkey, CASE family WHEN 'frames' THEN 'TPE1' WHEN 'atoms' THEN '\xa9ART' ELSE 'Author' END, concat_ws('; ', a, p_type, p_type) FROM t WHERE family <> 'vorbis'
UNION ALL SELECT p_partkey, 'TRCK', concat_ws('/', tn::VARCHAR, tt::VARCHAR) FROM t WHERE family = 'frames'
UNION ALL SELECT p_partkey, CASE family WHEN 'frames' THEN 'TPOS' ELSE 'WM/PartOfSet' END, concat_ws('/', dn::VARCHAR, td::VARCHAR) FROM t WHERE family IN ('frames', 'attributes') AND dn IS NOT NULL
UNION ALL SELECT p_partkey, 'WM/TrackNumber', tn::VARCHAR FROM t WHERE family = 'attributes'
UNION ALL SELECT p_partkey, 'trkn', tn || '|' || coalesce(tt, 0) FROM t WHERE family = 'atoms' UNION ALL SELECT p_partkey, 'disk', dn || '|' || coalesce(td, 0) FROM t WHERE family = 'atoms'
UNION ALL SELECT p_partkey, 'SYLT', '1500 ' || p_brand || '|62250 b' FROM t WHERE family = 'frames' AND p_size % 2 = 0)
SELECT p_partkey, key AS container_key, v AS value FROM o WHERE v IS NOT NULL"""


@query("p32_container_tags", _TAGS)
def p32(s, d):
    """Rows with every field: a quarter of the texts null, a quarter blank, lists with a blank in them."""
    p, size = F.col("p_partkey"), F.col("p_size")

    def value(i: int):
        k = (p + i) % 4
        return F.when(k == 1, "  ").when(k == 2, F.concat(F.lit(" "), "p_brand", F.lit(str(i)))).when(k == 3, F.concat(size, F.lit(f"{i} ")))

    fields = {f: F.array(value(i), F.col("p_type"), F.lit(" "), F.col("p_type")) if f in _LISTS else value(i) for i, f in enumerate(_FIELDS)}
    numbers = {"track_number": size, "total_tracks": F.when(size % 2 == 0, size + 3), "disc_number": F.when(size % 3 > 0, size % 3), "total_discs": F.when(size % 5 > 0, 2)}
    synced = F.when(size % 2 == 0, F.concat(F.lit("[00:01.50] "), "p_brand", F.lit("\n\n[1:02.25]b"))).otherwise("[00:01.50] a\nno time")
    more = {"rating": size % 6, "rating_email": F.when(size % 2 == 0, F.col("p_brand")).otherwise(" "), "syncedlyrics": synced}
    ext = F.concat(F.lit("."), F.element_at(F.array(*map(F.lit, _EXT)), (p % 9 + 1).cast("int")))
    t = dealt_out(table(s, d, "part")).select("p_partkey", ext.alias("ext"), *[c.alias(f) for f, c in (fields | numbers | more).items()])
    return T.container_tags(t, "p_partkey", "ext").select("p_partkey", "container_key", F.array_join("values", "|").alias("value"))


@query(
    "j13_duplicate_records",
    """SELECT c_custkey AS file_id, '/m/' || c_custkey || '.flac' AS path, '.flac' AS extension, 'flac' AS codec, 1000 + c_custkey AS size_bytes, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS duration_seconds,
  c_nationkey * 1000 AS bitrate_bps, 44100 AS sample_rate_hz, 2 AS channels, 16 AS bits_per_sample, CAST(NULL AS VARCHAR) AS content_hash,
  CASE WHEN c_custkey % 6 < 3 AND c_custkey % 4 > 0 THEN 'found' || c_custkey WHEN c_custkey % 5 > 1 THEN 'tag' || c_custkey END AS acoustid_id, CASE WHEN c_custkey % 4 > 0 AND c_custkey % 3 = 0 THEN (c_custkey % 100) / 100.0 END::DOUBLE AS acoustid_score,
  CASE WHEN c_custkey % 4 > 0 AND c_custkey % 9 < 4 THEN 'r' || c_custkey WHEN c_custkey % 2 = 0 THEN 'own' || c_custkey END AS recording_mbid,
  CASE WHEN c_custkey % 11 = 0 THEN 'rel' || c_custkey WHEN c_custkey % 4 > 0 AND c_custkey % 5 IN (1, 2) THEN 'x' || c_custkey END AS release_mbid,
  CASE WHEN c_custkey % 4 > 0 AND c_custkey % 8 > 2 THEN 'isrc' ELSE 'embedded_tags' END AS source, c_name AS title, c_mktsegment AS artist FROM customer""",
)
def j13(s, d):
    """Every fourth file has no resolution; releases of the candidates are none, one, one among blanks, the same one twice, or two."""
    c, k = table(s, d, "customer"), F.col("c_custkey")
    meta = c.select(
        k.alias("file_id"), F.concat(F.lit("/m/"), k, F.lit(".flac")).alias("path"), F.lit(".flac").alias("extension"), F.lit("flac").alias("codec"), (k + 1000).alias("size_bytes"),
        F.when(k % 7 > 0, F.col("c_acctbal")).alias("duration_seconds"), (F.col("c_nationkey") * 1000).alias("bitrate_bps"), F.lit(44100).alias("sample_rate_hz"), F.lit(2).alias("channels"), F.lit(16).alias("bits_per_sample"),
        F.when(k % 5 > 1, F.concat(F.lit("tag"), k)).otherwise(" ").alias("acoustid_id"), F.when(k % 2 == 0, F.concat(F.lit("own"), k)).alias("musicbrainz_recording_id"),
        F.when(k % 11 == 0, F.concat(F.lit("rel"), k)).alias("release_mbid"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("artist"),
    )
    x = F.concat(F.lit("x"), k)
    releases = F.when(k % 5 == 1, F.array(x)).when(k % 5 == 2, F.array(F.lit(" "), F.concat(F.lit(" "), x), F.lit(None))).when(k % 5 == 3, F.array(x, x)).when(k % 5 == 4, F.array(x, F.lit("y")))
    found = c.filter("c_custkey % 4 > 0").select(
        k.alias("file_id"), F.when(k % 8 > 2, F.lit(" isrc ")).otherwise(" ").alias("source"), F.when(k % 9 < 4, F.concat(F.lit("r"), k)).otherwise("").alias("recording_mbid"),
        F.when(k % 6 < 3, F.concat(F.lit("found"), k)).alias("acoustid_id"), F.when(k % 3 == 0, ((k % 100) / 100).cast("string")).otherwise("unknown").alias("acoustid_score"), releases.alias("candidate_release_mbids"),
    )
    return R.duplicate_records(meta, found)


@query(
    "p33_cached_payload",
    """SELECT event_id, event_id % 8 NOT IN (0, 1, 2, 3) AS hit, CASE WHEN event_id % 8 > 3 THEN 'resolved' END AS status, CASE WHEN event_id % 8 > 3 THEN event_type END AS source, CASE WHEN event_id % 8 = 5 THEN user_id::VARCHAR END AS recording_mbid,
  CASE WHEN event_id % 8 = 6 THEN 0.5 END::DOUBLE AS acoustid_score, CASE WHEN event_id % 8 = 7 THEN 'a|' || user_id WHEN event_id % 8 > 3 THEN '' END AS releases FROM events""",
)
def p33(s, d):
    """No JSON, a list, no source, a text for a list; a number for a text, a score as text, a null list, a list with blanks."""
    k, user = F.col("event_id") % 8, F.col("user_id").cast("string")
    head = F.concat(F.lit('{"status": " resolved ", "source": "'), "event_type", F.lit('"'))
    tail = F.when(k == 3, F.lit(', "candidate_release_mbids": "a"}')).when(k == 5, F.concat(F.lit(', "recording_mbid": '), user, F.lit(', "isrc": " ", "candidate_release_mbids": []}'))).when(k == 6, F.lit(', "acoustid_score": "0.5", "candidate_release_mbids": null}'))
    tail = tail.when(k == 7, F.concat(F.lit(', "acoustid_score": "high", "candidate_release_mbids": [" a", null, " ", '), user, F.lit("]}"))).otherwise("}")
    payload = F.when(k == 0, F.lit("{broken")).when(k == 1, F.concat(F.lit("["), head, F.lit("}]"))).when(k == 2, F.lit('{"status": "resolved", "source": " "}')).otherwise(F.concat(head, tail))
    r = R.cached_resolution(payload)
    picked = [r[f].alias(f) for f in ("status", "source", "recording_mbid", "acoustid_score")]
    return table(s, d, "events").select("event_id", r.isNotNull().alias("hit"), *picked, F.array_join(r["candidate_release_mbids"], "|").alias("releases"))


@query("p37_first_duration", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 1.5 WHEN 1 THEN p_retailprice WHEN 2 THEN p_size WHEN 3 THEN 3.5 WHEN 4 THEN p_size + 1 END::DOUBLE AS v FROM part")
def p37(s, d):
    """Each field is the first known one of a sixth of the rows; later ones are known too."""
    k = F.col("p_size") % 6
    values = (F.when(k == 0, 1.5), F.when(k <= 1, F.col("p_retailprice")), F.when(k <= 2, F.col("p_size")), F.when(k <= 3, 3.5), F.when(k <= 4, F.col("p_size") + 1))
    t = table(s, d, "part").select("p_partkey", *[v.alias(c) for c, v in zip(R.DURATION_FIELDS, values, strict=True)])
    return t.select("p_partkey", R.first_duration(t).alias("v"))


@query("s13_sidecars", "SELECT CASE doc_id % 4 WHEN 0 THEN '/l.x/' || doc_id WHEN 1 THEN '/l/.' || doc_id ELSE '/l/' || doc_id || CASE WHEN doc_id % 4 = 3 THEN '.b' ELSE '' END END || '.lrc' AS lrc_path, text FROM documents WHERE doc_id % 3 > 0 AND trim(text, ' ') <> ''")
def s13(s, d):
    """Names without a dot (in a folder with one), with only a leading one, with one and with two."""
    k = F.col("doc_id") % 4
    name = F.when(k == 0, F.concat(F.lit("/l.x/"), "doc_id")).when(k == 1, F.concat(F.lit("/l/."), "doc_id")).when(k == 2, F.concat(F.lit("/l/"), "doc_id", F.lit(".flac"))).otherwise(F.concat(F.lit("/l/"), "doc_id", F.lit(".b.flac")))
    return R.lyrics_sidecars(table(s, d, "documents").select(name.alias("path"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise(" ").alias("lyrics")), "path", "lyrics")


@query(
    "j8_candidate_match",
    """WITH l AS (SELECT l_suppkey AS cluster, l_orderkey * 10 + l_linenumber AS file, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS own, l_partkey, l_partkey + 1 AS other FROM lineitem),
t AS (SELECT p_brand AS release, p_partkey AS rec FROM part UNION ALL SELECT p_brand, p_partkey FROM part WHERE p_size = 7),
m AS (SELECT cluster, release, count(DISTINCT file) AS matched FROM (SELECT cluster, file, l_partkey AS rec FROM l UNION SELECT cluster, file, other FROM l) JOIN t USING (rec) GROUP BY ALL),
n AS (SELECT cluster, own AS rec, count(*) AS n FROM l WHERE own IS NOT NULL GROUP BY ALL), o AS (SELECT release, rec, count(*) AS m FROM t GROUP BY ALL),
b AS (SELECT cluster, release, sum(n)::BIGINT AS x, sum(m)::BIGINT AS y FROM n JOIN o USING (rec) GROUP BY ALL)
SELECT cluster, release, matched, coalesce(x, 0) AS local_primary, coalesce(y, 0) AS release_primary FROM m LEFT JOIN b USING (cluster, release)""",
)
def j8(s, d):
    """Suppliers' lines as files, each with two candidates, every other one with a recording of its own; brands as releases, some of whose tracks repeat."""
    part, text = F.col("l_partkey"), lambda c: c.cast("string")
    local = table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("cluster"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file"), F.when(F.col("l_linenumber") % 2 == 0, text(part)).alias("recording"),
        F.array(text(part), text(part + 1), text(part)).alias("candidates"),
    )
    p = table(s, d, "part")
    tracks = p.unionByName(p.filter("p_size = 7")).select(F.col("p_brand").alias("release"), F.col("p_partkey").alias("place"), text(F.col("p_partkey")).alias("recording"))
    return R.release_matches(local, tracks)


@query(
    "s12_grouping_text",
    """WITH c AS (SELECT p_size AS k, count(*) AS files, min(p_retailprice)::VARCHAR AS low FROM part GROUP BY 1),
r AS (SELECT p_size AS k, p_brand AS rel, count(*) AS score, row_number() OVER (PARTITION BY p_size ORDER BY count(*) DESC, p_brand) AS rk FROM part WHERE p_size % 5 > 0 GROUP BY p_size, p_brand),
b AS (SELECT k, max(score) AS best, list('            ' || rk || '. ' || rel || ' | ' || score || ' | ' || CASE rk % 3 WHEN 0 THEN 'no reasons' WHEN 1 THEN 'a; b; c' ELSE 'a' END ORDER BY rk) AS tops FROM r WHERE rk <= 3 GROUP BY k),
l AS (SELECT 1 AS section, k, '        ' || k || '. ' || files || ' track(s)' AS line FROM c
UNION ALL SELECT 2, c.k, unnest(list_concat(['Cluster ' || c.k || ':', '    Release selection:', '        status: ' || CASE WHEN c.k % 5 = 0 THEN 'unmatched' ELSE 'selected' END, '        selected_release_mbid: ' || CASE WHEN c.k % 5 = 0 THEN 'missing' ELSE 'R' || c.k END,
  '        score: ' || coalesce(best::VARCHAR, 'n/a'), '        album: ' || CASE c.k % 3 WHEN 0 THEN 'missing' ELSE 'Album ' || c.k END, '        album_artist: ' || CASE c.k % 4 WHEN 1 THEN 'X' ELSE 'missing' END, '        date: missing', '        matched_track_count: ' || c.k % 6,
  '        total_track_count: ' || files, '        top candidates:'], coalesce(tops, ['            none']), CASE WHEN c.k % 5 = 0 THEN ['        reason: no candidates'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN c.k % 7 = 0 THEN ['        error: late'] ELSE CAST([] AS VARCHAR[]) END, [''])) FROM c LEFT JOIN b USING (k)
UNION ALL SELECT 3, p_partkey, unnest(list_concat(['original:', '    /in/' || p_partkey, 'output:', '    /out/' || p_partkey, 'status:', '    ' || p_brand], CASE WHEN p_size % 2 = 0 THEN ['reason:', '    ' || p_type] ELSE CAST([] AS VARCHAR[]) END)) FROM part
UNION ALL SELECT 4, p_partkey, 'found ' || p_name FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT 1, 0, unnest(['Album clustering:', '    cluster_count: ' || (SELECT count(*) FROM c), '    clusters:', '']) UNION ALL SELECT 2, 0, 'Release selection details:' UNION ALL SELECT 3, 0, unnest(['Planned files:', '']) UNION ALL SELECT 4, 0, 'Lyrics progress:')
SELECT section, k AS item, line, count(*) AS times FROM l GROUP BY ALL""",
)
def s12(s, d):
    """Sizes as clusters, their brands as candidates (none for a fifth of them), parts as files."""
    p, k = table(s, d, "part"), F.col("p_size")
    clusters = p.select(k.alias("cluster"), F.col("p_partkey").alias("file"))
    sizes = p.groupBy(k.alias("cluster")).agg(F.count("*").alias("tracks"))
    c, none = F.col("cluster"), F.lit(None).cast("string")
    selections = sizes.select(
        "cluster", F.when(c % 5 == 0, "unmatched").otherwise("selected").alias("status"), F.when(c % 5 > 0, F.concat(F.lit("R"), c)).alias("release"), F.when(c % 3 > 0, F.concat(F.lit("Album "), c)).alias("album"),
        F.when(c % 4 == 1, "X").otherwise("").alias("album_artist"), none.alias("date"), (c % 6).alias("matched"), "tracks", F.when(c % 5 == 0, "no candidates").alias("reason"), F.when(c % 7 == 0, "late").alias("error"),
    )
    scored = p.filter("p_size % 5 > 0").groupBy(k.alias("cluster"), F.col("p_brand").alias("release")).agg(F.count("*").alias("score"))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "release")))
    reasons = F.when(F.col("rank") % 3 == 0, F.array().cast("array<string>")).when(F.col("rank") % 3 == 1, F.array(*map(F.lit, "abcd"))).otherwise(F.array(F.lit("a")))
    key = F.col("p_partkey")
    planned = p.select(key.alias("file"), F.concat(F.lit("/in/"), key).alias("original_path"), F.concat(F.lit("/out/"), key).alias("output_path"), F.col("p_brand").alias("status"), F.when(k % 2 == 0, F.col("p_type")).alias("reason"))
    lyrics = p.filter("p_partkey % 10 = 0").select(key.alias("file"), F.concat(F.lit("found "), "p_name").alias("line"))
    lines = reports.grouping_report(clusters, selections, scored.withColumn("reasons", reasons), planned, lyrics)
    return lines.groupBy("section", "item", "line").agg(F.count("*").alias("times"))
