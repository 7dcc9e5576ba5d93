"""Queries of ingest, resolution, release scores, the cache, lyrics and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.functions import text as X
from mediagraph.operators import albums as A
from mediagraph.operators import cache as C
from mediagraph.operators import graph as G
from mediagraph.operators import resolve as R
from mediagraph.plans.registry import query, table
from mediagraph.sources import ingest as I
from mediagraph.sources import releases as V

# -- ingest ------------------------------------------------------------------------------------------------------------------------


@query("s4_fingerprint_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS DOUBLE) END AS duration, CASE WHEN doc_id % 3 = 0 THEN source END AS fingerprint, CASE WHEN doc_id % 3 <> 0 THEN 'unreadable fingerprint text' END AS error FROM documents")
def s4(s, d):
    k = F.col("doc_id") % 3
    text = F.when(k == 0, F.concat(F.lit("DURATION="), "n_chars", F.lit("\nFINGERPRINT="), "source")).when(k == 1, F.concat(F.lit("DURATION=x\nFINGERPRINT="), "source")).otherwise("broken")
    return table(s, d, "documents").select("doc_id", I.fingerprint_text(text).alias("f")).select("doc_id", "f.duration", "f.fingerprint", "f.error")


#: A result: ids at its top, and under other names five and more levels down; blank ids, ids that are numbers, JSON inside a string.
_RESULT = """'{"id":" a' || l_partkey || '","score":' || l_discount || ',"recordings":[{"id":"r' || l_suppkey || '","title":"' || replace('[{"recordings":[{"id":"no"}]}]', '"', chr(92) || '"') || '","releasegroups":[{"id":"g' || l_suppkey % 7
  || '","releases":[{"id":"s' || l_linenumber || '","mediums":[{"tracks":[{"more":{"recordings":[{"id":"d' || l_partkey % 9 || '"},{"id":7},{"id":" "},{"id":"r' || l_suppkey || '"}]}}]}]}]}]}],"z":[[{"releases":[{"id":"y' || l_linenumber % 2
  || '"},3]}]],"b":{"releasegroups":{"id":"no"},"releases":[{"id":" x "},{"id":"s1"}]}}'"""
_S5 = f"""r AS (SELECT row_number() OVER () AS row, l_orderkey AS k, CAST({_RESULT} AS JSON) AS j FROM lineitem),
n AS (SELECT row, j, CAST([] AS BIGINT[]) AS spot FROM r
UNION ALL SELECT row, CASE WHEN json_type(j) = 'OBJECT' THEN json_extract(j, '$."' || c.name || '"') ELSE json_extract(j, '$[' || (c.pos - 1) || ']') END, list_append(spot, c.pos)
  FROM (SELECT row, j, spot, unnest(CASE WHEN json_type(j) = 'OBJECT' THEN list_transform(json_keys(j), lambda x, i: {{'name': x, 'pos': CAST(i AS BIGINT)}})
    ELSE list_transform(range(1, CAST(json_array_length(j) AS BIGINT) + 1), lambda i: {{'name': CAST(NULL AS VARCHAR), 'pos': i}}) END) AS c FROM n WHERE json_type(j) IN ('OBJECT', 'ARRAY')) u),
o AS (SELECT row, spot, kind, unnest(range(0, CAST(json_array_length(json_extract(j, '$.' || kind)) AS BIGINT))) AS p, json_extract(j, '$.' || kind) AS l FROM n, (VALUES ('recordings'), ('releases'), ('releasegroups')) v(kind) WHERE json_type(j) = 'OBJECT' AND json_type(json_extract(j, '$.' || kind)) = 'ARRAY'),
i AS (SELECT row, kind, spot, p, trim(json_extract_string(l, '$[' || p || '].id')) AS id FROM o WHERE json_type(json_extract(l, '$[' || p || '].id')) = 'VARCHAR' AND trim(json_extract_string(l, '$[' || p || '].id')) <> ''),
q AS (SELECT *, row_number() OVER (PARTITION BY row, kind, id ORDER BY spot, p) AS q FROM i),
f AS (SELECT row, kind, list(id ORDER BY spot, p) AS ids FROM q WHERE q = 1 GROUP BY ALL)"""
_OF = "coalesce((SELECT ids FROM f WHERE f.row = r.row AND kind = '{}'), CAST([] AS VARCHAR[]))"


def lookups(s, d) -> DataFrame:
    """Lookup results of each order, one for each of its rows."""
    t = table(s, d, "lineitem").withColumn("r", F.expr(_RESULT))
    return t.groupBy(F.col("l_orderkey").alias("k")).agg(F.concat(F.lit('{"status":"ok","results":['), F.array_join(F.collect_list("r"), ","), F.lit("]}")).alias("j"))


@query("s5_lookup_candidates", f"WITH RECURSIVE {_S5} SELECT k, trim(json_extract_string(j, '$.id')) AS id, CAST(json_extract_string(j, '$.score') AS DOUBLE) AS score, {_OF.format('recordings')} AS recordings, {_OF.format('releases')} AS releases, {_OF.format('releasegroups')} AS groups FROM r")
def s5(s, d):
    return I.lookup_candidates(lookups(s, d), "k", "j").select("k", "id", "score", "recordings", "releases", "groups")


@query(
    "w3_best_candidate",
    """WITH c AS (SELECT l_orderkey AS k, l_linenumber % 3 AS index, 'a' || l_partkey AS id, CASE WHEN l_suppkey % 4 <> 0 THEN l_quantity % 3 / 2 END AS score, l_partkey % 2 AS rec, CASE WHEN l_partkey % 3 = 0 OR l_partkey % 5 = 0 THEN 1 ELSE 0 END AS rel FROM lineitem)
SELECT k, id, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY coalesce(score, -1) DESC, rec DESC, rel DESC, index, id) AS r FROM c) WHERE r = 1""",
)
def w3(s, d):
    """Few scores and places, so that every one of the order's keys decides somewhere."""
    some = lambda c: F.when(c, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    p = F.col("l_partkey")
    c = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 3).alias("index"), F.concat(F.lit("a"), p).alias("id"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_quantity") % 3 / 2).alias("score"),
        some(p % 2 == 1).alias("recordings"), some(p % 3 == 0).alias("releases"), some(p % 5 == 0).alias("groups"),
    )
    return R.best_candidate(c, "k").select("k", "id", "score")


@query("s6_recording_lookup", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['r' || p_size] ELSE ['r' || p_size, p_brand] END AS recordings, CASE WHEN p_size % 2 = 0 THEN [p_type] ELSE CAST([] AS VARCHAR[]) END AS releases FROM part")
def s6(s, d):
    one = F.format_string('{"recording":{"id":"r%d","release-list":[{"id":"%s"}]}}', "p_size", "p_type")
    two = F.format_string('{"isrc":{"recording-list":[{"id":"r%d"},{"id":"%s"},{"id":"r%d"}]}}', "p_size", "p_brand", "p_size")
    return table(s, d, "part").select("p_partkey", I.recording_lookup(F.when(F.col("p_size") % 2 == 0, one).otherwise(two)).alias("x")).select("p_partkey", "x.recordings", "x.releases")


#: A track of an order's release, and the release with its two media, as the service writes them: even orders with the one spelling of
#: lists, odd ones with the other.
_TRACK = """'{"id":"t' || o || '-' || n || '","position":"' || n || '","title":"' || CASE WHEN n % 2 = 0 THEN ' ' ELSE 'T' || p END || '"' || CASE WHEN n % 3 = 0 THEN ',"grouping":"grp"' ELSE '' END
  || ',"recording":{"id":" r' || o || '-' || n || ' ","title":"R' || p || '"' || CASE WHEN n % 4 = 1 THEN ',"artist-credit-phrase":"Phrase"' ELSE '' END
  || CASE WHEN n % 4 = 0 THEN ',"artist-credit":[{"artist":{"id":"A9","name":"Cy","sort-name":" "},"joinphrase":" x "},{"name":"none"}]' ELSE '' END
  || CASE WHEN n % 3 = 1 THEN ',"tags":[{"name":"pop"},{"name":" "},{"name":"pop"},{"name":"folk"}]' ELSE '' END
  || ',"artist-relation-list":[{"type":"Composer","artist":{"name":"Cee"}},{"type":"composer","artist":"Dee"},{"type":"composer","work":{"resource":"Cee"}},{"type":"conductor","target":"Eff"},{"target":"lost"}]'
  || ',"relations":[{"type":"Original Performer","target-credit":"Gee"},{"type":"remix","target":"Aitch"}]' || CASE WHEN n = 5 THEN ',"url-relation-list":[{"target-type":"work","target":"http://no"},{"target-type":"URL","target":"http://t/' || o || '"}]' ELSE '' END || '}}'"""
_RELEASE_JSON = """'{"id":"R' || o || '","title":" Album ' || o || '","date":"' || CASE WHEN o % 5 = 0 THEN '199' ELSE '2001-0' || (o % 9 + 1) END || '","country":"' || CASE WHEN o % 3 = 0 THEN ' ' ELSE 'DE' END || '","barcode":"b' || o || '","status":"Official"'
  || CASE WHEN o % 4 = 0 THEN '' ELSE ',"asin":"a' || o || '"' END || CASE WHEN o % 3 = 1 THEN '' ELSE ',"text-representation":{"script":"Latn"}' END
  || ',"release-group":{"id":"G' || o % 50 || '",' || CASE WHEN o % 2 = 0 THEN '"primary-type":"Album"' ELSE '"type":"Single"' END || CASE WHEN o % 3 = 0 THEN ',"secondary-type-list":["Live"," ","Remix"]' ELSE '' END || ',"first-release-date":"1999-05","tag-list":[{"name":"rock"},{"name":"rock"}]}'
  || CASE WHEN o % 7 = 0 THEN ',"artist-credit-phrase":"Ann and Bob"' ELSE '' END || ',"artist-credit":[{"artist":{"id":"A1","name":"Ann","sort-name":"Ann, A"},"joinphrase":" & "}," & ",{"artist":{"id":"A2","name":" Bob "}}]'
  || ',"label-info-list":[{"label":{"name":"L' || o % 9 || '"},"catalog-number":"C' || o || '"},{"label":{"name":"L' || o % 9 || '"}},{"catalog-number":" "}]' || CASE WHEN o % 5 = 1 THEN ',"genre-list":[{"name":"jazz"}]' ELSE '' END
  || CASE WHEN o % 3 = 0 THEN ',"relation-list":[{"type":"home","url":{"resource":"https://r/' || o || '"}}]' ELSE '' END || CASE WHEN o % 2 = 0 THEN ',"url-relation-list":[{"target":"nothttp"},{"target":"http://u/' || o || '"}]' ELSE '' END
  || ',"' || CASE WHEN o % 2 = 0 THEN 'medium-list' ELSE 'media' END || '":[{"position":"1","format":"CD","title":" ","' || CASE WHEN o % 2 = 0 THEN 'track-list' ELSE 'tracks' END || '":[' || one || ']},{"position":"' || CASE WHEN o % 4 = 1 THEN 'x' ELSE '2' END
  || '","format":"Vinyl","title":"Side","' || CASE WHEN o % 2 = 0 THEN 'track-list' ELSE 'tracks' END || '":[' || two || ']}]}'"""


def releases(s, d, some=None) -> DataFrame:
    """o and the JSON text of each order's release, of all its rows or some; its first three rows are on the first medium."""
    rows = table(s, d, "lineitem")
    t = (rows if some is None else rows.filter(some)).selectExpr("l_orderkey AS o", "l_linenumber AS n", "l_partkey AS p", "l_suppkey AS s").withColumn("t", F.expr(_TRACK))
    texts = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("n", "p", "s", "t")))), lambda x: x["t"]), ",")
    return t.groupBy("o").agg(texts(F.col("n") <= 3).alias("one"), texts(F.col("n") > 3).alias("two")).select("o", F.expr(_RELEASE_JSON).alias("j"))


#: The same tracks by the rules of the row, straight from the table.
_TRACKS = """l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n > 3, n, p, s) - 1 AS place, count(*) OVER (PARTITION BY o, n > 3) AS total FROM l),
x AS (SELECT *, 'r' || o || '-' || n AS rid, CASE WHEN n <= 3 THEN 1 WHEN o % 4 = 1 THEN NULL ELSE 2 END AS disc, CASE WHEN n % 2 = 0 THEN 'R' ELSE 'T' END || p AS title FROM k)"""


@query("s7_release_tracks", f"WITH {_TRACKS} SELECT 'R' || o AS release, disc, 2 AS discs, n AS position, 't' || o || '-' || n AS track, title, rid AS recording FROM x")
def s7(s, d):
    return I.release_tracks(releases(s, d), "j")


@query("s8_transcript_segments", "SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 0.0 ELSE turn * 1.5 END::DOUBLE AS start_s, CASE WHEN turn % 3 = 2 THEN 0.0 ELSE turn * 1.5 + 1 END::DOUBLE AS end_s, trim(text) AS text FROM conversations WHERE trim(text) <> ''")
def s8(s, d):
    seg = F.struct("text", F.when(F.col("turn") % 3 == 2, "x").otherwise((F.col("turn") * 1500).cast("string")).alias("start"), (F.col("turn") * 1500 + 1000).cast("string").alias("end"))
    j = table(s, d, "conversations").withColumn("j", F.to_json(F.struct(F.array(seg).alias("segments"))))
    return I.transcript_segments(j.withColumn("key", F.struct("conv_id", "turn")), "key", "j").select("key.conv_id", "key.turn", "start_s", "end_s", "text")



@query("s15_lyrics_search", "SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_type AS album, p_retailprice AS duration FROM part WHERE p_size % 5 <> 0")
def s15(s, d):
    t = F.when(F.col("p_size") % 5 == 0, " ").otherwise(F.col("p_name"))
    a = F.struct(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, t).alias("trackName"), F.when(F.col("p_size") % 2 == 1, t).alias("name"), F.col("p_brand").alias("artist"), F.col("p_type").alias("albumName"), F.col("p_retailprice").alias("duration"))
    return I.lyrics_search(table(s, d, "part").select(F.to_json(F.array(a)).alias("j")), "j").select("id", "title", "artist", "album", "duration")


# -- resolution --------------------------------------------------------------------------------------------------------------------


def keyed_files(s, d) -> DataFrame:
    c, k = table(s, d, "customer"), F.col("c_custkey")
    return c.select(k.alias("file"), F.when(k % 4 == 0, F.concat(F.lit("R"), k)).alias("recording"), F.when(k % 3 == 0, F.concat(F.lit("I"), k % 90)).alias("isrc"), F.when(k % 5 == 0, F.concat(F.lit("A"), k % 50)).otherwise(" ").alias("acoustid"), F.when(k % 2 == 0, F.concat(F.lit("F"), k)).alias("fingerprint"))


def references(s, d) -> DataFrame:
    p, k = table(s, d, "part"), F.col("p_partkey")
    rows = [F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(l), k).alias("key"), F.when(k % 2 == 0, F.array(F.concat(F.lit("r"), k))).otherwise(F.array(F.concat(F.lit("r"), k), F.lit("x"))).alias("recordings")) for kind, l in (("isrc", "I"), ("acoustid", "A"), ("fingerprint", "F"))]
    return p.select(F.inline(F.array(*rows)))


@query(
    "j1_j2_resolution",
    """WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'recording' WHEN c_custkey % 3 = 0 THEN 'isrc' WHEN c_custkey % 5 = 0 THEN 'acoustid' WHEN c_custkey % 2 = 0 THEN 'fingerprint' END AS source,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN c_custkey % 90 WHEN c_custkey % 5 = 0 THEN c_custkey % 50 WHEN c_custkey % 2 = 0 THEN c_custkey END AS n FROM customer),
g AS (SELECT *, CASE WHEN source = 'isrc' AND n % 4 = 1 THEN 'no answer' WHEN source = 'fingerprint' AND n % 11 = 0 THEN 'no answer' WHEN source = 'recording' AND k % 52 = 0 THEN 'gone' END AS error FROM f)
SELECT k AS file, source, CASE WHEN error IS NOT NULL THEN 'error' WHEN p_partkey IS NULL THEN 'unmatched' ELSE 'resolved' END AS status, CASE WHEN p_partkey IS NULL THEN CAST([] AS VARCHAR[]) WHEN n % 2 = 0 THEN ['r' || n] ELSE ['r' || n, 'x'] END AS candidates,
  CASE WHEN source = 'recording' THEN 'R' || k WHEN p_partkey IS NOT NULL AND n % 2 = 0 THEN 'r' || n END AS recording, error FROM g LEFT JOIN part ON p_partkey = n""",
)
def j1(s, d):
    """Some lookups of codes, fingerprints and recordings fail, with and without candidates at hand."""
    p, c = table(s, d, "part"), table(s, d, "customer")
    isrc = p.filter("p_partkey % 4 = 1").select(F.lit("isrc").alias("kind"), F.concat(F.lit("I"), "p_partkey").alias("key"), F.lit("no answer").alias("error"))
    isrc = isrc.unionByName(c.filter("c_custkey < 90 and c_custkey % 4 = 1").select(F.lit("isrc").alias("kind"), F.concat(F.lit("I"), "c_custkey").alias("key"), F.lit("no answer").alias("error")))
    mark = c.filter("c_custkey % 11 = 0").select(F.lit("fingerprint").alias("kind"), F.concat(F.lit("F"), "c_custkey").alias("key"), F.lit("no answer").alias("error"))
    gone = c.filter("c_custkey % 52 = 0").select(F.lit("recording").alias("kind"), F.concat(F.lit("R"), "c_custkey").alias("key"), F.lit("gone").alias("error"))
    return R.resolve(keyed_files(s, d), references(s, d), failed=isrc.unionByName(mark).unionByName(gone))


@query("j3_release_expansion", "WITH r AS (SELECT DISTINCT l_orderkey, 'p' || p_brand AS b FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT o_orderkey AS file, CASE WHEN o_orderkey % 10 = 0 THEN ['own'] ELSE coalesce(list_sort(list(b) FILTER (b IS NOT NULL)), CAST([] AS VARCHAR[])) END AS releases FROM orders LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def j3(s, d):
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("recordings"))
    files = table(s, d, "orders").select(F.col("o_orderkey").alias("file")).join(li, "file", "left").withColumn("direct", F.when(F.col("file") % 10 == 0, F.array(F.lit("own"))))
    rec = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("recording"), F.concat(F.lit("p"), "p_brand").alias("release"))
    return R.expand_releases(files, rec)


@query("j11_needs_fingerprint", "SELECT c_custkey AS file FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND NOT (c_custkey % 7 = 0 AND c_custkey % 14 <> 0)")
def j11(s, d):
    f = keyed_files(s, d)
    cached = f.filter("file % 7 = 0").select("file", F.when(F.col("file") % 14 == 0, "0.9").otherwise("1.0").alias("version"))
    return R.needs_fingerprint(f, cached, "1.0").select("file")



# -- release scores: parts by brand and type as local albums -----------------------------------------------------------------------

#: Even brands have one candidate far ahead, odd ones six of about equal size.
_RELEASE = "CASE WHEN CAST(right(p_brand, 1) AS INT) % 2 = 0 AND p_partkey % 10 < 9 THEN 0 ELSE p_size % 6 END"
_SCORES = f"""WITH p AS (SELECT p_partkey, p_brand AS cluster, {_RELEASE} AS k FROM part),
a AS (SELECT cluster, k, cluster || '-' || k AS release, count(*) AS matched FROM p WHERE p_partkey % 5 <> 0 GROUP BY ALL),
l AS (SELECT cluster, count(*) AS n FROM p WHERE p_partkey % 5 <> 0 GROUP BY 1), t AS (SELECT cluster || '-' || k AS release, count(*) AS tracks FROM p GROUP BY 1),
sc AS (SELECT a.cluster, a.release, a.matched, n, tracks, (['official','bootleg','promotion','pseudo-release'])[k % 4 + 1] AS status, (1990 + k % 7) || '-01-01' AS date,
  CASE WHEN n = tracks THEN 100 WHEN abs(n - tracks) / n <= 0.33 THEN 40 ELSE -80 END + CASE WHEN matched / n >= 0.66 THEN 5 * matched ELSE 0 END + ([20, -50, -30, -30])[k % 4 + 1]
  + CASE WHEN k % 4 = 0 THEN 15 ELSE 0 END + CASE WHEN k % 5 = 3 THEN -50 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 10 ELSE 0 END AS score FROM a JOIN l USING (cluster) JOIN t USING (release)),
pl AS (SELECT *, row_number() OVER w AS place, lead(matched, 1, 0) OVER w AS nxt FROM sc WINDOW w AS (PARTITION BY cluster ORDER BY matched DESC, release)),
dom AS (SELECT cluster, matched / n >= 0.85 AND matched - nxt >= greatest(3, CAST(floor(n * 0.35) AS BIGINT)) AND abs(tracks - n) / n <= 0.33 AS dominant FROM pl WHERE place = 1),
lk AS (SELECT pl.* FROM pl JOIN dom USING (cluster) WHERE place = 1 OR (place <= 3 AND NOT dominant)),
tb AS (SELECT *, count(*) OVER w AS ties, count(*) FILTER (status = 'official') OVER w AS good, row_number() OVER (PARTITION BY cluster, score ORDER BY status <> 'official', date, release) AS r FROM lk WINDOW w AS (PARTITION BY cluster, score)),
fin AS (SELECT cluster, release, matched, TRUE AS looked_up, CAST(score + CASE WHEN ties >= 2 AND good >= 2 AND r = 1 THEN 5 ELSE 0 END AS BIGINT) AS score FROM tb
  UNION ALL SELECT cluster, release, matched, FALSE, 10 * matched FROM pl WHERE release NOT IN (SELECT release FROM lk)),
rk AS (SELECT *, row_number() OVER w AS rank, score - lead(score) OVER w AS margin FROM fin WINDOW w AS (PARTITION BY cluster ORDER BY score DESC, matched DESC, release))"""


def candidates(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences (cluster, release, files), sizes (cluster, n) and detailed scores of the candidate releases of each brand."""
    k = F.when((F.right("p_brand", F.lit(1)).cast("int") % 2 == 0) & (F.col("p_partkey") % 10 < 9), 0).otherwise(F.col("p_size") % 6)
    p = table(s, d, "part").select("p_partkey", F.col("p_brand").alias("cluster"), k.alias("k")).withColumn("release", F.concat_ws("-", "cluster", "k"))
    local = p.filter("p_partkey % 5 <> 0")
    counts = local.groupBy("cluster", "release", "k").agg(F.count("*").alias("files"))
    sizes, tracks = local.groupBy("cluster").agg(F.count("*").alias("n")), p.groupBy("release").agg(F.count("*").alias("tracks"))
    status = F.element_at(F.array(*map(F.lit, ("official", "Bootleg", "promotion", "pseudo-release"))), F.col("k") % 4 + 1)
    points, reasons = A.metadata_points(status, F.when(F.col("k") % 4 == 0, "Album"), F.when(F.col("k") % 5 == 3, F.array(F.lit("Live"))), F.when(F.col("k") % 2 == 0, "Digital Media"))
    total = A.track_count_points(F.col("n"), F.col("tracks")) + A.recording_points(F.col("files"), F.col("n")) + points
    detailed = counts.join(sizes, "cluster").join(tracks, "release").select(
        "cluster", "release", F.col("files").alias("matched"), "tracks", F.lower(status).alias("status"), F.concat(F.col("k") % 7 + 1990, F.lit("-01-01")).alias("date"), total.alias("score"), reasons.alias("reasons")
    )
    return counts.select("cluster", "release", "files"), sizes, detailed


def ranking(s, d) -> DataFrame:
    return A.ranked(A.composed(*candidates(s, d)))


@query("r2_r3_r6_scores", _SCORES + " SELECT cluster, release, CAST(score AS BIGINT) AS score FROM sc")
def r6(s, d):
    return candidates(s, d)[2].select("cluster", "release", F.col("score").cast("long").alias("score"))


@query("w6_w7_ranking", _SCORES + " SELECT cluster, release, looked_up, score, rank, margin FROM rk")
def w6(s, d):
    return ranking(s, d).select("cluster", "release", "looked_up", *[F.col(c).cast("long").alias(c) for c in ("score", "rank", "margin")])


@query(
    "r8_verdict",
    _SCORES + """, c AS (SELECT DISTINCT cluster FROM l UNION ALL SELECT DISTINCT 'none-' || cluster FROM l), bad AS (SELECT cluster, min(release) AS release FROM lk WHERE right(cluster, 1) = '3' AND place = 2 GROUP BY 1)
SELECT c.cluster, coalesce(bad.release, rk.release) AS release, CASE WHEN rk.release IS NULL THEN 'unmatched' WHEN bad.release IS NOT NULL THEN 'error' ELSE 'selected' END AS status,
  CASE WHEN rk.release IS NULL THEN 'no candidates' WHEN bad.release IS NOT NULL THEN 'lookup failed' WHEN score < 80 THEN 'low score' WHEN margin < 25 THEN 'small margin' ELSE 'best candidate' END AS reason
FROM c LEFT JOIN rk ON rk.cluster = c.cluster AND rk.rank = 1 LEFT JOIN bad ON bad.cluster = c.cluster""",
)
def r8(s, d):
    counts, sizes, _ = candidates(s, d)
    every = sizes.select("cluster").unionByName(sizes.select(F.concat(F.lit("none-"), "cluster").alias("cluster")))
    failed = A.shortlist(counts).filter("rank = 2 and right(cluster, 1) = '3'").select("cluster", "release")
    return A.verdict(ranking(s, d), clusters=every, failed=failed)


@query("r4_order_points", "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 60 WHEN 1 THEN 20 WHEN 4 THEN 20 WHEN 6 THEN 20 ELSE 0 END AS points FROM orders")
def r4(s, d):
    """Same order; one recording more in between; too little in order; not numbered; one track without recording; nothing matched; swapped."""
    k = F.col("o_orderkey") % 7
    arr = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    local = F.when(k == 5, arr("")).otherwise(arr("abcd"))
    rel = F.when(k == 1, arr("abxcd")).when(k == 2, arr("bdca")).when(k == 5, arr("")).when(k == 6, arr("abdc")).otherwise(arr("abcd"))
    return table(s, d, "orders").select("o_orderkey", A.order_points(local, rel, k != 3, F.when(k == 4, 5).otherwise(4)).cast("long").alias("points"))


@query(
    "r5_a13_disc_points",
    """WITH lo AS (SELECT l_orderkey AS c, l_linenumber AS pos, l_partkey AS rec, nullif(l_linenumber % 3, 0) AS disc FROM lineitem WHERE l_orderkey % 6 <> 5 OR l_linenumber = 3),
re AS (SELECT l_orderkey AS c, l_linenumber AS pos, l_partkey AS rec, nullif(CASE l_orderkey % 6 WHEN 1 THEN l_linenumber % 2 WHEN 2 THEN 3 - l_linenumber % 3 ELSE l_linenumber % 3 END, 0) AS disc FROM lineitem WHERE l_orderkey % 6 <> 3 AND l_partkey % 7 <> 0),
lc AS (SELECT c, max(coalesce(disc, 0)) AS n FROM lo GROUP BY 1), rc AS (SELECT c, max(coalesce(disc, 0)) AS n FROM re GROUP BY 1),
lm AS (SELECT c, rec, arg_max(disc, pos) AS disc FROM lo WHERE disc IS NOT NULL GROUP BY ALL), rm AS (SELECT c, rec, arg_max(disc, pos) AS disc FROM re WHERE disc IS NOT NULL GROUP BY ALL),
sm AS (SELECT lm.c, bool_and(rm.disc IS NULL OR rm.disc = lm.disc) AS same FROM lm LEFT JOIN rm ON rm.c = lm.c AND rm.rec = lm.rec GROUP BY 1)
SELECT lc.c AS cluster, CASE WHEN lc.n = 0 THEN 0 WHEN lc.n = coalesce(rc.n, 0) AND coalesce(same, FALSE) THEN 40 WHEN lc.n <> coalesce(rc.n, 0) THEN -30 ELSE 0 END AS points
FROM lc LEFT JOIN rc USING (c) LEFT JOIN sm USING (c)""",
)
def r5(s, d):
    """Equal and unequal layouts, unequal counts, releases without tracks, albums without disc numbers."""
    k, n = F.col("l_orderkey") % 6, F.col("l_linenumber")
    t = table(s, d, "lineitem").select(F.col("l_orderkey").alias("cluster"), n.alias("position"), F.col("l_partkey").alias("recording"), k.alias("k"), n.alias("n"))
    local = t.filter("k <> 5 or n = 3").withColumn("disc", F.col("n") % 3)
    release = t.filter("k <> 3 and recording % 7 <> 0").withColumn("disc", F.expr("case k when 1 then n % 2 when 2 then 3 - n % 3 else n % 3 end"))
    return A.disc_layout(local, release).select("cluster", F.col("points").cast("long").alias("points"))


@query("a8_track_count", "SELECT l_orderkey, CASE l_orderkey % 5 WHEN 0 THEN 99 WHEN 1 THEN 7 WHEN 4 THEN NULL ELSE sum(l_linenumber) FILTER (l_linenumber % 3 > 0) END::BIGINT AS tracks FROM lineitem GROUP BY l_orderkey")
def a8(s, d):
    """A count of the release by either name, counts of media by either name, some of which are no numbers, and none at all."""
    k, n = F.col("l_orderkey") % 5, F.col("l_linenumber")
    count = F.when(n % 3 == 0, F.lit('{"track-count":"x"}')).when(n % 3 == 1, F.concat(F.lit('{"track-count":"'), n, F.lit('"}'))).otherwise(F.concat(F.lit('{"track-count":0,"track_count":'), n, F.lit("}")))
    t = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(count), ",").alias("m"))
    media = F.when(k == 2, F.concat(F.lit('"medium-list":['), "m", F.lit("]"))).otherwise(F.concat(F.lit('"medium-list":[],"media":['), F.when(k == 4, "{}").otherwise(F.col("m")), F.lit("]")))
    own = F.when(k == 0, '"track-count":" 99",').when(k == 1, '"track-count":"?","track_count":7,').otherwise("")
    r = F.from_json(F.concat(F.lit("{"), own, media, F.lit("}")), V.RELEASE)
    return t.select("l_orderkey", V.stated_track_count(r).alias("tracks"))



@query("w11_local_order", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_size % 3, 0) NULLS LAST, nullif(p_size % 11, 0) NULLS LAST, lpad(CAST(p_partkey AS VARCHAR), 8, '0')) AS position FROM part")
def w11(s, d):
    t = table(s, d, "part").withColumn("path", F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    return A.local_order(t, "p_brand", "path", F.col("p_size") % 3, F.col("p_size") % 11).select("p_partkey", F.col("position").cast("long").alias("position"))


_ASSIGN = "WITH r AS (SELECT p_brand AS c, p_partkey AS t, p_size AS rec, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 3 <> 0), l AS (SELECT p_brand AS c, p_partkey AS f, p_size AS rec, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 5 <> 0)"


def assigned(s, d) -> DataFrame:
    p = table(s, d, "part").select(F.col("p_brand").alias("cluster"), F.col("p_partkey").alias("file"), F.col("p_partkey").alias("position"), F.col("p_size").cast("string").alias("recording"))
    # in one brand, files have a candidate that the release hasn't; it changes nothing
    local = p.filter("file % 5 <> 0").withColumn("candidates", F.when(F.col("cluster") == "Brand#2", F.array("recording", F.lit("none"))).otherwise(F.array().cast("array<string>")))
    return A.assign_tracks(local, p.filter("file % 3 <> 0").withColumnRenamed("file", "track"))


@query("j9_track_assignment", _ASSIGN + " SELECT l.c AS cluster, l.f AS file, r.t AS track FROM l LEFT JOIN r ON r.c = l.c AND r.rec = l.rec AND r.k = l.k")
def j9(s, d):
    return assigned(s, d)


#: Files of an order: its rows but every third, each with the recording of its row or of none.
_FILES = "fi AS (SELECT DISTINCT o * 10 + n AS file, o, n, CASE WHEN n = 7 THEN NULL ELSE 'r' || o || '-' || n END AS rec, '/in/' || o || '/' || n || CASE n % 3 WHEN 0 THEN '.tar.flac' WHEN 1 THEN '' ELSE '.mp3' END AS path FROM l WHERE (o + n) % 3 <> 0)"
_NULL = lambda *names: ", ".join(f"CAST(NULL AS VARCHAR) AS {n}" for n in names)
_ROWS = f"""{_TRACKS}, {_FILES}, y AS (SELECT o, n, place, total, disc, title, rid, row_number() OVER (PARTITION BY o, n ORDER BY place) AS c FROM x),
z AS (SELECT fi.*, y.place IS NOT NULL AS m, y.* EXCLUDE (o, n) FROM fi LEFT JOIN y ON y.o = fi.o AND y.rid = fi.rec AND c = 1)
SELECT file, CASE WHEN m THEN 'matched' ELSE 'unmatched_in_release' END AS status, CASE WHEN NOT m THEN 'no track of the release is this file''s' END AS reason, path AS original_path,
  CASE n % 3 WHEN 0 THEN '.flac' WHEN 1 THEN '' ELSE '.mp3' END AS extension, rec AS recording_mbid, CASE WHEN m THEN 'R' || o END AS release_mbid, CASE WHEN m THEN 'G' || o % 50 END AS release_group_mbid, CASE WHEN m THEN 't' || o || '-' || n END AS track_mbid,
  CASE WHEN m THEN title ELSE n || CASE WHEN n % 3 = 0 THEN '.tar' ELSE '' END END AS title, CASE WHEN NOT m THEN NULL WHEN n % 4 = 1 THEN 'Phrase' WHEN n % 4 = 0 THEN 'Cy' WHEN o % 7 = 0 THEN 'Ann and Bob' ELSE 'Ann & Bob' END AS artist,
  CASE WHEN m AND n % 4 = 0 THEN ['Cy'] ELSE CAST([] AS VARCHAR[]) END AS artists, CASE WHEN m AND n % 4 = 0 THEN 'Cyx' END AS artist_sort, CASE WHEN m THEN 'Ann, A& & Bob' END AS album_artist_sort, CASE WHEN m THEN ['Ann', 'Bob'] ELSE CAST([] AS VARCHAR[]) END AS album_artists,
  CASE WHEN m THEN 'Album ' || o END AS album, CASE WHEN NOT m THEN NULL WHEN o % 7 = 0 THEN 'Ann and Bob' ELSE 'Ann & Bob' END AS album_artist, CASE WHEN NOT m THEN NULL WHEN n % 3 = 1 THEN 'pop; folk' WHEN o % 5 = 1 THEN 'jazz' ELSE 'rock' END AS genre,
  CASE WHEN m THEN 'Cee; Dee' END AS composer, CASE WHEN m THEN 'Eff' END AS conductor, CASE WHEN m AND n % 3 = 0 THEN 'grp' END AS grouping, CASE WHEN m THEN n END AS track_number, CASE WHEN m THEN disc END AS disc_number, CASE WHEN m THEN total END AS total_tracks, CASE WHEN m THEN 2 END AS total_discs,
  CASE WHEN m THEN 'Official' END AS release_status, CASE WHEN m AND o % 3 <> 0 THEN 'DE' END AS release_country, CASE WHEN NOT m THEN CAST([] AS VARCHAR[]) ELSE list_concat([CASE WHEN o % 2 = 0 THEN 'Album' ELSE 'Single' END], CASE WHEN o % 3 = 0 THEN ['Live', 'Remix'] ELSE [] END) END AS releasetype,
  CASE WHEN m THEN CASE WHEN n <= 3 THEN 'CD' ELSE 'Vinyl' END END AS media, CASE WHEN m AND n > 3 THEN 'Side' END AS disc_subtitle, CASE WHEN NOT m THEN NULL WHEN o % 5 = 0 THEN '199' ELSE '2001-0' || (o % 9 + 1) END AS release_date, CASE WHEN m AND o % 5 <> 0 THEN '2001' END AS release_year,
  CASE WHEN m THEN '1999-05' END AS original_date, CASE WHEN m THEN '1999' END AS original_year, CASE WHEN m AND o % 3 <> 1 THEN 'Latn' END AS script, CASE WHEN m THEN 'b' || o END AS barcode, CASE WHEN m AND o % 4 <> 0 THEN 'a' || o END AS asin, CASE WHEN m THEN 'L' || o % 9 END AS publisher,
  CASE WHEN NOT m THEN NULL WHEN n = 5 THEN 'http://t/' || o WHEN o % 3 = 0 THEN 'https://r/' || o WHEN o % 2 = 0 THEN 'http://u/' || o END AS url, CASE WHEN m THEN 'Gee' END AS originalartist, CASE WHEN m THEN 'Aitch' END AS remixer,
  CASE WHEN m THEN ['L' || o % 9, 'L' || o % 9] ELSE CAST([] AS VARCHAR[]) END AS label, CASE WHEN m THEN ['C' || o] ELSE CAST([] AS VARCHAR[]) END AS catalognumber, CASE WHEN m THEN ['A1', 'A2'] ELSE CAST([] AS VARCHAR[]) END AS musicbrainz_albumartistid,
  CASE WHEN m AND n % 4 = 0 THEN ['A9'] ELSE CAST([] AS VARCHAR[]) END AS musicbrainz_artistid, CAST([] AS VARCHAR[]) AS musicbrainz_originalartistid, CASE WHEN n % 2 = 0 THEN 'I' || n END AS isrc, {_NULL('subtitle', 'acoustid_id', *V.NEVER)} FROM z"""


def track_rows(s, d) -> DataFrame:
    """The canonical rows of all files: each takes the first unused track of its order's release with its recording."""
    t = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).filter("(o + n) % 3 <> 0").distinct()
    end = F.when(F.col("n") % 3 == 0, ".tar.flac").when(F.col("n") % 3 == 1, "").otherwise(".mp3")
    recording = F.when(F.col("n") != 7, F.concat(F.lit("r"), "o", F.lit("-"), "n"))
    files = t.select(
        (F.col("o") * 10 + F.col("n")).alias("file"), F.col("o").alias("cluster"), F.col("n").alias("position"), F.concat(F.lit("/in/"), "o", F.lit("/"), "n", end).alias("original_path"), recording.alias("recording"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit(" I"), "n")).alias("isrc"), F.lit(" ").alias("acoustid"), F.array().cast("array<string>").alias("candidates"),
    )
    tracks = G.saved(V.canonical_tracks(releases(s, d), "j", "o").withColumnRenamed("o", "cluster"), "release_tracks")
    assigned = A.assign_tracks(files, tracks.select("cluster", F.col("place").cast("long").alias("track"), F.col("place").alias("position"), F.col("recording_mbid").alias("recording")))
    return V.track_rows(files, assigned.select("file", "cluster", F.col("track").alias("place")), tracks, "file")


@query("j10_enrichment", "WITH " + _ROWS)
def j10(s, d):
    return track_rows(s, d)


# -- cache: documents against an older manifest ------------------------------------------------------------------------------------

_CACHE = "WITH n AS (SELECT doc_id AS path, n_chars AS size FROM documents WHERE doc_id % 13 <> 0), o AS (SELECT doc_id AS path, n_chars + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size, source AS codec, lang AS hash, CASE WHEN doc_id % 11 = 0 THEN '0.9' ELSE '1.0' END AS version FROM documents WHERE doc_id % 10 <> 0), st AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'gone' WHEN n.size = o.size THEN 'unchanged' ELSE 'changed' END AS state FROM n FULL OUTER JOIN o ON n.path = o.path)"


def manifests(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = table(s, d, "documents")
    new = t.filter("doc_id % 13 <> 0").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size_bytes"), F.when(F.col("doc_id") % 2 == 0, "new").alias("codec"))
    old = t.filter("doc_id % 10 <> 0").select(F.col("doc_id").alias("path"), (F.col("n_chars") + (F.col("doc_id") % 7 == 0).cast("int")).alias("size_bytes"), F.col("source").alias("codec"), F.col("lang").alias("hash"), F.when(F.col("doc_id") % 11 == 0, "0.9").otherwise("1.0").alias("version"))
    return new, old, C.changes(new, old, by=("size_bytes",))


@query("c1_changes", _CACHE + " SELECT path, state FROM st")
def c1(s, d):
    return manifests(s, d)[2]


@query("c2_merge", _CACHE + " SELECT n.path, n.size AS size_bytes, coalesce(CASE WHEN n.path % 2 = 0 THEN 'new' END, CASE WHEN state = 'unchanged' THEN o.codec END) AS codec, CASE WHEN state = 'unchanged' THEN o.hash END AS hash FROM n JOIN st USING (path) LEFT JOIN o USING (path)")
def c2(s, d):
    new, old, st = manifests(s, d)
    return C.merged(new, old, st, ["codec"], ["hash"]).select("path", "size_bytes", "codec", "hash")


@query("c3_invalidation", _CACHE + " SELECT path, version FROM o JOIN st USING (path) WHERE state IN ('unchanged', 'gone')")
def c3(s, d):
    _, old, st = manifests(s, d)
    return C.still_valid(old, st).select("path", "version")


@query("c4_versioned_hits", _CACHE + " SELECT path FROM o WHERE version = '1.0' AND path % 3 <> 0")
def c4(s, d):
    _, old, _ = manifests(s, d)
    settings = F.when(F.col("path") % 3 == 0, '{"length": 60, "a": 1}').otherwise('{"a": 1, "length": 120}')
    return C.hits(old, "1.0", settings, '{"length":120,"a":1}').select("path")


@query("c5_upsert", _CACHE + ", u AS (SELECT path, 'old' AS v, path % 4 AS seen FROM o UNION ALL SELECT path, 'new', 2 FROM n) SELECT path, arg_max(v, seen * 2 + CAST(v = 'new' AS INT)) AS v FROM u GROUP BY path")
def c5(s, d):
    new, old, _ = manifests(s, d)
    return C.upserted(old.select("path", F.lit("old").alias("v"), (F.col("path") % 4).alias("at")), new.select("path", F.lit("new").alias("v"), F.lit(2).cast("long").alias("at")), "path", "at").select("path", "v")


_VERSIONS = _CACHE + """, one AS (SELECT path, size, codec, hash, 1 AS seen FROM o),
two AS (SELECT coalesce(n.path, one.path) AS path, CASE WHEN n.path IS NULL THEN one.size ELSE n.size END AS size, CASE WHEN n.path IS NULL THEN one.codec END AS codec, CASE WHEN n.path IS NULL THEN one.hash END AS hash, CASE WHEN n.path IS NULL THEN 1 ELSE 2 END AS seen FROM one FULL JOIN (SELECT * FROM n WHERE path % 3 = 0) n ON n.path = one.path),
three AS (SELECT path, size, CASE WHEN path % 5 = 0 THEN CASE WHEN path % 2 = 0 THEN 'c' END ELSE codec END AS codec, CASE WHEN path % 5 = 0 THEN 'h' || path ELSE hash END AS hash, seen FROM two)"""


@query("c5_versions", _VERSIONS + " SELECT 1 AS version, path, size, codec, hash, seen FROM one UNION ALL SELECT 2, path, size, codec, hash, seen FROM two UNION ALL SELECT 3, path, size, codec, hash, seen FROM three")
def c5_versions(s, d):
    """Three versions of a table, each by a reader that opened it before the next one: as it was, whole rows replaced, two columns updated
    (also for paths that aren't there, which adds none)."""
    new, old, _ = manifests(s, d)
    at = lambda df, n: df.withColumn("seen", F.lit(n))
    path = G.scratch_path(s, "versions")
    C.publish(at(old.select("path", F.col("size_bytes").alias("size"), "codec", "hash"), 1), path)
    one = C.opened(s, path)
    blank = F.lit(None).cast("string")
    C.publish(C.upserted(one, at(new.filter("path % 3 = 0").select("path", F.col("size_bytes").alias("size"), blank.alias("codec"), blank.alias("hash")), 2), "path", "seen"), path)
    two = C.opened(s, path)
    paths = table(s, d, "documents").filter("doc_id % 5 = 0").select(F.col("doc_id").alias("path"))
    C.publish(C.updated(two, paths.select("path", F.when(F.col("path") % 2 == 0, "c").alias("codec"), F.concat(F.lit("h"), "path").alias("hash")), "path", ["codec", "hash"]), path)
    read = [df.withColumn("version", F.lit(n)) for n, df in enumerate((one, two, C.opened(s, path)), 1)]
    return read[0].unionByName(read[1]).unionByName(read[2])


@query("c6_work", _CACHE + " SELECT path FROM n WHERE path NOT IN (SELECT path FROM o JOIN st USING (path) WHERE state = 'unchanged' AND version = '1.0')")
def c6(s, d):
    new, old, st = manifests(s, d)
    return C.work(new, C.hits(C.still_valid(old, st), "1.0")).select("path")


@query("c7_error_rows", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'ERROR' ELSE 'ok' END AS status FROM events")
def c7(s, d):
    bad = F.when(F.col("event_id") % 6 == 0, "DURATION=?").otherwise("DURATION=1\nFINGERPRINT=a")
    return table(s, d, "events").select("event_id", F.when(I.fingerprint_text(bad)["error"].isNotNull(), "ERROR").otherwise("ok").alias("status"))


# -- reports -----------------------------------------------------------------------------------------------------------------------


@query("a9_run_summary", "SELECT count(*) AS rows_all, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS high, count(DISTINCT user_id) AS users FROM events")
def a9(s, d):
    return table(s, d, "events").agg(F.count("*").alias("rows_all"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("value") > 50).alias("high"), F.count_distinct("user_id").alias("users"))


@query("a10_error_digest", "WITH e AS (SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 9 = 0 THEN ' ' ELSE event_type END), ''), 'unknown error') AS reason FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY event_id) AS k FROM e) SELECT reason, count(*) AS n, list_sort(list(event_id) FILTER (k <= 5)) AS examples FROM r GROUP BY reason")
def a10(s, d):
    from mediagraph.sources.reports import error_digest

    e = table(s, d, "events").withColumn("reason", F.when(F.col("event_id") % 9 == 0, " ").otherwise(F.col("event_type")))
    return error_digest(e, "reason", "event_id")


@query(
    "p36_release_summary",
    "SELECT p_partkey, p_name AS album, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' & ' || p_type WHEN 2 THEN p_type END AS album_artist, CASE WHEN p_size % 2 = 0 THEN '1990-01' END AS date FROM part",
)
def p36(s, d):
    k = F.col("p_partkey") % 4
    artist = lambda c: F.struct(F.struct(F.concat(F.lit(" "), c).alias("name")).alias("artist"))
    two = F.concat_ws("", F.lit("["), F.to_json(artist("p_brand")), F.lit('," & ",'), F.to_json(artist("p_type")), F.lit("]"))
    credits = F.when(k == 1, two).when(k == 2, F.concat(F.lit("["), F.to_json(artist("p_type")), F.lit("]"))).otherwise(F.lit("[]"))
    head = F.to_json(F.struct(F.col("p_name").alias("title"), F.when(F.col("p_size") % 2 == 0, "1990-01").alias("date"), F.when(k == 0, F.col("p_brand")).otherwise(" ").alias("artist-credit-phrase")))
    json = F.concat(F.left(head, F.length(head) - 1), F.lit(',"artist-credit":'), credits, F.lit("}"))
    r = I.release_summary(json)
    return table(s, d, "part").select("p_partkey", r["album"].alias("album"), r["album_artist"].alias("album_artist"), r["date"].alias("date"))


@query(
    "s14_cache_tables",
    _CACHE + """, v AS (SELECT path, version FROM o WHERE path IN (SELECT path FROM n))
SELECT 'files' AS name, path AS file_id, NULL AS version FROM n UNION ALL SELECT t.name, path, version FROM v, (VALUES ('fingerprints', '1.0'), ('analysis_results', '0.9'), ('metadata_resolution', NULL)) t(name, wanted) WHERE wanted IS NULL OR version = wanted""",
)
def s14(s, d):
    """All four tables read back: two of them by one version, one with all its versions; rows of files that are gone go with them."""
    new, old, _ = manifests(s, d)
    of = lambda df, name: df.select(F.col("path").alias("file_id"), *([F.col("version").alias(C.TABLES[name])] if C.TABLES[name] else []))
    path = G.scratch_path(s, "cache")
    C.write_tables({name: of(new if name == "files" else old, name) for name in C.TABLES}, path, buckets=8)
    wanted = {"fingerprints": "1.0", "analysis_results": "0.9"}
    version = lambda name: F.col(C.TABLES[name]) if C.TABLES[name] else F.lit(None).cast("string")
    read = [C.read_table(s, path, name, wanted.get(name)).select(F.lit(name).alias("name"), "file_id", version(name).alias("version")) for name in C.TABLES]
    return read[0].unionByName(read[1]).unionByName(read[2]).unionByName(read[3])
