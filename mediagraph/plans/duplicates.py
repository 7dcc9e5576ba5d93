"""Queries of duplicate detection and cleanup over documents as files, and parts as tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagraph.functions import text as X
from mediagraph.operators import dedupe as D
from mediagraph.plans.registry import query, table

EXTENSIONS = (".mp3", ".flac", ".m4a", ".ogg", ".opus", ".wav", ".aiff", ".wma")

#: documents as files: the SQL twin of files().
FILES_SQL = """f AS (SELECT doc_id AS file_id, '/lib/' || source || '/' || lang || '/' || doc_id || (['.mp3','.flac','.m4a','.ogg','.opus','.wav','.aiff','.wma'])[doc_id % 8 + 1] AS path,
  (['.mp3','.flac','.m4a','.ogg','.opus','.wav','.aiff','.wma'])[doc_id % 8 + 1] AS ext, n_chars AS size_bytes, text AS content, CASE WHEN doc_id % 2 = 0 THEN 16 ELSE 24 END AS bits,
  CASE WHEN doc_id % 3 = 0 THEN 96000 ELSE 44100 END AS rate, doc_id % 50 AS ac, (doc_id % 100) / 100.0 AS score, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 40 END AS rec,
  lang AS title, source AS artist, n_chars / 10 AS dur, CASE WHEN doc_id % 5 > 0 THEN n_chars * 8 END AS bitrate, doc_id % 2 + 1 AS channels, CASE WHEN doc_id % 6 = 0 THEN 'alac' WHEN doc_id % 6 = 1 THEN 'mp3' END AS codec FROM documents)"""
PAIRS_SQL = f"""WITH RECURSIVE {FILES_SQL},
isl AS (SELECT *, CASE WHEN dur - lag(dur) OVER w > 2.0 THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY title, artist ORDER BY dur, file_id)),
md AS (SELECT file_id, concat_ws('|', title, artist, CAST(sum(new) OVER (PARTITION BY title, artist ORDER BY dur, file_id) AS VARCHAR)) AS bucket FROM isl),
k AS (SELECT 1 AS t, sha256(content) AS bucket, file_id FROM f UNION ALL SELECT 2, CAST(ac AS VARCHAR), file_id FROM f WHERE score >= 0.85 UNION ALL SELECT 3, CAST(rec AS VARCHAR), file_id FROM f WHERE rec IS NOT NULL
  UNION ALL SELECT 4, bucket, file_id FROM md),
p AS (SELECT a.t, a.bucket, a.file_id AS a, b.file_id AS b FROM k a JOIN k b ON a.t = b.t AND a.bucket = b.bucket AND a.file_id < b.file_id),
e AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.a = p.a AND q.b = p.b AND q.t < p.t)),
s AS (SELECT t, bucket, a, b FROM e UNION ALL SELECT t, bucket, b, a FROM e),
r AS (SELECT DISTINCT t, bucket, a AS n, a AS c FROM s UNION SELECT s.t, s.bucket, s.b, r.c FROM r JOIN s ON s.t = r.t AND s.bucket = r.bucket AND s.a = r.n),
c AS (SELECT t, bucket, n, min(c) AS c FROM r GROUP BY ALL),
g AS (SELECT t, bucket, c, list_sort(list(n)) AS files, count(*) AS m FROM c GROUP BY t, bucket, c),
ec AS (SELECT e.t, e.bucket, c.c, count(*) AS n FROM e JOIN c ON c.t = e.t AND c.bucket = e.bucket AND c.n = e.a GROUP BY ALL),
groups AS (SELECT g.t, g.files FROM g JOIN ec USING (t, bucket, c) WHERE ec.n * 2 = m * (m - 1)
  UNION ALL SELECT e.t, [e.a, e.b] FROM e JOIN c ON c.t = e.t AND c.bucket = e.bucket AND c.n = e.a JOIN g ON g.t = e.t AND g.bucket = e.bucket AND g.c = c.c JOIN ec ON ec.t = e.t AND ec.bucket = e.bucket AND ec.c = c.c WHERE ec.n * 2 <> m * (m - 1))"""
_TIER = "(['binary_hash','acoustid_track','recording_mbid','metadata_duration_candidate'])[t]"
_LABEL = "(['Exact binary duplicate','Strong perceptual duplicate','Likely same recording','Weak metadata-duration candidate'])[t]"


def files(s, d) -> DataFrame:
    i = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (i % 8 + 1).cast("int"))
    return table(s, d, "documents").select(
        i.alias("file_id"), F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/"), i, ext).alias("path"), ext.alias("ext"), F.col("n_chars").alias("size_bytes"), F.col("text").alias("content"),
        F.when(i % 2 == 0, 16).otherwise(24).alias("bits"), F.when(i % 3 == 0, 96000).otherwise(44100).alias("rate"), (i % 50).alias("ac"), ((i % 100) / 100).alias("score"), F.when(i % 4 != 0, i % 40).alias("rec"),
        F.col("lang").alias("title"), F.col("source").alias("artist"), (F.col("n_chars") / 10).alias("dur"),
        F.when(i % 5 > 0, F.col("n_chars") * 8).alias("bitrate"), (i % 2 + 1).alias("channels"), F.when(i % 6 == 0, "alac").when(i % 6 == 1, "mp3").alias("codec"),
    )


def tier_tables(s, d) -> list[DataFrame]:
    f = files(s, d)
    # the table has the contents beside the sizes: to hash them there costs less than to move them to their sizes
    digests = f.select("file_id", "size_bytes", F.sha2("content", 256).alias("digest"))
    hashed = D.by_key(D.worth_hashing(digests), F.col("digest"), "binary_hash")
    tracks = f.select("file_id", X.match_token(F.col("title")).alias("title"), X.match_token(F.col("artist")).alias("artist"), "dur")
    islands = D.duration_islands(tracks, ["title", "artist"], "dur", "file_id")
    weak = D.by_key(islands, F.concat_ws("|", "title", "artist", "island"), "metadata_duration_candidate")
    return [hashed, D.by_key(f.filter("score >= 0.85"), F.col("ac"), "acoustid_track"), D.by_key(f, F.col("rec"), "recording_mbid"), weak]


def keep_first() -> list:
    return D.keeper_order(X.lossless(F.lit(None).cast("string"), F.col("ext")), F.col("bits"), F.col("rate"), F.lit(None).cast("int"), F.col("size_bytes"), F.col("path"))


@query("a6_size_gate", f"WITH {FILES_SQL} SELECT file_id, size_bytes FROM f WHERE size_bytes IN (SELECT size_bytes FROM f GROUP BY 1 HAVING count(*) > 1)")
def a6(s, d):
    return D.worth_hashing(files(s, d)).select("file_id", "size_bytes")


@query("d1_binary_hash", f"WITH {FILES_SQL} SELECT sha256(content) AS bucket, file_id AS file FROM f WHERE content IN (SELECT content FROM f GROUP BY 1 HAVING count(*) > 1)")
def d1(s, d):
    return D.by_key(D.worth_hashing(files(s, d)), F.sha2("content", 256), "binary_hash").select("bucket", "file")


@query("d2_fingerprint_tier", f"WITH {FILES_SQL}, g AS (SELECT * FROM f WHERE score >= 0.85) SELECT CAST(ac AS VARCHAR) AS bucket, file_id AS file FROM g WHERE ac IN (SELECT ac FROM g GROUP BY 1 HAVING count(*) > 1)")
def d2(s, d):
    return D.by_key(files(s, d).filter("score >= 0.85"), F.col("ac"), "acoustid_track").select("bucket", "file")


@query("d3_recording_tier", f"WITH {FILES_SQL} SELECT CAST(rec AS VARCHAR) AS bucket, file_id AS file FROM f WHERE rec IN (SELECT rec FROM f GROUP BY 1 HAVING count(*) > 1)")
def d3(s, d):
    return D.by_key(files(s, d), F.col("rec"), "recording_mbid").select("bucket", "file")


_ISLANDS = """WITH k AS (SELECT p_partkey, nullif(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), '') AS title, nullif(regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g'), '') AS artist, p_retailprice AS dur FROM part),
n AS (SELECT *, CASE WHEN dur - lag(dur) OVER w > 2.0 THEN 1 ELSE 0 END AS new FROM k WINDOW w AS (PARTITION BY title, artist ORDER BY dur, p_partkey)),
i AS (SELECT *, sum(new) OVER (PARTITION BY title, artist ORDER BY dur, p_partkey) AS island FROM n)"""


@query("w2_d4_duration_islands", _ISLANDS + " SELECT p_partkey, title, artist, CAST(island AS BIGINT) AS island, members FROM (SELECT *, count(*) OVER (PARTITION BY title, artist, island) AS members FROM i) WHERE members > 1")
def d4(s, d):
    t = table(s, d, "part").select("p_partkey", X.match_token(F.col("p_name")).alias("title"), X.match_token(F.col("p_brand")).alias("artist"), F.col("p_retailprice").alias("dur"))
    return D.duration_islands(t, ["title", "artist"], "dur", "p_partkey").select("p_partkey", "title", "artist", "island", "members")


@query("j6_duration_pairs", _ISLANDS + " SELECT title, artist, min(dur) AS low, max(dur) AS high FROM i GROUP BY title, artist, island HAVING count(*) > 1")
def j6(s, d):
    t = table(s, d, "part").select("p_partkey", X.match_token(F.col("p_name")).alias("title"), X.match_token(F.col("p_brand")).alias("artist"), F.col("p_retailprice").alias("dur"))
    return D.duration_islands(t, ["title", "artist"], "dur", "p_partkey").groupBy("title", "artist", "island").agg(F.min("dur").alias("low"), F.max("dur").alias("high")).drop("island")


@query(
    "d6_tiered_duplicates",
    PAIRS_SQL + f", m AS (SELECT row_number() OVER () AS g, t, unnest(files) AS file FROM groups) SELECT {_TIER} AS tier, {_LABEL} AS label, list(file ORDER BY lower(path), file) AS files FROM m JOIN f ON f.file_id = m.file GROUP BY g, t",
)
def d6(s, d):
    paths = files(s, d).select(F.col("file_id").alias("file"), "path")
    groups, pairs = D.groups_and_pairs(tier_tables(s, d), about=paths)
    return D.ordered_groups(groups, paths).unionByName(D.ordered_pairs(pairs)).select("tier", "label", "files")


@query("j7_d5_uncovered_pairs", PAIRS_SQL + f" SELECT {_TIER} AS tier, a, b FROM e")
def d5(s, d):
    return D.uncovered_pairs(tier_tables(s, d)).select("tier", "a", "b")


@query("d5_pair_counts", PAIRS_SQL + f" SELECT {_TIER} AS tier, c AS component, m AS files, ec.n AS pairs FROM g JOIN ec USING (t, bucket, c)")
def d5_counts(s, d):
    """Only components of the whole bucket's graph: what lists nothing must count the same pairs."""
    return D.uncovered_pair_counts(tier_tables(s, d)).select("tier", "component", "files", "pairs")


@query("a5_tier_counts", PAIRS_SQL + f" SELECT {_TIER} AS tier, count(*) AS n FROM groups GROUP BY 1")
def a5(s, d):
    return D.uncovered_group_counts(tier_tables(s, d))


@query("w8_group_order", PAIRS_SQL + " SELECT t AS tier_rank, files[1] AS first, len(files) AS members FROM groups")
def w8(s, d):
    groups, pairs = D.groups_and_pairs(tier_tables(s, d))
    each = [D.group_heads(groups), D.pair_heads(pairs)]
    heads = [x.select(F.col("tier_rank").cast("int").alias("tier_rank"), "first", "members") for x in each]
    return heads[0].unionByName(heads[1])


_PLAN = f"""WITH {FILES_SQL}, h AS (SELECT *, sha256(content) AS b, count(*) OVER (PARTITION BY content) AS n FROM f),
plan AS (SELECT b, file_id AS file, row_number() OVER (PARTITION BY b ORDER BY ext IN ('.flac','.wav','.aiff') DESC, bits DESC, rate DESC, size_bytes DESC, lower(path)) AS rank FROM h WHERE n > 1)"""


def plan(s, d) -> DataFrame:
    f = files(s, d)
    members = D.by_key(D.worth_hashing(f), F.sha2("content", 256), "binary_hash").withColumnRenamed("bucket", "group_id").join(f.withColumnRenamed("file_id", "file"), "file")
    return D.cleanup_plan(members, keep_first())


@query("w4_d7_cleanup_plan", _PLAN + " SELECT file, rank, CASE WHEN rank = 1 THEN 'keep' ELSE 'move' END AS action FROM plan")
def d7(s, d):
    return plan(s, d).select("file", F.col("rank").cast("long").alias("rank"), "action")


_LEDGER = _PLAN + """, m AS (SELECT *, min(file) OVER (PARTITION BY b) AS g, file % 7 <> 3 AS there, file % 7 <> 3 AND file % 11 = 5 AND file > 400 AS bad FROM plan),
j AS (SELECT m.*, k.there AS kept FROM m JOIN m k ON k.b = m.b AND k.rank = 1 WHERE m.rank > 1), e AS (SELECT g AS eg, rank AS er FROM j WHERE bad AND kept ORDER BY g, rank LIMIT 1),
l AS (SELECT j.file, CASE WHEN g > eg OR g = eg AND rank > er THEN 'not_attempted_cancelled' WHEN NOT kept THEN 'skipped_group' WHEN NOT there THEN 'skipped_missing' WHEN bad THEN 'failed' ELSE 'moved' END AS result
  FROM j LEFT JOIN e ON TRUE)"""


def ledger(s, d) -> DataFrame:
    f = files(s, d).select(F.col("file_id").alias("file"))
    planned = plan(s, d)
    first = planned.groupBy("group_id").agg(F.min("file").alias("first"))
    return D.action_ledger(planned.join(first, "group_id"), f.filter("file % 7 <> 3"), f.filter("file % 11 = 5 and file > 400"), order="first")


@query("d8_action_ledger", _LEDGER + " SELECT file, result FROM l")
def d8(s, d):
    return ledger(s, d).select("file", "result")


@query("a11_s11_cleanup_counters", _LEDGER + " SELECT count(*) FILTER (result = 'moved') AS moved, count(*) FILTER (result = 'failed') AS failed, count(*) FILTER (result LIKE 'skipped%') AS skipped, count(*) FILTER (result LIKE 'not_%') AS not_attempted, count(*) AS planned FROM l")
def a11(s, d):
    return D.cleanup_counters(ledger(s, d))


@query(
    "s11_cleanup_summary",
    _LEDGER + """, w AS (SELECT ac FROM f WHERE score >= 0.85 GROUP BY ac HAVING count(*) > 1),
x AS (SELECT (SELECT count(DISTINCT b) FROM plan) AS eligible_groups, (SELECT count(*) FROM w) AS review_only_groups, (SELECT count(*) FROM plan WHERE rank > 1) AS files_to_move, (SELECT count(*) FROM plan WHERE rank = 1) AS files_to_keep),
y AS (SELECT count(*) FILTER (result = 'moved') AS moved_successfully, count(*) FILTER (result = 'failed') AS failed, count(*) FILTER (result LIKE 'skipped%') AS skipped, min(file) FILTER (result = 'failed') AS bad FROM l)
SELECT 'run' AS kind, eligible_groups + review_only_groups AS total_groups_found, x.*, y.* EXCLUDE (bad), bad IS NOT NULL AS cancelled, 'cancelled after a failed move of ' || bad AS cancellation_reason FROM x, y
UNION ALL SELECT 'called off', eligible_groups + review_only_groups, x.*, 0, 0, 0, files_to_move > 0, CASE WHEN files_to_move > 0 THEN 'no' END FROM x""",
)
def s11(s, d):
    """A run that a failed move may end, and one that is called off before it starts; groups of a weaker tier are for review."""
    f = files(s, d)
    review = D.by_key(f.filter("score >= 0.85"), F.col("ac"), "acoustid_track").select("tier", F.concat(F.lit("ac-"), "bucket").alias("group_id"), "file").withColumn("action", F.lit("review"))
    moves = plan(s, d)
    whole = moves.select("tier", "group_id", "file", "action").unionByName(review)
    first = D.cleanup_summary(whole, ledger(s, d)).withColumn("kind", F.lit("run"))
    off = D.cleanup_summary(whole, D.action_ledger(moves, f.select(F.col("file_id").alias("file")), cancelled=True), reason="no").withColumn("kind", F.lit("called off"))
    return first.unionByName(off)


@query(
    "p20_quality_reason",
    f"""WITH {FILES_SQL}, q AS (SELECT *, CASE WHEN codec IS NOT NULL THEN codec = 'alac' ELSE ext IN ('.flac','.wav','.aiff') END AS lossless FROM f)
SELECT file_id, path, ext AS extension, codec, lossless, bits AS bits_per_sample, rate AS sample_rate_hz, bitrate AS bitrate_bps, size_bytes, dur AS duration_seconds,
  concat_ws(', ', CASE WHEN lossless THEN 'lossless audio preferred (' || coalesce(codec, ext) || ')' WHEN codec IS NOT NULL THEN 'codec=' || codec END, bits || '-bit', rate || ' Hz', bitrate || ' bps', size_bytes || ' bytes') AS reason FROM q""",
)
def p20(s, d):
    c = F.col
    q = D.quality_fields(c("path"), c("ext"), c("codec"), X.lossless(c("codec"), c("ext")), c("bits"), c("rate"), c("bitrate"), c("size_bytes"), c("dur"))
    return files(s, d).select("file_id", q.alias("q")).select("file_id", "q.*", D.quality_reason(c("q")).alias("reason"))


_ADVICE = "CASE t " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(D.ADVICE.values(), 1)) + " END"


@query(
    "s10_duplicate_report",
    PAIRS_SQL + f""", m AS (SELECT t, {_TIER} || ':' || files[1] || ':' || files[-1] || ':' || len(files) AS group_id, unnest(files) AS file FROM groups)
SELECT group_id, {_TIER} AS tier, {_LABEL} AS confidence_label, path, ext AS extension, size_bytes, dur AS duration_seconds, bitrate AS bitrate_bps, rate AS sample_rate_hz, channels, bits AS bits_per_sample, sha256(content) AS content_hash,
  CAST(ac AS VARCHAR) AS acoustid_id, score AS acoustid_score, CAST(rec AS VARCHAR) AS recording_mbid, coalesce(CASE WHEN ac % 2 = 0 THEN 'tags' END, {_TIER}) AS source, {_ADVICE} AS recommended_action FROM m JOIN f ON f.file_id = m.file""",
)
def s10(s, d):
    about = files(s, d).select(
        F.col("file_id").alias("file"), "path", F.col("ext").alias("extension"), "size_bytes", F.col("dur").alias("duration_seconds"), F.col("bitrate").alias("bitrate_bps"), F.col("rate").alias("sample_rate_hz"), "channels",
        F.col("bits").alias("bits_per_sample"), F.sha2("content", 256).alias("content_hash"), F.col("ac").cast("string").alias("acoustid_id"), F.col("score").alias("acoustid_score"), F.col("rec").cast("string").alias("recording_mbid"),
        F.when(F.col("ac") % 2 == 0, "tags").alias("source"),
    )
    groups, pairs = D.groups_and_pairs(tier_tables(s, d), about=about)
    return D.report_rows(D.numbered_groups(groups), about).unionByName(D.report_pairs(pairs))


@query("s2_extension_scan", f"WITH {FILES_SQL} SELECT file_id, path FROM f WHERE lower(ext) = '.flac'")
def s2(s, d):
    return files(s, d).filter(F.lower("ext") == ".flac").select("file_id", "path")


@query(
    "m2_copy_results",
    f"""WITH {FILES_SQL}, t AS (SELECT file_id, '/out/' || file_id % 300 AS target, CASE WHEN file_id % 9 = 0 THEN 'duplicate_skipped' WHEN file_id % 9 = 1 THEN 'unmatched' WHEN file_id % 31 = 2 THEN 'error' ELSE 'planned' END AS plan FROM f),
a AS (SELECT *, plan IN ('planned', 'unmatched') AS active FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY active, target ORDER BY file_id) AS rn FROM a)
SELECT file_id, CASE WHEN NOT active THEN 'skipped' WHEN rn > 1 THEN 'error: target reserved' WHEN file_id % 7 = 3 THEN 'error: source missing' WHEN file_id % 300 % 10 = 4 THEN 'error: target exists' ELSE 'copied' END AS status FROM r""",
)
def m2(s, d):
    """Among the first rows of their targets there are some without a source: the next row of the target is refused all the same."""
    from mediagraph.operators.plan import copy_results

    f, i = files(s, d), F.col("file_id")
    plan = F.when(i % 9 == 0, "duplicate_skipped").when(i % 9 == 1, "unmatched").when(i % 31 == 2, "error").otherwise("planned")
    planned = f.select("file_id", F.concat(F.lit("/OUT/"), i % 300).alias("target"), plan.alias("plan"))
    there = f.filter("file_id % 300 % 10 = 4").select(F.concat(F.lit("/Out/"), i % 300).alias("target"))
    return copy_results(planned, f.filter("file_id % 7 <> 3").select("file_id"), there).select("file_id", "status")


@query("m3_tag_eligibility", f"WITH {FILES_SQL} SELECT file_id, CASE WHEN file_id % 5 = 0 THEN 'skipped' WHEN file_id % 11 = 0 THEN 'unsupported_format' ELSE 'tagged' END AS status FROM f")
def m3(s, d):
    from mediagraph.operators.plan import tag_eligibility

    ext = F.when(F.col("file_id") % 11 == 0, ".ape").otherwise(F.upper("ext"))
    return tag_eligibility(files(s, d).withColumn("copied", F.col("file_id") % 5 != 0).withColumn("ext", ext), "file_id", "path", "ext", F.col("copied")).select("file_id", "status")
