"""Queries of signal status and album grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.operators import graph as G
from mediagraph.operators import plan as M
from mediagraph.operators import signal as S
from mediagraph.plans.registry import query, table

# -- signals: embeddings as frames of 64 samples at 44100 Hz, label as the file --------------------------------------------------

#: Shares above each probe by a discrete Fourier transform in SQL; the first bin strictly above each cutoff.
RATIOS_SQL = """RECURSIVE x AS (SELECT vec_id, label, unnest(range(0, 64)) AS n, unnest(list_transform(embedding, lambda v: CASE WHEN isfinite(v) THEN v::DOUBLE ELSE 0 END)) AS v FROM embeddings),
w AS (SELECT vec_id, label, n, v * (0.5 - 0.5 * cos(2 * pi() * n / 63)) AS v FROM x),
m AS (SELECT vec_id, label, k, sqrt(power(sum(v * cos(2 * pi() * k * n / 64)), 2) + power(sum(v * sin(2 * pi() * k * n / 64)), 2)) AS a FROM w, range(0, 33) t(k) GROUP BY ALL),
c AS (SELECT * FROM (VALUES (13000), (16000), (19000), (20000), (20500)) t(cutoff)),
r AS (SELECT vec_id, label, cutoff, sum(CASE WHEN k * 44100 / 64.0 > cutoff THEN a ELSE 0 END) / sum(a) AS ratio FROM m, c GROUP BY ALL)"""
FRACTIONS_SQL = RATIOS_SQL + """, a AS (SELECT label, cutoff, coalesce(count(*) FILTER (ratio > 0.13) / nullif(count(*) FILTER (ratio > 0.00001), 0), 0) AS fraction, count(*) FILTER (ratio > 0.00001) AS heard, count(*) AS frames FROM r GROUP BY ALL)"""


def ratios(s, d) -> DataFrame:
    return S.band_ratios(table(s, d, "embeddings"), ["vec_id", "label"], "embedding", F.lit(44100))


def fractions(s, d) -> DataFrame:
    return S.active_fractions(ratios(s, d), "label", active=0.13)


@query("s3_signal_scrub", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda v: CASE WHEN isfinite(v) AND v > -0.5 THEN v::DOUBLE ELSE 0 END)), 6) AS total FROM embeddings")
def s3(s, d):
    bad = F.transform("embedding", lambda v: F.when(v > -0.5, v).otherwise(F.lit(float("nan")).cast("float")))
    t = table(s, d, "embeddings").select("vec_id", S.scrubbed(bad).alias("x"))
    return t.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double")), 6).alias("total"))


@query(
    "x1_frames",
    "WITH l AS (SELECT user_id, list(value ORDER BY ts, event_id) AS x FROM events GROUP BY 1), f AS (SELECT user_id, x, unnest(range(0, greatest(0, (len(x) - 32) // 16 + 1))) AS frame FROM l WHERE len(x) >= 32) SELECT user_id, frame, round(list_sum(x[frame * 16 + 1:frame * 16 + 32]), 4) AS total FROM f",
)
def x1(s, d):
    series = table(s, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda e: e["value"]).alias("x"))
    return S.frames(series, "user_id", "x", 32, 16).select("user_id", F.col("frame").cast("long").alias("frame"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("x2_silence_gate", "SELECT vec_id, list_max(list_transform(embedding, lambda v: abs(v))) < 0.25 AS silent FROM embeddings")
def x2(s, d):
    return table(s, d, "embeddings").select("vec_id", S.silent(F.col("embedding"), 0.25).alias("silent"))


@query("x3_x4_band_ratios", f"WITH {RATIOS_SQL} SELECT vec_id, cutoff, round(ratio, 6) AS ratio FROM r")
def x4(s, d):
    return ratios(s, d).select("vec_id", "cutoff", F.round("ratio", 6).alias("ratio"))


@query("x5_frame_counts", f"WITH {RATIOS_SQL} SELECT label, count(*) AS frames, count(*) FILTER (ratio > 0) AS heard FROM r WHERE cutoff = 20500 GROUP BY label")
def x5(s, d):
    return ratios(s, d).filter("cutoff = 20500").groupBy("label").agg(F.count("*").alias("frames"), F.count_if(F.col("ratio") > 0).alias("heard"))


@query("a1_a2_active_fractions", f"WITH {FRACTIONS_SQL} SELECT label, cutoff, round(fraction, 6) AS fraction FROM a")
def a2(s, d):
    return fractions(s, d).select("label", "cutoff", F.round("fraction", 6).alias("fraction"))


@query("a3_ratio_summary", f"WITH {RATIOS_SQL} SELECT label, round(min(ratio), 6) AS low, round(quantile_cont(ratio, 0.9), 6) AS p90, round(quantile_cont(ratio, 0.95), 6) AS p95, round(quantile_cont(ratio, 0.99), 6) AS p99, round(max(ratio), 6) AS high, round(avg(ratio), 6) AS mean FROM r WHERE cutoff = 20500 GROUP BY label")
def a3(s, d):
    q = F.percentile("ratio", F.array(F.lit(0.9), F.lit(0.95), F.lit(0.99)))
    t = ratios(s, d).filter("cutoff = 20500").groupBy("label").agg(F.min("ratio").alias("low"), q.alias("q"), F.max("ratio").alias("high"), F.avg("ratio").alias("mean"))
    return t.select("label", *[F.round(c, 6).alias(n) for c, n in (("low", "low"), (F.col("q")[0], "p90"), (F.col("q")[1], "p95"), (F.col("q")[2], "p99"), ("high", "high"), ("mean", "mean"))])


_ELBOW = FRACTIONS_SQL + """, q AS (SELECT *, lag(fraction) OVER (PARTITION BY label ORDER BY cutoff) AS prev FROM a),
e AS (SELECT label, coalesce(min(cutoff) FILTER (fraction <= 0.1 AND (prev IS NULL OR prev >= 0.5)), min(cutoff) FILTER (fraction <= 0.1)) AS cutoff FROM q GROUP BY label)"""


@query("w1_elbow", f"WITH {_ELBOW} SELECT label, cutoff, CAST((MAP {{13000: 96, 16000: 128, 19000: 192, 20000: 256, 20500: 320}})[cutoff] AS INT) AS kbps FROM e WHERE cutoff IS NOT NULL")
def w1(s, d):
    return S.elbow(fractions(s, d), "label", 0.1, 0.5).select("label", "cutoff", "kbps")


#: The signals of label 3 are flat here: no frame has anything to hear above a cutoff.
_FLAT = _ELBOW.replace("CASE WHEN isfinite(v) THEN v::DOUBLE ELSE 0 END", "CASE WHEN label = 3 THEN 1 WHEN isfinite(v) THEN v::DOUBLE ELSE 0 END")
_STATUS = f"""WITH {_FLAT}, t AS (SELECT a.label, a.heard, a.fraction AS top, e.cutoff, b.fraction AS low FROM a LEFT JOIN e ON e.label = a.label LEFT JOIN a b ON b.label = e.label AND b.cutoff = e.cutoff WHERE a.cutoff = 20500),
st AS (SELECT label, CASE WHEN heard = 0 THEN 'Likely UPSCALED (no significant frames)' WHEN top >= 0.12 THEN 'Likely ORIGINAL' WHEN cutoff IS NOT NULL THEN 'Likely UPSCALED from <=' || (MAP {{13000: 96, 16000: 128, 19000: 192, 20000: 256, 20500: 320}})[cutoff] || ' kbps' ELSE 'Inconclusive (no cutoff match)' END AS status,
  CASE WHEN heard = 0 THEN 0.0 WHEN top >= 0.12 THEN least(1.0, (top - 0.12) / 0.88) WHEN cutoff IS NOT NULL THEN 1 - low ELSE 0.0 END::DOUBLE AS confidence FROM t)"""


def statuses(s, d) -> DataFrame:
    signal = F.when(F.col("label") == 3, F.transform("embedding", lambda _: F.lit(1.0).cast("float"))).otherwise(F.col("embedding"))
    found = S.band_ratios(table(s, d, "embeddings").withColumn("embedding", signal), ["vec_id", "label"], "embedding", F.lit(44100))
    return S.file_status(S.active_fractions(found, "label", active=0.13), "label", 0.12, 0.1, 0.5)


@query("a4_file_status", _STATUS + " SELECT label, status, round(confidence, 6) AS confidence FROM st")
def a4(s, d):
    return statuses(s, d).select("label", "status", F.round("confidence", 6).alias("confidence"))


@query("p38_suspects", _STATUS + " SELECT label, status, 'batch' AS rule FROM st WHERE status <> 'Likely ORIGINAL' UNION ALL SELECT label, status, 'single' FROM st WHERE status LIKE 'Likely UPSCALED%'")
def p38(s, d):
    found = statuses(s, d)
    batch, single = S.suspects(found).withColumn("rule", F.lit("batch")), S.suspects(found, single=True).withColumn("rule", F.lit("single"))
    return batch.unionByName(single).select("label", "status", "rule")


@query("s9_analysis_rows", _STATUS + " SELECT 'label-' || label AS path, status, printf('%.6f', confidence) AS confidence FROM st")
def s9(s, d):
    return statuses(s, d).select(F.concat(F.lit("label-"), "label").alias("path"), "status", F.format_string("%.6f", "confidence").alias("confidence"))


@query("j14_probes", "SELECT vec_id, cutoff FROM embeddings, (VALUES (13000), (16000), (19000), (20000), (20500)) t(cutoff) WHERE cutoff <= least(20500, greatest(0, label * 6000 / 2 - 100))")
def j14(s, d):
    return table(s, d, "embeddings").select("vec_id", F.explode(S.probe_cutoffs(F.col("label") * 6000)).alias("cutoff"))


# -- album grouping: orders as files, kinds of parts as releases ------------------------------------------------------------------------

#: Orders as files: eight neighbouring orders may share releases, sixteen release groups.
CANDS_SQL = "f AS (SELECT DISTINCT l_orderkey AS file, (l_orderkey // 8) || '-' || l_partkey % 20 AS release, (l_orderkey // 16) || '-' || l_suppkey % 30 AS release_group, o_custkey % 5 AS parent FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
EDGES_SQL = CANDS_SQL + """, w AS (SELECT a, b, sum(w) AS w FROM (SELECT x.file AS a, y.file AS b, 2 AS w FROM (SELECT DISTINCT file, release FROM f) x JOIN (SELECT DISTINCT file, release FROM f) y ON x.release = y.release AND x.file < y.file
  UNION ALL SELECT x.file, y.file, 1 FROM (SELECT DISTINCT file, release_group AS g FROM f) x JOIN (SELECT DISTINCT file, release_group AS g FROM f) y ON x.g = y.g AND x.file < y.file) GROUP BY a, b),
p AS (SELECT DISTINCT file, parent FROM f), e AS (SELECT w.a, w.b, CAST(w.w + CAST(x.parent = y.parent AS INT) AS BIGINT) AS weight FROM w JOIN p x ON x.file = w.a JOIN p y ON y.file = w.b WHERE w.w + CAST(x.parent = y.parent AS INT) >= 2)"""
COMP_SQL = "WITH RECURSIVE " + EDGES_SQL + """, sy AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT DISTINCT file AS n, file AS c FROM f UNION SELECT sy.b, r.c FROM r JOIN sy ON sy.a = r.n),
cl AS (SELECT n AS file, min(c) AS cluster FROM r GROUP BY n), cc AS (SELECT cluster, release, count(DISTINCT f.file) AS files FROM f JOIN cl USING (file) GROUP BY ALL)"""


def candidates(s, d) -> DataFrame:
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("file"), "l_partkey", "l_suppkey")
    j = li.join(table(s, d, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 5).alias("parent")), "file")
    key = lambda n, c: F.concat(F.floor(F.col("file") / n), F.lit("-"), c)
    return j.select("file", key(8, F.col("l_partkey") % 20).alias("release"), key(16, F.col("l_suppkey") % 30).alias("release_group"), "parent").distinct()


def clusters(s, d) -> tuple[DataFrame, DataFrame]:
    c = G.saved(candidates(s, d), "candidates")
    return c, G.album_groups(c)


@query("j4_j5_shared_weights", f"WITH {EDGES_SQL} SELECT a, b, weight FROM e")
def j5(s, d):
    return G.shared_weights(candidates(s, d)).select("a", "b", F.col("weight").cast("long").alias("weight"))


@query("g1_g2_album_groups", COMP_SQL + " SELECT file, cluster FROM cl")
def g2(s, d):
    return clusters(s, d)[1]


@query("a7_candidate_counts", COMP_SQL + " SELECT cluster, release, files FROM cc")
def a7(s, d):
    return G.candidate_counts(*clusters(s, d))


@query("a12_release_index", f"WITH {CANDS_SQL} SELECT release, count(DISTINCT file) AS files, list_sort(list(DISTINCT file)) AS members FROM f GROUP BY release")
def a12(s, d):
    t = candidates(s, d).groupBy("release").agg(F.array_sort(F.collect_set("file")).alias("members"))
    return t.select("release", F.size("members").cast("long").alias("files"), "members")


_RANKED = COMP_SQL + ", rk AS (SELECT cluster, release, files, 10 * files AS score, row_number() OVER (PARTITION BY cluster ORDER BY files DESC, release) AS rank, sum(1) OVER (PARTITION BY cluster) AS n FROM cc)"


@query("r1_w5_shortlist", _RANKED + " SELECT cluster, release, score, rank FROM rk WHERE rank <= 3")
def w5(s, d):
    from mediagraph.operators.albums import shortlist

    return shortlist(G.candidate_counts(*clusters(s, d))).select("cluster", "release", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("r7_dominance", COMP_SQL + ", z AS (SELECT cluster, count(*) AS n FROM cl GROUP BY 1), o AS (SELECT cluster, files, row_number() OVER (PARTITION BY cluster ORDER BY files DESC, release) AS rank, lead(files, 1, 0) OVER (PARTITION BY cluster ORDER BY files DESC, release) AS next FROM cc) SELECT o.cluster, files / n >= 0.85 AND files - next >= greatest(3, CAST(floor(0.35 * n) AS BIGINT)) AS dominant FROM o JOIN z USING (cluster) WHERE rank = 1")
def r7(s, d):
    from mediagraph.operators.albums import dominant

    c, cl = clusters(s, d)
    cl = G.saved(cl, "clusters")
    return dominant(G.candidate_counts(c, cl), cl.groupBy("cluster").agg(F.count("*").alias("n"))).select("cluster", "dominant")


# -- output plan -------------------------------------------------------------------------------------------------------------------


def _in_turn(rows: str) -> str:
    """SQL that gives names to the rows of a table t (o, p, s, n, x, rec, path) one after another, as a step of a recursion for each
    row of a group: what is taken is a list. Groups are paths without any suffix in brackets, as only such paths can meet."""
    stem, ext = "regexp_replace(path, '\\.[^./]+$', '')", "regexp_extract(path, '(\\.[^./]+)$', 1)"
    name = f"{stem} || ' [' || rec || CASE WHEN k > 1 THEN '-' || k ELSE '' END || ']' || {ext}"
    return f"""{rows}, q AS (SELECT *, regexp_replace(path, '( \\[[^\\[\\]]*\\])+(\\.[^./]+)?$', '\\2') AS g FROM t),
z AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o, p, s, n, x) AS i FROM q),
w AS (SELECT g, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS taken, CAST([] AS VARCHAR[]) AS recs, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS output_path FROM (SELECT DISTINCT g FROM q)
UNION ALL SELECT v.g, v.i, CASE WHEN v.st = 'duplicate_skipped' THEN v.taken ELSE list_append(v.taken, v.out) END, CASE WHEN v.st = 'duplicate_skipped' THEN v.recs ELSE list_append(v.recs, v.rec) END, v.st, v.out
  FROM (SELECT u.*, CASE WHEN st <> 'renamed' THEN path ELSE free END AS out FROM (
    SELECT z.*, w.taken, w.recs, CASE WHEN NOT list_contains(w.taken, path) THEN 'planned' WHEN w.recs[list_position(w.taken, path)] = rec THEN 'duplicate_skipped' ELSE 'renamed' END AS st,
      list_filter(list_transform(range(1, len(w.taken) + 2), lambda k: {name}), lambda c: NOT list_contains(w.taken, c))[1] AS free
    FROM w JOIN z ON z.g = w.g AND z.i = w.i + 1) u) v),
pl AS (SELECT z.*, CASE WHEN w.status = 'renamed' THEN 'planned' ELSE w.status END AS status, w.output_path FROM w JOIN z ON z.g = w.g AND z.i = w.i)"""


#: Some rows ask for a name that others are given: the first or second suffix of a recording, or a suffix behind a suffix.
_ASKED = "CASE l_orderkey % 11 WHEN 0 THEN ' [r' || l_partkey % 5 || ']' WHEN 1 THEN ' [r3-2]' WHEN 2 THEN ' [r1] [r2]' WHEN 3 THEN ' [r1] [r2] [r3-3]' ELSE '' END"
_W9 = f"t AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, CAST(l_extendedprice AS VARCHAR) AS x, '/out/' || l_orderkey % 700 || '/' || l_linenumber || {_ASKED} || '.flac' AS path, 'r' || l_partkey % 5 AS rec FROM lineitem)"


@query("w9_collision_free", f"WITH RECURSIVE {_in_turn(_W9)} SELECT o, p, s, n, status, output_path FROM pl")
def w9(s, d):
    o, p = F.col("l_orderkey"), F.col("l_partkey")
    k = o % 11
    more = F.when(k == 0, F.concat(F.lit(" [r"), p % 5, F.lit("]"))).when(k == 1, " [r3-2]").when(k == 2, " [r1] [r2]").when(k == 3, " [r1] [r2] [r3-3]").otherwise("")
    t = table(s, d, "lineitem").select(
        o.alias("o"), p.alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").cast("string").alias("x"),
        F.concat(F.lit("/out/"), o % 700, F.lit("/"), "l_linenumber", more, F.lit(".flac")).alias("path"), F.concat(F.lit("r"), p % 5).alias("rec"),
    )
    return M.collision_free(t, "path", ["o", "p", "s", "n", "x"], ["rec"], "rec").select("o", "p", "s", "n", "status", "output_path")


#: One title in fourteen ends in a recording's short id in brackets, and so do some unmatched files.
_PLANNED = _in_turn("""t AS (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, CAST(l_extendedprice AS VARCHAR) AS x, 'r' || l_partkey % 5 AS rec, l_partkey % 13 = 0 AS lost,
  CASE WHEN l_partkey % 13 = 0 THEN '/out/_unmatched/' || l_orderkey % 900 || CASE WHEN l_orderkey % 4 = 0 THEN ' [r2]' ELSE '' END || '.flac' ELSE '/out/' || CASE WHEN l_suppkey % 7 < 2 THEN 'Unknown Artist' ELSE 'A B ' || l_suppkey % 7 END || '/Album ' || l_orderkey % 500 || '/'
    || CASE WHEN l_orderkey % 3 = 0 AND l_linenumber % 3 > 0 THEN l_linenumber % 3 || '-' ELSE '' END || '0' || l_linenumber || ' - ' || CASE WHEN l_linenumber = 7 THEN 'Unknown Title' ELSE 'T ' || l_linenumber END || CASE WHEN l_partkey % 14 = 1 AND l_linenumber < 7 THEN ' [r4]' ELSE '' END || '.flac' END AS path FROM lineitem)""") + """,
pm AS (SELECT o, p, s, n, CASE WHEN status = 'planned' AND lost THEN 'unmatched' ELSE status END AS status, output_path FROM pl)"""


def planned(s, d) -> DataFrame:
    o, p, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    t = table(s, d, "lineitem").select(
        o.alias("o"), p.alias("p"), F.col("l_suppkey").alias("s"), n.alias("n"), F.col("l_extendedprice").cast("string").alias("x"),
        F.concat(F.lit("/in/"), o % 900, F.when(o % 4 == 0, " [r2]").otherwise(""), F.lit(".flac")).alias("original_path"), (p % 13 != 0).alias("matched"),
        F.when(F.col("l_suppkey") % 7 == 0, " ").when(F.col("l_suppkey") % 7 > 1, F.concat(F.lit("A/B: "), F.col("l_suppkey") % 7)).alias("album_artist"), F.concat(F.lit("Album  "), o % 500).alias("album"),
        F.when(n == 7, "???").otherwise(F.concat(F.lit("T "), n, F.when(p % 14 == 1, " [r4]").otherwise(""))).alias("title"), n.alias("track_number"), (n % 3).alias("disc_number"), F.when(o % 3 == 0, 2).alias("total_discs"),
        F.when(o % 2 == 0, "flac").alias("extension"), F.concat(F.lit("r"), p % 5).alias("recording"),
    )
    return M.planned_files(t, "/out", ["o", "p", "s", "n", "x"], ["recording"], keep=["o", "p", "s", "n"])


@query("m1_plan_files", f"WITH RECURSIVE {_PLANNED} SELECT o, p, s, n, status, output_path FROM pm")
def m1(s, d):
    return planned(s, d).select("o", "p", "s", "n", "status", "output_path")
