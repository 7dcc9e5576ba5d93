"""One query for each family of column functions, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mediagraph.functions import lyrics as L
from mediagraph.functions import text as X
from mediagraph.plans.registry import query, table

FOLD = "replace(lower({0}), 'ß', 'ss')"


@query("p1_tag_key", r"SELECT p_partkey, regexp_replace(lower(p_name), '[^\p{L}\p{N}]', '', 'g') AS k FROM part")
def p1(s, d):
    return table(s, d, "part").select("p_partkey", X.tag_key(F.col("p_name")).alias("k"))


@query(
    "p2_tag_identifier",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE trim(props) END AS recording, CASE WHEN event_id % 4 = 0 THEN 'album' ELSE 'own' END || user_id AS release, 'I' || user_id AS isrc, CASE WHEN event_id % 5 > 0 THEN 'A' || event_id END AS acoustid FROM events",
)
def p2(s, d):
    """Keys as they are and keys that hold one; an exact key before a longer one that comes first."""
    e, i = table(s, d, "events"), F.col("event_id")
    tag = lambda k, *v: F.struct(F.lit(k).alias("key"), F.array(*v).alias("values"))
    tags = F.array(
        tag("Title", F.lit(" "), F.col("event_type")), tag("MusicBrainz Track Id", F.when(i % 3 == 0, "").otherwise(F.col("props"))), tag("x-isrc-code", F.concat(F.lit("I"), F.col("user_id"))),
        tag("My MusicBrainz Album Id", F.concat(F.lit("own"), "user_id")), tag("MUSICBRAINZ_ALBUMID", F.when(i % 4 == 0, F.concat(F.lit(" album"), "user_id")).otherwise(" ")), tag("Acoustid Id", F.when(i % 5 > 0, F.concat(F.lit("A"), i))),
    )
    keys = {"recording": (X.RECORDING_KEYS, X.RECORDING_KEYS[:2]), "release": (("musicbrainzalbumid",),) * 2, "isrc": (("isrc", "tsrc"), ("isrc",)), "acoustid": (("acoustidid",),) * 2}
    return e.select("event_id", *[X.tag_lookup(tags, *k).alias(n) for n, k in keys.items()])


@query("p3_tag_display", "SELECT doc_id, trim(source) AS artist, trim(lang) AS album FROM documents")
def p3(s, d):
    t = table(s, d, "documents")
    tag = lambda k, v: F.struct(F.lit(k).alias("key"), F.array(v).alias("values"))
    tags = F.array(tag("artist sort", F.lit("zz")), tag("ALBUM ARTIST", F.lit("later")), tag("Artist", F.col("source")), tag("TALB", F.col("lang")))
    return t.select("doc_id", X.display_lookup(tags, X.ARTIST_KEYS).alias("artist"), X.display_lookup(tags, X.ALBUM_KEYS).alias("album"))


@query("p4_flat_clean", "SELECT doc_id, list_filter([trim(lang), '', trim(source) || CASE WHEN doc_id % 2 = 0 THEN 'é' ELSE 'ü' END], lambda x: x <> '') AS v FROM documents")
def p4(s, d):
    """Texts, and bytes in UTF-8 (even ids) or Latin-1."""
    end = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("C3A920"))).otherwise(F.unhex(F.lit("FC20")))
    data = X.decoded(F.concat(F.encode("source", "utf-8"), end))
    return table(s, d, "documents").select("doc_id", X.flat_clean(F.array(F.array(F.col("lang"), F.lit("  ")), F.array(data))).alias("v"))


@query("p5_first_identifier", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_name END), ''), nullif(trim(c_mktsegment), '')) AS v FROM customer")
def p5(s, d):
    return table(s, d, "customer").select("c_custkey", X.first_clean(F.when(F.col("c_custkey") % 2 == 0, " ").otherwise(F.col("c_name")), F.col("c_mktsegment")).alias("v"))


@query("p6_lenient_numbers", r"SELECT event_id, try_cast(regexp_extract(props, '(\d+)', 1) AS INT) AS i, try_cast(event_type AS DOUBLE) AS f FROM events")
def p6(s, d):
    return table(s, d, "events").select("event_id", X.lenient_int(F.regexp_extract("props", r"(\d+)", 1)).alias("i"), X.lenient_double(F.col("event_type")).alias("f"))


@query("p7_distinct_clean", "SELECT p_partkey, CASE WHEN p_brand = p_type THEN [p_brand] ELSE [p_brand, p_type] END AS v FROM part")
def p7(s, d):
    return table(s, d, "part").select("p_partkey", X.distinct_clean(F.array(F.col("p_brand"), F.lit(" "), F.concat(F.lit(" "), F.col("p_type")), F.col("p_brand"))).alias("v"))


@query("p8_match_token", rf"SELECT doc_id, nullif(regexp_replace({FOLD.format('text')}, '[^\p{{L}}\p{{N}}]', '', 'g'), '') AS v FROM documents")
def p8(s, d):
    return table(s, d, "documents").select("doc_id", X.match_token(F.col("text")).alias("v"))


@query("p9_match_text", rf"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({FOLD.format('text')}, '\([^)]*\)', ' ', 'g'), '\[[^\]]*\]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS v FROM documents")
def p9(s, d):
    return table(s, d, "documents").select("doc_id", X.match_text(F.col("text")).alias("v"))


@query("p10_primary_artist", "SELECT c_custkey, c_name AS v FROM customer")
def p10(s, d):
    mixed = F.concat("c_name", F.element_at(F.array(*map(F.lit, ("", "; other", " feat. other", " ft other", " featuring x with y"))), (F.col("c_custkey") % 5 + 1).cast("int")))
    return table(s, d, "customer").select("c_custkey", X.primary_artist(mixed).alias("v"))


@query(
    "p11_variant_mismatch",
    "SELECT p_partkey, list_sort(list_intersect(string_split(trim(regexp_replace(lower(a), '[^a-z0-9]+', ' ', 'g')), ' '), ['live','remix','cover'])) <> list_sort(list_intersect(string_split(trim(regexp_replace(lower(b), '[^a-z0-9]+', ' ', 'g')), ' '), ['live','remix','cover'])) AS v "
    "FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (Live)' ELSE '' END AS a, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' - LIVE' ELSE '' END AS b FROM part)",
)
def p11(s, d):
    add = lambda n, t: F.concat("p_name", F.when(F.col("p_partkey") % n == 0, t).otherwise(""))
    return table(s, d, "part").select("p_partkey", X.variant_mismatch(add(2, " (Live)"), add(3, " - LIVE")).alias("v"))


@query(
    "p12_instrumental",
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN TRUE WHEN p_size % 3 = 0 THEN p_size % 2 = 0 WHEN p_size % 11 = 0 THEN TRUE ELSE p_size % 7 = 0 END AS v FROM part",
)
def p12(s, d):
    z = F.col("p_size")
    flags = [F.when(z % 5 == 0, " Yes").otherwise("no"), F.when(z % 3 == 0, z % 2 == 0), F.when(z % 11 == 0, "INSTRUMENTAL")]
    return table(s, d, "part").select("p_partkey", X.instrumental(flags, [F.concat("p_type", F.when(z % 7 == 0, " (Instrumental)").otherwise(""))]).alias("v"))


@query("p13_path_component", r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[?:/\\*"<>|]+', ' ', 'g'), '\s+', ' ', 'g')), ''), 'Unknown') AS v FROM pages""")
def p13(s, d):
    return table(s, d, "pages").select("page_id", X.path_component(F.col("url"), "Unknown").alias("v"))


@query(
    "p14_disc_and_track",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_partkey % 4 WHEN 0 THEN CAST(l_suppkey % 9 AS INT) WHEN 1 THEN CAST(l_suppkey % 9 AS INT) ELSE NULL END AS disc, CASE WHEN l_partkey % 4 = 3 THEN NULL ELSE l_linenumber END AS track FROM lineitem",
)
def p14(s, d):
    k, n = F.col("l_partkey") % 4, F.col("l_suppkey") % 9
    stem = F.when(k == 0, F.format_string("CD%d - %d Song", n, F.col("l_linenumber"))).when(k == 1, F.format_string("%d-%d - Song", n, F.col("l_linenumber"))).when(k == 2, F.format_string("%d - Song", F.col("l_linenumber"))).otherwise("Song")
    t = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", X.disc_and_track(stem).alias("n"))
    return t.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "n.disc", "n.track")


@query(
    "p15_file_name",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity > 25 AND l_suppkey % 3 <> 0 THEN printf('%d-%02d - %s%s', l_suppkey % 3, l_linenumber, l_returnflag, '.flac') ELSE printf('%02d - %s%s', l_linenumber, l_returnflag, '.flac') END AS v FROM lineitem",
)
def p15(s, d):
    disc = F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey") % 3)
    v = X.file_name(disc, F.when(F.col("l_quantity") > 25, 2).otherwise(1), F.col("l_linenumber"), F.col("l_returnflag"), F.lit("flac"))
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", v.alias("v"))


@query("p16_of_total", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN CASE WHEN l_tax > 0.04 THEN l_linenumber || '/7' ELSE CAST(l_linenumber AS VARCHAR) END END AS v FROM lineitem")
def p16(s, d):
    n, total = F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")), F.when(F.col("l_tax") > 0.04, 7)
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", X.of_total(n, total).alias("v"))


@query("p17_quick_key", "SELECT doc_id, sha256('/lib/' || source || '/' || doc_id || '|' || n_chars || '|' || doc_id * 1000) AS v FROM documents")
def p17(s, d):
    return table(s, d, "documents").select("doc_id", X.quick_key(F.concat_ws("/", F.lit("/lib"), "source", "doc_id"), F.col("n_chars"), F.col("doc_id") * 1000).alias("v"))


@query("p18_content_hash", "SELECT doc_id, sha256(text) AS v FROM documents")
def p18(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("v"))


@query(
    "p19_lossless",
    "SELECT doc_id, CASE WHEN codec LIKE 'pcm%' OR codec IN ('alac','flac') THEN TRUE WHEN codec IN ('mp3','opus') THEN FALSE ELSE ext IN ('.flac','.wav') END AS v FROM (SELECT doc_id, (['pcm_x','alac','mp3','opus',NULL,'audio/flac'])[doc_id % 6 + 1] AS codec, (['.flac','.wav','.ogg','.m4a'])[doc_id % 4 + 1] AS ext FROM documents)",
)
def p19(s, d):
    pick = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("doc_id") % n + 1).cast("int"))
    return table(s, d, "documents").select("doc_id", X.lossless(pick(6, "pcm_x", "ALAC ", "mp3", "opus", None, "audio/flac"), pick(4, ".FLAC", ".wav", ".ogg", ".m4a")).alias("v"))


@query("p21_effective_cutoff", "SELECT vec_id, least(20500.0, greatest(0.0, (label * 6000) / 2 - 100))::DOUBLE AS v FROM embeddings")
def p21(s, d):
    return table(s, d, "embeddings").select("vec_id", X.effective_cutoff(F.col("label") * 6000).alias("v"))


@query(
    "p22_fraction_text",
    "SELECT user_id, string_agg(printf('%d=%.4f', k, v), ';' ORDER BY k) AS v, count(*) AS parsed FROM (SELECT user_id, CAST(event_id % 5 AS INT) AS k, round(count(*) / 7.0, 3) AS v FROM events GROUP BY ALL) GROUP BY user_id",
)
def p22(s, d):
    parts = table(s, d, "events").groupBy("user_id", (F.col("event_id") % 5).cast("int").alias("k")).agg(F.round(F.count("*") / 7.0, 3).alias("v"))
    maps = parts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m")).select("user_id", X.fractions_text(F.col("m")).alias("v"))
    return maps.select("user_id", "v", F.size(X.fractions_map(F.concat("v", F.lit(";x=1;3")))).cast("long").alias("parsed"))


@query("p23_release_year", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y') END AS v FROM orders")
def p23(s, d):
    return table(s, d, "orders").select("o_orderkey", X.release_year(F.when(F.col("o_orderkey") % 5 == 0, "199").otherwise(F.date_format("o_orderdate", "yyyy-MM"))).alias("v"))


@query(
    "p24_credit_phrase",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus || ' & ' || o_custkey END AS v FROM orders",
)
def p24(s, d):
    part = lambda n, j: F.struct(n.alias("name"), F.lit(j).alias("join"))
    parts = F.array(part(F.col("o_orderstatus"), " & "), part(F.col("o_custkey").cast("string"), None))
    return table(s, d, "orders").select("o_orderkey", X.credit_phrase(parts, F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))).alias("v"))


@query("p25_genre", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '; ' || p_type END ELSE p_name END AS v FROM part")
def p25(s, d):
    genres = F.when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type", "p_brand"))
    return table(s, d, "part").select("p_partkey", X.genre_text(genres, F.array("p_name")).alias("v"))


@query(
    "p26_relations",
    "SELECT l_orderkey, list_sort(list_distinct(list(l_shipmode) FILTER (l_returnflag = 'A'))) AS composers FROM (SELECT l_orderkey, l_returnflag, 'S' || l_suppkey % 7 AS l_shipmode FROM lineitem) GROUP BY l_orderkey HAVING count(*) FILTER (l_returnflag = 'A') > 0",
)
def p26(s, d):
    rel = F.struct(F.when(F.col("l_returnflag") == "A", "composer").otherwise("remixer").alias("type"), F.concat(F.lit("S"), F.col("l_suppkey") % 7).alias("name"))
    t = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(rel).alias("rels"))
    return t.select("l_orderkey", F.array_sort(X.names_by_relation(F.col("rels"), "composer")).alias("composers")).filter(F.size("composers") > 0)


@query("p27_short_id", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'unknown' ELSE left(replace(p_brand || '-' || p_type, '-', ''), 8) END AS v FROM part")
def p27(s, d):
    return table(s, d, "part").select("p_partkey", X.short_id(F.when(F.col("p_partkey") % 4 == 0, " -- ").otherwise(F.concat_ws("-", "p_brand", "p_type"))).alias("v"))


_LRC = "conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN '' ELSE '[00:0' || turn % 10 || '.5]' END || trim(split_part(text, chr(10), 1)) AS line"


_LINES = "li AS (SELECT conv_id, turn, text, trim(unnest(string_split(text, chr(10)))) AS t, unnest(range(len(string_split(text, chr(10))))) AS p FROM conversations WHERE text IS NOT NULL)"


@query(
    "p28_timed_lyrics",
    f"WITH {_LINES} SELECT conv_id, list(t ORDER BY turn, text, p) AS texts, CAST(sum((turn % 10) * 1000 + 500) AS BIGINT) AS total_ms FROM li WHERE conv_id % 9 <> 0 GROUP BY conv_id",
)
def p28(s, d):
    """Every line of every turn with a stamp; without any in some conversations, which then have no timed lines at all."""
    stamp = F.when(F.col("conv_id") % 9 == 0, "").otherwise(F.concat(F.lit("[00:0"), F.col("turn") % 10, F.lit(".5]")))
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(stamp, x)), "\n")
    t = table(s, d, "conversations").filter("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", lines.alias("line")))).alias("l"))
    t = t.select("conv_id", L.timed_lines(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("e")).filter(F.size("e") > 0)
    return t.select("conv_id", F.transform("e", lambda x: x["text"]).alias("texts"), F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x["ms"]).alias("total_ms"))


@query("p29_plain_lyrics", f"WITH {_LINES} SELECT conv_id, turn, string_agg(t, chr(10) ORDER BY p) FILTER (t <> '') AS v FROM li GROUP BY conv_id, turn, text UNION ALL SELECT conv_id, turn, NULL FROM conversations WHERE text IS NULL")
def p29(s, d):
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("[00:01.00]"), x)), "\n")
    lrc = F.concat(F.lit("[ar: x]\n"), lines, F.lit("\n\n [00:02.00] "))
    return table(s, d, "conversations").select("conv_id", "turn", L.plain_text(lrc).alias("v"))


_SEGMENTS = """t AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN ' ' ELSE trim(text) END AS t, turn % 3 <> 2 AND conv_id % 7 <> 0 AS timed, printf('[%02d:%02d.%02d] ', CAST(turn * 150 // 6000 AS BIGINT), CAST(turn * 150 % 6000 // 100 AS BIGINT), CAST(turn * 150 % 100 AS BIGINT)) AS stamp FROM conversations)"""


@query(
    "p30_segment_lines",
    f"WITH {_SEGMENTS} SELECT conv_id, coalesce(list(stamp || t ORDER BY turn, t) FILTER (timed AND t <> ' '), CASE WHEN conv_id % 10 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['[00:00.00] full ' || conv_id] END) AS timed, coalesce(list(t ORDER BY turn, t) FILTER (t <> ' '), CASE WHEN conv_id % 10 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['full ' || conv_id] END) AS plain FROM t GROUP BY conv_id",
)
def p30(s, d):
    """Some segments have no time, all of some conversations' have none or no text, and some of those have no full text either."""
    c = F.col("conv_id")
    text, start = F.when(c % 5 == 0, " ").otherwise(F.trim("text")), F.when((F.col("turn") % 3 != 2) & (c % 7 != 0), F.col("turn") * 1.5).cast("double")
    t = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", text.alias("text"), start.alias("start")))).alias("l"))
    segments = F.transform("l", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start")))
    full = F.when(c % 10 == 0, " ").otherwise(F.concat(F.lit(" full "), c))
    return t.select("conv_id", L.segment_lines(segments, full, True).alias("timed"), L.segment_lines(segments, full, False).alias("plain"))


@query("p31_provider_text", "SELECT doc_id, nullif(trim(text), '') AS v FROM documents")
def p31(s, d):
    wrapped = F.concat(F.lit("12 Contributors\nSong Lyrics"), "text", F.lit("You might also like12Embed"))
    return table(s, d, "documents").select("doc_id", L.provider_text(wrapped).alias("v"))



@query("p34_confidence", "SELECT vec_id, CASE WHEN label / 8.0 >= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, (label / 8.0 - 0.05) / 0.95)) END::DOUBLE AS v FROM embeddings")
def p34(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(X.original_confidence(F.col("label") / 8.0), 12).alias("v"))


@query(
    "p35_provider_error",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'error status without a payload' WHEN 1 THEN 'error status with an empty payload' ELSE 'error status (code=' || user_id || ', message=' || event_type || ')' END AS v FROM events",
)
def p35(s, d):
    k = F.col("event_id") % 3
    return table(s, d, "events").select("event_id", X.provider_error(F.lit("error"), F.when(k == 2, F.col("user_id").cast("string")), F.when(k == 2, F.concat(F.lit(" "), "event_type")).otherwise(" "), k > 0).alias("v"))



@query("p39_first_format", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS v FROM part")
def p39(s, d):
    return table(s, d, "part").select("p_partkey", X.first_format(F.array(F.lit(" "), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(""), F.col("p_type"))).alias("v"))
