"""Container tags, duplicate records, cached resolutions, sidecars, release matches and the text report on small inputs."""

import json

from pyspark.sql import functions as F

from mediagraph.operators import records, tags
from mediagraph.sources import reports


def tagged(spark, schema, *rows):
    out: dict = {}
    for r in tags.container_tags(spark.createDataFrame(rows, schema), "file", "ext").collect():
        assert r["container_key"] not in out.setdefault(r["file"], {})
        out[r["file"]][r["container_key"]] = r["values"]
    return out


def test_tags_of_each_family(spark):
    schema = "file long, ext string, title string, artist string, artists array<string>, track_number int, total_tracks int, recording_mbid string, track_mbid string, movement string, url string, album string"
    rows = [(n, e, " T ", "A", ["B", " ", None, "C"], 3, t, "r", "k", "m", "u", " ") for n, (e, t) in enumerate([(".flac", 9), (".MP3", 9), (".m4a", None), (".wma", 9), (".ape", 9), (None, 9)])]
    assert tagged(spark, schema, *rows) == {
        0: {"TITLE": ["T"], "ARTIST": ["A"], "ARTISTS": ["B", "C"], "TRACKNUMBER": ["3"], "TRACKTOTAL": ["9"], "TOTALTRACKS": ["9"], "MUSICBRAINZ_TRACKID": ["r"], "MUSICBRAINZ_RELEASETRACKID": ["k"], "MOVEMENTNAME": ["m"], "WEBSITE": ["u"]},
        1: {"TIT2": ["T"], "TPE1": ["B; C"], "TXXX:ARTISTS": ["B", "C"], "TRCK": ["3/9"], "UFID:http://musicbrainz.org": ["r"], "TXXX:MusicBrainz Track Id": ["k"], "WXXX:URL": ["u"]},
        2: {"\xa9nam": ["T"], "\xa9ART": ["B; C"], "----:com.apple.iTunes:Artists": ["B", "C"], "trkn": ["3", "0"], "----:com.apple.iTunes:MusicBrainz Recording Id": ["r"], "----:com.apple.iTunes:MusicBrainz Track Id": ["k"], "----:com.apple.iTunes:URL": ["u"]},
        3: {"Title": ["T"], "Author": ["B; C"], "WM/TrackNumber": ["3"], "MusicBrainz/Recording Id": ["r"], "MusicBrainz/Track Id": ["k"], "WM/AuthorURL": ["u"]},
    }


def test_tags_made_of_several_fields(spark):
    schema = "file long, ext string, artist string, artists array<string>, disc_number string, total_discs int, syncedlyrics string, website string, url string, rating int, rating_user_email string, musicip_fingerprint string"
    rows = [
        (1, ".ogg", None, [" "], "x", 2, None, " ", "u", 3, "me", "MusicMagic Fingerprint 1"), (2, ".opus", None, None, "1", None, None, "", "u", 3, " ", "2"),
        (3, ".wav", " A ", [], "1", 2, "[00:01.5] a\n[00:02.00][00:03.25] b", None, None, None, None, None), (4, ".aiff", "", None, None, 2, "[00:01.5] a\nb", None, None, None, None, None),
    ]
    assert tagged(spark, schema, *rows) == {
        1: {"RATING:me": ["3"], "FINGERPRINT": ["MusicMagic Fingerprint 1"], "TOTALDISCS": ["2"], "DISCTOTAL": ["2"], "DISCNUMBER": ["x"]},
        2: {"WEBSITE": ["u"], "RATING": ["3"], "FINGERPRINT": ["MusicMagic Fingerprint 2"], "DISCNUMBER": ["1"]},
        3: {"TPE1": ["A"], "TPOS": ["1/2"], "SYLT": ["1500 a", "2000 b", "3250 b"]},
    }


def test_every_key_of_a_family_is_one_field(spark):
    for family, pairs in tags.key_map().items():
        keys = [k for _, k in pairs] + list(tags.MADE[family].values())
        assert len(keys) == len(set(keys)) > 40, family
    assert tags.vorbis_keys("replaygain_track_gain") == ("REPLAYGAIN_TRACK_GAIN",) and tags.vorbis_keys("artist_sort") == ("ARTISTSORT",)


def test_cached_resolutions(spark):
    good = {"status": "s", "source": " x ", "recording_mbid": 7, "error": " ", "acoustid_score": "1.5", "track_number": 2, "candidate_release_mbids": ["a", None, " ", 3]}
    texts = [json.dumps(good), None, "", "null", "[]", "3", json.dumps(good | {"source": None}), json.dumps(good | {"candidate_recording_mbids": {}}), json.dumps({"status": "s", "source": "x"}), "{", '"text"']
    df = spark.createDataFrame(list(enumerate(texts)), "k long, j string").select("k", records.cached_resolution(F.col("j")).alias("r"))
    got = {r["k"]: r["r"] for r in df.collect()}
    assert [k for k, v in sorted(got.items()) if v is not None] == [0, 8]
    one = got[0].asDict()
    assert (one["source"], one["recording_mbid"], one["error"], one["acoustid_score"], one["track_number"], one["disc_number"]) == ("x", "7", None, 1.5, 2, None)
    assert one["candidate_release_mbids"] == ["a", "3"] and one["candidate_recording_mbids"] == [] and got[8]["acoustid_score"] is None


def test_sidecars_durations_and_only_candidates(spark):
    rows = [("/a.b/c", "[x]"), ("/a/c.flac", "y"), ("/a/.c", "z"), ("d.e.f", "w"), ("/n.mp3", " "), ("/n.mp3", None)]
    got = records.lyrics_sidecars(spark.createDataFrame(rows, "path string, l string"), "path", "l").collect()
    assert sorted((r["lrc_path"], r["text"]) for r in got) == [("/a.b/c.lrc", "[x]"), ("/a/.c.lrc", "z"), ("/a/c.lrc", "y"), ("d.e.lrc", "w")]
    d = spark.createDataFrame([(1, None, 3.0), (2, 2, 3.0), (3, None, None)], "k long, duration int, length_seconds double")
    assert [r["v"] for r in d.select("k", records.first_duration(d).alias("v")).orderBy("k").collect()] == [3.0, 2.0, None]
    assert d.select(records.first_duration(d.select("k"))).first()[0] is None
    lists = spark.createDataFrame([(["a"],), ([" a ", " ", None],), (["a", "a"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in lists.select(records.only_one(F.col("c"))).collect()] == ["a", "a", None, None, None]


def test_release_matches_against_loops(spark):
    local = [(1, 1, "r1", ["r1", "r2"]), (1, 2, "r1", ["r1", "r1"]), (1, 3, None, ["r3"]), (2, 4, "r9", []), (2, 5, " ", ["r2"]), (1, 6, "r4", None)]
    tracks = [("R", 1, "r1"), ("R", 2, "r1"), ("R", 3, "r2"), ("S", 1, "r9"), ("S", 2, None), ("T", 1, "r7")]
    want = {}
    for cluster in {c for c, *_ in local}:
        for release in {t[0] for t in tracks}:
            on = [t[2] for t in tracks if t[0] == release and t[2] is not None]
            mine = [x for x in local if x[0] == cluster]
            own = [x[2] for x in mine if x[2] in on]
            counts = (sum(bool(set(x[3] or []) & set(on)) for x in mine), len(own), sum(t in own for t in on))
            if any(counts):
                want[cluster, release] = counts
    a, b = spark.createDataFrame(local, "cluster long, file long, recording string, candidates array<string>"), spark.createDataFrame(tracks, "release string, place int, recording string")
    assert {(r[0], r[1]): (r[2], r[3], r[4]) for r in records.release_matches(a, b).collect()} == want


def test_report_text_in_order_and_without_rows(spark, tmp_path):
    clusters, selections = "cluster long, file long", "cluster long, status string, release string, album string, album_artist string, date string, matched int, tracks int, reason string, error string"
    candidates, planned, lyrics = "cluster long, rank int, release string, score int, reasons array<string>", "file long, original_path string, output_path string, status string, reason string", "file long, line string"
    make = lambda *rows: [spark.createDataFrame(r, s) for r, s in zip(rows, (clusters, selections, candidates, planned, lyrics), strict=True)]
    empty = reports.grouping_report(*make([], [], [], [], [])).orderBy(*reports.LINE_ORDER)
    assert [r["line"] for r in empty.collect()] == ["Album clustering:", "    cluster_count: 0", "    clusters:", "        none", "", "Release selection details:", "    none", "Planned files:", "    none", "", "Lyrics progress:", "    none"]
    full = make(
        [(1, 1), (1, 2), (2, 3)], [(1, "selected", "R", "Al", "", None, 2, 9, None, None), (2, "unmatched", None, None, None, None, 0, None, "no candidates", "late")],
        [(1, n, f"R{n}", 100 - n, ["a", "b", "c", "d"][: 4 * (n % 2)]) for n in (4, 2, 3, 1)], [(1, "/i", "/o", "planned", None), (2, "/j", "/p", "renamed", "taken")], [(2, "two"), (1, "one")],
    )
    reports.write_grouping_report(reports.grouping_report(*full), f"{tmp_path}/report")
    text = [r["value"] for r in spark.read.text(f"{tmp_path}/report").collect()]
    want = """Album clustering:|    cluster_count: 2|    clusters:|        1. 2 track(s)|        2. 1 track(s)||Release selection details:|Cluster 1:|    Release selection:|        status: selected|        selected_release_mbid: R|        score: 99|        album: Al|        album_artist: missing|        date: missing|        matched_track_count: 2|        total_track_count: 9|        top candidates:|            1. R1 ! 99 ! a; b; c|            2. R2 ! 98 ! no reasons|            3. R3 ! 97 ! a; b; c||Cluster 2:|    Release selection:|        status: unmatched|        selected_release_mbid: missing|        score: n/a|        album: missing|        album_artist: missing|        date: missing|        matched_track_count: 0|        total_track_count: missing|        top candidates:|            none|        reason: no candidates|        error: late||Planned files:|original:|    /i|output:|    /o|status:|    planned|original:|    /j|output:|    /p|status:|    renamed|reason:|    taken||Lyrics progress:|one|two"""
    assert sorted(text) == sorted(x.replace("!", "|") for x in want.split("|"))
    ordered = [r["line"] for r in reports.grouping_report(*full).orderBy(*reports.LINE_ORDER).collect()]
    assert ordered == [x.replace("!", "|") for x in want.split("|")]


def test_container_tags_are_made_by_all_cores(spark):
    """A small table of one file is no single task."""
    from mediagraph.plans.library import QUERIES

    df = QUERIES["p32_container_tags"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_release_is_parsed_once(spark):
    """The filter on its id doesn't parse its text again."""
    from mediagraph.sources.releases import canonical_tracks

    text = '{"id":"R1","media":[{"tracks":[{"id":"t1","title":"T"}]}]}'
    got = canonical_tracks(spark.createDataFrame([(1, text), (2, '{"id":" "}')], "k long, j string"), "j", "k")
    assert [(r["k"], r["track_mbid"]) for r in got.collect()] == [(1, "t1")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
