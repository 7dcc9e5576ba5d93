"""Stages of a run, published versions, failed lookups, nested ids, releases and assignment."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from mediagraph.operators import albums, cache, graph, resolve
from mediagraph.operators.run import STAGES, GroupingRun
from mediagraph.sources import ingest, releases


def test_a_published_stage_is_not_computed_again(spark, tmp_path):
    files = spark.createDataFrame([(1, "r1", None), (2, None, "I2"), (3, None, None)], "file long, recording string, isrc string").withColumns({c: F.lit(None).cast("string") for c in ("acoustid", "fingerprint")})
    references = spark.createDataFrame([("recording", "r1", ["r1"])], "kind string, key string, recordings array<string>")
    failed = spark.createDataFrame([("isrc", "I2", "no answer")], "kind string, key string, error string")
    first = GroupingRun(spark, f"{tmp_path}/run", files=files, references=references, failed=failed)
    got = {r["file"]: (r["status"], r["error"]) for r in first.stage("resolved").collect()}
    assert got == {1: ("resolved", None), 2: ("error", "no answer"), 3: ("unmatched", None)} and first.computed == ["resolved"]
    again = GroupingRun(spark, f"{tmp_path}/run", files=files.limit(0), references=references)
    assert again.stage("resolved").count() == 3 and again.computed == []
    with pytest.raises(KeyError):
        again.stage("candidates")  # without recordings: nothing is published
    assert cache.current_version(spark, f"{tmp_path}/run/candidates") is None and all(hasattr(first, f"_{s}") for s in STAGES)


def test_readers_keep_the_version_they_opened(spark, tmp_path):
    path = f"{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        cache.opened(spark, path)
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, codec string, hash string")
    assert cache.publish(rows, path) == 1
    old = cache.opened(spark, path)
    changes = spark.createDataFrame([(2, None, "z"), (3, "c", "w")], "k long, codec string, hash string")
    assert cache.publish(cache.updated(old, changes, "k", ["hash", "codec"]), path) == 2
    broken = rows.withColumn("hash", F.expr("raise_error('disk full')").cast("string"))
    with pytest.raises(Exception, match="disk full"):
        cache.publish(broken, path)
    read = lambda df: sorted(map(tuple, df.collect()))
    assert read(old) == [(1, "a", "x"), (2, "b", "y")] and read(cache.opened(spark, path)) == [(1, "a", "x"), (2, None, "z")]
    assert cache.current_version(spark, path)[0] == 2


def test_a_failed_lookup_is_an_error(spark):
    files = spark.createDataFrame([(1, "r", None), (2, None, "i")], "file long, recording string, isrc string").withColumns({c: F.lit(" ") for c in ("acoustid", "fingerprint")})
    references = spark.createDataFrame([("isrc", "i", ["a"])], "kind string, key string, recordings array<string>")
    failed = spark.createDataFrame([("isrc", "i", "late"), ("isrc", "i", "early"), ("isrc", "r", "other kind")], "kind string, key string, error string")
    got = {r["file"]: (r["status"], r["recording"], r["error"]) for r in resolve.resolve(files, references, failed=failed).collect()}
    assert got == {1: ("unmatched", "r", None), 2: ("error", "a", "early")}


def ids_by_walk(node, name, out):
    """Ids of the objects in lists of this name, a node's own before those below it."""
    if isinstance(node, dict):
        for x in node.get(name, []) if isinstance(node.get(name), list) else []:
            if isinstance(x, dict) and isinstance(x.get("id"), str) and x["id"].strip():
                out.append(x["id"].strip())
        for v in node.values():
            ids_by_walk(v, name, out)
    elif isinstance(node, list):
        for v in node:
            ids_by_walk(v, name, out)
    return out


def test_ids_at_any_depth(spark):
    r = random.Random(7)

    def node(depth):
        held = {}
        for key in r.sample(["z", "recordings", "a", "releases", "releasegroups", "id", "b"], r.randint(1, 5)):
            held[key] = r.choice(["x1", " x2 ", "", 5, None, '[{"recordings":[{"id":"no"}]}]', "[untitled]"]) if key == "id" or depth == 0 or r.random() < 0.2 else r.choice([node(depth - 1), [node(depth - 1), r.choice([3, "s", node(depth - 1)])], [[node(depth - 1)]], []])
        return held

    docs = [{"status": "ok", "results": [{"id": f"a{i}", "score": 0.5} | node(5) | {"id": r.choice([f"a{i}", " ", 7, f" b{i} "])} for i in range(3)]} for _ in range(30)] + [{"status": "ok", "results": []}, {"status": "error"}]
    table = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(docs)] + [(99, None), (98, "broken")], "k long, j string")
    got = {(x["k"], x["index"]): (x["id"], x["recordings"], x["releases"], x["groups"]) for x in ingest.lookup_candidates(table, "k", "j").collect()}
    want = {}
    for k, x in enumerate(docs):
        for i, res in enumerate(x.get("results", [])):
            if isinstance(res["id"], str) and res["id"].strip():
                want[k, i] = (res["id"].strip(), *[list(dict.fromkeys(ids_by_walk(res, n, []))) for n in ("recordings", "releases", "releasegroups")])
    assert got == want and any(w[1] for w in want.values())


def test_deep_ids_take_one_job(spark):
    deep = {"releases": [{"id": "last"}]}
    for i in range(200):
        deep = {"recordings": [{"id": "\ud800" if i == 199 else f" r{i % 3} ", "n": i, "more": deep}]}
    row = json.dumps({"results": [{"id": "a"} | deep]})
    sc = spark.sparkContext
    sc.setJobGroup("deep ids", "")
    got = ingest.lookup_candidates(spark.createDataFrame([(1, row)], "k long, j string").coalesce(1), "k", "j").collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("deep ids"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert [(r["recordings"], r["releases"], r["groups"]) for r in got] == [(["?", "r0", "r2", "r1"], ["last"], [])] and jobs == 1


def test_releases_in_either_spelling(spark):
    track = {"id": "t", "position": "3", "title": " ", "recording": {"id": "r", "title": "T", "url-relation-list": [{"target-type": "url", "target": "http://x"}]}}
    one = {"id": "a", "title": "A", "medium-list": [{"position": "2", "track-list": [track]}], "media": []}
    two = {"id": "b", "media": [{"position": "x", "format": "CD", "tracks": [track, track]}], "medium-list": [], "release-group": {"type": "Single", "secondary-type-list": ["Live", " "]}}
    table = spark.createDataFrame([(json.dumps(x),) for x in (one, two, {"title": "no id"}, {"id": "c"})], "j string")
    got = sorted(map(tuple, ingest.release_tracks(table, "j").collect()))
    assert got == [("a", 2, 1, 3, "t", "T", "r"), ("b", None, 1, 3, "t", "T", "r"), ("b", None, 1, 3, "t", "T", "r")]
    facts = {r["release"]: (r["tracks"], r["primary"], r["secondary"], r["format"]) for r in releases.release_facts(table, "j").collect()}
    assert facts == {"a": (1, None, [], None), "b": (2, "Single", ["Live"], "CD"), "c": (0, None, [], None)}
    assert releases.canonical_tracks(table, "j").select("url").distinct().collect()[0][0] == "http://x"
    assert len(releases.TRACK_ROW) == 61


def test_assignment_equals_one_file_after_another(spark):
    r = random.Random(3)
    local, tracks = [], []
    for c in range(40):
        recordings = [r.choice("abcd") if r.random() < 0.9 else None for _ in range(r.randint(0, 6))]
        tracks += [(c, 100 * c + k, k, x) for k, x in enumerate(recordings)]
        local += [(c, 100 * c + k, r.randint(0, 2), r.choice("abcde") if r.random() < 0.8 else None, r.choice([[], [], ["a", "b"], ["e"]]) if c % 2 else []) for k in range(r.randint(1, 6))]
    want = {}
    for c, files in itertools.groupby(sorted(local, key=lambda x: (x[0], x[2], x[1])), key=lambda x: x[0]):
        free = [t for t in tracks if t[0] == c]
        for _, file, _, own, others in files:
            hit = next((t for t in free if own is not None and t[3] == own), None) or next((t for t in free if t[3] is not None and t[3] in others), None)
            want[file] = hit and hit[1]
            free = [t for t in free if t is not hit]
    got = albums.assign_tracks(spark.createDataFrame(local, "cluster long, file long, position int, recording string, candidates array<string>"), spark.createDataFrame(tracks, "cluster long, track long, position int, recording string"))
    assert {x["file"]: x["track"] for x in got.collect()} == want


def test_a_run_reads_its_releases_once_and_their_own_fields_once_a_release(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([('{"id":"R","title":"T","release-group":{"id":"G"},"media":[{"tracks":[{"id":"t1"},{"id":"t2"}]}]}',)], "j string")
    plan = releases.canonical_tracks(rows, "j")._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate posexplode", 1)
    assert "first-release-date" in below and "first-release-date" not in above
    asked = []
    facts = releases.release_facts
    monkeypatch.setattr(releases, "release_facts", lambda *a: asked.append(a) or facts(*a))
    files = spark.createDataFrame([(1, "a", "r1", 0)], "file long, original_path string, recording string, parent long").withColumns({c: F.lit(None).cast("string") for c in ("isrc", "acoustid", "fingerprint")})
    references = spark.createDataFrame([("recording", "r1", ["r1"])], "kind string, key string, recordings array<string>")
    on = spark.createDataFrame([("r1", "R")], "recording string, release string")
    run = GroupingRun(spark, f"{tmp_path}/run", files=files, references=references, recordings=on, releases=rows)
    assert [(r["cluster"], r["release"], r["status"]) for r in run.stage("verdicts").collect()] == [(1, "R", "selected")] and len(asked) == 1


def test_pairs_are_dealt_over_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS_AT_ONCE", 10)
    rows = [(f, f"r{f % 3}", None if f == 5 else f"g{f % 2}", f % 4 or None) for f in range(20)]
    got = graph.shared_weights(spark.createDataFrame(rows, "file long, release string, release_group string, parent long"))
    want = set()
    for (a, r, g, p), (b, s, h, q) in itertools.combinations(rows, 2):
        shared = 2 * (r == s) + (g is not None and g == h)
        if shared and (weight := shared + (p is not None and p == q)) >= 2:
            want.add((a, b, weight))
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    assert got.rdd.getNumPartitions() > 4


def test_tracks_and_their_files_meet_without_a_broadcast(spark):
    """Tracks are few bytes as files and many rows; and those related in several ways, by track or recording, are found in one go."""
    track = '{"id":"t%d","position":"%d","recording":{"id":"r%d","title":"T","relations":[{"type":"Remix","target":"Ann"},{"type":" COMPOSER ","artist":"{\\"name\\":\\" Bob \\"}"},{"type":"remixer","work":"{\\"resource\\":\\"Cy\\"}"},{"type":"lost","target":"no"},{"type":null,"target":"no"}]}}'
    text = '{"id":"R","title":"Al","artist-credit":["", {"artist":{"name":" "}}],"media":[{"position":"1","tracks":[' + ",".join(track % (k, k, k) for k in (1, 2)) + "]}]}"
    tracks = releases.canonical_tracks(spark.createDataFrame([(5, text)], "cluster long, j string"), "j", "cluster")
    local = spark.createDataFrame([(10, 5, 1, "r1", []), (11, 5, 2, "r9", ["r2"])], "file long, cluster long, position int, recording string, candidates array<string>")
    given = albums.assign_tracks(local, tracks.select("cluster", F.col("place").cast("long").alias("track"), F.col("place").alias("position"), F.col("recording_mbid").alias("recording")))
    files = local.select("file", F.concat(F.lit("/in/"), "file", F.lit(".mp3")).alias("original_path"), "recording", *[F.lit(None).cast("string").alias(c) for c in ("isrc", "acoustid")])
    rows = releases.track_rows(files, given.select("file", "cluster", F.col("track").alias("place")), tracks, "file")
    assert "BroadcastExchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(x["file"], x["status"], x["recording_mbid"], x["composer"], x["remixer"], x["conductor"], x["album_artist"]) for x in rows.collect()} == {(10 + k, "matched", f"r{1 + k}", "Bob", "Ann; Cy", None, None) for k in (0, 1)}
