"""Groups of uncovered pairs against all pairs."""

import collections
import itertools
import random

import pytest

from mediagraph.operators import dedupe, graph
from mediagraph.plans import duplicates

SCHEMA = "tier string, bucket string, file long"


def by_all_pairs(tiers):
    """Groups (tier, files) and counts (tier, files, pairs) of components, from every pair of files."""
    seen, groups, counts = set(), collections.Counter(), collections.Counter()
    for name, buckets in tiers:
        new = set()
        for files in buckets.values():
            pairs = {p for p in itertools.combinations(sorted(files), 2)}
            open_ = pairs - seen
            new |= pairs
            near = collections.defaultdict(set)
            for a, b in open_:
                near[a].add(b)
                near[b].add(a)
            left = set(near)
            while left:
                comp, todo = set(), [left.pop()]
                while todo:
                    x = todo.pop()
                    comp.add(x)
                    todo += near[x] - comp
                left -= comp
                own = [p for p in open_ if p[0] in comp]
                counts[name, len(comp), len(own)] += 1
                if len(own) * 2 == len(comp) * (len(comp) - 1):
                    groups[name, tuple(sorted(comp))] += 1
                else:
                    groups.update((name, p) for p in own)
        seen |= new
    return groups, counts


def tables(spark, tiers):
    return [spark.createDataFrame([(n, b, f) for b, fs in buckets.items() for f in fs] or [], SCHEMA) for n, buckets in tiers]


def listed(groups):
    held = collections.defaultdict(list)
    for r in groups.collect():
        held[r["tier"], r["bucket"], r["part"]].append(r["file"])
    return collections.Counter((k[0], tuple(sorted(v))) for k, v in held.items()), held


@pytest.mark.parametrize("seed", [1, 2])
def test_uncovered_groups_equal_all_pairs(spark, seed):
    r = random.Random(seed)

    def buckets(n):
        held = collections.defaultdict(set)
        for f in range(36):
            if r.random() < 0.85:
                held[f"b{r.randrange(n)}"].add(f)
        return {b: fs for b, fs in held.items() if len(fs) > 1}

    tiers = [("one", buckets(r.choice([2, 9]))), ("two", buckets(3)), ("three", buckets(2)), ("four", buckets(1))]
    groups, counts = by_all_pairs(tiers)
    given = tables(spark, tiers)
    assert listed(dedupe.uncovered_groups(given, None))[0] == groups
    got = dedupe.uncovered_pair_counts(given).collect()
    assert collections.Counter((x["tier"], x["files"], x["pairs"]) for x in got) == counts


def test_several_components_in_one_bucket(spark):
    """{1,2,3} and {4,5,6} are disjoint, {1,4} and {2,5} too, and each of the one pair meets each of the other: two components."""
    keys = {0: "a1", 1: "b1"}
    tiers = [("one", {"x": {0, 2}, "y": {1, 3}}), ("two", {"x": {0, 3}, "y": {1, 2}}), ("three", {"all": {0, 1, 2, 3}})]
    assert keys and listed(dedupe.uncovered_groups(tables(spark, tiers), None))[0] == by_all_pairs(tiers)[0]


def test_a_component_over_the_bound_stays_one_group(spark):
    tiers = [("one", {"x": {0, 1}}), ("two", {"all": set(range(9))})]
    got, held = listed(dedupe.uncovered_groups(tables(spark, tiers), 34))
    assert ("two", tuple(range(9))) in got and any(part == "open:0" or part.startswith("open:") for _, _, part in held)
    assert listed(dedupe.uncovered_groups(tables(spark, tiers), 35))[0] == by_all_pairs(tiers)[0]


def test_a_large_bucket_of_many_stronger_keys(spark):
    """200,000 files in one bucket, by fours in 50,000 stronger ones: 6 pairs of each are covered, and nothing is listed."""
    n = 200_000
    one = spark.range(n).selectExpr("'one' tier", "cast(id div 4 as string) bucket", "id file")
    two = spark.range(n).selectExpr("'two' tier", "'all' bucket", "id file")
    got = dedupe.uncovered_pair_counts([one, two]).filter("tier = 'two'").collect()
    assert [(x["files"], x["pairs"]) for x in got] == [(n, n * (n - 1) // 2 - 50_000 * 6)]
    groups = dedupe.uncovered_groups([one, two]).filter("tier = 'two'")
    assert groups.select("part").distinct().count() == 1 and groups.count() == n


@pytest.mark.parametrize("chunk", [2, 256])
def test_pairs_and_counts_without_grouping(spark, monkeypatch, chunk):
    """Every uncovered pair once, whatever the bound on lists and the chunks; counts of groups, listed pairs and what is known of their files."""
    monkeypatch.setattr(dedupe, "CHUNK", chunk)
    r = random.Random(5)
    tiers = [("one", {"x": {0, 1, 2}, "y": {3, 4}}), ("two", {k: {f for f in range(30) if f % 3 == k} for k in range(3)}), ("three", {"all": set(range(24)), "few": {25, 28, 29}})]
    tiers[1] = ("two", {str(k): v - {r.randrange(30)} for k, v in tiers[1][1].items()})
    seen, pairs = set(), collections.Counter()
    for name, buckets in tiers:
        new = {p for files in buckets.values() for p in itertools.combinations(sorted(files), 2)}
        pairs.update((name, *p) for p in new - seen)
        seen |= new
    given = tables(spark, tiers)
    assert collections.Counter(map(tuple, dedupe.uncovered_pairs(given).select("tier", "a", "b").collect())) == pairs
    groups, _ = by_all_pairs(tiers)
    counts = collections.Counter()
    for (tier, _), n in groups.items():
        counts[tier] += n
    assert dict(map(tuple, dedupe.uncovered_group_counts(given).collect())) == counts
    cliques, two = dedupe.groups_and_pairs(given, None, spark.range(30).selectExpr("id file", "concat('p', 30 - id) path"))
    heads = [*dedupe.group_heads(cliques).select("first", "members").collect(), *dedupe.pair_heads(two).select("first", "members").collect()]
    assert collections.Counter(map(tuple, heads)) == collections.Counter((f[0], len(f)) for (_, f), n in groups.items() for _ in range(n))
    assert all(sorted(x["files"], key=lambda f: f"p{30 - f}") == x["files"] for x in dedupe.ordered_pairs(two).collect())


def test_a_component_of_over_ten_million_pairs_is_listed_whole(spark):
    """What d6, w8 and s10 are made from doesn't depend on the size of a component."""
    n = 4_600
    one = spark.range(2).selectExpr("'one' tier", "'x' bucket", "id file")
    two = spark.range(n).selectExpr("'two' tier", "'all' bucket", "id file")
    groups, pairs = dedupe.groups_and_pairs([one, two])
    assert [(x["tier"], x["file"]) for x in groups.orderBy("file").collect()] == [("one", 0), ("one", 1)]
    assert pairs.filter("a.file < b.file").count() == n * (n - 1) // 2 - 1 > 10_000_000


def test_texts_are_hashed_where_they_are(spark, tmp_path):
    """Files of one size meet by their hashes; no text is shuffled."""
    docs = [(1, "same", "en", "web", 4), (2, "same", "en", "web", 4), (3, "else", "en", "web", 4), (4, "longer", "en", "web", 6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    hashed = duplicates.tier_tables(spark, str(tmp_path))[0]
    plan = hashed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2(") > plan.index("Join LeftSemi, (size_bytes")
    assert sorted(x["file"] for x in hashed.collect()) == [1, 2]


def test_finished_components_are_left_out_of_later_rounds(spark, monkeypatch):
    sizes, kept = [], graph.saved

    def counting(df, name):
        out = kept(df, name)
        if name == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "saved", counting)
    chain = [(k, k + 1) for k in range(1000, 1040)]
    edges = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(300)] + chain, "a long, b long")
    got = {r["id"]: r["component"] for r in graph.stars(edges).collect()}
    assert got == {k: k - k % 2 for k in range(600)} | {k: 1000 for k in range(1000, 1041)}
    assert sizes[0] == 340 and max(sizes[3:]) <= 40


def test_album_groups_are_the_components_of_the_weights(spark):
    r = random.Random(11)
    rows = [(f, r.choice([None, f"r{r.randint(0, 60)}"]), r.choice([None, f"g{r.randint(0, 25)}"]), f % 7 if f % 3 else None) for f in range(60) for _ in range(r.randint(1, 3))]
    candidates = spark.createDataFrame(rows, "file long, release string, release_group string, parent int")
    want = {f: f for f, *_ in rows}
    edges = [(x["a"], x["b"]) for x in graph.shared_weights(candidates).collect()]
    for _ in range(60):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert {x["file"]: x["cluster"] for x in graph.album_groups(candidates).collect()} == want and 5 < len(set(want.values())) < 55
