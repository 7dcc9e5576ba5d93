"""Line dedup, conversation trie and word runs against brute force, with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediagraph.llm import linededup, queries, runs, trie

BLANKS = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 11 ---------------------------------------------------------------------------------------------------------------------------


def line_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute_lines(rows, min_chars, min_docs):
    held = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(line_key(line)) >= min_chars:
                held[line_key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (doc is not None and len(held.get(line_key(x), ())) >= min_docs and max(held[line_key(x)]) != doc)]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.fixture(scope="module")
def line_rows():
    r = random.Random(4)
    stock = [f"{'Shared' if i % 2 else 'ÉTÉ'} LINE number {i} {'x' * r.choice([1, 20, 40])}" for i in range(12)]
    texts = ["\n".join(r.choice([*stock, f"own {r.random()}", "", "  \t"]) + r.choice(["", " ", "\r", "\x0b"]) for _ in range(r.randint(1, 14))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n", "\n".join([stock[1]] * 400), "y" * 200_000, "\n".join(str(i) for i in range(30_000)), "É" + stock[1].lower(), stock[1].upper() + " "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, stock[1]), (None, stock[1]), (3, texts[3]), (3, stock[1] + "\nother"), (3, None)]
    return rows


def test_line_dedup_equals_brute_force(spark, line_rows):
    docs = spark.createDataFrame([(d, t, "given") for d, t in line_rows], "doc_id long, text string, n_lines string").repartition(5)
    for chars, least in ((20, 2), (20, 5), (40, 3)):
        got = linededup.dedup_lines(docs, chars, least)
        assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
        assert collections.Counter(map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect())) == collections.Counter(brute_lines(line_rows, chars, least))


def test_line_dedup_splits_heavy_keys_and_keeps_other_columns(spark, line_rows, monkeypatch):
    docs = spark.createDataFrame([(d, t) for d, t in line_rows], "item long, body string").withColumn("lost", F.lit(1)).withColumn("_line_lost", F.lit(2)).withColumn("key", F.lit("k"))
    for share in (1, 4, 10**9):  # no key is heavy, some are, all are
        monkeypatch.setattr(linededup, "HEAVY_SHARE", share)
        got = linededup.dedup_lines(docs, 20, 3, id_col="item", text_col="body").collect()
        assert collections.Counter((x["item"], x["n_lines"], x["n_dropped"], x["body"]) for x in got) == collections.Counter(brute_lines(line_rows, 20, 3))
        assert {(x["lost"], x["_line_lost"], x["key"]) for x in got} == {(1, 2, "k")}
    assert linededup.dedup_lines(docs.limit(0), 20, 3, id_col="item", text_col="body").collect() == []


def test_line_digests(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, None)], "doc_id long, text string")
    assert {tuple(x) for x in linededup.digests(linededup.dedup_lines(docs)).collect()} == {(1, 2, 0, sha("a\nb")), (2, 1, 0, sha(""))}


# -- 12 ---------------------------------------------------------------------------------------------------------------------------


def conversations_of(rows):
    held = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in held.items()}


def brute_rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 4, int(c / 20) * 20
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(convs):
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = collections.defaultdict(set)
    for path in members:
        for d in range(len(path) + 1):
            below[path[:d]].add(path)
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for path, ids in members.items():
        spared = sum((len(members[p]) - 1) * len(p[-1][1].encode().split()) for p in below[path] if p)
        ended = sorted(c for c in ids if len(convs[c]) == len(path))
        out.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), children[path], sum(not children[p] for p in below[path]), spared, sha(",".join(map(str, ended)))))
    return collections.Counter(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def talk():
    r = random.Random(12)
    rows = []
    for c in [*range(-30, 200), 5000, 10**12]:
        for turn in range(r.randint(1, 6)):
            rows.append((c, r.choice([turn, turn, None, 0]), r.choice(["user", "assistant", None]), r.choice(["hi", "hi there\tyou", "", None, f"no {r.randint(0, 3)}"])))
    same = [(0, "user", "one two"), (1, "assistant", "three")]
    rows += [(c, *t) for c in range(3000, 5100) for t in same if c != 5000]
    long = [(i, "user", f"word {i}") for i in range(20)]
    rows += [(c, *t) for c in (6001, 6002) for t in long] + [(6003, 0, "user", "word 0"), (6003, 1, "user", "word 1")] + [(None, 0, "user", "lost")]
    return rows + rows[:3]


def test_trie_equals_brute_force(spark, talk, monkeypatch):
    table = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("given")).repartition(5)
    convs = conversations_of(talk)
    arrays = trie.turn_arrays(table).cache()
    for share in (20_000, 3):
        monkeypatch.setattr(trie, "HEAVY_SHARE", share)
        got = trie.trie(trie.rebuilt(arrays)).select(COLUMNS).collect()
        assert collections.Counter(map(tuple, got)) == brute_trie(brute_rebuilt(convs))
    plain = trie.trie(arrays).select(COLUMNS).collect()
    assert collections.Counter(map(tuple, plain)) == brute_trie(convs)


def test_trie_of_few(spark):
    table = spark.createDataFrame([(1, 0, "u", "a b")], "conv_id long, turn long, role string, text string")
    assert trie.trie(trie.turn_arrays(table.limit(0))).collect() == []
    none = sha("")
    alone = trie.trie(trie.turn_arrays(table)).select(COLUMNS).collect()
    assert {tuple(x) for x in alone} == {(1, 0, None, 1, 1, 1, 0, none), (1, 1, 1, 1, 0, 1, 0, sha("1"))}
    silent = trie.trie(spark.createDataFrame([(4, []), (2, [])], f"conv_id long, turns {trie.TURN}")).select(COLUMNS).collect()
    assert [tuple(x) for x in silent] == [(2, 0, None, 2, 0, 1, 0, sha("2,4"))]


def test_lone_conversations_take_no_rounds(spark):
    """600 turns that no other conversation shares: the rounds are those of the first two turns."""
    rows = [(1, t, "u", f"x {t}") for t in range(600)] + [(2, 0, "u", "x 0"), (2, 1, "u", "else")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ends = trie.with_alone(trie.endings(trie.prefixes(trie.turn_arrays(table))))
    assert {r["alone"] for r in ends.collect()} == {2}
    got = trie.trie(trie.turn_arrays(table)).select(COLUMNS).collect()
    assert collections.Counter(map(tuple, got)) == brute_trie(conversations_of(rows))


# -- 13 ---------------------------------------------------------------------------------------------------------------------------


def brute_runs(words, exponent, least):
    found = {}
    for p in range(1, len(words) // exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= exponent * p:
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items() if n >= least)


def repetitive(r, most=90):
    words = []
    while len(words) < most and r.random() < 0.9:
        unit = [f"w{r.randrange(r.choice([1, 2, 3, 9]))}" for _ in range(r.randint(1, 9))]
        words += (unit * 8)[: r.randint(1, 50)]
    return words


def test_runs_equal_brute_force():
    r = random.Random(13)
    for _ in range(250):
        words = repetitive(r)
        for exponent, least in ((2, 0), (3, 4), (4, 6)):
            assert runs.word_runs(words, exponent, least) == brute_runs(words, exponent, least)


def test_runs_are_known_after_each_word():
    r = random.Random(14)
    for _ in range(25):
        words, at = np.array([int(w[1:]) for w in repetitive(r, 60)], dtype=np.uint64), 0
        catcher = runs.Catcher(2)
        while at < len(words):
            step = r.choice([1, 1, 1, 7, 30])
            catcher.append(words[at : at + step])
            at += step
            assert catcher.runs() == brute_runs(words[:at].tolist(), 2, 0)


def test_long_texts_of_few_words():
    assert runs.word_runs(["a"] * 100_000, 4, 6) == [(0, 100_000, 1)]
    assert runs.word_runs([str(i % 9973) for i in range(100_000)], 4, 6) == [(0, 100_000, 9973)]
    a, b = "a", "ab"
    while len(b) < 60_000:
        a, b = b, b + a
    assert runs.word_runs(list(b), 4, 0) == []  # no run of the Fibonacci word reaches the fourth power
    with pytest.raises(ValueError):
        runs.Catcher(1)


def brute_row(doc, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a, original = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        words = [original[i] if i < a else original[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words, 4, 6)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else None
    numbers = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc, len(found), *numbers, sha(lines), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def test_run_query_equals_brute_force(spark, tmp_path):
    r = random.Random(15)
    rows = [(i, r.choice([" ", "\n", "\x0b\t"]).join(repetitive(r, 40)), "x", 1) for i in range(80)]
    rows += [(200 + i, " ".join(str(r.random()) for _ in range(r.randint(1, 40))), "x", 1) for i in range(40)]
    rows += [(None, "a " * 9, None, None), (500, None, None, None), (501, "", None, None), (502, "  é " * 8, None, None), rows[0], rows[0]]
    spark.createDataFrame(rows, "doc_id long, text string, period string, runs long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_word_runs(spark, str(tmp_path))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert collections.Counter(map(tuple, got.select(columns).collect())) == collections.Counter(brute_row(d, t) for d, t, _, _ in rows)
    assert runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
