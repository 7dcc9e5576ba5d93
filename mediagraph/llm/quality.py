"""Quality rules: counts of words, symbols and repetition, and bands of perplexity under an n-gram model of all documents.

The model is a modified Kneser-Ney trigram model over words (ngrams.py), counted by Spark over all distinct texts that pass the base
rules; tasks hold its frequent n-grams, and the counts of the others answer the chunks of text that have them. Its vocabulary is every word that makes up at least 1 / VOCABULARY of all; other words are one unknown word in the trigrams,
times the probability of their bytes under a second model of the same kind, counted over the unknown words. So salad of real words
and noise of characters both have a high perplexity. Each language has a lower and an upper bound, from the quartiles of its own
distinct texts, so copies weigh no more than one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.llm import ngrams
from mediagraph.llm.common import fresh, kept, saved
from mediagraph.llm.ngrams import END, KneserNey, before, keys_of

UNKNOWN = 1
#: The part of a trigram's key that is its last two ids.
PAIR = ngrams.IDS * ngrams.IDS - 1
SYMBOLS = b"#*$%&|<>"
#: A word is in the vocabulary if it makes up at least this part of all: at most so many are.
VOCABULARY = 1 << 13
#: Words that a Python worker remembers before it starts over (some 200 bytes each), and words that are looked at together.
REMEMBERED, AT_ONCE = 100_000, 100_000
#: Words of a chunk, whose texts ask together for the n-grams that tasks don't hold.
CHUNK_WORDS = 1_000_000
#: Byte trigrams of unknown words: all are held, as there are no more than these.
SPELLED = 257**3
#: Languages whose bands go to every task; more of them are joined by a shuffle.
BROADCAST_BANDS = 100_000
#: Digests of repeated texts that go to every task; more of them are joined by a shuffle.
BROADCAST_REPEATS = 1_000_000


def text_digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def with_copies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """text of each row and copies, how many rows have that text."""
    texts = docs.select(F.col(text_col).alias("text"))
    repeated = saved(texts.groupBy(text_digest("text").alias("same")).agg(F.count("*").alias("copies")).filter("copies > 1"), "repeated")
    few = repeated.count() <= BROADCAST_REPEATS
    both = texts.withColumn("digest", text_digest("text")).join(F.broadcast(repeated) if few else repeated, F.col("digest") == F.col("same"), "left")
    return both.select("text", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def parts_of(cells) -> Iterator[list[list[bytes]]]:
    """The words of each text, of whole texts with about AT_ONCE words together."""
    part, size = [], 0
    for cell in cells:
        part.append((cell.as_py() or "").encode().split())
        size += len(part[-1]) + 1
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def chunks_of(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about CHUNK_WORDS words, going by the bytes of the texts."""
    if batch.num_rows:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // (6 * CHUNK_WORDS)
        starts = np.flatnonzero(np.append(True, size[1:] != size[:-1])).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def places(found: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each of the wanted keys lies among those found, which are distinct."""
    by = np.argsort(found)
    return by[np.searchsorted(found[by], wanted)].astype(np.int32)


class Lexicon(dict):
    """Numbers of the words seen, with what is known of each: it with ASCII letters lower-cased, that one's hash and id (place in the
    vocabulary of 64-bit hashes in order plus 2, or UNKNOWN) and, where a model of spelling is given, the log10 probability of an unknown
    word's bytes. Number 0 ends a text."""

    def __init__(self, vocabulary: np.ndarray, spelling: KneserNey | None = None):
        super().__init__()
        self.vocabulary, self.spelling = vocabulary, spelling
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[None] = 0
        self.words, self.hashes, self.ids, self.spelled = [None], np.zeros(1, np.uint64), np.array([END]), np.zeros(1)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.words)
        self.words.append(word.lower())
        return n

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' words, each text with an end, and their lengths."""
        if len(self) > REMEMBERED:
            self.forget()
        flat: list[int] = []
        get = self.__getitem__
        for words in texts:
            flat.extend(map(get, words))
            flat.append(0)
        new = self.words[len(self.ids) :]
        if new:
            digest = xxhash.xxh3_64_intdigest
            h = np.fromiter(map(digest, new), np.uint64, len(new))
            at = np.minimum(np.searchsorted(self.vocabulary, h), max(len(self.vocabulary) - 1, 0))
            known = self.vocabulary[at] == h if len(self.vocabulary) else np.zeros(len(h), bool)
            self.hashes = np.concatenate([self.hashes, h])
            self.ids = np.concatenate([self.ids, np.where(known, at + 2, UNKNOWN)])
            if self.spelling is not None:
                logs = np.zeros(len(new))
                rare = np.flatnonzero(~known)
                ids, lengths = letters([new[i] for i in rare.tolist()])
                if len(rare):
                    logs[rare] = np.add.reduceat(self.spelling.log10(trigram_keys(ids, lengths)).astype(float), np.cumsum(lengths) - lengths)
                self.spelled = np.concatenate([self.spelled, logs])
        return np.array(flat, np.int64), np.array([len(w) + 1 for w in texts], np.int64)


def letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words plus 1, each word with an END, and their lengths."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.frombuffer(b"\n".join(words) + b"\n", np.uint8).astype(np.int64)
    return np.where(flat == 10, END, flat + 1), np.array([len(w) + 1 for w in words], np.int64)


def trigram_keys(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    one, two = before(ids, lengths)
    return keys_of(two, one, ids)


def repeats_of(numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each text, the words in a window of three that stands twice or more in it: repeated_words of all texts at once. numbers: of the
    words, each text with an end, as Lexicon gives them."""
    covered = np.zeros(len(numbers), np.int64)
    inside = np.flatnonzero((numbers[:-2] > 0) & (numbers[1:-1] > 0) & (numbers[2:] > 0))
    a, b, c = (numbers[inside + i] for i in range(3))
    if len(numbers) and numbers.max() < 1 << 21:
        key = (a << 42) | (b << 21) | c
    else:
        key = (np.unique((a << 32) | b, return_inverse=True)[1] << 32) | c
    text = np.repeat(np.arange(len(lengths)), lengths)[inside]
    mixed = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + text.view(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    order = np.sort(mixed)
    again = order[1:][order[1:] == order[:-1]]
    if len(again):
        # few windows are looked at more closely: those whose upper bits some repeated ones have
        held, upper = np.zeros(1 << 20, bool), np.uint64(44)
        held[again >> upper] = True
        some = np.flatnonzero(held[mixed >> upper])
        some = some[np.lexsort((key[some], text[some]))]
        same = (key[some[1:]] == key[some[:-1]]) & (text[some[1:]] == text[some[:-1]])
        twice = inside[some[np.append(same, False) | np.append(False, same)]]
        for i in range(3):
            covered[twice + i] = 1
    return np.add.reduceat(covered, np.cumsum(lengths) - lengths) if len(lengths) else covered


def good(numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether each text passes the base rules."""
    return (lengths > 50) & (100 * repeats_of(numbers, lengths) <= 50 * (lengths - 1))


def counted(docs: DataFrame, count) -> DataFrame:
    """Sums over distinct texts: count(cells) gives (kind, keys, or keys and how often) for some texts; the result has kind, key and n.

    docs has text and copies: each of the rows of one text counts its part of one.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], ngrams.Counter] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for (kind, copies), counter in held.items():
                keys, n = counter.take()
                yield from ngrams.cut(keys, n / copies, ("kind", kind))
            held.clear()

        for batch in batches:
            texts, copies = batch.column(0), batch.column(1).to_numpy()
            for c in np.unique(copies).tolist():
                for kind, *keys in count(texts.filter(pa.array(copies == c))):
                    held.setdefault((kind, c), ngrams.Counter()).add(*keys)
                if sum(x.size for x in held.values()) > 2 * ngrams.HELD:
                    if sum(x.settled() for x in held.values()) > ngrams.HELD:
                        yield from sent()
        yield from sent()

    parts = docs.select("text", "copies").mapInArrow(add, "kind long, key long, n double")
    return parts.groupBy("kind", "key").agg(F.round(F.sum("n")).cast("long").alias("n"))


class Perplexity:
    """The models of words (what tasks hold of it, and in how many ranges the others answer) and of unknown words' bytes, over a
    vocabulary of word hashes."""

    def __init__(self, vocabulary: np.ndarray, words: KneserNey, ranges: int, spelling: KneserNey):
        self.vocabulary, self.words, self.ranges, self.spelling = vocabulary, words, ranges, spelling

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Log10 probabilities of texts in one task."""

    def __init__(self, model: Perplexity):
        self.model, self.lexicon = model, Lexicon(model.vocabulary, model.spelling)

    def of_texts(self, cells) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of each text: its words and its end, the words in repeated windows, the summed log10 probabilities of those whose trigrams are
        held, and the keys of the other trigrams."""
        sizes, repeats, logs, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)], []
        for texts in parts_of(cells):
            numbers, lengths = self.lexicon.numbers(texts)
            keys = trigram_keys(self.lexicon.ids[numbers], lengths)
            held, missing = self.model.words.exact(keys)
            starts = np.cumsum(lengths) - lengths
            sizes.append(lengths)
            repeats.append(repeats_of(numbers, lengths))
            logs.append(np.add.reduceat(held + self.lexicon.spelled[numbers], starts))
            rest += np.split(keys[missing], np.searchsorted(missing, starts[1:]))
        return np.concatenate(sizes), np.concatenate(repeats), np.concatenate(logs), rest


def lexicon_of(vocabulary: bytes) -> Lexicon:
    """One for each Python worker that counts."""
    return kept(("lexicon", vocabulary), lambda: Lexicon(np.frombuffer(vocabulary, np.uint64)))


def train(docs: DataFrame, text_col: str = "text") -> tuple[Perplexity, ngrams.Whole]:
    """The model of all distinct texts that pass the base rules, as tasks hold it, and that of all its word n-grams. What comes to the
    driver is bounded by VOCABULARY, ngrams.ENTRIES and SPELLED."""
    spark = docs.sparkSession
    texts = with_copies(docs, text_col)

    def words(cells) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        lexicon = lexicon_of(b"")
        for part in parts_of(cells):
            numbers, lengths = lexicon.numbers(part)
            times = np.bincount(numbers[np.repeat(good(numbers, lengths), lengths)], minlength=1)
            times[0] = 0  # ends
            seen = np.flatnonzero(times)
            yield 0, lexicon.hashes[seen].view(np.int64), times[seen]

    by_word = saved(counted(texts, words).select("key", "n"), "words")
    total = by_word.agg(F.sum("n")).first()[0] or 0
    frequent = by_word.filter(F.col("n") >= max(2, -(-total // VOCABULARY))).select("key").toArrow()["key"].to_numpy()
    vocabulary = np.sort(frequent.view(np.uint64))
    shared = spark.sparkContext.broadcast(vocabulary)

    def trigrams(cells) -> Iterator[tuple]:
        lexicon = lexicon_of(shared.value.tobytes())
        unknown: list[np.ndarray] = []

        def spelled(words: list) -> tuple:
            """The letters of each unknown word once, as often as it was there."""
            number, n = np.unique(np.concatenate(unknown), return_counts=True)
            ids, lengths = letters([words[i] for i in number.tolist()])
            unknown.clear()
            return 1, trigram_keys(ids, lengths), np.repeat(n, lengths)

        words = lexicon.words
        for part in parts_of(cells):
            numbers, lengths = lexicon.numbers(part)
            if lexicon.words is not words and unknown:
                yield spelled(words)
            passed = good(numbers, lengths)
            numbers, lengths = numbers[np.repeat(passed, lengths)], lengths[passed]
            words, ids = lexicon.words, lexicon.ids[numbers]
            yield 0, trigram_keys(ids, lengths)
            unknown.append(numbers[ids == UNKNOWN])
        if unknown:
            yield spelled(words)

    both = saved(counted(texts, trigrams), "trigrams")
    spelling = ngrams.train(both.filter("kind = 1").select("key", "n"), 257, entries=1 << 62)[0]
    whole = ngrams.whole(both.filter("kind = 0").select("key", "n"), len(vocabulary) + 2)
    return Perplexity(vocabulary, whole.model, whole.ranges, spelling), whole


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    return len(words), *marks(text), repeated_words(words)


def marks(text: bytes) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
    return len(text.translate(None, _UNCOUNTED)), symbols, len(lines) - len(set(lines))


#: White space, and the bytes that follow the first one of a character.
_UNCOUNTED = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))


def windows_of(words: list[bytes]) -> np.ndarray:
    """A number for each window of three words, the same for equal windows."""
    ids = dict(zip(dict.fromkeys(words), range(len(words))))
    w = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    if len(ids) < 1 << 21:
        return (w[:-2] * len(ids) + w[1:-1]) * len(ids) + w[2:]
    # the product of three could overflow
    _, pair = np.unique(w[:-2] * len(ids) + w[1:-1], return_inverse=True)
    return pair * len(ids) + w[2:]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that stands twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    key = windows_of(words)
    order = np.sort(key)
    again = order[1:] == order[:-1]
    if not again.any():
        return 0
    twice = np.isin(key, order[1:][again])
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : i + n - 2] |= twice
    return int(covered.sum())


SCORED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def bands_of(bins: DataFrame, width: float, own: float) -> DataFrame:
    """lang, low and high from lang, digest and bin (thousandths of log10 perplexity); the row whose lang is null holds for all others.

    The quartiles are those of a language's distinct texts, n of them, drawn towards those of all texts as if own more texts had
    these: (n * own quartile + own * overall quartile) / (n + own). The bounds lie width times their distance outside them. Quartiles
    are read from counts by thousandths, so they are the same however the rows are dealt.
    """
    bins = bins.groupBy("lang", "digest").agg(F.min("bin").alias("bin")).groupBy("lang", "bin").agg(F.count("*").alias("n"))
    bins = bins.unionByName(bins.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n"))
    so_far = bins.withColumn("below", F.sum("n").over(Window.partitionBy("lang").orderBy("bin"))).withColumn("docs", F.sum("n").over(Window.partitionBy("lang")))
    quarter = lambda q: F.min(F.when(F.col("below") >= q * F.col("docs"), F.col("bin"))) / 1000
    quartiles = so_far.groupBy("lang").agg(quarter(0.25).alias("q1"), quarter(0.75).alias("q3"), F.max("docs").alias("docs"))
    overall = quartiles.filter("lang is null").select(F.col("q1").alias("all1"), F.col("q3").alias("all3"))
    drawn = lambda q, a: (F.col("docs") * F.col(q) + own * F.col(a)) / (F.col("docs") + own)
    both = quartiles.crossJoin(F.broadcast(overall)).select("lang", drawn("q1", "all1").alias("q1"), drawn("q3", "all3").alias("q3"))  # one row
    apart = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.01))
    return both.select("lang", (F.col("q1") - width * apart).alias("low"), (F.col("q3") + width * apart).alias("high"))


def judge(
    docs: DataFrame,
    width: float = 2.0,
    scatter: float = 2.0,
    own: float = 30.0,
    lang_col: str = "lang",
    text_col: str = "text",
    prefix: str = "",
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (or its columns keep) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log10_perplexity, base_failed and kept.

    kept is false if base_failed (under 50 words, or over half of them in repeated windows), or if the perplexity of a word is outside
    its language's band (bands_of). The mean over a short text scatters more: both bounds are wider by scatter over the root of its
    words. A null or empty text has no words and fails; a null language is one of its own, a missing column lang makes one language;
    rows are judged each, however often they repeat; an empty table gives an empty table. Given columns of the added names give way
    (prefix sets other names). Each text is read once for its score; then the rows of a chunk meet the answers for the n-grams that tasks
    don't hold.
    """
    spark = docs.sparkSession
    added = [prefix + c for c in [*SCORED, "log10_perplexity", "base_failed", "kept"]]
    given = docs.drop(*[c for c in added if c not in (text_col, lang_col)])
    held, whole = train(given, text_col)
    model = spark.sparkContext.broadcast(held)
    stay = [c for c in given.columns if keep is None or c in keep]
    lang, digest = fresh(given, "lang"), fresh(given, "digest")
    lang_value = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in given.columns else F.lit("")
    source = given.select(*stay, F.col(text_col).alias(fresh(given, "text")), lang_value.alias(lang), text_digest(text_col).alias(digest))
    text = fresh(given, "text")
    names = [c for c in source.columns if c != text]
    place = len(stay)
    chunk, about, rest, others = (fresh(source, c) for c in ("chunk", "asked", "rest", "lower"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value.scorer()
        for whole_batch in batches:
            for batch in chunks_of(whole_batch, place):
                counts = [marks((cell.as_py() or "").encode()) for cell in batch.column(place)]
                sizes, repeats, logs, missing = scorer.of_texts(batch.column(place))
                keys = np.concatenate(missing)
                three, _ = ngrams.dealt(keys, model.value.ranges)
                two, _ = ngrams.dealt(three & PAIR, model.value.ranges)
                # where the chunk's trigrams lie among its distinct ones, and where the bigrams of these do
                at, lower = (places(found, wanted) for found, wanted in ((three, keys), (two, three & PAIR)))
                ends = np.cumsum([0, *map(len, missing)])
                name = xxhash.xxh3_128_hexdigest(sizes.tobytes() + logs.tobytes() + keys.tobytes())
                first = lambda value, kind, n=batch.num_rows: pa.array([value] + [None] * (n - 1), kind)
                made = [pa.array(c, pa.int64()) for c in (sizes - 1, *map(list, zip(*counts, strict=True)), repeats)]
                made += [pa.array(logs, pa.float64()), pa.array([name] * batch.num_rows), first(ngrams.asked({3: keys, 2: keys & PAIR}, model.value.ranges), ngrams.ASKED_ARROW)]
                made += [pa.array([at[ends[i] : ends[i + 1]].tobytes() for i in range(batch.num_rows)], pa.binary()), first(lower.tobytes(), pa.binary())]
                columns = [batch.column(i) for i in range(batch.num_columns) if i != place]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*names, *added[:6], chunk, about, rest, others])

    def complete(left: pa.Table, right: pa.Table) -> pa.Table:
        """Log10 perplexity per word of each text (its end counted)."""
        told = ngrams.Told(zip(*(right[c].to_pylist() for c in ("ngram", "part", "own", "back")), strict=True), model.value.ranges)
        (own, back), (pairs, _) = told.in_turn(3), told.in_turn(2)
        lower = next((x.as_py() for x in left[others] if x.is_valid), b"")
        logs = np.log10(own.astype(float) + back.astype(float) * pairs[np.frombuffer(lower, np.int32)])
        total = [known + float(logs[np.frombuffer(x, np.int32)].sum()) for known, x in zip(left[added[5]].to_pylist(), left[rest].to_pylist(), strict=True)]
        value = -np.array(total) / (left[added[0]].to_numpy() + 1)
        return left.select([*names, *added[:5]]).append_column(added[5], pa.array(value, pa.float64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names)
    fields += ", " + ", ".join(f"`{c}` long" for c in added[:5]) + f", `{added[5]}` double"
    scored = saved(source.mapInArrow(score, f"{fields}, `{chunk}` string, `{about}` {ngrams.ASKED}, `{rest}` binary, `{others}` binary"), "scored")
    answers = ngrams.answered(scored.filter(F.col(about).isNotNull()).select(F.col(chunk).alias("unit"), F.inline(about)), whole, {2: 10.0**held.words.p1})
    scored = saved(scored.drop(about).groupBy(chunk).cogroup(answers.groupBy("unit")).applyInArrow(complete, fields), "scored")
    bins = scored.select(F.col(lang).alias("lang"), F.col(digest).alias("digest"), F.col(added[5]).alias("logs"))
    bins = saved(bins.select("lang", "digest", F.round(F.col("logs") * 1000).cast("long").alias("bin")), "bins")
    bands = saved(bands_of(bins, width, own), "bands")
    few = bands.count() <= BROADCAST_BANDS
    band, low, high = (fresh(scored, c) for c in ("band_lang", "low", "high"))
    every = bands.filter("lang is null").select(F.col("low").alias(f"{low}_all"), F.col("high").alias(f"{high}_all"))
    named = bands.filter("lang is not null").select(F.col("lang").alias(band), F.col("low").alias(low), F.col("high").alias(high))
    both = scored.join(F.broadcast(named) if few else named, scored[lang] == named[band], "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    failed = (F.col(added[0]) < 50) | (100 * F.col(added[4]) > 50 * F.col(added[0]))
    value = F.round(added[5], 3)
    more = scatter / F.sqrt(F.col(added[0]) + 1)
    fits = (value >= F.coalesce(low, f"{low}_all") - more) & (value <= F.coalesce(high, f"{high}_all") + more)
    out = both.withColumn(added[6], failed).withColumn(added[7], ~failed & F.coalesce(fits, F.lit(True)))
    return out.select(*stay, *added)


def keep_good(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", **options) -> DataFrame:
    """The documents that judge keeps, with their own columns.

    A verdict depends on a row's text and language only, so rows are judged by these, their digest and language written down, and the
    rows of those that fail are taken out in the end: texts are neither written nor shuffled with their scores.
    """
    digest, lang, prefix = fresh(docs, "digest"), fresh(docs, "language"), fresh(docs, "q_")
    named = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    known = docs.withColumns({digest: text_digest(text_col), lang: named})
    judged = judge(known, lang_col=lang, text_col=text_col, prefix=prefix, keep=[digest, lang], **options)
    failed = saved(judged.filter(~F.col(f"{prefix}kept")).select(digest, lang).distinct(), "failed")
    few = failed.count() <= BROADCAST_REPEATS
    return known.join(F.broadcast(failed) if few else failed, [digest, lang], "left_anti").select(*docs.columns)
