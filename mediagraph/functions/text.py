"""Column functions on names, tags and identifiers. All are null-safe native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag keys of identifiers and of display fields, by priority.
RECORDING_KEYS = ("musicbrainzrecordingid", "musicbrainztrackid", "ufidhttpmusicbrainzorg")
TITLE_KEYS = ("title", "tracktitle", "tit2", "nam")
ARTIST_KEYS = ("artist", "artists", "tpe1", "author", "art", "albumartist", "albumartists", "aart")
ALBUM_KEYS = ("album", "albumtitle", "talb", "alb")
NOT_DISPLAYED = ("id", "mbid", "musicbrainz", "sort", "fingerprint", "acoustid")
VARIANTS = ("live", "remix", "cover")
#: Codecs and extensions without and with loss.
LOSSLESS_CODECS = ("alac", "aiff", "flac", "pcm", "pcm_s16le", "pcm_s24le", "pcm_s32le", "wav")
LOSSLESS_EXTENSIONS = (".aif", ".aiff", ".flac", ".wav")
LOSSY_CODECS = ("aac", "mp3", "opus", "vorbis", "wma")


def clean(c: Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def first_clean(*cols: Column) -> Column:
    return F.coalesce(*[clean(c) for c in cols])


def tag_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def folded(c: Column) -> Column:
    """Lower case with sharp s written out, as case folding does."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def match_token(c: Column) -> Column:
    return F.nullif(F.regexp_replace(folded(c), r"[^\p{L}\p{N}]", ""), F.lit(""))


def match_text(c: Column) -> Column:
    """Folded, without bracketed parts, other characters than a-z and 0-9 as single blanks; null gives an empty string."""
    t = folded(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", " "), r"\[[^\]]*\]", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def lenient_int(c: Column) -> Column:
    return F.trim(c).try_cast("int")


def lenient_double(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def distinct_clean(arr: Column) -> Column:
    """Trimmed values without blanks, the first of equals kept."""
    return F.array_distinct(F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x != ""))


def flat_clean(nested: Column) -> Column:
    return F.filter(F.transform(F.flatten(nested), lambda x: F.trim(x)), lambda x: x != "")


def decoded(b: Column) -> Column:
    """Bytes as text: UTF-8, or else Latin-1."""
    return F.when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(F.decode(b, "ISO-8859-1"))


def primary_artist(artist: Column, artists: Column | None = None) -> Column:
    given = clean(artist) if artists is None else F.coalesce(F.get(distinct_clean(artists), F.lit(0)), clean(artist))
    first = F.get(F.split(given, r"(?i)\s*(?:;|\bwith\b|\bfeat\.?\b|\bft\.?\b|\bfeaturing\b)\s*", 2), F.lit(0))
    return F.coalesce(clean(first), given)


def variant_tokens(c: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(folded(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.array_sort(F.array_intersect(words, F.array(*map(F.lit, VARIANTS))))


def variant_mismatch(a: Column, b: Column) -> Column:
    return variant_tokens(a) != variant_tokens(b)


def instrumental(flags: list[Column], texts: list[Column]) -> Column:
    """What the first flag that decides says: a boolean one decides either way, a text one only with 1, true, yes or instrumental; else
    whether a text names it."""
    decided = []
    for f in flags:
        boolean = F.typeof(f) == "boolean"
        said = folded(F.trim(f.cast("string"))).isin("1", "true", "yes", "instrumental")
        decided.append(F.when(boolean, f.cast("string") == "true").when(said, True))
    named = [F.coalesce(F.contains(folded(t), F.lit("instrumental")), F.lit(False)) for t in texts]
    return F.coalesce(*decided, F.array_contains(F.array(*named), True) if named else F.lit(False), F.lit(False))


def path_component(c: Column, fallback: str) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(c, r'[?:/\\*"<>|]+', " "), r"\s+", " ")
    return F.coalesce(clean(cleaned), F.lit(fallback))


def disc_and_track(stem: Column) -> Column:
    """Disc and track number that a file name begins with."""
    patterns = [r"(?i)^(?:cd|disc)\s*(\d+)\s*[-._ ]+\s*(\d+)\b", r"^(\d+)\s*[-._]\s*(\d+)\b", r"^(\d+)\s+(\d+)\b"]
    number = lambda p, g: F.regexp_extract(stem, p, g).try_cast("int")
    disc, track = F.lit(None).cast("int"), F.when(stem.rlike(r"^(\d+)\b"), number(r"^(\d+)\b", 1))
    for p in reversed(patterns):
        disc, track = F.when(stem.rlike(p), number(p, 1)).otherwise(disc), F.when(stem.rlike(p), number(p, 2)).otherwise(track)
    return F.struct(disc.alias("disc"), track.alias("track"))


def file_name(disc: Column, discs: Column, track: Column, title: Column, ext: Column) -> Column:
    dotted = F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    number = F.coalesce(track, F.lit(0))
    return F.when((F.coalesce(discs, F.lit(1)) > 1) & disc.isNotNull(), F.format_string("%d-%02d - %s%s", disc, number, title, dotted)).otherwise(F.format_string("%02d - %s%s", number, title, dotted))


def of_total(n: Column, total: Column) -> Column:
    return F.when(n.isNotNull(), F.concat_ws("/", n.cast("string"), total.cast("string")))


def quick_key(path: Column, size: Column, mtime_ns: Column) -> Column:
    return F.sha2(F.concat_ws("|", path, size.cast("string"), mtime_ns.cast("string")), 256)


def lossless(codec: Column, ext: Column) -> Column:
    c, e = F.lower(F.trim(codec)), F.lower(F.trim(ext))
    by_codec = F.when(c.startswith("pcm") | c.isin(*LOSSLESS_CODECS), True).when(c.isin(*LOSSY_CODECS), False)
    return F.coalesce(by_codec, e.isin(*LOSSLESS_EXTENSIONS), F.lit(False))


def release_year(date: Column) -> Column:
    return F.when(F.length(date) >= 4, F.left(date, F.lit(4)))


def short_id(c: Column) -> Column:
    return F.coalesce(F.nullif(F.left(F.replace(clean(c), F.lit("-"), F.lit("")), F.lit(8)), F.lit("")), F.lit("unknown"))


def tag_lookup(tags: Column, exact: tuple[str, ...], contains: tuple[str, ...] = ()) -> Column:
    """The first non-blank value of an array of (key, values): exact keys by priority, then keys that contain one, in tag order."""
    def having(test) -> Column:
        return _first_value(F.filter(tags, lambda t: test(tag_key(t["key"]))))

    found = [having(lambda k, a=alias: k == a) for alias in exact]
    found += [having(lambda k, a=alias: F.contains(k, F.lit(a))) for alias in contains]
    return F.coalesce(*found)


def display_lookup(tags: Column, aliases: tuple[str, ...]) -> Column:
    """As tag_lookup with exact keys only, without tags whose keys look like identifiers; keys of artists always count."""
    def shown(t: Column) -> Column:
        k = tag_key(t["key"])
        marked = F.lit(False)
        for m in NOT_DISPLAYED:
            marked = marked | F.contains(k, F.lit(m))
        return ~marked | k.isin("artist", "artists", "albumartist", "albumartists")

    return tag_lookup(F.filter(tags, lambda t: shown(t)), aliases)


def _first_value(tags: Column) -> Column:
    return F.get(flat_clean(F.transform(tags, lambda t: t["values"])), F.lit(0))


def fractions_text(m: Column) -> Column:
    """A map as key=value pairs by key, four decimals."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.format_string("%d=%.4f", e["key"], e["value"])), ";")


def fractions_map(text: Column) -> Column:
    """The pairs of such a text that can be read; the last of equal keys stays."""
    pairs = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.struct(F.trim(F.get(F.split(p, "="), F.lit(0))).try_cast("int").alias("key"), F.trim(F.get(F.split(p, "="), F.lit(1))).try_cast("double").alias("value")))
    good = F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull())
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, F.size(good)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def original_confidence(active: Column, least: float = 0.05, gamma: float = 1.0) -> Column:
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (active - least) / (1 - least)))
    return F.when(active >= 1, F.lit(1.0)).otherwise(F.pow(x, F.lit(gamma)))


def effective_cutoff(samplerate: Column) -> Column:
    return F.least(F.lit(20500.0), F.greatest(F.lit(0.0), samplerate / 2 - 100)).cast("double")


def provider_error(status: Column, code: Column, message: Column, has_error: Column) -> Column:
    details = F.concat_ws(", ", F.concat(F.lit("code="), code), F.concat(F.lit("message="), clean(message)))
    return F.when(~has_error, F.lit("error status without a payload")).when(details == "", F.lit("error status with an empty payload")).otherwise(F.concat(F.lit("error status ("), details, F.lit(")")))


def credit_phrase(parts: Column, phrase: Column) -> Column:
    """A credit as printed: the given phrase, else names and joining words of its parts in order."""
    return F.coalesce(clean(phrase), clean(F.array_join(F.transform(parts, lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.coalesce(p["join"], F.lit("")))), "")))


def genre_text(genres: Column, tags: Column) -> Column:
    """Distinct genres, else tags, joined."""
    g, t = distinct_clean(F.coalesce(genres, F.array().cast("array<string>"))), distinct_clean(F.coalesce(tags, F.array().cast("array<string>")))
    return F.nullif(F.array_join(F.when(F.size(g) > 0, g).otherwise(t), "; "), F.lit(""))


def names_by_relation(relations: Column, kind: str) -> Column:
    """Distinct names of an array of (type, name) with the given type."""
    return distinct_clean(F.transform(F.filter(relations, lambda r: r["type"] == kind), lambda r: r["name"]))


def first_format(formats: Column) -> Column:
    return F.get(F.filter(F.transform(formats, lambda x: F.trim(x)), lambda f: f != ""), F.lit(0))
