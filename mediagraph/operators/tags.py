"""Container tags of canonical track rows: one row for each key that a file's family of tags would be given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from mediagraph.functions.lyrics import timed_lines
from mediagraph.functions.text import clean

#: The family of tags of each extension.
FAMILY = {".flac": "vorbis", ".ogg": "vorbis", ".opus": "vorbis", ".mp3": "frames", ".wav": "frames", ".aiff": "frames", ".m4a": "atoms", ".wma": "attributes"}

#: The fields of a Vorbis comment. A key is the field's name in capitals without underscores (UNDERSCORED keep them), but
#: for those of VORBIS_NAMES.
VORBIS_FIELDS = (
    "title", "artist", "artists", "artist_sort", "album", "albumsort", "album_artist", "album_artist_sort", "track_number", "total_tracks", "disc_number", "total_discs", "disc_subtitle", "release_date",
    "original_date", "original_year", "release_country", "release_status", "releasetype", "media", "label", "barcode", "catalognumber", "asin", "composer", "composersort", "lyricist", "writer", "arranger",
    "conductor", "performer", "producer", "engineer", "mixer", "djmixer", "remixer", "director", "work", "movement", "movementnumber", "movementtotal", "showmovement", "genre", "grouping", "mood", "bpm", "key",
    "language", "comment", "subtitle", "titlesort", "compilation", "copyright", "license", "lyrics", "encodedby", "encodersettings", "originalfilename", "originalartist", "publisher", "script", "isrc",
    "replaygain_album_gain", "replaygain_album_peak", "replaygain_album_range", "replaygain_reference_loudness", "replaygain_track_gain", "replaygain_track_peak", "replaygain_track_range",
    "musicbrainz_albumartistid", "release_mbid", "musicbrainz_artistid", "musicbrainz_composerid", "musicbrainz_discid", "musicbrainz_originalalbumid", "musicbrainz_originalartistid", "recording_mbid",
    "release_group_mbid", "track_mbid", "musicbrainz_trmid", "musicbrainz_workid", "acoustid_id", "acoustid_fingerprint", "musicip_puid",
)
UNDERSCORED = ("replaygain_", "musicbrainz_", "acoustid_", "musicip_")
VORBIS_NAMES = {
    "total_tracks": ("TRACKTOTAL", "TOTALTRACKS"), "total_discs": ("DISCTOTAL", "TOTALDISCS"), "release_date": ("DATE",), "movement": ("MOVEMENTNAME",), "movementnumber": ("MOVEMENT",),
    "release_mbid": ("MUSICBRAINZ_ALBUMID",), "recording_mbid": ("MUSICBRAINZ_TRACKID",), "release_group_mbid": ("MUSICBRAINZ_RELEASEGROUPID",), "track_mbid": ("MUSICBRAINZ_RELEASETRACKID",),
}
#: Identifiers, whose two parts are joined by a blank in frames and atoms, by a slash in attributes.
IDENTIFIERS = {
    "musicbrainz_albumartistid": ("MusicBrainz", "Album Artist Id"), "release_mbid": ("MusicBrainz", "Album Id"), "musicbrainz_artistid": ("MusicBrainz", "Artist Id"), "musicbrainz_discid": ("MusicBrainz", "Disc Id"),
    "musicbrainz_originalalbumid": ("MusicBrainz", "Original Album Id"), "musicbrainz_originalartistid": ("MusicBrainz", "Original Artist Id"), "recording_mbid": ("MusicBrainz", "Recording Id"),
    "release_group_mbid": ("MusicBrainz", "Release Group Id"), "track_mbid": ("MusicBrainz", "Track Id"), "acoustid_id": ("Acoustid", "Id"), "acoustid_fingerprint": ("Acoustid", "Fingerprint"),
    "musicip_fingerprint": ("MusicIP", "Fingerprint"), "musicip_puid": ("MusicIP", "PUID"),
}
#: Text frames by field, and the fields that become described frames under their Vorbis key.
FRAMES = {
    "album": "TALB", "album_artist": "TPE2", "albumsort": "TSOA", "artist_sort": "TSOP", "genre": "TCON", "composer": "TCOM", "conductor": "TPE3", "grouping": "TIT1", "title": "TIT2", "subtitle": "TIT3",
    "release_date": "TDRL", "original_date": "TDOR", "isrc": "TSRC", "media": "TMED", "disc_subtitle": "TSST", "bpm": "TBPM", "key": "TKEY", "copyright": "TCOP", "encodedby": "TENC", "encodersettings": "TSSE",
    "originalartist": "TOPE", "remixer": "TPE4", "publisher": "TPUB", "lyrics": "USLT", "recording_mbid": "UFID:http://musicbrainz.org", "url": "WXXX:URL",
}
DESCRIBED = ("album_artist_sort", "artists", "asin", "barcode", "catalognumber", "label", "original_year", "release_country", "release_status", "releasetype", "script")
#: Atoms by field, and the names of free-form ones.
ATOMS = {
    "album": "\xa9alb", "album_artist": "aART", "title": "\xa9nam", "release_date": "\xa9day", "genre": "\xa9gen", "composer": "\xa9wrt", "grouping": "\xa9grp", "lyrics": "\xa9lyr", "albumsort": "soal",
    "album_artist_sort": "soaa", "artist_sort": "soar",
}
FREE_FORM = {
    "artists": "Artists", "album_artists": "Album Artists", "asin": "ASIN", "barcode": "BARCODE", "catalognumber": "CATALOGNUMBER", "disc_subtitle": "DISCSUBTITLE", "isrc": "ISRC", "label": "LABEL", "media": "MEDIA",
    "original_date": "Original Date", "original_year": "Original Year", "release_country": "Release Country", "release_status": "Release Status", "releasetype": "Release Type", "script": "SCRIPT", "bpm": "BPM",
    "copyright": "Copyright", "encodedby": "Encoded By", "encodersettings": "Encoder Settings", "key": "Initial Key", "subtitle": "Subtitle", "publisher": "Publisher", "url": "URL", "originalartist": "Original Artist",
    "remixer": "Remixer", "conductor": "Conductor",
}
#: Attributes by field.
ATTRIBUTES = {
    "album": "WM/AlbumTitle", "album_artist": "WM/AlbumArtist", "title": "Title", "track_number": "WM/TrackNumber", "release_date": "WM/Year", "genre": "WM/Genre", "composer": "WM/Composer", "conductor": "WM/Conductor",
    "subtitle": "WM/SubTitle", "lyrics": "WM/Lyrics", "publisher": "WM/Publisher", "label": "LABEL", "bpm": "WM/BeatsPerMinute", "grouping": "WM/ContentGroupDescription", "url": "WM/AuthorURL",
    "originalartist": "WM/OriginalArtist", "remixer": "WM/ModifiedBy", "release_country": "ReleaseCountry", "release_status": "ReleaseStatus", "releasetype": "ReleaseType", "script": "SCRIPT", "isrc": "ISRC",
    "asin": "ASIN", "barcode": "BARCODE", "catalognumber": "CATALOGNUMBER", "original_date": "OriginalDate", "original_year": "OriginalYear", "media": "Media", "disc_subtitle": "DiscSubtitle",
}
#: The keys whose values are made of several fields, or of one in another form.
MADE = {
    "vorbis": {"fingerprint marked": "FINGERPRINT", "site": "WEBSITE", "rated": "RATING"},
    "frames": {"artists joined": "TPE1", "track of total": "TRCK", "disc of total": "TPOS", "lines": "SYLT"},
    "atoms": {"artists joined": "\xa9ART", "track and total": "trkn", "disc and total": "disk"},
    "attributes": {"artists joined": "Author", "disc of total": "WM/PartOfSet"},
}
#: Fixed value: what a fingerprint of this kind begins with in a Vorbis comment.
FINGERPRINT_MARK = "MusicMagic Fingerprint "


def vorbis_keys(field: str) -> tuple[str, ...]:
    return VORBIS_NAMES.get(field) or ((field if field.startswith(UNDERSCORED) else field.replace("_", "")).upper(),)


def key_map() -> dict[str, list[tuple[str, str]]]:
    """Family to its pairs of field and key, for all keys whose values are those of one field as they are."""
    ids = lambda sep, head="": [(f, head + sep.join(parts)) for f, parts in IDENTIFIERS.items()]
    return {
        "vorbis": [(f, k) for f in VORBIS_FIELDS for k in vorbis_keys(f)],
        "frames": [*FRAMES.items(), *[(f, f"TXXX:{vorbis_keys(f)[0]}") for f in DESCRIBED], *[(f, k) for f, k in ids(" ", "TXXX:") if f != "recording_mbid"]],
        "atoms": [*ATOMS.items(), *[(f, f"----:com.apple.iTunes:{n}") for f, n in FREE_FORM.items()], *ids(" ", "----:com.apple.iTunes:")],
        "attributes": [*ATTRIBUTES.items(), *ids("/")],
    }


def container_tags(tracks: DataFrame, file: str, ext: str) -> DataFrame:
    """file, container_key and values (texts) of each key that a canonical track row gives, by the family of the file's extension.

    Fields that tracks lacks are null. Null and blank values are left out, and a key without values has no row; lists keep their order
    and repeats. Numbers of tracks and discs are joined with their totals in frames and in the attribute of discs, and are two values,
    the total 0 where it isn't known, in atoms. Synced lyrics are values of milliseconds, a blank and the text. A file of another
    extension has no rows.
    """
    types = {f.name: f.dataType for f in tracks.schema}
    none = F.array().cast("array<string>")

    def one(field: str) -> Column:
        return clean(F.col(field).cast("string")) if field in types else F.lit(None).cast("string")

    def some(c: Column) -> Column:
        return F.array_compact(F.array(c))

    def values(field: str) -> Column:
        if isinstance(types.get(field), ArrayType):
            return F.array_compact(F.transform(F.coalesce(F.col(field).cast("array<string>"), none), clean))
        return some(one(field))

    def number(field: str) -> Column:
        return one(field).try_cast("int")

    def of_total(field: str, total: str) -> Column:
        return some(F.when(number(field).isNotNull(), F.concat_ws("/", number(field).cast("string"), number(total).cast("string"))))

    def pair(field: str, total: str) -> Column:
        known = F.array(number(field).cast("string"), F.coalesce(number(total), F.lit(0)).cast("string"))
        return F.when(number(field).isNotNull(), known).otherwise(none)

    artists = values("artists")
    credited = some(F.when(F.size(artists) > 0, F.array_join(artists, "; ")).otherwise(one("artist")))
    marked = F.transform(values("musicip_fingerprint"), lambda x: F.when(x.startswith(FINGERPRINT_MARK), x).otherwise(F.concat(F.lit(FINGERPRINT_MARK), x)))
    synced = F.transform(timed_lines(one("syncedlyrics")), lambda e: F.concat_ws(" ", e["ms"].cast("string"), e["text"]))
    site = some(clean(F.coalesce(F.nullif(F.col("website").cast("string"), F.lit("")) if "website" in types else F.lit(None), F.col("url").cast("string") if "url" in types else F.lit(None)).cast("string")))
    rated = F.concat_ws(":", F.lit("RATING"), F.coalesce(one("rating_email"), one("rating_user_email")))
    made = {
        "artists joined": credited, "fingerprint marked": marked, "site": site, "lines": synced, "track of total": of_total("track_number", "total_tracks"), "disc of total": of_total("disc_number", "total_discs"),
        "track and total": pair("track_number", "total_tracks"), "disc and total": pair("disc_number", "total_discs"),
    }
    names = [(family, field, key) for family, pairs in key_map().items() for field, key in [*pairs, *MADE[family].items()]]
    plain = [(F.lit(f), values(f)) for f in sorted({f for _, f, _ in names} & set(types))]
    entries = F.array(*[F.struct(name.alias("field"), F.lit(None).cast("string").alias("own_key"), v.alias("values")) for name, v in [*plain, *[(F.lit(n), v) for n, v in made.items()]]])
    rating = F.array(F.struct(F.lit("rated").alias("field"), rated.alias("own_key"), values("rating").alias("values")))
    family = F.coalesce(*[F.when(F.lower(ext) == e, name) for e, name in FAMILY.items()])
    long = tracks.select(file, family.alias("_family"), F.inline(F.filter(F.concat(entries, rating), lambda r: F.size(r["values"]) > 0))).filter("_family is not null")
    keys = tracks.sparkSession.createDataFrame(names, "_family string, field string, container_key string")
    found = long.join(F.broadcast(keys), ["_family", "field"])  # a fixed table, of the keys above
    return found.select(file, F.coalesce("own_key", "container_key").alias("container_key"), "values")
