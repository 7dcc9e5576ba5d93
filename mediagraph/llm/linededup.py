"""Line dedup: lines that many documents share stay in one of them only.

Texts are split into lines; the key of a line is the line without white space at its ends and with A-Z lower-cased. Hashes of long
enough keys are counted by distinct documents; the lines of keys in too many documents go, except in the document of the largest id,
and texts are put together again from what stays, by position.

Only hashes and positions are shuffled by line; a text moves once, to meet the positions it loses. Keys that hold a large share of all
shared lines are told to every task (their number has a bound that follows from that share); all others meet by a shuffle.

Edge cases: a null or empty text is one empty line and comes back as an empty text; a row without id counts as no document, and
keeps all its lines; rows that repeat an id are one document, and each keeps or loses lines by that id; two rows equal in id and text
are treated alike; an empty table gives no rows; columns of any other name are kept, and those named like added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagraph.llm.common import fresh, saved

#: ASCII white space, as Spark SQL's trim takes it.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with more than one in so many of all shared lines is sent to every task: fewer than so many keys can be.
HEAVY_SHARE = 20_000


def line_key(line: Column) -> Column:
    """Letters outside A-Z keep their case, so lower() does for lines of ASCII only."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, n_docs and last_doc (the largest id) of the keys in min_docs documents or more. Documents are counted where they are
    spread by key and id, so that a key of many documents is summed from parts of all tasks."""
    one_each = lines.filter("doc_id is not null").select("h1", "h2", "doc_id").distinct()
    return one_each.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc")).filter(F.col("n_docs") >= min_docs)


def lost_lines(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """doc_id, text_key and pos of the saved lines whose key is shared, but for those in the key's last document."""
    total = shared.agg(F.sum("n_docs")).first()[0] or 0
    is_heavy = F.col("n_docs") * HEAVY_SHARE > F.lit(total)
    heavy, others = shared.filter(is_heavy), shared.filter(~is_heavy)
    columns = ["doc_id", "text_key", "pos"]
    common = lines.join(F.broadcast(heavy), ["h1", "h2"]).filter("doc_id <> last_doc").select(columns)
    rest = lines.join(F.broadcast(heavy.select("h1", "h2")), ["h1", "h2"], "left_anti").join(others, ["h1", "h2"])
    return common.unionByName(rest.filter("doc_id <> last_doc").select(columns))


def without_lines(text: Column, lost: Column) -> Column:
    """text without the lines at the ascending positions of lost, a column of its own: a mark for each line up to the last lost one is
    laid beside the lines, and joining leaves out those that become null."""
    gaps = F.transform(lost, lambda at, i: F.repeat(F.lit("0"), at - F.coalesce(F.get(lost, i - 1), F.lit(-1)) - 1))
    marks = F.split(F.concat(F.array_join(gaps, "1"), F.lit("1")), "")
    kept = F.zip_with(F.split(text, "\n"), marks, lambda line, mark: F.when(mark == "1", F.lit(None)).otherwise(line))
    return F.array_join(kept, "\n")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with shared lines taken out of their text, and n_lines (before) and n_dropped."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).filter("doc_id is not null")
    exploded = source.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = exploded.select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    lines = saved(keyed.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")), "lines")
    shared = saved(shared_lines(lines, min_docs), "shared_lines")
    lost_by_text = lost_lines(lines, shared).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("lost"))

    key, at, lost, body = (fresh(docs, s) for s in ("line_text_key", "line_doc", "line_lost", "line_text"))
    right = lost_by_text.select(F.col("doc_id").alias(at), F.col("text_key").alias(key), F.col("lost").alias(lost)).hint("shuffle_hash")
    left = docs.withColumn(body, text)
    met = left.join(right, (F.col(id_col) == F.col(at)) & (F.xxhash64(body) == F.col(key)), "left")
    new = F.when(F.col(lost).isNull(), F.col(body)).otherwise(without_lines(F.col(body), F.col(lost)))
    added = {text_col: new, "n_lines": F.size(F.split(body, "\n")).cast("long"), "n_dropped": F.coalesce(F.size(lost), F.lit(0)).cast("long")}
    return met.withColumns(added).drop(key, at, lost, body)


def digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))
