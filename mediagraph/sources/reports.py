"""Report sinks: analysis rows, duplicate members, manifests and grouping text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagraph.functions.text import clean

#: The columns of the analysis report, in order.
ANALYSIS_COLUMNS = ("path", "status", "confidence", "samplerate_hz", "num_samples", "num_total_frames", "num_non-silent_frames", "effective_cutoff_hz", "per_cutoff_active_fraction")


def write_analysis(results: DataFrame, path: str) -> None:
    """Appends the report's columns as CSV; missing ones are empty, others are left out."""
    cols = [(F.format_string("%.6f", c) if c == "confidence" else F.col(f"`{c}`")).alias(c) if c in results.columns else F.lit("").alias(c) for c in ANALYSIS_COLUMNS]
    results.select(*cols).write.mode("append").option("header", True).csv(path)


def write_manifest(actions: DataFrame, summary: DataFrame, path: str) -> None:
    """The actions as JSON rows under path/actions, and the one-row summary under path/summary."""
    actions.write.mode("overwrite").json(f"{path}/actions")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def error_digest(rows: DataFrame, reason: str, example: str, examples: int = 5) -> DataFrame:
    """reason, n and the first examples; blank reasons are unknown errors."""
    named = rows.select(F.coalesce(clean(F.col(reason)), F.lit("unknown error")).alias("reason"), F.col(example).alias("example"))
    firsts = named.withColumn("k", F.row_number().over(Window.partitionBy("reason").orderBy("example"))).filter(F.col("k") <= examples).groupBy("reason").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    return named.groupBy("reason").agg(F.count("*").alias("n")).join(firsts, "reason")


#: What orders the lines of the text report.
LINE_ORDER = ("section", "part", "item", "n")


def grouping_report(clusters: DataFrame, selections: DataFrame, candidates: DataFrame, planned: DataFrame, lyrics: DataFrame) -> DataFrame:
    """The text report of a grouping run, as rows of LINE_ORDER and line: clusters, the release chosen for each, planned files, lyrics.

    clusters: cluster (a number), file; selections: cluster, status, release, album, album_artist, date, matched, tracks, reason, error;
    candidates: cluster, rank, release, score, reasons (three of each, for the first three); planned: file (a number), original_path,
    output_path, status, reason; lyrics: file, line. A section without rows says none; missing values say missing, or have no line.
    """
    text = lambda c: F.col(c).cast("string")
    said = lambda label, c, default="missing": F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(c, F.lit("")), F.lit(default)))

    def lines(df: DataFrame, section: int, part: int, item: Column, every: list[Column], indent: str = "") -> DataFrame:
        found = F.transform(F.array_compact(F.array(*every)), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit(indent), x)))
        return df.select(F.lit(section).alias("section"), F.lit(part).alias("part"), item.cast("long").alias("item"), F.posexplode(found).alias("n", "line"))

    def around(df: DataFrame, section: int, head: list[Column], none: str, end: bool = True) -> list[DataFrame]:
        size = df.agg(F.count("*").alias("_n"))  # one row
        first = lines(size, section, 0, F.lit(0), [*head, F.when(F.col("_n") == 0, none)])
        return [first, lines(size, section, 2, F.lit(0), [F.lit("")])] if end else [first]

    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("files"))
    reasons = F.coalesce(F.nullif(F.array_join(F.slice("reasons", 1, 3), "; "), F.lit("")), F.lit("no reasons"))
    top = F.concat(F.lit("        "), text("rank"), F.lit(". "), F.concat_ws(" | ", text("release"), text("score"), reasons))
    best = candidates.filter("rank <= 3").groupBy("cluster").agg(F.min_by("score", "rank").cast("string").alias("_score"), F.transform(F.array_sort(F.collect_list(F.struct("rank", top.alias("line")))), lambda x: x["line"]).alias("_top"))
    chosen = selections.join(best, "cluster", "left")
    labels = [("status", "status"), ("selected_release_mbid", "release"), ("score", "_score"), ("album", "album"), ("album_artist", "album_artist"), ("date", "date"), ("matched_track_count", "matched"), ("total_track_count", "tracks")]
    facts = [F.concat(F.lit("    "), said(label, text(c), "n/a" if c == "_score" else "missing")) for label, c in labels]
    tops = F.array_join(F.coalesce("_top", F.array(F.lit("        none"))), "\n    ")
    why = [F.when(F.coalesce(text(c), F.lit("")) != "", F.concat(F.lit(f"    {c}: "), text(c))) for c in ("reason", "error")]
    choice = [F.concat(F.lit("Cluster "), text("cluster"), F.lit(":")), *[F.concat(F.lit("    "), c) for c in (F.lit("Release selection:"), *facts, F.lit("    top candidates:"), tops, *why)], F.lit("")]
    reasoned = F.coalesce(text("reason"), F.lit("")) != ""
    plan = [F.lit("original:"), F.concat(F.lit("    "), text("original_path")), F.lit("output:"), F.concat(F.lit("    "), text("output_path")), F.lit("status:"), F.concat(F.lit("    "), text("status"))]
    plan += [F.when(reasoned, "reason:"), F.when(reasoned, F.concat(F.lit("    "), text("reason")))]
    parts = [
        *around(sizes, 1, [F.lit("Album clustering:"), F.concat(F.lit("    cluster_count: "), text("_n")), F.lit("    clusters:")], "        none"),
        lines(sizes, 1, 1, F.col("cluster"), [F.concat(F.lit("        "), text("cluster"), F.lit(". "), text("files"), F.lit(" track(s)"))]),
        *around(selections, 2, [F.lit("Release selection details:")], "    none", end=False), lines(chosen, 2, 1, F.col("cluster"), choice),
        *around(planned, 3, [F.lit("Planned files:")], "    none"), lines(planned, 3, 1, F.col("file"), plan),
        *around(lyrics, 4, [F.lit("Lyrics progress:")], "    none", end=False), lines(lyrics, 4, 1, F.col("file"), [F.col("line")]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    # the top candidates are one text until here, as they are a list of up to three
    return out.select("section", "part", "item", "n", F.posexplode(F.split("line", "\n")).alias("m", "line")).select("section", "part", "item", (F.col("n").cast("long") * (1 << 20) + F.col("m")).alias("n"), "line")


def write_grouping_report(lines: DataFrame, path: str) -> None:
    """The report's lines in order, as text files whose names are in that order."""
    lines.orderBy(*LINE_ORDER).select("line").write.mode("overwrite").text(path)
