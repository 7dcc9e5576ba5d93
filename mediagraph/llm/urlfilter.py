"""URL filter by a path-template tree, in DataFrame expressions only.

Per host, segments that vary (numbers, hex strings, or too many values that hardly repeat) become wildcards; labelled sibling
branches whose share of bad pages doesn't differ from their parent's are merged; a template is rejected by its purity, the smoothed
share of good pages among its labelled ones. Explicit rules go before the tree's verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagraph.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, ASCII letters lower-cased; empty for null or a url without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (like net/) and its action, null where none fits. rules: (action, host, path), written out by the caller."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def typed_segments(path: Column) -> Column:
    """The path's segments with numbers and hex strings as typed wildcards."""
    parts = F.filter(F.split(path, "/", -1), lambda _, i: i > 0)

    def typed(s: Column) -> Column:
        ending = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})?$", 1)
        stem = F.left(s, F.length(s) - F.length(ending))
        return F.when(stem.rlike(r"^[0-9]+$"), F.concat(F.lit("<num>"), ending)).when(stem.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$"), F.concat(F.lit("<hex>"), ending)).otherwise(s)

    return F.transform(parts, typed)


def template_tree(paths: DataFrame, least_children: int = 16, least_repeats: float = 4.0, z: float = 1.96, least_labelled: int = 5) -> DataFrame:
    """paths (host, segments, n, labelled, bad; a row for each host and segments) with the template of each row's leaf.

    Level by level from the root: a node whose children are least_children or more, with fewer than least_repeats pages each on
    average, gets one child <any>; then children of one height with least_labelled labelled pages or more, that don't differ from their
    parent's share of bad pages (a two-sided z test at z), are merged into <like>; with fewer labels a branch stays as it is. Levels go on until no row has a further segment; a row that is
    alone below its node has nothing to be merged with at any level, so the rest of its segments is taken at once.
    """
    tree, level = paths.withColumn("template", F.array().cast("array<string>")), 0
    done = tree.filter(F.size("segments") == 0)
    tree = tree.filter(F.size("segments") > 0)
    while not tree.isEmpty():
        at = tree.withColumn("seg", F.get("segments", F.lit(level)))
        children = at.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
        nodes = children.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("pages"), F.sum("rows").alias("rows"))
        wide = (F.col("children") >= least_children) & (F.col("pages") < least_repeats * F.col("children"))
        alone = (F.col("rows") == 1) & F.lit(least_children > 1)
        nodes = nodes.select("host", "template", wide.alias("wide"), alone.alias("alone")).filter("wide or alone")
        at = at.join(nodes, ["host", "template"], "left").withColumn("seg", F.when(F.col("wide"), F.lit("<any>")).otherwise(F.col("seg")))
        at = saved(at.drop("wide").withColumn("alone", F.coalesce("alone", F.lit(False))).withColumn("height", F.size("segments")), "level")
        key = ["host", "template", "height"]
        branches = at.groupBy(*key, "seg").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        parents = branches.groupBy(*key).agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"), F.count("*").alias("siblings")).filter("siblings > 1")
        share = (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)
        spread = F.sqrt(share * (1 - share) / F.greatest(F.col("labelled"), F.lit(1)))
        like = (F.col("labelled") >= least_labelled) & (F.abs(F.col("bad") / F.nullif(F.col("labelled"), F.lit(0)) - share) < z * spread)
        merged = branches.join(parents, key).filter(like).select(*key, "seg", F.lit("<like>").alias("to"))
        rest = F.when(F.col("alone"), F.slice("segments", level + 2, 1 << 30)).otherwise(F.array().cast("array<string>"))
        tree = at.join(merged, [*key, "seg"], "left").withColumn("template", F.concat("template", F.array(F.coalesce("to", "seg")), rest)).select(*paths.columns, "template", "alone")
        tree, level = saved(tree, "level"), level + 1
        more = (F.size("segments") > level) & ~F.col("alone")
        done, tree = done.unionByName(tree.filter(~more).drop("alone")), tree.filter(more).drop("alone")
    return done


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", weight: float = 10.0, reject: float = 0.5, sure: float = 3.0) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each page.

    labels (url_key, bad 0 or 1) marks pages by the last run of digits in their path, which names the document shown there. A
    template's purity is (good + weight * overall share of good) / (labelled + weight); it is blocked if that is under reject and, by
    sure standard errors, under the overall share (or the latter is itself under reject). A null url, or one without ://,
    has an empty host and path and is judged like any other template. Repeated rows are judged each; empty tables give empty tables;
    without labels nothing is blocked but by rules.
    """
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("segments", typed_segments(F.col("path")))
    known = labels.filter("url_key is not null and bad is not null").groupBy("url_key").agg(F.max("bad").alias("bad"))
    keyed = seen.select("host", "segments", F.expr(r"try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as bigint)").alias("url_key"))
    # pages without a key have no label and need no join
    bad = keyed.filter("url_key is not null").join(known, "url_key", "left").unionByName(keyed.filter("url_key is null"), allowMissingColumns=True)
    keyed = bad.select("host", "segments", "bad")
    paths = saved(keyed.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")), "paths")
    overall = paths.agg(F.sum("bad"), F.sum("labelled")).first()
    good = 1 - overall[0] / overall[1] if overall[1] else 1.0
    tree = template_tree(paths)
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    leaves = leaves.withColumn("purity", (F.col("labelled") - F.col("bad") + weight * good) / (F.col("labelled") + weight))
    most = F.col("purity") + sure * F.sqrt(F.col("purity") * (1 - F.col("purity")) / (F.col("labelled") + weight))
    impure = (F.col("purity") < reject) & ((most < good) | F.lit(good < reject))
    leaves = leaves.select("host", "template", "purity", impure.alias("impure"))
    judged = tree.select("host", "segments", "template").join(leaves, ["host", "template"])
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("impure"), "block").otherwise("allow"))
    out = seen.join(judged, ["host", "segments"], "left")
    return out.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.round("purity", 6).alias("purity"))
