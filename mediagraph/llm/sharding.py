"""Hilbert-curve sharding: quantise metadata dimensions, order rows along the curve, cut the order into runs of equal length.

Neighbours on the curve are neighbours in every dimension, so each shard covers a small box of the metadata space and readers can
skip shards by any of the dimensions. Only DataFrame expressions are used. The global rank of a row is the sum of three bounded
steps (rows in earlier cells, rows in earlier slices of the cell, place in the slice), so neither a cell nor the whole order is
ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of the grid are at most 2 ** MAX_GRID_BITS, so tables with a row per cell are small whatever the input.
MAX_GRID_BITS = 16


def hashed_level(value: Column, bits: int) -> Column:
    """A level for a categorical value; null has its own hash."""
    return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit("\0"))), F.lit(1 << bits)).cast("long")


def log_level(value: Column, bits: int, step: float = 0.5) -> Column:
    """A level for a size on a log scale: step powers of two for each level; null and sizes up to 1 are level 0."""
    level = F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(1)).cast("double")) / step)
    return F.least(level, F.lit((1 << bits) - 1)).cast("long")


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """The place of a grid cell on the Hilbert curve, from the levels of its dimensions (0 to 2 ** bits - 1)."""
    n = len(levels)
    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]
    x = F.array(*[v.cast("long") for v in levels])

    def undo(acc: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = q - F.lit(1)
        head, here = F.get(acc, F.lit(0)), F.get(acc, i)
        swap = (head.bitwiseXOR(here)).bitwiseAND(low)
        flip = here.bitwiseAND(q) != 0
        return F.transform(
            acc,
            lambda v, j: F.when(flip, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(F.when((i != 0) & ((j == 0) | (j == i)), v.bitwiseXOR(swap)).otherwise(v)),
        )

    if steps:
        x = F.aggregate(F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps]), x, undo)
    # Gray code: each coordinate takes in those before it, then the parity of the last one's bits
    gray = F.aggregate(x, F.array().cast("array<long>"), lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.coalesce(F.element_at(F.concat(F.array(F.lit(0).cast("long")), acc), -1), F.lit(0))))))
    places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    parity = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])

    def place(g: Column) -> Column:
        t = F.aggregate(parity, F.lit(0).cast("long"), lambda acc, q: F.when(F.element_at(g, -1).bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
        both = F.transform(g, lambda v: v.bitwiseXOR(t))
        return F.aggregate(F.transform(places, lambda p: F.expr("0L") + F.get(both, p["i"]).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p["b"]))), F.lit(0).cast("long"), lambda acc, bit: acc * 2 + F.when(bit != 0, 1).otherwise(0))

    return F.element_at(F.transform(F.array(gray), place), 1)


def curve(dimensions: int, bits: int, spark) -> DataFrame:
    """A row for each cell of the grid: l0, l1, ... and its place on the curve."""
    if dimensions * bits > MAX_GRID_BITS:
        raise ValueError(f"a grid of {dimensions * bits} bits is above the bound of {MAX_GRID_BITS}")
    cells = spark.range(1 << (dimensions * bits), numPartitions=1)
    levels = [F.floor(F.col("id") / (1 << (bits * i))).cast("long").bitwiseAND(F.lit((1 << bits) - 1)) for i in range(dimensions)]
    cells = cells.select(*[v.alias(f"l{i}") for i, v in enumerate(levels)])
    return cells.withColumn("place", hilbert_index([F.col(f"l{i}") for i in range(dimensions)], bits))


def assign(rows: DataFrame, levels: list[Column], tie: list[Column], shards: int, bits: int, rows_per_slice: int = 1_000_000) -> DataFrame:
    """rows with levels l0, l1, ..., place on the curve, rank, shard and slot: the counts of any two shards differ by one at most.

    tie orders rows of one cell; rows alike in every tie column are given their ranks in no stated order, which can't be told from
    outside. rows must not have columns named like those added.
    """
    spark, n = rows.sparkSession, len(levels)
    cells = curve(n, bits, spark)
    total = rows.count()
    slices = max(16, -(-total // rows_per_slice))
    keyed = rows.select("*", *[v.alias(f"l{i}") for i, v in enumerate(levels)]).join(F.broadcast(cells), [f"l{i}" for i in range(n)])
    keyed = keyed.withColumn("slice", F.pmod(F.xxhash64(*tie), F.lit(slices)))
    counts = keyed.groupBy("place", "slice").agg(F.count("*").alias("n"))
    before_slice = counts.select("place", "slice", (F.sum("n").over(Window.partitionBy("place").orderBy("slice")) - F.col("n")).alias("slice_offset"))
    in_cell = counts.groupBy("place").agg(F.sum("n").alias("n"))
    # one row for each cell of a bounded grid
    before_cell = in_cell.select("place", (F.sum("n").over(Window.orderBy("place")) - F.col("n")).alias("cell_offset"))
    offsets = before_slice.join(F.broadcast(before_cell), "place").select("place", "slice", (F.col("cell_offset") + F.col("slice_offset")).alias("offset"))
    ranked = keyed.withColumn("within", F.row_number().over(Window.partitionBy("place", "slice").orderBy(*tie))).join(offsets, ["place", "slice"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("within") - 1)
    ranked = ranked.withColumn("shard", F.expr(f"cast((rank * {shards}L) div {max(total, 1)}L as int)"))
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return ranked.withColumn("slot", F.col("rank") - first).drop("within", "offset", "slice")


def shard_documents(docs: DataFrame, shards: int = 40, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the levels of each row, along a curve over language, source and size.

    Law `rows`: the counts of shards are at most one apart; equal texts need not share a shard, since a group of copies may be larger
    than one. size is the text's UTF-8 bytes plus 16; a null text has none, and the checksum of nothing. A column lang or source that
    is null or missing has a level of its own. Repeated rows get a slot each; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lang, source = (F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source"))
    light = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), lang.alias("lang"), source.alias("source"))
    levels = [hashed_level(F.col("lang"), bits), hashed_level(F.col("source"), bits), log_level(F.col("bytes"), bits, 1.5)]
    tie = [F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), F.col("text_crc32"), F.col("bytes")]
    placed = assign(light, levels, tie, shards, bits)
    return placed.select(
        "doc_id", (F.col("bytes") + 16).alias("size"), "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("l0").alias("lang_level"), F.col("l1").alias("source_level"), F.col("l2").alias("size_level"), "place",
    )


def manifest(placed: DataFrame, dimensions: list[str]) -> DataFrame:
    """A row for each shard: rows, bytes, and the least and greatest level of each dimension, for pruning."""
    bounds = [f(c).alias(f"{name}_{c}") for c in dimensions for f, name in ((F.min, "min"), (F.max, "max"))]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), *bounds)


def shards_to_read(shard_manifest: DataFrame, wanted: dict[str, tuple[int, int]]) -> DataFrame:
    """The shards whose boxes meet the wanted range of levels in every dimension named."""
    for c, (low, high) in wanted.items():
        shard_manifest = shard_manifest.filter((F.col(f"max_{c}") >= low) & (F.col(f"min_{c}") <= high))
    return shard_manifest.select("shard")


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the documents with a folder for each shard, in curve order inside it; ids must be unique."""
    keyed = docs.join(placed.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    keyed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
