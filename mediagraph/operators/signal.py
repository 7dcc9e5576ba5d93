"""Framing, spectral ratios and file status over sample tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Probe cutoffs in Hz, and the bit rate that each one suggests.
PROBES = (13000, 16000, 19000, 20000, 20500)
KBPS = {13000: 96, 16000: 128, 19000: 192, 20000: 256, 20500: 320}


def effective_cutoff(rate: Column) -> Column:
    """The highest frequency worth looking at: 100 Hz below half the rate, and no more than the highest probe."""
    return F.least(F.lit(float(PROBES[-1])), F.greatest(F.lit(0.0), rate.cast("double") / 2 - 100))


def probe_cutoffs(rate: Column, cutoffs: tuple[int, ...] = PROBES) -> Column:
    """The cutoffs that a row of this rate is probed at, ascending."""
    return F.filter(F.array(*map(F.lit, cutoffs)), lambda c: c <= effective_cutoff(rate))


def scrubbed(samples: Column) -> Column:
    """Samples as floats, with 0 for what isn't finite."""
    return F.transform(samples, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), F.lit(0.0)).otherwise(x).cast("float"))


def frames(series: DataFrame, key: str, samples: str, size: int, hop: int) -> DataFrame:
    """key, frame and samples of each full window of size; what is left at the end makes none."""
    n = F.size(samples)
    start = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(hop)))
    cut = series.select(key, samples, F.posexplode(start).alias("frame", "start"))
    return cut.select(key, "frame", F.slice(samples, F.col("start") + 1, size).alias("samples"))


def silent(samples: Column, gate: float = 1e-4) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x))), F.lit(0.0)) < gate


def band_ratios(signals: DataFrame, key: list[str], samples: str, rate: Column, cutoffs: tuple[int, ...] = PROBES) -> DataFrame:
    """key, cutoff and the share of spectral magnitude above it, for each row and cutoff up to the row's effective one.

    One Hann-windowed transform serves all cutoffs of a row; a silent or empty row has share 0.
    """
    given = signals.select(*key, rate.cast("double").alias("rate"), scrubbed(F.col(samples)).cast("array<double>").alias("x"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name not in ("rate", "x"))

    def ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(key) + 1)
            samples = column.flatten().to_numpy(zero_copy_only=False)
            sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
            starts, hertz = np.cumsum(sizes) - sizes, np.nan_to_num(batch.column(len(key)).to_numpy(zero_copy_only=False))
            rows, cuts, shares = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
            # rows of one length and rate are transformed together, about a million samples at a time
            for n, r in {*zip(sizes.tolist(), hertz.tolist(), strict=True)}:
                alike = np.flatnonzero((sizes == n) & (hertz == r))
                wanted = [c for c in cutoffs if c <= min(20500.0, max(0.0, r / 2 - 100))]
                for part in np.array_split(alike, -(-len(alike) * max(n, 1) // 1_000_000)):
                    above = np.zeros((len(part), len(wanted)))
                    if n and r > 0:
                        x = samples[starts[part][:, None] + np.arange(n)]
                        mags, freqs = np.abs(np.fft.rfft(x * np.hanning(n), axis=1)), np.fft.rfftfreq(n, 1 / r)
                        total = mags.sum(axis=1)
                        heard = (np.abs(x).max(axis=1) >= 1e-4) & np.isfinite(total) & (total > 0)
                        for k, c in enumerate(wanted):
                            above[heard, k] = mags[heard, np.searchsorted(freqs, c, side="right") :].sum(axis=1) / total[heard]
                    rows.append(np.repeat(part, len(wanted)))
                    cuts.append(np.tile(np.array(wanted, np.int32), len(part)))
                    shares.append(above.reshape(-1))
            taken = batch.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([*taken.columns[: len(key)], pa.array(np.concatenate(cuts)), pa.array(np.concatenate(shares))], names=[*key, "cutoff", "ratio"])

    return given.mapInArrow(ratios, f"{fields}, cutoff int, ratio double")


def active_fractions(ratios: DataFrame, key: str, quiet: float = 1e-5, active: float = 1e-3) -> DataFrame:
    """key, cutoff and the share of active frames among those that aren't quiet; 0 where none is left."""
    heard = F.count_if(F.col("ratio") > quiet)
    return ratios.groupBy(key, "cutoff").agg(F.coalesce(F.try_divide(F.count_if(F.col("ratio") > F.greatest(F.lit(active), F.lit(quiet))), heard), F.lit(0.0)).alias("fraction"), heard.alias("heard"), F.count("*").alias("frames"))


def elbow(fractions: DataFrame, key: str, quiet: float = 0.02, before: float = 0.2) -> DataFrame:
    """key, cutoff, fraction and kbps: the first quiet cutoff after a loud one (or the first of all), else the lowest quiet one."""
    w = Window.partitionBy(key).orderBy("cutoff")
    at = fractions.withColumn("prev", F.lag("fraction").over(w)).filter(F.col("fraction") <= quiet)
    falls = F.col("prev").isNull() | (F.col("prev") >= before)
    found = at.groupBy(key).agg(F.coalesce(F.min(F.when(falls, F.struct("cutoff", "fraction"))), F.min(F.struct("cutoff", "fraction"))).alias("e"))
    rates = F.create_map(*[F.lit(x) for pair in KBPS.items() for x in pair])
    return found.select(key, "e.cutoff", "e.fraction", F.element_at(rates, F.col("e.cutoff")).alias("kbps"))


def file_status(fractions: DataFrame, key: str, least: float = 0.05, quiet: float = 0.02, before: float = 0.2) -> DataFrame:
    """key, status and confidence, from the fractions at each probe cutoff; the highest cutoff decides whether a file is original."""
    top = fractions.groupBy(key).agg(F.max_by("fraction", "cutoff").alias("top"), F.max_by("heard", "cutoff").alias("heard"), F.max_by("frames", "cutoff").alias("frames"))
    found = top.join(elbow(fractions, key, quiet, before), key, "left")
    original, drop = F.col("top") >= least, F.col("kbps").isNotNull()
    status = F.when(F.col("frames") == 0, "No audio data.").when(F.col("heard") == 0, "Likely UPSCALED (no significant frames)").when(original, "Likely ORIGINAL").when(drop, F.concat(F.lit("Likely UPSCALED from <="), F.col("kbps"), F.lit(" kbps"))).otherwise("Inconclusive (no cutoff match)")
    share = (F.col("top") - least) / (1 - least)
    sure = F.when(F.col("heard") == 0, F.lit(0.0)).when(original, F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))).when(drop, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("fraction")))).otherwise(0.0)
    return found.select(key, status.alias("status"), sure.alias("confidence"))


def suspects(results: DataFrame, single: bool = False) -> DataFrame:
    """What isn't likely original, errors included; single: the rule for files looked at one by one, which names only likely upscaled ones."""
    status = F.coalesce(F.col("status"), F.lit("ERROR"))
    return results.filter(status.startswith("Likely UPSCALED") if single else status != "Likely ORIGINAL")
