"""Cadence, density, grid fits, word consensus and band runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.operators import scan as S
from cutlake.operators.quantiles import exact_quantiles
from cutlake.operators.series import halo


def cadence_stats(blocks: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """Shot count, median, mean, shortest, longest, and shots under half a second."""
    shots = blocks.select(*keys, ((F.col("end_frame") - F.col("start_frame")) / F.lit(rate)).alias("_s"))
    agg = shots.groupBy(*keys).agg(
        F.count("*").alias("shots"), F.round(F.avg("_s"), 6).alias("mean_s"), F.round(F.min("_s"), 6).alias("min_s"), F.round(F.max("_s"), 6).alias("max_s"), F.count_if(F.col("_s") < 0.5).alias("bursts")
    )
    return agg.join(exact_quantiles(shots, keys, "_s", {"median_s": 0.5}).select(*keys, F.round("median_s", 6).alias("median_s")), keys)


def cut_density(ours: DataFrame, reference: DataFrame, key: str, at: str, width: float = 1.0) -> DataFrame:
    """Cuts per bin on one timeline, zero where there is none; the timeline ends with the later cut of either side."""
    binned = lambda df, name: df.groupBy(key, F.floor(F.col(at) / width).alias("bin")).agg(F.count("*").alias(name))
    a, b = binned(ours, "ours"), binned(reference, "reference")
    spine = a.select(key, "bin").unionByName(b.select(key, "bin")).groupBy(key).agg(F.max("bin").alias("_hi"))
    bins = spine.select(key, F.explode(F.sequence(F.lit(0).cast("long"), "_hi")).alias("bin"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return bins.join(a, [key, "bin"], "left").join(b, [key, "bin"], "left").select(key, "bin", zero("ours"), zero("reference"))


def fit_grid(events: DataFrame, keys: list[str], k: str, t: str) -> DataFrame:
    """Least-squares phase and step of ``t = phase + k * step``, tempo and RMS residual."""
    fit = events.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(t, k).alias("_step"), F.regr_intercept(t, k).alias("_phase"), F.regr_syy(t, k).alias("_yy"), F.regr_sxy(t, k).alias("_xy"), F.regr_sxx(t, k).alias("_xx")
    )
    left = F.greatest(F.lit(0.0), F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx"))
    return fit.where("_step IS NOT NULL").select(
        *keys, "n", F.round("_phase", 4).alias("phase"), F.round("_step", 6).alias("step"), F.round(F.lit(60.0) / F.col("_step"), 4).alias("bpm"), F.round(F.sqrt(left / F.col("n")), 4).alias("rms")
    )


def word_consensus(votes: DataFrame, keys: list[str], word: str, at: str, window: str, length: float = 12.0, edge: float = 1.5) -> DataFrame:
    """Median time of each word over windows that hold it away from their edges, made monotonic in word order."""
    inner = votes.where((F.col(at) - F.col(window) >= edge) & (F.col(window) + length - F.col(at) >= edge))
    middle = exact_quantiles(inner, [*keys, word], at, {"_m": 0.5}, count="votes")
    return S.scan(middle, keys, [word], time=S.running_max("_m")).select(*keys, word, "votes", F.round("time", 6).alias("time"))


def sustained_band(series: DataFrame, keys: list[str], pos: str, level: str, hop_seconds: float, low: float = -32.0, high: float = -12.0,
                   least: float = 0.4, window_seconds: float = 6.0, width: int = 4096) -> DataFrame:
    """Runs of at least ``least`` seconds whose level stays in a band below the sliding 90th percentile (dB)."""
    reach = int(window_seconds / hop_seconds / 2)
    ref = halo(series, keys, pos, reach, width, {"_p": lambda w: F.percentile(F.col(level), F.lit(0.9)).over(w.rangeBetween(-reach, reach))})
    inside = ref.where((F.col(level) - F.col("_p")).between(low, high)).select(*keys, pos)
    runs = S.islands(inside, keys, [pos], [pos], lambda b, r: r[pos] - b[pos] > 1, label="_run")
    found = runs.groupBy(*keys, "_run").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"))
    return found.where((F.col("end") - F.col("start")) * hop_seconds >= least).drop("_run")
