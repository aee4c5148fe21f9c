"""Luma, contrast and hue arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rec.709 luma weights.
WEIGHTS = (0.2126, 0.7152, 0.0722)


def _dot(values: list[Column]) -> Column:
    r, g, b = (v * w for v, w in zip(values, WEIGHTS))
    return r + g + b


def luma(r: Column, g: Column, b: Column) -> Column:
    return _dot([r.cast("double"), g.cast("double"), b.cast("double")])


def michelson(a: Column, b: Column) -> Column:
    high, low = F.greatest(a, b), F.least(a, b)
    return (high - low) / F.greatest(high + low, F.lit(1e-6))


def _linear(level: Column) -> Column:
    value = level / 255.0
    return F.when(value <= 0.04045, value / 12.92).otherwise(F.pow((value + 0.055) / 1.055, F.lit(2.4)))


def relative_luminance(r: Column, g: Column, b: Column) -> Column:
    """WCAG relative luminance of an 8-bit sRGB triple."""
    return _dot([_linear(c.cast("double")) for c in (r, g, b)])


def contrast_of(a: Column, b: Column) -> Column:
    """WCAG ratio of two relative luminances."""
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def contrast_from_luma(a: Column, b: Column) -> Column:
    """WCAG ratio of two luma levels read as neutral greys."""
    level = lambda c: _linear(F.least(F.lit(255.0), F.greatest(F.lit(0.0), c)))
    return contrast_of(level(a), level(b))


def delivered_luma(value: Column, alpha: Column, core: Column) -> Column:
    """Luma a fill shows on a surface through a plate of opacity ``alpha``."""
    a = F.coalesce(alpha, F.lit(1.0))
    return F.when(a >= 1.0, value).otherwise(a * value + (1.0 - a) * F.coalesce(core, value))


def worst_over_surfaces(value: Column, surfaces: Column, measure: str = "michelson") -> Column:
    """Least contrast of a fill over ``array<struct<alpha, core, ring>>``."""
    rules = {"michelson": michelson, "separation": lambda a, b: F.abs(a - b), "ratio": contrast_from_luma}
    rule = rules[measure]
    return F.array_min(F.transform(surfaces, lambda s: rule(delivered_luma(value, s["alpha"], s["core"]), s["ring"])))


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def bounded_grade(source: dict[str, Column], target: dict[str, Column]) -> Column:
    """Struct of exposure stops, contrast and saturation, each clamped. Keys: y_q10, y_q50, y_q90, saturation."""
    tiny = lambda c: F.greatest(c, F.lit(1e-4))
    exposure = _clamp(F.log2(tiny(target["y_q50"]) / tiny(source["y_q50"])), -1.5, 1.0)
    spread = lambda m: tiny(m["y_q90"] - m["y_q10"])
    contrast = _clamp(spread(target) / spread(source), 0.75, 1.30)
    saturation = _clamp(tiny(target["saturation"]) / tiny(source["saturation"]), 0.75, 1.30)
    return F.struct(
        F.round(exposure, 4).alias("exposure_stops"), F.round(contrast, 4).alias("contrast"), F.round(saturation, 4).alias("saturation")
    )


def hue_delta(a: Column, b: Column) -> Column:
    """Signed shortest angle from a to b; NaN when either is unknown."""
    unknown = a.isNull() | b.isNull() | F.isnan(a) | F.isnan(b)
    return F.when(unknown, F.lit(float("nan"))).otherwise(F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0)


def circular_mean(degrees: Column, digits: int = 9) -> Column:
    """Aggregate: vector mean of angles in [0, 360); NaN when the vectors cancel or none is given."""
    known = F.when(~F.isnan(degrees), F.radians(degrees))
    s = F.coalesce(F.sum(F.round(F.sin(known), 12)), F.lit(0.0))
    c = F.coalesce(F.sum(F.round(F.cos(known), 12)), F.lit(0.0))
    cancelled = (F.abs(s) < 10.0 ** -digits) & (F.abs(c) < 10.0 ** -digits)
    return F.when(cancelled, F.lit(float("nan"))).otherwise(F.pmod(F.degrees(F.atan2(s, c)), F.lit(360.0)))


def grade_reliable(percentiles: list[Column], p99: Column, p01: Column) -> Column:
    """Reason text: ``ok``, missing percentiles, or a flat frame."""
    bad = F.lit(False)
    for p in percentiles:
        bad = bad | p.isNull() | F.isnan(p)
    flat = p99 - p01 < 0.06
    return F.when(bad, "NaN in percentiles").when(flat, "flat frame").otherwise("ok")


def mood_adjust(cand_l: Column, cand_s: Column, ref_l: Column, ref_s: Column) -> Column:
    """Struct of brightness, saturation and gamma that moves a clip 70 % toward a reference's mood."""
    bright = _clamp((ref_l - cand_l) / 255.0 * 0.70, -0.22, 0.18)
    sat = _clamp(F.when(cand_s > 1, 1.0 + (ref_s / cand_s - 1.0) * 0.70).otherwise(1.0), 0.80, 1.50)
    gamma = F.when(ref_l - cand_l < -25, 0.95).otherwise(1.0)
    return F.struct(F.round(bright, 3).alias("brightness"), F.round(sat, 3).alias("saturation"), gamma.alias("gamma"))
