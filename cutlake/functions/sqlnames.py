"""SQL names for the functions a SQL user would call."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_LINEAR = "CASE WHEN {0} / 255D <= 0.04045D THEN {0} / 255D / 12.92D ELSE power(({0} / 255D + 0.055D) / 1.055D, 2.4D) END"
_REL = " + ".join(f"{w}D * ({_LINEAR.format(ch)})" for w, ch in ((0.2126, "r"), (0.7152, "g"), (0.0722, "b")))

SCALAR = {
    "cl_luma(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS DOUBLE": "0.2126D * r + 0.7152D * g + 0.0722D * b",
    "cl_michelson(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "abs(a - b) / greatest(a + b, 1e-6D)",
    "cl_relative_luminance(r DOUBLE, g DOUBLE, b DOUBLE) RETURNS DOUBLE": _REL,
    "cl_contrast(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "(greatest(a, b) + 0.05D) / (least(a, b) + 0.05D)",
    "cl_hue_delta(a DOUBLE, b DOUBLE) RETURNS DOUBLE": "pmod(b - a + 180D, 360D) - 180D",
}
TABLE = {
    "cl_blocks_from_cuts(frames BIGINT, cuts ARRAY<BIGINT>) RETURNS TABLE(block_id STRING, start_frame BIGINT, end_frame BIGINT)": """
        SELECT concat('p', CASE WHEN i < 999 THEN lpad(string(i + 1), 3, '0') ELSE string(i + 1) END),
          CASE WHEN i = 0 THEN 0 ELSE ends[i - 1] + 1 END, e + 1
        FROM (SELECT array_sort(array_union(cuts, array(frames - 1))) AS ends) LATERAL VIEW posexplode(ends) x AS i, e""",
    "cl_call_cards(doc STRING) RETURNS TABLE(card INT, call_id STRING, body STRING)": r"""
        SELECT i, regexp_extract(b, r'(?m)^[ \t]*call_id:[ \t]*(\S+)', 1), b
        FROM (SELECT slice(split(doc, r'(?m)^[ \t]*CALL_REQUIRED[ \t]*$'), 2, 1000000) AS bs) LATERAL VIEW posexplode(bs) x AS i, raw
        LATERAL VIEW explode(array(split(raw, r'(?m)^[ \t]*```[ \t]*$', 2)[0])) y AS b
        WHERE b RLIKE r'(?m)^[ \t]*call_id:[ \t]*\S'""",
}

_HIGH = "(x * 134217729D - (x * 134217729D - x))"
_ERROR = f"(({_HIGH} * 100D - x * 100D) + (x - {_HIGH}) * 100D)"
_OVER = "((x * 100D - floor(x * 100D)) - 0.5D)"
_N = "int(greatest(2, rint(d / 5D)))"
_ROUND2 = (
    f"CASE WHEN {_OVER} > -{_ERROR} OR ({_OVER} = -{_ERROR} AND pmod(floor(x * 100D), 2) = 1) "
    "THEN double(floor(x * 100D)) + 1D ELSE double(floor(x * 100D)) END / 100D"
)


def _exact(term: str) -> str:
    """Hundredths by the double's exact value, halves to even; see timecode.round_exact."""
    return re.sub(r"\bx\b", f"({term})", _ROUND2)


SEGMENTS = {
    "cl_segments(d DOUBLE) RETURNS ARRAY<STRUCT<t0: DOUBLE, t1: DOUBLE>>": f"""
        CASE WHEN d IS NULL OR isnan(d) OR d <= 0 OR d = double('infinity') THEN array()
        WHEN d <= 7 THEN array(named_struct('t0', 0D, 't1', d))
        ELSE transform(sequence(1, {_N}), i -> named_struct(
          't0', CASE WHEN i = 1 THEN 0D ELSE {_exact('(i - 1) * d / ' + _N)} END,
          't1', CASE WHEN i = {_N} THEN d ELSE {_exact('i * d / ' + _N)} END)) END""",
}


def register(spark: SparkSession) -> None:
    """Register the ``cl_`` functions in a session.

    All but text normalisation are SQL expressions, so they stay inside the
    plan; normalisation has no SQL equivalent and runs on Arrow batches.
    """
    from cutlake.functions.text import whole_normal_form

    spark.udf.register("cl_normalize_text", whole_normal_form)
    for head, body in {**SCALAR, **TABLE, **SEGMENTS}.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
