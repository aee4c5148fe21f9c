"""Core operators against plain Python on small skewed tables; results must not depend on how work is cut."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cutlake.operators import joins as J
from cutlake.operators import reuse as U
from cutlake.operators import scan as S
from cutlake.operators.nearest import as_of, nearest
from cutlake.operators.quantiles import exact_quantiles
from cutlake.operators.ranges import gap_runs, range_join
from cutlake.operators.spacing import keep_spaced

T0 = datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """One key holds most rows, one is null, values have gaps."""
    rng = random.Random(7)
    rows = []
    for key, n in (("hot", 120), ("b", 9), (None, 11)):
        for i, pos in enumerate(sorted(rng.sample(range(500), n))):
            rows.append((key, pos, i, None if rng.random() < 0.4 else rng.randint(0, 50)))
    return rows, spark.createDataFrame(rows, "k string, pos long, id long, v long").repartition(5).cache()


@pytest.mark.parametrize("width", [3, 40, 10_000])
def test_scan_matches_plain_fold(series, width):
    rows, df = series
    out = S.scan(
        df, ["k"], ["pos"], width, p=S.prev("v"), n=S.following("v"), l=S.last_known("v"), f=S.next_known("v"), s=S.running_sum("v"), mx=S.running_max("v"),
        mn=S.running_min("v"), bx=S.max_before("v"), rx=S.remaining_max("v"), tot=S.total("v"), i=S.position(),
    )
    got = {(r.k, r.pos): (r.p, r.n, r.l, r.f, r.s, r.mx, r.mn, r.bx, r.rx, r.tot, r.i) for r in out.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        vs = sorted((r[1], r[3]) for r in rows if r[0] == key)
        known = lambda xs: [x for x in xs if x is not None]
        top = lambda xs, fn: fn(known(xs)) if known(xs) else None
        values = [v for _, v in vs]
        for i, (pos, _) in enumerate(vs):
            upto, on = values[: i + 1], values[i:]
            want[(key, pos)] = (
                values[i - 1] if i else None, values[i + 1] if i + 1 < len(vs) else None, (known(upto) or [None])[-1], (known(on) or [None])[0],
                top(upto, sum), top(upto, max), top(upto, min), top(values[:i], max), top(on, max), top(values, sum), i + 1,
            )
    assert got == want


@pytest.mark.parametrize("width", [4, 60, 10_000])
def test_islands_cross_chunks(series, width):
    rows, df = series
    out = S.islands(df, ["k"], ["pos"], ["pos"], lambda b, r: r["pos"] - b["pos"] > 6, width)
    got = {(r.k, r.pos): r.island.pos for r in out.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        start = last = None
        for pos in sorted(r[1] for r in rows if r[0] == key):
            start = pos if last is None or pos - last > 6 else start
            want[(key, pos)], last = start, pos
    assert got == want


@pytest.mark.parametrize("stretch", [1, 5, 4096])
def test_spacing_does_not_depend_on_the_stretch(spark, stretch):
    rng = random.Random(3)
    rows, want = [], set()
    for key, part, n, span in (("hot", None, 400, 40_000), ("b", 1, 30, 90_000), (None, 2, 25, 4_000)):
        seconds = sorted(rng.randint(0, span) for _ in range(n))
        last = None
        for i, s in enumerate(seconds):
            ident = len(rows)
            rows.append((key, part, T0 + timedelta(seconds=s), ident))
            if last is None or s - last > 90:
                want.add(ident)
                last = s
    df = spark.createDataFrame(rows, "k string, part int, ts timestamp, id long").repartition(4)
    out = keep_spaced(df, ["k", "part"], "ts", ["id"], 90_000_000, stretch=stretch)
    assert {r.id for r in out.collect()} == want
    assert out.columns == df.columns


@pytest.mark.parametrize("stretch,fan,levels", [(2, 1024, 1), (3, 7, 3), (1, 2, 2)])
def test_spacing_of_one_key_with_a_hundred_thousand_stretches(spark, stretch, fan, levels):
    n = 300_000 if levels == 1 else 6_000
    us = "id * 700000 + pmod(xxhash64(id), 500000) + if(id % 97 = 0, 400000, 0)"
    df = spark.range(n).select("id", F.lit("one").alias("k"), F.expr(f"timestamp_micros({us})").alias("ts"), F.expr(us).alias("us"))
    want, last = [], None
    for t, i in sorted((r.us, r.id) for r in df.select("us", "id").collect()):
        if last is None or t - last > 1_000_000:
            want.append(i)
            last = t
    got = keep_spaced(df, ["k"], "ts", ["id"], 1_000_000, stretch=stretch, fan=fan, levels=levels)
    assert sorted(r.id for r in got.select("id").collect()) == sorted(want)


@pytest.mark.parametrize("width,salt", [(2.0, 1), (7.0, 3), (1000.0, 1)])
def test_range_join_is_exact_for_any_width(spark, width, salt):
    rng = random.Random(5)
    make = lambda n, k: [(rng.choice("aab"), i, float(s := rng.randint(0, 60)), float(s + rng.choice([0, 0, 1, 5, 40]))) for i in range(n)]
    a, b = make(60, 0), make(50, 1)
    left = spark.createDataFrame(a, "k string, i int, lo double, hi double")
    right = spark.createDataFrame(b, "k string, j int, s double, e double")
    got = sorted((r.i, r.j) for r in range_join(left, right, ["k"], ("lo", "hi"), ("s", "e"), width, salt).collect())

    def touch(lo, hi, s, e):
        if lo >= hi:
            return s <= lo < e
        return lo <= s < hi if s >= e else lo < e and s < hi

    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and touch(x[2], x[3], y[2], y[3]))
    assert got == want


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    data = {"hot": np.round(rng.normal(0, 50, 901), 2), "few": np.array([3.0, -1.0]), "one": np.array([5.0])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    for r in exact_quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.5, "c": 0.95}).collect():
        assert r.n == len(data[r.k])
        assert [r.a, r.b, r.c] == pytest.approx([np.quantile(data[r.k], q) for q in (0.25, 0.5, 0.95)])


@pytest.mark.parametrize("width", [3, 500])
def test_nearest_and_as_of(spark, width):
    cuts = spark.createDataFrame([("a", 10), ("a", 15), ("a", 1), ("b", 4)], "k string, frame long")
    onsets = spark.createDataFrame([("a", 5), ("a", 20), ("a", 12)], "k string, frame long")
    got = {(r.k, r.frame): (r.nearest, r.distance) for r in nearest(cuts, onsets, ["k"], "frame", "frame", width).collect()}
    assert got == {("a", 10): (12, 2), ("a", 15): (12, 3), ("a", 1): (5, 4), ("b", 4): (None, None)}
    tie = nearest(spark.createDataFrame([("a", 16)], "k string, frame long"), onsets, ["k"], "frame", "frame", width).first()
    assert (tie.nearest, tie.distance) == (12, 4)
    marked = onsets.withColumn("v", F.col("frame") * 10)
    held = {(r.k, r.frame): r.v for r in as_of(cuts, marked, ["k"], "frame", "frame", ["v"], width, prefix="").select("k", F.col("frame"), "v").collect()}
    assert held == {("a", 10): 50, ("a", 15): 120, ("a", 1): None, ("b", 4): None}


def test_gap_runs_merge(spark):
    spans = spark.createDataFrame([("a", 0, 3), ("a", 2, 5), ("a", 8, 9), ("a", 9, 10), ("a", -4, 0)], "k string, s long, e long")
    clocks = spark.createDataFrame([("a", 12), ("b", 2)], "k string, n long")
    got = sorted((r.k, r.lo, r.hi) for r in gap_runs(spans, clocks, ["k"], "s", "e", "n", 2).collect())
    assert got == [("a", 5, 8), ("a", 10, 12), ("b", 0, 2)]


def test_stack_slots(spark):
    rng = random.Random(11)
    rows = [("x", i, s := rng.randint(0, 300), s + rng.randint(1, 30)) for i in range(150)]
    df = spark.createDataFrame(rows, "asset string, id long, start_frame long, end_frame long")
    want, placed = {}, []
    for _, i, s, e in sorted(rows, key=lambda r: (r[2], r[1])):
        taken = {slot for slot, ps, pe in placed if s < pe and ps < e}
        slot = next(n for n in range(999) if n not in taken)
        placed.append((slot, s, e))
        want[i] = slot
    for parts in (1, 5):
        assert {r.id: r.slot for r in J.stack_slots(df.repartition(parts)).collect()} == want


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (12, 16))
    data = np.vstack([base, base[:6] + rng.normal(0, 0.01, (6, 16)), base[:2]])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, v array<double>")
    got = {(r.a, r.b): round(r.distance, 9) for r in U.frame_distance_pairs(df, "id", "v", 0.05, 16, block=3).collect()}
    want = {(i, j): round(float(np.abs(data[i] - data[j]).mean()), 9) for i in range(18) for j in range(i + 1, 18) if np.abs(data[i] - data[j]).mean() <= 0.05}
    assert got == want and want


def test_top_k_keeps_ties_in_order(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 7), ("b", 4, 1)], "k string, id int, v int")
    got = sorted((r.k, r.id, r["rank"]) for r in S.top_k_per(df, ["k"], [F.col("v").desc(), F.col("id")], 2).collect())
    assert got == [("a", 1, 2), ("a", 3, 1), ("b", 4, 1)]


