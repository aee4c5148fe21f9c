"""Vector operators against plain versions and on awkward rows."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cutlake.llm import negatives, vectornear
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<double>, label int, _id string, _g int, _seq string, rank string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, l, "x", 1, "s", "r") for i, v, l in rows], SCHEMA).repartition(parts)


def clustered(seed: int, n: int, dims: int = 24, labels: int = 3, hot: int = 120):
    """Random vectors with chains of near ones, copies, and one tight cluster of ``hot`` different vectors."""
    rng, rows, out = np.random.default_rng(seed), [], []
    centre = rng.standard_normal(dims)
    for i in range(n):
        base = centre if i < hot else rows[rng.integers(len(rows))] if i % 3 == 0 else rng.standard_normal(dims)
        rows.append(base + rng.standard_normal(dims) * (0.04 if i < hot else 0.3 if i % 3 == 0 else 0.0))
        if i % 7 == 0:
            rows[-1] = rows[rng.integers(len(rows))]
    ids = random.Random(seed).sample(range(10 * n), n)
    for i, (k, v) in enumerate(zip(ids, rows)):
        out.append((k, [float(x) for x in v], 0 if i < hot else int(rng.integers(labels))))
    return out


AWKWARD = [
    (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, math.nan], 1), (6, [math.inf, 1.0], 1), (7, [1.0, 1.0], None),
    (8, [1.0, 1.0], 1), (9, [2.0, 2.0], 1), (9, [2.0, 2.0], 1), (10, [1.0, 1.0, 0.0], 1), (11, [-1.0, -1.0], 1), (12, [1.0, 1.0], 2), (None, [3.0, 3.1], 1), (13, [1e200, 1e200], 1), (14, [-0.0, 1.0], 2), (15, [0.0, 1.0], 2),
]


@pytest.mark.parametrize("interval,leaf,fan", [(2048, 128, 16), (24, 4, 3)])
def test_near_vectors(spark, interval, leaf, fan):
    rows = clustered(interval, 420)
    got = vectornear.near_vectors(frame(spark, rows), interval=interval, leaf=leaf, fan=fan).collect()
    links, least = brute.near_vectors(rows)
    assert max(links) >= 120 and sum(x > 0 for x in links) > 200
    assert sorted(map(tuple, got)) == sorted((i, n, c, i == c) for (i, _, _), n, c in zip(rows, links, least))


def test_near_vectors_awkward(spark):
    got = vectornear.near_vectors(frame(spark, AWKWARD)).collect()
    links, least = brute.near_vectors(AWKWARD)
    want = sorted(((i, n, i if c is None else c) for (i, _, _), n, c in zip(AWKWARD, links, least)), key=repr)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == want
    assert {r.vec_id: r.n_links for r in got}[8] == 4 and {r.vec_id: r.n_links for r in got}[15] == 1
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert vectornear.near_vectors(frame(spark, AWKWARD).where("vec_id > 99")).collect() == []
    assert vectornear.near_vectors(frame(spark, AWKWARD[:7])).select("n_links").distinct().collect() == [(0,)]


def test_many_near_vectors_make_few_rows(spark):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(32)
    rows = [(i, [float(x) for x in centre + 0.02 * rng.standard_normal(32)], 1) for i in range(3000)]
    got = vectornear.near_vectors(frame(spark, rows, 8), interval=64).agg({"n_links": "min", "component_id": "max"}).first()
    assert tuple(got) == (0, 2999) or set(got) == {0, 2999}


@pytest.mark.parametrize("row_block,anchor_block", [(4096, 1024), (50, 7)])
def test_hard_negatives(spark, row_block, anchor_block):
    rows = [(i, [round(x, 2) for x in v], l) for i, v, l in clustered(3, 300, dims=20, hot=40)] + AWKWARD[:7] + [(None, [0.5] * 20, 1), (50, [], 1), (100, [0.5] * 5, 2)]
    frame_ = frame(spark, rows)
    got = negatives.hard_negatives(frame_, anchor=frame_["vec_id"] % 5 == 0, row_block=row_block, anchor_block=anchor_block).collect()
    want = brute.hard_negatives(rows, lambda i: i is not None and i % 5 == 0)
    assert len(want) > 100 and sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_hard_negatives_edges(spark):
    none = frame(spark, AWKWARD).where("vec_id > 99")
    assert negatives.hard_negatives(none, anchor=none["vec_id"] % 5 == 0).collect() == []
    big = [(0, [3e4, -2e4], 1), (5, [3e4, -2e4], 1), (6, [1.5e4, -1.6e4], 2), (7, [1.5e4, -1.6e4], 2)]
    frame_ = frame(spark, big)
    got = negatives.hard_negatives(frame_, anchor=frame_["vec_id"] == 0).collect()
    assert sorted(map(tuple, got)) == sorted(brute.hard_negatives(big, lambda i: i == 0)) and [r.negative_id for r in sorted(got, key=lambda r: r.rank)] == [6, 7]
    with pytest.raises(Exception, match="64 bits|64-bit"):
        negatives.hard_negatives(frame(spark, [(0, [1e30], 1), (1, [1.0], 2)])).collect()


@pytest.mark.parametrize("planes,most", [(1, 1), (9, 256), (20, 1 << 18)])
def test_scores_are_inner_products(planes, most):
    rng = np.random.default_rng(planes)
    low = -(1 << (planes - 1))
    rows, anchors = rng.integers(low, -low, (70, 16)), rng.integers(-most, most + 1, (9, 16))
    tables = negatives.subset_sums(anchors, np.int64)
    got = negatives.scores(tables, negatives.pack(rows, planes).transpose(1, 2, 0).astype(np.intp), np.int64)
    assert (got == rows @ anchors.T).all()
