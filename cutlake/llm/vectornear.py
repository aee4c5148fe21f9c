"""Near-duplicate vectors by an epsilon grid order join on leading principal dimensions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutlake.llm import store, vectors
from cutlake.llm.components import smallest_reachable
from cutlake.llm.groups import attach
from cutlake.llm.numbering import numbered

THRESHOLD, LEADING, INTERVAL, FAN, LEAF, ROUNDS = 0.93, 8, 2048, 16, 128, 2
SLACK = 1e-7  # rounding of bounds: a block is skipped or taken whole only beyond it
BAND = 1e-11  # cosines closer to the threshold are summed exactly


def unit_rows(rows: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """``_id, _g, _unit``: the group (length and label) and the packed unit vector; both null where the row links with nothing."""

    def run(batches):
        for batch in batches:
            good, values, bounds = vectors.usable(batch.column(2))
            labels, own_g, own_unit = batch.column(1).to_pylist(), [], []
            for i, ok in enumerate(good.tolist()):
                x = values[bounds[i] : bounds[i + 1]]
                top = np.abs(x).max(initial=0.0) if ok else 0.0
                if not ok or labels[i] is None or top == 0.0:
                    own_g.append(None)
                    own_unit.append(None)
                    continue
                x = x / top
                own_g.append(f"{len(x)}:{labels[i]}")
                own_unit.append((x / math.sqrt(x @ x) + 0.0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own_g, pa.string()), pa.array(own_unit, pa.binary())], names=["_id", "_g", "_unit"])

    picked = rows.select(F.col(id).cast("long").alias("_id"), F.col(label).cast("string").alias("_label"), F.col(vector).alias("_v"))
    return picked.mapInArrow(run, "_id long, _g string, _unit binary")


def principal_axes(units: DataFrame, dims: int, leading: int, rounds: int = ROUNDS) -> np.ndarray:
    """``dims`` x ``leading`` orthonormal columns near the leading principal axes of all vectors of length ``dims``.

    Block power iteration: each round sums ``x (x . Q)`` over the table, a few
    numbers for each dim and task. Bounds from these axes hold whatever their quality.
    """
    k = min(leading, dims)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((dims, k)))[0]
    names = [f"_s{j}" for j in range(k + 1)]
    for _ in range(rounds):

        def sums(batches, q=q):
            total, count = np.zeros((dims + 1, k + 1)), 0
            for batch in batches:
                x = vectors.matrix(batch.column(0).to_pylist())
                if len(x):
                    total[:dims, :k] += x.T @ (x @ q)
                    total[:dims, k] += x.sum(axis=0)
                    count += len(x)
            total[dims, k] = count
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), *(pa.array(c) for c in total.T.copy())], names=["_i", *names])

        parts = units.select("_unit").where(F.octet_length("_unit") == 8 * dims).mapInArrow(sums, ", ".join(["_i long", *(f"{c} double" for c in names)]))
        found = parts.groupBy("_i").agg(*(F.sum(c).alias(c) for c in names)).orderBy("_i").collect()
        if not found:
            break
        total = np.array([r[1:] for r in found], dtype=float)
        mean = total[:dims, k] / max(total[dims, k], 1.0)
        spread = total[:dims, :k] - total[dims, k] * np.outer(mean, mean @ q)
        q = np.linalg.qr(spread)[0] if np.isfinite(spread).all() and np.abs(spread).max(initial=0.0) > 0 else q
    return q


def _project(units: list[bytes], axes: np.ndarray) -> np.ndarray:
    x = vectors.matrix(units)
    n, k = axes.shape
    wide = np.zeros((len(x), n))
    wide[:, : min(n, x.shape[1])] = x[:, :n]
    return wide @ axes


def in_grid_order(classes: DataFrame, axes: np.ndarray, width: float) -> DataFrame:
    """``classes`` with ``_cell``, the grid cell on the leading dimensions."""
    names = classes.columns

    def run(batches):
        for batch in batches:
            cells = np.floor(_project(batch.column(names.index("_unit")).to_pylist(), axes) / width).astype(np.int32)
            flat = pa.array(cells.reshape(-1))
            at = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * axes.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, flat)], names=[*names, "_cell"])

    return classes.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in classes.dtypes), "_cell array<int>"]))


SHAPE = "_node long, _first long, _last long, _gmin string, _gmax string, _w long, _low array<double>, _high array<double>, _centre binary, _radius double"


def _shape(x: np.ndarray, y: np.ndarray) -> tuple:
    """Box on the leading dims and ball of some unit vectors."""
    centre = x.mean(axis=0)
    return y.min(axis=0), y.max(axis=0), centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1).max()))


def interval_shapes(ordered: DataFrame, axes: np.ndarray) -> DataFrame:
    """One row per interval of the sequence: its numbers, groups, weight, box and ball."""

    def run(key, table):
        units = table["_unit"].to_pylist()
        low, high, centre, radius = _shape(vectors.matrix(units), _project(units, axes))
        seq, g = np.asarray(table["_seq"]), table["_g"].to_pylist()
        cells = [[key[0].as_py()], [int(seq.min())], [int(seq.max())], [min(g)], [max(g)], [int(np.asarray(table["_n"]).sum())], [low.tolist()], [high.tolist()], [centre.astype("<f8").tobytes()], [radius]]
        return pa.table(cells, names=[c.split()[0] for c in SHAPE.split(", ")])

    return ordered.groupBy("_interval").applyInArrow(run, SHAPE)


def parent_shapes(shapes: DataFrame, fan: int) -> DataFrame:
    """Shapes of runs of ``fan`` nodes: at most ``fan`` rows meet."""

    def run(key, table):
        centres, radii = vectors.matrix(table["_centre"].to_pylist()), np.asarray(table["_radius"])
        centre = centres.mean(axis=0)
        radius = float((np.sqrt(((centres - centre) ** 2).sum(axis=1)) + radii).max())
        low, high = np.array(table["_low"].to_pylist()).min(axis=0), np.array(table["_high"].to_pylist()).max(axis=0)
        cells = [[key[0].as_py()], [pc.min(table["_first"]).as_py()], [pc.max(table["_last"]).as_py()], [min(table["_gmin"].to_pylist())], [max(table["_gmax"].to_pylist())], [pc.sum(table["_w"]).as_py()], [low.tolist()], [high.tolist()], [centre.astype("<f8").tobytes()], [radius]]
        return pa.table(cells, names=[c.split()[0] for c in SHAPE.split(", ")])

    return shapes.groupBy(F.floor(F.col("_node") / fan).alias("_parent")).applyInArrow(run, SHAPE)


def _judged(pairs: DataFrame, shapes: DataFrame, limit: float) -> DataFrame:
    """Pairs of nodes that may hold links; ``_sure`` where every pair of members, also inside each node, is one."""
    side = lambda s: shapes.select(*(F.col(c).alias(f"{c}{s}") for c in shapes.columns))
    met = pairs.join(side("_a"), F.col("_a") == F.col("_node_a")).join(side("_b"), F.col("_b") == F.col("_node_b"))
    met = met.where((F.col("_gmin_b") <= F.col("_gmax_a")) & (F.col("_gmin_a") <= F.col("_gmax_b")))  # groups are sorted

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            if not batch.num_rows:
                continue
            box = {n: np.array(col[n].to_pylist()) for n in ("_low_a", "_high_a", "_low_b", "_high_b")}
            gap = np.maximum(0, np.maximum(box["_low_a"] - box["_high_b"], box["_low_b"] - box["_high_a"]))
            apart = np.sqrt((gap**2).sum(axis=1))
            ca, cb = vectors.matrix(col["_centre_a"].to_pylist()), vectors.matrix(col["_centre_b"].to_pylist())
            wide = max(ca.shape[1], cb.shape[1])
            off = np.sqrt(((np.pad(ca, ((0, 0), (0, wide - ca.shape[1]))) - np.pad(cb, ((0, 0), (0, wide - cb.shape[1])))) ** 2).sum(axis=1))
            ra, rb = np.asarray(col["_radius_a"]), np.asarray(col["_radius_b"])
            far = np.maximum(apart, off - ra - rb) > limit + SLACK
            one = np.asarray(pc.and_(pc.equal(col["_gmin_a"], col["_gmax_b"]), pc.equal(col["_gmax_a"], col["_gmin_b"])))
            sure = one & (off + 2 * np.maximum(ra, rb) < limit - SLACK)
            out = [*(col[n] for n in ("_a", "_b", "_first_a", "_last_a", "_first_b", "_w_a", "_w_b")), pa.array(sure)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(~far)) for c in out], names=["_a", "_b", "_first_a", "_last_a", "_first_b", "_w_a", "_w_b", "_sure"])

    return met.mapInArrow(run, "_a long, _b long, _first_a long, _last_a long, _first_b long, _w_a long, _w_b long, _sure boolean")


class _Meeting:
    """The members of two intervals (or of one with itself): adds up weights and keeps a spanning forest of links."""

    def __init__(self, units, axes, weights, groups, threshold, leaf):
        self.x, self.y, self.w, self.g = vectors.matrix(units), _project(units, axes), weights, groups
        self.threshold, self.limit, self.leaf = threshold, math.sqrt(max(0.0, 2 - 2 * threshold)), leaf
        self.total, self.tree = np.zeros(len(weights), np.int64), np.arange(len(weights))
        self.links: list[tuple[int, int]] = []
        self.shapes: dict[tuple[int, int], tuple] = {}

    def shape(self, part):
        if part not in self.shapes:
            self.shapes[part] = _shape(self.x[part[0] : part[1]], self.y[part[0] : part[1]])
        return self.shapes[part]

    def join(self, i: int, others: np.ndarray):
        others = others[self.tree[others] != self.tree[i]]
        while len(others):
            self.links.append((i, int(others[0])))
            low, high = sorted((self.tree[i], self.tree[others[0]]))
            self.tree[self.tree == high] = low
            others = others[self.tree[others] != self.tree[i]]

    def meet(self, p, q):
        """Recursive join of the sequence stretches ``p`` and ``q`` (equal, or apart)."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            if p[0] == p[1] or q[0] == q[1] or self.g[q[0]] > self.g[p[1] - 1] or self.g[p[0]] > self.g[q[1] - 1]:
                continue
            (la, ha, ca, ra), (lb, hb, cb, rb) = self.shape(p), self.shape(q)
            off = math.sqrt(((ca - cb) ** 2).sum())
            gap = np.maximum(0, np.maximum(la - hb, lb - ha))
            if max(math.sqrt(gap @ gap), off - ra - rb) > self.limit + SLACK:
                continue
            if self.g[p[0]] == self.g[q[1] - 1] and self.g[q[0]] == self.g[p[1] - 1] and off + 2 * max(ra, rb) < self.limit - SLACK:
                self.total[p[0] : p[1]] += self.w[q[0] : q[1]].sum()
                if p != q:
                    self.total[q[0] : q[1]] += self.w[p[0] : p[1]].sum()
                self.join(p[0], np.arange(p[0], p[1]))
                self.join(p[0], np.arange(q[0], q[1]))
            elif max(p[1] - p[0], q[1] - q[0]) <= self.leaf:
                self.compare(p, q)
            elif p == q:
                mid = (p[0] + p[1]) // 2
                stack += [((p[0], mid), (p[0], mid)), ((p[0], mid), (mid, p[1])), ((mid, p[1]), (mid, p[1]))]
            elif p[1] - p[0] >= q[1] - q[0]:
                mid = (p[0] + p[1]) // 2
                stack += [((p[0], mid), q), ((mid, p[1]), q)]
            else:
                mid = (q[0] + q[1]) // 2
                stack += [(p, (q[0], mid)), (p, (mid, q[1]))]

    def compare(self, p, q):
        a, b = self.x[p[0] : p[1]], self.x[q[0] : q[1]]
        cos = a @ b.T
        same = self.g[p[0] : p[1], None] == self.g[None, q[0] : q[1]]
        near = (cos >= self.threshold) & same
        for i, j in zip(*np.nonzero((np.abs(cos - self.threshold) < BAND) & same)):
            near[i, j] = math.fsum(a[i] * b[j]) / math.sqrt(math.fsum(a[i] * a[i]) * math.fsum(b[j] * b[j])) >= self.threshold
        if p == q:
            np.fill_diagonal(near, True)
        self.total[p[0] : p[1]] += near @ self.w[q[0] : q[1]]
        if p != q:
            self.total[q[0] : q[1]] += self.w[p[0] : p[1]] @ near
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            self.join(p[0] + i, q[0] + np.flatnonzero(near[i]))


def near_vectors(
    rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD,
    leading: int = LEADING, interval: int = INTERVAL, fan: int = FAN, leaf: int = LEAF,
) -> DataFrame:
    """One row per row: ``id, n_links, component_id, kept``.

    Two vectors of one label and one length link if their cosine is ``threshold`` or
    more. ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the smallest id reachable by links, the own one included (null
    ids are never smallest); ``kept`` tells that it is the own id. Vectors that are null, zero or
    empty, hold a null or a non-finite component, or have no label link with nothing.
    Rows that repeat an id are rows of their own, with equal ``kept``. An empty
    table gives no rows. Other columns are ignored, whatever their names.

    Equal vectors are one weighted class. Unit vectors at a cosine of ``threshold`` are
    ``eps`` apart; classes are sorted by their cells of width ``eps`` on the leading
    principal dimensions (group first) and cut into intervals of the sequence.
    Intervals form a tree; from its top, pairs of nodes are split into pairs of children,
    level by level, and left out when box or ball shows them farther apart than
    ``eps``. Nodes so close that all their members link count as a whole. The pairs
    of intervals that remain meet in tasks, where the same recursion goes on to
    stretches of ``leaf`` vectors. No list of pairs is made: a meeting returns
    weights and a spanning forest.
    """
    limit = math.sqrt(max(0.0, 2 - 2 * threshold))
    stored = store.keep(unit_rows(rows, id, vector, label), "units")
    key = F.sha2(F.concat(F.col("_g").cast("binary"), F.lit(b"\0"), "_unit"), 256)
    classes = stored.where("_g is not null").groupBy("_g", "_unit").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    commonest = classes.groupBy(F.octet_length("_unit").alias("_b")).agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), "_b").first()
    axes = principal_axes(stored.where("_g is not null"), (commonest["_b"] if commonest else 8) // 8, leading)
    ordered, n = numbered(in_grid_order(classes, axes, max(limit, 1e-3)), ["_g", "_cell", "_unit"], "_seq")
    ordered = ordered.drop("_cell").withColumn("_interval", F.floor(F.col("_seq") / interval))

    levels, nodes = [store.keep(interval_shapes(ordered, axes), "shapes")], -(-n // interval)
    while nodes > fan:
        levels.append(store.keep(parent_shapes(levels[-1], fan), "shapes"))
        nodes = -(-nodes // fan)
    spark = rows.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in range(nodes) for b in range(a, nodes)], "_a long, _b long")  # at most fan * fan
    added, sure_links = [], []
    for depth in range(len(levels) - 1, -1, -1):
        found = store.keep(_judged(pairs, levels[depth], limit), "node_pairs")
        sure, width = found.where("_sure"), interval * fan**depth
        both = sure.select(F.col("_a").alias("_node"), F.col("_w_b").alias("_plus")).union(sure.where("_a <> _b").select("_b", "_w_a"))
        added.append((width, both.groupBy("_node").agg(F.sum("_plus").alias("_plus"))))
        sure_links.append(sure.where("_a <> _b").select(F.col("_first_a").alias("a"), F.col("_first_b").alias("b")))
        sure_links.append(sure.where("_a = _b").select(F.col("_first_a").alias("a"), F.explode(F.sequence("_first_a", "_last_a")).alias("b")))
        pairs = found.where("not _sure").select("_a", "_b")
        if depth:
            kids = lambda c: F.explode(F.sequence(F.col(c) * fan, F.col(c) * fan + fan - 1))
            pairs = pairs.select(kids("_a").alias("_a"), "_b").select("_a", kids("_b").alias("_b")).where("_a <= _b")

    def meeting(key, table):
        table = table.sort_by("_seq")
        seq, at = np.asarray(table["_seq"]), np.asarray(table["_interval"])
        names = table["_g"].to_pylist()
        rank = {g: i for i, g in enumerate(sorted(set(names)))}
        groups = np.array([rank[g] for g in names])
        own = _Meeting(table["_unit"].to_pylist(), axes, np.asarray(table["_n"]), groups, threshold, leaf)
        cut = int(np.searchsorted(at, at[-1])) if key[0].as_py() != key[1].as_py() else 0
        own.meet((0, cut) if cut else (0, len(seq)), (cut, len(seq)))
        links = np.array(own.links, dtype=np.int64).reshape(-1, 2)
        a, b = np.concatenate([seq, seq[links[:, 0]]]), np.concatenate([own.total, seq[links[:, 1]]])
        return pa.table([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) >= len(seq))], names=["a", "b", "link"])

    sides = pairs.select("_a", "_b", F.col("_a").alias("_at")).union(pairs.where("_a <> _b").select("_a", "_b", "_b"))
    members = ordered.select("_seq", "_g", "_unit", "_n", "_interval").join(sides, F.col("_interval") == F.col("_at")).drop("_at")
    met = store.keep(members.groupBy("_a", "_b").applyInArrow(meeting, "a long, b long, link boolean"), "meetings")

    totals = met.where("not link").groupBy(F.col("a").alias("_s")).agg(F.sum("b").alias("_total"))
    facts = ordered.select("_seq", key.alias("_key"), "_least", "_n").join(totals, F.col("_seq") == F.col("_s"), "left").withColumn("_links", F.coalesce("_total", F.lit(0)))
    for width, plus in added:
        facts = facts.join(plus, F.floor(F.col("_seq") / width) == F.col("_node"), "left").withColumn("_links", F.col("_links") + F.coalesce("_plus", F.lit(0))).drop("_node", "_plus")
    links = met.where("link").select("a", "b")
    for more in sure_links:
        links = links.union(more)
    roots = store.keep(smallest_reachable(links).join(ordered.select("_seq", "_least"), F.col("node") == F.col("_seq")).select("node", "root", "_least"), "members")
    whole = store.keep(roots.groupBy("root").agg(F.min("_least").alias("_lowest"), F.count("*").alias("_classes")), "components")
    linked = attach(roots.select("node", "root"), whole, "root", "_classes", "node")
    facts = facts.join(linked.select("node", "_lowest"), F.col("_seq") == F.col("node"), "left")
    facts = store.keep(facts.select("_key", "_n", (F.col("_links") - 1).alias("_links"), F.coalesce("_lowest", "_least").alias("_component")), "classes")
    out = attach(stored.select("_id", key.alias("_key"), F.monotonically_increasing_id().alias("_spread")), facts, "_key", "_n", "_spread")
    component = F.coalesce("_component", "_id")
    return out.select(F.col("_id").alias(id), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
