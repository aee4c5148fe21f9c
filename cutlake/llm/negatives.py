"""Hard negatives by exact integer scores: subset-sum tables of the anchors, indexed with the candidates' bit planes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutlake.llm import store, vectors
from cutlake.llm.numbering import numbered

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
ROW_BLOCK, ANCHOR_BLOCK = 4096, 1024
ROW_TILE, ANCHOR_TILE = 2048, 128
LIMIT = 1 << 55
_FAR = np.iinfo(np.int64).max


def quantised(rows: DataFrame, id: str, vector: str, label: str, anchor: Column, scale: int) -> DataFrame:
    """``_id, _label, _anchor, _ints`` (signed 64-bit components as bytes), ``_most`` (the largest magnitude), ``_dims`` of the rows that take part."""

    def run(batches):
        for batch in batches:
            good, values, bounds = vectors.usable(batch.column(3))
            good &= np.asarray(pc.is_valid(batch.column(1)))
            whole = np.floor(float(scale) * values)
            out, most, dims = [], [], []
            for i in np.flatnonzero(good).tolist():
                own = whole[bounds[i] : bounds[i + 1]]
                peak = float(np.abs(own).max(initial=0.0))
                if peak >= LIMIT:
                    raise ValueError("a scaled component does not fit the 64-bit scores")
                out.append(own.astype("<i8").tobytes())
                most.append(int(peak))
                dims.append(len(own))
            left = batch.select([0, 1, 2]).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*left.columns, pa.array(out, pa.binary()), pa.array(most, pa.int64()), pa.array(dims, pa.int64())], names=["_id", "_label", "_anchor", "_ints", "_most", "_dims"])

    picked = rows.select(F.col(id).cast("long").alias("_id"), F.col(label).cast("string").alias("_label"), F.coalesce(anchor, F.lit(False)).alias("_anchor"), F.col(vector).alias("_v"))
    return picked.mapInArrow(run, "_id long, _label string, _anchor boolean, _ints binary, _most long, _dims long")


def pack(ints: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of two's complement numbers (rows x dims) as bytes: rows x planes x groups of eight dims."""
    wide = np.zeros((len(ints), -(-ints.shape[1] // 8) * 8), dtype=np.int64)
    wide[:, : ints.shape[1]] = ints
    return np.stack([np.packbits((wide >> p & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes)], axis=1)


def subset_sums(anchors: np.ndarray, kind) -> np.ndarray:
    """``out[g, m, a]``: the sum of anchor ``a``'s components of group ``g`` whose bit is set in ``m``."""
    n, dims = anchors.shape
    out = np.zeros((dims // 8, 256, n), dtype=kind)
    for g in range(dims // 8):
        for bit in range(8):
            out[g, 1 << bit : 2 << bit] = out[g, : 1 << bit] + anchors[:, g * 8 + bit].astype(kind)
    return out


def scores(tables: np.ndarray, planes: np.ndarray, kind) -> np.ndarray:
    """Inner products, rows x anchors: per plane the looked-up sums of all groups, shifted and added from the sign plane down.

    ``planes`` is planes x groups x rows.
    """
    total = np.zeros((planes.shape[2], tables.shape[2]), dtype=kind)
    part, held = np.empty(total.shape, tables.dtype), np.empty(total.shape, tables.dtype)
    for p in range(len(planes) - 1, -1, -1):
        part[:] = 0
        for g in range(len(tables)):
            np.take(tables[g], planes[p, g], axis=0, out=held, mode="clip")
            part += held
        total += total
        if p == len(planes) - 1:
            total -= part
        else:
            total += part
    return total


class _Side:
    """The rows of one block as matrices; ``planes`` says how many bit planes a row's bytes hold (none: components)."""

    def __init__(self, table: pa.Table, planes: int = 0):
        self.uid = np.asarray(table["_uid"])
        self.id = np.asarray(pc.fill_null(table["_id"], _FAR))
        self.known = np.asarray(pc.is_valid(table["_id"]))
        self.label = table["_label"].combine_chunks()
        own = table["_planes" if planes else "_ints"].to_pylist()
        width = max((len(x) for x in own), default=0)
        if planes:
            groups, self.data = width // planes, np.zeros((len(own), planes, width // planes), np.uint8)
            for i, x in enumerate(own):
                part = np.frombuffer(x, np.uint8).reshape(planes, -1)
                self.data[i, :, : part.shape[1]] = part
            self.dims = groups * 8
        else:
            self.dims = -(-width // 64) * 8
            self.data = np.zeros((len(own), self.dims), np.int64)
            for i, x in enumerate(own):
                self.data[i, : len(x) // 8] = np.frombuffer(x, "<i8")


def _tiles(anchors: _Side, rows: _Side, a: np.ndarray, r: np.ndarray, most: int, planes: int):
    """``(anchor places, row places, scores)`` of the given places, tile by tile."""
    dims = min(anchors.dims, rows.dims)  # a shorter vector is zero in its missing dims
    sums = np.int16 if most * dims < 1 << 15 else np.int32 if most * dims < 1 << 31 else np.int64
    kind = np.int32 if most * dims << planes < 1 << 31 else np.int64
    for x in range(0, len(a), ANCHOR_TILE):
        own = a[x : x + ANCHOR_TILE]
        tables = subset_sums(anchors.data[own, :dims], sums)
        for y in range(0, len(r), ROW_TILE):
            part = r[y : y + ROW_TILE]
            yield own, part, scores(tables, rows.data[part, :, : dims // 8].transpose(1, 2, 0).astype(np.intp), kind)


class _Best:
    """The ``k`` best rows of each key: higher scores first, then smaller ids; null ids come last."""

    def __init__(self, keys: int, k: int):
        self.k, self.floor, self.waiting = k, np.full(keys, np.iinfo(np.int64).min), 0
        self.held = [np.zeros(0, np.int64) for _ in range(4)]
        self.more: list[list[np.ndarray]] = []

    def add(self, key, score, id, uid):
        self.more.append([key, score.astype(np.int64), id, uid])
        self.waiting += len(key)
        if self.waiting > 1 << 18:
            self.trim()

    def trim(self):
        key, score, id, uid = (np.concatenate(x) for x in zip(self.held, *self.more))
        order = np.lexsort((uid, id, -score, key))
        key, score, id, uid = key[order], score[order], id[order], uid[order]
        first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        last = rank == self.k - 1
        self.floor[key[last]] = score[last]
        self.held = [x[rank < self.k] for x in (key, score, id, uid)]
        self.more, self.waiting = [], 0
        return self.held


def _codes(anchors: _Side, rows: _Side) -> tuple[np.ndarray, np.ndarray]:
    both = pa.chunked_array([anchors.label.cast(pa.string()), rows.label.cast(pa.string())]).combine_chunks().dictionary_encode()
    codes = np.asarray(both.indices)
    return codes[: len(anchors.uid)], codes[len(anchors.uid) :]


def _cells(rows: DataFrame, anchors: DataFrame, run, schema: str) -> DataFrame:
    return rows.groupBy("_rb", "_ab").cogroup(anchors.groupBy("_rb", "_ab")).applyInArrow(run, schema)


def _leading(df: DataFrame, keys: list[str], score: str, id: str, k: int, name: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(id), "_u"))
    return df.withColumn(name, place.cast("int")).where(F.col(name) <= k)


def hard_negatives(
    rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", anchor: Column | None = None, positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component ``x`` counts as ``floor(scale * x)``; a score is the exact integer
    inner product. Rows for which ``anchor`` holds (a row of which it is null is none; without it every
    row) get their ``positives`` best other rows of the same label and, for each of
    these, the ``negatives`` best rows of another label with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``.
    Higher scores come first, ties by smaller id (an integer), null ids last.

    Rows with a null label, a null vector or any null or non-finite component take no
    part. An empty vector scores 0; a shorter vector is zero in the dims it lacks.
    Rows that repeat an id are rows of their own, copies of an anchor are its positives.
    Components so large that a score could pass 2**55 are an error. An empty table
    gives no rows. Other columns are ignored, whatever their names.

    Anchors and rows are dealt to blocks, and blocks meet in cells of bounded size:
    first those that share a label, for the positives, then all, for the negatives.
    In a cell, tables hold the sums of every subset of eight anchor components;
    the packed bit planes of a row index them. A cell returns its best rows only.
    """
    anchor = F.lit(True) if anchor is None else anchor
    dealt = quantised(rows, id, vector, label, anchor, scale).withColumn("_salt", F.monotonically_increasing_id())
    uid, n = numbered(dealt, ["_label", "_salt"], "_uid")
    uid = uid.withColumn("_rb", F.floor(F.col("_uid") / row_block)).drop("_salt")
    most, dims = uid.agg(F.max("_most"), F.max("_dims")).first()
    most, dims = most or 0, dims or 0
    planes = max(1, int(most).bit_length() + 1)
    if (int(most) << planes) * dims >= LIMIT:
        raise ValueError("scores of these components may not fit 64 bits")
    chosen, n_anchors = numbered(uid.where("_anchor").select("_uid", "_id", "_label", "_ints"), ["_uid"], "_ano")
    chosen = chosen.withColumn("_ab", F.floor(F.col("_ano") / anchor_block))

    def packed(batches):
        for batch in batches:
            out = [pack(np.frombuffer(x, "<i8")[None], planes).tobytes() for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], names=["_uid", "_id", "_label", "_rb", "_planes"])

    slim = uid.select("_uid", "_id", "_label", "_rb", "_ints").mapInArrow(packed, "_uid long, _id long, _label string, _rb long, _planes binary")
    slim = store.keep(slim, "planes")

    def same_label(right, left):
        names = ["_a", "_score", "_i", "_u"]
        if not right.num_rows or not left.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        a, r = _Side(left), _Side(right, planes)
        mine, theirs = _codes(a, r)
        best = _Best(len(a.uid), positives)
        for code in np.intersect1d(mine, theirs).tolist():
            for own, part, s in _tiles(a, r, np.flatnonzero(mine == code), np.flatnonzero(theirs == code), most, planes):
                at, to = np.nonzero((s >= best.floor[own]) & (r.uid[part][:, None] != a.uid[own]))
                best.add(own[to], s[at, to], r.id[part[at]], r.uid[part[at]])
            best.trim()
        key, score, i, u = best.trim()
        return pa.table([pa.array(a.uid[key]), pa.array(score), pa.array(i, mask=i == _FAR), pa.array(u)], names=names)

    shared = slim.select("_rb", "_label").distinct().join(chosen.select("_ab", "_label").distinct(), "_label").select("_rb", "_ab").distinct()
    shared = store.keep(shared, "label_cells")
    near = _cells(slim.join(shared, "_rb"), chosen.drop("_ano").join(shared, "_ab"), same_label, "_a long, _score long, _i long, _u long")
    near = _leading(near, ["_a"], "_score", "_i", positives, "_slot")
    near = near.groupBy("_a").agg(F.array_sort(F.collect_list(F.struct("_slot", "_score", "_i"))).alias("_p"))
    mined = chosen.drop("_ano").join(near, F.col("_uid") == F.col("_a")).select(*(c for c in chosen.columns if c != "_ano"), F.col("_p._score").alias("_ps"), F.col("_p._i").alias("_pi"))
    mined = store.keep(mined, "anchors")

    def other_label(right, left):
        a, r = _Side(left), _Side(right, planes)
        mine, theirs = _codes(a, r)
        held = left["_ps"].to_pylist()
        ps = np.full((len(held), positives), -1, np.int64)
        for i, x in enumerate(held):
            ps[i, : len(x)] = x
        least, top = np.where(ps < 0, _FAR, -(-low * ps // 100)), high * ps // 100
        best = _Best(ps.size, negatives)
        every = np.arange(len(r.uid))
        for own, part, s in _tiles(a, r, np.arange(len(a.uid)), every, most, planes):
            floor = np.maximum(least, best.floor.reshape(ps.shape))[own]
            at, to = np.nonzero((s >= floor.min(axis=1)) & (mine[own] != theirs[part][:, None]))
            score = s[at, to].astype(np.int64)
            for slot in range(positives):
                ok = (score >= floor[to, slot]) & (score <= top[own[to], slot])
                where = part[at[ok]]
                best.add(own[to[ok]] * positives + slot, score[ok], r.id[where], r.uid[where])
            best.trim()
        key, score, i, u = best.trim()
        anchor_at, slot = key // positives, key % positives
        pi = left["_pi"].to_pylist()
        positive = pa.array([pi[x][y] for x, y in zip(anchor_at.tolist(), slot.tolist())], pa.int64())
        return pa.table(
            [pa.array(a.uid[anchor_at]), pa.array(slot.astype(np.int32)), pa.array(a.id[anchor_at], mask=~a.known[anchor_at]), positive, pa.array(ps[anchor_at, slot]), pa.array(i, mask=i == _FAR), pa.array(score), pa.array(u)],
            names=["_a", "_slot", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score", "_u"],
        )

    def guarded(right, left):
        if right.num_rows and left.num_rows:
            return other_label(right, left)
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
        return pa.table([pa.array([], k) for k in kinds], names=["_a", "_slot", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score", "_u"])

    row_blocks, anchor_blocks = max(1, -(-n // row_block)), max(1, -(-n_anchors // anchor_block))
    everywhere = lambda name, count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)
    found = _cells(
        slim.select("*", everywhere("_ab", anchor_blocks)), mined.select("*", everywhere("_rb", row_blocks)), guarded,
        "_a long, _slot int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long, _u long",
    )
    kept = _leading(found, ["_a", "_slot"], "negative_score", "negative_id", negatives, "rank")
    return kept.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
