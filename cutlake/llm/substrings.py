"""Repeated passages: hashes of every word window, counted in Spark, merged into removal intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutlake.llm import words

WINDOW = 20
CHUNK_WINDOWS = 1_000_000
BUCKET_WINDOWS = 2_000_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
LOWEST = -(1 << 63)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of each run of ``size`` word hashes, by doubling: two runs side by side make a longer one."""
    out, length, run, run_length = None, 0, h, 1
    power = lambda n: _U(pow(int(_BASE), n, 1 << 64))
    while size >> length.bit_length() or length < size:
        if (size >> (run_length.bit_length() - 1)) & 1:
            if out is None:
                out, length = run, run_length
            else:
                n = len(h) - length - run_length + 1
                out, length = out[:n] * power(run_length) + run[length : length + n] if n > 0 else h[:0], length + run_length
        if length == size:
            break
        n = len(h) - 2 * run_length + 1
        run = run[:n] * power(run_length) + run[run_length : run_length + n] if n > 0 else h[:0]
        run_length *= 2
    return words.mix(out)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32 in few bytes: byte planes, compressed."""
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def ascending(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0))


def _deltas(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def short(h: np.ndarray) -> bytes:
    """The upper seven bytes of hashes; the bucket that they travel to tells the rest apart."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 1:]).tobytes()


def long(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(-1, 7)
    out = np.zeros((len(parts), 8), np.uint8)
    out[:, 1:] = parts
    return out.view("<u8").ravel()


class _Chunk:
    """Windows of some documents in the order of their ids: place ``p`` is a window of document ``doc_of(p)``."""

    def __init__(self, docs: list[tuple[int, int, np.ndarray]]):
        docs = sorted(docs, key=lambda d: d[:2])
        self.ids = np.array([d[0] for d in docs], dtype=np.int64)
        self.texts = np.array([d[1] for d in docs], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum([len(d[2]) for d in docs]))).astype(np.int64)
        self.hashes = np.concatenate([d[2] for d in docs])

    def head(self) -> bytes:
        """Ids, text digests (32 bits) and first places of all documents: once for the chunk."""
        return pack(np.concatenate([*_halves(self.ids), self.texts & 0xFFFFFFFF, self.first[:-1]]))

    def order(self, places: np.ndarray) -> bytes:
        """Ids and first places of the documents that the places lie in: what their order needs."""
        own = np.unique(_owner(self.first, places))
        return pack(np.concatenate([*_halves(self.ids[own]), np.diff(self.first[own], prepend=0)]))

    def rows(self, buckets: int):
        """For each bucket the hashes that open here and their places; then the places that repeat an earlier one here."""
        order = np.argsort(self.hashes, kind="stable")
        sorted_ = self.hashes[order]
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        doc, lead_doc = _owner(self.first, order), _owner(self.first, lead)
        later = (self.ids[doc] != self.ids[lead_doc]) | (order - self.first[doc] != lead - self.first[lead_doc])
        key = int(words.mix(np.add.reduce(words.mix(self.ids.view(_U)) ^ self.texts.view(_U), keepdims=True))[0].view(np.int64))
        yield key % buckets, key, self.head(), None, ascending(np.sort(order[later]))
        opens = np.sort(order[~later])
        h = self.hashes[opens]
        bucket = (h % _U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
        for b in range(buckets):
            part = opens[by[cuts[b] : cuts[b + 1]]]
            if len(part):
                yield b, key, self.order(part), short(self.hashes[part]), ascending(part)


def _owner(first: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(first, places, side="right") - 1


def _halves(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.diff(ids, prepend=0)
    return steps & 0xFFFFFFFF, (steps >> 32) & 0xFFFFFFFF


def _head(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, text digests, first places of all documents of a chunk."""
    low, high, texts, first = unpack(data).reshape(4, -1)
    return np.cumsum(low | (high << 32)), texts.astype(np.int32).astype(np.int64), first


def _order(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    low, high, first = unpack(data).reshape(3, -1)
    return np.cumsum(low | (high << 32)), np.cumsum(first)


ROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("head", pa.binary()), ("hashes", pa.binary()), ("places", pa.binary())])


def _windows(rows: DataFrame, size: int, buckets: int) -> DataFrame:
    """Every window of ``rows(id, digest, text)`` as packed rows, a chunk of documents by a bucket of hashes each."""

    def run(batches):
        docs, held = [], 0
        for batch in batches:
            ids, digests = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for part in words.slices(batch.column(2)):
                found = part.words()
                if len(found) < size:
                    continue
                every = window_hashes(found.hashes(), size)
                for i in np.flatnonzero(np.diff(found.first) >= size).tolist():
                    a, b = found.first[i], found.first[i + 1] - size + 1
                    docs.append((int(ids[part.at + i]), int(digests[part.at + i]), every[a:b]))
                    held += b - a
                if held >= CHUNK_WINDOWS:
                    yield from batches_of(docs)
                    docs, held = [], 0
        if docs:
            yield from batches_of(docs)

    def batches_of(docs):
        for row in _Chunk(docs).rows(buckets):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, ROW.types)], schema=ROW)

    return rows.mapInArrow(run, "bucket long, chunk long, head binary, hashes binary, places binary")


def _repeats(packed: DataFrame, buckets: int) -> DataFrame:
    """Per chunk and bucket the places of windows that start earlier elsewhere; a chunk's head comes with one of its rows."""
    out = pa.schema([("chunk", pa.int64()), ("head", pa.binary()), ("places", pa.binary())])

    def one(*values):
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, out.types)], schema=out)

    def run(batches):
        held, bucket = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                b, chunk, head, hashes, places = (batch.column(c)[i].as_py() for c in range(5))
                if b != bucket:
                    yield from judged(held)
                    held, bucket = [], b
                if hashes is None:  # judged in its chunk already
                    yield one(chunk, head, places)
                else:
                    held.append((chunk, head, long(hashes), _deltas(places)))
        yield from judged(held)

    def judged(held):
        if len(held) < 2:
            return
        sizes = [len(x[2]) for x in held]
        row = np.repeat(np.arange(len(held)), sizes)
        hashes = np.concatenate([x[2] for x in held])
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        several = np.concatenate((same, [False])) | np.concatenate(([False], same))
        at = order[several]
        if not len(at):
            return
        doc, start = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
        places = np.concatenate([x[3] for x in held])
        for r, (_, head, _, own) in enumerate(held):
            ids, first = _order(head)
            which, span = _owner(first, own), slice(sum(sizes[:r]), sum(sizes[: r + 1]))
            doc[span], start[span] = ids[which], own - first[which]
        at = at[np.lexsort((start[at], doc[at], hashes[at]))]
        new = np.concatenate(([True], hashes[at[1:]] != hashes[at[:-1]]))
        lead = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = at[(doc[at] != doc[lead]) | (start[at] != start[lead])]
        late = late[np.argsort(row[late], kind="stable")]
        cuts = np.searchsorted(row[late], np.arange(len(held) + 1))
        for r, (chunk, *_) in enumerate(held):
            own = late[cuts[r] : cuts[r + 1]]
            if len(own):
                yield one(chunk, None, ascending(np.sort(places[own])))

    met = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(run, "chunk long, head binary, places binary")


def _intervals(found: DataFrame, size: int) -> DataFrame:
    """``_id, _digest, _starts, _ends``: per document the maximal word intervals to remove."""

    def merge(batches):
        held, chunk, head = [], None, None
        for batch in batches:
            for i in range(batch.num_rows):
                c, h, places = (batch.column(k)[i].as_py() for k in range(3))
                if c != chunk:
                    yield from intervals(head, held)
                    held, chunk, head = [], c, None
                held.append(_deltas(places))
                head = h or head
        yield from intervals(head, held)

    def intervals(head, held):
        if not sum(map(len, held)):
            return
        ids, texts, first = _head(head)
        places = np.sort(np.concatenate(held))
        doc = _owner(first, places)
        start = places - first[doc]
        # a window opens an interval unless it begins inside or right behind the one before
        opens = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + size)))
        begin = np.flatnonzero(opens)
        end = np.concatenate((begin[1:], [len(places)])) - 1
        owners, at = np.unique(doc[begin], return_index=True)
        cuts = pa.array(np.concatenate((at, [len(begin)])).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (start[begin], start[end] + size)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[owners]), pa.array(texts[owners]), *lists], names=["_id", "_digest", "_starts", "_ends"])

    met = found.repartition("chunk").sortWithinPartitions("chunk")
    return met.mapInArrow(merge, "_id long, _digest long, _starts array<long>, _ends array<long>")


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: ``id, n_words, n_removed, intervals, kept_text``.

    Words are cut at white space and taken as they are. A word is removed if it lies
    in a run of ``window`` words of its document that also starts earlier: in a
    document with a smaller id or further left in its own. Runs are judged on the
    input. ``intervals`` are the removed ``[first word, end word]``, ``kept_text`` the
    other words joined by one space.

    Ids are whole numbers; a null id counts as smaller than any other. Rows that
    repeat an id are compared by place only, so equal places of equal rows are not
    earlier than one another. A null text has no words. Other columns are ignored.

    Hashes of all windows are dealt into buckets by hash: about one for each
    ``BUCKET_WINDOWS``, so a bucket fits a task at any size of the input. A row of a
    chunk and bucket names only the documents that it has windows of. Of equal
    windows in a chunk of documents only the earliest travels, so a passage that is
    everywhere sends one entry a chunk. Windows are equal if they agree in bucket and
    in 56 more bits of their hash.
    """
    spark = docs.sparkSession
    own, body = F.coalesce(F.col(id).cast("long"), F.lit(LOWEST)), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(own.alias("id"), F.hash(body).cast("long").alias("digest"), body.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (6 * BUCKET_WINDOWS) + 1)
    cuts = _intervals(_repeats(_windows(rows, window, buckets), buckets), window)
    cuts = cuts.groupBy("_id", "_digest").agg(F.first("_starts").alias("_starts"), F.first("_ends").alias("_ends"))
    named = docs.select(F.col(id).alias("_own"), own.alias("_k"), F.hash(body).cast("long").alias("_d"), body.alias("_text"))
    fields = named.schema.fields[:3]

    def squeeze(batches):
        small = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [small.compress(t.encode()) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.binary())], names=["_own", "_k", "_d", "_text"])

    named = named.mapInArrow(squeeze, T.StructType([*fields, T.StructField("_text", T.BinaryType())]))
    met = named.join(cuts.hint("merge"), (F.col("_k") == F.col("_id")) & (F.col("_d") == F.col("_digest")), "left").select("_own", "_text", "_starts", "_ends")

    def rebuild(batches):
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            n, gone, kept = [], [], []
            for t, starts, ends in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                own = large.decompress(t).split()
                n.append(len(own))
                for a, b in zip(reversed(starts or ()), reversed(ends or ())):
                    del own[a:b]
                gone.append(n[-1] - len(own))
                kept.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), batch.column(2), batch.column(3), pa.array(kept, pa.string())], names=["_own", "n_words", "n_removed", "_starts", "_ends", "kept_text"])

    more = T.StructType.fromDDL("n_words long, n_removed long, _starts array<long>, _ends array<long>, kept_text string").fields
    out = met.mapInArrow(rebuild, T.StructType([met.schema["_own"], *more]))
    spans = F.coalesce(F.arrays_zip(F.col("_starts").alias("start"), F.col("_ends").alias("end")), F.array())
    return out.select(F.col("_own").alias(id), "n_words", "n_removed", spans.alias("intervals"), "kept_text")
