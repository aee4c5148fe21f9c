"""Token sequences of a fixed length, packed by a configuration linear program over the length histogram."""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutlake.llm import store
from cutlake.llm.numbering import numbered

CAPACITY, END = 2048, 0
ROUNDS, STEP, GAP, RESERVE = 800, 0.5, 0.0005, 0.125
BATCH = 256


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a byte-level BPE rank file (``*.tiktoken``), once per process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, tokens: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``tokens``, little-endian 32-bit ids) of whole texts.

    A document is the ids of its text and then ``end``; strings of special tokens
    are ordinary text. Only a document of more than ``capacity`` ids is cut: every
    piece has ``capacity`` ids but the first, which takes what is over. A null text
    is empty and gives the piece ``[end]``. Rows that repeat an id have pieces of
    their own.
    """
    fields = [T.StructField("id", docs.schema[id].dataType), *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long, tokens binary").fields]

    def run(batches):
        coder = encoding(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                out, row = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*coder.encode_ordinary(t or ""), end], dtype="<u4")
                    first = (len(ids) - 1) % capacity + 1
                    for k, to in enumerate(range(first, len(ids) + 1, capacity)):
                        start = 0 if k == 0 else to - capacity
                        data = ids[start:to].tobytes()
                        out.append((k, start, to - start, zlib.crc32(data), data if tokens else None))
                        row.append(i)
                own = pc.take(part.column(0), pa.array(row, pa.int64()))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names=[f.name for f in fields])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id)
    return out if tokens else out.drop("tokens")


def best_configuration(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length (ascending) stands in the dearest sequence: a knapsack by dynamic programming."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room], n = best[room - 1], fits[room]
        if n:
            value = best[room - lengths[:n]] + prices[:n]
            j = int(value.argmax())
            if value[j] > best[room]:
                best[room], choice[room] = value[j], j
    counts, room = np.zeros(len(lengths), dtype=np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(lengths[choice[room]])
    return counts


def fractional(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Configurations, their fractional uses and a lower bound of the number of sequences.

    The program asks for the fewest sequences that cover the demand of every
    length. Prices start in proportion to length. Each round prices the best
    configuration, uses it as often as its scarcest length allows and makes what
    it covered cheaper by a factor; uses are scaled at the end so that the mean
    coverage is one. ``demand . prices / best value`` bounds the optimum from below.
    """
    prices, covered, bound = lengths / capacity, np.zeros(len(lengths)), 0.0
    uses: dict[bytes, float] = {}
    total = 0.0
    for _ in range(rounds):
        a = best_configuration(lengths, prices, capacity)
        bound = max(bound, float(demand @ prices) / float(a @ prices))
        a = np.minimum(a, demand)
        used = np.flatnonzero(a)
        step = float((demand[used] / a[used]).min())
        uses[a.tobytes()] = uses.get(a.tobytes(), 0.0) + step
        total += step
        covered[used] += step * a[used] / demand[used]
        prices[used] *= 1 - STEP * np.minimum(1.0, step * a[used] / demand[used])
        prices /= prices.max()
        least = covered.min()
        if least > 0 and total / least <= bound * (1 + GAP):
            break
    scale = 1 / max(float((covered * demand).sum() / demand.sum()), 1e-9)
    return np.array([np.frombuffer(k, np.int64) for k in uses]), np.array(list(uses.values())) * scale, bound


def best_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: sequences of the same make-up are handled together."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length, left in sorted(zip(lengths.tolist(), demand.tolist()), reverse=True):
        while left:
            at = min((r for r in room if r >= length and room[r]), default=None)
            if at is None:
                each = min(capacity // length, left)
                n = left // each
                room.setdefault(capacity - each * length, []).append(((length,) * each, n))
                left -= n * each
            else:
                made, n = room[at].pop()
                each = min(at // length, left)
                k = min(n, left // each)
                room.setdefault(at - each * length, []).append((made + (length,) * each, k))
                if n > k:
                    room[at].append((made, n - k))
                left -= k * each
    return [x for stack in room.values() for x in stack]


def configurations(lengths: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths of a sequence, how many such sequences)`` that hold exactly the demand.

    Fractional uses are rounded down and cut to what is left of all but an eighth of
    each length. A configuration with more than twice the waste that the bound
    makes unavoidable is not used, so that short parts are not spent beside gaps.
    What rounding leaves, a mix of all lengths, is packed by best fit.
    """
    out = [((capacity,), int(n)) for x, n in zip(lengths, demand) if x == capacity and n]
    own = np.flatnonzero((demand > 0) & (lengths < capacity))
    if not len(own):
        return out
    size, need = lengths[own], demand[own].astype(np.int64)
    patterns, uses, bound = fractional(size, need, capacity, rounds)
    kept = np.ceil(RESERVE * need).astype(np.int64)
    need -= kept
    waste = capacity - patterns @ size
    most = 2 * (capacity - float(need @ size) / max(bound, 1e-9))
    for p in np.argsort(waste, kind="stable"):
        used = np.flatnonzero(patterns[p])
        n = min(int(uses[p]), int((need[used] // patterns[p][used]).min()))
        if n > 0 and waste[p] <= most:
            need -= n * patterns[p]
            out.append((tuple(np.repeat(size, patterns[p]).tolist()), n))
    return out + best_fit(size, need + kept, capacity)


def pack(parts: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``: no sequence is longer than ``capacity``, offsets have no gap.

    Only the histogram of lengths (at most ``capacity`` rows) reaches the driver,
    where the program is solved. Parts are numbered by length and then ``order``;
    the n-th part of a length goes to the n-th place of that length in the plan,
    a table bounded by the configurations. Lengths are 1 to ``capacity``; a null
    length is an error. An empty table gives an empty result; columns of ``parts``
    that have the name of a new one are replaced.
    """
    parts = parts.drop("sequence_id", "offset", "_number")
    rows, _ = numbered(parts, [length, *order], "_number")
    counts = [(r[0], r[1]) for r in rows.groupBy(length).count().collect()]
    if any(x is None or not 0 < x <= capacity for x, _ in counts):
        raise ValueError(f"lengths must be 1 to {capacity}")
    counts.sort()
    lengths, demand = np.array([x for x, _ in counts], np.int64), np.array([n for _, n in counts], np.int64)
    first = dict(zip(lengths.tolist(), (np.cumsum(demand) - demand).tolist()))
    places, sequence = [], 0  # first number, sequence, copies in each, offset, length
    for made, n in configurations(lengths, demand, capacity, rounds) if counts else []:
        offset = 0
        for size in sorted(set(made), reverse=True):
            copies = made.count(size)
            places.append((first[size], sequence, copies, offset, size))
            first[size] += n * copies
            offset += copies * size
        sequence += n
    plan = np.array(sorted(places), dtype=np.int64).reshape(-1, 5)
    names = [*parts.columns, "sequence_id", "offset"]

    def place(batches):
        for batch in batches:
            number = np.asarray(batch.column(batch.schema.get_field_index("_number")))
            at = plan[np.searchsorted(plan[:, 0], number, side="right") - 1]
            nth = number - at[:, 0]
            out = [pa.array(at[:, 1] + nth // at[:, 2]), pa.array(at[:, 3] + nth % at[:, 2] * at[:, 4])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out], names=names)

    return rows.mapInArrow(place, T.StructType([*parts.schema.fields, *T.StructType.fromDDL("sequence_id long, offset long").fields]))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, tokens``: the ids of packed pieces (with ``tokens``) side by side; a sequence has at most a capacity of them."""
    own = F.array_sort(F.collect_list(F.struct("offset", F.hex("tokens").alias("t"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.array_join(F.transform(own, lambda x: x["t"]), "")).alias("tokens"))


def pack_documents(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, **how) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Pieces are written once, since a sort by ranges reads its input twice.
    """
    parts = store.keep(pieces(docs, vocabulary, id, text, capacity, **how), "pieces")
    return pack(parts, [id, "piece", "ids_crc32"], capacity=capacity)
